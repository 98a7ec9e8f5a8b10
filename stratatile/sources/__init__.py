"""PMTiles archives as a Spark data source and as a sink."""
