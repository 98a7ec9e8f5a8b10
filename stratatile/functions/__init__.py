"""Column functions: tile ids, geometry, tile encoding, names and credits."""
