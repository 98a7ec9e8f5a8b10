"""Queries that build an archive from a table, convert it and read the layers back.

The archive is written by the engine's own codec and sink: tiles are encoded
from features, equal ones stored once. What comes back is what any reader of
the layer would see, so the whole conversion is checked by SQL over the table.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mvt, wkb
from ..operators import layout, runs
from ..scratch import checkpoint_root, materialize
from ..shipping import ship
from ..sources.pmtiles import Header, open_archive
from ..sources.reader import read_blobs, read_entries
from ..sources.writer import write_layer
from .config import RunConfig
from .convert import convert, decode_tiles

#: Zooms 0 to 6 have so many tiles; the tile with number i has the row whose key is i.
MAX_ZOOM, TILES = 6, 5461
METADATA = {"attribution": "&copy; Rows", "vector_layers": [{"id": "earth", "fields": {}}, {"id": "water", "fields": {"kind": "String"}}]}
PROFILES = {
    "lakes": "return [f for f in tile.features(SURFACE_WATER)]",
    "streams": "return tile.features(WATERWAYS)",
    "land": "return subtract_water(tile, tile.buffered_square)",
}
PROFILE = """
from stratatile.plans.profile import Profile, subtract_water
from stratatile.plans.schema import SURFACE_WATER, WATERWAYS

class Made(Profile):
    name = {name!r}
    def transform(self, tile):
        {body}

PROFILE = Made
"""


def box(x: int, y: int, side: int) -> bytes:
    return wkb.dump("Polygon", [[(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]])


def tiles_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile_id, payload): earth everywhere; finished orders are lakes, open ones streams, others have a tunnel."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for key, status, customer in zip(*(c.to_pylist() for c in b.columns), strict=True):
                water = []
                if status == "F":
                    water.append({"wkb": box(512 * (customer % 4), 1024, 1024), "props": {"kind": "lake", "n": ("uint", customer % 4)}})
                elif status == "O":
                    water.append({"wkb": wkb.dump("LineString", [(0, 0), (100 + customer % 3, 50)]), "props": {"kind": "stream", "deep": customer % 2 == 0}})
                else:
                    water.append({"wkb": box(0, 0, 2048), "props": {"kind": "water", "tunnel": "yes"}})
                made.append(mvt.encode([{"name": "earth", "features": [{"wkb": box(0, 0, 4096), "props": {}}]}, {"name": "water", "features": water}], 4096))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["tile_id", "payload"])

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderkey") < TILES)
    return orders.select("o_orderkey", "o_orderstatus", "o_custkey").mapInArrow(run, "tile_id long, payload binary")


def write_archive(tiles: DataFrame, path: str, max_zoom: int, metadata: dict) -> None:
    """``tiles(tile_id, payload)`` as an archive: runs merged, contents stored once in order of first use."""
    stored = materialize(layout.digested(tiles.withColumn("profile", F.lit(0))), "stored")
    merged = materialize(runs.merge_runs(stored.select("profile", "tile_id", F.lit(1).cast("long").alias("run_length"), "digest")), "stored-runs")
    blobs = materialize(layout.lay_out(layout.distinct_payloads(stored, keeps=("length",)).join(layout.first_use(merged), ["profile", "digest"])), "stored-blobs")
    payloads = layout.distinct_payloads(stored, keeps=("payload",)).join(blobs.select("digest", "layout_offset"), "digest")
    stats = layout.layer_stats(merged).first()
    write_layer(merged, blobs, payloads, stats, metadata, Header(min_zoom=0, max_zoom=max_zoom, min_lon_e7=-1800000000, min_lat_e7=-850511287, max_lon_e7=1800000000, max_lat_e7=850511287), path, tiles.sparkSession.sparkContext.defaultParallelism)


def converted(spark: SparkSession, sf_dir: str, low: int = 0, high: int = MAX_ZOOM) -> dict[str, str]:
    """Paths of the layers made from an archive of the orders, by name."""
    root = checkpoint_root(spark).removeprefix("file://")
    os.makedirs(root, exist_ok=True)
    folder = Path(tempfile.mkdtemp(dir=root))
    source = str(folder / "orders.pmtiles")
    write_archive(tiles_of_orders(spark, sf_dir), source, MAX_ZOOM, METADATA)
    for name, body in PROFILES.items():
        (folder / f"{name}.py").write_text(PROFILE.format(name=name, body=body), encoding="utf-8")
    config = RunConfig(tuple(str(folder / f"{name}.py") for name in PROFILES), "protomaps", low, high, "Made, {source}")
    written = convert(spark, config, source, str(folder / "out"))
    return {Path(p).stem: p for p in written}


def convert_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the lakes and streams of zooms 2 to 6, with a number for each content in order of first use."""
    done = None
    for name, path in converted(spark, sf_dir, low=2).items():
        if name != "land":
            part = read_entries(spark, path)
            first = part.groupBy("offset").agg(F.min("tile_id").alias("first_tile_id"))
            rows = part.join(first, "offset").select(F.lit(name).alias("layer"), "tile_id", "run_length", "first_tile_id")
            done = rows if done is None else done.unionByName(rows)
    return done


def convert_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What header and metadata of each layer say."""
    done = None
    for name, path in converted(spark, sf_dir, 1, 5).items():
        h = read_entries(spark, path, part="header")
        field = lambda key: F.get_json_object("metadata_json", f"$.{key}")
        rows = h.select(F.lit(name).alias("layer"), "addressed_tiles", "tile_contents", "clustered", "min_zoom", "max_zoom", "min_lon_e7", "max_lat_e7", field("name").alias("name"), field("attribution").alias("attribution"), field("minzoom").alias("minzoom"), field("vector_layers[0].id").alias("layer_id"))
        done = rows if done is None else done.unionByName(rows)
    return done


def _decoded(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, layer, geom_type, wkb, props) of every feature of every tile of an archive; runs are spread out."""
    blobs = read_entries(spark, path)
    distinct = blobs.groupBy("offset", "length").agg(F.min("tile_id").alias("tile_id"), F.min("run_length").alias("run_length"))
    tiles = decode_tiles(read_blobs(distinct, open_archive(path), 2)).select("offset", "length", F.explode("layers").alias("layer")).select("offset", "length", F.col("layer.name").alias("layer"), F.explode("layer.features").alias("f"))
    spread = blobs.select("offset", "length", F.explode(F.sequence(F.col("tile_id"), F.col("tile_id") + F.col("run_length") - 1)).alias("tile_id"))
    return spread.join(tiles, ["offset", "length"]).select("tile_id", "layer", "f.geom_type", "f.wkb", "f.props")


def convert_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of lakes and streams as decoded from the layers, with extremes of their geometry."""
    made = converted(spark, sf_dir)
    done = None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(3).to_pylist():
                points = wkb.load(data)[1]
                points = points[0] if isinstance(points[0], list) else points
                rows.append((int(min(p[0] for p in points)), int(min(p[1] for p in points)), int(max(p[0] for p in points)), int(max(p[1] for p in points))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), b.column(5), b.column(6), *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4))], names=["tile_id", "layer", "geom_type", "kind", "n", "deep", "x0", "y0", "x1", "y1"])

    for name in ("lakes", "streams"):
        rows = _decoded(spark, made[name])
        prop = lambda key, part: F.try_element_at("props", F.lit(key))[part]
        flat = rows.select("tile_id", "layer", "geom_type", "wkb", prop("kind", "s").alias("kind"), F.coalesce(prop("n", "i").cast("long"), F.lit(-1)).alias("n"), F.coalesce(prop("deep", "b").cast("string"), F.lit("")).alias("deep"))
        part = flat.mapInArrow(measure, "tile_id long, layer string, geom_type string, kind string, n long, deep string, x0 long, y0 long, x1 long, y1 long")
        done = part if done is None else done.unionByName(part)
    return done


def convert_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the area of the land of each tile: the buffered square without its lakes."""
    path = converted(spark, sf_dir, high=5)["land"]

    def area(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(1).to_pylist():
                kind, rings = wkb.load(data)
                parts = rings if kind == "MultiPolygon" else [rings]
                turn = lambda r: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:], strict=False)))
                out.append(int(sum(turn(p[0]) - sum(map(turn, p[1:])) for p in parts)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["tile_id", "area2"])

    return _decoded(spark, path).select("tile_id", "wkb").mapInArrow(area, "tile_id long, area2 long")


QUERIES = {f.__name__: f for f in (convert_entries, convert_headers, convert_features, convert_land)}

_TILES = f"SELECT o_orderkey AS t, o_orderstatus AS s, o_custkey AS c FROM orders WHERE o_orderkey < {TILES}"
#: What the bytes of a tile of a layer depend on.
_CONTENT = "SELECT 'lakes' AS layer, t, c % 4 AS content FROM tiles WHERE s = 'F' UNION ALL SELECT 'streams', t, (c % 3) * 2 + c % 2 FROM tiles WHERE s = 'O'"
_LAND = "UNION ALL SELECT 'land', t, CASE WHEN s = 'F' THEN c % 4 ELSE 9 END FROM tiles"

#: Water is grown by half a unit before it is cut out; on the grid that adds a strip of one unit on two sides of a box.
ORACLE_SQL = {
    "convert_entries": f"""
WITH tiles AS ({_TILES} AND o_orderkey >= 5), made AS ({_CONTENT}),
marked AS (SELECT *, CASE WHEN lag(t) OVER w = t - 1 AND lag(content) OVER w = content THEN 0 ELSE 1 END AS starts FROM made WINDOW w AS (PARTITION BY layer ORDER BY t)),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY layer ORDER BY t) AS island FROM marked)
SELECT layer, min(t) AS tile_id, count(*) AS run_length, min(first_id) AS first_tile_id FROM (SELECT *, min(t) OVER (PARTITION BY layer, content) AS first_id FROM islands) GROUP BY layer, island""",
    "convert_headers": f"""
WITH tiles AS ({_TILES} AND o_orderkey >= 1 AND o_orderkey < 1365), made AS ({_CONTENT} {_LAND}), zoomed AS (SELECT *, (length(bin(3 * t + 1)) - 1) // 2 AS z FROM made)
SELECT layer, count(*) AS addressed_tiles, count(DISTINCT content) AS tile_contents, 1::BIGINT AS clustered, min(z) AS min_zoom, max(z) AS max_zoom, -1800000000::BIGINT AS min_lon_e7, 850511287::BIGINT AS max_lat_e7,
  layer AS name, 'Made, &copy; Rows' AS attribution, '1' AS minzoom, layer AS layer_id FROM zoomed GROUP BY layer""",
    "convert_features": f"""
WITH tiles AS ({_TILES})
SELECT t AS tile_id, 'lakes' AS layer, 'Polygon' AS geom_type, 'lake' AS kind, c % 4 AS n, '' AS deep, 512 * (c % 4) AS x0, 1024::BIGINT AS y0, 512 * (c % 4) + 1024 AS x1, 2048::BIGINT AS y1 FROM tiles WHERE s = 'F'
UNION ALL SELECT t, 'streams', 'LineString', 'stream', -1, CAST(c % 2 = 0 AS VARCHAR), 0, 0, 100 + c % 3, 50 FROM tiles WHERE s = 'O'""",
    "convert_land": f"SELECT t AS tile_id, 2 * (4352::BIGINT * 4352 - CASE WHEN s = 'F' THEN 1024 * 1024 + 2 * 1024 ELSE 0 END) AS area2 FROM ({_TILES} AND o_orderkey < 1365)",
}
