"""Queries over the driver's tables that exercise the operators, with the SQL that checks them.

The tables hold no tiles, so their numeric columns stand in for tile ids,
offsets and lengths; each query says which.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names, tileid
from .operators import entries, features, layout, runs
from .plans import roundtrip

#: Small buckets, so that the carries between them are used at test sizes.
WIDTH = 512


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _runs(spark: SparkSession, sf_dir: str, length: str = "1") -> DataFrame:
    """Orders as runs: the key is the tile id, the status the content."""
    return _t(spark, sf_dir, "orders").select(F.lit("all").alias("profile"), F.col("o_orderkey").alias("tile_id"), F.expr(f"cast({length} as bigint)").alias("run_length"), F.col("o_orderstatus").alias("digest"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"))


def zoom_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(32).select(F.col("id").cast("int").alias("z"), tileid.first_id(F.col("id")).alias("first_id"))


def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 1 to 4 tiles cut to zooms 4 to 6."""
    return entries.clip_runs(_runs(spark, sf_dir, "1 + o_orderkey % 4"), *tileid.zoom_bounds(4, 6)).select("tile_id", "run_length")


def blob_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as entries: (part, supplier) is (offset, length)."""
    return entries.blob_stats(_t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("offset"), F.col("l_suppkey").alias("length")))


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.merge_runs(_runs(spark, sf_dir), width=WIDTH).select("tile_id", "run_length", F.col("digest").alias("blob"))


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th run is a tile too long."""
    return runs.overlaps(_runs(spark, sf_dir, "1 + if(o_orderkey % 97 = 0, 1, 0)"), width=WIDTH).select("overlapping", "first_overlap")


def blob_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as blobs, used first where a line item mentions them."""
    lines = _t(spark, sf_dir, "lineitem")
    blobs = lines.groupBy(F.col("l_partkey").alias("digest")).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("first_tile_id"), (F.max("l_suppkey") + 1).alias("length")).withColumn("profile", F.lit("all"))
    return layout.lay_out(blobs, width=WIDTH).select(F.col("digest").alias("blob"), "first_tile_id", "length", "layout_offset")


def payload_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as payloads."""
    docs = _t(spark, sf_dir, "documents").select(F.lit("all").alias("profile"), F.encode("lang", "utf-8").alias("payload"), F.col("doc_id").alias("tile_id"))
    made = layout.digested(docs)
    blobs = layout.distinct_payloads(made).join(layout.first_use(made), ["profile", "digest"])
    counts = made.groupBy("digest").agg(F.count("*").alias("n"))
    return blobs.join(counts, "digest").select(F.lower(F.hex("digest")).alias("digest"), "n", "first_tile_id", "length")


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as blobs of their suppliers' weight, cut in eight."""
    blobs = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("offset")).agg(F.sum("l_suppkey").alias("length"))
    return entries.share_cut(blobs, 8, WIDTH).groupBy("share").agg(F.count("*").alias("blobs"), F.sum("length").cast("long").alias("bytes"), F.min("offset").alias("first_offset"))


def feature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as features: two tests that keep rows without the property."""
    events = _t(spark, sf_dir, "events")
    tunnel = F.get_json_object("props", "$.k")
    return events.where(features.is_not(F.col("event_type"), "error") & (F.coalesce(tunnel, F.lit("no")) != "3")).select("event_id")


def hilbert_z12(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("o_custkey") % 4096, (F.col("o_orderkey") * 7) % 4096
    return _t(spark, sf_dir, "orders").select("o_orderkey", tileid.tile_id(F.lit(12), x, y).alias("tile_id"))


def zoom_of_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", tileid.zoom_of(F.col("o_orderkey")).alias("z"))


def hilbert_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tileid.tile_zxy(F.col("o_orderkey"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", t["z"].alias("z"), t["x"].alias("x"), t["y"].alias("y"))


def fanout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as entries of orders as blobs; finished orders have no output."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("offset"), F.lit(1).cast("long").alias("length"), F.col("l_linenumber").cast("long").alias("tile_id"))
    made = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("offset"), F.lit(1).cast("long").alias("length"), F.when(F.col("o_orderstatus") != "F", F.length("o_orderpriority")).alias("payload"))
    return entries.fan_out(lines, made).select(F.col("offset").alias("l_orderkey"), F.col("tile_id").alias("l_linenumber"), F.col("payload").cast("long").alias("n"))


def fanout_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fan-out by grouping: runs per blob, with their total."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("offset"), F.lit(1).cast("long").alias("length"), F.col("l_orderkey").alias("tile_id"), F.lit(1).cast("long").alias("run_length"))
    return entries.grouped_by_blob(lines).select("offset", F.explode("runs").alias("r")).groupBy("offset").agg(F.count("*").alias("entries"), F.sum("r.tile_id").cast("long").alias("ids"))


def profile_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as the profiles of a config."""
    profiles = sorted(r["r_name"] for r in _t(spark, sf_dir, "region").collect())
    return entries.per_profile(_t(spark, sf_dir, "orders").select("o_orderkey"), profiles).withColumnRenamed("profile", "r_name")


def leaf_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.leaf_limits(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tile_id")), 99_999).select("tile_id", F.col("next_id").cast("long").alias("next_id"))


def layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses as layers, priorities as contents."""
    layers = _t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("profile"), F.col("o_orderkey").alias("tile_id"), (F.lit(1) + F.col("o_orderkey") % 4).alias("run_length"), F.col("o_orderpriority").alias("digest"))
    return layout.layer_stats(layers)


def buffered_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = features.square(F.col("p_size"), 4)
    return _t(spark, sf_dir, "part").select("p_partkey", s["low"].alias("low"), s["high"].alias("high"))


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names as credits; every third declares none, every fifth has no template."""
    declared = F.when(F.col("s_suppkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("s_name")))
    template = F.when(F.col("s_suppkey") % 5 == 0, F.lit(None)).when(F.col("s_suppkey") % 2 == 0, F.lit("Own credit")).otherwise(F.lit("Mine, {source}"))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", names.credited(declared, template).alias("credit"))


def name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("-"), F.col("c_name"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.col("c_name"), F.lit("/x"))).otherwise(F.regexp_replace("c_name", "#", "_"))
    return _t(spark, sf_dir, "customer").select("c_custkey", names.valid_layer_name(tried).alias("valid"))


def missing_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event kinds a user has, as listed layers: which required one is missing."""
    listed = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("listed"))
    required = frozenset({"click", "error", "purchase", "view"})
    return listed.select("user_id", F.array_join(features.missing_layers(F.col("listed"), required), ",").alias("missing"), F.array_join(features.fitting_schemas(F.col("listed"), {"one": frozenset({"click", "view"}), "two": frozenset({"purchase"})}), ",").alias("fits"))


def union_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("tile_id"), F.lit("orders").alias("layer"))
    second = _t(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("tile_id"), F.lit("lines").alias("layer"))
    return first.unionByName(second)


def sorted_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _t(spark, sf_dir, "orders").select(F.lit("all").alias("profile"), F.col("o_orderkey").alias("tile_id"), F.col("o_orderpriority").alias("digest"))
    counts = made.groupBy("digest").agg(F.count("*").alias("n"))
    return layout.first_use(made).join(counts, "digest").select(F.col("digest").alias("blob"), "n", "first_tile_id").orderBy("first_tile_id")


def layer_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole layer over orders as entries: clip, drop, merge, deduplicate, lay out."""
    clipped = entries.clip_runs(_runs(spark, sf_dir), *tileid.zoom_bounds(3, 6)).where("digest <> 'P'")
    merged = runs.merge_runs(clipped, width=WIDTH)
    blobs = layout.first_use(merged).withColumn("length", F.ascii("digest").cast("long"))
    placed = layout.lay_out(blobs, width=WIDTH).select("digest", "layout_offset", "length")
    return merged.join(placed, "digest").select("tile_id", "run_length", F.col("layout_offset").alias("offset"), "length")


QUERIES = {
    f.__name__: f
    for f in (layer_pipeline, zoom_bounds, clip, blob_count, islands, overlap, blob_layout, payload_dedup, shares, feature_set, hilbert_z12, zoom_of_id, hilbert_inverse, fanout_join, fanout_grouped, profile_cross, leaf_bound, layer_stats, buffered_square, attribution, name_check, missing_layers, union_layers, sorted_dedup)
} | roundtrip.QUERIES

_ISLANDS = """
SELECT min(tile_id) AS tile_id, CAST(sum(run_length) AS BIGINT) AS run_length, any_value(blob) AS blob FROM (
  SELECT *, sum(starts) OVER (ORDER BY tile_id) AS island FROM (
    SELECT *, CASE WHEN lag(tile_id + run_length) OVER (ORDER BY tile_id) = tile_id AND lag(blob) OVER (ORDER BY tile_id) = blob THEN 0 ELSE 1 END AS starts
    FROM ({source}))) GROUP BY island"""

ORACLE_SQL = {
    "zoom_bounds": "SELECT CAST(z AS INTEGER) AS z, ((1::BIGINT << (2 * z)) - 1) // 3 AS first_id FROM range(32) t(z)",
    "clip": "SELECT greatest(t, 85) AS tile_id, least(t + n, 5461) - greatest(t, 85) AS run_length FROM (SELECT o_orderkey AS t, 1 + o_orderkey % 4 AS n FROM orders) WHERE t < 5461 AND t + n > 85",
    "blob_count": "SELECT count(*) AS blobs, CAST(sum(s) AS BIGINT) AS blob_bytes FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)",
    "islands": _ISLANDS.format(source="SELECT o_orderkey AS tile_id, 1 AS run_length, o_orderstatus AS blob FROM orders"),
    "overlap": "SELECT count(*) FILTER (t < e) AS overlapping, min(t) FILTER (t < e) AS first_overlap FROM (SELECT t, lag(t + n) OVER (ORDER BY t) AS e FROM (SELECT o_orderkey AS t, 1 + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS n FROM orders))",
    "blob_layout": "SELECT *, CAST(coalesce(sum(length) OVER (ORDER BY first_tile_id, blob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS layout_offset FROM (SELECT l_partkey AS blob, min(l_orderkey * 8 + l_linenumber) AS first_tile_id, max(l_suppkey) + 1 AS length FROM lineitem GROUP BY 1)",
    "payload_dedup": "SELECT sha256(lang) AS digest, count(*) AS n, min(doc_id) AS first_tile_id, CAST(any_value(strlen(lang)) AS BIGINT) AS length FROM documents WHERE lang IS NOT NULL GROUP BY 1",
    "shares": """
WITH b AS (SELECT l_partkey AS o, CAST(sum(l_suppkey) AS BIGINT) AS w FROM lineitem GROUP BY 1),
s AS (SELECT o, w, row_number() OVER (ORDER BY o) - 1 AS i, sum(w) OVER (ORDER BY o) - w AS seen, sum(w) OVER () AS total FROM b),
f AS (SELECT o, w, i, least(7, CASE WHEN seen = 0 THEN 0 ELSE seen * 8 // total END) - i AS gap FROM s),
g AS (SELECT o, w, i + min(gap) OVER (ORDER BY o) AS share FROM f)
SELECT CAST(share AS INTEGER) AS share, count(*) AS blobs, CAST(sum(w) AS BIGINT) AS bytes, min(o) AS first_offset FROM g GROUP BY 1""",
    "feature_set": "SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'error' AND coalesce(json_extract_string(props, '$.k'), 'no') <> '3'",
    "hilbert_z12": """
WITH RECURSIVE walk(k, b, d, x, y) AS (
  SELECT o_orderkey, 12, 0::BIGINT, (o_custkey % 4096)::BIGINT, ((o_orderkey * 7) % 4096)::BIGINT FROM orders
  UNION ALL
  SELECT k, b - 1, d + (1::BIGINT << (2 * (b - 1))) * xor(3 * ((x >> (b - 1)) & 1), (y >> (b - 1)) & 1),
    CASE WHEN (y >> (b - 1)) & 1 = 0 THEN CASE WHEN (x >> (b - 1)) & 1 = 1 THEN (1::BIGINT << (b - 1)) - 1 - (y & ((1::BIGINT << (b - 1)) - 1)) ELSE y & ((1::BIGINT << (b - 1)) - 1) END ELSE x & ((1::BIGINT << (b - 1)) - 1) END,
    CASE WHEN (y >> (b - 1)) & 1 = 0 THEN CASE WHEN (x >> (b - 1)) & 1 = 1 THEN (1::BIGINT << (b - 1)) - 1 - (x & ((1::BIGINT << (b - 1)) - 1)) ELSE x & ((1::BIGINT << (b - 1)) - 1) END ELSE y & ((1::BIGINT << (b - 1)) - 1) END
  FROM walk WHERE b > 0)
SELECT k AS o_orderkey, d + ((1::BIGINT << 24) - 1) // 3 AS tile_id FROM walk WHERE b = 0""",
    "zoom_of_id": "SELECT o_orderkey, CAST((length(bin(3 * o_orderkey + 1)) - 1) // 2 AS INTEGER) AS z FROM orders",
    "hilbert_inverse": """
WITH RECURSIVE zoomed AS (SELECT o_orderkey AS k, (length(bin(3 * o_orderkey + 1)) - 1) // 2 AS z FROM orders),
walk(k, z, b, d, x, y) AS (
  SELECT k, z, 0, k - ((1::BIGINT << (2 * z)) - 1) // 3, 0::BIGINT, 0::BIGINT FROM zoomed
  UNION ALL
  SELECT k, z, b + 1, d >> 2,
    CASE WHEN xor(d, (d >> 1) & 1) & 1 = 0 THEN CASE WHEN (d >> 1) & 1 = 1 THEN (1::BIGINT << b) - 1 - y ELSE y END ELSE x END + (((d >> 1) & 1) << b),
    CASE WHEN xor(d, (d >> 1) & 1) & 1 = 0 THEN CASE WHEN (d >> 1) & 1 = 1 THEN (1::BIGINT << b) - 1 - x ELSE x END ELSE y END + ((xor(d, (d >> 1) & 1) & 1) << b)
  FROM walk WHERE b < z)
SELECT k AS o_orderkey, CAST(z AS INTEGER) AS z, x, y FROM walk WHERE b = z""",
    "fanout_join": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, length(o_orderpriority) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'",
    "fanout_grouped": 'SELECT l_partkey AS "offset", count(*) AS entries, CAST(sum(l_orderkey) AS BIGINT) AS ids FROM lineitem GROUP BY 1',
    "profile_cross": "SELECT o_orderkey, r_name FROM orders CROSS JOIN region",
    "leaf_bound": "SELECT c_custkey AS tile_id, lead(c_custkey, 1, CAST(99999 AS BIGINT)) OVER (ORDER BY c_custkey) AS next_id FROM customer",
    "layer_stats": "SELECT o_orderstatus AS profile, CAST(sum(1 + o_orderkey % 4) AS BIGINT) AS addressed_tiles, count(*) AS entries, count(DISTINCT o_orderpriority) AS contents, CAST((length(bin(3 * min(o_orderkey) + 1)) - 1) // 2 AS INTEGER) AS min_zoom, CAST((length(bin(3 * max(o_orderkey + o_orderkey % 4) + 1)) - 1) // 2 AS INTEGER) AS max_zoom FROM orders GROUP BY 1",
    "buffered_square": "SELECT p_partkey, -(p_size * 4 / 256.0)::DOUBLE AS low, (p_size + p_size * 4 / 256.0)::DOUBLE AS high FROM part",
    "attribution": """
SELECT s_suppkey, CASE WHEN template IS NULL THEN own WHEN contains(template, '{source}') AND own IS NULL THEN NULL ELSE trim(replace(template, '{source}', coalesce(own, ''))) END AS credit FROM (
  SELECT s_suppkey, nullif(trim(CASE WHEN s_suppkey % 3 = 0 THEN '  ' ELSE ' ' || s_name END), '') AS own,
    CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'Own credit' ELSE 'Mine, {source}' END AS template FROM supplier)""",
    "name_check": "SELECT c_custkey, regexp_full_match(CASE WHEN c_custkey % 4 = 0 THEN '-' || c_name WHEN c_custkey % 4 = 1 THEN c_name || '/x' ELSE replace(c_name, '#', '_') END, '[A-Za-z0-9][A-Za-z0-9._-]*') AS valid FROM customer",
    "missing_layers": """
SELECT user_id, coalesce(string_agg(DISTINCT need, ',' ORDER BY need) FILTER (NOT list_contains(listed, need)), '') AS missing,
  concat_ws(',', CASE WHEN any_value(list_has_all(listed, ['click', 'view'])) THEN 'one' END, CASE WHEN any_value(list_contains(listed, 'purchase')) THEN 'two' END) AS fits
FROM (SELECT user_id, list(DISTINCT event_type) AS listed FROM events GROUP BY 1) CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'view']) AS need) GROUP BY 1""",
    "union_layers": "SELECT o_orderkey AS tile_id, 'orders' AS layer FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey, 'lines' FROM lineitem WHERE l_linenumber = 1",
    "sorted_dedup": "SELECT o_orderpriority AS blob, count(*) AS n, min(o_orderkey) AS first_tile_id FROM orders GROUP BY 1 ORDER BY 3",
    "layer_pipeline": f"""
WITH runs AS ({_ISLANDS.format(source="SELECT o_orderkey AS tile_id, 1 AS run_length, o_orderstatus AS blob FROM orders WHERE o_orderkey >= 21 AND o_orderkey < 5461 AND o_orderstatus <> 'P'")}),
blobs AS (SELECT blob, min(tile_id) AS first_id, ascii(blob) AS length FROM runs GROUP BY 1),
placed AS (SELECT *, CAST(coalesce(sum(length) OVER (ORDER BY first_id, blob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS layout_offset FROM blobs)
SELECT tile_id, run_length, layout_offset AS "offset", CAST(length AS BIGINT) AS length FROM runs JOIN placed USING (blob)""",
} | roundtrip.ORACLE_SQL
