"""Runs of a layer: overlap check and merging of neighbours with equal content.

Both shuffle their runs once, by bucket of tile ids. What neighbouring buckets
have to tell each other is a row or two for each bucket, so it goes through a
window over those rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import BUCKET, between, bucketed, inside


def overlaps(runs: DataFrame, group: Sequence[str] = ("profile",), digest: str = "digest", width: int = 1 << 20) -> DataFrame:
    """Per group: overlapping (runs that begin before their predecessor ends) and first_overlap (its tile id)."""
    cut = bucketed(runs.withColumn("_end", F.col("tile_id") + F.col("run_length")), "tile_id", width)
    bad = F.col("tile_id") < F.lag("_end").over(inside(group, ["tile_id"]))
    seen = cut.withColumn("_bad", F.when(bad, F.col("tile_id")))
    buckets = seen.groupBy(*group, BUCKET).agg(F.count("_bad").alias("_n"), F.min("_bad").alias("_bad"), F.min("tile_id").alias("_first"), F.max_by("_end", "tile_id").alias("_last"))
    carried = buckets.withColumn("_carried", F.when(F.col("_first") < F.lag("_last").over(between(group)), F.col("_first")))
    return carried.groupBy(*group).agg((F.sum("_n") + F.count("_carried")).alias("overlapping"), F.min(F.least("_bad", "_carried")).alias("first_overlap"))


def merge_runs(runs: DataFrame, group: Sequence[str] = ("profile",), digest: str = "digest", width: int = 1 << 20) -> DataFrame:
    """Runs that touch and have the same content become one: (group, tile_id, run_length, digest).

    Neighbours are merged within their bucket first. Only the first and the
    last of what a bucket then has can go on in another bucket.
    """
    cut = bucketed(runs.select(*group, "tile_id", "run_length", F.col(digest).alias("_of")), "tile_id", width)
    order = inside(group, ["tile_id"])
    within = _merged(cut, order, [*group, BUCKET], F.lit(True))
    edges = Window.partitionBy(*group, BUCKET)
    placed = within.withColumns({"_low": F.min("tile_id").over(edges), "_high": F.max("tile_id").over(edges)})
    inner = (F.col("tile_id") > F.col("_low")) & (F.col("tile_id") < F.col("_high"))
    outer = placed.where(~inner).select(*group, BUCKET, "tile_id", "run_length", "_of")
    across = Window.partitionBy(*group).orderBy("tile_id") if group else Window.partitionBy(F.lit(0)).orderBy("tile_id")
    joined = _merged(outer, across, group, F.col(BUCKET) != F.lag(BUCKET).over(across))
    named = [*group, "tile_id", "run_length", F.col("_of").alias(digest)]
    return placed.where(inner).select(*named).unionByName(joined.select(*named))


def _merged(runs: DataFrame, order: Window, kept: Sequence[str], may: Column) -> DataFrame:
    """``runs(kept, tile_id, run_length, _of)`` with each run that touches its predecessor and equals it added to that, where it ``may``."""
    end = F.lag(F.col("tile_id") + F.col("run_length")).over(order)
    goes_on = (F.col("tile_id") == end) & F.col("_of").eqNullSafe(F.lag("_of").over(order)) & may
    marked = runs.withColumn("_start", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("tile_id")))
    island = marked.withColumn("_island", F.max("_start").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*kept, F.col("_island").alias("tile_id")).agg(F.sum("run_length").cast("long").alias("run_length"), F.first("_of").alias("_of"))
