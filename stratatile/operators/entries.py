"""Directory entries: range filter, clipping, distinct blobs, equal shares, leaf bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import BUCKET, between, bucketed, inside, with_summary


def overlapping(start: int, limit: int) -> Column:
    """Runs that touch [start, limit); those that reach over an end are kept whole."""
    return (F.col("tile_id") < limit) & (F.col("tile_id") + F.col("run_length") > start)


def clip_runs(entries: DataFrame, start: int, limit: int) -> DataFrame:
    """Runs cut to [start, limit); a run is never unrolled into tiles."""
    first = F.greatest(F.col("tile_id"), F.lit(start).cast("long"))
    end = F.least(F.col("tile_id") + F.col("run_length"), F.lit(limit).cast("long"))
    return entries.where(overlapping(start, limit)).withColumns({"tile_id": first, "run_length": end - first}).where("run_length > 0")


def distinct_blobs(entries: DataFrame) -> DataFrame:
    """(offset, length) once each, whatever the order of the entries."""
    return entries.select("offset", "length").distinct()


def blob_stats(entries: DataFrame) -> DataFrame:
    """One row: blobs, blob_bytes; each blob counts once."""
    return distinct_blobs(entries).agg(F.count("*").alias("blobs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("blob_bytes"))


def leaf_limits(pointers: DataFrame, limit: int) -> DataFrame:
    """Adds next_id: the next pointer's tile id, or the range's end for the last.

    A directory has at most a few thousand pointers, so one window does.
    """
    return pointers.withColumn("next_id", F.lead("tile_id", 1, limit).over(Window.orderBy("tile_id")))


def share_cut(blobs: DataFrame, shares: int, width: int = 1 << 24) -> DataFrame:
    """Adds share (0 to shares - 1) to ``blobs(offset, length)``: consecutive blobs of about equal bytes.

    A blob is never split, and a share never starts twice at one blob: with i
    the blob's place and f the share that its preceding bytes would put it in,
    the share is i + min(f - i) over it and all blobs before. Zero-length
    blobs weigh nothing. Ties of offset go by length.
    """
    cut = bucketed(blobs, "offset", width)
    order = inside([], ["offset", "length"])
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = cut.groupBy(BUCKET).agg(F.sum("length").alias("_bytes"), F.count("*").alias("_rows"))
    before = totals.select(BUCKET, (F.sum("_bytes").over(between([])) - F.col("_bytes")).alias("_bytes_before"), (F.sum("_rows").over(between([])) - F.col("_rows")).alias("_rows_before"), F.sum("_bytes").over(Window.partitionBy(F.lit(0))).alias("_all"))
    placed = with_summary(cut.withColumns({"_seen": F.sum("length").over(upto) - F.col("length"), "_i": F.row_number().over(order) - 1}), before, []).withColumns({"_seen": F.col("_seen") + F.col("_bytes_before"), "_i": F.col("_i") + F.col("_rows_before")})
    wish = F.least(F.lit(shares - 1).cast("long"), F.when(F.col("_seen") == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", F.col("_seen") * shares, F.col("_all"))))
    placed = placed.withColumn("_gap", wish - F.col("_i")).drop("_seen", "_bytes_before", "_rows_before", "_all")
    lows = placed.groupBy(BUCKET).agg(F.min("_gap").alias("_low")).select(BUCKET, F.min("_low").over(between([]).rowsBetween(Window.unboundedPreceding, -1)).alias("_low_before"))
    least = F.min("_gap").over(upto)
    return with_summary(placed.withColumn("_least", least), lows, []).withColumn("share", (F.col("_i") + F.least(F.col("_least"), F.coalesce("_low_before", "_least"))).cast("int")).drop(BUCKET, "_gap", "_i", "_least", "_low_before")


def share_count(entries: int, blob_bytes: int, parallelism: int, per_task: int = 8, most_bytes: int = 64 << 20) -> int:
    """How many shares to cut: several for each slot, more if they would be over ``most_bytes``, never more than entries."""
    wanted = parallelism * per_task if parallelism > 1 else 1
    return max(1, min(entries, max(wanted, -(-blob_bytes // most_bytes))))


def fan_out(entries: DataFrame, outputs: DataFrame, kept: str = "payload") -> DataFrame:
    """Entries with what their blob became: N to 1 on (offset, length), left-out outputs (null in ``kept``) dropped."""
    return entries.join(outputs.where(F.col(kept).isNotNull()), ["offset", "length"])


def grouped_by_blob(entries: DataFrame, most: int = 100_000) -> DataFrame:
    """(offset, length, runs array<struct<tile_id, run_length>>): the same fan-out without a join.

    A blob that very many entries share, such as open ocean, gets several
    rows of about ``most`` runs at most, so no row grows with the archive.
    """
    salted = entries.withColumn("_n", F.count("*").over(Window.partitionBy("offset", "length", F.pmod(F.xxhash64("tile_id"), F.lit(1024))).orderBy("tile_id")))
    return salted.groupBy("offset", "length", F.floor(F.col("_n") * 1024 / most).alias("_salt")).agg(F.sort_array(F.collect_list(F.struct("tile_id", "run_length"))).alias("runs")).drop("_salt")


def per_profile(runs: DataFrame, profiles: Sequence[str]) -> DataFrame:
    """Every run for every profile that a run config lists."""
    return runs.withColumn("profile", F.explode(F.array(*map(F.lit, profiles))))
