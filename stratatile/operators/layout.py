"""Contents of a layer: deduplication by digest, order of first use, offsets, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tileid import zoom_of
from .ordered import prefix_sum


def digested(outputs: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds digest (SHA-256) and length of the payload; rows that a profile left out (null) are dropped."""
    return outputs.where(F.col(payload).isNotNull()).withColumns({"digest": F.unhex(F.sha2(F.col(payload), 256)), "length": F.octet_length(payload).cast("long")})


def distinct_payloads(outputs: DataFrame, group: Sequence[str] = ("profile",), keeps: Sequence[str] = ("payload", "length")) -> DataFrame:
    """One row for each distinct payload of a group, with its digest and the columns ``keeps`` of one of its outputs."""
    return outputs.groupBy(*group, "digest").agg(F.min(F.struct(*keeps)).alias("_of")).select(*group, "digest", "_of.*")


def first_use(runs: DataFrame, group: Sequence[str] = ("profile",), digest: str = "digest") -> DataFrame:
    """(group, digest, first_tile_id)."""
    return runs.groupBy(*group, digest).agg(F.min("tile_id").alias("first_tile_id"))


def lay_out(blobs: DataFrame, group: Sequence[str] = ("profile",), digest: str = "digest", width: int = 1 << 20) -> DataFrame:
    """Adds layout_offset to ``blobs(first_tile_id, digest, length)``: bytes of all blobs used earlier."""
    return prefix_sum(blobs, "length", "first_tile_id", [digest], "layout_offset", group, width)


def layer_stats(runs: DataFrame, group: Sequence[str] = ("profile",), digest: str = "digest") -> DataFrame:
    """Per group: addressed_tiles, entries, contents, min_zoom, max_zoom (of the last tile of any run)."""
    last = F.col("tile_id") + F.col("run_length") - 1
    return runs.groupBy(*group).agg(F.sum("run_length").cast("long").alias("addressed_tiles"), F.count("*").alias("entries"), F.count_distinct(digest).alias("contents"), zoom_of(F.min("tile_id")).alias("min_zoom"), zoom_of(F.max(last)).alias("max_zoom"))
