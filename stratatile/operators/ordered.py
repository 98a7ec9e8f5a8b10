"""Running values over a long order without one task that sees it all.

A window without PARTITION BY goes to a single task. Here the order is cut
into buckets of a numeric leading column; windows run within a bucket, and
what a bucket needs from those before it comes from one summary row for each
bucket. Buckets are of fixed width, so nothing has to be sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = "_bucket"


def bucketed(df: DataFrame, by: str, width: int) -> DataFrame:
    return df.withColumn(BUCKET, F.floor(F.col(by) / F.lit(width)).cast("long"))


def inside(group: Sequence[str], order: Sequence[str]) -> Window:
    """Window over a bucket in order."""
    return Window.partitionBy(*group, BUCKET).orderBy(*order)


def between(group: Sequence[str]) -> Window:
    """Window over the summary rows of all buckets of a group."""
    return (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(BUCKET)


def same_group(group: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    condition = left[BUCKET] == right[BUCKET]
    for g in group:
        condition &= left[g].eqNullSafe(right[g])
    return condition


def with_summary(df: DataFrame, summary: DataFrame, group: Sequence[str]) -> DataFrame:
    """Joins the summary row of its bucket to every row."""
    kept = [c for c in summary.columns if c != BUCKET and c not in group]
    renamed = summary.select(F.col(BUCKET).alias("_b"), *[F.col(g).alias(f"_g_{g}") for g in group], *kept)
    condition = F.col(BUCKET) == F.col("_b")
    for g in group:
        condition &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return df.join(renamed, condition, "left").drop("_b", *[f"_g_{g}" for g in group])


def prefix_sum(df: DataFrame, value: str, by: str, ties: Sequence[str], name: str, group: Sequence[str] = (), width: int = 1 << 20, inclusive: bool = False) -> DataFrame:
    """Adds the sum of ``value`` over all rows before this one in the order of (by, *ties)."""
    cut = bucketed(df, by, width)
    totals = cut.groupBy(*group, BUCKET).agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(between(group)) - F.col("_total")).drop("_total")
    running = F.sum(value).over(inside(group, [by, *ties]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.lit(0) if inclusive else F.col(value)
    return with_summary(cut.withColumn("_running", running), before, group).withColumn(name, (F.col("_before") + F.col("_running") - own).cast("long")).drop(BUCKET, "_before", "_running")
