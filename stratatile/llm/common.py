"""What the operators share: written tables, word rules and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import discard, materialize
from ..shipping import ship

#: A word is a run of bytes other than space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to a-z and nothing else (Spark's lower() follows Unicode)."""
    return F.translate(col, UPPER, LOWER)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that Python objects exist for few rows at a time."""
    for b in batches:
        for i in range(0, max(b.num_rows, 1), rows):
            yield b.slice(i, rows)


def in_workers(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in workers that can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.split() breaks at exactly \\x20 and \\x09-\\x0D."""
    return text.lower().split()


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the smallest index that it reaches."""
    n = len(linked)
    root = np.arange(n)
    while True:
        near = np.minimum(root, np.where(linked, root[None, :], n).min(1, initial=n))
        near = near[near]
        if (near == root).all():
            return root
        root = near


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: int, share: int = 2_000) -> DataFrame:
    """``left`` joined to ``right(key, n, ...)``, which has one row for each key of left and how often left has it.

    Keys that more than one in ``share`` of left's ``rows`` have are fewer than
    ``share``: they meet their row by a broadcast, so none is a task of its own.
    The others meet theirs by a shuffle.
    """
    often = F.col("n") * F.lit(share) > F.lit(rows)
    value = F.struct(*[c for c in right.columns if c not in (key, "n")])
    hot = right.where(often).select(F.col(key).alias("_key"), value.alias("_value"))
    met = left.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    known = met.where("_key is not null").select(*left.columns, "_value.*")
    others = met.where("_key is null").select(*left.columns).join(right.where(~often).drop("n").hint("shuffle_merge"), key)
    return known.unionByName(others.select(*known.columns))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges(a, b)``; component: the smallest node reachable.

    Each round hooks every node to the neighbour that comes first in an order
    hashed anew, itself included, jumps pointers until they name roots, and
    goes on with the edges between roots. At least half of the nodes that have
    an edge are hooked on average, whatever the shape of the graph, and one is
    always, so the rounds end by themselves; all tables shrink with the nodes.
    Nodes with very many edges, and roots that very many nodes name, meet
    their row by ``join_hot``; aggregates at them are minima and counts, made
    before the shuffle.
    """
    left = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while ends := 2 * left.count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = lambda c, r=len(rounds): F.struct(F.xxhash64(F.lit(r), c).alias("h"), F.col(c).alias("n"))
        near = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("first"), F.count("*").alias("n")), "near")
        up = _roots(materialize(near.select("node", F.least("first", place("node"))["n"].alias("up")), "hooks"))
        rounds.append(up)
        root_of = materialize(near.select("node", "n").join(up, "node"), "near")
        met = left
        for end, root in (("a", "x"), ("b", "y")):
            met = join_hot(met, root_of.select(F.col("node").alias(end), "n", F.col("up").alias(root)), end, ends)
        done_with, left = left, materialize(met.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(done_with, near, root_of)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    done = rounds.pop()
    while rounds:  # roots of a round that had edges left are nodes of the next
        below, above = rounds.pop(), done.select(F.col("node").alias("up"), F.col("up").alias("root"))
        named = below.groupBy("up").agg(F.count("*").alias("n")).join(above, "up", "left").select("up", "n", F.coalesce("root", "up").alias("root"))
        done = materialize(join_hot(below, named, "up", below.count()).select("node", F.col("root").alias("up")), "labels")
    lowest = done.groupBy("up").agg(F.min("node").alias("component"), F.count("*").alias("n"))
    return materialize(join_hot(done, lowest, "up", done.count()).select("node", "component"), "labels")


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, up) with the root of each node, from a written forest of (node, up) whose roots name themselves."""
    rows = hooks.count()
    while True:
        above = hooks.groupBy("up").agg(F.count("*").alias("n")).join(hooks.select(F.col("node").alias("up"), F.col("up").alias("next")), "up")
        stepped = materialize(join_hot(hooks, above, "up", rows).select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "hooks")
        discard(hooks)
        settled = stepped.where("moved").limit(1).count() == 0
        hooks = stepped.select("node", "up")
        hooks._scratch = stepped._scratch
        if settled:
            return hooks
