"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions; each projection is
shifted and cut into cells of ``width``, and ``projections`` cells together
name a bucket in each of ``tables`` tables. Vectors that share a bucket get an
exact cosine check in double precision.

Equal vectors are one entry with a multiplicity. Buckets above ``block``
entries are cut into tiles, so that no task holds more. A pair is counted in
the first table that brings it together, so counts need no list of pairs; of
the links a tile returns counts and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, forest, in_workers, join_hot, materialize, table


def collision(distance: float, width: float) -> float:
    """Probability that one projection puts two points at ``distance`` in one cell (2-stable)."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-(r**2) / 2))


def hash_shape(rows: int, cosine: float, recall: float = 0.999, width: float = 2.0) -> tuple[int, int]:
    """(projections, tables): an unrelated vector shares a bucket with about one in 2,000 rows at most, a pair at ``cosine`` is found with probability ``recall``.

    Projections grow with the logarithm of the number of rows, so that the
    unrelated vectors in a bucket stay as few.
    """
    far, near = collision(math.sqrt(2), width), collision(math.sqrt(2 - 2 * cosine), width)
    projections = max(8, math.ceil(math.log(max(rows, 2) / 8) / -math.log(far)))
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - near**projections))


class Projections:
    """Directions, shifts and mixers that depend on the seed and the dimension alone."""

    def __init__(self, projections: int, tables: int, width: float, seed: int = 11) -> None:
        self.shape, self.width, self.seed, self.made = (projections, tables), width, seed, {}

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables) bucket numbers of unit vectors."""
        k, t = self.shape
        d = unit.shape[1]
        if d not in self.made:
            rng = np.random.default_rng([self.seed, d])
            self.made[d] = rng.standard_normal((d, k * t)), rng.uniform(0, self.width, k * t), rng.integers(-(2**62), 2**62, (k, t)) | 1
        a, shift, mix = self.made[d]
        cells = np.floor((unit @ a + shift) / self.width).astype(np.int64).reshape(len(unit), k, t)
        return (cells * mix[None]).sum(1)


def _unit(raw: bytes) -> np.ndarray | None:
    """The vector over its length, in double precision; None if it can't link."""
    x = np.frombuffer(raw, "<f8")
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def near_vectors(vectors: DataFrame, cosine: float = 0.98, recall: float = 0.999, width: float = 2.0, block: int = 256) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, label)``.

    Two rows link if their labels are equal and not null, their vectors have
    the same length, and their cosine is ``cosine`` or more. Null, empty and
    zero vectors, and those with null or non-finite components, link with
    nothing: n_links 0, component_id their own vec_id. Rows with equal vectors
    and labels link to each other, repeated ids too. The smallest vec_id of a
    component is kept; a null vec_id is the smallest only among nulls. Other
    columns are ignored.
    """
    wide = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(F.isnan(v) | v.isNull() | (F.abs(v) == F.lit(float("inf"))), F.lit(None)).otherwise(v))
    sound = F.col("label").isNotNull() & F.coalesce((F.size(wide) > 0) & ~F.exists(wide, lambda v: v.isNull()) & F.exists(wide, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn("sound", sound).withColumn("v", F.when(F.col("sound"), F.transform(wide, lambda v: v + 0.0))).withColumn("same", F.when(F.col("sound"), F.sha2(F.to_json(F.struct("label", "v")), 256))).select("vec_id", "label", "v", "same")
    rows = materialize(rows, "vectors")
    entries = rows.where("same is not null").groupBy("same").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id())
    entries = materialize(entries, "vector-entries")
    shape = hash_shape(entries.count(), cosine, recall, width)
    hashing = Projections(*shape, width)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [_unit(np.asarray(v.values.to_numpy(zero_copy_only=False), "<f8").tobytes()) for v in b.column(1)]
            sizes = np.array([len(u) for u in units])
            codes = np.zeros((len(units), shape[1]), np.int64)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                codes[at] = hashing.codes(np.stack([units[i] for i in at])) + d
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([u.tobytes() for u in units], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))], names=["node", "unit", "codes"])

    coded = in_workers(entries.select("node", "v"), hashed, "node long, unit binary, codes array<long>")
    coded = materialize(coded.join(entries.select("node", "label", "copies"), "node"), "vector-codes")
    posts = coded.select("node", "label", F.posexplode("codes").alias("t", "code"))
    lists = posts.groupBy("t", "code", "label").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.when(F.col("n") <= block, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / block)).cast("int")).drop("n")
    held = materialize(posts.join(lists, ["t", "code", "label"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "vector-posts")
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    tiles = dealt.join(coded.select("node", "copies", "unit", "codes"), "node").groupBy("t", "code", "label", "i", "j").agg(F.collect_list(F.struct("node", "part", "copies", "unit", "codes")).alias("members"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, links, roots = [], [], []
            for t, i, j, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                m = members.values
                node, part, copies = (m.field(k).to_numpy(zero_copy_only=False) for k in ("node", "part", "copies"))
                units = np.stack([np.frombuffer(x, "<f8") for x in m.field("unit").to_pylist()])
                codes = m.field("codes").flatten().to_numpy().reshape(len(node), -1)
                hit = units @ units.T >= cosine
                np.fill_diagonal(hit, False)
                if i != j:
                    hit &= part[:, None] != part[None, :]
                for before in range(t):  # that table has counted the pair
                    hit &= codes[:, before][:, None] != codes[:, before][None, :]
                n = hit @ copies
                root = forest(hit)
                some = n > 0
                nodes.append(node[some])
                links.append(n[some].astype(np.int64))
                roots.append(node[root[some]])
            whole = [np.concatenate(x or [np.empty(0, np.int64)]).astype(np.int64) for x in (nodes, links, roots)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in whole], names=["node", "links", "root"])

    found = materialize(in_workers(tiles.select("t", "i", "j", "members"), linked, "node long, links long, root long"), "vector-links")
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = entries.select("node", "same", "copies", "first").join(counts, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = known.groupBy("component").agg(F.min("first").alias("lowest"))
    known = materialize(known.join(lowest, "component").select("same", F.col("copies").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "lowest"), "vector-groups")
    alone = rows.where("same is null").select("vec_id", "same", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("lowest"))
    done = join_hot(rows.where("same is not null").select("vec_id", "same"), known, "same", rows.count()).unionByName(alone)
    component = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("lowest"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op7_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
