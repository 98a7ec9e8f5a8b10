"""SimHash near-dedup by an inverted index over byte positions with count filtering.

Fingerprints within ``max_bits`` differing bits differ in at most that many of
their 8 bytes, so at least 8 - max_bits positional bytes are shared. A posting
list per single (position, byte) would hold 1/256 of all fingerprints, and its
pairs grow with the square; so the index posts a fingerprint under groups of
positional bytes, chosen so that every qualifying pair shares a whole group.
For three bits, 14 groups of four bytes do (the planes of the affine geometry
AG(3, 2): any three positions lie in a plane, and its complement is a plane of
shared bytes). Within a list the shared bytes of each pair are tallied, pairs
that reach 8 - max_bits are kept and verified.

Near-dedup of whole texts by their five-word shingles (``drop_near_duplicates``)
uses the same index over a longer SimHash, as a radius that reaches a
similarity of 0.8 leaves none of 8 bytes equal for sure; see ``shingles``.

Equal fingerprints are one entry of the index. Lists longer than ``block`` are
cut into tiles of about that many entries, so no task holds more, and a task
returns a spanning forest of what it found, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, forest, in_slices, in_workers, join_hot, materialize, table, text_bytes, words_of
from .shingles import drop_near_duplicates as drop_near_duplicates

SEED = 42
#: Shingles whose bits are counted at a time.
STEP = 255 * 256


def simhash(text: bytes, width: int = 3) -> int:
    """Fingerprint of one text: a bit is set if over half of the shingle hashes have it; no words: 0."""
    words = words_of(text)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter((digest(x, SEED) for x in shingles), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; the long has the 64 bits of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            fps = np.array([simhash(t, width) for t in text_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return in_workers(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def position_groups(max_bits: int) -> list[tuple[int, ...]]:
    """Groups of byte positions of which any two fingerprints within ``max_bits`` share one wholly."""
    if max_bits == 3:
        return [g for g in combinations(range(8), 4) if g[0] ^ g[1] ^ g[2] ^ g[3] == 0]
    return list(combinations(range(8), 8 - max_bits))


def links_in(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Boolean matrix: pairs that share at least 8 - max_bits positional bytes and differ in max_bits bits at most."""
    x = fps.view(np.uint64)
    apart = x[:, None] ^ x[None, :]
    shared = (apart.view(np.uint8).reshape(len(x), len(x), 8) == 0).sum(2, dtype=np.uint8)
    linked = shared >= 8 - max_bits
    linked[linked] = np.bitwise_count(apart[linked]) <= max_bits
    np.fill_diagonal(linked, False)
    return linked


def near_edges(distinct: DataFrame, max_bits: int = 3, block: int = 512) -> DataFrame:
    """(a, b): edges that connect the ``distinct(fp)`` as their links do."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    posts = []
    for i, group in enumerate(position_groups(max_bits)):
        key = F.lit(i).cast("long")
        if len(group) > 6:
            key = F.xxhash64(F.lit(i), *[byte(p) for p in group])  # longer than a long; links are verified anyway
        else:
            for p in group:
                key = key * 256 + byte(p)
        posts.append(key)
    postings = distinct.select("fp", F.explode(F.array(*posts)).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.when(F.col("n") <= block, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / block)).cast("int")).select("key", "parts")
    held = materialize(postings.join(lists, "key"), "postings")
    tiles = held.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).groupBy("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = [], []
            for fps in b.column(0):
                x = fps.values.to_numpy()
                root = forest(links_in(x, max_bits))
                moved = root != np.arange(len(x))
                a.append(x[moved])
                z.append(x[root[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [np.empty(0, np.int64)])), pa.array(np.concatenate(z or [np.empty(0, np.int64)]))], names=["a", "b"])

    return in_workers(tiles.select("fps"), run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3, block: int = 512) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``.

    component_id: the smallest non-null doc_id among the rows that links of
    fingerprints reach, itself included; null if all of them have null ids.
    Null and empty texts have fingerprint zero and link like any other. Rows
    with equal texts have equal fingerprints and so one component; repeated
    rows stay rows. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, width), "simhash")
    named = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    groups = connected_components(near_edges(named.select("fp"), max_bits, block))
    grouped = named.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = materialize(grouped.join(lowest, "component").select("fp", "n", "component_id"), "simhash-labels")
    return join_hot(prints, labels, "fp", prints.count()).select("doc_id", "fp", "component_id")


def op9_simhash_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
