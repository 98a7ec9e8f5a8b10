"""Near-dedup of texts by SimHash of word shingles, over a byte-position index with count filtering.

A text is its set of distinct shingles of ``width`` words. Its fingerprint is a
SimHash of all of them: each shingle votes on each bit with a signed byte of its
hash (so that few shingles seldom tie), and the bit is set if the votes sum to
more than zero. Two sets at a Jaccard similarity s have a cosine of 2s / (1 + s)
or more, which says how often their bits are equal. SimHash's 64 bits leave no
byte equal for sure at 0.8, so the fingerprint is longer: groups of BYTES byte
positions, as many as bring a pair at the threshold into one list with
probability ``recall``.

A fingerprint is posted under each group's bytes, and under the same with the
WEAK bits nearest to a tie flipped in all ways. A post carries SIDE bits of
other positions; pairs in a list that differ in too many of them for that share
of pairs at the threshold go at once (the number of groups allows for it). Of
the others the shared positional bytes are tallied; pairs that reach the number
that a pair at the threshold has for sure, but for a probability far below that
of the groups, are kept, and verified by the exact similarity of the two whole
sets.

Texts with equal sets are one entry. Short or sparse lists give their pairs, and
a dense list pairs each entry with one centre. Of these each entry is first
checked with the FIRST partners with which it shares most lists, so that a large
group becomes few components by a number of pairs that grows with its entries,
not their square. Then come the pairs of sparse lists between components that
are still apart, with other centres for the dense ones. All pairs of a dense
list are checked only between components that are apart after that, in tiles of
bounded size that return a spanning forest, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, in_slices, in_workers, join_hot, materialize, text_bytes, words_of

SEED = 42
#: Byte positions in a group, bits of a group that are flipped, further bits in a post, shingles that are hashed at a time.
BYTES, WEAK, SIDE, ROWS = 3, 3, 32, 256
#: Entries whose posts are dealt at a time, posts a task meets, the longest list of which all pairs are looked at, and partners of an entry that are checked first.
DEALT, MET, LIST, FIRST = 4_096, 1_000_000, 64, 8
#: The same for min-hashes, on which the stage does not rest: positions in a group, shingles at a time.
DEPTH, STEP = 5, 2_048


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, no words the shingle zero."""
    words = words_of(text)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), SEED) if words else 0], np.uint64)
    return np.unique(np.fromiter((digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(width)), strict=False)), np.uint64, len(words) - width + 1))


def groups_for(similarity: float, recall: float) -> int:
    """Groups of DEPTH positions that bring a pair at ``similarity`` together with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**DEPTH)))


def least_shared(positions: int, similarity: float, miss: float) -> int:
    """The most bytes that a pair at ``similarity`` shares but for a probability of ``miss`` (a sum of binomial terms)."""
    below, k = 0.0, 0
    while k < positions:
        below += math.comb(positions, k) * similarity**k * (1 - similarity) ** (positions - k)
        if below > miss:
            break
        k += 1
    return k


def fingerprint(hashes: np.ndarray, positions: int) -> bytes:
    """The lowest byte of each min-hash of a set."""
    rng = np.random.default_rng(SEED)
    flip, turn = (rng.integers(0, 2**64, positions, np.uint64) for _ in range(2))
    turn |= np.uint64(1)
    least = np.full(positions, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), STEP):
        mixed = (hashes[i : i + STEP, None] ^ flip) * turn
        least = np.minimum(least, mixed.min(0))
    # the multiplier leaves the lowest bits of a product poor, so the byte is one of a mix of all
    least ^= least >> np.uint64(32)
    return (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def group_keys(prints: np.ndarray) -> np.ndarray:
    """(fingerprints, groups) longs: number of the group, then its DEPTH bytes."""
    parts = prints.reshape(len(prints), -1, DEPTH).astype(np.int64)
    keys = np.broadcast_to(np.arange(parts.shape[1]), parts.shape[:2])
    for k in range(DEPTH):
        keys = keys * 256 + parts[:, :, k]
    return keys


def as_prints(column, positions: int) -> np.ndarray:
    """The positional bytes of a column of prints; what follows them names weak bits."""
    prints = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return prints.reshape(-1, positions + positions // BYTES * WEAK)[:, :positions]


def equal_bits(similarity: float) -> float:
    """How often a SimHash bit of two sets at a Jaccard similarity is equal."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_apart(similarity: float) -> int:
    """As many SIDE bits differ of all but 1 in 20 pairs at ``similarity``."""
    return SIDE - least_shared(SIDE, equal_bits(similarity), 0.05)


def meeting(similarity: float, trials: int = 200, each: int = 1_000) -> float:
    """How often a pair at ``similarity`` meets in a given group: bits that differ are weak ones of either text, and enough SIDE bits are equal."""
    rng, cosine, met = np.random.default_rng(SEED), 2 * similarity / (1 + similarity), 0
    for _ in range(trials):
        x = rng.standard_normal((each, 8 * BYTES))
        y = cosine * x + math.sqrt(1 - cosine**2) * rng.standard_normal(x.shape)
        weak = np.logical_or(*(np.abs(v) <= np.partition(np.abs(v), WEAK - 1, axis=1)[:, WEAK - 1 : WEAK] for v in (x, y)))
        met += int((((x > 0) == (y > 0)) | weak).all(1).sum())
    p = equal_bits(similarity)
    return met / (trials * each) * sum(math.comb(SIDE, k) * (1 - p) ** k * p ** (SIDE - k) for k in range(most_apart(similarity) + 1))


def simhash_groups(similarity: float, recall: float) -> int:
    """Groups of BYTES positions that bring a pair at ``similarity`` together with probability ``recall``.

    Two more than votes that are normal need: those of sets of about ten shingles are not quite.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(similarity))) + 2


def votes(hashes: np.ndarray, positions: int) -> np.ndarray:
    """For each of 8 x positions bits the sum of the signed bytes, doubled, with which all shingles vote."""
    rng = np.random.default_rng(SEED)
    flip, turn = (rng.integers(0, 2**64, positions, np.uint64) for _ in range(2))
    turn |= np.uint64(1)
    every, half = np.uint64(0x00FF00FF00FF00FF), np.uint64(32)
    sums = np.zeros((2, positions, 4), np.int64)
    for i in range(0, len(hashes), ROWS):
        mixed = (hashes[i : i + ROWS, None] ^ flip) * turn
        mixed ^= mixed >> half
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> half
        # bytes are added four to a word: 256 of them stay below 2**16
        for k in (0, 1):
            sums[k] += ((mixed >> np.uint64(8 * k)) & every).sum(0).view(np.uint16).reshape(-1, 4)
    return 2 * sums.transpose(1, 2, 0).reshape(-1) - 255 * len(hashes)


def simhash_print(hashes: np.ndarray, positions: int) -> bytes:
    """The SimHash of a set in ``positions`` bytes, then a byte for each of the WEAK bits of each group."""
    sums = votes(hashes, positions)
    weak = np.argsort(np.abs(sums).reshape(-1, 8 * BYTES), axis=1, kind="stable")[:, :WEAK]
    return np.packbits(sums > 0, bitorder="little").tobytes() + weak.astype(np.uint8).tobytes()


def posts_of(prints: np.ndarray, positions: int) -> np.ndarray:
    """(prints, groups x 2**WEAK) longs: number of the group, its bytes with weak bits flipped in one way, then SIDE bits of the positions after it."""
    groups = positions // BYTES
    own = prints[:, :positions].astype(np.int64)
    whole = lambda start, n: sum(np.roll(own, -start - k, axis=1)[:, ::BYTES][:, :groups] << 8 * k for k in range(n))
    value, side = whole(0, BYTES), whole(BYTES, SIDE // 8)
    bit = np.int64(1) << prints[:, positions:].reshape(len(prints), groups, WEAK).astype(np.int64)
    ways = (np.arange(2**WEAK)[:, None] >> np.arange(WEAK) & 1).astype(np.int64)
    flipped = value[:, :, None] ^ (bit @ ways.T)
    keys = (np.arange(groups)[:, None] << 8 * BYTES) + flipped
    return ((keys << SIDE) + side[:, :, None]).reshape(len(prints), -1)


def side_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b) & np.int64(2**SIDE - 1))


def meets_in(posts: np.ndarray, nodes: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of sparse lists and (key, node) of dense ones, from all posts of some keys.

    Pairs within ``apart`` SIDE bits count. A list that has more than twice as
    many of them as posts is dense: it is left to its nodes that are in one. So
    are lists longer than LIST, with all their nodes.
    """
    order = np.argsort(posts)
    posts, nodes = posts[order], nodes[order]
    keys = posts >> SIDE
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    many = np.diff(np.r_[first, len(keys)])
    number = np.repeat(np.arange(len(first)), many)
    left = np.repeat(first + many, many) - np.arange(len(keys))  # posts from here to the end of the list
    at = np.flatnonzero((left > 1) & (many <= LIST)[number])
    x, y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, LIST):
        at = at[left[at] > d]
        if not len(at):
            break
        near = at[side_apart(posts[at], posts[at + d]) <= apart]
        x.append(near)
        y.append(near + d)
    x, y = np.concatenate(x), np.concatenate(y)
    dense = np.bincount(number[x], minlength=len(first)) > 2 * many
    kept = (many > LIST)[number]
    for end in (x, y):
        kept[end[dense[number[end]]]] = True
    some = ~dense[number[x]]
    a, b = nodes[x[some]], nodes[y[some]]
    return np.minimum(a, b), np.maximum(a, b), keys[kept], nodes[kept]


def similar_groups(rows: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.9999, block: int = 512) -> DataFrame:
    """row, doc_id, same (equal for equal sets), component for every row of written ``rows(row, doc_id, text)``; component: the smallest row that links reach."""
    groups_ = simhash_groups(similarity, recall)
    positions = groups_ * BYTES
    least = least_shared(positions, equal_bits(similarity) ** 8, (1 - recall) / 10)
    apart = most_apart(similarity)
    fewest = math.ceil(similarity / (1 - similarity) - 1e-6)  # smaller sets have no other set so similar

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            sets = [shingle_set(t, width) for t in text_bytes(b.column(2))]
            columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([simhash_print(x, positions) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["row", "doc_id", "n", "same", "print"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, DEALT):
            prints = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, positions + groups_ * WEAK), np.uint8)
            posts = posts_of(prints, positions)
            both = np.stack([posts.ravel(), np.repeat(b.column(0).to_numpy(), posts.shape[1])], axis=1)
            share = ((both[:, 0] >> SIDE).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shares)
            order = np.argsort(share, kind="stable")
            which, start = np.unique(share[order], return_index=True)
            blobs = np.split(both[order], start[1:]) if len(which) else []
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32), pa.int32()), pa.array([x.tobytes() for x in blobs], pa.binary())], names=["share", "posts"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts = np.frombuffer(b"".join(x for b in batches for x in b.column(0).to_pylist()), np.int64).reshape(-1, 2)
        a, b, key, node = meets_in(posts[:, 0], posts[:, 1], apart)
        pairs = pa.table({"a": a, "b": b, "times": np.ones(len(a), np.int64)}).group_by(["a", "b"]).aggregate([("times", "sum")])
        for t in (pa.table({"key": pa.nulls(len(pairs), pa.int64()), "a": pairs["a"], "b": pairs["b"], "times": pairs["times_sum"]}), pa.table({"key": key, "a": node, "b": pa.nulls(len(node), pa.int64()), "times": np.ones(len(node), np.int64)})):
            yield from t.combine_chunks().to_batches(100_000)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            sets = [shingle_set(t, width).view(np.int64) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([simhash_print(x.view(np.uint64), positions) for x in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "print", "shingles"])

    prints = materialize(in_workers(rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text"), printed, "row long, doc_id long, n long, same binary, print binary"), "shingles")
    entries = materialize(prints.groupBy("same").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("print").alias("print"), F.count("*").alias("copies")), "shingle-entries")
    posted = entries.where(F.col("n") >= fewest).select("node", "print")
    shares = max(4, math.ceil(posted.count() * groups_ * 2**WEAK / MET))
    meets = materialize(in_workers(in_workers(posted, dealt, "share int, posts binary").repartitionById(shares, "share").select("posts"), met, "key long, a long, b long, times long"), "shingle-meets")
    held = materialize(meets.where("key is not null").select("key", F.col("a").alias("node")).join(entries.select("node", "n").hint("merge"), "node"), "shingle-posts")
    sparse = [meets.where("key is null").select(F.col(x).alias("node"), F.col(y).alias("other"), "times", F.lit(True).alias("sparse")) for x, y in ("ab", "ba")]

    groups, sets = rows.sparkSession.createDataFrame([], "node long, component long"), None
    for turn in range(3):
        parts = held.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if turn < 2:
            ways = _around_centres(parts, similarity, turn)
            some = _ranked(ways if turn else ways.unionByName(sparse[0]).unionByName(sparse[1]))
            if not turn:
                some = materialize(some, "shingle-ranked")
                others = some.where(F.col("rank") > FIRST)
            some = some.where(F.col("rank") <= FIRST).select("a", "b")
            near = _tallied(_apart(some.unionByName(others.select("a", "b")).distinct(), groups) if turn else some.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), entries, least, positions, similarity)
            if sets is None:
                nodes = held.select(F.col("node").alias("row"))
                for t, end in product((near, others), "ab"):
                    nodes = nodes.unionByName(t.select(F.col(end).alias("row")))
                sets = materialize(in_workers(rows.join(nodes.distinct().hint("merge"), "row", "left_semi").select("row", "text"), listed, "node long, print binary, shingles array<long>"), "shingle-sets")
            found = _verified(near, sets, similarity)
        else:
            found = _links_in_tiles(parts, sets, similarity, least, positions, apart, block)
        links = materialize(found, "shingle-links")
        if not turn or not links.isEmpty():
            groups = _raised(groups, connected_components(links)) if turn else connected_components(links)
    grouped = materialize(entries.select("same", "node", F.col("copies").alias("n")).join(groups, "node", "left").select("same", "n", F.coalesce("component", "node").alias("component")), "shingle-labels")
    return join_hot(prints.select("row", "doc_id", "same"), grouped, "same", prints.count()).select("row", "doc_id", "same", "component")


def _fits(a: str, b: str, similarity: float):
    """Sets of such sizes can be similar."""
    return F.least(a, b) / F.greatest(a, b) >= similarity


def _around_centres(parts: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(node, other, times, sparse): every member of a list of ``parts(key, node, n, component)`` and the list's centre, if they are apart."""
    centre = parts.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "component").alias("h"), F.col("node").alias("node"), F.col("n").alias("n"), F.col("component").alias("component"))).alias("c"))
    met = parts.join(centre, "key").select("node", "n", "component", F.col("c.node").alias("other"), F.col("c.n").alias("m"), F.col("c.component").alias("its"))
    return met.where((F.col("component") != F.col("its")) & _fits("n", "m", similarity)).select("node", "other", F.lit(1).cast("long").alias("times"), F.lit(False).alias("sparse"))


def _ranked(ways: DataFrame) -> DataFrame:
    """(a, b, rank) of ``ways(node, other, times, sparse)``: the pair's place among the partners of a node, the better of two, those that share most lists first.

    Pairs of sparse lists are all there, others up to place FIRST: their lists check them again.
    """
    pairs = ways.groupBy("node", "other").agg(F.sum("times").alias("times"), F.max("sparse").alias("sparse"))
    placed = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("times"), F.xxhash64("other"))))
    return placed.where(F.col("sparse") | (F.col("rank") <= FIRST)).groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.min("rank").alias("rank"))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, x, y): the ``pairs(a, b)`` whose components, x and y, differ."""
    for end, its in (("a", "x"), ("b", "y")):
        pairs = pairs.join(groups.select(F.col("node").alias(end), F.col("component").alias(its)), end, "left").withColumn(its, F.coalesce(its, end))
    return pairs.where("x <> y").select("a", "b", "x", "y")


def _tallied(pairs: DataFrame, entries: DataFrame, least: int, positions: int, similarity: float) -> DataFrame:
    """Written ``pairs(a, b, x, y)`` of fitting sizes whose fingerprints share ``least`` positional bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = (as_prints(b.column(4), positions) == as_prints(b.column(5), positions)).sum(1)
            yield b.select(["a", "b", "x", "y"]).filter(pa.array(shared >= least))

    left, right = (entries.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("print").alias(f"print_{k}")).hint("merge") for k in "ab")
    met = pairs.join(left, "a").join(right, "b").where(_fits("n_a", "n_b", similarity)).select("a", "b", "x", "y", "print_a", "print_b")
    return materialize(in_workers(met, run, "a long, b long, x long, y long"), "shingle-pairs")


def _links_in_tiles(parts: DataFrame, sets: DataFrame, similarity: float, least: int, positions: int, apart: int, block: int) -> DataFrame:
    """(a, b): edges between components that connect what the links of a list connect; a spanning forest for each tile.

    A pair is checked only in the list of the smallest key at which its SIDE bits are near too, and not if the tile has
    connected it by then. That list has shown the pair, or is dense and holds both; a pair without such a key is checked in all.
    """
    lists = parts.groupBy("key").agg(F.count("*").alias("many"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", F.when(F.col("many") <= block, F.lit(1)).otherwise(F.ceil(F.col("many") * 2 / block)).cast("int").alias("parts"))
    dealt = materialize(parts.join(lists, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "shingle-tiles")
    full = dealt.join(sets.hint("merge"), "node")
    tiles = full.groupBy("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list(F.struct("node", "n", "component", "print", "shingles")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, members in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                m = members.values
                node, n, component = (m.field(k).to_numpy() for k in ("node", "n", "component"))
                prints = np.frombuffer(b"".join(m.field("print").to_pylist()), np.uint8).reshape(len(node), -1)
                posts = posts_of(prints, positions)
                hit = (node[:, None] < node[None, :]) & (component[:, None] != component[None, :])
                hit &= np.minimum(n[:, None], n[None, :]) / np.maximum(n[:, None], n[None, :]) >= similarity
                x, y = np.nonzero(hit)
                some = np.concatenate([np.empty(0, bool), *((prints[x[i : i + 10_000], :positions] == prints[y[i : i + 10_000], :positions]).sum(1) >= least for i in range(0, len(x), 10_000))])
                shingles, root, a, z = m.field("shingles"), np.unique(component, return_inverse=True)[1], [], []
                for x, y in zip(x[some], y[some], strict=True):
                    if root[x] == root[y]:
                        continue
                    common, p, q = np.intersect1d(posts[x] >> SIDE, posts[y] >> SIDE, assume_unique=True, return_indices=True)
                    if (common[side_apart(posts[x][p], posts[y][q]) <= apart] < key).any():
                        continue
                    both = len(np.intersect1d(shingles[x].values.to_numpy(), shingles[y].values.to_numpy(), assume_unique=True))
                    if both / (n[x] + n[y] - both) >= similarity:
                        root[root == root[y]] = root[x]
                        a.append(component[x])
                        z.append(component[y])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return in_workers(tiles.select("key", "members"), run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): components of the ``pairs(a, b, x, y)`` whose sets have at least that Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").withColumn("both", F.size(F.array_intersect("s", "t")))
    return met.where(F.col("both") / (F.size("s") + F.size("t") - F.col("both")) >= similarity).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _raised(groups: DataFrame, higher: DataFrame) -> DataFrame:
    """``groups(node, component)`` after ``higher(node, component)`` joined components, or nodes that had none."""
    tops = groups.groupBy("component").agg(F.count("*").alias("n")).join(higher.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("component", "n", F.coalesce("top", "component").alias("top"))
    moved = join_hot(groups, tops, "component", groups.count()).select("node", F.col("top").alias("component"))
    return materialize(moved.unionByName(higher.join(groups.select("node"), "node", "left_anti")), "shingle-groups")


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component: that with the smallest doc_id.

    Texts link if the Jaccard similarity of their shingles is ``similarity`` or
    more; null texts and those without words link to each other. Rows are told
    apart by a number of their own, not by doc_id: of rows that share the
    smallest one the first by a hash of the shingles stays, a row whose doc_id is
    null only if the component has no other, and rows with one doc_id and
    different texts all stay. An empty table gives no rows.
    """
    names = docs.columns
    quoted = lambda c: docs["`" + c.replace("`", "``") + "`"]
    rows = materialize(docs.select(F.struct(*[quoted(c) for c in names]).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "rows")
    narrow = rows.select(F.col("_row").alias("row"), F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "same", "row")
    kept = materialize(similar_groups(narrow, **how).groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.row").alias("_row")), "kept")
    # always by a shuffle: plans should be alike at every size
    stay = rows.join(kept.hint("merge"), "_row", "left_semi")
    return stay.select(*[F.col("_doc").getField(c).alias(c) for c in names])
