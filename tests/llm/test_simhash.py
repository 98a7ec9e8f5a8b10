import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stratatile.llm import simhash


def plain(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(keys, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in keys}


def test_every_row_against_brute_force(spark, docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {(r[0], plain(r[1])) for r in rows}
    assert {(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got} == fps
    group = components(sorted({f for _, f in fps}), lambda a, b: (a ^ b).bit_count() <= 3)
    lowest = {}
    for i, f in fps:
        if i is not None:
            lowest[group[f]] = min(i, lowest.get(group[f], i))
    for r in got:
        assert r["component_id"] == lowest.get(group[r["fp"] & (1 << 64) - 1])


def test_groups_share_bytes_with_every_close_pair():
    for bits in (1, 2, 3, 4):
        groups = simhash.position_groups(bits)
        for changed in combinations(range(8), bits):
            assert any(not set(changed) & set(g) for g in groups)
    assert len(simhash.position_groups(3)) == 14


def test_edges_connect_what_links_connect(spark):
    """Chains, dense groups above the block size, and random prints."""
    rng = np.random.default_rng(2)
    prints = set()
    for _ in range(6):
        at = int(rng.integers(0, 2**63))
        for _ in range(60):
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                at ^= 1 << int(b)
            prints.add(at)
    centre = int(rng.integers(0, 2**63))
    prints |= {centre ^ 1 << a ^ 1 << b for a in range(32) for b in range(a)}
    prints |= {int(x) for x in rng.integers(0, 2**63, 300)}
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    edges = simhash.near_edges(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, block=64).collect()
    want = components(sorted(signed), lambda a, b: ((a ^ b) & 2**64 - 1).bit_count() <= 3)
    got = components(sorted(signed), lambda a, b, e={frozenset(x) for x in map(tuple, edges)}: frozenset((a, b)) in e)
    assert want == got


def test_empty_table_and_long_text(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.simhash(text.encode()) == plain(text)


def test_components_of_long_chains(spark):
    from stratatile.llm.common import connected_components

    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501), (501, 500), (7, 7)], "a long, b long"))
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_components_of_a_path_in_any_order(spark):
    """A path and a ring through thousands of nodes whose ids say nothing of their places."""
    from stratatile.llm.common import connected_components

    ids = [int(x) for x in np.random.default_rng(4).permutation(6000) - 3000]
    path, ring = ids[:4000], ids[4000:]
    edges = [*zip(path, path[1:], strict=False), *zip(ring, ring[1:] + ring[:1], strict=True)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(path, min(path)), **dict.fromkeys(ring, min(ring))}


def test_components_around_hot_nodes(spark):
    """Two stars of very many leaves, a bridge between them, and pairs apart from them."""
    from stratatile.llm.common import connected_components

    edges = [(5_000, i) for i in range(3_000)] + [(i, 6_000) for i in range(10_000, 12_500)] + [(2_999, 10_000)] + [(20_000 + 2 * i, 20_001 + 2 * i) for i in range(2_500)]
    random.Random(5).shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: (n - n % 2 if n >= 20_000 else 0) for e in edges for n in e}
