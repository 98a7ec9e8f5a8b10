import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from stratatile.llm import shingles, simhash


def plain(text, width=5):
    words = (text or "").split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def made(seed=6):
    """Texts and copies with runs of changed words, of similarities on both sides of 0.8; chains; a large group."""
    rng = random.Random(seed)
    new = lambda: f"w{rng.randrange(10**9)}"
    texts = []
    for _ in range(60):
        base = [new() for _ in range(rng.randint(60, 300))]
        texts.append(base)
        for _ in range(3):
            base = list(base)
            for _ in range(rng.choice([1, 2, 3, len(base) // 50, len(base) // 30])):
                base[rng.randrange(len(base))] = new()
            texts.append(base)
    base = [new() for _ in range(100)]
    texts += [[*base[:i], new(), *base[i + 1 :]] for i in range(100)]
    return [" ".join(t) for t in texts] + ["", None, " ", "one two", "one two", "one two three"]


def test_stage_reaches_similarity_of_five_word_shingles(spark):
    texts = made()
    sets = [plain(t) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = [p for p in combinations(range(len(texts)), 2) if alike(*p) >= 0.8]
    assert sum(alike(*p) < 0.9 for p in near) > 50
    root = list(range(len(texts)))
    for a, b in near:
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_tiles_and_turns_find_what_one_list_finds(spark):
    rows = [(i, i, t) for i, t in enumerate(made(7))]
    df = spark.createDataFrame(rows, "row long, doc_id long, text string")
    got = [{r["row"]: r["component"] for r in shingles.similar_groups(df, block=b).collect()} for b in (8, 512)]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_null_and_repeated_ids(spark, docs, empty):
    kept = shingles.drop_near_duplicates(docs).collect()
    named = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    # copies of 7 under a null id and null texts under one go; texts that share an id stay, a repeated row goes
    assert len(named) == len(kept) and named.count(4) == 2 and named.count(3) == 1
    assert 7 in named and 105 not in named and 106 not in named and {0, 1, 2, 3, 103, 108} <= set(named)
    assert len([i for i in named if i in (100, 101, 102)]) == 1
    assert shingles.drop_near_duplicates(empty).count() == 0


def test_unique_text_is_never_lost(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(3, "alpha"), (5, "alpha"), (5, "beta"), (7, "gamma"), (None, "delta"), (None, "delta"), (None, "gamma"), (None, "epsilon"), (7, "zeta")]
    df = spark.createDataFrame([(i, text(k), k) for i, k in rows], "doc_id long, text string, kind string")
    for some in (df, df.repartition(4), df.orderBy(F.desc("kind"))):
        got = sorted((r["doc_id"] or 0, r["kind"]) for r in simhash.drop_near_duplicates(some).collect())
        assert got == [(0, "delta"), (0, "epsilon"), (3, "alpha"), (5, "beta"), (7, "gamma"), (7, "zeta")]


def test_bytes_agree_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    for shared in (0, 100, 400, 500):
        a, b = rng.integers(0, 2**63, (2, 500), np.uint64)
        b[:shared] = a[:shared]
        alike = shared / (1000 - shared)
        x, y = (np.frombuffer(shingles.fingerprint(s, 4000), np.uint8) for s in (a, b))
        assert abs((x == y).mean() - (alike + (1 - alike) / 256)) < 0.03
    keys = shingles.group_keys(np.array([[1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], np.uint8))
    assert keys.tolist() == [[0x0102030405, 0x10607080900 + 10]]


def test_least_shared_bytes():
    assert shingles.least_shared(120, 0.8, 1e-5) == 76 and shingles.least_shared(5, 1.0, 1e-5) == 5
    assert shingles.groups_for(0.8, 0.9999) == 24


def test_print_is_a_simhash_of_the_whole_set():
    """Every shingle votes on every bit, worked out in plain code; the weak bits are those nearest to a tie."""
    rng = np.random.default_rng(5)
    hashes, positions = rng.integers(0, 2**64, 700, np.uint64), 6
    draw = np.random.default_rng(shingles.SEED)
    flip, turn = (draw.integers(0, 2**64, positions, np.uint64).tolist() for _ in range(2))
    sums = [0] * (8 * positions)
    for h in hashes.tolist():
        for p in range(positions):
            x = (h ^ flip[p]) * (turn[p] | 1) % 2**64
            x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 % 2**64
            for k, byte in enumerate((x ^ x >> 32).to_bytes(8, "little")):
                sums[8 * p + k] += 2 * byte - 255
    got = shingles.simhash_print(hashes, positions)
    assert shingles.votes(hashes, positions).tolist() == sums
    assert [got[i // 8] >> i % 8 & 1 for i in range(len(sums))] == [int(v > 0) for v in sums]
    weak = [sorted(range(24), key=lambda i: abs(sums[24 * g + i]))[:3] for g in (0, 1)]
    assert list(got[positions:]) == weak[0] + weak[1]


def test_pairs_at_the_threshold_meet_and_pass_the_tally():
    rng, groups = np.random.default_rng(6), shingles.simhash_groups(0.8, 0.9999)
    positions = 3 * groups
    least, apart = shingles.least_shared(positions, shingles.equal_bits(0.8) ** 8, 1e-5), shingles.most_apart(0.8)
    for both, one, other in ((4, 1, 0), (8, 1, 1), (8, 2, 0), (40, 5, 5), (160, 20, 20), (160, 40, 0)):
        posts, bits = [], []
        for _ in range(300):
            x = rng.integers(0, 2**64, both + one + other, np.uint64)
            pair = np.frombuffer(b"".join(shingles.simhash_print(s, positions) for s in (x[: both + one], np.r_[x[:both], x[both + one :]])), np.uint8).reshape(2, -1)
            posts.append(shingles.posts_of(pair, positions))
            bits.append(np.bitwise_count(pair[0, :positions] ^ pair[1, :positions]).sum() / (8 * positions))
            assert (pair[0, :positions] == pair[1, :positions]).sum() >= least
        assert 1 - np.mean(bits) > shingles.equal_bits(0.8) - 0.01
        a, b, key, node = shingles.meets_in(np.concatenate(posts).ravel(), np.repeat(np.arange(600), groups * 8), apart)
        assert {(2 * i, 2 * i + 1) for i in range(300)} <= set(zip(a.tolist(), b.tolist(), strict=True)) and not len(key) and not len(node)


def test_lists_give_pairs_or_their_nodes():
    """Sparse, dense and long lists against all pairs of each."""
    rng = np.random.default_rng(7)
    near = lambda n: np.bitwise_xor(rng.integers(0, 2**32), 1 << rng.integers(0, 32, n))
    lists = [rng.integers(0, 2**32, 1), rng.integers(0, 2**32, 60), np.r_[rng.integers(0, 2**32, 9), near(3)], np.r_[rng.integers(0, 2**32, 20), near(30)], rng.integers(0, 2**32, 65)]
    posts = np.concatenate([(k << 32) + side for k, side in enumerate(lists)])
    nodes = rng.permutation(len(posts))
    places = np.split(np.arange(len(posts)), np.cumsum([len(x) for x in lists])[:-1])
    pairs, held = [], []
    for k, at in enumerate(places):
        found = [(x, y) for x, y in combinations(at, 2) if (int(posts[x]) ^ int(posts[y])).bit_count() <= 10]
        if len(at) > 64 or len(found) > 2 * len(at):
            held += [(k, int(nodes[i])) for i in (at if len(at) > 64 else {i for p in found for i in p})]
        else:
            pairs += [tuple(sorted((int(nodes[x]), int(nodes[y])))) for x, y in found]
    assert {k for k, _ in held} == {3, 4}
    mixed = rng.permutation(len(posts))
    a, b, key, node = shingles.meets_in(posts[mixed], nodes[mixed], 10)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(pairs)
    assert sorted(zip(key.tolist(), node.tolist(), strict=True)) == sorted(held)


def test_dense_lists_of_near_texts_that_do_not_link(spark):
    """Texts around one base at about 0.7 of each other, and copies of some at 0.9: long lists of many components."""
    rng = random.Random(8)
    new = lambda: f"w{rng.randrange(10**9)}"
    changed = lambda t, places: [new() if i in places else w for i, w in enumerate(t)]
    base = [new() for _ in range(200)]
    texts = [changed(base, rng.sample(range(200), 4)) for _ in range(120)]
    texts += [changed(t, [rng.randrange(200)]) for t in texts[:60]]
    sets = [plain(" ".join(t)) for t in texts]
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    assert len(set(root)) == 120
    df = spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(texts)], "row long, doc_id long, text string").repartition(3)
    for block in (32, 512):
        assert {r["row"]: r["component"] for r in shingles.similar_groups(df, block=block).collect()} == dict(enumerate(root))


def test_pairs_of_a_large_group_grow_with_its_texts(spark, monkeypatch):
    """Near copies, of which nearly every two meet in some list: few pairs for each text are tallied, not all."""
    rng = random.Random(9)
    new = lambda: f"w{rng.randrange(10**9)}"
    base = [new() for _ in range(150)]
    texts = [" ".join([*base[:i], new(), *base[i + 1 :]]) for i in (rng.randrange(150) for _ in range(240))]
    seen, tallied = [], shingles._tallied
    monkeypatch.setattr(shingles, "_tallied", lambda pairs, *rest: seen.append(pairs.count()) or tallied(pairs, *rest))
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string").repartition(3)
    assert {r["component"] for r in shingles.similar_groups(df).collect()} == {0}
    assert seen and sum(seen) <= 16 * len(texts), seen
