import hashlib
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from stratatile.llm import imatch


def test_order_edits_and_prints(spark, docs, rows):
    got = imatch.imatch(docs).collect()
    assert len(got) == len(rows)
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(text) // 4
        want.append((i is None, i or 0, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[7] == prints[105] == prints[106] and prints[7] <= prints[None]
    assert prints[100] == prints[101] == prints[102] == {"0"}
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[100]["near_next"] == by[101]["near_next"] == 1 and by[105]["near_next"] == 1  # equal neighbours


def test_next_over_many_ranges(spark, monkeypatch):
    """Ids with gaps, negative ids, repeated ids and nulls, in ranges of few rows."""
    ids = [None, None, -5, -5, 0, 1, 7, 7, 7, 100, 10**12] + list(range(1000, 1400, 3))
    df = spark.createDataFrame([(x, f"t{i}") for i, x in enumerate(ids)], "doc_id long, text string").repartition(4)
    want = sorted(((x, f"t{i}") for i, x in enumerate(ids)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = {r["text"]: r["next"] for r in imatch.with_next(df, len(ids)).collect()}
    assert got == {a[1]: b[1] for a, b in zip(want, want[1:] + want[:1], strict=True)}


@pytest.mark.parametrize("n", [1, 5, 64, 300])
def test_ranges_by_two_short_searches(spark, n):
    cuts = sorted({i * i for i in range(n)})
    df = spark.range(-3, n * n + 3, max(1, n // 9))
    for r in df.select("id", imatch.bucket_of(F.col("id"), cuts).alias("b")).collect():
        assert r["b"] == sum(c <= r["id"] for c in cuts)


def test_near_copies_are_nearer_than_others(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(20_000)}"
    texts = [" ".join(word() for _ in range(n)) for n in (40, 80, 200, 500, 1500) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = imatch.imatch(df).collect()
    mean = lambda k: sum(r[k] for r in got) / len(got)
    assert mean("near_edited") > 0.25 and mean("near_next") < 0.05
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.95 * len(got)


def xx(kind, *values):
    """Spark's xxhash64 of longs (q) or ints (i) one after the other, as a signed number."""
    seed = 42
    for k, v in zip(kind, values, strict=True):
        seed = xxhash.xxh64_intdigest(struct.pack("<" + k, v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def hashes(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found = {xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", lowered)}
    return {h - (1 << 64) if h >> 63 else h for h in found}


def plain_print(text, df, low, high, terms=40):
    """(level, marks) of a text in plain code."""
    own, level = hashes(text), 0
    while len(own) / terms >= 2 ** (level + 1):
        level += 1
    zeros = lambda h: (h & -h).bit_length() - 1 if h else 63
    own = sorted(h for h in own if zeros(h) >= level)
    own = [h for h in own if low <= df[h] <= high] or own
    marks = {(level, imatch.SUBSETS, xx("q" * len(own), *own) % 2**imatch.KEPT)} if own else set()
    for s in range(imatch.SUBSETS):
        members = [h for h in own if (xx("qi", h, 1) % 2**64 >> s * imatch.BITS) % 2**imatch.BITS == 0]
        for k in range(level, 1 + max(map(zeros, members), default=-1)):
            some = [h for h in members if zeros(h) >= k]
            marks.add((k, s, xx("q" * len(some), *some) % 2**imatch.KEPT))
    return level, marks


def plain_likeness(a, b):
    if not a[1] and not b[1]:
        return 1.0
    x, y = ({m for m in p[1] if m[0] >= max(a[0], b[0])} for p in (a, b))
    either = {m[:2] for m in x | y}
    return len(x & y) / len(either) if either else 0.0


def test_fingerprints_and_likeness_against_plain_code(spark, docs, rows):
    texts = [r[1] or "" for r in rows]
    df = Counter(h for t in texts for h in hashes(t))
    high = max(2, 0.05 * len(texts))
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(imatch.imatch(docs).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]))
    want = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        own, made, following = (plain_print(t, df, 2, high) for t in (text, changed, after))
        want.append((i is not None, i or 0, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, made, plain_likeness(own, made), plain_likeness(own, following)))
    want.sort(key=lambda w: w[:4])

    def read(shown):
        level, _, marks = shown.partition(":")
        cut = lambda v: (v >> imatch.KEPT) // imatch.ALL, lambda v: (v >> imatch.KEPT) % imatch.ALL, lambda v: v % 2**imatch.KEPT
        return int(level), {tuple(c(int(m, 16)) for c in cut) for m in marks.split(",") if m}

    assert len(got) == len(want)
    for r, w in zip(got, want, strict=True):
        assert (r["n_chars"], r["edited_sha256"]) == w[2:4]
        assert read(r["fingerprint"])[1] == w[4][1] and read(r["edited_fingerprint"])[1] == w[5][1]
        assert r["near_edited"] == pytest.approx(w[6]) and r["near_next"] == pytest.approx(w[7])


def test_contained_texts_are_alike_whatever_their_sizes(spark):
    rng = random.Random(9)
    for small, large in ((63, 129), (60, 250), (200, 900)):
        words = [f"w{rng.randrange(10**9)}" for _ in range(large)]
        texts = [" ".join(words[:small]), " ".join(words)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = imatch.imatch(df, rarest=1, commonest=1.0).where("doc_id = 0").first()
        assert 0 < got["near_next"] < 0.8, (small, large)


def test_a_text_of_common_words_keeps_a_print(spark):
    df = spark.createDataFrame([(i, "the same words everywhere") for i in range(50)] + [(99, "rare one")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.imatch(df).collect()}
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != "0" and got[99]["fingerprint"] not in ("0", got[0]["fingerprint"])


def test_empty_table_and_one_row(spark, empty):
    assert imatch.imatch(empty).count() == 0
    one = imatch.imatch(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
