import zlib

import numpy as np

from stratatile.llm import gam


def test_tables_find_curves_and_interactions():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 4))
    signal = 6 * (np.abs(x[:, 0]) - 0.5) + 2 * np.sign(x[:, 1] * x[:, 2])
    y = (rng.random(4000) < 1 / (1 + np.exp(-signal))).astype(float)
    model = gam.fit_additive(x[:3000], y[:3000], pairs=1)
    assert [(i, j) for i, j, _ in model.pairs] == [(1, 2)]
    right = ((model.score(x[3000:]) > 0.5) == (signal[3000:] > 0)).mean()
    assert right > 0.9
    flat = np.abs(model.tables[3]).max()
    assert flat < 0.4 * np.abs(model.tables[0]).max()


def test_score_is_the_sum_of_looked_up_values():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    model = gam.fit_additive(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), rounds=20, pairs=2)
    for row, got in zip(x[:40], model.score(x[:40]), strict=True):
        at = [int((e <= v).sum()) for e, v in zip(model.edges, row, strict=True)]
        total = model.base + sum(t[i] for t, i in zip(model.tables, at, strict=True)) + sum(t[at[i], at[j]] for i, j, t in model.pairs)
        assert np.isclose(got, 1 / (1 + np.exp(-total)))


def test_one_kind_of_label_or_none():
    x = np.zeros((5, 3))
    assert np.allclose(gam.fit_additive(x[:0], np.zeros(0)).score(x), 0.5)
    assert (gam.fit_additive(x, np.ones(5)).score(x) > 0.8).all()
    same = gam.fit_additive(x, np.array([0.0, 1, 0, 1, 0])).score(x)
    assert np.allclose(same, same[0])


def plain_tree(rows, bin_of, g, h, bins, depth, ridge=2.0):
    """Value of each bin: the best cut of the ordered bins by sums over rows, then each side again."""
    total = lambda some: (sum(g[r] for r in rows if bin_of[r] in some), sum(h[r] for r in rows if bin_of[r] in some))
    worth = lambda some: total(some)[0] ** 2 / (total(some)[1] + ridge)
    cuts = [(worth(bins[:k]) + worth(bins[k:]) - worth(bins), -k) for k in range(1, len(bins))] if depth else []
    gain, k = max(cuts, default=(0, 0))
    if gain <= 1e-9:
        a, b = total(bins)
        return dict.fromkeys(bins, a / (b + ridge))
    return plain_tree(rows, bin_of, g, h, bins[:-k], depth - 1) | plain_tree(rows, bin_of, g, h, bins[-k:], depth - 1)


def test_cyclic_boosting_against_plain_loops():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2)).round(1)
    y = (x[:, 0] + rng.normal(size=40) > 0).astype(float)
    model = gam.fit_additive(x, y, rounds=4, bins=6, pairs=0)
    base = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    total, rows = [base] * 40, range(40)
    tables = [dict.fromkeys(range(len(e) + 1), 0.0) for e in model.edges]
    bins = [[sum(e <= v for e in model.edges[j]) for v in x[:, j]] for j in range(2)]
    for _ in range(5):  # a third as many rounds more go to pairs and features in turn
        for j in range(2):
            p = [1 / (1 + np.exp(-t)) for t in total]
            tree = plain_tree(rows, bins[j], y - p, [q * (1 - q) for q in p], list(tables[j]), 2)
            for k, v in tree.items():
                tables[j][k] += 0.15 * v
            total = [t + 0.15 * tree[b] for t, b in zip(total, bins[j], strict=True)]
    assert all(np.allclose(t, list(w.values())) for t, w in zip(model.tables, tables, strict=True))


ODDS = np.zeros(1 << gam.GRAM_BITS, np.float32)


def test_features_of_odd_texts(monkeypatch):
    for text in (b"", b" \n\t", b"\xff\xfe", b"a", "É𝒳".encode(), b"a" * 10_000, b"x\n" * 500, b"\x0b", "漢字かな 한글".encode()):
        got = gam.features(text, ODDS)
        assert len(got) == len(gam.FEATURES) and np.isfinite(got).all()
    at = lambda text, name: gam.features(text.encode(), ODDS)[gam.FEATURES.index(name)]
    assert at("a a a a b", "same_as_last") == 3 / 5
    assert at("漢字 かな", "letters") == 4 / 5 and at("漢字 ab", "caseless") == 1 / 2
    assert at("a. b! c -- ***", "ends_in_symbol") == 4 / 5 and at("a. b! c -- ***", "bare_symbols") == 2 / 5
    assert at("abab", "byte_entropy") == 1.0 and at("a a a", "word_entropy") == 0.0
    odds = np.random.default_rng(1).normal(size=len(ODDS)).astype(np.float32)
    text = "Some WORDS é over and over. " * 40
    whole = gam.features(text.encode(), odds)
    monkeypatch.setattr(gam, "BYTES", 37)  # the same a few bytes at a time
    assert np.allclose(gam.features(text.encode(), odds), whole)


def plain_grams(text):
    low, n = text.encode(), gam.GRAM
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in low)
    found = []
    for i in range(len(low) - n + 1):
        h = int.from_bytes(low[i : i + n], "little")
        h ^= h >> 15
        found.append((h * 0x9E3779B1 % 2**32) >> (32 - gam.GRAM_BITS))
    return found


def test_odds_of_training_texts_come_from_other_texts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["good", "fine", "Other"] if i % 2 else ["bad", "poor", "Other"], 12)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(gam, "fit_additive", lambda x, y, **_: seen.update(x=x, y=y) or gam.AdditiveModel(0.0))
    model = gam.train_quality(docs, labels)

    def odds(some):
        sums = np.zeros((2, 1 << gam.GRAM_BITS))
        for i in some:
            found = plain_grams(texts[i])
            for g in found:
                sums[i % 2, g] += 1 / len(found)
        even = 0.5 * sums.sum() / sums.shape[1] / 2
        return np.log((sums[1] + even) / (sums[1] + even).sum()) - np.log((sums[0] + even) / (sums[0] + even).sum())

    assert np.allclose(model.odds, odds(range(40)), atol=1e-5)
    fold = [zlib.crc32(str(i).encode()) // 8 % gam.FOLDS for i in range(40)]
    want = sorted(float(np.mean(odds([k for k in range(40) if fold[k] != fold[i]])[plain_grams(texts[i])])) for i in range(40))
    assert np.allclose(sorted(seen["x"][:, -1]), want, atol=1e-5) and seen["y"].sum() == 20


def test_rows_and_stage(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(60)] + [(3, None, 0), (None, 1, 0), (5, 0, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    model = gam.train_quality(docs, labels)
    scored = gam.score_quality(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert {(r["doc_id"], round(r["score"], 9)) for r in scored} == {(r["doc_id"], round(r["score"], 9)) for r in gam.score_quality(docs, gam.train_quality(docs.repartition(5), labels)).collect()}
    kept = gam.keep_quality(docs, model, 0.3)
    assert kept.schema == docs.schema
    high = sorted(str(r["doc_id"]) for r in scored if r["score"] >= 0.3)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == high
    nothing = gam.train_quality(empty, labels)
    assert gam.score_quality(empty, nothing).count() == 0
    assert gam.keep_quality(empty, model).count() == 0


def test_labelled_texts_are_bounded_whatever_repeats(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    for ids in (range(400), [7] * 3000):
        docs = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
        n = gam.labelled_texts(docs, labels, 100).count()
        assert n <= 150 and (n >= 50 or len(set(ids)) == 1)


def test_query_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in gam.op6_additive_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null").collect()
    held = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels if got[r["doc_id"]]["held_out"]]
    ones, zeros = [s for q, s in held if q], [s for q, s in held if not q]
    above = np.mean([[a > b for b in zeros] for a in ones])
    assert above > 0.97 and all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())
