import random

import numpy as np
from texts import words

from stratatile.llm import langid

ALPHABETS = {"aa": "aeimnort", "bb": "bdfgklpu", "cc": "cehjqsvwxyz"}


def labelled(spark, n=40):
    rng = random.Random(1)
    return spark.createDataFrame([(k, words(rng, 40, v)) for k, v in ALPHABETS.items() for _ in range(n)], "lang string, text string")


def mixed(shares, n=400, seed=2):
    rng = random.Random(seed)
    return " ".join(words(rng, 1, ALPHABETS[rng.choices(list(shares), list(shares.values()))[0]]) for _ in range(n))


def test_trigrams_against_plain_code():
    texts = ["Abc dé", "", "1x", "ß\0q", "  "]
    doc, bucket = langid.trigrams(texts)
    want = []
    for i, t in enumerate(texts):
        padded = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        want += [(i, padded[j - 1 : j + 2]) for j in range(1, len(padded) - 1) if padded[j].isalpha()]
    assert doc.tolist() == [i for i, _ in want]
    same = {}
    for (_, g), b in zip(want, bucket.tolist(), strict=True):
        assert same.setdefault(g, b) == b
    assert len(set(same.values())) == len(same)


def test_shares_of_mixtures(spark):
    model = langid.train_languages(labelled(spark))
    assert model.languages == ("aa", "bb", "cc") and np.allclose(model.table.sum(0), 1, atol=1e-3)
    texts = [mixed({"aa": 1}), mixed({"aa": 0.7, "bb": 0.3}), mixed({"aa": 0.25, "bb": 0.25, "cc": 0.5}), "12 ?!", "", None, "жчш щыэ юяж чшщ " * 20]
    main, share, size = model.infer(texts, 2.0)
    assert main[:3].tolist() == [0, 0, 2] and size[:3].tolist() == [1, 2, 3]
    assert share[0] > 0.98 and abs(share[1] - 0.7) < 0.1 and abs(share[2] - 0.5) < 0.1
    assert main[3:6].tolist() == [-1, -1, -1] and size[6] == 0


def test_em_never_lowers_the_likelihood(spark):
    model = langid.train_languages(labelled(spark))
    _, bucket = langid.trigrams([mixed({"aa": 0.5, "cc": 0.5})])
    p = model.table[bucket]
    ones, starts, widths = np.ones(len(p), np.float32), np.array([0]), np.array([len(p)])
    likes = [model._em(p, ones, starts, widths, np.array([float(len(p))]), np.full((1, 3), 1 / 3, np.float32), k)[1][0] for k in range(8)]
    assert all(b >= a - 1e-2 for a, b in zip(likes, likes[1:], strict=False))


def plain_inference(model, text, penalty=2.0):
    """Main language, its share in the full mixture and the size of the best set, by loops over trigrams."""
    _, buckets = langid.trigrams([text])
    if not len(buckets):
        return None
    rows, n = [model.table[b].astype(float) for b in buckets], len(buckets)

    def em(columns, theta, steps):
        for _ in range(steps):
            new = [0.0] * len(columns)
            for r in rows:
                total = sum(t * r[c] for t, c in zip(theta, columns, strict=True))
                for j, c in enumerate(columns):
                    new[j] += theta[j] * r[c] / total
            theta = [x / n for x in new]
        return theta, sum(np.log(sum(t * r[c] for t, c in zip(theta, columns, strict=True))) for r in rows)

    k = len(model.languages)
    full, _ = em(range(k), [1 / k] * k, langid.STEPS)
    order = sorted(range(k), key=lambda j: -full[j])
    best, chosen, shares = -n * np.log(langid.BUCKETS), 0, [1.0]
    single = sum(np.log(r[order[0]]) for r in rows)
    if single > best:
        best, chosen = single, 1
    best = max(best, single)
    for m in range(2, k + 1):
        if full[order[m - 1]] * n < 1:
            break
        start = [max(full[j], 1e-3) for j in order[:m]]
        fit, like = em(order[:m], [x / sum(start) for x in start], langid.SET_STEPS)
        if like - penalty * (m - 1) * np.log(n + 1) <= best:
            break
        best, chosen, shares = like - penalty * (m - 1) * np.log(n + 1), m, fit
    main = order[int(np.argmax(shares))]
    return main, full[main], chosen


def test_inference_against_plain_loops(spark):
    model = langid.train_languages(labelled(spark))
    texts = [mixed(s, n, seed) for seed, (s, n) in enumerate([({"aa": 1}, 30), ({"bb": 0.6, "cc": 0.4}, 60), ({"aa": 0.3, "bb": 0.3, "cc": 0.4}, 90), ({"aa": 0.95, "bb": 0.05}, 40), ({"cc": 1}, 1)])] + ["жчш щыэ", "a", "1"]
    main, share, size = model.infer(texts, 2.0)
    for i, t in enumerate(texts):
        want = plain_inference(model, t)
        assert (main[i], size[i]) == ((want[0], want[2]) if want else (-1, 0)) and (want is None or np.isclose(share[i], want[1], atol=1e-3)), t


def test_sets_grow_with_the_languages_and_none_is_left_out(spark):
    rng = random.Random(4)
    letters = [chr(0x4E00 + 40 * k + j) for k in range(300) for j in range(40)]
    own = {f"l{k:03d}": "".join(letters[40 * k : 40 * k + 8]) for k in range(300)}
    rows = [(k, words(rng, 60, v)) for k, v in own.items()]
    model = langid.train_languages(spark.createDataFrame(rows, "lang string, text string").repartition(2))
    assert len(model.languages) == 300
    text = " ".join(words(rng, 80, own[f"l{k:03d}"]) for k in (5, 80, 150, 220, 299))
    main, share, size = model.infer([text, words(rng, 30, own["l299"])], 2.0)
    assert size.tolist() == [5, 1] and main[1] == 299 and 0.1 < share[0] < 0.4


def test_long_texts_are_read_in_parts():
    text = "Añb 1 " * 500 + "ΣΑΣ"
    want = np.unique(langid.trigrams([text])[1], return_counts=True)
    for chars in (7, 64, 10**6):
        got = langid.counted([text], chars)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_rows_and_stage(spark, docs, rows):
    model = langid.train_languages(langid.training_rows(docs))
    assert set(model.languages) == {"en", "xx"}
    got = langid.identify(docs, model).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r["doc_id"]) if r["doc_id"] not in (None, 4) else "x"
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= r["score"] <= 1
    right = [r["lang_pred"] == ("en" if r["doc_id"] % 2 else "xx") for r in got if r["doc_id"] is not None and r["doc_id"] < 60]
    assert sum(right) > 0.97 * len(right)
    kept = langid.keep_identified(docs, model)
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(60)) <= ids and not {100, 101, 102, 104} & ids


def test_no_languages_and_no_rows(spark, docs, empty):
    none = langid.train_languages(langid.training_rows(empty))
    assert none.languages == ()
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(empty, none).count() == 0 and langid.keep_identified(empty, none).count() == 0


def test_query_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in langid.op5_language_mixture(spark, "/root/testdata/sf0.01").collect()}
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    held = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in table if got[r["doc_id"]]["held_out"]]
    assert len(got) == len(table) and len(held) > 150 and sum(held) > 0.98 * len(held)
