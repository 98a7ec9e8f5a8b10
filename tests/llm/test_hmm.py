import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratatile.llm import hmm

WORDS = r"[^\x20\x09-\x0D]+"


def tokens(text):
    return re.findall(WORDS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def small_model(k=3, codes=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.HiddenMarkov(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((codes, k)), 0))


def paths(model, codes):
    """Probability of each path of states with the codes."""
    for path in itertools.product(range(len(model.initial)), repeat=len(codes)):
        p = model.initial[path[0]] * model.emits[codes[0], path[0]]
        for a, b, c in zip(path, path[1:], codes[1:], strict=False):
            p *= model.moves[a, b] * model.emits[c, b]
        yield path, p


TEXTS = [np.array(x, np.int32) for x in ([0, 1, 2, 4], [4], [3, 3, 3, 4], [2, 1, 0, 0, 1, 4], [1, 4])]


def test_forward_against_all_paths():
    model = small_model()
    want = [math.log10(sum(p for _, p in paths(model, t))) for t in TEXTS]
    assert np.allclose(hmm.log10_likelihoods(model, TEXTS, 4), want)


def test_expected_counts_against_all_paths():
    model = small_model()
    initial, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for t in TEXTS:
        found = list(paths(model, t))
        total = sum(p for _, p in found)
        for path, p in found:
            initial[path[0]] += p / total
            for a, b in itertools.pairwise(path):
                moves[a, b] += p / total
            for s, c in zip(path, t, strict=True):
                emits[c, s] += p / total
    for stretch in (10**6, 6, 1):  # in one stretch of steps, and cut into many
        got = hmm.expected(model, TEXTS, 4, stretch)
        assert all(np.allclose(a, b) for a, b in zip(got, (initial, moves, emits), strict=True))


def test_lanes_hold_every_text_once():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 60, 300), np.array([5000, 1, 1]), np.array([1])):
        lane, first, width, steps = hmm.lanes(lengths)
        used = np.zeros((width, steps), int)
        for i, s, n in zip(lane, first, lengths, strict=True):
            used[i, s : s + n] += 1
        assert used.max() == 1 and used.sum() == lengths.sum()


def plain_scores(train, ask, states, classes, passes, strength):
    """The model in plain code, text by text: counts, start, Baum-Welch over all paths' sums, scores."""
    counts = Counter(w for t in train for w in tokens(t)[:-1])
    place = lambda w: hmm.class_of(w.encode(), classes)
    code = lambda t: [place(w) for w in tokens(t)[:-1]] + [classes]
    trained = np.zeros(classes + 1)
    for w, n in counts.items():
        trained[place(w)] += n
    trained[classes] = len(train)
    unseen = max(sum(n == 1 for n in counts.values()), 1) / classes
    v = hmm.Vocabulary(trained, len(counts) + (len(train) > 0), unseen, {})
    around = np.zeros((classes + 1, 2 * hmm.KINDS))
    for t in train:
        for a, z in itertools.pairwise(code(t)):
            around[a, z % hmm.KINDS] += 1
            around[z, hmm.KINDS + a % hmm.KINDS] += 1
    model = hmm.started(around, v, states, strength)
    for _ in range(passes):
        initial, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((classes + 1, states))
        for t in train:
            c = code(t)
            alpha, beta = np.zeros((len(c), states)), np.ones((len(c), states))
            for i, x in enumerate(c):
                alpha[i] = (model.initial if i == 0 else alpha[i - 1] @ model.moves) * model.emits[x]
            for i in range(len(c) - 2, -1, -1):
                beta[i] = model.moves @ (model.emits[c[i + 1]] * beta[i + 1])
            p = alpha[-1].sum()
            initial += alpha[0] * beta[0] / p
            for i, x in enumerate(c):
                emits[x] += alpha[i] * beta[i] / p
                if i:
                    moves += alpha[i - 1][:, None] * model.moves * (model.emits[x] * beta[i])[None] / p
        model = v.reestimated(initial, moves, emits, strength)
    out = []
    for t in ask:
        a, total = None, 0.0
        for w, x in zip(tokens(t), code(t), strict=True):
            share = 1.0 if x == classes else (counts[w] or unseen) / (trained[x] + unseen)
            a = (model.initial if a is None else a @ model.moves) * model.emits[x] * share
            total += math.log10(a.sum())
            a = a / a.sum()
        out.append(total)
    return out


@pytest.mark.parametrize("passes", [0, 2])
def test_whole_scores_against_plain_code(spark, passes):
    rng = np.random.default_rng(7)
    train = [" ".join(rng.choice(list("abcdefgh") if i % 2 else list("stuvwxyz"), rng.integers(0, 12))) for i in range(30)]
    ask = ["", "a b Q", "unseen words only", "S t u a", None]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(100 + i, t, False) for i, t in enumerate(ask)]
    df = spark.createDataFrame(rows, "doc_id long, text string, trains boolean").repartition(3)
    got = {r["doc_id"]: r["score"] for r in hmm.score_sequences(df, states=3, classes=17, passes=passes, strength=5.0).collect()}
    want = plain_scores(train, train + ask, 3, 17, passes, 5.0)
    assert [got[r[0]] for r in rows] == pytest.approx(want, abs=2e-4)


def test_texts_that_do_not_train_change_nothing(spark):
    rng = np.random.default_rng(8)
    train = [(i, " ".join(rng.choice(list("abcdefgh") if i % 2 else list("stuvwxyz"), 20)), True) for i in range(40)]
    scores = []
    for other in ("a " * 500, " ".join(f"word{i} z" for i in range(300))):
        df = spark.createDataFrame([*train, *((100 + i, other, False) for i in range(30))], "doc_id long, text string, trains boolean")
        scores.append({r["doc_id"]: (r["score"], r["base_score"], r["train_tokens"]) for r in hmm.score_sequences(df, states=2).collect() if r["doc_id"] < 100})
    assert len(scores[0]) == 40 and all(scores[0][k] == pytest.approx(scores[1][k], abs=1e-6) for k in scores[0])


def test_training_raises_the_likelihood(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(list("abcd") if i % 2 else list("wxyz"), 30)), True) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, trains boolean")
    got = [hmm.score_sequences(docs, states=2, passes=n, strength=2.0).agg(F.sum("score"), F.sum("base_score")).first() for n in (0, 3)]
    assert got[1][0] >= got[0][0] - 1
    assert got[1][0] > got[1][1] + 0.2 * 80 * 30 * math.log10(2)


def test_base_scores_and_counts(spark, docs, rows):
    asked = docs.withColumn("trains", ~F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)))
    got = hmm.score_sequences(asked, states=2, classes=20, passes=1).collect()
    counts = Counter()
    for r in rows:
        if r[0] is None or r[0] % 5:
            counts.update(tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((r[0] is None, r[0] or 0, len(t := tokens(r[1])), sum(counts[x] > 0 for x in t), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), 5)) for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


@pytest.mark.parametrize("states", [1, 2])
def test_probabilities_of_short_texts_add_up(spark, states):
    """With one state a step doesn't depend on the one before: the end, the words and each class's unseen word are all there is."""
    train = [(i, t, True) for i, t in enumerate(["a b", "a a c", "b", "", "d"])]
    fresh = {hmm.class_of(w.encode(), 3): w for w in (f"new{i}" for i in range(50))}
    asked = ["", "a", "b", "c", "d", *fresh.values()]
    df = spark.createDataFrame(train + [(100 + i, t, False) for i, t in enumerate(asked)], "doc_id long, text string, trains boolean")
    got = {r["doc_id"]: 10 ** r["score"] for r in hmm.score_sequences(df, states=states, classes=3, passes=1).collect()}
    ends = [got[100 + i] for i in range(len(asked))]
    assert len(fresh) == 3 and 0 < sum(ends) < 1
    if states == 1:
        assert ends[0] + sum(x / ends[0] for x in ends[1:]) == pytest.approx(1, abs=1e-4)


def test_nothing_to_learn_from(spark, empty):
    assert hmm.score_sequences(empty.withColumn("trains", F.lit(True))).count() == 0
    df = spark.createDataFrame([(1, "a b", False), (2, None, None)], "doc_id long, text string, trains boolean")
    got = {r["doc_id"]: r for r in hmm.score_sequences(df).collect()}
    assert got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0 and math.isfinite(got[1]["score"])
