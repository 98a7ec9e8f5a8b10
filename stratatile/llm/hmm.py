"""Hidden Markov language model.

Tokens are the lower-cased words of a text and one end. The model has
``states`` latent states. Words fall into classes by a hash, the end is a class
of its own; a state emits a class, and a word has a share of its class:

    P(word | state) = P(class | state) * c / (N + u)

with c the training count of the word, N the training tokens of its class and u
what all words of the class that training lacks have together: the number of
words that training has once over the number of classes (Good and Turing's
estimate). So every word is treated alike, frequent or not, at every size of
the corpus: what workers hold is a table of ``classes`` x ``states``, and the
counts of words, which grow with the corpus, stay a distributed table.

Training: a start from what surrounds each class in all training texts (classes
that are followed and preceded alike start in one state), then ``passes`` of
Baum-Welch whose expected counts come from all whole training texts, summed
over partitions. Scoring: the scaled forward recursion over each whole text in
double precision. Texts that don't train have no part in any of it.

Many texts go through the recursion side by side: they are laid end to end in
lanes, and a lane starts anew from the initial distribution at each text's
first token. Long lanes are worked on in stretches whose forward variables are
recomputed from the one that entered the stretch, so memory doesn't grow with
the length of a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, in_workers, materialize, table, text_bytes, words_of
from .langid import held_out

SEED = 42
#: Classes of words; with the end they are 16-bit numbers.
CLASSES = (1 << 16) - 1
#: Distinct words that a task counts, and classes that it remembers, before it hands them on or starts anew.
FLUSH = 250_000
#: Tokens that go through the recursion together.
TOGETHER = 1_000_000
#: A word with at least this share of the training tokens is looked up from a broadcast: there are 1 / HEAVY at most.
HEAVY = 2e-6
#: Kinds of neighbours that the start tells apart.
KINDS = 16


_digest = xxhash.xxh64_intdigest


def class_of(word: bytes, classes: int) -> int:
    """The same number as pmod(xxhash64(word), classes) in SQL."""
    h = _digest(word, SEED)
    return (h - (1 << 64) if h >> 63 else h) % classes


class Classes(dict):
    """Classes by word, hashed when first met; forgets when it holds too many."""

    def __init__(self, classes: int) -> None:
        super().__init__()
        self.classes = classes

    def __missing__(self, word: bytes) -> int:
        if len(self) >= FLUSH:
            self.clear()
        h = _digest(word, SEED)
        self[word] = c = (h - (1 << 64) if h >> 63 else h) % self.classes
        return c


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, trained long) of ``texts(text)``; ends are not words."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "trained"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in in_slices(batches):
            for text in text_bytes(b.column(0)):
                counts.update(words_of(text))
                if len(counts) > FLUSH:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return in_workers(texts.select("text"), run, "word binary, trained long").groupBy("word").agg(F.sum("trained").alias("trained"))


@dataclass(frozen=True)
class Vocabulary:
    """Training counts of the classes of words and, last, of the end; ``heavy`` has the counts of the commonest words."""

    trained: np.ndarray
    types: int  # distinct training tokens, the end among them
    unseen: float  # u: weight of what training lacks, for each class
    heavy: dict[bytes, int]

    @property
    def end(self) -> int:
        return len(self.trained) - 1

    @property
    def tokens(self) -> int:
        return int(self.trained.sum())

    @property
    def log_shares(self) -> np.ndarray:
        """log10 of the denominator of each class's shares; the end is all of its class."""
        out = np.log10(self.trained + self.unseen)
        out[self.end] = 0
        return out

    @property
    def base(self) -> np.ndarray:
        """Smoothed distribution of the classes."""
        counts = self.trained + self.unseen
        return counts / counts.sum()

    def reestimated(self, initial: np.ndarray, moves: np.ndarray, emits: np.ndarray, strength: float) -> HiddenMarkov:
        """Probabilities from expected counts.

        A state has its share of the unseen, and is smoothed with ``strength`` tokens of the base distribution.
        """
        moves = moves + 1.0
        emits = emits + self.unseen * emits.sum(0) / max(emits.sum(), 1e-300) + strength * self.base[:, None]
        return HiddenMarkov((initial + 1) / (initial + 1).sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def learn_vocabulary(words: DataFrame, ends: int, classes: int) -> Vocabulary:
    """From written ``words(word, trained)``: one row for each class, and the rows of 1 / HEAVY words at most."""
    trained = np.zeros(classes + 1)
    sums = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(classes)).alias("class")).agg(F.sum("trained").alias("n"), F.count("*").alias("v"), F.sum((F.col("trained") == 1).cast("long")).alias("once")).toPandas()
    trained[sums["class"]] = sums["n"]
    trained[classes] = ends
    heavy = words.where(F.col("trained") >= F.lit(HEAVY * trained.sum())).collect()
    return Vocabulary(trained, int(sums["v"].sum()) + (ends > 0), max(float(sums["once"].sum()), 1.0) / classes, {bytes(r["word"]): r["trained"] for r in heavy})


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, trains, n_tokens, heavy, heavy_base, heavy_log, share_log, codes (uint16 bytes), other words and their counts.

    heavy, heavy_base, heavy_log: how many tokens are heavy words, and their
    sums of log10(count + 1) and log10(count); share_log: the sum of the
    denominators of all shares.
    """
    fields = "doc_id long, trains boolean, n_tokens long, heavy long, heavy_base double, heavy_log double, share_log double, codes binary, others array<binary>, times array<int>"
    end, shares = v.end, v.log_shares
    heavy = {w: (float(np.log10(n + 1)), float(np.log10(n))) for w, n in v.heavy.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(end)
        for b in in_slices(batches):
            columns: list[list] = [[] for _ in range(8)]
            for text in text_bytes(b.column(2)):
                words = words_of(text)
                codes = np.full(len(words) + 1, end, "<u2")
                codes[:-1] = np.fromiter(map(classes.__getitem__, words), "<u2", len(words))
                known, base, log, others, times = 0, 0.0, 0.0, [], []
                for w, n in Counter(words).items():
                    got = heavy.get(w)
                    if got is None:
                        others.append(w)
                        times.append(n)
                    else:
                        known += n
                        base += n * got[0]
                        log += n * got[1]
                for c, value in zip(columns, (len(codes), known, base, log, float(shares[codes].sum()), codes.tobytes(), others, times), strict=True):
                    c.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "trains", "n_tokens", "heavy", "heavy_base", "heavy_log", "share_log", "codes", "others", "times"])

    return in_workers(docs.select("doc_id", "trains", "text"), run, fields)


def sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


@dataclass(frozen=True)
class HiddenMarkov:
    """initial (K), moves (K x K, from row to column), emits (classes and the end x K)."""

    initial: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    def single(self) -> HiddenMarkov:
        return HiddenMarkov(*(x.astype(np.float32) for x in (self.initial, self.moves, self.emits)))


def lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(lane, first step) of each text, number of lanes and of steps: longest first, each to the emptiest lane of few."""
    steps = int(max(lengths.max(), min(int(lengths.sum()), 2048)))
    lane, first = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    at, used = 0, 0
    ordered = np.argsort(-lengths, kind="stable")
    # next-fit on sorted lengths fills lanes from both ends of the order
    low, high = 0, len(ordered) - 1
    while low <= high:
        i = ordered[low] if used + lengths[ordered[low]] <= steps else ordered[high]
        if used + lengths[i] > steps:
            at, used = at + 1, 0
            continue
        lane[i], first[i] = at, used
        used += lengths[i]
        if i == ordered[low]:
            low += 1
        else:
            high -= 1
    return lane, first, at + 1, steps


def laid_out(texts: list[np.ndarray], idle: int):
    """codes (steps x lanes), starts (steps x lanes boolean), used (the same), lane and first step of each text."""
    lengths = np.array([len(t) for t in texts])
    lane, first, width, steps = lanes(lengths)
    codes = np.full((width, steps), idle, np.int32)
    starts, used = np.zeros((width, steps), np.bool_), np.zeros((width, steps), np.bool_)
    for t, i, s in zip(texts, lane, first, strict=True):
        codes[i, s : s + len(t)] = t
        used[i, s : s + len(t)] = True
        starts[i, s] = True
    starts |= ~used
    return np.ascontiguousarray(codes.T), np.ascontiguousarray(starts.T), np.ascontiguousarray(used.T), lane, first


def forward(model: HiddenMarkov, codes: np.ndarray, starts: np.ndarray, a: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Scales (steps x lanes) of the forward recursion from ``a``, the scaled forward variables if asked for, and the last one."""
    steps, width = codes.shape
    scale = np.empty((steps, width), model.emits.dtype)
    alphas = np.empty((steps, width, len(model.initial)), model.emits.dtype) if keep else None
    some = starts.any(1)
    for t in range(steps):
        a = a @ model.moves
        if some[t]:
            a[starts[t]] = model.initial
        a *= model.emits[codes[t]]
        s = a.sum(1)
        a /= s[:, None]
        scale[t] = s
        if keep:
            alphas[t] = a
    return scale, alphas, a


def _entering(model: HiddenMarkov, width: int) -> np.ndarray:
    return np.tile(model.initial, (width, 1))


def log10_likelihoods(model: HiddenMarkov, texts: list[np.ndarray], idle: int) -> np.ndarray:
    """log10 of the probability of each sequence of codes."""
    out = np.zeros(len(texts))
    for some in in_groups(texts, TOGETHER):
        codes, starts, _, lane, first = laid_out([texts[i] for i in some], idle)
        logs = np.log10(forward(model, codes, starts, _entering(model, codes.shape[1]), keep=False)[0]).T
        for i, at, s in zip(some, lane, first, strict=True):
            out[i] = logs[at, s : s + len(texts[i])].sum()
    return out


def in_groups(texts: list[np.ndarray], most: int) -> Iterator[list[int]]:
    """Places of texts of like length, with about ``most`` tokens together; a longer text is alone."""
    n, some = 0, []
    for i in np.argsort([-len(t) for t in texts], kind="stable"):
        if some and n + len(texts[i]) > most:
            yield some
            n, some = 0, []
        some.append(int(i))
        n += len(texts[i])
    if some:
        yield some


def expected(model: HiddenMarkov, texts: list[np.ndarray], idle: int, stretch: int = TOGETHER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of initial states, moves and emissions (classes x K) over whole ``texts``.

    Forward variables are kept for about ``stretch`` tokens at a time.
    """
    k = len(model.initial)
    initial, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emits), k))
    for some in in_groups(texts, TOGETHER):
        codes, starts, used, _, _ = laid_out([texts[i] for i in some], idle)
        width = codes.shape[1]
        step = max(1, stretch // width)
        cuts = list(range(0, len(codes), step))
        entering = [_entering(model, width)]
        for c in cuts[:-1]:
            entering.append(forward(model, codes[c : c + step], starts[c : c + step], entering[-1], keep=False)[2])
        weighed = np.zeros((width, k), model.emits.dtype)  # backward variable of the step after, times its emission over its scale
        after = np.ones(width, np.bool_)  # the step after starts a text
        for c in reversed(cuts):
            part, begins = codes[c : c + step], starts[c : c + step]
            scale, gamma, _ = forward(model, part, begins, entering.pop(), keep=True)
            for t in range(len(part) - 1, -1, -1):
                moves += gamma[t].T @ weighed
                back = weighed @ model.moves.T
                back[after] = 1
                weighed = back * model.emits[part[t]] / scale[t][:, None]
                after = begins[t]
                weighed[after] = 0
                gamma[t] *= back
            within = used[c : c + step]
            gamma[~within] = 0
            initial += gamma[begins & within].sum(0)
            flat = part.ravel()
            for i in range(k):
                emits[:, i] += np.bincount(flat, gamma[:, :, i].ravel(), len(emits))
    return initial, moves * model.moves, emits


def neighbours(encoded: DataFrame, classes: int) -> np.ndarray:
    """(classes and the end x 2 KINDS): how often each class is followed and preceded by each kind of class, in all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((classes + 1) * 2 * KINDS, np.int64)
        for b in batches:
            # texts one after the other: what follows an end is not a neighbour
            whole = np.concatenate([np.empty(0, "<u2"), *sequences(b.column(0))]).astype(np.int64)
            a, z = whole[:-1], whole[1:]
            inside = a != classes
            a, z = a[inside], z[inside]
            sums += np.bincount(a * (2 * KINDS) + z % KINDS, minlength=len(sums))
            sums += np.bincount(z * (2 * KINDS) + KINDS + a % KINDS, minlength=len(sums))
        rows = sums.reshape(classes + 1, 2 * KINDS)
        place = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), *(pa.array(rows[place, i]) for i in range(2 * KINDS))], names=["class", *(f"k{i}" for i in range(2 * KINDS))])

    names = [f"k{i}" for i in range(2 * KINDS)]
    got = in_workers(encoded.where("trains").select("codes"), run, "class int, " + ", ".join(f"{n} long" for n in names)).groupBy("class").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    out = np.zeros((classes + 1, 2 * KINDS))
    out[got["class"]] = got[names].to_numpy(float)
    return out


def started(around: np.ndarray, v: Vocabulary, states: int, strength: float) -> HiddenMarkov:
    """States start as clusters of classes with like neighbours, weighed by how often the classes occur."""
    weight = around.sum(1)
    x = np.sqrt(around / np.maximum(weight[:, None], 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.maximum(norm, 1e-9)
    own = np.zeros(len(x), np.int64)
    if weight.any():
        centres = x[[int(weight.argmax())]]
        while len(centres) < states:  # the class with most tokens that are far from all centres
            far = weight * np.maximum(0, 1 - (x @ centres.T).max(1)) ** 2
            centres = np.vstack([centres, x[int(far.argmax())]])
        for _ in range(20):
            own = (x @ centres.T).argmax(1)
            centres = np.array([(x[own == c] * weight[own == c, None]).sum(0) if (own == c).any() else centres[c] for c in range(states)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    counts = np.full((len(x), states), 0.2 / states)
    counts[np.arange(len(x)), own] += 0.8
    moves = np.full((states, states), 0.2 / states) + np.eye(states) * 0.8
    return v.reestimated(np.ones(states), moves * 1000, counts * v.trained[:, None], strength)


def baum_welch(encoded: DataFrame, model: HiddenMarkov, v: Vocabulary, strength: float) -> HiddenMarkov:
    """One pass over all training texts; the driver gets one row for each class and state that occurs."""
    k, fast, size, end = len(model.initial), model.single(), len(v.trained), v.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        initial, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
        for b in batches:
            got = expected(fast, sequences(b.column(0)), end)
            initial, moves, emits = initial + got[0], moves + got[1], emits + got[2]
        code = np.flatnonzero(emits.any(1))
        values = np.concatenate([initial[None], moves, emits[code]])
        place = np.concatenate([[-1], -2 - np.arange(k), code])
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), *(pa.array(values[:, i].astype(np.float32)) for i in range(k))], names=["place", *(f"s{i}" for i in range(k))])

    names = [f"s{i}" for i in range(k)]
    sums = in_workers(encoded.where("trains").select("codes"), run, "place int, " + ", ".join(f"{n} float" for n in names)).groupBy("place").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    place, values = sums["place"].to_numpy(), sums[names].to_numpy(float)
    initial, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
    initial[:] = values[place == -1].sum(0)
    inner = place <= -2
    moves[-2 - place[inner]] = values[inner]
    emits[place[place >= 0]] = values[place >= 0]
    return v.reestimated(initial, moves, emits, strength)


def score_sequences(docs: DataFrame, states: int = 6, classes: int = CLASSES, passes: int = 3, strength: float = 200.0) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs(doc_id, text, trains)``.

    Learns from rows with ``trains`` true, and from nothing else. A null text
    is an empty one: its only token is the end. Repeated rows are scored alike,
    and count as often as they occur; other columns are ignored. Without
    training rows every token is unseen. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("trains", F.lit(False)).alias("trains"), "text")
    words = materialize(count_words(docs.where("trains")), "words")
    v = learn_vocabulary(words, docs.where("trains").count(), classes)
    encoded = materialize(encode(docs, v).withColumn("row", F.monotonically_increasing_id()), "codes")
    model = started(neighbours(encoded, classes), v, states, strength)
    for _ in range(passes):
        model = baum_welch(encoded, model, v, strength)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs = log10_likelihoods(model, sequences(b.column(7)), v.end)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(7)), pa.array(logs)], names=["row", "doc_id", "n_tokens", "heavy", "heavy_base", "heavy_log", "share_log", "logs"])

    scored = in_workers(encoded.select("row", "doc_id", "n_tokens", "heavy", "heavy_base", "heavy_log", "share_log", "codes"), run, "row long, doc_id long, n_tokens long, heavy long, heavy_base double, heavy_log double, share_log double, logs double")
    # words meet their counts by a shuffle; the heavy ones, on which it would be uneven, are not among them
    others = encoded.select("row", F.explode(F.arrays_zip("others", "times")).alias("w")).select("row", F.col("w.others").alias("word"), F.col("w.times").alias("times"))
    light = words.where(F.col("trained") < F.lit(HEAVY * v.trained.sum()))
    sums = others.join(light, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("trained") + 1)).alias("base"), F.sum(F.col("times") * F.log10("trained")).alias("log"), F.sum("times").alias("known"))
    joined = scored.join(sums, "row", "left").fillna({"base": 0.0, "log": 0.0, "known": 0})
    known, ends = F.col("heavy") + F.col("known"), float(v.trained[v.end])
    base = F.col("heavy_base") + F.col("base") + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(v.tokens + v.types + 1.0)))
    score = F.col("logs") + F.col("heavy_log") + F.col("log") + (F.col("n_tokens") - 1 - known) * F.lit(float(np.log10(v.unseen))) - F.col("share_log")
    return joined.select("doc_id", "n_tokens", (known + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 7, 2)
    scored = score_sequences(docs.select("doc_id", "text", (~out).alias("trains")))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
