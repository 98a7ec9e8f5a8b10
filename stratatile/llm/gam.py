"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a row of FEATURES: general statistics of its characters,
words and lines, and the mean log-odds of its byte n-grams, which are learned
from the labels. Training bins every feature and boosts shallow trees
cyclically, feature after feature, on the bins; the sum of a feature's trees is
its lookup table. Pairs of features that still explain the residual get a table
over both their bins. A score is the sum of looked-up values: additions over
whole columns of bins.

Labels may be a bounded sample (about ``max_rows`` labelled rows, chosen by a
hash of their id); only their texts are read for training. All texts are then
scored in one pass.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, in_slices, in_workers, materialize, table, text_bytes
from .langid import held_out

FEATURES = (
    "log_words", "word_length", "letters", "caseless", "upper", "digits", "symbols", "spaces", "bare_symbols", "ends_in_symbol",
    "distinct_words", "top_word", "same_as_last", "top_pair", "word_entropy", "byte_entropy", "compressed", "distinct_lines", "line_words", "log_longest_line", "gram_odds",
)
#: Bytes of an n-gram, bits of its hash, and parts of the labelled texts, each of which gets the odds that the others give.
GRAM, GRAM_BITS, FOLDS = 4, 14, 4
#: Bytes that are worked on at a time.
BYTES = 1 << 22


@cache
def kinds() -> np.ndarray:
    """Class of each code point: 0 letter without case, 1 lower, 2 upper, 3 digit, 4 space, 5 symbol or other."""
    out = np.full(0x110000, 5, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = 2 if c.isupper() else 1 if c.islower() else 0
        elif c.isdigit():
            out[i] = 3
        elif c.isspace():
            out[i] = 4
    return out


def pieces(text: bytes, overlap: int = 0) -> Iterator[np.ndarray]:
    """The bytes of a text, BYTES at a time."""
    whole = np.frombuffer(text, np.uint8)
    for i in range(0, max(len(whole) - overlap, 0), BYTES):
        yield whole[i : i + BYTES + overlap]


def entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def grams(piece: np.ndarray) -> np.ndarray:
    """Hash of every GRAM bytes in a row, lower-cased (A-Z)."""
    low = np.where((piece >= 65) & (piece <= 90), piece + 32, piece).astype(np.uint32)
    n = len(low) - GRAM + 1
    h = low[:n].copy()
    for k in range(1, GRAM):
        h |= low[k : k + n] << np.uint32(8 * k)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)


def gram_weights(text: bytes) -> np.ndarray:
    """Share of each hash among the n-grams of a text; none if it is shorter than one."""
    counts = np.zeros(1 << GRAM_BITS)
    for piece in pieces(text, GRAM - 1):
        counts += np.bincount(grams(piece), minlength=len(counts))
    return counts / max(counts.sum(), 1)


def mean_odds(text: bytes, odds: np.ndarray) -> float:
    total, n = 0.0, 0
    for piece in pieces(text, GRAM - 1):
        found = odds[grams(piece)]
        total, n = total + float(found.sum(dtype=np.float64)), n + len(found)
    return total / n if n else 0.0


def features(text: bytes, odds: np.ndarray) -> list[float]:
    """The FEATURES of one text; all zero if it has no word."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, kind, chars = len(words), np.zeros(6, np.int64), 0
    string = text.decode("utf-8", "replace")
    for i in range(0, len(string), BYTES):
        part = np.frombuffer(string[i : i + BYTES].encode("utf-32-le", "surrogatepass"), "<u4")
        kind += np.bincount(kinds()[part], minlength=6)
        chars += len(part)
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    often = np.fromiter(counts.values(), float, len(counts))
    pairs = Counter(zip(lower, lower[1:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1, int(kind[0] + kind[1] + kind[2]))
    # a byte above 127 is part of a letter as far as words go; ASCII says the rest
    plain = [w for w in counts if not w.isalnum() and w.isascii()]
    bare = sum(counts[w] for w in plain if not any(map(bytes.isalnum, (w[i : i + 1] for i in range(len(w))))))
    ended = sum(counts[w] for w in counts if w[-1] < 128 and not w[-1:].isalnum())
    bytes_ = sum(np.bincount(piece, minlength=256) for piece in pieces(text))
    return [
        np.log1p(n), chars / n, letters / chars, kind[0] / letters, kind[2] / letters, kind[3] / chars, kind[5] / chars, kind[4] / chars, bare / n, ended / n,
        len(counts) / n**0.7, often.max() / n, sum(map(bytes.__eq__, lower, lower[1:])) / n, max(pairs.values(), default=0) / n, entropy(often) / np.log2(n + 1), entropy(bytes_), len(zlib.compress(text, 1)) / len(text), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), np.log1p(max(map(len, lines), default=0)), mean_odds(text, odds),
    ]


def feature_array(column: pa.Array, odds: list[np.ndarray]) -> np.ndarray:
    """Features of each text, with the odds of its place in the list."""
    rows = [features(t, o) for t, o in zip(text_bytes(column), odds, strict=True)]
    return np.array(rows, np.float32).astype(np.float64).reshape(-1, len(FEATURES))


def log_odds(weights: np.ndarray, strength: float = 0.5) -> np.ndarray:
    """log of a hash's share in texts of label 1 over that in texts of label 0, from (2, hashes) sums; 0 if a label is lacking."""
    if not weights.sum(1).all():
        return np.zeros(weights.shape[1], np.float32)
    even = strength * weights.sum() / weights.shape[1] / 2
    p = (weights + even) / (weights + even).sum(1, keepdims=True)
    return np.log(p[1] / p[0]).astype(np.float32)


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; ``pairs`` has (feature, feature, table over both bins); ``odds`` are those of the n-grams."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    odds: np.ndarray = field(default_factory=lambda: np.zeros(1 << GRAM_BITS, np.float32))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        b, total = self.bins(x), np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for i, j, t in self.pairs:
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))

    def score_texts(self, column: pa.Array) -> np.ndarray:
        return self.score(feature_array(column, [self.odds] * len(column)))


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Best gain and place of a cut of ordered bins with gradient and curvature sums."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Values of a tree over ordered bins."""
    gain, at = _split(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)])


def _tree2(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """The same over the bins of two features."""
    down, across = (_split(g.sum(1 - a), h.sum(1 - a), ridge) for a in (0, 1)) if depth else ((0.0, 0), (0.0, 0))
    if max(down[0], across[0]) <= 1e-9:
        return np.full(g.shape, g.sum() / (h.sum() + ridge))
    axis, at = (0, down[1]) if down[0] >= across[0] else (1, across[1])
    (ga, gb), (ha, hb) = np.split(g, [at], axis), np.split(h, [at], axis)
    return np.concatenate([_tree2(ga, ha, depth - 1, ridge), _tree2(gb, hb, depth - 1, ridge)], axis)


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, depth: int = 2, pairs: int = 6, ridge: float = 2.0) -> AdditiveModel:
    """Cyclic boosting on the logistic loss. Without rows: 0.5 for all; with one kind of label: its smoothed rate."""
    rate_of_one = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(rate_of_one / (1 - rate_of_one))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b, total = model.bins(x), np.full(len(y), model.base)

    def slopes(cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(cells, y - p, n), np.bincount(cells, p * (1 - p), n)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            step = rate * _tree(*slopes(b[:, j], len(t)), depth, ridge)
            t += step
            total += step[b[:, j]]
    found = []
    for i, j in combinations(range(x.shape[1]), 2):
        shape = (len(model.tables[i]), len(model.tables[j]))
        g, h = (a.reshape(shape) for a in slopes(b[:, i] * shape[1] + b[:, j], shape[0] * shape[1]))
        v = _tree2(g, h, 2, ridge)
        found.append((float((v * g).sum()), i, j))
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for _, i, j in sorted(found, reverse=True)[:pairs]]
    for _ in range(rounds // 3):  # pairs and single features in turn, as each changes what the others have to explain
        for i, j, t in model.pairs:
            cells = b[:, i] * t.shape[1] + b[:, j]
            step = rate * _tree2(*(a.reshape(t.shape) for a in slopes(cells, t.size)), depth + 1, ridge)
            t += step
            total += step[b[:, i], b[:, j]]
        for j, t in enumerate(model.tables):
            step = rate * _tree(*slopes(b[:, j], len(t)), depth, ridge)
            t += step
            total += step[b[:, j]]
    return model


def labelled_texts(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of about ``max_rows`` labelled rows of ``docs`` at most; of repeated labels the lowest counts.

    Labels are thinned by a hash of their id (a top-k would send max_rows rows
    from every task) and then so few that they are broadcast: texts aren't
    shuffled. Rows are thinned once more if ids repeat in ``docs``.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("y"))
    n = marks.count()
    if n > max_rows:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = rows.select("doc_id").join(F.broadcast(marks), "doc_id").count()
    joined = rows.join(F.broadcast(marks), "doc_id")
    return joined.where(F.rand(17) < max_rows / met) if met > 1.5 * max_rows else joined


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 50_000) -> AdditiveModel:
    """Model of label ``quality`` (0 or 1) from the texts of labelled ``docs(doc_id, text)``; see ``labelled_texts``.

    Rows with a null doc_id or without a label don't train. The n-gram odds of
    a training text come from the other FOLDS of the texts, so that they tell
    as much of it as of an unknown text.
    """
    sample = materialize(labelled_texts(docs, labels, max_rows), "labelled")
    cells = FOLDS * 2
    fold_of = lambda i: zlib.crc32(str(i).encode()) // 8 % FOLDS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((cells, 1 << GRAM_BITS))
        for b in in_slices(batches):
            for i, text, y in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                sums[fold_of(i) * 2 + int(y > 0)] += gram_weights(text)
        cell, gram = sums.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(gram.astype(np.int32)), pa.array(sums[cell, gram])], names=["cell", "gram", "w"])

    found = in_workers(sample, counted, "cell int, gram int, w double").groupBy("cell", "gram").agg(F.sum("w").alias("w")).toPandas()
    sums = np.zeros((cells, 1 << GRAM_BITS))
    sums[found["cell"], found["gram"]] = np.round(found["w"], 9)  # sums come in any order
    by_label = sums.reshape(FOLDS, 2, -1)
    others = [log_odds(by_label.sum(0) - by_label[k]) for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            x = feature_array(b.column(1), [others[fold_of(i)] for i in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), b.column(2)], names=["doc_id", "x", "y"])

    got = in_workers(sample, run, "doc_id long, x array<double>, y double").toPandas()
    discard(sample)
    x, y = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES)), got["y"].to_numpy(float)
    order = np.lexsort((*x.T, got["doc_id"].to_numpy()))  # the same model whatever the order of arrival
    model = fit_additive(x[order], y[order])
    model.odds = log_odds(by_label.sum(0))
    return model


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; null and empty texts are scored too, repeated rows alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score_texts(b.column(1)))], names=["doc_id", "score"])

    return in_workers(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, unchanged, that score ``threshold`` or more. Null texts count as empty."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            yield b.filter(pa.array(model.score_texts(b.column(at)) >= threshold))

    return in_workers(docs, run, docs.schema)


def op6_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores for every row; rows with a null doc_id are scored too and never train."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    scored = score_quality(docs, train_quality(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
