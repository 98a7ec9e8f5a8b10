"""Language ID by multilingual mixture inference.

Training counts letter trigrams per language over all training rows. For each
document, expectation-maximisation estimates what share of its trigrams each
language has, and the set of languages is the one of best penalised likelihood
among the nested sets of its most likely languages, the empty set (a uniform
choice of trigrams) included: a set grows as long as that raises it.

Every language that occurs is learned. Trigrams are counted in a fixed number
of buckets, so the model is a table of BUCKETS x languages whatever the size of
the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, in_workers, table

BUCKETS = 1 << 16
#: Characters that are worked on at a time, and languages for which so many are.
CHARS, FEW = 250_000, 16
#: Languages of which a task holds counts at a time.
HELD = 64
#: EM steps of the full mixture, and of a set.
STEPS, SET_STEPS = 12, 4


@cache
def letters() -> np.ndarray:
    """1 for code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


def hashed(code: np.ndarray, mid: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each place ``mid`` + 1 of folded code points."""
    a, b, c = code[mid], code[mid + 1], code[mid + 2]
    h = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(16)
    return h & np.uint32(BUCKETS - 1)


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, what isn't a letter as one blank, and the places before letters that aren't first or last."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[code]
    return np.where(is_letter, code, 32).astype(np.uint32), np.flatnonzero(is_letter[1:-1])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document index, bucket) of each trigram around a letter; what isn't a letter is one blank."""
    texts = [t.lower() for t in texts]
    if not texts:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    code, mid = folded("\0".join(["", *texts, ""]))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.searchsorted(np.cumsum(lengths), mid, side="right").astype(np.uint32), hashed(code, mid)


def counted(texts: list[str], chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index << 16 | bucket, count), sorted; a text longer than ``chars`` is read in parts."""
    if len(texts) > 1 or len(texts[0]) <= chars:
        doc, bucket = trigrams(texts)
        return np.unique((doc << np.uint32(16)) | bucket, return_counts=True)
    sums, whole = np.zeros(BUCKETS, np.int64), "\0" + texts[0].lower() + "\0"
    for i in range(0, len(whole) - 2, chars):
        sums += np.bincount(hashed(*folded(whole[i : i + chars + 2])), minlength=BUCKETS)
    bucket = np.flatnonzero(sums)
    return bucket.astype(np.uint32), sums[bucket]


def in_steps(texts: list[str | None], chars: int) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) with about ``chars`` characters together, and fewer than 65,536 texts; a longer text is alone."""
    start, n, some = 0, 0, []
    for i, t in enumerate(texts):
        if some and (n + len(t or "") > chars or len(some) == 65_000):
            yield start, some
            start, n, some = i, 0, []
        some.append(t or "")
        n += len(t or "")
    if some:
        yield start, some


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages, float32 probabilities

    @property
    def chars(self) -> int:
        """Characters at a time: their trigrams meet a row of all languages each."""
        return max(1, CHARS * FEW // max(FEW, len(self.languages)))

    def infer(self, texts: list[str | None], penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the main language (-1: no letter), its share, number of languages in the set, for each text."""
        main, share, size = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if self.languages:
            for start, some in in_steps(texts, self.chars):
                at, m, s, n = self._infer(some, penalty)
                main[start + at], share[start + at], size[start + at] = m, s, n
        return main, share, size

    def _infer(self, texts: list[str], penalty: float):
        key, count = counted(texts, self.chars)
        at, starts = np.unique(key >> np.uint32(16), return_index=True)
        if not len(at):
            return at, at, at, at
        widths = np.diff(np.append(starts, len(key)))
        p, count = self.table[key & np.uint32(BUCKETS - 1)], count.astype(np.float32)
        n = np.add.reduceat(count, starts)
        theta, _ = self._em(p, count, starts, widths, n, np.full((len(at), len(self.languages)), 1 / len(self.languages), np.float32), STEPS)
        order = np.argsort(-theta, axis=1, kind="stable")
        best = -n * np.log(BUCKETS)  # the empty set
        chosen = np.zeros(len(at), np.int64)
        single = np.log(np.maximum(np.take_along_axis(p, np.repeat(order[:, :1], widths, axis=0), 1)[:, 0], 1e-30))
        value = np.add.reduceat(single * count, starts)  # the penalty is for languages beyond the first
        chosen[value > best] = 1
        best = np.maximum(best, value)
        shares = np.zeros_like(theta)
        np.put_along_axis(shares, order[:, :1], 1.0, 1)
        growing = np.ones(len(at), np.bool_)
        for k in range(2, len(self.languages) + 1):
            # a language that explains less than one trigram can't be worth the penalty
            growing &= np.take_along_axis(theta, order[:, k - 1 : k], 1)[:, 0] * n >= 1
            mixed = np.flatnonzero(growing)
            if not len(mixed):
                break
            rows = np.concatenate([np.arange(starts[d], starts[d] + widths[d]) for d in mixed])
            w = widths[mixed]
            s = np.concatenate([[0], np.cumsum(w)[:-1]])
            columns = order[mixed, :k]
            some = np.take_along_axis(p[rows], np.repeat(columns, w, axis=0), 1)
            first = np.take_along_axis(np.maximum(theta[mixed], 1e-3), columns, 1)
            fit, like = self._em(some, count[rows], s, w, n[mixed], first / first.sum(1, keepdims=True), SET_STEPS)
            value = like - penalty * (k - 1) * np.log(n[mixed] + 1)
            better = value > best[mixed]
            won = mixed[better]
            best[won], chosen[won], shares[won] = value[better], k, 0
            shares[won[:, None], columns[better]] = fit[better]
            growing[mixed[~better]] = False
        winner = shares.argmax(1)
        # the share that the full mixture gives the winner: 1 only if no other language explains anything
        return at, winner, np.take_along_axis(theta, winner[:, None], 1)[:, 0], chosen

    @staticmethod
    def _em(p, count, starts, widths, n, theta, steps):
        which = np.repeat(np.arange(len(widths)), widths)
        for _ in range(steps):
            r = p * theta[which]
            r *= (count / np.maximum(r.sum(1), 1e-30))[:, None]
            theta = np.add.reduceat(r, starts, axis=0) / n[:, None]
        like = np.add.reduceat(np.log(np.maximum((p * theta[which]).sum(1), 1e-30)) * count, starts)
        return theta, like


def train_languages(labelled: DataFrame, smoothing: float = 0.1) -> LanguageModel:
    """Counts of all rows of ``labelled(lang, text)``; the driver gets BUCKETS x languages sums at most."""
    names = sorted(r["lang"] for r in labelled.where("lang is not null").select(F.col("lang").cast("string")).distinct().collect())
    place = {name: i for i, name in enumerate(names)}

    def rows(counts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, sums in counts.items():
            bucket = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), lang, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[bucket])], names=["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in in_slices(batches):
            langs, texts = np.array([place.get(x, -1) for x in b.column(0).to_pylist()]), b.column(1).to_pylist()
            for start, some in in_steps(texts, CHARS):
                key, n = counted(some, CHARS)
                lang = langs[start + (key >> np.uint32(16)).astype(np.int64)]
                for k in np.unique(lang[lang >= 0]):
                    mine = lang == k
                    if int(k) not in counts and len(counts) == HELD:
                        yield from rows(counts)
                        counts = {}
                    counts.setdefault(int(k), np.zeros(BUCKETS, np.int64))
                    counts[int(k)] += np.bincount(key[mine] & np.uint32(BUCKETS - 1), n[mine], BUCKETS).astype(np.int64)
        yield from rows(counts)

    sums = in_workers(labelled.select(F.col("lang").cast("string"), "text"), run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(names)), np.float32)
    counts[sums["bucket"], sums["lang"]] = sums["n"]
    if names:
        counts += np.float32(smoothing)
        counts /= counts.sum(0, dtype=np.float64).astype(np.float32)
    return LanguageModel(tuple(names), counts)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and text is not null").select("lang", "text")


def identify(docs: DataFrame, model: LanguageModel, penalty: float = 2.0) -> DataFrame:
    """doc_id, lang_pred, score, n_languages for every row.

    lang_pred: the language with the largest share, ``und`` if the text is
    null or has no letter, or if no language was learned (score 0 then).
    score: the share that the mixture of all languages gives it. n_languages:
    the size of the set chosen; 0 if a uniform choice of trigrams explains the
    text better than any language. Repeated rows are judged alike; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            main, share, size = model.infer(b.column(1).to_pylist(), penalty)
            names = np.array([*model.languages, "und"], object)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[main], pa.string()), pa.array(np.clip(share, 0, 1)), pa.array(size)], names=["doc_id", "lang_pred", "score", "n_languages"])

    return in_workers(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double, n_languages long")


def keep_identified(docs: DataFrame, model: LanguageModel, penalty: float = 2.0) -> DataFrame:
    """The rows of ``docs``, unchanged, whose set of languages isn't empty."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            main, _, size = model.infer(b.column(at).to_pylist(), penalty)
            yield b.filter(pa.array((main >= 0) & (size > 0)))

    return in_workers(docs, run, docs.schema)


def held_out(doc_id: str, parts: int, which: int):
    """crc32 of the id as text leaves ``which``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == which, F.lit(False))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_languages(training_rows(docs.where(~held_out("doc_id", 4, 2))))
    found = identify(docs, model).withColumn("held_out", held_out("doc_id", 4, 2))
    return found.select("doc_id", "held_out", "lang_pred", "score", "n_languages")
