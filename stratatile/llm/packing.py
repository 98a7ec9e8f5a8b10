"""Vector best-fit packing of tokenized documents into sequences.

A piece is a vector of what it uses: tokens, one document, and attention cost
(its length squared). A sequence has a capacity for each. Pieces go, longest
first, to a sequence among those where every capacity holds: the one whose
residual vector would have the smallest weighted norm, or the one whose free
capacities have the largest weighted dot product with the piece. Ties go to the
sequence opened first; where none fits, one is opened.

The vector depends on the length alone, so the packing is computed on counts
per length (at most ``capacity`` rows, whatever the number of documents) and
on classes of sequences with equal content; the sequences have the contents
that packing the pieces one at a time would give. Each piece then finds its place
from its rank among the pieces of its length. Ranks come from counts per
(length, slice), so that a length that a third of all pieces have is spread
over the slices.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_slices, in_workers, materialize, table, text_bytes

END = (1).to_bytes(4, "little")
CACHE_WORDS = 250_000
#: Pieces for each slice of a length, if all had one length.
SLICE_PIECES = 500_000
#: A word of letters whose lower case and normal form are plain, then punctuation.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")


class WordTokenizer:
    """Token ids of whole texts as bytes (little-endian 32 bits each), from a cache of words.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words one after the other. A word of plain letters and
    punctuation goes straight to the model in its parts; any other word takes
    the tokenizer's full path.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        got = self.parts.get(text)
        if got is None:
            if len(self.parts) >= CACHE_WORDS:
                self.parts.clear()
            mapped = text.encode().decode("latin-1").translate(self.shown)
            got = self.parts[text] = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        return got

    def word(self, word: bytes) -> bytes:
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        text = word.decode()
        if m := PLAIN.fullmatch(text):
            got = b"".join([self.part(x) for x in (m[1].lower(), m[2]) if x])
        else:
            got = np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.words[word] = got
        return got

    @staticmethod
    def reads(path: str) -> bool:
        """Whether a tokenizer's file has the normaliser and the splitter that this class relies on."""
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        # fixed values: these are what the file has
        normalizer = {"type": "Sequence", "normalizers": [{"type": "NFC"}, spaces, {"type": "Lowercase"}]}
        words = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
        byte = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        plain = all(PLAIN.fullmatch(t["content"]) is None or not t["content"].isalpha() for t in given.get("added_tokens", []))
        return plain and given.get("normalizer") == normalizer and given.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [words, byte]}

    def ids(self, text: bytes) -> bytes:
        get, words = self.words.get, text.split()
        return b"".join([x if (x := get(w)) is not None else self.word(w) for w in words])


    def forget(self) -> None:
        """Gives the caches' memory back; a worker goes on to other stages."""
        self.words, self.parts = {}, {}


class WholeTokenizer:
    """The same of any tokenizer, text by text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)

    def ids(self, text: bytes) -> bytes:
        return np.array(self.full.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        pass


@cache
def tokenizer(path: str) -> WordTokenizer | WholeTokenizer:
    return WordTokenizer(path) if WordTokenizer.reads(path) else WholeTokenizer(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each text's ids and the end id, cut at ``capacity``."""
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for b in in_slices(batches):
            of, piece, length, crc, ids = [], [], [], [], []
            for i, text in enumerate(text_bytes(b.column(1))):
                whole = own.ids(text) + END
                for k, at in enumerate(range(0, len(whole), step)):
                    part = whole[at : at + step]
                    of.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [b.column(0).take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()), pa.array(np.array(piece, np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        own.forget()

    return in_workers(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, fields)


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence; weights of tokens, documents and attention cost; how a sequence is chosen.

    A sequence full of texts of under four tokens reaches the number of
    documents first; a whole piece takes all tokens and all attention.
    """

    tokens: int = 4096
    documents: int = 1024
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    choose: str = "residual"

    @property
    def caps(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], float)

    def after(self, left: np.ndarray, need: np.ndarray) -> np.ndarray:
        """What a sequence with ``left`` capacities scores for a piece; the least is chosen."""
        if self.choose == "residual":
            return (np.array(self.weights) * ((left - need) / self.caps) ** 2).sum(-1)
        return -(np.array(self.weights) * (left / self.caps) * (need / self.caps)).sum(-1)


def need_of(length: int) -> np.ndarray:
    """Vector of a piece."""
    return np.array([length, 1.0, float(length) ** 2])


def plan_bins(counts: dict[int, int], limits: Limits) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], int]:
    """Runs by length, and the number of sequences.

    A run (rank, first, sequences, each, offset): from that rank on, pieces go
    ``each`` to a sequence, to so many sequences from ``first`` on, put from
    ``offset``. By residual norm a sequence that got a piece is still the best
    for the next equal one; by dot product it is not, so there the pieces of a
    length go to the best (sequence, number of pieces before) in one sort.
    """
    caps, runs, total = limits.caps, defaultdict(list), 0
    smallest = min(counts, default=0)
    left = np.zeros((64, 3))
    first, size, used = np.zeros(64, np.int64), np.zeros(64, np.int64), 0

    def keep(room: np.ndarray, start: int, n: int) -> None:
        nonlocal left, first, size, used
        if not n or (room < need_of(smallest)).any():
            return
        if used == len(left):
            alive = np.flatnonzero(size[:used] > 0)
            used = len(alive)
            grown = max(64, 2 * used)
            left, first, size = (np.concatenate([x[alive], np.zeros((grown - used, *x.shape[1:]), x.dtype)]) for x in (left, first, size))
        left[used], first[used], size[used] = room, start, n
        used += 1

    def put(length: int, rank: int, room: np.ndarray, start: int, n: int, each: int) -> int:
        """``each`` pieces into each of n sequences from ``start`` on; the next rank."""
        runs[length].append((rank, start, n, each, int(caps[0] - room[0])))
        keep(room - each * need_of(length), start, n)
        return rank + n * each

    for length in sorted(counts, reverse=True):
        need, todo, rank = need_of(length), counts[length], 0
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while rank < todo:
            fitting = np.flatnonzero((size[:used] > 0) & (left[:used] >= need).all(1))
            if not len(fitting):  # new sequences, each filled before the next is opened
                each = int((caps // need).min())
                whole, more = divmod(todo - rank, each)
                for n, k in ((whole, each), (int(more > 0), more)):
                    if n:
                        rank = put(length, rank, caps.copy(), total, n, k)
                        total += n
                break
            if limits.choose == "residual":
                score = limits.after(left[fitting], need)
                best = fitting[score == score.min()]
                shares = [(int(best[first[best].argmin()]), None)]
            else:
                shares = dot_shares(limits, left[fitting], first[fitting], size[fitting], need, todo - rank)
                shares = [(int(fitting[i]), some) for i, some in shares]
            taken = [(left[i].copy(), int(first[i]), int(size[i]), some) for i, some in shares]
            size[[i for i, _ in shares]] = 0
            for room, start, n, some in taken:
                if some is None:
                    each = int((room // need).min())
                    whole, more = divmod(min(todo - rank, n * each), each)
                    some = [(whole, each), (int(more > 0), more)]
                for m, k in some:
                    if m:
                        rank = put(length, rank, room, start, m, k)
                        start, n = start + m, n - m
                keep(room, start, n)
    return runs, total


def dot_shares(limits: Limits, left: np.ndarray, first: np.ndarray, size: np.ndarray, need: np.ndarray, todo: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For classes of sequences that a piece fits: how many sequences of each, in order, get how many of ``todo`` equal pieces."""
    most = (left // need).min(1).astype(np.int64)
    which = np.repeat(np.arange(len(left)), most)
    before = np.arange(len(which)) - np.repeat(np.cumsum(most) - most, most)
    score = limits.after(left[which] - before[:, None] * need, need)
    order = np.lexsort((before, first[which], score))
    upto = np.cumsum(size[which[order]])
    full = order[: int(np.searchsorted(upto, todo, side="right"))]  # every sequence of the class gets this piece
    got = np.bincount(which[full], minlength=len(left))
    rest = todo - int(size[which[full]].sum())
    shares = {int(i): [(int(size[i]), int(got[i]))] for i in np.flatnonzero(got)}
    if rest and len(full) < len(order):  # the first sequences of the next class get one more
        i = int(which[order[len(full)]])
        shares[i] = [(rest, int(got[i]) + 1)] + ([(int(size[i]) - rest, int(got[i]))] if got[i] else [])
    return list(shares.items())


def pack_pieces(pieces: DataFrame, limits: Limits) -> DataFrame:
    """Adds sequence_id and offset to written ``pieces(row, length, ...)``; row is a number of its own for each."""
    slices = max(64, pieces.count() // SLICE_PIECES)
    counted = pieces.groupBy("length", F.pmod(F.xxhash64("row"), F.lit(slices)).alias("slice")).agg(F.count("*").alias("n"))
    by_length = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limits.tokens rows at most
    runs, _ = plan_bins(by_length, limits)
    before = counted.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "slice").orderBy("row"))
    ranked = pieces.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices))).withColumn("inside", inside).join(before, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("slice", "row", "inside", "before")
    plan = {n: tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) for n, rows in runs.items()}
    kept = [c for c in ranked.columns if c != "rank"]
    schema = ranked.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                starts, first, _, each, begin = plan[int(n)]
                k = np.searchsorted(starts, rank[at], side="right") - 1
                q = rank[at] - starts[k]
                sequence[at] = first[k] + q // each[k]
                offset[at] = begin[k] + q % each[k] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[f.name for f in schema])

    return in_workers(ranked, run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, limits: Limits | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece of every row.

    Null and empty texts are a piece of the end id alone. Longer documents are
    cut into pieces of the token capacity, of which the last may be shorter.
    Rows with null or repeated ids are packed like any other; other columns
    are ignored; an empty table has no pieces.
    """
    limits = limits or Limits()
    pieces = materialize(tokenized_pieces(docs, path or tokenizer_path(), limits.tokens, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack_pieces(pieces, limits)


def op4_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
