"""I-Match fingerprints over randomised lexicon subsets.

A text's terms are its distinct lower-cased words. The lexicon keeps terms
whose inverse document frequency lies in a chosen band. SUBSETS randomised
subsets of the lexicon, which overlap, keep a share of one in 2 ** BITS of its
terms each; all of a text's lexicon terms in a subset are sorted and hashed
together. The whole lexicon is one more subset.

A long text has many terms in every such subset, and any edit would change all
hashes. So there are lexicons of many levels: that of level k keeps one term in
2 ** k, the same ones for all texts. A text has hashes for its own level, which
keeps about ``terms`` of its words, and for all higher ones as far as it has
terms there. Two texts are compared on all levels that both have, from the
higher of their own levels up: their likeness is the share of subsets with equal
hashes, of those that either has terms in. Any two texts share levels, whatever
their sizes.

Everything is DataFrame functions. Document frequencies are sums over 64-bit
hashes of terms, made per task before they are shuffled; only the terms of a
text's own level go on to meet the lexicon. Terms above the band are few (their
number is at most the mean number of terms of a text over the upper limit of
the frequency), and they are dropped before anything is shuffled by term.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, ascii_lower, materialize, table

#: Bits of a second hash of a term that say whether a subset keeps it, and subsets: all such groups of 64 bits.
BITS = 4
SUBSETS = 64 // BITS
#: Subsets with the whole lexicon, and bits of a hash that a fingerprint keeps for each.
ALL, KEPT = SUBSETS + 1, 24
#: Bytes of text in a task, about.
TASK_BYTES = 32 << 20


def term_hashes(text: Column) -> Column:
    """Array of the hashes of the distinct words of a text."""
    words = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE)
    return F.transform(F.filter(F.array_distinct(words), lambda w: w != ""), lambda w: F.xxhash64(w))


def level_of(count: Column, terms: int) -> Column:
    """Thinning level of a text with so many terms."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(count, F.lit(1)) / F.lit(float(terms))))).cast("int")


def thinned(hashes: Column, level: Column) -> Column:
    """Terms that the lexicon of a level can have: those that end in so many zero bits."""
    return F.filter(hashes, lambda h: h.bitwiseAND(F.pow(F.lit(2), level).cast("long") - 1) == 0)


def signatures(kept: Column, level: Column) -> Column:
    """Array of longs, one for each level and subset that has terms of ``kept``: level, subset and KEPT bits of the hash.

    The whole lexicon, number SUBSETS, has one of ``level`` alone, so that every text with terms has a mark. ``kept`` are sorted hashes of terms, all of the lexicon of ``level``.
    """
    known = F.transform(kept, lambda h: F.struct(h.alias("h"), F.xxhash64(h, F.lit(1)).alias("g"), F.log2(h.bitwiseAND(-h).cast("double")).cast("int").alias("top")))
    known = F.transform(known, lambda t: F.struct(t["h"].alias("h"), t["g"].alias("g"), F.coalesce(t["top"], F.lit(63)).alias("top")))

    def mark(k: Column, s: Column, terms: Column) -> Column:
        return (k * ALL + s).cast("long") * 2**KEPT + F.xxhash64(F.transform(terms, lambda t: t["h"])).bitwiseAND(F.lit(2**KEPT - 1))

    def of_subset(s: Column) -> Column:
        members = F.filter(known, lambda t: F.call_function("shiftrightunsigned", t["g"], s * BITS).bitwiseAND(F.lit(2**BITS - 1)) == 0)
        # as long as there are terms: no level above the top one has any
        return F.transform(F.array(members), lambda m: F.when(F.size(m) > 0, F.transform(F.sequence(level, F.array_max(F.transform(m, lambda t: t["top"]))), lambda k: mark(k, s, F.filter(m, lambda t: t["top"] >= k)))).otherwise(F.array().cast("array<long>")))[0]

    whole = F.when(F.size(kept) > 0, F.array(mark(level, F.lit(SUBSETS), known))).otherwise(F.array().cast("array<long>"))
    return F.concat(whole, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), of_subset)))


def with_next(docs: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, ``next``, bucket, place of ``docs(doc_id, text)``, a table of so many ``rows``.

    next: the text after this one in the order of (doc_id, text), null ids
    first; the first after the last. Rows go to ranges of doc_id, whose bounds
    are ids that occur; the row at a bound also goes to the range before,
    where it only serves as the next text. So the texts are shuffled once, and
    every range has a row. ``place`` counts from 1 in its bucket.
    """
    n = max(64, math.isqrt(2 * rows))
    spread = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(100 * n)).alias("cuts"), F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    low, nulls = spread["low"], spread["nulls"]
    cuts = sorted({c for c in spread["cuts"] or () if c != low} | ({low} if nulls and low is not None else set()))
    bucket = bucket_of(F.coalesce(F.col("doc_id"), F.lit(-(2**63))), cuts)
    at_cut = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(low)
    place = lambda b, kind: F.struct(b.cast("int").alias("bucket"), F.lit(kind).alias("serves"))
    targets = F.filter(F.array(place(bucket, 0), place(F.when(at_cut, bucket - 1), 1), place(F.when(is_first, F.lit(len(cuts))), 2)), lambda t: t["bucket"].isNotNull())
    dealt = docs.withColumn("t", F.explode(targets)).select("doc_id", "text", "t.bucket", "t.serves")
    dealt = dealt.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, spread["bytes"] // TASK_BYTES), "bucket")  # as many tasks as the texts need, not a set number
    order = Window.partitionBy("bucket").orderBy("serves", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("next", F.lead("text").over(order)).withColumn("place", F.row_number().over(order)).where("serves = 0").drop("serves")


def bucket_of(value: Column, cuts: list[int]) -> Column:
    """Number of ``cuts`` (sorted) that are not above ``value``, by two short searches."""
    if not cuts:
        return F.lit(0)
    step = math.ceil(math.sqrt(len(cuts)))
    array = lambda x: F.array(*[F.lit(c).cast("long") for c in x])
    below = lambda cs: F.size(F.filter(cs, lambda c: c <= value))
    coarse = below(array(cuts[step - 1 :: step])) * step
    return coarse + below(F.slice(array(cuts), coarse + 1, step))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n/4) characters replaced by the first as many of ``following``."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def imatch(docs: DataFrame, terms: int = 40, rarest: int = 2, commonest: float = 0.05) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The band: terms in at least ``rarest`` texts and at most the share
    ``commonest`` of all. A text none of whose terms of its own level is in the
    band uses all of them; a text without words has the empty fingerprint,
    which is like itself (1) and unlike any other (0). Null texts count as
    empty. Ties of doc_id go by text, null ids come first; repeated rows follow
    each other; other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.count()
    pairs = with_next(docs, total)
    own, made = term_hashes(F.col("text")), term_hashes(F.col("edited"))
    read = pairs.withColumn("edited", edited(F.col("text"), F.col("next"))).select("doc_id", "bucket", "place", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), own.alias("own"), made.alias("made"))
    read = read.withColumn("own_level", level_of(F.size("own"), terms)).withColumn("made_level", level_of(F.size("made"), terms))
    read = read.withColumn("own", thinned(F.col("own"), F.col("own_level"))).withColumn("made", thinned(F.col("made"), F.col("made_level")))
    read = materialize(read.withColumn("row", F.monotonically_increasing_id()), "imatch-terms")

    counts = docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= rarest)
    counts = materialize(counts, "imatch-frequencies")
    top = max(rarest, commonest * total)
    common = F.broadcast(counts.where(F.col("df") > F.lit(top)).select("term", F.lit(True).alias("common")))
    lexicon = counts.where(F.col("df") <= F.lit(top)).select("term")

    sides = read.select("row", F.explode(F.array_union("own", "made")).alias("term"))
    lookup = sides.join(common, "term", "left").where("common is null").select("row", "term")
    within = lookup.join(lexicon, "term").groupBy("row").agg(F.collect_list("term").alias("banded"))
    joined = read.join(within, "row", "left").withColumn("banded", F.coalesce("banded", F.array().cast("array<long>")))

    def banded(side: str) -> Column:
        kept = F.array_sort(F.array_intersect(side, "banded"))
        return F.when(F.size(kept) > 0, kept).otherwise(F.array_sort(F.col(side)))

    kept = joined.select("doc_id", "n_chars", "edited_sha256", "bucket", "place", "own_level", "made_level", banded("own").alias("own"), banded("made").alias("made"))
    prints = kept.select("doc_id", "n_chars", "edited_sha256", "bucket", "place", F.struct(F.col("own_level").alias("level"), signatures(F.col("own"), F.col("own_level")).alias("marks")).alias("own"), F.struct(F.col("made_level").alias("level"), signatures(F.col("made"), F.col("made_level")).alias("marks")).alias("made"))
    after = next_print(materialize(prints, "imatch-prints"))
    return after.select("doc_id", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("made")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("made")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


def printed(fingerprint: Column) -> Column:
    """Level and marks as text; 0 for a text without words."""
    marks = F.array_join(F.transform(fingerprint["marks"], lambda m: F.lower(F.hex(m))), ",")
    return F.when(F.size(fingerprint["marks"]) == 0, F.lit("0")).otherwise(F.concat_ws(":", fingerprint["level"].cast("string"), marks))


def next_print(named: DataFrame) -> DataFrame:
    """Adds ``next``, the fingerprint after this one by (bucket, place); the rows are narrow now."""
    last = named.agg(F.max("bucket")).first()[0] or 0
    row = F.struct(*named.columns)
    before = F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1)
    twice = F.when(F.col("place") == 1, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("serves")), F.struct(before.alias("b"), F.lit(1).alias("serves")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("serves"))))
    dealt = named.select(row.alias("r"), F.explode(twice).alias("t")).select("r.*", "t.b", "t.serves")
    order = Window.partitionBy("b").orderBy("serves", "place")
    return dealt.withColumn("next", F.lead("own").over(order)).where("serves = 0")


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets with equal hashes, of those that either has terms in, on the levels that both have; 0 to 1."""
    lowest = F.greatest(a["level"], b["level"]).cast("long") * (ALL * 2**KEPT)
    both = lambda x: F.filter(x["marks"], lambda m: m >= lowest)
    places = lambda x: F.transform(both(x), lambda m: F.shiftright(m, KEPT))
    equal, either = F.size(F.array_intersect(both(a), both(b))), F.size(F.array_union(places(a), places(b)))
    return F.when((F.size(a["marks"]) == 0) & (F.size(b["marks"]) == 0), F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(equal / either)


def op3_imatch_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch(table(spark, sf_dir, "documents"))
