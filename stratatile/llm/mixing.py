"""Mixing sources to target weights by weighted fair queueing.

Every document, in a shuffled order that only its id and text length decide,
gets the virtual time at which its source would have sent it: the words of
the source up to and with this document, divided by the source's target. All
sources therefore reach their targets at time 1 whatever their sizes. A source
whose target is above its size queues its documents again, up to the stated
number of passes. The queue is cut in the order of virtual time where the
total budget is used up.

Plan: one narrow table (source, id, size) is written; the sources and their
targets are a table too, as there may be very many. Running sums come from two
levels, sums per (source, slice of the shuffle) and sums within a slice, so a
source with a third of all rows is spread over as many slices as others need
tasks; the global order is found by counting words per interval of virtual
time, narrowing the interval that holds the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, discard, materialize, table

#: Intervals of virtual time that one counting pass tells apart.
INTERVALS = 4096
#: Entries in the last interval that are sorted to find the cut.
LAST = 50_000
#: Documents in a slice of a source's shuffle, about; sources in a range of their order; sources that are broadcast, at most.
SLICE_ROWS, RANGE_ROWS, BROADCAST_ROWS = 20_000, 100_000, 10_000


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), budget_share: float = 1.5, max_passes: int = 2) -> DataFrame:
    """``sizes(source, n, rows)`` with rank, weight and target: shares of the budget, held at ``max_passes`` sizes.

    Sources go by code point, null last; ``weights`` repeat. What a source
    cannot take is shared again among the rest by weight until none is above.
    One aggregate over the sources for each time that it is shared.
    """
    tasks = 1 + sizes.count() // RANGE_ROWS
    ranged = materialize(sizes.repartitionByRange(tasks, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    starts, before = {}, 0
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():  # one row for each range
        starts[r["_part"]] = before
        before += r["count"]
    first = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_part")), F.lit(0)) if starts else F.lit(0)
    rank = (first + inside - 1).cast("long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranged.withColumn("rank", rank).drop("_part").withColumn("weight", weight), "ranked")
    discard(ranged)

    most = F.col("n") * F.lit(float(max_passes))
    left = budget_share * (ranked.agg(F.sum("n")).first()[0] or 0)
    total = ranked.agg(F.sum("weight")).first()[0] or 0.0
    level, held = (left / total if total else 0.0), 0
    while True:  # a source that a share overfills stays full, as what is left for the rest only grows by weight
        full = F.col("weight") * F.lit(level) > most
        r = ranked.agg(F.sum(F.when(full, most)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("free"), F.sum(full.cast("long")).alias("n")).first()
        if (r["n"] or 0) <= held or not r["free"]:
            break
        held, level = r["n"], (left - r["taken"]) / r["free"]
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), most))


def fair_queue(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget_share: float = 1.5, max_passes: int = 2, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    taken: words of the document in the mix, 0 to ``max_passes`` times its
    size. Documents are taken whole; the one on which the budget ends is taken
    too if more than half of it fits. Null and empty texts have size 0 and are
    never taken; a null source is a source of its own; repeated rows queue one
    by one. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")).withColumn("row", F.monotonically_increasing_id())
    return _queue(rows, weights, budget_share, max_passes, seed).drop("row")


def _queue(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), budget_share: float = 1.5, max_passes: int = 2, seed: int = 17) -> DataFrame:
    """fair_queue of ``rows(doc_id, source, size, mark, row)``, with row; the order of the rows says nothing, but for equal ones."""
    queued = materialize(rows.withColumn("u", F.xxhash64("doc_id", "size", "mark", F.lit(seed))), "queue")
    sums = queued.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    shares = materialize(source_targets(sums, weights, budget_share, max_passes), "shares")
    seen = shares.agg(F.max("rows").alias("rows"), F.sum("n").alias("words"), F.count("*").alias("sources")).first()
    slices = max(64, (seen["rows"] or 0) // SLICE_ROWS)
    few = F.broadcast if seen["sources"] <= BROADCAST_ROWS else (lambda x: x)
    kinds = few(shares.select("rank", F.col("source").alias("source_of"), F.col("n").alias("source_size"), "target"))
    queued = queued.join(kinds, F.col("source").eqNullSafe(F.col("source_of"))).drop("source_of").withColumn("slice", F.pmod(F.shiftright("u", 20), F.lit(slices)))

    # words of the source before each slice: a table of sources x slices
    before = queued.groupBy("rank", "slice").agg(F.sum("size").alias("words")).select("rank", "slice", (F.sum("words").over(Window.partitionBy("rank").orderBy("slice")) - F.col("words")).alias("before"))
    within = Window.partitionBy("rank", "slice").orderBy("u", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = queued.withColumn("within", F.sum("size").over(within)).join(before, ["rank", "slice"]).withColumn("upto", F.col("before") + F.col("within")).drop("before", "within", "slice")
    timed = materialize(timed, "timed")

    entries = timed.where("size > 0 and target > 0").select("rank", "row", "u", "size", "upto", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))).alias("pass")).withColumn("time", finish("pass"))
    cut = find_cut(entries, budget_share * (seen["words"] or 0))
    taken = sum((F.when(_not_after(finish(F.lit(k)), cut), F.col("size")).otherwise(F.lit(0)) for k in range(max_passes)), F.lit(0))
    return timed.select("row", "doc_id", "source", "size", "source_size", "target", F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0)).cast("long").alias("taken"))


def finish(which) -> Column:
    """Virtual finish time of a document in the given pass over its source."""
    turn = F.col(which) if isinstance(which, str) else which
    return (turn * F.col("source_size") + F.col("upto")) / F.col("target")


def _not_after(time: Column, cut: tuple | None) -> Column:
    if cut is None:
        return F.lit(False)
    t, rank, row = cut
    return (time < F.lit(t)) | ((time == F.lit(t)) & ((F.col("rank") < rank) | ((F.col("rank") == rank) & (F.col("row") <= row))))


def find_cut(entries: DataFrame, budget: float) -> tuple | None:
    """(time, rank, row) of the last entry in the mix; ties in time go by source, then row.

    Each pass counts words in equal intervals of time (a partial aggregate, at
    most INTERVALS rows) and goes on with the one interval in which the budget
    ends, until that holds few entries, or one moment: a source has one entry
    at a moment at most. Those are sorted and read one by one up to the cut.
    """
    low, high, spent, start = 0.0, None, 0, entries
    last = entries.agg(F.max("time").alias("t"), F.count("*").alias("n")).first()
    if not last["n"]:
        return None
    high, n = last["t"], last["n"]
    while n > LAST and high > low:
        width = (high - low) / INTERVALS
        if low + width <= low:
            break
        place = F.least(F.floor((F.col("time") - F.lit(low)) / F.lit(width)), F.lit(INTERVALS - 1)).cast("int")
        counts = {r["i"]: (r["w"], r["n"], r["a"], r["b"]) for r in start.groupBy(place.alias("i")).agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("time").alias("a"), F.max("time").alias("b")).collect()}
        for i in sorted(counts):
            w, n, a, b = counts[i]
            if spent + w > budget or i == max(counts):
                break
            spent += w
        low, high, start = a, b, start.where((F.col("time") >= F.lit(a)) & (F.col("time") <= F.lit(b)))
    found = None
    for r in start.orderBy("time", "rank", "row").select("time", "rank", "row", "size").toLocalIterator():
        if spent + r["size"] > budget:
            if found is None or budget - spent > r["size"] / 2:
                found = (r["time"], r["rank"], r["row"])
            return found
        spent += r["size"]
        found = (r["time"], r["rank"], r["row"])
    return found


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``.

    Each row comes as often as the queue took that row, whatever its doc_id.
    """
    names = docs.columns
    quoted = lambda c: docs["`" + c.replace("`", "``") + "`"]
    # row numbers are only the same in both uses once they are written
    rows = materialize(docs.select(F.struct(*[quoted(c) for c in names]).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "rows")
    narrow = rows.select(F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.source").alias("source"), word_count(F.col("_doc.text")).alias("size"), F.xxhash64("_doc.text").alias("mark"), F.col("_row").alias("row"))
    times = _queue(narrow, **how).where("taken > 0").select(F.col("row").alias("_row"), F.expr("cast(taken div size as int)").alias("_times"))
    joined = rows.join(times.hint("merge"), "_row")
    return joined.select("_doc", F.explode(F.expr("sequence(1, _times)")).alias("_k")).select(*[F.col("_doc").getField(c).alias(c) for c in names])


def op10_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fair_queue(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken")
