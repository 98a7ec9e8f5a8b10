"""URL filter: host and path rules, then a character language-model ratio.

Two smoothed Markov models of variable order, one of accepted and one of
rejected URLs, give each URL the mean over its characters and its end of
log p(char | context, accepted) - log p(char | context, rejected). The context
of a character is the longest one, of ORDER characters at most, that training
has often enough. In each model

    p(char | context) = (n(context, char) + s * p(char | shorter context)) / (n(context) + s)

down to a uniform choice, so characters that a model never saw in a context,
or at all, have the probability that the model gives them. A threshold,
calibrated on URLs that rules decide and that did not train, turns the score
into a verdict.

Everything is DataFrame expressions. Characters are folded to SYMBOLS classes
(letters, one digit class, punctuation, the rest). A context has to hold a
share of 1 / CONTEXTS of all training characters, so there are CONTEXTS of each
length at most, and the table that scoring broadcasts has at most
ORDER * CONTEXTS * SYMBOLS rows, whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: Folded characters; position is the code. Codes 0 and 1: start or end, any other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.:-_?=&#%+~"
SYMBOLS = len(ALPHABET) + 2
#: Characters of the longest context, and contexts of one length at most.
ORDER, CONTEXTS = 3, 5_000
#: Occurrences that a context needs in any case, and steps of the score's unit that calibration tells apart.
LEAST, STEPS = 4, 1_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def grams(url: Column) -> Column:
    """Array of codes of ORDER + 1 folded characters in a row, one for each character and the end.

    A code is a number of base SYMBOLS: its last digit is the character, the
    digits before are its context.
    """
    folded = F.regexp_replace(F.regexp_replace(ascii_lower(F.coalesce(url, F.lit(""))), "[0-9]", "0"), "[^a-z0/.:\\-_?=&#%+~]", "!")
    codes = F.concat(F.array(*[F.lit(0)] * ORDER), F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.when(c == "!", F.lit(1)).otherwise(F.instr(F.lit(ALPHABET), c) + 1)), F.array(F.lit(0)))
    made = F.slice(codes, F.lit(1), F.size(codes) - ORDER)
    for k in range(1, ORDER + 1):
        made = F.zip_with(made, F.slice(codes, F.lit(1 + k), F.size(codes) - ORDER), lambda x, y: x * SYMBOLS + y)
    return made


def train_ratio(labelled: DataFrame, strength: float = 2.0) -> dict[int, DataFrame]:
    """By length of the context: (gram, ratio) for every character after every context of that length that counts.

    ``labelled(grams, accepted)`` are the training URLs.
    """
    counts = materialize(labelled.select("accepted", F.explode("grams").alias("g")).groupBy("g").agg(F.sum(F.col("accepted").cast("long")).alias("ca"), F.sum((~F.col("accepted")).cast("long")).alias("cr")), "url-counts")
    total = counts.agg(F.sum("ca").alias("na"), F.sum("cr").alias("nr")).first()
    na, nr = total["na"] or 0, total["nr"] or 0
    least = max(LEAST, (na + nr) / CONTEXTS)
    below = counts.sparkSession.range(SYMBOLS).select(F.col("id").alias("gram"), F.lit(1.0 / SYMBOLS).alias("pa"), F.lit(1.0 / SYMBOLS).alias("pr"))
    tables = {}
    for k in range(ORDER + 1):
        seen = counts.groupBy((F.col("g") % SYMBOLS ** (k + 1)).cast("long").alias("gram")).agg(F.sum("ca").alias("ca"), F.sum("cr").alias("cr"))
        context = F.floor(F.col("gram") / SYMBOLS).alias("context")
        if k:
            kept = seen.groupBy(context).agg(F.sum("ca").alias("na"), F.sum("cr").alias("nr")).where(F.col("na") + F.col("nr") >= F.lit(least))
        else:
            kept = counts.sparkSession.range(1).select(F.col("id").alias("context"), F.lit(na).alias("na"), F.lit(nr).alias("nr"))
        every = kept.select("na", "nr", F.explode(F.sequence(F.col("context") * SYMBOLS, F.col("context") * SYMBOLS + SYMBOLS - 1)).alias("gram"))
        shorter = below.select((F.col("gram")).alias("suffix"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        met = every.join(seen, "gram", "left").withColumn("suffix", F.col("gram") % SYMBOLS ** max(k, 1)).join(F.broadcast(shorter), "suffix")
        p = lambda c, n, q: (F.coalesce(c, F.lit(0)) + F.lit(strength) * F.col(q)) / (F.col(n) + F.lit(strength))
        below = materialize(met.select("gram", p("ca", "na", "qa").alias("pa"), p("cr", "nr", "qr").alias("pr")), "url-model")
        tables[k] = below.select(F.col("gram").cast("int").alias("gram"), F.log(F.col("pa") / F.col("pr")).alias("ratio"))
    return tables


def url_scores(urls: DataFrame, model: dict[int, DataFrame]) -> DataFrame:
    """``urls(row, grams)`` -> (row, score): mean ratio over the characters and the end.

    The model meets each character by a hash join; its size is bounded by
    CONTEXTS, and so it is broadcast. Sums are made per row before the shuffle.
    """
    chars = urls.select("row", F.explode("grams").alias("g"))
    for k, part in model.items():
        renamed = part.select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"r{k}"))
        chars = chars.withColumn(f"c{k}", (F.col("g") % SYMBOLS ** (k + 1)).cast("int")).join(F.broadcast(renamed), F.col(f"c{k}") == F.col(f"g{k}"), "left")
    return chars.groupBy("row").agg(F.avg(F.coalesce(*[f"r{k}" for k in sorted(model, reverse=True)])).alias("score"))


def threshold_of(bins: Sequence[tuple[int, int, int]]) -> tuple[float, float]:
    """(threshold, its error rate) from sorted (bin, accepted, rejected) of calibration URLs.

    The cut between two bins that makes the larger of two shares least: of
    accepted URLs below it, of rejected ones from it on; the lowest such cut.
    Without URLs of both kinds: 0, where both models are equally likely.
    """
    accepted, rejected = sum(a for _, a, _ in bins), sum(r for _, _, r in bins)
    if not accepted or not rejected:
        return 0.0, float("nan")
    found, lost, kept, before = [], 0, rejected, bins[0][0] - 1
    for at, a, r in [*bins, (bins[-1][0] + 1, 0, 0)]:
        found.append((max(lost / accepted, kept / rejected), (before + at) / 2 + 0.5))
        lost, kept, before = lost + a, kept - r, at
    error, cut = min(found)
    return cut / STEPS, error


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, strength: float = 2.0) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides).

    URLs that rules allow or block are the accepted and rejected ones: those of
    three in sixteen hosts, by a hash of the host, calibrate the threshold, the
    others train the models. Without training URLs of both kinds every other
    URL is allowed. A null URL has empty host and path and is judged by the
    models as an empty string; an empty URL is its end alone. Repeated rows are
    judged alike; other columns are ignored. An empty table gives no rows.
    """
    narrow = pages.select("page_id", "url").select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), grams(F.col("url")).alias("grams"))
    rows = materialize(narrow.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("row", F.monotonically_increasing_id()), "urls")
    ruled = rows.where("hit is not null").withColumn("accepted", F.col("hit.verdict") == "allow")
    calibrates = F.substring(F.md5("host"), 1, 1).isin("0", "1", "2")
    trains = ruled.where(~calibrates)
    fitted = len(trains.select("accepted").distinct().collect()) == 2
    model = train_ratio(trains.select("grams", "accepted"), strength) if fitted else {}
    by_model, scored = F.lit("allow"), rows.where("hit is null").select("row", F.lit(None).cast("double").alias("score"))
    if fitted:
        measured = url_scores(ruled.where(calibrates).select("row", "grams"), model).join(ruled.select("row", "accepted"), "row")
        bins = measured.groupBy(F.floor(F.col("score") * STEPS).alias("bin")).agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r")).collect()
        threshold, _ = threshold_of(sorted((r["bin"], r["a"], r["r"]) for r in bins))
        scored = url_scores(rows.where("hit is null").select("row", "grams"), model)
        by_model = F.when(F.col("score") < F.lit(threshold), "block").otherwise("allow")
    return rows.join(scored, "row", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), by_model).alias("verdict"), "score")


def op8_url_lm_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("score")


_POWERS = {k: SYMBOLS**k for k in range(ORDER + 2)}
_LEVELS = "".join(f"""
s{k} AS (SELECT g % {_POWERS[k + 1]} AS gram, sum(ca) AS ca, sum(cr) AS cr FROM counts GROUP BY 1),
x{k} AS (SELECT gram // {SYMBOLS} AS context, sum(ca) AS na, sum(cr) AS nr FROM s{k} GROUP BY 1 HAVING {k} = 0 OR sum(ca) + sum(cr) >= (SELECT greatest({LEAST}, (sum(ca) + sum(cr)) / {CONTEXTS}.0) FROM counts)),
e{k} AS (SELECT na, nr, context * {SYMBOLS} + unnest(range({SYMBOLS})) AS gram FROM {f"x{k}" if k else "(SELECT 0 AS context, sum(ca) AS na, sum(cr) AS nr FROM counts)"}),
p{k} AS (SELECT e.gram, (coalesce(ca, 0) + 2.0 * {"b.pa" if k else f"(1.0 / {SYMBOLS})"}) / (na + 2.0) AS pa, (coalesce(cr, 0) + 2.0 * {"b.pr" if k else f"(1.0 / {SYMBOLS})"}) / (nr + 2.0) AS pr FROM e{k} AS e LEFT JOIN s{k} AS s ON s.gram = e.gram {f"JOIN p{k - 1} AS b ON b.gram = e.gram % {_POWERS[k]}" if k else ""}),""" for k in range(ORDER + 1))  # fmt: skip
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_LONGEST = sorted(RULES, key=lambda r: -len(r.name))

#: The same in DuckDB's SQL.
ORACLE = f"""
WITH u AS MATERIALIZED (SELECT row_number() OVER () AS id, page_id, coalesce(url, '') AS url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {" ".join(f"WHEN {_FITS.format(r.host, r.path)} THEN '{r.name}'" for r in _LONGEST)} END AS rule, CASE {" ".join(f"WHEN {_FITS.format(r.host, r.path)} THEN '{r.verdict}'" for r in _LONGEST)} END AS ruled,
  substr(md5(host), 1, 1) IN ('0', '1', '2') AS calibrates,
  list_concat({[0] * ORDER}, list_transform(string_split(regexp_replace(regexp_replace(translate(url, '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}'), '[0-9]', '0', 'g'), '[^a-z0/.:\\-_?=&#%+~]', '!', 'g'), ''), lambda c: CASE WHEN c = '' THEN -1 WHEN c = '!' THEN 1 ELSE instr('{ALPHABET}', c) + 1 END), [0]) AS given FROM u),
q AS (SELECT * EXCLUDE (given), list_filter(given, lambda x: x >= 0) AS c FROM r),
places AS (SELECT id, rule, ruled, calibrates, c, unnest(range(1, len(c) - {ORDER - 1})) AS i FROM q),
chars AS MATERIALIZED (SELECT id, rule, ruled, calibrates, {" + ".join(f"CAST(c[i + {j}] AS BIGINT) * {_POWERS[ORDER - j]}" for j in range(ORDER + 1))} AS g FROM places),
counts AS MATERIALIZED (SELECT g, count(*) FILTER (ruled = 'allow') AS ca, count(*) FILTER (ruled = 'block') AS cr FROM chars WHERE ruled IS NOT NULL AND NOT calibrates GROUP BY g),{_LEVELS}
scores AS MATERIALIZED (SELECT id, any_value(ruled) AS ruled, any_value(calibrates) AS calibrates, avg(coalesce({", ".join(f"ln(p{k}.pa / p{k}.pr)" for k in range(ORDER, -1, -1))})) AS score
  FROM chars {" ".join(f"LEFT JOIN p{k} ON p{k}.gram = g % {_POWERS[k + 1]}" for k in range(ORDER + 1))} GROUP BY id),
bins AS (SELECT CAST(floor(score * {STEPS}) AS BIGINT) AS bin, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS r FROM scores WHERE ruled IS NOT NULL AND calibrates GROUP BY 1),
ends AS (SELECT * FROM bins UNION ALL SELECT max(bin) + 1, 0, 0 FROM bins HAVING count(*) > 0),
cuts AS (SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin), bin - 1) AS before, coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost, sum(r) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kept, sum(a) OVER () AS na, sum(r) OVER () AS nr FROM ends),
threshold AS (SELECT coalesce((SELECT ((before + bin) / 2.0 + 0.5) / {STEPS}.0 FROM cuts WHERE na > 0 AND nr > 0 ORDER BY greatest(lost / na, kept / nr), bin LIMIT 1), 0) AS t, (SELECT sum(ca) > 0 AND sum(cr) > 0 FROM counts) AS fitted)
SELECT page_id, host, path, rule, coalesce(q.ruled, CASE WHEN (SELECT fitted FROM threshold) AND score < (SELECT t FROM threshold) THEN 'block' ELSE 'allow' END) AS verdict FROM q LEFT JOIN scores USING (id)"""
