import hashlib
import random
import re
from collections import Counter
from math import floor, isclose, log

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from stratatile.llm import urlfilter

URLS = [None, "", "no scheme", "http://net", "http://NET/", "http://a.Example.NET/en/x?y#z", "https://example.net/en", "https://example.net/de/1", "http://xexample.net/en/", "ftp://example.com/de/", "http://www.example.com/de/a", "http://example.com/d", "http://a.org/fr/b", "http://org?x=/fr/", "http://org#/fr/", "//x://y/z", "http:///path", "http://é.org/fr/ü?ñ", "http://a.org\n/fr/", "http://" + "a" * 5000 + ".net/" + "b" * 5000]


def plain(url):
    m = re.search(r"://", url or "")
    if not m:
        return "", ""
    rest = url[m.end() :]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def verdict(host, path):
    found = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(found, key=lambda r: len(r.name), default=None)


def test_hosts_paths_rules(spark):
    rows = [(i, u, "score", True) for i, u in enumerate(URLS)] + [(0, None, "", None), (None, URLS[5], "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string, hit boolean")
    got = urlfilter.judge_urls(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is None:
            continue
        host, path = plain(URLS[r["page_id"]])
        rule = verdict(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.name if rule else None)
        assert r["verdict"] == (rule.verdict if rule else r["verdict"]) and r["verdict"] in ("allow", "block")


def test_model_tells_kinds_apart(spark):
    good = [f"http://a{i}.org/fr/garden/{i}" for i in range(40)]
    bad = [f"http://b{i}.net/casino-win/{i}" for i in range(40)]
    asked = [f"http://c{i}.com/garden/{i}" for i in range(20)] + [f"http://d{i}.com/casino-win/{i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(good + bad + asked)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(df).collect()}
    assert [got[80 + i] for i in range(40)] == ["allow"] * 20 + ["block"] * 20


def test_one_kind_or_none(spark):
    for urls in ([], ["http://a.com/"], ["http://a.com/", "http://a.net/"]):
        df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        assert [r["verdict"] for r in urlfilter.judge_urls(df).orderBy("page_id").collect()] == ["allow", "block"][: len(urls)]


def fold(url):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    return [0] * urlfilter.ORDER + [1 if c not in urlfilter.ALPHABET and not c.isascii() or c not in urlfilter.ALPHABET and not c.isdigit() else urlfilter.ALPHABET.index("0" if c.isdigit() else c) + 2 for c in low] + [0]


def plain_ratio(trained, least, s=2.0):
    """Mean log ratio of a URL by two models written out: the longest context that counts, smoothed down to a uniform choice."""
    seen = {k: (Counter(), Counter()) for k in (True, False)}
    for url, kind in trained:
        c = fold(url)
        for i in range(urlfilter.ORDER, len(c)):
            for k in range(urlfilter.ORDER + 1):
                seen[kind][0][tuple(c[i - k : i])] += 1
                seen[kind][1][tuple(c[i - k : i + 1])] += 1

    def p(kind, context, z):
        below = p(kind, context[1:], z) if context else 1 / urlfilter.SYMBOLS
        return (seen[kind][1][(*context, z)] + s * below) / (seen[kind][0][context] + s)

    def score(url):
        c, got = fold(url), []
        for i in range(urlfilter.ORDER, len(c)):
            k = max(k for k in range(urlfilter.ORDER + 1) if k == 0 or seen[True][0][tuple(c[i - k : i])] + seen[False][0][tuple(c[i - k : i])] >= least)
            context = tuple(c[i - k : i])
            got.append(log(p(True, context, c[i]) / p(False, context, c[i])))
        return sum(got) / len(got)

    return score


def test_scores_and_verdicts_against_plain_models(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    urls = [f"http://{word('abc')}.org/fr/{word('abcd')}" for _ in range(60)] + [f"http://{word('xyb')}.net/{word('wxyz')}/{i}" for i in range(60)]
    urls += [f"http://{word('abx')}.com/{word('abcdwxyz')}" for _ in range(30)] + ["q", "Q#%~", "\u00e9\U0001d4b3", "", None, "!!", "http://new/~~~"]
    got = {r["page_id"]: r for r in urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)).collect()}
    held = lambda u: hashlib.md5(plain(u)[0].encode()).hexdigest()[0] in "012"
    ruled = {u: r.verdict == "allow" for u in urls if (r := verdict(*plain(u)))}
    trained = [(u, k) for u, k in ruled.items() if not held(u)]
    assert 0 < len(trained) < len(ruled)
    score = plain_ratio(trained, max(urlfilter.LEAST, sum(len(u) + 1 for u, _ in trained) / urlfilter.CONTEXTS))
    bins = Counter((floor(score(u) * urlfilter.STEPS), k) for u, k in ruled.items() if held(u))
    places = sorted({b for b, _ in bins})
    threshold, error = urlfilter.threshold_of([(b, bins[b, True], bins[b, False]) for b in places])
    assert error <= 0.2
    for i, u in enumerate(urls):
        if u in ruled:
            assert got[i]["score"] is None
        else:
            assert isclose(got[i]["score"], score(u), rel_tol=1e-9) and got[i]["verdict"] == ("block" if score(u) < threshold else "allow")


def test_a_character_that_one_kind_lacks_speaks_for_neither_but_by_its_probability(spark):
    df = spark.createDataFrame([("ab", True)] * 50 + [("b", False)], "url string, accepted boolean").select("accepted", urlfilter.grams(F.col("url")).alias("grams"))
    model = urlfilter.train_ratio(df)
    asked = spark.createDataFrame([(0, "q")], "row long, url string").select("row", urlfilter.grams(F.col("url")).alias("grams"))
    want = plain_ratio([("ab", True)] * 50 + [("b", False)], urlfilter.LEAST)("q")
    assert isclose(urlfilter.url_scores(asked, model).first()["score"], want, rel_tol=1e-9) and want < -1


def test_threshold_makes_the_larger_error_least():
    assert urlfilter.threshold_of([])[0] == 0 and urlfilter.threshold_of([(3, 5, 0)])[0] == 0
    assert urlfilter.threshold_of([(-10, 0, 5), (10, 5, 0)]) == (0.0005, 0.0)
    cut, error = urlfilter.threshold_of([(0, 1, 8), (10, 0, 2), (20, 9, 0)])
    assert (cut, error) == (0.0155, 0.1)
    bins = [(b, random.Random(b).randint(0, 3), random.Random(-b).randint(0, 3)) for b in range(1, 30, 2)]
    a, r = sum(x for _, x, _ in bins), sum(x for _, _, x in bins)
    errors = [max(sum(x for b, x, _ in bins if b < t) / a, sum(x for b, _, x in bins if b >= t) / r) for t in range(32)]
    assert urlfilter.threshold_of(bins)[1] == min(errors)


def test_sql_on_odd_urls(spark):
    urls = [*URLS, *(f"http://h{i}.org/fr/a{i}" for i in range(40)), *(f"http://h{i}.net/b{i}" for i in range(40)), *(f"http://h{i}.com/b{i}" for i in range(9))]
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls})
    con = duckdb.connect()
    con.register("pages", pages)
    want = {r[0]: r[1:] for r in con.sql(urlfilter.ORACLE).fetchall()}
    got = urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).select("page_id", "host", "path", "rule", "verdict").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want
