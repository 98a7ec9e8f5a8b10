import random

import pytest
from pyspark.sql import functions as F

import archives
from stratatile.functions import names, tileid
from stratatile.operators import entries, features, layout, runs
from stratatile.operators.ordered import prefix_sum
from stratatile.sources.reader import read_entries, spans


def greedy(lengths, n):
    """Shares one blob at a time: a new one begins at the first blob that is past its threshold."""
    total, seen, share, out = sum(lengths), 0, 0, []
    for i, length in enumerate(lengths):
        if i and share < n - 1 and seen * n >= (share + 1) * total and seen:
            share += 1
        out.append(share)
        seen += length
    return out


def test_share_cut_equals_the_greedy_rule(spark):
    rng = random.Random(3)
    for n, lengths in [(4, [100, 1, 1, 1]), (3, [0, 0, 5, 0, 5, 5]), (2, [7])] + [(rng.randint(1, 6), [rng.choice([0, 1, 3, 50, 400]) for _ in range(rng.randint(1, 30))]) for _ in range(6)]:
        if not sum(lengths):
            continue
        blobs = spark.createDataFrame([(i * 10, v) for i, v in enumerate(lengths)], "offset long, length long")
        for width in (15, 1 << 20):
            got = [r["share"] for r in entries.share_cut(blobs, n, width).orderBy("offset").collect()]
            assert got == greedy(lengths, n), (n, lengths, width)


def test_tile_ids_and_back(spark):
    cells = [(z, x, y) for z in range(5) for x in range(1 << z) for y in range(1 << z)] + [(30, 2**30 - 1, 12345), (30, 5, 2**30 - 1)]
    df = spark.createDataFrame(cells, "z int, x long, y long")
    rows = df.withColumn("id", tileid.tile_id(F.col("z"), F.col("x"), F.col("y"))).withColumn("back", tileid.tile_zxy(F.col("id"))).withColumn("zoom", tileid.zoom_of(F.col("id"))).collect()
    for r in rows:
        assert r["id"] == archives.zxy_to_id(r["z"], r["x"], r["y"])
        assert tuple(r["back"]) == (r["z"], r["x"], r["y"]) == tileid.zxy_of(r["id"]) and r["zoom"] == r["z"]
    assert sorted(r["id"] for r in rows)[:341] == list(range(341))
    one = spark.range(1).select(tileid.describe(F.lit(20).cast("long"), F.lit(3)).alias("d")).first()["d"]
    assert one == tileid.describe_one(20, 3)


@pytest.mark.parametrize("width", [1, 3, 7, 1 << 20])
def test_runs_equal_a_plain_pass(spark, width):
    """Merging and the overlap check against one pass over the sorted runs, with islands over many buckets and gaps."""
    rng = random.Random(width)
    rows, expected, overlapping = [], [], {}
    for profile in "abc":
        at, merged = 0, []
        for _ in range(60):
            at += rng.choice([0, 0, 0, 0, 1, 9])
            run = (profile, at, rng.randint(1, 4), rng.choice(["x", "x", "x", "y", None]))
            rows.append(run)
            if merged and merged[-1][1] + merged[-1][2] == at and merged[-1][3] == run[3]:
                merged[-1] = (profile, merged[-1][1], merged[-1][2] + run[2], run[3])
            else:
                merged.append(run)
            at += run[2]
        expected += merged
    order = lambda r: r[:2]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "profile string, tile_id long, run_length long, digest string")
    assert sorted(map(tuple, runs.merge_runs(df, width=width).collect()), key=order) == sorted(expected, key=order)
    longer = [(p, t, n + (rng.random() < 0.2), d) for p, t, n, d in rows]
    for profile in "abc":
        mine = sorted(r[1:3] for r in longer if r[0] == profile)
        over = [b for (a, n), (b, _) in zip(mine, mine[1:]) if b < a + n]
        overlapping[profile] = (len(over), min(over, default=None))
    got = runs.overlaps(spark.createDataFrame(longer, df.schema), width=width).collect()
    assert {r["profile"]: (r["overlapping"], r["first_overlap"]) for r in got} == overlapping


def test_same_offset_with_alternating_lengths_is_two_blobs(spark):
    df = spark.createDataFrame([(0, 0, 5, 1), (1, 0, 6, 1), (2, 0, 5, 1)], "tile_id long, offset long, length long, run_length long")
    assert tuple(entries.blob_stats(df).first()) == (2, 11)
    assert tuple(entries.blob_stats(df.where("tile_id > 9")).first()) == (0, 0)


@pytest.mark.parametrize("width", [4, 1 << 20])
def test_runs_across_buckets(spark, width):
    rows = [("a", 0, 3, "x"), ("a", 3, 4, "x"), ("a", 7, 1, "y"), ("a", 9, 1, "y"), ("a", 10, 30, "y"), ("a", 40, 1, None), ("a", 41, 1, None), ("b", 0, 10, "x"), ("b", 5, 1, "x")]
    df = spark.createDataFrame(rows, "profile string, tile_id long, run_length long, digest string")
    got = sorted(map(tuple, runs.merge_runs(df.where("profile = 'a'"), width=width).collect()))
    assert got == [("a", 0, 7, "x"), ("a", 7, 1, "y"), ("a", 9, 31, "y"), ("a", 40, 2, None)]
    assert sorted(map(tuple, runs.overlaps(df, width=width).collect())) == [("a", 0, None), ("b", 1, 5)]


def test_prefix_sums_and_layout(spark):
    rng = random.Random(1)
    rows = [("p", i, rng.randint(0, 9), f"{rng.random()}") for i in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "profile string, first_tile_id long, length long, digest string")
    for width in (10, 333, 1 << 20):
        at = 0
        for r in layout.lay_out(df, width=width).orderBy("first_tile_id").collect():
            assert r["layout_offset"] == at
            at += r["length"]
    assert prefix_sum(df, "length", "first_tile_id", [], "s", inclusive=True, width=7).agg(F.max("s")).first()[0] == sum(r[2] for r in rows)


def test_merged_run_over_zooms_counts_its_last_tile(spark):
    df = spark.createDataFrame([("p", 0, 85, "x")], "profile string, tile_id long, run_length long, digest string")
    assert tuple(layout.layer_stats(df).first()) == ("p", 85, 1, 1, 0, 3)


def test_hot_blob_is_several_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("tile_id"), F.lit(0).alias("offset"), F.lit(1).alias("length"), F.lit(1).alias("run_length"))
    got = entries.grouped_by_blob(df, most=1024).collect()
    assert len(got) > 2 and sum(len(r["runs"]) for r in got) == 5000


def test_entries_prune_leaves_and_keep_straddling_runs(spark, tmp_path):
    path = archives.write(tmp_path / "a.pmtiles", archives.smoke_tiles(), leaf=7)
    assert sorted(r["tile_id"] for r in read_entries(spark, path).collect()) == list(range(85))
    assert sorted(r["tile_id"] for r in read_entries(spark, path, 1, 2).collect()) == list(range(1, 21))
    leaves = read_entries(spark, path, 1, 2, "leaves").orderBy("tile_id").collect()
    assert [(r["tile_id"], r["next_id"]) for r in leaves] == [(0, 7), (7, 14), (14, 21)]
    head = read_entries(spark, path, part="header").first()
    assert head["max_zoom"] == 3 and "vector_layers" in head["metadata_json"]
    run = archives.write(tmp_path / "b.pmtiles", {0: b"x", 10: b"y"}, runs={0: 10, 10: 75})
    assert sorted((r["tile_id"], r["run_length"]) for r in read_entries(spark, run, 2, 2).collect()) == [(0, 10), (10, 75)]


def test_reads_are_joined_over_small_gaps():
    assert list(spans([(0, 10), (10, 10), (30, 5), (10_000_000, 1)])) == [[0, 1, 2], [3]]
    assert list(spans([])) == []


def test_missing_properties_pass_a_not_test(spark):
    df = spark.createDataFrame([("tunnel",), ("bridge",), (None,)], "brunnel string")
    assert df.where(features.is_not(F.col("brunnel"), "tunnel")).count() == 2


def test_names_and_credits(spark):
    tried = ["a", "A.b_c-1", "", "-a", "a/b", "a\n", ".a", "é"]
    df = spark.createDataFrame([(x,) for x in tried], "n string")
    assert [r[0] for r in df.select(names.valid_layer_name(F.col("n"))).collect()] == [True, True] + [False] * 6
    rows = [(None, "x {source}", None), (" own ", None, "own"), ("own", "x {source} {source}", "x own own"), (None, " x ", "x"), ("own", "  ", "own"), (None, None, None)]
    df = spark.createDataFrame(rows, "d string, t string, want string")
    assert all(r[0] == r[1] for r in df.select(names.credited(F.col("d"), F.col("t")), "want").collect())


def test_share_count():
    assert entries.share_count(1000, 10, 4) == 32
    assert entries.share_count(5, 10, 4) == 5
    assert entries.share_count(1000, 10, 1) == 1
    assert entries.share_count(10_000, 100 << 26, 4) == 100
    assert entries.share_count(0, 0, 4) == 1
