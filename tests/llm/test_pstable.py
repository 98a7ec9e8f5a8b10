import numpy as np
import pytest

from stratatile.llm import pstable

SCHEMA = "vec_id long, embedding array<float>, label int, same string, n_links int, t int"


def brute(rows, cosine=0.98):
    """(n_links, component) of every row by plain code."""
    units = []
    for _, v, label, *_ in rows:
        x = np.array([np.nan if c is None else c for c in v], np.float32).astype(float) if v else np.zeros(0)
        units.append(x / np.linalg.norm(x) if label is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    n = len(rows)
    linked = [[i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= cosine for j in range(n)] for i in range(n)]
    comp = [r[0] for r in rows]
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for j in range(n) if linked[i][j])]) for i in range(n)]
        if new == comp:
            break
        comp = new
    return [(sum(linked[i]), comp[i]) for i in range(n)]


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []

    def add(v, label):
        rows.append((len(rows), None if v is None else [None if x is None else float(x) for x in v], label, "x", 1, 1))

    for label in (1, 2):
        for _ in range(60):
            add(rng.normal(size=16), label)
    centre = rng.normal(size=16)
    for i in range(90):  # a dense group, larger than a block
        add(centre * rng.uniform(0.5, 3) + rng.normal(size=16) * 0.06, 1)
    for _ in range(12):  # a chain
        centre = centre + rng.normal(size=16) * 0.12
        add(centre, 2)
    for v in (rows[0][1], rows[0][1], [2 * x for x in rows[0][1]], [-x for x in rows[0][1]]):
        add(v, 1)
    for v, label in ((None, 1), ([], 1), ([0.0] * 16, 1), ([0.0] * 15 + [None], 1), ([float("nan")] * 16, 1), ([float("inf")] + [1.0] * 15, 1), (rows[0][1], None), (rows[0][1][:8], 1), (rows[0][1], 2)):
        add(v, label)
    return rows


@pytest.mark.parametrize("block", [16, 256])
def test_against_all_pairs(spark, block):
    rows = vectors()
    got = {r["vec_id"]: r for r in pstable.near_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    assert len(got) == len(rows)
    for (i, *_), (n, c) in zip(rows, brute(rows), strict=True):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, c, c == i), rows[i]


def test_repeated_and_null_ids(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(5, v, 1, "", 0, 0), (5, v, 1, "", 0, 0), (None, v, 1, "", 0, 0), (None, None, 1, "", 0, 0)], SCHEMA)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in pstable.near_vectors(df).collect())
    assert got == [("5", 2, "5"), ("5", 2, "5"), ("None", 0, "None"), ("None", 2, "5")]
    assert pstable.near_vectors(df.limit(0)).count() == 0


def test_collision_rates_are_as_computed():
    rng = np.random.default_rng(4)
    made = pstable.Projections(1, 4000, 2.0)
    a = rng.normal(size=32)
    a /= np.linalg.norm(a)
    b = rng.normal(size=32)
    b -= (b @ a) * a
    b /= np.linalg.norm(b)
    for cosine in (0.98, 0.5, 0.0):
        c = cosine * a + np.sqrt(1 - cosine**2) * b
        codes = made.codes(np.stack([a, c]))
        assert abs((codes[0] == codes[1]).mean() - pstable.collision(np.sqrt(2 - 2 * cosine), 2.0)) < 0.03


def test_shape_grows_slowly():
    shapes = [pstable.hash_shape(10**k, 0.98) for k in (2, 4, 6, 9)]
    assert [s[0] for s in shapes] == sorted(s[0] for s in shapes) and shapes[-1][0] < 40
    for rows, (k, t) in zip((10**2, 10**4, 10**6, 10**9), shapes, strict=True):
        near = pstable.collision(np.sqrt(0.04), 2.0) ** k
        assert 1 - (1 - near) ** t >= 0.999


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest to bring together: at least 0.99 of their links are found."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 1, "", 0, 0), (2 * i + 1, (0.981 * a + np.sqrt(1 - 0.981**2) * b).tolist(), 1, "", 0, 0)]
    got = pstable.near_vectors(spark.createDataFrame(rows, SCHEMA)).where("n_links > 0").count()
    assert got >= 0.99 * 3000
