"""Rank statistics and neighbours against all pairs, also where orders are cut into parts."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from spectrafield.operators import ordered, spatial


def tau_b(rows):
    s = nx = ny = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        dx, dy = (a > c) - (a < c), (b > d) - (b < d)
        s, nx, ny = s + dx * dy, nx + dx * dx, ny + dy * dy
    return s / math.sqrt(nx * ny) if nx and ny else None


def dcor(rows):
    n = len(rows)
    def centred(v):
        d = [[abs(a - b) for b in v] for a in v]
        m = [sum(r) / n for r in d]
        g = sum(m) / n
        return [[d[i][j] - m[i] - m[j] + g for j in range(n)] for i in range(n)]
    a, b = centred([r[0] for r in rows]), centred([r[1] for r in rows])
    mean = lambda p, q: sum(p[i][j] * q[i][j] for i in range(n) for j in range(n)) / n**2
    return math.sqrt(max(0, mean(a, b) / math.sqrt(mean(a, a) * mean(b, b))))


@pytest.mark.parametrize("part_rows", [10**6, 7])
@pytest.mark.parametrize("kind", ["ties", "smooth"])
def test_rank_statistics_match_all_pairs(spark, monkeypatch, part_rows, kind):
    monkeypatch.setattr(ordered, "PART_ROWS", part_rows)
    rng = random.Random(kind)
    rows = [(rng.choice([1.0, 2.5, -3.0, 8.0]), float(rng.randrange(5))) if kind == "ties" else (x := rng.gauss(0, 3), x * x + rng.random()) for _ in range(70)]
    df = spark.createDataFrame([*rows, (None, 1.0), (1.0, float("nan"))], "x double, y double")
    k = ordered.kendall(df).first()
    assert k["n_pairs"] == 70 * 69 // 2 and math.isclose(k["tau"], tau_b(rows), rel_tol=1e-12)
    d = ordered.distance_correlation(df).first()
    assert d["n"] == 70 and math.isclose(d["dcor"], dcor(rows), rel_tol=1e-9)


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert ordered.kendall(df).first()["tau"] is None and ordered.distance_correlation(df).first()["dcor"] == 0
    assert tuple(ordered.kendall(df.limit(0)).first()) == (0, None) and ordered.distance_correlation(df.limit(0)).first()["n"] == 0


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", 7.0), ("b", 2.0)], "g string, v double")
    assert sorted((r["g"], r["v"], r["r"]) for r in ordered.average_ranks(df, ["g"], "v", "r").collect()) == [("a", 1.0, 1.0), ("a", 3.0, 2.5), ("a", 3.0, 2.5), ("a", 7.0, 4.0), ("b", 2.0, 1.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_match_all_pairs(spark, seed):
    rng = random.Random(seed)
    pts = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(60)] + [(100 + i, 500.0 + rng.random(), -900.0) for i in range(6)] + [(200 + i, 7.0, 7.0) for i in range(20)] + [(300 + 4 * i + j, i * 2.0, j * 2.0) for i in range(4) for j in range(4)] + [(999, 1e4, 1e4)]
    rng.shuffle(pts)
    got = {}
    for r in spatial.knn(spark.createDataFrame(pts, "site long, x double, y double"), 4).collect():
        got.setdefault(r["i"], {})[r["place"]] = (r["j"], r["d"])
    for i, x, y in pts:
        want = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), j) for j, a, b in pts if j != i)[:4]
        assert [got[i][p + 1] for p in range(4)] == [(j, d) for d, j in want]


def test_few_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "site long, x double, y double")
    assert sorted(map(tuple, spatial.knn(df, 8).collect())) == [(1, 2, 5.0, 1), (2, 1, 5.0, 1)]
    assert spatial.knn(df.limit(1), 8).collect() == [] and spatial.knn(df.where(F.lit(False)), 8).collect() == []


def test_no_nested_loops(spark):
    df = spark.range(100).select(F.col("id").alias("site"), (F.col("id") % 10 * 1.0).alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"))
    plan = spatial.knn(df, 4)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
