"""Steps that grow with permutations, draws or pairs: what is copied is never broadcast, and results equal brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from spectrafield.operators import pairs, spatial, stats, validation


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, n=40):
    return spark.createDataFrame([(i, float(i * 7 % 11), float(i * i % 23)) for i in range(n)], "id long, x double, y double")


def test_permutations_are_not_broadcast(spark):
    one = validation.permutation_test(points(spark), "id", "x", "y", 20)
    many = validation.permutation_targets(points(spark).selectExpr("*", "'t' as target"), "id", "target", "x", "y", 20)
    for df in (one, many):
        assert "ShuffledHashJoin" in plan_of(df) and df.first()["n_permutations"] == 20


def test_draws_are_not_broadcast(spark):
    df = validation.bootstrap_r2(points(spark).selectExpr("*", "x * 0.5 as p", "'m' as model"), "id", "y", "p", ["model"], draws=30)
    assert "ShuffledHashJoin" in plan_of(df) and df.first()["n"] == 40


def brute_lags(rows, lags=12):
    """(lag -> mean distance, gamma, pairs) over all pairs, and the median of the positive distances."""
    near = [(math.hypot(a[1] - b[1], a[2] - b[2]), (a[3] - b[3]) ** 2) for i, a in enumerate(rows) for b in rows[i + 1 :]]
    near = [p for p in near if p[0] > 0]
    far = float(np.median([d for d, _ in near]))
    found = {}
    for d, q in near:
        if d <= far:
            found.setdefault(math.ceil(round(d / (far / lags), 9)), []).append((d, q))
    return far, {k: (np.mean([d for d, _ in v]), np.mean([q for _, q in v]) / 2, len(v)) for k, v in found.items() if len(v) > 1}


def test_pairs_are_never_rows(spark, monkeypatch):
    rows = [(i, float(i * 37 % 29) * 20, float(i // 9) * 20, float(i * i % 101)) for i in range(300)]
    df = spark.createDataFrame(rows, "site long, x double, y double, v double").repartition(3)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 70)
    _, want = brute_lags(rows)
    got = spatial.semivariogram(df)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    got = {r["lag"]: (r["distance"], r["gamma"], r["n_pairs"]) for r in got.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    two = df.withColumn("g", F.col("site") % 2)
    cut = pairs.blocks(two, ["g"], "site", ["x", "y"])
    found = {r["g"]: r["far"] for r in pairs.median_distance(cut, ["g"], "site", ["x", "y"]).collect()}
    for g in (0, 1):
        assert found[g] == brute_lags([r for r in rows if r[0] % 2 == g])[0]


def test_kernels_and_weights_make_no_rows_of_pairs(spark, monkeypatch):
    rows = [(i, float(i * 37 % 29), float(i * i % 101)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 40)
    got = stats.hsic(df)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    gap = [np.abs(np.subtract.outer(c, c)) for c in np.array(rows)[:, 1:].T]
    k, m = (np.exp(-(g**2) / (2 * np.median(g[np.triu_indices(150, 1)]) ** 2)) for g in gap)
    k = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    assert got.first()["n"] == 150 and math.isclose(got.first()["hsic"], (k * m).mean(), rel_tol=1e-9)
    sums = {r["id"]: r["r_x"] for r in pairs.kernel_sums(pairs.blocks(df, [], "id", ["x"]), "id", {"x": 3.0}).collect()}
    want = np.exp(-(gap[0] ** 2) / 18).sum(1) - 1
    assert all(math.isclose(sums[i], want[i], rel_tol=1e-12) for i in range(150))


def test_ranks_sort_no_whole_group(spark, monkeypatch):
    """Ranks of groups in parts equal ranks of groups as they are, with ties, hot values and missing keys."""
    rows = [("a", float(i * 37 % 101), float(i * i % 23)) for i in range(400)] + [(None, 0.0 if i % 3 else float(i), 5.0 - i) for i in range(200)] + [("flat", 2.0, float(i)) for i in range(100)] + [("few", float(-i), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    want = {r["g"]: (r["n"], r["rho"]) for r in stats.spearman(df, ["g"]).collect()}
    ranks = sorted(map(str, stats.ranked_pairs(df, ["g"]).collect()))
    monkeypatch.setattr(stats, "PART_ROWS", 30)
    cut = stats.ranked_pairs(df, ["g"])
    assert "_px" in plan_of(cut) and sorted(map(str, cut.collect())) == ranks
    got = {r["g"]: (r["n"], r["rho"]) for r in stats.spearman(df, ["g"]).collect()}
    assert got.keys() == want.keys() and got["flat"][1] is None and want["flat"][1] is None
    assert all(n == want[g][0] and (rho is None or math.isclose(rho, want[g][1], rel_tol=1e-12)) for g, (n, rho) in got.items())
