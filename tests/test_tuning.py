"""Variogram fits against a fine search, tuned lines against rows, stacking against models fitted by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafield.operators import holdout, tuning, variogram
from spectrafield.operators.selection import merged, parted_moments


def misfit(model, h, g, nugget, sill, reach):
    return ((g - nugget - sill * variogram.shape(model, h, reach)) ** 2).sum()


@pytest.mark.parametrize("model, nugget, sill, reach", [("spherical", 0.3, 2.0, 70.0), ("exponential", 0.0, 1.5, 60.0), ("gaussian", 0.5, 1.0, 50.0)])
def test_ranges_come_back(model, nugget, sill, reach):
    h = np.arange(1, 13) * 8.0
    found = variogram.fitted(h, nugget + sill * variogram.shape(model, h, reach))
    assert found["model"] == model and abs(found["range_m"] - reach) < 1e-4 and abs(found["nugget"] - nugget) < 1e-5 and found["fit_rmse"] < 1e-6


@pytest.mark.parametrize("seed", range(4))
def test_no_better_fit_within_the_bounds(seed):
    rng = np.random.default_rng(seed)
    h, g = np.sort(rng.random(10)) * 90 + 5, rng.random(10) + np.linspace(0, 1, 10)
    top = g.max()
    for model in variogram.MODELS:
        reach, nugget, sill, error = variogram.best_range(model, h, g)
        assert 0 <= nugget <= top and 0 <= sill <= 2 * top and 0.1 * h.min() <= reach <= h.max()
        tries = [misfit(model, h, g, *rng.random(2) * [top, 2 * top], r) for r in np.linspace(0.1 * h.min(), h.max(), 40) for _ in range(60)]
        near = [misfit(model, h, g, min(max(nugget + a, 0), top), min(max(sill + b, 0), 2 * top), min(max(reach + c, 0.1 * h.min()), h.max())) for a, b, c in rng.normal(size=(400, 3)) * [0.01, 0.01, 0.5]]
        assert error <= min(tries) + 1e-12 and error <= min(near) + 1e-9


def test_flat_few_and_bounded_lags(spark):
    assert variogram.fitted(np.array([1.0, 2.0]), np.array([1.0, 2.0])) is None
    assert variogram.fitted(np.arange(1.0, 6), np.array([1.0, 1.01, 1.0, 1.02, 1.0]))["model"] == "pure_nugget"
    fits = spark.createDataFrame([("a", "d1", 37.9, 0.1), ("a", "d2", None, 0.2), ("b", "d1", 900.0, 0.95), ("c", "d1", None, None)], "element string, date string, range_m double, nugget_ratio double")
    assert sorted(map(tuple, variogram.recommended_buffers(fits).collect())) == [("a", 37, 50, ""), ("b", 100, 50, "pure nugget"), ("c", 50, 50, "no range")]


def test_outliers_and_small_surveys_are_left_out(spark):
    rows = [("a", i, float(i % 5) * 10, float(i // 5) * 10, float(i % 7)) for i in range(25)] + [("a", 99, 0.0, 90.0, 1e9), ("a", 98, 0.0, 91.0, None)] + [("b", i, float(i), 0.0, 1.0) for i in range(9)]
    got = variogram.empirical(spark.createDataFrame(rows, "element string, site long, x double, y double, v double"), ["element"]).collect()
    assert {r["element"] for r in got} == {"a"} and max(r["gamma"] for r in got) < 40
    assert variogram.fit(spark.createDataFrame([], "element string, distance double, gamma double"), ["element"]).collect() == []


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    y = x @ [2.0, 0.0, -1.0, 0.5] + rng.normal(size=120) + 3
    fold = np.arange(120) % 4
    return x, y, fold, spark.createDataFrame([(*map(float, r), float(v), int(f)) for r, v, f in zip(x, y, fold)], "a double, b double, c double, d double, y double, fold int").repartition(3)


def ridge_by_rows(x, y, penalty):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda q: y.mean() + (q - m) / s @ w


def test_curves_match_rows(table):
    x, y, fold, df = table
    parts = parted_moments(df, F.array("a", "b", "c", "d", "y"), F.col("fold"))
    for (penalty,), rmse, r2 in tuning.curve(parts, "ridge"):
        error = sum(((y[fold == k] - ridge_by_rows(x[fold != k], y[fold != k], penalty)(x[fold == k])) ** 2).sum() for k in range(4))
        assert np.isclose(rmse, np.sqrt(error / 120)) and np.isclose(r2, 1 - error / ((y - y.mean()) ** 2).sum())
    assert tuning.tuned(parts, "pls", [(1,), (4,)])[0] in [(1,), (4,)]


def test_elastic_net_meets_its_conditions(table):
    x, y, _, df = table
    m = merged(parted_moments(df, F.array("a", "b", "c", "d", "y"), F.col("fold")))
    z = (x - x.mean(0)) / x.std(0)
    for penalty, share in [(0.01, 0.5), (0.3, 0.9), (1.0, 0.1), (5.0, 1.0)]:
        line = tuning.elastic_net(m, penalty, share)
        w = line.slopes * x.std(0)
        slope = z.T @ (y - y.mean() - z @ w) / len(y) - penalty * (1 - share) * w
        assert np.allclose(slope[w != 0], penalty * share * np.sign(w[w != 0]), atol=1e-7) and (np.abs(slope[w == 0]) <= penalty * share + 1e-9).all()
    assert not tuning.elastic_net(m, 50.0, 1.0).slopes.any()


def test_stacking_matches_rows(table):
    x, y, fold, df = table
    out, about = tuning.stacked(df.withColumn("predicted", F.lit("old")), ["a", "b", "c", "d"], "y", "fold", {"one": (["a", "b"], "ridge"), "two": (["c", "d"], "ridge")})
    got = out.toPandas()
    order = np.lexsort((got["a"],))
    mine = np.lexsort((x[:, 0],))
    base = np.empty((120, 2))
    for j, (cols, name) in enumerate([([0, 1], "one"), ([2, 3], "two")]):
        for k in range(4):
            base[fold == k, j] = ridge_by_rows(x[fold != k][:, cols], y[fold != k], about[name][0])(x[fold == k][:, cols])
    top = np.empty(120)
    for k in range(4):
        top[fold == k] = ridge_by_rows(base[fold != k], y[fold != k], about["penalty"])(base[fold == k])
    assert np.allclose(got["one"].to_numpy()[order], base[mine, 0]) and np.allclose(got["predicted"].to_numpy()[order], top[mine])
    with pytest.raises(ValueError, match="two folds"):
        tuning.stacked(df.where("fold = 0"), ["a"], "y", "fold", {"one": (["a"], "ridge")})


def test_holdout_chooses_without_the_test_rows(spark):
    rng = np.random.default_rng(9)
    n = 90
    x = rng.normal(size=(n, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=n) / 3
    part = np.where(np.arange(n) < 20, 7, np.arange(n) % 2)
    at = np.where(part == 7, 1000.0, rng.random(n))
    df = spark.createDataFrame([(float(at[i]), 0.0, float(x[i, 0]), float(x[i, 1]), float(y[i]), None, int(part[i]), i % 5) for i in range(n)], "x double, y double, a double, b double, t double, none double, part int, inner int")
    assert holdout.farthest(df) == 7 and holdout.farthest(df.limit(0)) is None
    rows = holdout.holdout_models(df, ["a", "b"], ["t", "none"], "part", "inner", {"ridge": None, "lasso": None})
    assert [r[1] for r in rows] == ["ridge", "lasso"] and sum(r[-1] for r in rows) == 1
    train, test = part != 7, part == 7
    penalty = float(rows[0][2].strip("[]"))
    told = ridge_by_rows(x[train], y[train], penalty)(x[test])
    assert rows[0][3:5] == (70, 20) and np.isclose(rows[0][6], np.sqrt(((y[test] - told) ** 2).mean()))
    changed = df.withColumn("t", F.when(F.col("part") == 7, F.col("t") * 9).otherwise(F.col("t")))
    again = holdout.holdout_models(changed, ["a", "b"], ["t"], "part", "inner", {"ridge": None, "lasso": None})
    assert [(r[2], round(r[5], 9), r[-1]) for r in again] == [(r[2], round(r[5], 9), r[-1]) for r in rows]
