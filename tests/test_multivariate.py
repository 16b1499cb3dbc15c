"""Operators over many columns: what SQL does not reach."""

import numpy as np
from pyspark.sql import functions as F
from spectrafield.functions import distributions, spectra
from spectrafield.operators import multivariate as mv
from spectrafield.operators import raster, validation


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")


def test_components_and_incomplete_rows(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)) @ np.diag([5, 2, 1, 0.5, 0.1]) + 1e6
    df = frame(spark, x).unionByName(spark.createDataFrame([(98, [1.0, None, 1.0, 1.0, 1.0]), (99, [float("nan")] * 5), (97, None)], "id long, v array<double>"))
    m = mv.moments(df, F.col("v"))
    assert m.n == 60 and np.allclose(m.cross, np.cov(x.T) * 59, atol=1e-6)
    got = mv.principal_components(m, 0.95)
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose([g[1] for g in got], want[: len(got)])
    assert got[-1][3] > 0.95 and (len(got) == 1 or got[-2][3] <= 0.95)


def test_empty_and_constant_columns(spark):
    empty = mv.moments(frame(spark, []), F.col("v"))
    assert empty.n == 0 and mv.successive_projections(empty) == [] and mv.principal_components(empty) == [] and mv.canonical_correlations(empty, 1) == []
    flat = mv.moments(frame(spark, [[1, 2, i % 3] for i in range(9)]), F.col("v"))
    model = mv.partial_least_squares(flat, 2)
    assert not len(model.explained) and model.intercept == 1.0 and not mv.importance_in_projection(model).any()


def test_full_latent_model_is_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=40)
    df = frame(spark, np.column_stack([x, y]))
    model = mv.partial_least_squares(mv.moments(df, F.col("v")), 3)
    want = np.linalg.lstsq(np.column_stack([x, np.ones(40)]), y, rcond=None)[0]
    assert np.allclose([*model.coefficients, model.intercept], want)
    got = [r[0] for r in df.orderBy("id").select(mv.predicted(model, F.slice("v", 1, 3))).collect()]
    assert np.allclose(got, np.column_stack([x, np.ones(40)]) @ want)


def test_digamma(spark):
    known = {1: -0.5772156649015329, 2: 0.42278433509846713, 33: sum(1 / i for i in range(1, 33)) - np.euler_gamma, 5000: sum(1 / i for i in range(1, 5000)) - np.euler_gamma}
    rows = spark.createDataFrame([(k,) for k in known], "k long").select("k", mv.digamma(F.col("k")).alias("d")).collect()
    assert all(abs(r["d"] - known[r["k"]]) < 1e-12 for r in rows)


def test_information_of_copies_and_ties(spark):
    rows = [("same", i, float(i % 50), float(i % 50)) for i in range(100)] + [("few", i, 1.0, 2.0) for i in range(5)] + [("null", i, None, 1.0) for i in range(9)]
    got = {r["g"]: r for r in mv.mutual_information(spark.createDataFrame(rows, "g string, id int, x double, y double"), ["g"]).collect()}
    assert set(got) == {"same"} and got["same"]["mi"] > 1.0


def test_continuum_of_odd_spectra(spark):
    w = [400.0, 410.0, 420.0, 430.0, 440.0]
    odd = [[0.0, 1.0, 0.5, 1.0, 0.0], [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 2.0], [1.0, float("nan"), 1.0, 1.0, 1.0], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "id int, v array<double>")
    got = [r["s"] for r in df.select("id", spectra.continuum_removed(F.col("v"), w).alias("s")).orderBy("id").collect()]
    assert got[0] == [0.0, 1.0, 0.5, 1.0, 0.0] and got[1] == odd[1] and got[2] == odd[2] and np.isnan(got[3][1]) and got[4] is None


def test_spatial_folds(spark):
    rows = [(i, float(i % 10), float(i // 10)) for i in range(60)] + [(60, 100.0, 100.0), (61, None, 1.0)]
    got = validation.spatial_folds(spark.createDataFrame(rows, "id int, x double, y double"), "id").collect()
    assert len(got) == 61 and {r["fold"] for r in got} == set(range(5))
    assert [r["id"] for r in got if r["holdout"]] == [60]


def test_bootstrap_of_few_and_of_a_constant(spark):
    rows = [("few", i, float(i), i + 0.5) for i in range(4)] + [("flat", i, 1.0, 1.0 + i) for i in range(8)] + [("good", i, float(i), i + (-1.0) ** i) for i in range(30)] + [("one", 0, 1.0, 2.0)] + [("good", 90, None, 1.0), ("good", 91, 1.0, float("nan"))]
    got = {r["g"]: r for r in validation.bootstrap_r2(spark.createDataFrame(rows, "g string, i int, y double, p double"), "i", "y", "p", ["g"], 300).collect()}
    assert got["few"]["low"] is None and got["few"]["r2"] is not None and got["flat"]["r2"] is None
    assert got["one"]["n"] == 1 and got["one"]["low"] is None
    assert got["good"]["n"] == 30 and got["good"]["low"] < got["good"]["r2"] < got["good"]["high"]


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-10, 1e-4, 0.3, 0.5, 0.975, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", distributions.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-6 for r in rows)


def test_binary_patterns_of_a_flat_tile(spark):
    px = spark.createDataFrame([(r, c, 7) for r in range(8) for c in range(8)], "row int, col int, v int")
    got = raster.binary_patterns(px, "v", 8).orderBy("bin").collect()
    assert abs(sum(r["density"] for r in got) * 18 / 8 - 1) < 1e-12 and got[7]["density"] >= 16 / 64 * 8 / 18
