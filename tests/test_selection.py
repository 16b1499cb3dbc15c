"""Selection, sparse dependence, wavelets and waves on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from spectrafield.functions import spectra
from spectrafield.operators import multivariate as mv
from spectrafield.operators import raster, selection


def parts_of(spark, x):
    df = spark.createDataFrame([(i % 4, [float(v) for v in row]) for i, row in enumerate(x)], "part int, v array<double>")
    dirty = spark.createDataFrame([(0, [None] * x.shape[1]), (9, None), (None, [1.0] * x.shape[1]), (1, [float("inf")] * x.shape[1])], "part int, v array<double>")
    return selection.parted_moments(df.unionByName(dirty), F.col("v"), F.col("part"))


def data(n=120, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, 6)) + 1e4
    return np.column_stack([x, 3 * x[:, 1] - 2 * x[:, 4] + np.random.default_rng(9).normal(size=n) * 0.1])


def test_parts_add_up(spark):
    x = data()
    parts = parts_of(spark, x)
    assert [p.n for p in parts] == [30] * 4
    for k, p in enumerate(parts):
        assert np.allclose(p.mean, x[k::4].mean(0)) and np.allclose(p.cross, np.cov(x[k::4].T) * 29, atol=1e-6)
    whole = selection.merged(parts)
    assert whole.n == 120 and np.allclose(whole.cross, np.cov(x.T) * 119, atol=1e-6)


def test_held_out_error_is_that_of_rows(spark):
    x = data()
    parts, total = parts_of(spark, x), 0.0
    for k in range(4):
        inside = np.arange(len(x)) % 4 == k
        rest = x[~inside]
        model = mv.partial_least_squares(mv.Moments(len(rest), rest.mean(0), np.cov(rest.T) * (len(rest) - 1)), 2)
        total += ((x[inside, -1] - x[inside, :-1] @ model.coefficients - model.intercept) ** 2).sum()
    assert np.isclose(selection.held_out_error(parts, 2), np.sqrt(total / len(x)))


def test_selection_finds_the_columns(spark):
    parts = parts_of(spark, data())
    assert {1, 4} <= set(selection.selected(parts, "cars")) and sorted(selection.selected(parts, "vip", components=2)) == [1, 4]
    assert len(selection.selected(parts, "spa", 3)) == 3 and len(selection.selected(parts, "cars_spa", 1)) == 1
    with pytest.raises(ValueError):
        selection.selected(parts, "none")
    assert parts_of(spark, np.zeros((0, 3))) == [] and selection.competitive_selection([]) == []


def test_graphical_lasso_is_optimal():
    s = np.corrcoef(data()[:, :].T)
    for penalty in (0.05, 0.3):
        found = selection.graphical_lasso(s, penalty)
        gap = np.linalg.inv(found) - s
        off = ~np.eye(len(s), dtype=bool)
        assert np.allclose(np.diag(gap), 0, atol=1e-6) and np.abs(gap[off]).max() <= penalty + 1e-6
        linked = off & (np.abs(found) > 1e-6)
        assert linked.any() and np.allclose(gap[linked], penalty * np.sign(found[linked]), atol=1e-5)
    assert np.allclose(selection.graphical_lasso(s, 0.0), np.linalg.inv(s), rtol=1e-4, atol=1e-4)


def test_sparse_partial_correlations(spark):
    parts = parts_of(spark, data())
    found = {(i, j): p for i, j, p in selection.sparse_partial_correlations(parts)}
    assert found[1, 6] > 0.3 and found[4, 6] < -0.3
    assert selection.sparse_partial_correlations([]) == [] and selection.sparse_partial_correlations(parts_of(spark, data(8))) == []


def test_wavelets(spark):
    assert abs(spectra.wavelet_kernel(4).sum()) < 1e-3 and spectra.wavelet_kernel(4).argmax() in range(28, 37)
    bump = [float(np.exp(-((i - 32) ** 2) / 50)) for i in range(64)]
    df = spark.createDataFrame([(1, bump), (2, [1.0, None]), (3, None), (4, [])], "id int, v array<double>").select("id", spectra.wavelet_features(F.col("v")).alias("f"))
    got = {r["id"]: r["f"] for r in df.collect()}
    assert len(got[1]) == 15 and got[2] is got[3] is got[4] is None
    assert max(got[1], key=lambda f: f["most"])["scale"] in range(4, 13)


def test_waves_answer_their_own_frequency(spark):
    px = [(r, c, 1 + float(np.cos(2 * np.pi * 0.25 * c))) for r in range(32) for c in range(32)]
    got = {(r["frequency"], r["angle"]): r["mean"] for r in raster.wave_energy(spark.createDataFrame(px, "row int, col int, v double"), "v").collect()}
    assert len(got) == 12 and max(got, key=got.get) in {(0.25, 0), *[(0.1, a) for a in range(4)]} and got[0.25, 0] > 10 * got[0.25, 2]
