"""Processes on inducing points against full ones of plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafield.operators import gaussian

SCHEMA = "id long, a double, b double, y double, w double, fold int"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 90
    x = rng.normal(size=(n, 2)) * [2.0, 5.0] + [1.0, -3.0]
    y = np.sin(x[:, 0]) + 0.1 * x[:, 1] + rng.normal(size=n) * 0.1 + 7
    w = rng.normal(size=n)
    fold = np.arange(n) % 3
    return x, y, w, fold, spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), float(w[i]), int(fold[i])) for i in range(n)], SCHEMA).repartition(5)


def full(x, y, q, length, noise, amplitude):
    """Expected value, deviation and log likelihood of the process on all rows."""
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * length**2))
    c = amplitude * (k(x, x) + noise * np.eye(len(x)))
    at = amplitude * k(q, x)
    v = y - y.mean()
    told = y.mean() + at @ np.linalg.solve(c, v)
    sure = amplitude * (1 + noise) - np.einsum("ij,ji->i", at, np.linalg.solve(c, at.T))
    return told, np.sqrt(sure), -0.5 * (v @ np.linalg.solve(c, v) + np.linalg.slogdet(c)[1] + len(x) * np.log(2 * np.pi))


def test_all_rows_as_points_are_the_full_process(data):
    x, y, w, _, df = data
    model, outside = gaussian.fit(df.withColumn("fold", F.lit(0)), ["a", "b"], ["y", "w"], ["id"], "fold", inducing=90)
    assert outside == {}
    z = (x - x.mean(0)) / x.std(0)
    for j, t in enumerate((y, w)):
        p = model.processes[j]
        told, sure, likely = full(z, t, z, p.length, p.noise, p.amplitude)
        got = model.tell(x)
        assert np.allclose(got[0][:, j], told, atol=1e-5) and np.allclose(got[1][:, j], sure, atol=1e-5) and abs(p.worth - likely) < 1e-3
        others = [full(z, t, z, length, noise, a * p.amplitude)[2] for length in gaussian.LENGTHS for noise in np.geomspace(1e-3, 1e3, 25) for a in (0.5, 1.0, 2.0)]
        assert p.worth >= max(others) - 1e-3
    assert model.processes[0].noise < 1 < model.processes[1].noise or model.processes[1].amplitude * model.processes[1].noise > 0.5


def test_few_points_bound_the_likelihood_and_folds_are_told_by_others(spark, data):
    x, y, _, fold, df = data
    model, outside = gaussian.fit(df, ["a", "b"], ["y"], ["id"], "fold", inducing=25)
    z = (x - model.middle) / model.spread
    p = model.processes[0]
    assert p.worth <= full(z, y, z, p.length, p.noise, p.amplitude)[2] + 1e-6
    got = {r["id"]: r for r in gaussian.predict(df, outside, "fold", ["id", "y"]).collect()}
    assert len(got) == 90 and {r["target"] for r in got.values()} == {"y"}
    for k in range(3):
        own = outside[k].processes[0]
        part = fold == k
        kz, kx = gaussian.kernel(model.points, model.points, own.length), gaussian.kernel(z[~part], model.points, own.length)
        values, vectors = np.linalg.eigh(kz)
        keep = values > values[-1] * gaussian.SMALLEST  # what is left out is left out of the definition
        low = lambda rows: rows @ vectors[:, keep] / np.sqrt(values[keep])  # noqa: B023, E731
        train = low(kx)
        inner = train @ train.T + own.noise * np.eye(len(train))  # all rows, as if they were few
        new = low(gaussian.kernel(z[part], model.points, own.length)) @ train.T
        want = y[~part].mean() + new @ np.linalg.solve(inner, y[~part] - y[~part].mean())
        lone = low(gaussian.kernel(z[part], model.points, own.length))
        spread = np.sqrt(own.amplitude * (1 + own.noise - (lone * lone).sum(1) + (lone * (lone - new @ np.linalg.solve(inner, train))).sum(1)))
        assert np.allclose([got[i]["deviation"] for i in np.flatnonzero(part)], spread, atol=1e-5)
        assert np.allclose([got[i]["predicted"] for i in np.flatnonzero(part)], want, atol=1e-5)
    error = np.array([got[i]["predicted"] - y[i] for i in range(90)])
    assert 1 - (error**2).mean() / y.var() > 0.6
    covered = np.mean([abs(got[i]["predicted"] - y[i]) <= 1.96 * got[i]["deviation"] for i in range(90)])
    assert 0.8 < covered <= 1
    changed = df.withColumn("y", F.when(F.col("fold") == 1, F.col("y") * -3).otherwise(F.col("y")))
    again = gaussian.fit(changed, ["a", "b"], ["y"], ["id"], "fold", inducing=25)[1][1]
    assert np.allclose(again.tell(x)[0], outside[1].tell(x)[0])


def test_missing_constant_repeated_and_no_rows(spark, data):
    *_, df = data
    nothing = spark.createDataFrame([], SCHEMA)
    assert gaussian.fit(nothing, ["a", "b"], ["y"], ["id"], "fold") == (None, {})
    bad = spark.createDataFrame([(900, None, 1.0, 2.0, 1.0, 0), (901, 1.0, float("nan"), 2.0, 1.0, 1), (902, 1.0, 1.0, float("inf"), 1.0, 1), (903, 1.0, 1.0, 1.0, 1.0, None)], SCHEMA)
    both = df.unionByName(bad)
    one, two = (gaussian.fit(d, ["a", "b"], ["y"], ["id"], "fold", inducing=20) for d in (df, both))
    probe = np.array([[0.0, 0.0], [3.0, -1.0]])
    assert np.allclose(one[0].tell(probe), two[0].tell(probe))
    told = {r["id"]: (r["predicted"], r["deviation"]) for r in gaussian.predict(both, two[1], "fold", ["id"]).collect()}
    assert len(told) == 94 and told[900] == told[901] == told[903] == (None, None) and told[902][1] > 0
    flat = spark.createDataFrame([(i, 1.0, float(i % 2), 4.0, 0.0, i % 2) for i in range(20)], SCHEMA)
    model, _ = gaussian.fit(flat, ["a", "b"], ["y"], ["id"], "fold")
    assert np.allclose(model.tell(np.array([[1.0, 0.0]])), [[[4.0]], [[0.0]]])
    with pytest.raises(ValueError, match="sums"):
        gaussian.fit(df, ["a", "b"], ["y"], ["id"], "fold", inducing=90, lengths=tuple(np.linspace(1, 2, 4000)))


def test_rows_are_read_once(spark):
    from spectrafield.plans import gaussian as plans

    df = plans.gaussian_process(spark, "/root/testdata/sf0.001")
    assert "parquet" not in df._jdf.queryExecution().executedPlan().toString() and df.count() > 0
