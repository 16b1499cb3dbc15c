"""Kernel independence against all pairs of rows."""

import numpy as np
import pytest

from spectrafield.operators import independence

SCHEMA = "id long, x double, y double"


def brute(x, y, wx, wy):
    k = lambda v, w: np.exp(-((v[:, None] - v) ** 2) / (2 * w * w))
    h = np.eye(len(x)) - 1 / len(x)
    return np.trace(k(x, wx) @ h @ k(y, wy) @ h) / len(x) ** 2


def width(v):
    q = np.quantile(v, np.linspace(0, 1, independence.LEVELS))
    return np.median(np.abs(q[:, None] - q)[np.triu_indices(len(q), 1)])


def frame(spark, x, y):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], SCHEMA).repartition(5)


@pytest.mark.parametrize("kind, few", [("normal", 20), ("skewed", 20), ("skewed", 256), ("ties", 256)])
def test_statistic_is_that_of_all_pairs(spark, kind, few, monkeypatch):
    monkeypatch.setattr(independence, "FEW", few)
    rng = np.random.default_rng(1)
    x = {"normal": rng.normal(size=150), "skewed": np.exp(rng.normal(size=150)), "ties": rng.integers(0, 4, 150) * 10.0}[kind]
    y = x**2 + rng.normal(size=150)
    got = independence.hsic_test(frame(spark, x, y), 39).first()
    assert got["n"] == 150 and np.isclose(got["hsic"], brute(x, y, width(x), width(y)), rtol=1e-7) and got["p"] == 1 / 40


def test_p_of_the_permutations_named(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=60), rng.normal(size=60)
    got = independence.hsic_test(frame(spark, x, y), 99).first()
    from hashlib import md5

    order = sorted(range(60), key=lambda i: (int(md5(f"{i}.42".encode()).hexdigest()[:8], 16), i))
    x, y = x[order], y[order]
    deals = independence.dealings(99, 60, 42)
    assert all(len({(a * i + c) % 60 for i in range(60)}) == 60 for a, c in deals) and len(set(deals)) > 80
    drawn = [brute(x, y[[(a * i + c) % 60 for i in range(60)]], width(x), width(y)) for a, c in deals]
    assert np.isclose(got["p"], (1 + sum(round(v, 9) >= round(drawn[0], 9) for v in drawn[1:])) / 100) and got["p"] > 0.02


def test_constant_few_missing_and_far_values(spark):
    one = independence.hsic_test(frame(spark, np.arange(20.0), np.full(20, 3.0)), 19).first()
    assert abs(one["hsic"]) < 1e-12 and one["p"] == 1.0
    assert tuple(independence.hsic_test(frame(spark, np.arange(9.0), np.arange(9.0)), 19).first()) == (9, None, 19, None)
    assert independence.hsic_test(spark.createDataFrame([], SCHEMA)).first()["n"] == 0
    x = np.append(np.arange(20.0), [np.nan, np.inf])
    assert independence.hsic_test(frame(spark, x, np.arange(22.0)), 19).first()["n"] == 20
    far = np.append(np.arange(300.0), 1e9)
    assert np.isclose(independence.hsic_test(frame(spark, far, np.arange(301.0)), 1).first()["hsic"], brute(far, np.arange(301.0), width(far), width(np.arange(301.0))), rtol=1e-6)
    with pytest.raises(ValueError, match="ranks or logarithms"):
        independence.hsic_test(frame(spark, np.append(np.arange(2000) / 1000, np.arange(1, 301) * 1e5), np.arange(2300.0)), 19).first()
