"""Radii that leave out the same sites have equal rows, to the last digit."""

import math
import random

from spectrafield.operators import stats
from spectrafield.plans import queries


def test_equal_radii_have_equal_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.randrange(25), rng.randrange(-99999, 999999) / 100) for k in range(3000)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").repartition(6).write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r["radius"]: tuple(r)[1:] for r in queries.buffer_sweep(spark, str(tmp_path)).collect()}
    assert sorted(got) == queries.RADII
    assert got[0.0] == got[20.0] != got[30.0]  # sites lie 20 m apart
    y, total = [v for *_, v in rows], math.fsum(v for *_, v in rows)
    errors = [v - (total - v) / (len(y) - 1) for v in y]
    mean, sse = total / len(y), math.fsum(e * e for e in errors)
    want = (len(y), 1 - sse / math.fsum((v - mean) ** 2 for v in y), math.sqrt(sse / len(y)), math.fsum(map(abs, errors)) / len(y))
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got[0.0], want, strict=True))


def test_settings_are_kept_apart(spark):
    rows = [(k, s, float(k), k + s) for k in range(5) for s in (1.0, 2.0) if k < 4 or s == 1.0] + [(9, 2.0, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, s double, y double, p double")
    got = {r["s"]: (r["n"], r["mae"]) for r in stats.sweep_metrics(df, "id", "s", [1.0, 2.0, 3.0]).collect()}
    assert got == {1.0: (5, 1.0), 2.0: (5, 2.0)}
    plain = {r["s"]: tuple(r) for r in stats.regression_metrics(df, ["s"], quartiles=False).collect()}
    assert {r["s"]: tuple(r) for r in stats.sweep_metrics(df, "id", "s", [1.0, 2.0]).collect()} == plain
