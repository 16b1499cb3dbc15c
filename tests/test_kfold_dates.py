"""Folds of every date against lines fitted one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from spectrafield.operators import validation


def test_groups_have_their_own_lines(spark):
    rng = np.random.default_rng(3)
    rows = [(d, i, float(x), float(a * x + b + rng.normal())) for d, a, b in (("A", 2, 1), ("N", -3, 5), ("R", 0.5, 0)) for i, x in enumerate(rng.random(40) * 10)]
    df = spark.createDataFrame(rows, "date string, point long, x double, y double")
    got = validation.kfold_line(df, "point", "x", "y", by=("date",)).collect()
    assert len(got) == len(rows)
    fold = {r["point"]: r["fold"] for r in df.select("point", validation.fold_of("point").alias("fold")).distinct().collect()}
    for r in got:
        x, y = np.array([(q[2], q[3]) for q in rows if q[0] == r["date"] and fold[q[1]] != r["fold"]]).T
        own = next(q[2] for q in rows if q[:2] == (r["date"], r["point"]))
        assert r["predicted"] == pytest.approx(np.polyval(np.polyfit(x, y, 1), own))
    alone = validation.kfold_line(df.where(F.col("date") == "N"), "point", "x", "y").collect()
    assert {r["point"]: r["predicted"] for r in alone} == pytest.approx({r["point"]: r["predicted"] for r in got if r["date"] == "N"})
