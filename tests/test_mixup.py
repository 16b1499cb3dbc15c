"""Mixtures lie between their rows and follow from hashes alone."""

import numpy as np
from pyspark.sql import functions as F

from spectrafield.operators import validation


def test_mixtures_lie_between_their_rows(spark):
    rows = [(i * 3, float(i), float(i * i)) for i in range(200)]
    df = spark.createDataFrame([*rows, (1000, None, 1.0)], "id long, u double, v double")
    got = validation.mixup(df.repartition(4), "id", ["u", "v"]).orderBy("i").collect()
    of = {k: (u, v) for k, u, v in rows}
    assert [r["i"] for r in got] == list(range(1, 201)) and len({r["a"] for r in got}) > 90
    for r in got:
        (ua, va), (ub, vb), s = of[r["a"]], of[r["b"]], r["share"]
        assert 0 < s < 1 and abs(r["u"] - (s * ua + (1 - s) * ub)) < 1e-9 and abs(r["v"] - (s * va + (1 - s) * vb)) < 1e-9
    shares = np.array([r["share"] for r in got])
    # variance of the symmetric beta distribution of 0.3
    assert abs(shares.mean() - 0.5) < 0.1 and abs(shares.var() - 0.25 / 1.6) < 0.04
    again = validation.mixup(df.repartition(1), "id", ["u", "v"]).orderBy("i").collect()
    assert again == got
    assert validation.mixup(df, "id", ["u"], share=0.25).count() == 50


def test_nothing_to_mix(spark):
    df = spark.createDataFrame([(1, None)], "id long, u double")
    assert validation.mixup(df, "id", ["u"]).count() == 0
    one = validation.mixup(df.withColumn("u", F.lit(2.0)), "id", ["u"]).first()
    assert (one["a"], one["b"], one["u"]) == (1, 1, 2.0)
