"""Forests against trees grown row by row; quantiles against Spark's own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafield.operators import forest as fo
from spectrafield.operators.quantiles import exact_quantiles


def mix(x):
    x &= fo.MASK
    for _ in range(2):
        x = ((x ^ (x >> 16)) * fo.SPREAD) & fo.MASK
    return x ^ (x >> 16)


def pair(a, b):
    return mix(mix(a) + (b & 0xFFFFF) * 1000003)


def draws(key, tree):
    u, k, total = pair(key, tree), 0, 0.0
    while k < 8:
        total += math.exp(-1) / math.factorial(k)
        if u < int(total * (fo.MASK + 1)):
            break
        k += 1
    return k


def grown(rows, edges, tree, depth, least, most):
    """{node: (feature, bin, value)} of one tree; rows: (key, y steps, bins)."""
    out, todo = {}, {1: [(y, x, draws(k, tree)) for k, y, x in rows]}
    for level in range(depth + 1):
        below = {}
        for node, held in todo.items():
            held = [h for h in held if h[2]]
            w, s = sum(h[2] for h in held), sum(h[0] * h[2] for h in held)
            if not w:
                continue
            p = len(edges)
            best = (1e-9, None, None)
            for j in sorted(sorted(range(p), key=lambda j: (pair(pair(tree, node), j), j))[:most]):
                for b in range(len(edges[j]) + 1):
                    wl, sl = sum(h[2] for h in held if h[1][j] <= b), sum(h[0] * h[2] for h in held if h[1][j] <= b)
                    if wl < least or w - wl < least:
                        continue
                    gain = sl * sl / wl + (s - sl) * (s - sl) / (w - wl) - s * s / w
                    if gain > best[0]:
                        best = (gain, j, b)
            _, j, b = best if level < depth else (0, None, None)
            out[node] = (j, b, s / w)
            if j is not None:
                below[2 * node], below[2 * node + 1] = [h for h in held if h[1][j] <= b], [h for h in held if h[1][j] > b]
        todo = below
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(240):
        a, b, c = rng.normal(), rng.integers(0, 4), rng.normal()
        data.append((i * 7, float(a), None if i % 17 == 0 else float(b), float(c), float(a * 3 + (b == 2) * 5 + rng.normal() / 5) if i % 29 else None, i % 3, [i % 3, (i + 1) % 3] if i % 10 == 0 else [i % 3]))
    return data, spark.createDataFrame(data, "id long, a double, b double, c double, y double, fold int, out array<int>")


def test_forest_is_what_rows_say(spark, rows):
    data, df = rows
    model = fo.fit(df.repartition(5), "id", ["a", "b", "c"], "y", out="out", folds=3, trees=4, depth=3, least=3, bins=8, most=2)
    ys = [r[4] for r in data if r[4] is not None]
    low, step = min(ys), (max(ys) - min(ys)) / fo.STEPS
    for f in range(3):
        held = []
        for r in data:
            if r[4] is not None and f not in r[6]:
                x = [r[1], r[2] if r[2] is not None else model.medians[1], r[3]]
                held.append((r[0], round((r[4] - low) / step), [sum(v > e for e in model.edges[j]) for j, v in enumerate(x)]))
        for t in range(4):
            want = grown(held, model.edges, t, 3, 3, 2)
            got = {n: (int(model.feature[f, t, n]) if model.feature[f, t, n] >= 0 else None, int(model.cut[f, t, n]) if model.feature[f, t, n] >= 0 else None, model.value[f, t, n]) for n in range(16) if not np.isnan(model.value[f, t, n])}
            assert {n: g[:2] for n, g in got.items()} == {n: w[:2] for n, w in want.items()}
            assert all(math.isclose(got[n][2], w[2] * step + low, rel_tol=1e-12, abs_tol=1e-9) for n, w in want.items())


def test_predictions_beat_the_mean_and_come_back(spark, rows, tmp_path):
    _, df = rows
    model = fo.fit(df, "id", ["a", "b", "c"], "y", out="out", folds=3, trees=30, depth=5, most=2)
    got = fo.predict(df.withColumn("spread", F.lit("old")), model, fold="fold").collect()
    y = np.array([r["y"] for r in got if r["y"] is not None])
    p = np.array([r["predicted"] for r in got if r["y"] is not None])
    assert 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.6
    assert all(r["spread"] > 0 for r in got) and len(got) == 240
    share = model.importance()
    assert np.allclose(share.sum(1), 1) and (share[:, 0] > share[:, 2]).all()
    model.save(spark, str(tmp_path / "m"))
    again = fo.predict(df, fo.load(spark, str(tmp_path / "m")), fold="fold")
    assert {(r["id"], r["predicted"], r["spread"]) for r in again.collect()} == {(r["id"], r["predicted"], r["spread"]) for r in got}


def test_nothing_to_learn(spark, rows):
    _, df = rows
    for part in (df.where("y is null"), df.limit(0)):
        model = fo.fit(part, "id", ["a"], "y", trees=2, depth=2)
        assert {(r["predicted"], r["spread"]) for r in fo.predict(df, model).collect()} == {(None, None)}
    model = fo.fit(df.withColumn("y", F.lit(2.0)), "id", ["a"], "y", trees=2, depth=2)
    assert {r["predicted"] for r in fo.predict(df.withColumn("ok", F.col("id") > 0), model, valid="ok").collect()} == {2.0, None}


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(1)
    data = [(g, float(v)) for g in range(4) for v in (rng.normal(size=300) if g < 2 else rng.integers(0, 5, 200) if g == 2 else [7.5])]
    data += [(0, None), (1, float("nan")), (9, None)] + [(5, v) for v in (-1.7e308, 1.7e308, 0.0, 1.0)]
    df = spark.createDataFrame(data, "g int, v double")
    at = [0.0, 0.02, 0.25, 0.5, 0.98, 1.0, 1 / 3]
    want = df.where("v is not null and not isnan(v)").groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, at))).alias("q"))
    for bins in (4096, 3):
        got = exact_quantiles(df, ["g"], "v", at, bins)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    whole = exact_quantiles(df.where("g < 3"), [], "v", [0.5]).first()
    assert whole["q"] == [df.where("g < 3 and not isnan(v)").agg(F.percentile("v", F.lit(0.5))).first()[0]]
    assert exact_quantiles(df.limit(0), ["g"], "v", [0.5]).collect() == []
