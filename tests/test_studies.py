"""Studies over tables of the test's own, configurations, readers, patches and targets outside buffers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafield.operators import forest, models, patches, validation
from spectrafield.plans import studies
from spectrafield.sources import readers


@pytest.fixture(scope="module")
def own(spark):
    rng = np.random.default_rng(2)
    n = 60
    a, b = rng.normal(size=n), rng.normal(size=n)
    fe, zn = 2 * a + rng.normal(size=n) / 4, rng.normal(size=n)
    rows = [(i, float(a[i]), None if i == 5 else float(b[i]), float(fe[i]), None if i % 7 == 0 else float(zn[i])) for i in range(n)]
    places = [(i, float(i % 8) * 20, float(i // 8) * 20) for i in range(n)]
    return rows, spark.createDataFrame(rows, "pid long, a double, b double, `Fe, mg/kg` double, zn double"), spark.createDataFrame(places, "pid long, east double, north double")


CONFIG = studies.Config(point="pid", x="east", y="north", elements=("Fe, mg/kg", "zn"), features=("a", "b"), short_names={"Fe, mg/kg": "Fe"}, buffers={"zn": 30.0}, trees=4, depth=2)


def test_correlations_of_own_tables(spark, own, tmp_path):
    rows, df, _ = own
    tables = studies.correlation_study(df.select("pid", "a", "b"), df.select("pid", "Fe, mg/kg", "zn"), CONFIG)
    got = {(r["feature"], r["element"]): r for r in tables["correlations"].collect()}
    x, y = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    one = got["a", "Fe, mg/kg"]
    assert math.isclose(one["r"], np.corrcoef(x, y)[0, 1], rel_tol=1e-9) and one["short_name"] == "Fe" and one["category"] == "strong" and one["date"] == "all"
    assert got["b", "zn"]["n"] == sum(r[2] is not None and r[4] is not None for r in rows) and got["a", "zn"]["short_name"] == "zn"
    assert "all | Fe" in tables["heatmap"].columns and tables["top"].count() == 4
    paths = studies.write({"correlations": tables["correlations"]}, str(tmp_path))
    assert readers.read_table(spark, paths[0]).count() == 4


def test_offsets_move_points(spark, own):
    _, df, _ = own
    moved = df.select((F.col("pid") - 100).alias("pid"), "a", "b", F.lit("d1").alias("date"))
    config = studies.Config(**{**CONFIG.__dict__, "id_offsets": {"d1": 100}})
    got = studies.correlation_study(moved, df.select("pid", "Fe, mg/kg", "zn"), config)["correlations"].collect()
    assert len(got) == 4 and {r["date"] for r in got} == {"d1"}


def test_other_studies_run(own):
    rows, df, places = own
    profile = studies.dependence_study(df, df, CONFIG, "a", "Fe, mg/kg")["profile"].first()
    assert profile["r"] > 0.9 and profile["tau"] > 0.6 and profile["dcor"] > 0.8 and profile["tau_p"] < 0.01 and profile["hsic"] > 0 and profile["hsic_p"] == 1 / 200
    v = studies.variogram_study(df.select("pid", "Fe, mg/kg", "zn"), places, CONFIG)
    assert {r["element"] for r in v["buffers"].collect()} == {"Fe, mg/kg", "zn"}
    b = studies.buffered_study(df, places, CONFIG)
    metrics = {r["short_name"]: r for r in b["metrics"].collect()}
    assert metrics["Fe"]["r2"] > 0.8 and metrics["Fe"]["buffer_m"] == 50 and metrics["zn"]["buffer_m"] == 30 and metrics["zn"]["n"] < 60
    assert b["neighbours"].first()["n"] == 60
    best = {(r["short_name"], r["model"]): r["r2"] for r in studies.model_study(df, CONFIG)["candidates"].orderBy("r2").collect()}
    assert best["Fe", "ridge"] > 0.9 and best["zn", "ridge"] < 0.2
    # two features leave a node one of them to be cut by, so four small trees explain about half: the figure is that of the forest's own rows
    folded = df.withColumn("f", validation.fold_of("pid", CONFIG.folds)).withColumn("o", F.array("f")).withColumn("k", F.xxhash64("a", "b", "Fe, mg/kg"))
    told = forest.predict(folded, forest.fit(folded, "k", ["a", "b"], "Fe, mg/kg", out="o", folds=CONFIG.folds, trees=4, depth=2), fold="f").select("Fe, mg/kg", "predicted").collect()
    y, p = np.array(told).T
    assert len(y) == 60 and math.isclose(best["Fe", "forest"], 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9) and best["Fe", "forest"] > max(0.4, best["zn", "forest"])


def test_configuration_files(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"elements": ["zn"], "buffers": {"zn": 20}}))
    config = studies.load_config(spark, str(tmp_path / "none.json"), str(path))
    assert config.elements == ("zn",) and config.buffer("zn") == 20 and config.buffer("fe") == 50 and config.short("zn") == "zn"
    path.write_text(json.dumps({"element": []}))
    with pytest.raises(ValueError, match="unknown"):
        studies.load_config(spark, str(path))
    with pytest.raises(ValueError, match="elements"):
        studies.correlation_study(spark.range(3).toDF("point_id").withColumn("f", F.lit(1.0)), spark.range(3).toDF("point_id"), studies.Config(features=("f",)))


def test_readers(spark, tmp_path):
    spark.createDataFrame([(1, "0,5"), (2, "<0.05")], "id long, v string").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "s.csv").write_text("pid,500,410.5\n1,0.2,0.1\n2,x,0.3\n")
    (tmp_path / "j.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.first_source(spark, [str(tmp_path / "no"), str(tmp_path / "t.parquet")]).endswith("t.parquet")
    with pytest.raises(FileNotFoundError):
        readers.first_source(spark, [str(tmp_path / "no")])
    t = readers.read_table(spark, str(tmp_path / "t.parquet")).select(readers.measured(F.col("v")).alias("v"))
    assert sorted((r["v"] for r in t.collect()), key=str) == [0.5, None]
    assert readers.read_table(spark, str(tmp_path / "j.json")).count() == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, "a.doc")
    spectra, waves = readers.read_spectra(spark, str(tmp_path / "s.csv"), "pid")
    assert waves == [410.5, 500.0] and sorted(map(tuple, spectra.collect())) == [(1, [0.1, 0.2]), (2, [0.3, None])]


def test_mirrored_windows_match_padding(spark):
    rng = np.random.default_rng(0)
    grid = rng.random((9, 7))
    df = spark.createDataFrame([(i, j, float(grid[i, j])) for i in range(9) for j in range(7)], "row int, col int, b double")
    views = np.lib.stride_tricks.sliding_window_view(np.pad(grid, 2, mode="reflect"), (5, 5)).reshape(9, 7, -1)
    for tile in (4, 64):
        got = patches.reflected_stats(df, ["b"], 5, tile).collect()
        assert len(got) == 63
        for r in got:
            v = views[r["row"], r["col"]]
            assert np.allclose([r["mean"], r["std"], r["median"], r["p25"], r["p75"]], [v.mean(), v.std(), np.median(v), *np.percentile(v, [25, 75])])
    assert patches.reflected_stats(df.limit(0), ["b"], 5).collect() == []
    with pytest.raises(ValueError):
        patches.reflected_stats(df.where("row < 2"), ["b"], 5)


def test_turns_match_numpy(spark):
    base = np.arange(2 * 3 * 3, dtype=float).reshape(2, 3, 3)
    df = spark.createDataFrame([(k, a, d, base.ravel().tolist()) for k in range(4) for a in (False, True) for d in (False, True)], "k int, a boolean, d boolean, p array<double>")
    for r in df.select("k", "a", "d", patches.turned(F.col("p"), 3, F.col("k"), F.col("a"), F.col("d")).alias("p")).collect():
        want = np.rot90(base, k=r["k"], axes=(1, 2))
        want = np.flip(want, axis=2) if r["a"] else want
        want = np.flip(want, axis=1) if r["d"] else want
        assert np.array_equal(np.array(r["p"]).reshape(2, 3, 3), want), r


def test_targets_outside_buffers_match_rows(spark, own):
    rows, df, places = own
    joined = df.withColumnRenamed("pid", "site").join(places.select(F.col("pid").alias("site"), F.col("east").alias("x"), F.col("north").alias("y")), "site").withColumn("flat", F.lit(1.0))
    got = {(r["site"], r["target"]): r for r in models.buffered_targets(joined, ["a", "b"], ["Fe, mg/kg", "zn"], 45.0, 0.7).collect()}
    data = np.array([[r[1], np.nan if r[2] is None else r[2], r[3], np.nan if r[4] is None else r[4]] for r in rows])
    at = np.array([[i % 8 * 20.0, i // 8 * 20.0] for i in range(60)])
    assert (5, "zn") not in got and len(got) == 59 * 2
    for (site, target), r in got.items():
        t = 2 if target != "zn" else 3
        far = (np.hypot(*(at - at[site]).T) >= 45) & ~np.isnan(data[:, 1]) & ~np.isnan(data[:, t])
        x, y = data[far][:, :2], data[far][:, t]
        m = x.mean(0)
        w = np.linalg.solve((x - m).T @ (x - m) + 0.7 * np.eye(2), (x - m).T @ (y - y.mean()))
        assert r["n"] == far.sum() and math.isclose(r["predicted"], y.mean() + (data[site, :2] - m) @ w, rel_tol=1e-8, abs_tol=1e-9)
    assert {r["predicted"] for r in models.buffered_targets(joined, ["flat"], ["zn"], 45.0, 0.0).collect()} == {None}
    assert {r["predicted"] for r in models.buffered_targets(joined, ["a"], ["zn"], 1e6).collect()} == {None}
    alone = models.buffered_ridge(joined.where("b is not null"), ["flat"], "a", 45.0, 0.0).collect()
    assert {r["predicted"] for r in alone} == {None}
