"""The engine's queries over the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions, indices, spectra
from ..operators import ordered, pairs, raster, spatial, stats, validation
from ..sources import tables as src

W = src.WAVELENGTHS
BANDS = ["b0", "b1", "b2", "b3", "b4"]
MODELS = ("spherical", "exponential", "gaussian")
RADII = [0.0, 20.0, 30.0, 50.0, 75.0, 100.0]


def band_pivot(spark, d):
    obs = src.observations(spark, d).where("channel <= 5")
    wide = obs.groupBy("point_id").pivot("channel", [1, 2, 3, 4, 5]).agg((F.sum("value") / F.count("value") / 100.0))
    return wide.toDF("point_id", *[f"ch{i}" for i in range(1, 6)])


def hyper_aggregate_min_bands(spark, d):
    per = src.observations(spark, d).where("value <> 0").groupBy("point_id", "channel").agg((F.sum("value") / F.count("*") / 100.0).alias("value"), F.count("*").alias("n_sets"))
    gate = per.groupBy("point_id").agg(F.count("*").alias("n_bands")).where("n_bands >= 6")
    return per.join(gate, "point_id")


def sets_per_point(spark, d):
    per = src.observations(spark, d).groupBy("point_id", "channel").agg(F.count("*").alias("n"))
    return per.groupBy("point_id").agg(F.avg("n").alias("mean_sets"), F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"))


def _tier(tier: int):
    def run(spark, d):
        df = indices.with_indices(src.band_points(spark, d), (tier,))
        return df.select("point_id", "date", *[i.name for i in indices.registry() if i.tier == tier])

    return run


def ms_indices_eps_family(spark, d):
    return indices.with_padded_indices(src.band_points(spark, d)).select("point_id", "date", *indices.PADDED)


def ms_indices_channels(spark, d):
    return indices.with_channel_indices(src.band_points(spark, d)).select("point_id", "date", *indices.CHANNELS)


def index_catalogue(spark, d):
    """Every index with its tier and how many points have a value."""
    df = indices.with_indices(src.band_points(spark, d), (1, 2, 3))
    counts = df.agg(*[F.count(i.name).alias(i.name) for i in indices.registry()])
    tiers = F.create_map(*[x for i in indices.registry() for x in (F.lit(i.name), F.lit(i.tier))])
    return counts.unpivot([], [i.name for i in indices.registry()], "name", "n_valid").withColumn("tier", tiers[F.col("name")])


def hyper_indices_all(spark, d):
    df = indices.with_narrow_indices(src.spectra(spark, d), W)
    return df.select("point_id", *indices.NARROW, "rep")


def _bands(df: DataFrame) -> DataFrame:
    return df.select("point_id", F.posexplode("s").alias("band", "value"))


def _array(make):
    return lambda spark, d: _bands(src.spectra(spark, d).select("point_id", make(F.col("spectrum")).alias("s")))


def spectral_shape(spark, d):
    df = src.spectra(spark, d)
    return df.select("point_id", *[c.alias(k) for k, c in spectra.shape_features(F.col("spectrum"), W).items()])


def feature_pairs(spark, d) -> DataFrame:
    """Tier-1 indices next to the targets of the same point, by date."""
    df = indices.with_indices(src.band_points(spark, d), (1,))
    return stats.wide_pairs(df, ["point_id", "date"], [i.name for i in indices.registry() if i.tier == 1], ["size", "price"])


def pearson_matrix(spark, d):
    return stats.pearson(feature_pairs(spark, d), ["date", "feature", "element"])


def spearman_matrix(spark, d):
    return stats.spearman(feature_pairs(spark, d), ["date", "feature", "element"])


def _site_values(spark, d):
    return src.sites(spark, d).select(F.col("site").alias("id"), F.col("v").alias("x"), F.col("u").alias("y"))


def kendall_tau(spark, d):
    return ordered.kendall(_site_values(spark, d))


def distance_correlation(spark, d):
    return ordered.distance_correlation(_site_values(spark, d))


def correlogram(spark, d):
    df = src.spectra(spark, d)
    both = df.select(F.lit("raw").alias("variant"), "spectrum", F.col("target").alias("y")).unionByName(
        df.select(F.lit("snv").alias("variant"), spectra.snv(F.col("spectrum")).alias("spectrum"), F.col("target").alias("y"))
    )
    return stats.pearson(both.select("variant", "y", F.posexplode("spectrum").alias("band", "x")), ["variant", "band"])


def top3_per_element(spark, d):
    r = stats.pearson(feature_pairs(spark, d), ["date", "feature", "element"]).withColumn("r", F.round("r", 6)).drop("r2")
    return stats.top_n(r, ["date", "element"], "r", "feature", 3)


def best_index_per_element(spark, d):
    r = stats.pearson(feature_pairs(spark, d), ["date", "feature", "element"]).withColumn("r", F.round("r", 6))
    best = F.max_by(F.struct("feature", "r"), F.struct(F.abs("r"), "feature")).alias("best")
    return r.groupBy("date", "element").agg(best).select("date", "element", "best.feature", "best.r")


def corr_heatmap_pivot(spark, d):
    r = stats.pearson(feature_pairs(spark, d), ["date", "feature", "element"])
    wide = r.groupBy("feature", "date").pivot("element", ["price", "size"]).agg((F.avg("r")))
    return wide.withColumn("strongest", F.greatest(F.abs("price"), F.abs("size")))


def significance_labels(spark, d):
    p = F.col("l_discount")
    df = src.table(spark, d, "lineitem").groupBy("l_discount").agg(F.count("*").alias("n"))
    return df.select(p.alias("p"), "n", stats.significance_label(p).alias("label"), stats.star_ladder(p).alias("stars"))


def category_ladder(spark, d):
    r = stats.pearson(feature_pairs(spark, d), ["date", "feature", "element"])
    df = r.select("date", "feature", "element", "r2", distributions.correlation_p(F.col("r"), F.col("n")).alias("p"))
    return df.withColumn("category", stats.category(F.col("r2"), F.col("p")))


def iqr_outlier_filter(spark, d):
    df = src.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_extendedprice").alias("value"))
    kept = stats.without_outliers(df, ["l_returnflag"], "value", 0.5)
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def zscore_features(spark, d):
    df = src.band_points(spark, d).select("point_id", "date", F.col("r").alias("value"))
    return df.select("point_id", "date", stats.zscores(df, ["date"], "value").alias("z"))


def constant_feature_filter(spark, d):
    df = src.band_points(spark, d).withColumn("fixed", F.lit(1.0))
    long = stats.long_form(df, ["point_id", "date"], ["b", "g", "r", "e", "n", "fixed"], "feature", "value")
    return long.groupBy("feature").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("std")).where("std > 1e-8")


def median_impute(spark, d):
    df = src.band_points(spark, d).select("point_id", "date", F.when(F.col("n_obs") > 3, F.col("r")).alias("value"))
    middle = df.groupBy("date").agg(F.percentile("value", F.lit(0.5)).alias("middle"))
    return df.join(F.broadcast(middle), "date").select("point_id", "date", F.coalesce("value", "middle", F.lit(0.0)).alias("value"))


def semivariogram(spark, d):
    return spatial.semivariogram(src.sites(spark, d))


def variogram_models_eval(spark, d):
    """Three models at the lags of the sites' variogram."""
    h = spatial.semivariogram(src.sites(spark, d)).select("lag", F.col("distance").alias("h"))
    return h.select("lag", "h", *[spatial.variogram_value(m, F.col("h"), 0.1, 1.0, 120.0).alias(m) for m in MODELS])


def morans_i(spark, d):
    return spatial.morans_i(src.sites(spark, d), 4)


def knn_edges(spark, d):
    return spatial.knn(src.sites(spark, d), 4)


def buffered_train_counts(spark, d):
    return spatial.outside_sums(src.sites(spark, d), RADII).select("site", "radius", F.col("n").cast("long").alias("n"))


def buffered_loo_mean(spark, d):
    return spatial.buffered_mean(src.sites(spark, d), [50.0])


def buffered_loo_simple_regression(spark, d):
    return spatial.buffered_line(src.sites(spark, d), [50.0])


def buffer_sweep(spark, d):
    p = spatial.buffered_mean(src.sites(spark, d), RADII)
    m = stats.sweep_metrics(p.where("predicted is not null"), "site", "radius", RADII, "v", "predicted")
    return m.select("radius", "n", "r2", "rmse", "mae")


def random_vs_buffered_inflation(spark, d):
    p = spatial.buffered_line(src.sites(spark, d), [0.0, 50.0])
    m = stats.regression_metrics(p.where("predicted is not null"), ["radius"], "v", "predicted", quartiles=False)
    wide = m.groupBy().agg(F.max(F.when(F.col("radius") == 0, F.col("r2"))).alias("r2_random"), F.max(F.when(F.col("radius") == 50, F.col("r2"))).alias("r2_buffered"))
    return wide.withColumn("inflation", F.col("r2_random") - F.col("r2_buffered"))


def buffer_recommendation(spark, d):
    cut = pairs.blocks(src.sites(spark, d), [], "site", ["x", "y", "u"])
    per = pairs.median_distance(cut, [], "site", ["x", "y"], "u").select(F.col("u").cast("int").alias("element"), F.col("far").alias("middle"))
    return per.select("element", "middle", F.least(F.lit(100), F.greatest(F.lit(20), F.coalesce(F.col("middle"), F.lit(50.0)).cast("int"))).alias("buffer"))


def _predicted(spark, d):
    return src.table(spark, d, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_quantity") * 1.5).alias("p"))


def regression_metrics(spark, d):
    return stats.regression_metrics(_predicted(spark, d), ["l_returnflag"])


def baseline_mean_r2(spark, d):
    df = _predicted(spark, d)
    means = df.groupBy("l_returnflag").agg(F.avg("y").alias("m"))
    joined = df.drop("p").join(F.broadcast(means), "l_returnflag").withColumnRenamed("m", "p")
    return stats.regression_metrics(joined, ["l_returnflag"]).select("l_returnflag", "n", (F.round("r2", 6) + 0.0).alias("r2"), "rmse")


def masked_huber_loss(spark, d):
    df = _predicted(spark, d).withColumn("y", F.when(F.col("y") > 20, F.col("y")))
    return df.groupBy("l_returnflag").agg(stats.huber("y", "p", 5.0).alias("loss"), F.count("y").alias("n"))


def mixup_partner_weights(spark, d):
    """Weights of every ordered pair; widths and totals come from blocks, so that the pairs are made once, as they go out."""
    s = src.sites(spark, d).select("site", "v")
    cut = pairs.blocks(s, [], "site", ["v"])
    width = pairs.median_distance(cut, [], "site", ["v"], positive=False).first()
    if width is None:
        return s.select(F.col("site").alias("i"), F.col("site").alias("j"), F.col("v").alias("weight")).where("false")
    total = spatial.settled(pairs.kernel_sums(cut, "site", {"v": width["far"] / 2}))
    left = s.join(total, "site").select(F.col("site").alias("i"), F.col("v").alias("vi"), F.col("r_v").alias("total"))
    left = left.repartition(16 * spark.sparkContext.defaultParallelism, "i")  # few rows that make many
    gap, bw = F.abs(F.col("vi") - F.col("vj")), F.lit(width["far"] / 2)
    return left.join(s.select(F.col("site").alias("j"), F.col("v").alias("vj")), F.col("i") != F.col("j")).select("i", "j", (F.exp(-gap * gap / (2 * bw * bw)) / F.col("total")).alias("weight"))


def band_stats_p2_p98(spark, d):
    return raster.band_stats(src.raster(spark, d), BANDS)


def normalised_pixels(spark, d):
    return raster.normalised(src.raster(spark, d), BANDS)


def rgb_stretch(spark, d):
    n = raster.normalised(src.raster(spark, d), ["b2", "b1", "b0"])
    wide = n.groupBy("row", "col").pivot("band", ["b2", "b1", "b0"]).agg((F.first("value") * 255))
    return wide.toDF("row", "col", "red", "green", "blue")


def tile_grid_stats(spark, d):
    t = raster.tiles(src.raster(spark, d), 32)
    return t.groupBy("tile_r", "tile_c").agg(F.count("*").alias("n"), F.avg("b4").alias("mean"), F.min("b4").alias("least"), F.max("b4").alias("most"))


def _window(window: int):
    return lambda spark, d: raster.window_stats(src.raster(spark, d), "b2", window)


def glcm_features(spark, d):
    px = src.raster(spark, d).select("row", "col", F.least(F.lit(15), F.floor(F.col("b4") / 0.005 * 15)).cast("int").alias("level"))
    return raster.glcm(px, "level", 32)


def tile_blend(spark, d):
    return raster.blend(src.raster(spark, d).select("row", "col", "b4"), "b4", 32, 8)


def map_stats(spark, d):
    px = src.raster(spark, d)
    long = px.unpivot([], BANDS, "band", "value").where("value <> 0")
    return raster.map_stats(long, ["band"], "value")


def nodata_masking(spark, d):
    px = src.raster(spark, d)
    valid = ~((F.col("b0") == 0) & (F.col("b1") == 0) & (F.col("b2") == 0) & (F.col("b3") == 0) & (F.col("b4") == 0))
    return px.select("row", "col", F.when(valid, 2.0 * F.col("b2") + F.col("b4")).alias("prediction"))


def point_pixels(spark, d):
    """Points by an affine transform on the pixel table."""
    s = src.sites(spark, d).select("site", F.floor((1000.0 - F.col("y")) / 15.0).cast("int").alias("row"), F.floor((F.col("x") - 0.0) / 15.0).cast("int").alias("col"))
    px = src.raster(spark, d)
    return s.where("row >= 0 and col >= 0").join(px, ["row", "col"])


def date_lookup(spark, d):
    """Dates to samplings by the first of the keys that a date's name contains."""
    keys = spark.createDataFrame([("1-URG", "first", 0), ("HIGH", "second", 1), ("LOW", "third", 2), ("E", "other", 3)], "k string, sampling string, priority int")
    o = src.table(spark, d, "orders").select("o_orderpriority").distinct()
    met = o.join(F.broadcast(keys), F.col("o_orderpriority").contains(F.col("k")), "left")
    return met.groupBy("o_orderpriority").agg(F.min_by("sampling", "priority").alias("sampling"))


def partial_correlation(spark, d):
    """Bands against price, given the size of the point."""
    df = src.band_points(spark, d)
    long = df.unpivot(["point_id", "date", "size", "price"], ["b", "g", "r", "e"], "feature", "x")
    return stats.partial_correlation(long, ["date", "feature"], "x", "price", "size")


def linear_importance(spark, d):
    return stats.linear_importance(feature_pairs(spark, d), ["date", "feature", "element"])


def target_scaler(spark, d):
    df = src.band_points(spark, d).select("date", F.when(F.col("n_obs") > 3, F.col("e")).alias("value"))
    return stats.target_scaler(df, ["date"], "value")


def mean_target_top20(spark, d):
    """Bands of the spectrum by their correlation with the mean of the targets: the label and the mean level."""
    df = src.spectra(spark, d).select("point_id", "spectrum", ((F.col("target") + spectra.mean(F.col("spectrum"))) / 2).alias("y"))
    r = stats.pearson(df.select("y", F.posexplode("spectrum").alias("band", "x")), ["band"]).select("band", F.round("r", 6).alias("r"))
    return r.orderBy(F.abs("r").desc(), "band").limit(20)


def inflation_summary(spark, d):
    """What folds at random promise over buffered folds: median, largest, and radii above 0.01."""
    p = spatial.buffered_line(src.sites(spark, d), RADII)
    m = stats.regression_metrics(p.where("predicted is not null"), ["radius"], "v", "predicted", quartiles=False).select("radius", "r2")
    base = m.where("radius = 0").select(F.col("r2").alias("base"))
    gap = m.where("radius > 0").join(F.broadcast(base)).withColumn("inflation", (F.col("base") - F.col("r2")))
    return gap.agg(F.median("inflation").alias("middle"), F.max("inflation").alias("most"), F.sum((F.col("inflation") > 0.01).cast("long")).alias("n_over"))


def kfold_line(spark, d):
    """One line over all dates; all dates of a point fall into one fold."""
    p = validation.kfold_line(src.band_points(spark, d), "point_id", "b", "e")
    return stats.regression_metrics(p, ["fold"], "y", "predicted", quartiles=False).select("fold", "n", "r2", "rmse", "mae")


def kfold_line_dates(spark, d):
    """The lines of every date, each date with folds of its own."""
    p = validation.kfold_line(src.band_points(spark, d), "point_id", "b", "e", by=("date",))
    return stats.regression_metrics(p, ["date", "fold"], "y", "predicted", quartiles=False).select("date", "fold", "n", "r2", "rmse", "mae")


def group_folds(spark, d):
    """Folds by sampling point: all dates of a point fall into one."""
    df = src.band_points(spark, d).select("point_id", "date", validation.fold_of("point_id").alias("fold"))
    return df.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("point_id").alias("points"))


def permutation_test(spark, d):
    return validation.permutation_test(src.sites(spark, d), "site", "u", "v", 199)


def overlapping_tiles(spark, d):
    return raster.overlapping_tiles(src.raster(spark, d), 64, 16)


def pass_statistics(spark, d):
    """Three passes with a shift each over the pixels."""
    px = src.raster(spark, d).where("b4 <> 0")
    passes = px.select("row", "col", F.explode(F.array(*[F.struct(F.lit(k).alias("pass"), (F.col("b4") * (1 + 0.1 * k)).alias("value")) for k in range(3)])).alias("s"))
    return raster.pass_statistics(passes.select("row", "col", "s.value"), ["row", "col"], "value")


def queries() -> dict:
    return {
        "band_pivot": band_pivot,
        "hyper_aggregate_min_bands": hyper_aggregate_min_bands,
        "sets_per_point": sets_per_point,
        "ms_indices_tier1": _tier(1),
        "ms_indices_tier2": _tier(2),
        "ms_indices_tier3": _tier(3),
        "ms_indices_eps_family": ms_indices_eps_family,
        "ms_indices_channels": ms_indices_channels,
        "index_catalogue": index_catalogue,
        "hyper_indices_all": hyper_indices_all,
        "snv_rows": _array(spectra.snv),
        "snv_eps_rows": _array(lambda s: spectra.snv(s, 1e-10)),
        "sg_smooth_rows": _array(spectra.savitzky_golay),
        "sg_derivative_rows": _array(lambda s: spectra.savitzky_golay(s, degree=2, order=1)),
        "finite_diff_deriv": _array(lambda s: spectra.finite_difference(s, W)),
        "band_subsample": _array(spectra.every),
        "noisy_band_removal": _array(lambda s: spectra.without_range(s, W)),
        "preprocess_pipeline": _array(lambda s: spectra.preprocess(s, W, ("smooth", "snv", "remove_noise"))),
        "red_edge_features": spectral_shape,
        "pearson_matrix": pearson_matrix,
        "spearman_matrix": spearman_matrix,
        "kendall_tau": kendall_tau,
        "distance_correlation": distance_correlation,
        "correlogram": correlogram,
        "top3_per_element": top3_per_element,
        "best_index_per_element": best_index_per_element,
        "corr_heatmap_pivot": corr_heatmap_pivot,
        "significance_labels": significance_labels,
        "category_ladder": category_ladder,
        "iqr_outlier_filter": iqr_outlier_filter,
        "zscore_features": zscore_features,
        "constant_feature_filter": constant_feature_filter,
        "median_impute": median_impute,
        "semivariogram": semivariogram,
        "variogram_models_eval": variogram_models_eval,
        "morans_i": morans_i,
        "knn_edges": knn_edges,
        "buffered_train_counts": buffered_train_counts,
        "buffered_loo_mean": buffered_loo_mean,
        "buffered_loo_simple_regression": buffered_loo_simple_regression,
        "buffer_sweep": buffer_sweep,
        "random_vs_buffered_inflation": random_vs_buffered_inflation,
        "buffer_recommendation": buffer_recommendation,
        "regression_metrics": regression_metrics,
        "baseline_mean_r2": baseline_mean_r2,
        "masked_huber_loss": masked_huber_loss,
        "mixup_partner_weights": mixup_partner_weights,
        "band_stats_p2_p98": band_stats_p2_p98,
        "normalised_pixels": normalised_pixels,
        "rgb_stretch": rgb_stretch,
        "tile_grid_stats": tile_grid_stats,
        "window_stats_w3": _window(3),
        "window_stats_w7": _window(7),
        "glcm_features": glcm_features,
        "tile_blend": tile_blend,
        "map_stats": map_stats,
        "nodata_masking": nodata_masking,
        "point_pixels": point_pixels,
        "date_lookup": date_lookup,
        "partial_correlation": partial_correlation,
        "linear_importance": linear_importance,
        "target_scaler": target_scaler,
        "mean_target_top20": mean_target_top20,
        "inflation_summary": inflation_summary,
        "kfold_line": kfold_line,
        "kfold_line_dates": kfold_line_dates,
        "group_folds": group_folds,
        "permutation_test": permutation_test,
        "overlapping_tiles": overlapping_tiles,
        "pass_statistics": pass_statistics,
    }
