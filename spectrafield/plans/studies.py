"""Studies over a user's own tables: a configuration says what columns mean, the results are tables.

``Config`` is read from JSON (the first of several paths that is there) or
made in Python; each study takes DataFrames, returns named DataFrames, and knows
no table of its own.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions
from ..operators import forest, independence, models, ordered, spatial, stats, tuning, validation, variogram
from ..operators.selection import parted_moments
from ..sources import readers


@dataclass(frozen=True)
class Config:
    """Names of columns, limits and lists of a study."""

    point: str = "point_id"
    date: str = "date"
    x: str = "x"
    y: str = "y"
    elements: tuple[str, ...] = ()
    features: tuple[str, ...] = ()
    short_names: dict[str, str] = field(default_factory=dict)
    id_offsets: dict[str, int] = field(default_factory=dict)
    buffers: dict[str, float] = field(default_factory=dict)
    default_buffer: float = 50.0
    min_samples: int = 10
    alpha: float = 0.05
    top: int = 3
    folds: int = 5
    penalty: float = 1.0
    trees: int = 200
    depth: int = 8

    def short(self, element: str) -> str:
        """An element's short name, itself if it has none."""
        return self.short_names.get(element, element)

    def buffer(self, element: str) -> float:
        return float(self.buffers.get(element, self.default_buffer))


def load_config(spark: SparkSession, *paths: str) -> Config:
    """The configuration in the first of ``paths`` that is there; unknown names raise ``ValueError``."""
    path = readers.first_source(spark, list(paths))
    found = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    known = {f.name for f in fields(Config)}
    if unknown := sorted(set(found) - known):
        raise ValueError(f"unknown in {path}: {', '.join(unknown)}")
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


def labels(df: DataFrame, config: Config, element: str = "element") -> DataFrame:
    """``df`` with ``short_name`` of its elements, themselves where none is known."""
    if not config.short_names:
        return df.withColumn("short_name", F.col(element))
    names = df.sparkSession.createDataFrame(sorted(config.short_names.items()), f"{element} string, short_name string")
    return df.join(F.broadcast(names), element, "left").withColumn("short_name", F.coalesce("short_name", F.col(element)))


def _long(df: DataFrame, config: Config, columns: tuple[str, ...], name: str, value: str) -> DataFrame:
    if not columns:
        raise ValueError(f"the configuration names no {name}s")
    dated = df if config.date in df.columns else df.withColumn(config.date, F.lit("all"))
    dated = dated.select(F.col(config.point).alias("point_id"), F.col(config.date).cast("string").alias("date"), *[F.col(c).cast("double").alias(c) for c in columns])
    return stats.long_form(dated, ["point_id", "date"], list(columns), name, value)


def correlation_study(features: DataFrame, chemistry: DataFrame, config: Config) -> dict[str, DataFrame]:
    """``correlations``, ``top`` and ``heatmap`` of every feature with every element by date.

    ``features`` has a row a point and date, ``chemistry`` a row a point, or a
    point and date; points of a date get that date's offset first. Pairs with a
    missing side are left out, and groups of fewer than ``min_samples`` pairs.
    """
    x = _long(features, config, config.features, "feature", "x")
    if config.id_offsets:
        offsets = F.create_map(*[F.lit(v) for pair in config.id_offsets.items() for v in pair])
        x = x.withColumn("point_id", F.col("point_id") + F.coalesce(offsets[F.col("date")], F.lit(0)))
    dated = config.date in chemistry.columns
    y = _long(chemistry, config, config.elements, "element", "y")
    pairs = stats.pairs(x, y if dated else y.drop("date"), ["point_id", "date"] if dated else ["point_id"])
    keys = ["date", "feature", "element"]
    r = stats.pearson(pairs, keys, config.min_samples)
    rho = stats.spearman(pairs, keys, config.min_samples).drop("n")
    both = r.join(rho, keys).withColumn("p", distributions.correlation_p(F.col("r"), F.col("n"))).withColumn("rho_p", distributions.correlation_p(F.col("rho"), F.col("n")))
    both = labels(both, config).withColumn("label", stats.significance_label(F.col("p"), config.alpha)).withColumn("category", stats.category(F.col("r2"), F.col("p")))
    wide = both.withColumn("column", F.concat_ws(" | ", "date", "short_name")).groupBy("feature").pivot("column").agg(F.first("r"))
    return {"correlations": both, "top": stats.top_n(both, ["date", "element"], "r", "feature", config.top), "heatmap": wide}


def dependence_study(features: DataFrame, chemistry: DataFrame, config: Config, feature: str, element: str) -> dict[str, DataFrame]:
    """``profile``: one pair in every measure, Pearson, Spearman, Kendall, the distance correlation and kernel independence, with p where it has one."""
    one = Config(**{**config.__dict__, "features": (feature,), "elements": (element,)})
    pairs = stats.pairs(_long(features, one, one.features, "feature", "x"), _long(chemistry, one, one.elements, "element", "y").drop("date"), ["point_id"]).select(F.concat_ws("|", "point_id", "date").alias("id"), "x", "y")
    r = pairs.agg(F.count("*").alias("n"), stats.pearson_of("x", "y").alias("r"))
    ranked = ordered.average_ranks(ordered.average_ranks(pairs, [], "x", "rx"), [], "y", "ry").agg(stats.pearson_of("rx", "ry").alias("rho"))
    tau, far = stats.kendall_p(pairs).select("tau", F.col("p").alias("tau_p")), ordered.distance_correlation(pairs).select("dcor")
    kernel = independence.hsic_test(pairs).select("hsic", F.col("p").alias("hsic_p"))
    row = r.join(ranked).join(tau).join(far).join(kernel)
    p = lambda c: distributions.correlation_p(F.col(c), F.col("n"))
    return {"profile": row.select(F.lit(feature).alias("feature"), F.lit(element).alias("element"), "n", "r", p("r").alias("r_p"), "rho", p("rho").alias("rho_p"), "tau", "tau_p", "dcor", "hsic", "hsic_p")}


def _placed(chemistry: DataFrame, places: DataFrame, config: Config) -> DataFrame:
    at = places.select(F.col(config.point).alias("site"), F.col(config.x).cast("double").alias("x"), F.col(config.y).cast("double").alias("y"))
    return chemistry.withColumnRenamed(config.point, "site").join(at, "site")


def variogram_study(chemistry: DataFrame, places: DataFrame, config: Config) -> dict[str, DataFrame]:
    """``lags``, ``fits`` and ``buffers`` of every element by date."""
    joined = _placed(chemistry.drop(config.x, config.y), places, config)
    joined = joined if config.date in joined.columns else joined.withColumn(config.date, F.lit("all"))
    long = joined.select("site", F.col(config.date).cast("string").alias("date"), "x", "y", *[F.col(c).cast("double").alias(c) for c in config.elements]).unpivot(["site", "date", "x", "y"], list(config.elements), "element", "v")
    lags = variogram.empirical(long, ["element", "date"])
    fits = variogram.fit(lags, ["element", "date"])
    return {"lags": lags, "fits": fits, "buffers": labels(variogram.recommended_buffers(fits), config)}


def buffered_study(rows: DataFrame, places: DataFrame, config: Config) -> dict[str, DataFrame]:
    """``predictions`` of every element outside its own buffer, their ``metrics``, and ``neighbours`` (Moran's I).

    ``rows`` has the features and elements of every point, once a point.
    """
    joined = _placed(rows.drop(config.x, config.y), places, config)
    told = None
    for element in config.elements:
        one = models.buffered_targets(joined, list(config.features), [element], config.buffer(element), config.penalty, config.min_samples)
        one = one.withColumn("buffer_m", F.lit(config.buffer(element)))
        told = one if told is None else told.unionByName(one)
    if told is None:
        raise ValueError("the configuration names no elements")
    told = told.withColumnRenamed("target", "element")
    metrics = stats.regression_metrics(told.where("y is not null and predicted is not null"), ["element", "buffer_m"], "y", "predicted")
    first = config.elements[0]
    moran = spatial.morans_i(joined.select("site", "x", "y", F.col(first).cast("double").alias("v")).where("v is not null"), 8)
    return {"predictions": told, "metrics": labels(metrics, config), "neighbours": moran.select(F.lit(first).alias("element"), "*")}


def model_study(rows: DataFrame, config: Config) -> dict[str, DataFrame]:
    """``candidates``: every linear candidate and the forest for every element, by folds of points.

    ``rows`` has the features and elements of every point; a point's rows share a fold.
    """
    spark, found = rows.sparkSession, []
    folded = rows.withColumn("_fold", validation.fold_of(config.point, config.folds))
    features = list(config.features)
    for element in config.elements:
        parts = parted_moments(folded, F.array(*[F.col(c).cast("double") for c in [*features, element]]), F.col("_fold"))
        for model in tuning.MODELS:
            found += [(element, model, str(list(p)), rmse, r2) for p, rmse, r2 in tuning.curve(parts, model)]
        grown = forest.fit(folded.withColumn("_out", F.array("_fold")).withColumn("_key", F.xxhash64(*features, element)), "_key", features, element, out="_out", folds=config.folds, trees=config.trees, depth=config.depth)
        told = forest.predict(folded.where(F.col(element).isNotNull()), grown, fold="_fold").where("predicted is not null")
        m = stats.regression_metrics(told, [], element, "predicted").first()
        found.append((element, "forest", str([config.trees, config.depth]), m["rmse"], m["r2"]))
    return {"candidates": labels(spark.createDataFrame(found, "element string, model string, parameters string, rmse double, r2 double"), config)}


def write(tables: dict[str, DataFrame], out: str, kind: str = "csv", digits: int = 6) -> list[str]:
    """Write a study's tables under ``out``; their paths."""
    paths = []
    for name, df in tables.items():
        paths.append(f"{out}/{name}.{kind}")
        readers.write_table(df, paths[-1], digits)
    return paths
