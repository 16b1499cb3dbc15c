"""Models in closed form over sums: ridge outside buffers, variogram fits, partial least squares on moments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import near_pairs, variogram_value


def moments(columns: list[str]) -> dict:
    """Aggregates of count, sums and products of ``columns``."""
    out = {"n": F.count("*").cast("double")} | {f"s_{a}": F.sum(a) for a in columns}
    return out | {f"p_{a}_{b}": F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]}


def solved(gram: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many small systems, and which of them have one: the others stay 0."""
    size = np.abs(gram).max(axis=(1, 2))
    sound = (size > 0) & np.isfinite(size)
    sound[sound] = np.linalg.cond(gram[sound]) < 1e12
    out = np.zeros_like(xy)
    out[sound] = np.linalg.solve(gram[sound], xy[sound][..., None])[..., 0]
    return out, sound


def buffered_targets(points: DataFrame, features: list[str], targets: list[str], radius: float, penalty: float = 1.0, least: int = 10) -> DataFrame:
    """(site, target, n, y, predicted): ridge of every target on the sites at least ``radius`` away that have this target.

    Each target has moments of its own rows, so one that is missing somewhere
    takes no row from the others; all come from one reading of the near pairs.
    Fewer than ``least`` sites to learn from, or columns without a single
    answer, give null. A site without features is not predicted and teaches nothing.
    """
    whole = points
    for c in features:
        whole = whole.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    whole = whole.select("site", "x", "y", *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)], *[F.when(~F.isnan(F.col(t).cast("double")), F.col(t).cast("double")).alias(f"t{k}") for k, t in enumerate(targets)])
    p = len(features)

    def kinds(k: int, mark: str = "") -> dict:
        names = [*(f"f{i}" for i in range(p)), f"t{k}"]
        has = F.col(f"t{k}{mark}").isNotNull()
        value = lambda c: F.when(has, F.col(f"{c}{mark}"))
        return {f"{k}_n": F.when(has, 1.0)} | {f"{k}_s{i}": value(c) for i, c in enumerate(names)} | {f"{k}_p{i}_{j}": value(names[i]) * value(names[j]) for i in range(p + 1) for j in range(i, p + 1)}

    every = {name: c for k in range(len(targets)) for name, c in kinds(k).items()}
    total = whole.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(name) for name, c in every.items()]).first().asDict()
    near = near_pairs(whole, radius, ["site", "x", "y", *(f"f{i}" for i in range(p)), *(f"t{k}" for k in range(len(targets)))]).where(F.col("d") < radius)
    around = {name: c for k in range(len(targets)) for name, c in kinds(k, "2").items()}
    within = near.groupBy(F.col("site1").alias("site")).agg(*[F.sum(c).alias(f"w_{name}") for name, c in around.items()])
    base = whole.join(within, "site", "left")
    rest = [(F.lit(float(total[name])) - F.coalesce(c, F.lit(0.0)) - F.coalesce(F.col(f"w_{name}"), F.lit(0.0))).alias(name) for name, c in every.items()]
    base = base.select("site", *(f"f{i}" for i in range(p)), *(f"t{k}" for k in range(len(targets))), *rest)

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: E731, B023
            x = np.stack([get(f"f{i}") for i in range(p)], 1) if p else np.zeros((batch.num_rows, 0))
            for k, target in enumerate(targets):
                n = np.rint(get(f"{k}_n"))
                mean = np.stack([get(f"{k}_s{i}") for i in range(p + 1)], 1) / np.maximum(n, 1)[:, None]
                gram = np.zeros((len(n), p + 1, p + 1))
                for i in range(p + 1):
                    for j in range(i, p + 1):
                        gram[:, i, j] = gram[:, j, i] = get(f"{k}_p{i}_{j}") - n * mean[:, i] * mean[:, j]
                beta, sound = solved(gram[:, :p, :p] + penalty * np.eye(p), gram[:, :p, p])
                told = mean[:, p] + ((x - mean[:, :p]) * beta).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("site"), pa.array([target] * len(n)), pa.array(n.astype(np.int64)), batch.column(f"t{k}"), pa.array(told, mask=(n < least) | ~sound)], ["site", "target", "n", "y", "predicted"])

    return base.mapInArrow(run, f"site {points.schema['site'].dataType.simpleString()}, target string, n long, y double, predicted double")


def buffered_ridge(points: DataFrame, features: list[str], target: str, radius: float, penalty: float) -> DataFrame:
    """(site, n, v, predicted): ridge with an intercept on all sites at least ``radius`` away.

    Sums over all sites less those over the near ones are a site's training
    data, so no training set is made; a site is never its own. Where columns
    leave no single answer the prediction is null.
    """
    names = [*features, target]
    total = points.agg(*[f.alias(k) for k, f in moments(names).items()]).first().asDict()
    near = near_pairs(points, radius, ["site", "x", "y", *names]) if "x" not in features else near_pairs(points.withColumnRenamed("x", "px"), radius, ["site", "px", "y", *names])
    near = near.where(F.col("d") < radius).select(F.col("site1").alias("site"), *[F.col(f"{c}2").alias(c) for c in names])
    within = near.groupBy("site").agg(*[f.alias(k) for k, f in moments(names).items()])
    base = points.select("site", *names).join(within, "site", "left")
    own = {"n": F.lit(1.0)} | {f"s_{a}": F.col(a) for a in names} | {f"p_{a}_{b}": F.col(a) * F.col(b) for i, a in enumerate(names) for b in names[i:]}
    kinds = list(own)
    rest = base.select("site", *names, *[(F.lit(float(total[k] or 0)) - own[k] - F.coalesce(F.col(k), F.lit(0.0))).alias(k) for k in kinds])

    def run(batches):
        p = len(features)
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: E731, B023
            n = np.rint(get("n"))
            safe = np.maximum(n, 1)
            mean = np.stack([get(f"s_{c}") for c in names], 1) / safe[:, None]
            gram = np.zeros((len(n), p + 1, p + 1))
            for i, a in enumerate(names):
                for j in range(i, p + 1):
                    gram[:, i, j] = gram[:, j, i] = get(f"p_{a}_{names[j]}") - n * mean[:, i] * mean[:, j]
            beta, sound = solved(gram[:, :p, :p] + penalty * np.eye(p), gram[:, :p, p])
            own_x = np.stack([get(c) for c in features], 1)
            value = mean[:, p] + ((own_x - mean[:, :p]) * beta).sum(1)
            predicted = pa.array(value, mask=(n < 1) | ~sound)
            yield pa.RecordBatch.from_arrays([batch.column("site"), pa.array(n.astype(np.int64)), batch.column(target), predicted], ["site", "n", "v", "predicted"])

    return rest.mapInArrow(run, "site long, n long, v double, predicted double")


def fit_variogram(lags: DataFrame, steps: int = 20) -> DataFrame:
    """One row (model, nugget, partial_sill, range, rmse) for ``lags`` (distance, gamma), of which there are a dozen.

    For each model and each of ``steps`` ranges up to the last lag the least
    squares give nugget and sill, neither below 0; a range beyond 95 % of the
    last lag counts twice its error. Where gamma varies by less than 15 % of
    its mean there is only a nugget.
    """
    spark = lags.sparkSession
    far = lags.agg(F.max("distance").alias("far"), F.avg("gamma").alias("flat"), (F.max("gamma") - F.min("gamma")).alias("span"))
    grid = spark.range(1, steps + 1).select(F.col("id").alias("k")).withColumn("model", F.explode(F.array(*map(F.lit, ("spherical", "exponential", "gaussian")))))
    grid = grid.join(F.broadcast(far)).withColumn("reach", F.col("far") * F.col("k") / float(steps))
    h, reach = F.col("distance"), F.col("reach")
    unit = F.when(F.col("model") == "spherical", variogram_value("spherical", h, 0.0, 1.0, reach)).when(F.col("model") == "exponential", variogram_value("exponential", h, 0.0, 1.0, reach)).otherwise(variogram_value("gaussian", h, 0.0, 1.0, reach))
    met = F.broadcast(lags).join(grid).withColumn("f", unit)
    line = met.groupBy("model", "k").agg(F.greatest(F.lit(0.0), F.coalesce(F.regr_slope("gamma", "f"), F.lit(0.0))).alias("part"), F.avg("gamma").alias("m"), F.avg("f").alias("mf"))
    line = line.select("model", "k", "part", F.greatest(F.lit(0.0), F.col("m") - F.col("part") * F.col("mf")).alias("nugget"))
    miss = F.col("gamma") - F.col("nugget") - F.col("part") * F.col("f")
    fits = met.join(F.broadcast(line), ["model", "k"]).groupBy("model", "k", "reach", "nugget", "part", "flat", "span").agg((F.sqrt(F.avg(miss * miss)) * F.when(F.col("k") > 0.95 * steps, 2.0).otherwise(1.0)).alias("rmse"))
    best = fits.orderBy(F.round("rmse", 9), "model", "k").limit(1)
    flat = F.col("span") / F.col("flat") < 0.15
    return best.select(
        F.when(flat, "nugget").otherwise(F.col("model")).alias("model"), F.when(flat, F.col("flat")).otherwise(F.col("nugget")).alias("nugget"),
        F.when(flat, 0.0).otherwise(F.col("part")).alias("partial_sill"), F.when(flat, 0.0).otherwise(F.col("reach")).alias("range"), F.when(~flat, F.col("rmse")).alias("rmse"),
    )
