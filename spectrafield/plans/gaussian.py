"""Gaussian processes on inducing points: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gaussian, spatial, validation
from ..sources import tables as src
from . import oracle

FEATURES, TARGETS = ["b", "g", "r", "e"], ["size", "price"]
#: Points and lengths of the query of sums.
FEW, SHORT = 6, (1.0, 2.0)


def _rows(spark, d):
    return src.band_points(spark, d).select("point_id", "date", *FEATURES, *TARGETS, validation.fold_of("point_id").alias("fold"))


def gaussian_process(spark, d):
    """Both targets of every point and date, told with a deviation by the processes of the other folds."""
    rows = spatial.settled(_rows(spark, d))  # read four times
    _, outside = gaussian.fit(rows, FEATURES, TARGETS, ["point_id", "date"], "fold")
    told = gaussian.predict(rows, outside, "fold", ["point_id", "date", "fold", *TARGETS])
    y = F.when(F.col("target") == "size", F.col("size")).otherwise(F.col("price"))
    return told.select("point_id", "date", "fold", "target", y.alias("y"), "predicted", "deviation")


def gaussian_scores(spark, d):
    """(target, n, r2, rmse, covered): errors outside folds, and the share of values within 1.96 deviations."""
    error = F.col("y") - F.col("predicted")
    rows = gaussian_process(spark, d).where("predicted is not null")
    mean = F.avg(error * error)
    return rows.groupBy("target").agg(F.count("*").alias("n"), (1 - F.try_divide(mean, F.var_pop("y"))).alias("r2"), F.sqrt(mean).alias("rmse"), F.avg((F.abs(error) <= 1.96 * F.col("deviation")).cast("double")).alias("covered"))


def gaussian_products(spark, d):
    """The sums that processes are fitted on, for six points and two lengths."""
    rows = _rows(spark, d)
    middle, spread = gaussian.scale_of(rows, FEATURES)
    points = (gaussian.inducing_points(rows, FEATURES, ["point_id", "date"], FEW) - middle) / spread
    return gaussian.products(rows, FEATURES, ["size"], "fold", middle, spread, points, SHORT)


def queries() -> dict:
    return {f.__name__: f for f in (gaussian_process, gaussian_scores, gaussian_products)}


def oracle_sql() -> dict[str, str]:
    scale = ", ".join(f"avg({c}) m_{c}, stddev_pop({c}) s_{c}" for c in FEATURES)
    standard = ", ".join(f"({c} - m_{c}) / s_{c} {c}" for c in FEATURES)
    gap = " + ".join(f"(z.{c} - q.{c}) * (z.{c} - q.{c})" for c in FEATURES)
    lengths = ", ".join(f"({v!r}::double)" for v in SHORT)
    return {
        "gaussian_products": f"""with {oracle.POINTS}, sc as (select {scale} from pts), z as (select point_id, date, {oracle.FOLD} fold, size, {standard} from pts, sc),
 q as (select row_number() over (order by h, point_id, date) i, * from (select *, {oracle._hash("point_id::varchar || '.' || date")} h from z) order by h, point_id, date limit {FEW}),
 k as (select z.point_id, z.date, z.fold, z.size, length, list(exp(-({gap}) / (2 * length * length)) order by i) told from z, q, (values {lengths}) t(length) group by all),
 a as (select fold, length, list_concat(told, [size, 1::double]) a from k)
 select fold part, length, i, j, sum(a[i + 1] * a[j + 1]) c from a, (select unnest(range({FEW + 2})) i) x, (select unnest(range({FEW + 2})) j) y where i <= j group by 1, 2, 3, 4""",
    }
