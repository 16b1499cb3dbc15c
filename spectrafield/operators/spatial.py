"""Spatial operators on point tables (site, x, y, v).

Pairs are of one survey's sites. Where a radius is known, pairs come from an
equi-join on grid cells of that size and their neighbours, so that the work
follows the pairs that are near, not the square of the sites.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _side(points: DataFrame, mark: str, columns: list[str]) -> DataFrame:
    return points.select(*[F.col(c).alias(f"{c}{mark}") for c in columns])


def distance(mark1: str = "1", mark2: str = "2") -> Column:
    dx, dy = F.col(f"x{mark1}") - F.col(f"x{mark2}"), F.col(f"y{mark1}") - F.col(f"y{mark2}")
    return F.sqrt(dx * dx + dy * dy)


def near_pairs(points: DataFrame, radius: float, columns: list[str]) -> DataFrame:
    """Ordered pairs of different sites nearer than or at ``radius``: columns with marks 1 and 2, and d."""
    cell = lambda df, m: df.withColumns({"cx": F.floor(F.col(f"x{m}") / radius), "cy": F.floor(F.col(f"y{m}") / radius)})
    a = cell(_side(points, "1", columns), "1")
    around = F.sequence(F.lit(-1), F.lit(1))
    b = cell(_side(points, "2", columns), "2").withColumn("ox", F.explode(around)).withColumn("oy", F.explode(around))
    b = b.select(*[f"{c}2" for c in columns], (F.col("cx") + F.col("ox")).alias("cx"), (F.col("cy") + F.col("oy")).alias("cy"))
    return a.join(b, ["cx", "cy"]).where("site1 <> site2").withColumn("d", distance()).where(F.col("d") <= radius).drop("cx", "cy")


def all_pairs(points: DataFrame, columns: list[str]) -> DataFrame:
    """Unordered pairs of a survey's sites, for statistics that are defined over all of them."""
    return _side(points, "1", columns).join(_side(points, "2", columns), F.col("site1") < F.col("site2")).withColumn("d", distance())


def semivariogram(points: DataFrame, lags: int = 12) -> DataFrame:
    """(lag, distance, gamma, n_pairs); lags divide the median of the positive distances."""
    from . import pairs  # which settles its blocks by this module

    cut = pairs.blocks(points.select("site", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "v")]), [], "site", ["x", "y", "v"])
    sums = pairs.lag_sums(cut, [], "site", pairs.median_distance(cut, [], "site", ["x", "y"]), lags)
    n = F.col("n_pairs")
    return sums.where(n >= 2).select("lag", (F.col("d") / n).alias("distance"), (F.try_divide("square", "n_squares") / 2).alias("gamma"), "n_pairs")


def variogram_value(model: str, h: Column, nugget: float, sill: float, reach: float) -> Column:
    """Spherical, exponential or gaussian model at lag h."""
    part = sill - nugget
    if model == "spherical":
        return F.when(h < reach, nugget + part * (1.5 * h / reach - 0.5 * (h / reach) * (h / reach) * (h / reach))).otherwise(F.lit(float(sill)))
    if model == "exponential":
        return nugget + part * (1 - F.exp(-3 * h / reach))
    if model == "gaussian":
        return nugget + part * (1 - F.exp(-3 * (h / reach) * (h / reach)))
    raise ValueError(f"unknown model: {model}")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder that executors share: plans of rounds do not nest. A session without one, as in tests, gets its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def knn(points: DataFrame, k: int = 8) -> DataFrame:
    """(i, j, d, place): the k nearest other sites of each, ties to the smaller id.

    Sites are compared in blocks of near ones. Of sites at one place only the k + 1
    smallest ids can be among anyone's nearest, and only these are compared; the
    others have the k smallest for neighbours. Sites without a place have none.
    """
    from . import nearest  # which settles its blocks by this module

    at = points.select("site", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    first = Window.partitionBy("x", "y").orderBy("site")
    known = settled(at.withColumn("_p", F.row_number().over(first)).where(F.col("_p") <= k + 1).drop("_p"))
    found = nearest.nearest(known, [], "site", k).select("site", F.posexplode("near").alias("place", "n")).select(F.col("site").alias("i"), "n.j", "n.d", (F.col("place") + 1).alias("place"))
    crowded = known.groupBy("x", "y").agg(F.array_sort(F.collect_list("site")).alias("js")).where(F.size("js") > k)  # k + 1 each
    rest = at.join(known.select("site"), "site", "left_anti").join(crowded, ["x", "y"])
    return found.unionByName(rest.select(F.col("site").alias("i"), F.posexplode(F.slice("js", 1, k)).alias("place", "j")).select("i", "j", F.lit(0.0).alias("d"), (F.col("place") + 1).alias("place")))


def neighbour_edges(points: DataFrame, k: int = 8) -> DataFrame:
    """Symmetrised k-nearest-neighbour edges (i, j)."""
    edges = knn(points, k).select("i", "j")
    return edges.union(edges.select("j", "i")).distinct()


def morans_i(points: DataFrame, k: int = 8) -> DataFrame:
    """One row (n, s0, moran, expected, z) over symmetric neighbour weights."""
    edges = neighbour_edges(points, k)
    centre = points.agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    z = points.join(F.broadcast(centre)).select("site", (F.col("v") - F.col("m")).alias("z"), "n")
    cross = edges.join(z.select(F.col("site").alias("i"), F.col("z").alias("zi")), "i").join(z.select(F.col("site").alias("j"), F.col("z").alias("zj")), "j")
    top = cross.agg(F.sum(F.col("zi") * F.col("zj")).alias("top"), F.count("*").cast("double").alias("s0"))
    degree = edges.groupBy("i").agg(F.count("*").alias("k")).agg(F.sum(4.0 * F.col("k") * F.col("k")).alias("s2"))
    below = z.agg(F.sum(F.col("z") * F.col("z")).alias("below"), F.max("n").cast("double").alias("n"))
    one = top.join(below).join(degree).withColumn("s1", 2 * F.col("s0"))
    n, s0 = F.col("n"), F.col("s0")
    expected = -1 / (n - 1)
    variance = (n * n * F.col("s1") - n * F.col("s2") + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - expected * expected
    moran = F.try_divide(n * F.col("top"), s0 * F.col("below"))
    return one.select(F.col("n").cast("long").alias("n"), s0.alias("s0"), moran.alias("moran"), expected.alias("expected"), F.try_divide(moran - expected, F.sqrt(F.when(variance > 0, variance))).alias("z"))


def outside_sums(points: DataFrame, radii: list[float]) -> DataFrame:
    """For every site and radius the sums over all sites at least that far: (site, radius, n, su, sv, suu, suv).

    The site itself never counts. Totals less what lies within the radius: only near pairs are made.
    """
    spark = points.sparkSession
    sums = {"n": F.count("*"), "su": F.sum("u"), "sv": F.sum("v"), "suu": F.sum(F.col("u") * F.col("u")), "suv": F.sum(F.col("u") * F.col("v"))}
    total = points.agg(*[f.alias(f"t_{k}") for k, f in sums.items()])
    reach = spark.createDataFrame([(float(r),) for r in radii], "radius double")  # a handful of radii
    most = max(max(radii), 1e-9)
    near = near_pairs(points, most, ["site", "x", "y", "u", "v"]).join(F.broadcast(reach), F.col("d") < F.col("radius"))
    within = near.groupBy(F.col("site1").alias("site"), "radius").agg(
        F.count("*").alias("w_n"), F.sum("u2").alias("w_su"), F.sum("v2").alias("w_sv"), F.sum(F.col("u2") * F.col("u2")).alias("w_suu"), F.sum(F.col("u2") * F.col("v2")).alias("w_suv")
    )
    base = points.select("site", "u", "v").join(F.broadcast(reach)).join(F.broadcast(total)).join(within, ["site", "radius"], "left")
    own = {"n": F.lit(1), "su": F.col("u"), "sv": F.col("v"), "suu": F.col("u") * F.col("u"), "suv": F.col("u") * F.col("v")}
    return base.select("site", "radius", "u", "v", *[(F.col(f"t_{k}") - own[k] - F.coalesce(f"w_{k}", F.lit(0))).alias(k) for k in sums])


def buffered_mean(points: DataFrame, radii: list[float]) -> DataFrame:
    """(site, radius, v, n, predicted): the mean of the sites outside the buffer."""
    return outside_sums(points, radii).select("site", "radius", "v", "n", F.try_divide("sv", "n").alias("predicted"))


def buffered_line(points: DataFrame, radii: list[float]) -> DataFrame:
    """(site, radius, v, n, predicted): v by a least-squares line on u over the sites outside the buffer, in closed form."""
    n, su, sv = F.col("n"), F.col("su"), F.col("sv")
    slope = F.try_divide(n * F.col("suv") - su * sv, n * F.col("suu") - su * su)
    return outside_sums(points, radii).withColumn("slope", F.coalesce(slope, F.lit(0.0))).select(
        "site", "radius", "v", "n", (F.try_divide(sv - F.col("slope") * su, n) + F.col("slope") * F.col("u")).alias("predicted")
    )
