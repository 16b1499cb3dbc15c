"""Running totals, ranks and rank statistics of columns of any length.

An order is cut into parts at approximate quantiles; each part sums its own rows,
and what the parts before it hold is added by a broadcast of one row a part. So
no window holds a whole column, and statistics over all pairs (Kendall's tau, the
distance correlation) take n log n rows instead of n squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows from which an order is cut into parts, and parts at most.
PART_ROWS, PARTS = 200_000, 1024


def part_of(value: Column, bounds: list[float]) -> Column:
    """How many of the ascending ``bounds`` lie below the value: binary search in an array."""
    if not bounds:
        return F.lit(0)
    table, steps = F.array(*map(F.lit, bounds)), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, s: F.when((low + s <= len(bounds)) & (F.try_element_at(table, low + s) < value), low + s).otherwise(low))


def bounds_of(rows: DataFrame, order: str, count: int) -> list[float]:
    """Where to cut ``order`` so that parts have about ``PART_ROWS`` rows; as many numbers as parts reach the driver."""
    parts = min(PARTS, count // PART_ROWS)
    return sorted(set(rows.stat.approxQuantile(order, [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []


def running(rows: DataFrame, by: list[str], order: list[str], totals: dict[str, Column], bounds: list[float]) -> DataFrame:
    """``rows`` with running totals (name -> summed column) along ``order`` within ``by``, the row itself included.

    ``bounds`` cut the first column of ``order``, so equal values share a part.
    """
    rows = rows.withColumn("_part", part_of(F.col(order[0]), bounds))
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *[F.sum(c).over(within).alias(f"_in_{k}") for k, c in totals.items()])
    if not bounds:
        return out.select(*[c for c in rows.columns if c != "_part"], *[F.col(f"_in_{k}").alias(k) for k in totals])
    sums = rows.groupBy(*by, "_part").agg(*[F.sum(c).alias(k) for k, c in totals.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "_part", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_to_{k}") for k in totals])
    out = out.join(before, [*by, "_part"])
    return out.select(*[c for c in rows.columns if c != "_part"], *[(F.col(f"_in_{k}") + F.col(f"_to_{k}")).alias(k) for k in totals])


def ranked_values(values: DataFrame, column: str, weight: str, count: int) -> DataFrame:
    """(column, w, c, s, place): the distinct values, their weight, weight and weighted sum up to each, and their place from 1."""
    distinct = values.groupBy(column).agg(F.sum(weight).alias("w"))
    w, v = F.col("w"), F.col(column)
    return running(distinct, [], [column], {"c": w, "s": w * v, "place": F.lit(1).cast("long")}, bounds_of(values, column, count))


def crossings(values: DataFrame, count: int) -> DataFrame:
    """One row (crossed, product) for ``values`` (x, y, k, yr): pairs that x and y order differently, and the sum of dx * dy over them.

    yr numbers the values of y; k is how often a row counts. At every bit of yr,
    rows that agree in all higher bits form a group along x; a row with the bit
    off crosses those before it with the bit on. Each pair is met at the highest
    bit that tells it apart, so there are as many rows as rows times bits.
    """
    last = values.agg(F.max("yr")).first()[0]
    bits = int(last).bit_length() if last is not None else 0
    bit = F.expr(f"explode(sequence(0, {max(bits, 1) - 1}))").alias("b")
    dealt = values.select("x", "y", "k", "yr", bit).select("x", "y", "k", "yr", "b", F.expr("shiftright(yr, b + 1)").alias("g"), F.expr("shiftright(yr, b) & 1").alias("on"))
    on = F.col("k") * F.col("on")
    sums = {"n1": on, "x1": on * F.col("x"), "y1": on * F.col("y"), "xy1": on * F.col("x") * F.col("y")}
    # totals hold the row itself, which is on or takes part: the two exclude each other
    met = running(dealt, ["b", "g"], ["x", "yr"], sums, bounds_of(values, "x", count)).where("on = 0")
    product = F.col("x") * F.col("y") * F.col("n1") - F.col("x") * F.col("y1") - F.col("y") * F.col("x1") + F.col("xy1")
    return met.agg(F.coalesce(F.sum(F.col("k") * F.col("n1")), F.lit(0)).alias("crossed"), F.coalesce(F.sum(F.col("k") * product), F.lit(0.0)).alias("product"))


def _weighted(values: DataFrame) -> tuple[DataFrame, int]:
    """Finite rows (x, y), equal ones once with their number k, and how many there are."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = values.where(finite("x") & finite("y")).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy("x", "y").agg(F.count("*").alias("k"))
    return rows, rows.count()


def kendall(values: DataFrame) -> DataFrame:
    """One row (n_pairs, tau) for ``values`` (x, y): tau-b, null if a column is constant."""
    rows, count = _weighted(values)
    places = ranked_values(rows, "y", "k", count).select("y", F.col("place").alias("yr"))
    met = crossings(rows.join(places, "y"), count)
    pairs = lambda k: F.coalesce(F.sum(F.col(k) * (F.col(k) - 1) / 2), F.lit(0.0))
    tied = lambda c, name: rows.groupBy(c).agg(F.sum("k").alias("w")).agg(pairs("w").alias(name))
    one = rows.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), pairs("k").alias("both")).join(tied("x", "tx")).join(tied("y", "ty")).join(met)
    whole = F.col("n") * (F.col("n") - 1) / 2
    s = whole - F.col("tx") - F.col("ty") + F.col("both") - 2 * F.col("crossed")
    return one.select(whole.cast("long").alias("n_pairs"), F.try_divide(s, F.sqrt((whole - F.col("tx")) * (whole - F.col("ty")))).alias("tau"))


def distance_correlation(values: DataFrame) -> DataFrame:
    """One row (n, dcor) for ``values`` (x, y): root of the distance covariance over the root of both distance variances.

    Row sums of distances come from running totals, the sum of products of
    distances from the crossings; 0 if a column is constant.
    """
    rows, count = _weighted(values)
    centre = rows.agg((F.sum(F.col("k") * F.col("x")) / F.sum("k")).alias("mx"), (F.sum(F.col("k") * F.col("y")) / F.sum("k")).alias("my"), F.sum("k").alias("n"))
    rows = rows.join(F.broadcast(centre)).select((F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), "k", "n")
    # a row's distances to all others: to those up to it and to those beyond
    def sums(c: str, name: str) -> DataFrame:
        at = ranked_values(rows, c, "k", count)
        total = rows.agg(F.sum(F.col("k") * F.col(c)).alias("all"), F.max("n").alias("m"))
        return at.join(F.broadcast(total)).select(c, (F.col(c) * (2 * F.col("c") - F.col("m")) + F.col("all") - 2 * F.col("s")).alias(name), *([F.col("place").alias("yr")] if c == "y" else []))

    whole = rows.join(sums("x", "a"), "x").join(sums("y", "b"), "y")
    met = crossings(whole.select("x", "y", "k", "yr"), count)
    k = F.col("k")
    of = {"sx": k * F.col("x"), "sy": k * F.col("y"), "sxy": k * F.col("x") * F.col("y"), "sxx": k * F.col("x") * F.col("x"), "syy": k * F.col("y") * F.col("y"), "ta": k * F.col("a"), "tb": k * F.col("b"), "ab": k * F.col("a") * F.col("b"), "aa": k * F.col("a") * F.col("a"), "bb": k * F.col("b") * F.col("b")}
    one = whole.agg(F.sum("k").alias("n"), *[F.sum(c).alias(name) for name, c in of.items()]).join(met)
    n = F.col("n").cast("double")
    centred = lambda squares, cross, left, right: squares / (n * n) - 2 * F.col(cross) / (n * n * n) + F.col(left) * F.col(right) / (n * n * n * n)
    both = centred(2 * (n * F.col("sxy") - F.col("sx") * F.col("sy") - 2 * F.col("product")), "ab", "ta", "tb")
    of_x, of_y = centred(2 * (n * F.col("sxx") - F.col("sx") * F.col("sx")), "aa", "ta", "ta"), centred(2 * (n * F.col("syy") - F.col("sy") * F.col("sy")), "bb", "tb", "tb")
    spread = F.when((of_x > 0) & (of_y > 0), F.sqrt(of_x * of_y))
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), F.sqrt(F.greatest(F.lit(0.0), both / spread)).alias("dcor"))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with each value's rank within ``by``, ties sharing the mean of theirs; ranks are of distinct values and join back."""
    distinct = df.groupBy(*by, value).agg(F.count("*").alias("_w"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = distinct.select(*by, value, (F.sum("_w").over(upto) - (F.col("_w") - 1) / 2.0).alias(name))
    return df.join(ranks, [*by, value])
