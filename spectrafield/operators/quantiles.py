"""Exact quantiles of groups of any size, without a buffer of a group's values.

Values are counted once (equal ones are one row), the counts are put into a
histogram of equal bins between a group's ends, and only bins that hold a wanted
rank are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bins of a group's histogram.
BINS = 4096


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: Sequence[float], bins: int = BINS) -> DataFrame:
    """(by, n, q): the quantiles of each group's finite values, what ``percentile`` returns for them, as one array.

    Between two ranks values are interpolated. Groups without a finite value
    have no row. Repeated values cost one row. State is a histogram of ``bins``
    a group; the sort of one bin's distinct values may spill.
    """
    keys = by or ["_all"]
    finite = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf"))
    rows = (df if by else df.withColumn("_all", F.lit(0))).where(finite)
    counts = rows.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    ends = counts.groupBy(*keys).agg(F.sum("_k").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # the bin rises with the value: differences, quotients and products of doubles do
    bin_ = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins))).otherwise(0)
    binned = counts.join(ends, keys).select(*keys, "_v", "_k", "n", bin_.cast("int").alias("_bin"))
    filled = binned.groupBy(*keys, "_bin").agg(F.sum("_k").alias("_k"), F.max("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.withColumn("_end", F.sum("_k").over(upto)).withColumn("_begin", F.col("_end") - F.col("_k"))
    wish = []
    for i, p in enumerate(probabilities):
        at = (F.col("n") - 1) * F.lit(float(p))
        wish += [F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank(at).cast("long").alias("rank"), at.alias("at")) for side, rank in enumerate((F.floor, F.ceil))]
    targets = filled.withColumn("_w", F.explode(F.array(*wish))).where((F.col("_w.rank") >= F.col("_begin")) & (F.col("_w.rank") < F.col("_end")))
    targets = targets.select(*keys, "_bin", "n", "_w.i", "_w.side", "_w.at", (F.col("_w.rank") - F.col("_begin")).alias("_rank"))
    within = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    wanted = binned.join(targets.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi").select(*keys, "_bin", "_v", "_k", F.sum("_k").over(within).alias("_to"))
    hit = wanted.join(targets, [*keys, "_bin"]).where((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_k")))
    side = lambda i, s: F.max(F.when((F.col("i") == i) & (F.col("side") == s), F.col("_v")))
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("at")))
    found = hit.groupBy(*keys, "n").agg(*[side(i, s).alias(f"_{i}_{s}") for i in range(len(probabilities)) for s in (0, 1)], *[at(i).alias(f"_{i}_at") for i in range(len(probabilities))])

    def quantile(i: int):
        low, high, place = F.col(f"_{i}_0"), F.col(f"_{i}_1"), F.col(f"_{i}_at")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(*by, "n", F.array(*[quantile(i) for i in range(len(probabilities))]).alias("q"))
