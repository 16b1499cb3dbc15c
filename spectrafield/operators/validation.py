"""Validation of models over folds and permutations.

Models are least-squares lines in closed form, so that a fold's model is the
totals less the fold's own sums: one grouped pass serves all folds.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import normal_below, normal_quantile
from .ordered import bounds_of, running


def hash_number(*parts: Column | str) -> Column:
    """32 bits of the MD5 digest of the parts, joined by dots: alike on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(".", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def fold_of(key: str, folds: int = 5, seed: int = 42) -> Column:
    """Fold 0 .. folds - 1 of a key: rows of one key, such as a group of replicates, share it."""
    return F.pmod(hash_number(F.col(key).cast("string"), F.lit(str(seed))), F.lit(folds)).cast("int")


def kfold_line(df: DataFrame, key: str, x: str, y: str, folds: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, fold, y, predicted): y by a line on x, fitted on the other folds of the same ``by``."""
    rows = df.select(*by, F.col(key), fold_of(key, folds).alias("fold"), F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    sums = {"n": F.count("*").cast("double"), "sx": F.sum("x"), "sy": F.sum("y"), "sxx": F.sum(F.col("x") * F.col("x")), "sxy": F.sum(F.col("x") * F.col("y"))}
    per = rows.groupBy(*by, "fold").agg(*[c.alias(k) for k, c in sums.items()])  # one row a group and fold
    total = per.groupBy(*by).agg(*[F.sum(k).alias(f"t_{k}") for k in sums])
    rest = per.join(F.broadcast(total), list(by) or None).select(*by, "fold", *[(F.col(f"t_{k}") - F.col(k)).alias(k) for k in sums])
    slope = F.coalesce(F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")), F.lit(0.0))
    line = rest.select(*by, "fold", slope.alias("a"), F.try_divide(F.col("sy") - slope * F.col("sx"), "n").alias("b"))
    return rows.join(F.broadcast(line), [*by, "fold"]).select(*by, key, "fold", "y", (F.col("a") * F.col("x") + F.col("b")).alias("predicted"))


def _dealt(rows: DataFrame, by: list[str], permutations: int) -> DataFrame:
    """(by, p, r2) of rows (by, k, x, y) for every permutation p: x in the order of k meets y in the order of a hash of k, p and by.

    Only y is copied and ordered anew, a permutation in a group of its own; places of x are numbered once. Spark does
    not count what an explosion adds and would broadcast the copies, so the join says which side to build: the numbered rows.
    """
    numbered = rows.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("k")).alias("i"), "x")
    copies = rows.select(*by, "k", "y", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("p"))
    at = hash_number(F.col("k").cast("string"), F.col("p").cast("string"), *[F.col(c) for c in by])
    dealt = copies.select(*by, "p", "y", F.row_number().over(Window.partitionBy(*by, "p").orderBy(at, "k")).alias("i"))
    return dealt.join(numbered.hint("shuffle_hash"), [*by, "i"]).groupBy(*by, "p").agg(_rounded_r2().alias("drawn"))


def _rounded_r2() -> Column:
    return F.round(F.pow(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")), 2), 9)


def permutation_test(points: DataFrame, key: str, x: str, y: str, permutations: int = 99) -> DataFrame:
    """One row (n, r2, n_permutations, p): share of permutations whose r2 reaches the observed.

    Values are dealt anew by the order of a hash of key and permutation. A
    permutation is one group: the work is a survey's points times permutations.
    """
    rows = points.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    observed = rows.agg(F.count("*").alias("n"), _rounded_r2().alias("r2"))
    drawn = _dealt(rows, [], permutations)
    return drawn.join(F.broadcast(observed)).groupBy("n", "r2").agg(F.count("*").alias("n_permutations"), F.avg((F.col("drawn") >= F.col("r2")).cast("double")).alias("p"))


def permutation_targets(points: DataFrame, key: str, target: str, x: str, y: str, permutations: int = 199) -> DataFrame:
    """(target, n, r2, n_permutations, p) for long targets, each dealt anew on its own.

    p is (1 + permutations that reach the observed r2) / (1 + permutations), so
    it is never 0. A target's permutation is one group.
    """
    rows = points.select(F.col(target).alias(target), F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    observed = rows.groupBy(target).agg(F.count("*").alias("n"), _rounded_r2().alias("r2"))
    drawn = _dealt(rows, [target], permutations)
    reached = F.sum((F.col("drawn") >= F.col("r2")).cast("int"))
    return drawn.join(observed, target).groupBy(target, "n", "r2").agg(F.count("*").alias("n_permutations"), ((reached + 1) / (F.count("*") + 1.0)).alias("p"))


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (hash_number(*parts) + 0.5) / float(1 << 32)


def beta_draw(alpha: float, *parts: Column | str, tries: int = 16) -> Column:
    """A draw of the symmetric beta distribution: the first of some hashed pairs of powers whose sum is at most 1, else the half."""
    pair = lambda k: F.struct(F.pow(uniform(*parts, F.lit(f"u{k}")), F.lit(1 / alpha)).alias("a"), F.pow(uniform(*parts, F.lit(f"v{k}")), F.lit(1 / alpha)).alias("b"))
    first = F.get(F.filter(F.array(*map(pair, range(tries))), lambda p: (p["a"] + p["b"] <= 1) & (p["a"] + p["b"] > 0)), F.lit(0))
    return F.coalesce(first["a"] / (first["a"] + first["b"]), F.lit(0.5))


def mixup(rows: DataFrame, key: str, columns: list[str], alpha: float = 0.3, share: float = 1.0, seed: int = 42) -> DataFrame:
    """(i, a, b, share, columns): as many mixtures as ``share`` of the rows, each of two rows drawn by hash.

    A mixture is ``share`` times the row a and the rest times the row b, in
    every column; a and b are keys, which are distinct and numeric. Rows with a
    missing column are not drawn.
    """
    whole = rows.select(F.col(key).alias("_key"), *columns)
    for c in columns:
        whole = whole.where(F.col(c).isNotNull())
    n = whole.count()
    numbered = running(whole, [], ["_key"], {"i": F.lit(1).cast("long")}, bounds_of(whole, "_key", n))
    word = F.col("i").cast("string")
    pick = lambda side: hash_number(word, F.lit(str(seed)), F.lit(side)) % max(n, 1) + 1
    drawn = numbered.where(F.col("i") <= int(n * share)).select("i", pick("a").alias("ia"), pick("b").alias("ib"), beta_draw(alpha, word, F.lit(str(seed))).alias("share"))
    side = lambda m: numbered.select(F.col("i").alias(f"i{m}"), F.col("_key").alias(m), *[F.col(c).alias(f"{c}_{m}") for c in columns])
    met = drawn.join(side("a"), "ia").join(side("b"), "ib")
    return met.select("i", "a", "b", "share", *[(F.col("share") * F.col(f"{c}_a") + (1 - F.col("share")) * F.col(f"{c}_b")).alias(c) for c in columns])


def with_noise(df: DataFrame, by: list[str], keys: list[str], value: str, share: float = 0.02) -> DataFrame:
    """``df`` and ``noisy``: the value plus normal noise of ``share`` of its deviation within ``by``.

    The noise follows from a hash of the keys, so that a lost task draws the same again.
    """
    spread = df.groupBy(*by).agg(F.stddev_pop(value).alias("_s"))
    even = lambda tag: (hash_number(*[F.col(k).cast("string") for k in keys], F.lit(tag)) + 0.5) / 4294967296.0
    normal = F.sqrt(F.lit(-2.0) * F.log(even("u"))) * F.cos(F.lit(2.0) * F.pi() * even("v"))
    return df.join(spread, by).select(*df.columns, (F.col(value) + F.lit(share) * F.col("_s") * normal).alias("noisy"))


def spatial_folds(points: DataFrame, key: str, x: str = "x", y: str = "y", folds: int = 5, seed: int = 42) -> DataFrame:
    """(key, fold, holdout): folds are clusters of neighbouring points; the one farthest from the points' centre is the holdout."""
    rows = points.select(F.col(key), F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x is not null and _y is not null")
    placed = rows.select("*", F.col("_x").cast("double").alias("a"), F.col("_y").cast("double").alias("b"))
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="at").transform(placed)
    model = KMeans(k=folds, seed=seed, featuresCol="at", predictionCol="fold").fit(vectors)
    middle = rows.agg(F.avg("_x").alias("mx"), F.avg("_y").alias("my")).first()
    centres = model.clusterCenters()
    far = max(range(len(centres)), key=lambda i: (centres[i][0] - middle["mx"]) ** 2 + (centres[i][1] - middle["my"]) ** 2)
    return model.transform(vectors).select(key, "fold", (F.col("fold") == far).alias("holdout"))


def bootstrap_r2(df: DataFrame, key: str, y: str, predicted: str, by: list[str], draws: int = 2000, alpha: float = 0.05) -> DataFrame:
    """(by, n, r2, below, acceleration, low, high): bias-corrected and accelerated bootstrap interval of R2.

    A place of a draw takes the row that the hash of both numbers tells. R2
    without a row follows from the sums, so the jackknife is one pass. Pairs with
    a missing or NaN side are left out; fewer than 5 have no interval. A group's rows
    are numbered, ties by value, and drawn ``draws`` times over.
    """
    e, whole = F.col("y") - F.col("p"), Window.partitionBy(*by)
    rows = df.select(*by, F.col(key).alias("k"), F.col(y).alias("y"), F.col(predicted).alias("p")).where("y is not null and p is not null and not isnan(y) and not isnan(p)")
    placed = rows.select(*by, "y", "p", (F.row_number().over(whole.orderBy("k", "y", "p")) - 1).alias("i"), F.count("*").over(whole).alias("n"))
    fit = lambda sse, sst: 1 - F.try_divide(sse, sst)
    spread = placed.groupBy(*by).agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.sum(e * e).alias("sse"), (F.var_pop("y") * F.count("*")).alias("sst"))
    apart = F.col("y") - F.col("m")
    left_out = placed.drop("n").join(spread, by).select(*by, fit(F.col("sse") - e * e, F.col("sst") - apart * apart * F.try_divide(F.col("n"), F.col("n") - 1)).alias("jk"))
    mean = left_out.groupBy(*by).agg(F.avg("jk").alias("mj"))
    d = F.col("mj") - F.col("jk")
    lean = left_out.join(mean, by).groupBy(*by).agg((F.sum(d * d * d) / (6 * F.pow(F.sum(d * d), 1.5) + 1e-12)).alias("acceleration"))
    slots = placed.where("n >= 5").select(*by, "i", "n").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    taken = slots.select(*by, "draw", F.pmod(hash_number(F.col("draw").cast("string"), F.col("i").cast("string")), F.col("n")).cast("int").alias("i"))
    # Spark does not count what the explosion adds and would broadcast the draws: the rows are the side to build
    drawn = taken.join(placed.select(*by, "i", "y", "p").hint("shuffle_hash"), [*by, "i"]).groupBy(*by, "draw").agg(fit(F.sum(e * e), F.var_pop("y") * F.count("*")).alias("b"))
    point = spread.select(*by, "n", fit(F.col("sse"), F.col("sst")).alias("r2"))
    all_draws = drawn.groupBy(*by).agg(F.array_sort(F.collect_list("b")).alias("b"))  # at most ``draws`` numbers a group
    known = point.join(lean, by).join(all_draws, by, "left").withColumn("below", F.try_divide(F.size(F.filter("b", lambda b: b < F.col("r2") - 1e-12)), F.size("b")))
    known = known.withColumn("z", normal_quantile(F.col("below")))

    def bound(tail: float) -> Column:
        moved = F.col("z") + NormalDist().inv_cdf(tail)
        at = normal_below(F.col("z") + F.try_divide(moved, 1 - F.col("acceleration") * moved)) * (F.size("b") - 1)
        low = F.floor(at).cast("int")
        first, second = F.get("b", low), F.get("b", F.least(low + 1, F.size("b") - 1))
        return F.when(F.size("b") > 0, first + (at - low) * (second - first))

    return known.select(*by, "n", "r2", F.when(F.size("b") > 0, F.col("below")).alias("below"), "acceleration", bound(alpha / 2).alias("low"), bound(1 - alpha / 2).alias("high"))
