"""Relations among many columns at once, from their cross-products.

The rows are read twice, for the means and for the centred cross-products; a
task sends one number for each pair of columns, and Spark adds them up. What
reaches the driver has columns squared numbers, however many rows there are.
Rows with a missing or non-finite value are left out whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nearest
from .spatial import settled

#: Columns beyond which cross-products do not belong on the driver.
MOST_COLUMNS = 1000


class Moments(NamedTuple):
    """Number of complete rows, means, centred cross-products."""

    n: int
    mean: np.ndarray
    cross: np.ndarray


def moments(df: DataFrame, values: Column) -> Moments:
    """Moments of the places of an array column; arrays have one length."""
    complete = df.select(values.cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    found = complete.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.count("*").alias("n")).orderBy("at").limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    if not found:
        return Moments(0, np.zeros(0), np.zeros((0, 0)))
    mean = np.array([r["m"] for r in found])
    width = len(mean)
    upper = np.triu_indices(width)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, width) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], ["i", "j", "c"])

    sums = complete.mapInArrow(products, "i long, j long, c double").groupBy("i", "j").agg(F.sum("c").alias("c")).toPandas()
    cross = np.zeros((width, width))
    cross[sums["i"], sums["j"]] = sums["c"]
    cross[sums["j"], sums["i"]] = sums["c"]
    return Moments(found[0]["n"], mean, cross)


class Latent(NamedTuple):
    """Partial least squares: weights and explained part by component, and the line in the columns' own units."""

    weights: np.ndarray
    explained: np.ndarray
    coefficients: np.ndarray
    intercept: float


def partial_least_squares(m: Moments, components: int = 10) -> Latent:
    """The last column by latent components of the others, all of them scaled to unit deviation.

    Scores are never formed: a component's score products follow from the
    cross-products, which are deflated in their place. Constant columns weigh nothing.
    """
    scale = np.sqrt(np.diag(m.cross))
    scale = np.where(scale > 0, scale, 1.0)
    unit = m.cross / np.outer(scale, scale)
    xx, xy = unit[:-1, :-1].copy(), unit[:-1, -1].copy()
    weights, loadings, slopes, explained = [], [], [], []
    for _ in range(min(components, m.n - 1, len(xy))):
        length = np.linalg.norm(xy)
        if length < 1e-12:
            break
        w = xy / length
        spread = w @ xx @ w
        p, q = xx @ w / spread, w @ xy / spread
        xy = xy - p * (q * spread)
        xx = xx - np.outer(p, p) * spread
        weights.append(w), loadings.append(p), slopes.append(q), explained.append(q * q * spread)
    if not weights:
        return Latent(np.zeros((0, len(xy))), np.zeros(0), np.zeros(len(xy)), float(m.mean[-1]))
    w, p = np.array(weights), np.array(loadings)
    line = w.T @ np.linalg.solve(p @ w.T, np.array(slopes)) * scale[-1] / scale[:-1]
    return Latent(w, np.array(explained), line, float(m.mean[-1] - line @ m.mean[:-1]))


def importance_in_projection(model: Latent) -> np.ndarray:
    """Root of a column's mean squared weight by what each component explains; 1 is the average column."""
    if not len(model.explained):
        return np.zeros(model.weights.shape[1])
    return np.sqrt(model.weights.shape[1] * (model.explained @ model.weights**2) / model.explained.sum())


def predicted(model: Latent, values: Column) -> Column:
    """The model's line as an expression on an array of its columns."""
    line = F.array(*[F.lit(float(c)) for c in model.coefficients])
    return F.aggregate(F.zip_with(values, line, lambda a, b: a * b), F.lit(model.intercept), lambda total, x: total + x)


def successive_projections(m: Moments, select: int = 20) -> list[int]:
    """Columns in the order of choice: the most variable, then always the one farthest from the span of those chosen."""
    if not m.n:
        return []
    left = m.cross + m.n * np.outer(m.mean, m.mean)
    chosen = [int(np.argmax(np.diag(m.cross)))]
    while len(chosen) < min(select, len(m.mean)):
        last = chosen[-1]
        if left[last, last] <= 0:
            break
        left = left - np.outer(left[:, last], left[:, last]) / left[last, last]
        rest = np.diag(left).copy()
        rest[chosen] = -np.inf
        chosen.append(int(np.argmax(rest)))
    return chosen


def principal_components(m: Moments, share: float = 0.95) -> list[tuple[int, float, float, float]]:
    """(component, variance, share, cumulative share) of the fewest components that explain more than ``share``."""
    values = np.clip(np.linalg.eigvalsh(m.cross)[::-1], 0, None)
    if not values.sum():
        return []
    parts = values / values.sum()
    total = np.cumsum(parts)
    keep = min(int(np.searchsorted(total, share, side="right")) + 1, len(values))
    return [(i + 1, float(values[i] / max(m.n - 1, 1)), float(parts[i]), float(total[i])) for i in range(keep)]


def canonical_correlations(m: Moments, left: int, components: int = 3) -> list[float]:
    """Correlations of the best combinations of the first ``left`` columns and of the others, strongest first."""
    count = min(components, left, len(m.mean) - left, m.n - 2)
    if count < 1:
        return []

    def root(block: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(block)
        good = values > 1e-12 * values.max()
        return vectors[:, good] / np.sqrt(values[good])

    a, b = root(m.cross[:left, :left]), root(m.cross[left:, left:])
    return [float(min(r, 1.0)) for r in np.linalg.svd(a.T @ m.cross[:left, left:] @ b, compute_uv=False)[:count]]


def digamma(count: Column) -> Column:
    """Digamma of whole numbers of 1 or more: harmonic sums up to 32, the asymptotic series beyond."""
    small = F.aggregate(F.when(count > 1, F.sequence(F.lit(1), count.cast("int") - 1)).otherwise(F.array().cast("array<int>")), F.lit(-np.euler_gamma), lambda a, i: a + F.lit(1.0) / i)
    square = count.cast("double") * count
    series = F.log(count) - F.lit(0.5) / count - (F.lit(1 / 12) - (F.lit(1 / 120) - F.lit(1 / 252) / square) / square) / square
    return F.when(count <= 32, small).otherwise(series)


def mutual_information(df: DataFrame, by: list[str], neighbours: int = 5) -> DataFrame:
    """(by, n, mi): nearest-neighbour estimate of the information that x and y share, in nats, 0 at least.

    ``df`` holds id, x and y; ids are unique within ``by``. Both are scaled to
    unit deviation, and distance is the larger of the two differences. No noise is added, so
    that ties count as they are. Groups of fewer than ``neighbours`` + 1 points have no
    row. Neighbours come from blocks of near points, counts along either column
    from its sorted blocks: no pair of points is a row.
    """
    clean = df.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(*by, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    spread = clean.groupBy(*by).agg(F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.count("*").alias("n"))
    one = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
    spread = spread.where(F.col("n") > neighbours).select(*by, "n", one("sx").alias("sx"), one("sy").alias("sy"))
    unit = clean.join(spread, by)  # differences are scaled, not values, so that ties stay ties
    near = nearest.nearest(unit.drop("n"), by, "id", neighbours, scaled=True, named=False)
    reach = near.select(*by, "id", "x", "y", F.col("near")[neighbours - 1]["d"].alias("far")).join(spread, by)
    within = nearest.counts_within(settled(reach), by, "id").join(spread.select(*by, "n"), by)
    psi = within.select(*by, "n", (digamma(F.col("nx")) + digamma(F.col("ny"))).alias("s"))
    return psi.groupBy(*by, "n").agg(F.avg("s").alias("s")).select(*by, "n", F.greatest(F.lit(0.0), digamma(F.col("n")) + digamma(F.lit(neighbours)) - F.col("s")).alias("mi"))
