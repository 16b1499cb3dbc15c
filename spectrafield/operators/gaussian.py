"""Gaussian processes on inducing points, for several targets and folds at once.

A task turns its rows into kernels between each row and a bounded set of points,
and adds up the products of these kernels, of the targets and of ones. The sums,
by fold and length of the kernel, are all that a fit needs: what is known outside
a fold is the sum of the other folds, noise and amplitude are searched on the
sums, and so is the length. Rows are read three times (means, products,
predictions), however many candidates there are. State is bounded by folds x
lengths x points squared, never by rows. Where every row is a point, this is the
full Gaussian process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..shipping import ship
from .validation import hash_number

#: Lengths of the kernel in standard deviations of the features.
LENGTHS = (0.5, 1.0, 2.0, 4.0, 8.0)
#: Share of the largest below which a direction of the points' own kernel is left out: rounding would decide it.
SMALLEST = 1e-10
#: Bounds of the noise's variance over the kernel's.
NOISE = (1e-6, 1e4)
#: Numbers that all sums of products hold, at most.
MOST_NUMBERS = 1 << 23
NUMBERS = ArrayType(DoubleType())


class Process(NamedTuple):
    """What one target is told by: ``basis`` turns kernels to the points into independent directions."""

    length: float
    noise: float  # variance of the noise over ``amplitude``
    amplitude: float
    mean: float
    basis: np.ndarray
    weights: np.ndarray
    known: np.ndarray
    worth: float  # lower bound of the log likelihood


@dataclass
class Model:
    """Processes of all targets over standardised features."""

    features: list[str]
    targets: list[str]
    middle: np.ndarray
    spread: np.ndarray
    points: np.ndarray
    processes: list[Process]

    def tell(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, targets) of expected values and of standard deviations of a new measurement, noise included."""
        z = (x - self.middle) / self.spread
        told, sure = np.empty((len(x), len(self.targets))), np.empty((len(x), len(self.targets)))
        for j, p in enumerate(self.processes):
            at = kernel(z, self.points, p.length) @ p.basis
            told[:, j] = p.mean + at @ p.weights
            sure[:, j] = np.sqrt(p.amplitude * (np.maximum(0.0, 1 - (at * at) @ p.known) + p.noise))
        return told, sure


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of both."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    return np.exp(-gaps(a, b) / (2 * length * length))


def _best(worth, low: float, high: float, steps: int = 60) -> float:
    """Where ``worth`` is largest: the best of a grid, then golden sections between its neighbours."""
    grid = np.linspace(low, high, 47)
    at = int(np.argmax([worth(v) for v in grid]))
    a, b = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
    share = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        c, d = b - share * (b - a), a + share * (b - a)
        a, b = (a, d) if worth(c) >= worth(d) else (c, b)
    return (a + b) / 2


def process(sums: np.ndarray, points: np.ndarray, target: int, length: float) -> Process:
    """The process of one target of greatest worth at a length, from the products of (points, targets, one).

    For a noise over amplitude the best amplitude is known in closed form, so
    only the noise is searched. The worth is the bound that holds for any choice
    of points: the likelihood on the points less what they leave untold.
    """
    m = len(points)
    n, mean = sums[-1, -1], sums[m + target, -1] / sums[-1, -1]
    square = sums[m + target, m + target] - n * mean * mean
    w, u = np.linalg.eigh(kernel(points, points, length))
    keep = w > w[-1] * SMALLEST
    root = u[:, keep] / np.sqrt(w[keep])
    lam, v = np.linalg.eigh(root.T @ sums[:m, :m] @ root)
    lam, basis = np.maximum(lam, 0.0), root @ v
    c = basis.T @ (sums[:m, m + target] - mean * sums[:m, -1])
    if square <= 1e-12 * max(1.0, n * mean * mean):  # a constant is told by its mean
        return Process(length, 0.0, 0.0, float(mean), basis, np.zeros(len(c)), np.zeros(len(c)), float("-inf"))
    left = max(n - lam.sum(), 0.0)

    def amplitude(r: float) -> float:
        return max((square - (c * c / (lam + r)).sum()) / (r * n), 1e-300)

    def worth(log_r: float) -> float:
        r = np.exp(log_r)
        return float(-0.5 * (n * (np.log(2 * np.pi) + np.log(amplitude(r)) + 1 + log_r) + np.log1p(lam / r).sum()) - left / (2 * r))

    found = _best(worth, *np.log(NOISE))
    r = float(np.exp(found))
    return Process(length, r, amplitude(r), float(mean), basis, c / (lam + r), lam / (lam + r), worth(found))


def whole_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        v = F.col(c).cast("double")
        rows = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows


def scale_of(rows: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the features, 1 where constant."""
    one = rows.agg(*[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    spread = np.array([one[f"s{i}"] or 0.0 for i in range(len(features))])
    return np.array([one[f"m{i}"] or 0.0 for i in range(len(features))]), np.where(spread > 1e-12, spread, 1.0)


def inducing_points(rows: DataFrame, features: list[str], key: list[str], most: int) -> np.ndarray:
    """Features of the ``most`` rows whose key has the least hash: a bounded sample that does not depend on partitions."""
    h = hash_number(*[F.col(k).cast("string") for k in key])
    picked = rows.orderBy(h, *key).limit(most).select(*[F.col(c).cast("double") for c in features]).collect()
    return np.array([tuple(r) for r in picked], float).reshape(len(picked), len(features))


def products(rows: DataFrame, features: list[str], targets: list[str], part: str, middle: np.ndarray, spread: np.ndarray, points: np.ndarray, lengths: tuple[float, ...]) -> DataFrame:
    """(part, length, i, j, c): sums over rows of the products of two of (kernels to the points, targets, 1), for i <= j.

    ``points`` are standardised. Each task sends one number a cell, so the
    exchange grows with tasks, not rows.
    """
    width, d = len(points) + len(targets) + 1, len(features)
    upper = np.triu_indices(width)
    ship(rows.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, d + len(targets))
            z, parts = (v[:, :d] - middle) / spread, batch.column(0).to_numpy()
            order = np.argsort(parts, kind="stable")
            z, v, parts = z[order], v[order], parts[order]
            names, begins = np.unique(parts, return_index=True)
            apart = gaps(z, points)  # once for all lengths
            told = np.column_stack((apart, v[:, d:], np.ones(len(v))))
            for length in lengths:
                told[:, : len(points)] = np.exp(apart / (-2 * length * length))
                for p, begin, end in zip(names.tolist(), begins, [*begins[1:], len(parts)], strict=True):
                    mine = told[begin:end]
                    total[p, length] = total.get((p, length), 0.0) + mine.T @ mine
        for (p, length), t in total.items():
            columns = [np.full(len(upper[0]), p), np.full(len(upper[0]), length), upper[0], upper[1], t[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "length", "i", "j", "c"])

    arrays = F.array(*[F.col(c).cast("double") for c in [*features, *targets]])
    told = rows.select(F.col(part).cast("long").alias("part"), arrays.alias("v")).mapInArrow(sums, "part long, length double, i long, j long, c double")
    return told.groupBy("part", "length", "i", "j").agg(F.sum("c").alias("c"))


def fit(rows: DataFrame, features: list[str], targets: list[str], key: list[str], part: str, inducing: int = 128, lengths: tuple[float, ...] = LENGTHS) -> tuple[Model | None, dict[int, Model]]:
    """(model of all rows, fold -> model of the other folds).

    key: columns that tell rows apart; they choose the points, by hash.
    part: whole numbers of at most some tens of folds. Rows with a missing or
    infinite number or without a fold are left out; without rows the model is
    None, and so there is no model outside an only fold. Features are
    standardised over all rows, targets are centred outside each fold.
    """
    whole = whole_rows(rows, [*features, *targets]).where(F.col(part).isNotNull())
    middle, spread = scale_of(whole, features)
    points = (inducing_points(whole, features, key, inducing) - middle) / spread
    if not len(points):
        return None, {}
    width = len(points) + len(targets) + 1
    folds = whole.select(part).distinct().count()
    if folds * len(lengths) * width * (width + 1) // 2 > MOST_NUMBERS:
        raise ValueError(f"more than {MOST_NUMBERS} sums: take fewer points, lengths or folds")
    found = products(whole, features, targets, part, middle, spread, points, lengths).toPandas()
    told: dict[int, dict[float, np.ndarray]] = {}
    for (p, length), cells in found.groupby(["part", "length"]):
        s = np.zeros((width, width))
        s[cells["i"], cells["j"]] = cells["c"]
        s[cells["j"], cells["i"]] = cells["c"]
        told.setdefault(int(p), {})[length] = s

    def of(parts: list[int]) -> Model:
        total = {length: sum(told[p][length] for p in parts) for length in lengths}
        best = [max((process(total[length], points, j, length) for length in lengths), key=lambda p: p.worth) for j in range(len(targets))]
        return Model(list(features), list(targets), middle, spread, points, best)

    return of(list(told)), {p: of([q for q in told if q != p]) for p in told if len(told) > 1}


def predict(rows: DataFrame, models: dict[int, Model], part: str, keep: list[str]) -> DataFrame:
    """(keep, target, predicted, deviation): each row told by the model of its ``part``; missing where a feature or the model is.

    ``keep`` are columns of ``rows``, none of them named like a new one.
    """
    one = next(iter(models.values()))
    d = len(one.features)
    ship(rows.sparkSession)
    kept = rows.select(*keep, F.col(part).cast("long").alias("_part"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in one.features]).alias("_x"))
    schema = kept.drop("_part", "_x").schema.add("_told", NUMBERS).add("_sure", NUMBERS)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(len(keep) + 1).flatten()).reshape(batch.num_rows, d)
            parts = batch.column(len(keep)).to_numpy(zero_copy_only=False)
            told, sure = np.full((2, len(x), len(one.targets)), np.nan)
            for p, model in models.items():
                mine = (parts == p) & np.isfinite(x).all(1)
                if mine.any():
                    told[mine], sure[mine] = model.tell(x[mine])
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(one.targets))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel(), mask=np.isnan(v.ravel()))) for v in (told, sure)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *lists], [*keep, "_told", "_sure"])

    wide = kept.mapInArrow(tell, schema)
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, one.targets)).alias("t"), F.col("_told").alias("a"), F.col("_sure").alias("s")))
    return wide.select(*keep, each.alias("_e")).select(*keep, F.col("_e")["t"].alias("target"), F.col("_e")["a"].alias("predicted"), F.col("_e")["s"].alias("deviation"))
