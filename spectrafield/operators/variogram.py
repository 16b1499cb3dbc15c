"""Variograms by element and date: outliers cut, binned lags, bounded least squares, and the buffers that follow.

Pairs are of one survey's sites, which is what a variogram is defined over; a
survey's lags are a dozen numbers, and each is fitted in a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairs
from .stats import without_outliers

#: Lags up to the median distance; pairs that a lag needs, sites that a survey needs.
LAGS, LEAST_PAIRS, LEAST_SITES = 12, 2, 10
#: Below this share of their mean the lags are flat; beyond this share of the largest range a fit is at its bound.
FLAT, EDGE = 0.15, 0.95
#: Buffers in metres: without a range, and the bounds of all others.
DEFAULT, LOW, HIGH = 50, 20, 100
MODELS = ("spherical", "exponential", "gaussian")


def empirical(points: DataFrame, by: list[str], lags: int = LAGS) -> DataFrame:
    """(by, lag, distance, gamma, n_pairs) for points (by, site, x, y, v): half the mean squared difference by distance.

    Values beyond three interquartile ranges of the quartiles are cut, surveys
    of fewer than ten sites have no row. Lags divide the median of the positive
    distances evenly; a lag's distance is its middle. Missing values are left
    out; sites at one place form no pair.
    """
    fine = without_outliers(points.where(F.col("v").isNotNull() & ~F.isnan("v")), by, "v")
    enough = fine.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_SITES).select(*by)
    fine = fine.join(enough, by, "left_semi")
    cut = pairs.blocks(fine.select(*by, "site", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "v")]), by, "site", ["x", "y", "v"])
    far = pairs.median_distance(cut, by, "site", ["x", "y"])
    out = pairs.lag_sums(cut, by, "site", far, lags, mean=False).where(F.col("n_pairs") >= LEAST_PAIRS).join(far, by)
    return out.select(*by, "lag", ((F.col("lag") - 0.5) * F.col("far") / lags).alias("distance"), (F.try_divide("square", "n_squares") / 2).alias("gamma"), "n_pairs")


def shape(model: str, h: np.ndarray, reach: float) -> np.ndarray:
    """The rise from 0 to 1 of a model with range ``reach``."""
    u = h / reach
    if model == "spherical":
        return np.where(u <= 1, 1.5 * u - 0.5 * u**3, 1.0)
    return 1 - np.exp(-3 * (u if model == "exponential" else u**2))


def bounded_line(f: np.ndarray, g: np.ndarray, most: float, steepest: float) -> tuple[float, float, float]:
    """(nugget, partial sill, squared error) of least squares g = nugget + sill * f with 0 <= nugget <= most, 0 <= sill <= steepest.

    The least of the free solution and of those along each bound that lie inside the others.
    """
    n, sf, sg, sff, sfg, sgg = len(f), f.sum(), g.sum(), (f * f).sum(), (f * g).sum(), (g * g).sum()
    tries, det = [], n * sff - sf * sf
    if det > 1e-14 * max(1.0, n * sff):
        tries.append(((sff * sg - sf * sfg) / det, (n * sfg - sf * sg) / det))
    for a in (0.0, most):
        tries.append((a, min(max((sfg - a * sf) / sff if sff > 0 else 0.0, 0.0), steepest)))
    for b in (0.0, steepest):
        tries.append((min(max((sg - b * sf) / n, 0.0), most), b))
    best = None
    for a, b in tries:
        if -1e-12 <= a <= most * (1 + 1e-12) and -1e-12 <= b <= steepest * (1 + 1e-12):
            miss = g - a - b * f
            error = float((miss * miss).sum())
            if best is None or error < best[2]:
                best = (max(a, 0.0), max(b, 0.0), error)
    return best


def best_range(model: str, h: np.ndarray, g: np.ndarray, grid: int = 200, rounds: int = 80) -> tuple[float, float, float, float]:
    """(range, nugget, partial sill, squared error): for a given range the rest is linear, so only the range is searched.

    A grid finds the valley, golden sections its bottom; ranges lie between a
    tenth of the first lag and the last.
    """
    top = float(g.max())
    low, high = float(h.min()) * 0.1, float(h.max())
    error = lambda r: bounded_line(shape(model, h, r), g, top, 2 * top)[2]
    places = np.linspace(low, high, grid)
    k = int(np.argmin([error(r) for r in places]))
    a, b, cut = places[max(k - 1, 0)], places[min(k + 1, grid - 1)], (np.sqrt(5) - 1) / 2
    x, y = b - cut * (b - a), a + cut * (b - a)
    ex, ey = error(x), error(y)
    for _ in range(rounds):
        if ex <= ey:
            b, y, ey = y, x, ex
            x = b - cut * (b - a)
            ex = error(x)
        else:
            a, x, ex = x, y, ey
            y = a + cut * (b - a)
            ey = error(y)
    reach = min((float(x), float(places[k])), key=error)
    return reach, *bounded_line(shape(model, h, reach), g, top, 2 * top)


def fitted(h: np.ndarray, g: np.ndarray) -> dict | None:
    """The best model of a survey's lags; None for fewer than three."""
    if len(h) < 3:
        return None
    mean = float(g.mean())
    if mean > 0 and (g.max() - g.min()) / mean < FLAT:
        return {"model": "pure_nugget", "nugget": mean, "partial_sill": 0.0, "total_sill": mean, "range_m": None, "fit_rmse": 0.0, "note": "pure nugget"}
    best = None
    for model in MODELS:
        reach, nugget, sill, error = best_range(model, h, g)
        rmse = float(np.sqrt(error / len(h))) * (2 if reach > EDGE * h.max() else 1)
        if best is None or rmse < best["fit_rmse"]:
            best = {"model": model, "nugget": nugget, "partial_sill": sill, "total_sill": nugget + sill, "range_m": reach, "fit_rmse": rmse, "note": ""}
    return best


def fit(lags: DataFrame, by: list[str]) -> DataFrame:
    """(by, model, nugget, partial_sill, total_sill, range_m, nugget_ratio, fit_rmse, note) of ``empirical``'s lags.

    Nugget and sill are bounded by the largest lag and its double, the range by
    the last lag; a range at that bound counts twice its error. Flat lags are
    pure nugget without a range; surveys of fewer than three lags have no row.
    """
    names = ["model", "nugget", "partial_sill", "total_sill", "range_m", "nugget_ratio", "fit_rmse", "note"]
    kinds = [pa.string(), *[pa.float64()] * 6, pa.string()]

    def of(key, table):
        order = np.argsort(table.column("distance").to_numpy(), kind="stable")
        found = fitted(table.column("distance").to_numpy()[order], table.column("gamma").to_numpy()[order])
        rows = [found | {"nugget_ratio": found["nugget"] / found["total_sill"] if found["total_sill"] > 0 else None}] if found else []
        keys = {b: table.column(b).slice(0, len(rows)).combine_chunks() for b in by}
        return pa.table(keys | {n: pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)})

    types = ", ".join(f"{b} {lags.schema[b].dataType.simpleString()}" for b in by)
    return lags.select(*by, "distance", "gamma").groupBy(*by).applyInArrow(of, types + ", model string, nugget double, partial_sill double, total_sill double, range_m double, nugget_ratio double, fit_rmse double, note string")


def recommended_buffers(fits: DataFrame, element: str = "element") -> DataFrame:
    """(element, recommended_buffer_m, global_buffer_m, note): the median of an element's ranges over its dates, within bounds.

    Elements without a range get the default; the global buffer is the median
    of all elements' buffers, without fraction.
    """
    good = F.when(F.col("range_m") > 0, F.col("range_m"))
    per = fits.groupBy(element).agg(F.median(good).alias("middle"), F.min("nugget_ratio").alias("least"))  # a handful of dates each
    inside = F.least(F.greatest(F.col("middle"), F.lit(float(LOW))), F.lit(float(HIGH))).cast("int")
    buffer = F.when(F.col("middle").isNotNull(), inside).otherwise(DEFAULT)
    note = F.when(F.col("middle").isNull(), "no range").when(F.col("least") > 0.9, "pure nugget").when(F.col("middle") > 200, "cut").otherwise("")
    per = per.select(element, buffer.alias("recommended_buffer_m"), note.alias("note"))
    return per.join(F.broadcast(per.agg(F.median("recommended_buffer_m").cast("int").alias("global_buffer_m")))).select(element, "recommended_buffer_m", "global_buffer_m", "note")
