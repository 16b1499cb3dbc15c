"""Spectrum functions: arrays in, arrays out, all as higher-order expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.try_divide(_sum(values), F.size(values))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambdas would compute it again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def deviation(values: Column) -> Column:
    """Population standard deviation."""
    return bound(mean(values), lambda m: F.sqrt(mean(F.transform(values, lambda x: (x - m) * (x - m)))))


def snv(values: Column, padding: float | None = None) -> Column:
    """Row z-score. A zero deviation counts as 1, or ``padding`` is added to every one."""

    def scaled(v: Column) -> Column:
        def by(p: Column) -> Column:
            below = F.when(p["s"] == 0, 1.0).otherwise(p["s"]) if padding is None else p["s"] + padding
            return bound(below, lambda q: F.transform(v, lambda x: (x - p["m"]) / q))

        return bound(F.struct(mean(v).alias("m"), deviation(v).alias("s")), by)

    return bound(values, scaled)


def finite_difference(values: Column, wavelengths: list[float]) -> Column:
    """Step over wavelength step, the last repeated."""
    gaps = F.array(*[F.lit(b - a + 1e-10) for a, b in zip(wavelengths, wavelengths[1:], strict=False)])
    n = F.size(values)
    steps = F.zip_with(F.slice(values, F.lit(2), n - 1), F.slice(values, F.lit(1), n - 1), lambda b, a: b - a)
    slopes = F.zip_with(steps, gaps, lambda s, g: s / g)
    return F.concat(slopes, F.slice(slopes, F.lit(-1), F.lit(1)))


def every(values: Column, step: int = 5) -> Column:
    return F.filter(values, lambda x, i: i % step == 0)


def without_range(values: Column, wavelengths: list[float], low: float = 925, high: float = 975) -> Column:
    """Without the bands from low to high, both included."""
    gone = F.array(*[F.lit(low <= w <= high) for w in wavelengths])
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), gone.alias("gone")), lambda x: ~x["gone"]), lambda x: x["v"])


def smoothing_matrix(window: int = 11, degree: int = 2, order: int = 0) -> np.ndarray:
    """Least-squares polynomial weights: row k evaluates the fit of a window at its k-th place."""
    window += 1 - window % 2
    x = np.arange(window) - window // 2
    powers = np.vander(x, degree + 1, increasing=True).astype(float)
    fit = np.linalg.pinv(powers)
    out = np.zeros((window, window))
    for p in range(order, degree + 1):
        factor = np.prod([p - i for i in range(order)]) if order else 1
        out += factor * np.outer(x.astype(float) ** (p - order), fit[p])
    return out


def savitzky_golay(values: Column, window: int = 11, degree: int = 2, order: int = 0) -> Column:
    """Smoothing, or a derivative over unit steps; at the ends the outermost window's polynomial is evaluated."""
    matrix = smoothing_matrix(window, degree, order)
    window, half = len(matrix), len(matrix) // 2
    rows = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in matrix])

    def smoothed(v: Column) -> Column:
        n = F.size(v)

        def at(i: Column) -> Column:
            start = F.greatest(F.lit(0), F.least(i - half, n - window))
            part = F.slice(v, start + 1, F.lit(window))
            return _sum(F.zip_with(part, F.element_at(rows, i - start + 1), lambda a, b: a * b))

        return F.when(n >= window, F.transform(F.sequence(F.lit(0), n - 1), at))

    return bound(values, smoothed)


def preprocess(values: Column, wavelengths: list[float], steps: tuple[str, ...]) -> Column:
    """Ordered steps out of smooth, deriv1, deriv2, snv, remove_noise; what is missing or not finite ends as 0."""
    for step in steps:
        match step:
            case "smooth":
                values = savitzky_golay(values)
            case "deriv1":
                values = savitzky_golay(values, degree=2, order=1)
            case "deriv2":
                values = savitzky_golay(values, degree=3, order=2)
            case "snv":
                values = snv(values)
            case "remove_noise":
                values = without_range(values, wavelengths)
            case _:
                raise ValueError(f"unknown step: {step}")
    return F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def between(values: Column, wavelengths: list[float], low: float, high: float) -> Column:
    """The bands from low to high, both included."""
    at = [i for i, w in enumerate(wavelengths) if low <= w <= high]
    return F.slice(values, F.lit(at[0] + 1), F.lit(len(at))) if at else F.array().cast("array<double>")


def trapezoid(values: Column, step: float) -> Column:
    """Area under evenly spaced values."""
    n = F.size(values)
    return step * (_sum(values) - (F.element_at(values, 1) + F.element_at(values, n)) / 2)


def shape_features(values: Column, wavelengths: list[float]) -> dict[str, Column]:
    """Red edge position and area, green peak, near-infrared level and slope, water depth, infrared to visible area.

    Wavelengths are evenly spaced.
    """
    step = wavelengths[1] - wavelengths[0]
    edge = [i for i, w in enumerate(wavelengths) if 680 <= w <= 760]
    slopes = F.array(*[(values[min(i + 1, edge[-1])] - values[max(i - 1, edge[0])]) / (step * (min(i + 1, edge[-1]) - max(i - 1, edge[0]))) for i in edge])
    green = between(values, wavelengths, 500, 600)
    infrared = between(values, wavelengths, 780, 900)
    w = np.array([x for x in wavelengths if 780 <= x <= 900])
    centred = w - w.mean()
    weights = F.array(*[F.lit(float(x)) for x in centred / (centred**2).sum()])
    water = between(values, wavelengths, 950, 990)
    edges = (F.element_at(water, 1) + F.element_at(water, -1)) / 2
    visible = between(values, wavelengths, 400, 700)
    return {
        "red_edge_position": F.element_at(F.array(*[F.lit(float(wavelengths[i])) for i in edge]), F.array_position(slopes, F.array_max(slopes)).cast("int")),
        "red_edge_slope": F.array_max(slopes),
        "red_edge_area": trapezoid(between(values, wavelengths, 680, 760), step),
        "green_peak": F.array_max(green),
        "nir_mean": mean(infrared),
        "nir_std": deviation(infrared),
        "nir_slope": _sum(F.zip_with(infrared, weights, lambda a, b: a * b)),
        "water_depth": edges - F.array_min(water),
        "nir_vis_ratio": F.try_divide(trapezoid(infrared, step), trapezoid(visible, step)),
    }


def continuum_removed(values: Column, wavelengths: list[float]) -> Column:
    """Spectra over the line through the corners of their convex hull, upper and lower ones.

    A band is a corner if every slope towards it from the left is above, or every one below,
    all slopes from it to the right. Where the line is 0 the value stays; so do
    straight spectra and those with missing or non-finite values or of another length.
    """
    w = np.array(wavelengths)
    n = len(w)
    gaps = w[None, :] - w[:, None] + np.eye(n)
    left, right = np.tril(np.ones((n, n), bool), -1).T, np.triu(np.ones((n, n), bool), 1)

    def one(v: np.ndarray) -> np.ndarray:
        slope = (v[None, :] - v[:, None]) / gaps  # from the row's band to the column's
        low, high = np.where(left, slope, np.inf).min(0), np.where(left, slope, -np.inf).max(0)
        least, most = np.where(right, slope, np.inf).min(1), np.where(right, slope, -np.inf).max(1)
        corner = (low > most) | (high < least)
        corner[[0, -1]] = True
        if corner.sum() == 2:
            return v
        line = np.interp(w, w[corner], v[corner])
        return v / np.where(line == 0, 1.0, line)

    @F.pandas_udf("array<double>")
    def removed(spectra: pd.Series) -> pd.Series:
        def safe(v):
            if v is None:
                return None
            v = np.asarray(v, float)
            return one(v) if len(v) == n and np.isfinite(v).all() else v

        return spectra.map(safe)

    usable = (F.size(values) == n) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, removed(values)).otherwise(values)  # Arrow would turn a NaN into a null


def chlorophyll_depth(values: Column, wavelengths: list[float]) -> Column:
    """(depth, relative) of the absorption at 680 nm under the line from 550 to 750 nm."""
    at = lambda x: int(np.argmin(np.abs(np.array(wavelengths) - x)))
    a, b, c = at(550), at(680), at(750)
    part = (680.0 - wavelengths[a]) / (wavelengths[c] - wavelengths[a])
    line = values[a] + (values[c] - values[a]) * part
    return F.struct((line - values[b]).alias("depth"), ((line - values[b]) / (line + 1e-8)).alias("relative"))


def wavelet_kernel(scale: int, fine: int = 1024, reach: float = 8.0) -> np.ndarray:
    """Weights of the bands at -8 ``scale`` .. 8 ``scale`` around a place, for the Mexican hat stretched by ``scale``.

    The wavelet is integrated on ``fine`` points and read at ``scale`` of them a
    unit; differences of the integral, over the root of the scale, are the weights.
    """
    x = np.linspace(-reach, reach, fine)
    step = x[1] - x[0]
    integral = np.cumsum(2 / np.sqrt(3) / np.pi**0.25 * (1 - x**2) * np.exp(-(x**2) / 2)) * step
    at = np.floor(np.arange(scale * 2 * reach + 1) / (scale * step)).astype(int)
    read = integral[np.minimum(at, fine - 1)]
    return np.sqrt(scale) * np.diff(np.concatenate(([0.0], read, [0.0])))[::-1]


def wavelet_features(values: Column, scales: tuple[int, ...] = tuple(range(2, 32, 2))) -> Column:
    """Array of (scale, abs_mean, most, least) of a spectrum's wavelet coefficients, taken as 0 beyond its ends.

    NULL spectra, and those that are empty or have missing or non-finite values, give NULL.
    """

    @F.pandas_udf("array<struct<scale: int, abs_mean: double, most: double, least: double>>")
    def features(spectra: pd.Series) -> pd.Series:
        kernels = [(s, wavelet_kernel(s)) for s in scales]

        def one(v):
            if v is None or not len(v) or not np.isfinite(v := np.asarray(v, float)).all():
                return None
            out = []
            for s, k in kernels:
                c = np.convolve(v, k)[8 * s : 8 * s + len(v)]
                out.append({"scale": s, "abs_mean": float(np.abs(c).mean()), "most": float(c.max()), "least": float(c.min())})
            return out

        return spectra.map(one)

    return features(values)
