"""Models tuned and stacked on the moments of folds: one reading serves a whole grid.

What a linear model fitted outside a fold misses inside it follows from the
folds' cross-products, so every candidate of ridge, elastic net and partial least
squares is judged without reading rows again. Stacking reads rows once more, for
the base models' predictions outside their folds.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .multivariate import Moments, partial_least_squares
from .selection import merged, of_columns, parted_moments

# The grids in use.
RIDGE = (0.01, 0.1, 1.0, 10.0, 100.0)
NET = tuple((a, s) for a in (0.001, 0.01, 0.1, 1.0) for s in (0.1, 0.5, 0.9))
LASSO = (0.001, 0.01, 0.1, 1.0)
COMPONENTS = (3, 5, 7, 10, 15)


class Line(NamedTuple):
    """A linear model in the columns' own units."""

    slopes: np.ndarray
    start: float


def _standard(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram matrix and products with the target of standardised columns, and their deviations (1 where constant)."""
    spread = np.sqrt(np.diag(m.cross)[:-1] / max(m.n, 1))
    spread = np.where(spread > 1e-12, spread, 1.0)
    return m.cross[:-1, :-1] / np.outer(spread, spread), m.cross[:-1, -1] / spread, spread


def _line(w: np.ndarray, spread: np.ndarray, m: Moments) -> Line:
    slopes = w / spread
    return Line(slopes, float(m.mean[-1] - slopes @ m.mean[:-1]))


def ridge(m: Moments, penalty: float) -> Line:
    """Least squares with ``penalty`` times the squared weights of standardised columns; the last column is the target."""
    gram, xy, spread = _standard(m)
    return _line(np.linalg.lstsq(gram + penalty * np.eye(len(xy)), xy, rcond=None)[0], spread, m)


def elastic_net(m: Moments, penalty: float, share: float, rounds: int = 2000, tolerance: float = 1e-10) -> Line:
    """Half the mean squared error plus ``penalty`` times (``share`` of the absolute, the rest half of the squared weights), by coordinate descent on the moments."""
    gram, xy, spread = _standard(m)
    gram, xy = gram / max(m.n, 1), xy / max(m.n, 1)
    w = np.zeros(len(xy))
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            rest = xy[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - penalty * share, 0.0) / (gram[j, j] + penalty * (1 - share)) if gram[j, j] > 0 else 0.0
            most, w[j] = max(most, abs(new - w[j])), new
        if most < tolerance:
            break
    return _line(w, spread, m)


def latent(m: Moments, components: int) -> Line:
    """Partial least squares with at most ``components``."""
    found = partial_least_squares(m, min(components, len(m.mean) - 1, max(1, m.n - 2)))
    return Line(found.coefficients, found.intercept)


MODELS = {
    "ridge": (ridge, [(a,) for a in RIDGE]),
    "lasso": (lambda m, a: elastic_net(m, a, 1.0), [(a,) for a in LASSO]),
    "elastic_net": (elastic_net, list(NET)),
    "pls": (latent, [(k,) for k in COMPONENTS]),
}


def missed(line: Line, m: Moments) -> float:
    """Sum of the squared errors of a line on the rows that ``m`` tells of."""
    b = np.append(-line.slopes, 1.0)
    return float(b @ m.cross @ b + m.n * (m.mean[-1] - line.start - line.slopes @ m.mean[:-1]) ** 2)


def curve(parts: list[Moments], model: str, grid: list[tuple] | None = None) -> list[tuple[tuple, float, float]]:
    """(parameters, rmse, r2) of every candidate of a model, each fold predicted by the model of the others."""
    fit, usual = MODELS[model]
    whole = merged(parts)
    outside = [merged(parts[:k] + parts[k + 1 :]) for k in range(len(parts))]
    out = []
    for p in grid or usual:
        error = sum(missed(fit(o, *p), m) for o, m in zip(outside, parts, strict=True))
        out.append((p, float(np.sqrt(error / whole.n)), float(1 - error / whole.cross[-1, -1]) if whole.cross[-1, -1] > 0 else float("nan")))
    return out


def tuned(parts: list[Moments], model: str, grid: list[tuple] | None = None) -> tuple[tuple, Line]:
    """The parameters of least error, the first of equal ones, and the model of all rows with them."""
    best = min(curve(parts, model, grid), key=lambda c: round(c[1], 12))
    return best[0], MODELS[model][0](merged(parts), *best[0])


def applied(line: Line, columns: list[Column]) -> Column:
    out = F.lit(line.start)
    for slope, c in zip(line.slopes, columns, strict=True):
        out = out + F.lit(float(slope)) * c
    return out


def stacked(rows: DataFrame, features: list[str], target: str, part: str, base: dict[str, tuple[list[str], str]], penalties: tuple[float, ...] = RIDGE) -> tuple[DataFrame, dict]:
    """``rows`` with the base models' predictions and ``predicted`` outside each row's fold ``part`` (0 ..), and how they were weighed.

    base: name -> (features, model). Base models are tuned on all folds; a
    row's base predictions come from the folds but its own, and so does the
    ridge that weighs them, whose penalty has the least error over folds.
    Incomplete rows and columns named like new ones are left out.
    """
    arrays = F.array(*[F.col(c).cast("double") for c in [*features, target]])
    parts = parted_moments(rows, arrays, F.col(part))
    numbers = sorted(r[0] for r in rows.where(F.forall(arrays, lambda x: x.isNotNull() & ~F.isnan(x))).select(F.col(part).cast("long")).distinct().collect())
    if len(parts) < 2:
        raise ValueError("stacking needs two folds")
    out = rows.where(F.forall(arrays, lambda x: x.isNotNull() & ~F.isnan(x))).drop(*base, "predicted")
    about = {}
    for name, (columns, model) in base.items():
        at = np.array([*(features.index(c) for c in columns), len(features)])
        mine = [of_columns(m, at) for m in parts]
        best, _ = tuned(mine, model)
        about[name] = best
        told = F.lit(None).cast("double")
        for k, number in enumerate(numbers):
            line = MODELS[model][0](merged(mine[:k] + mine[k + 1 :]), *best)
            told = F.when(F.col(part) == number, applied(line, [F.col(c) for c in columns])).otherwise(told)
        out = out.withColumn(name, told)
    names = list(base)
    upper = parted_moments(out, F.array(*[F.col(c).cast("double") for c in [*names, target]]), F.col(part))
    penalty, _ = tuned(upper, "ridge", [(a,) for a in penalties])
    about["penalty"] = penalty[0]
    told = F.lit(None).cast("double")
    for k, number in enumerate(numbers):
        line = ridge(merged(upper[:k] + upper[k + 1 :]), *penalty)
        told = F.when(F.col(part) == number, applied(line, [F.col(c) for c in names])).otherwise(told)
    return out.withColumn("predicted", told), about
