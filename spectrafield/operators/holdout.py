"""A spatial holdout: the fold farthest from the centre is the test, models are chosen on folds of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tuning
from .selection import parted_moments


def farthest(points: DataFrame, part: str = "part", x: str = "x", y: str = "y") -> int | None:
    """The part whose middle lies farthest from the middle of all points; the smallest of equal ones, None without points."""
    middle = points.groupBy(part).agg(F.avg(x).alias("px"), F.avg(y).alias("py"))
    centre = points.agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    dx, dy = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
    row = middle.join(F.broadcast(centre)).select(part, F.round(dx * dx + dy * dy, 9).alias("d")).where("d is not null").orderBy(F.desc("d"), part).first()
    return None if row is None else row[part]


def holdout_models(points: DataFrame, features: list[str], targets: list[str], part: str, inner: str, models: dict[str, list[tuple] | None]) -> list[tuple]:
    """(target, model, parameters, n_train, n_test, inner_rmse, test_rmse, test_r2, chosen) for every model and target.

    Parameters have the least error over the folds ``inner`` of the training
    rows; the chosen model is the one of least inner error, so the test rows
    choose nothing. A target has its own complete rows; one without test or
    training rows has no result.
    """
    test = farthest(points, part)
    if test is None:
        return []
    out = []
    for target in targets:
        values = F.array(*[F.col(c).cast("double") for c in [*features, target]])
        # the test rows are a fold of their own, told from the inner ones by its number
        parts = parted_moments(points, values, F.when(F.col(part) == test, -1).otherwise(F.col(inner)))
        held = points.where(F.col(part) == test).where(F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v))).count()
        if not held or len(parts) < 3:
            continue
        rest, far = parts[1:], parts[0]
        rows = []
        for model, grid in models.items():
            found = tuning.curve(rest, model, grid)
            best = min(found, key=lambda c: round(c[1], 12))
            error = tuning.missed(tuning.MODELS[model][0](tuning.merged(rest), *best[0]), far)
            spread = far.cross[-1, -1]
            rows.append((target, model, str(list(best[0])), sum(m.n for m in rest), far.n, best[1], float((error / far.n) ** 0.5), float(1 - error / spread) if spread > 0 else None))
        least = min(rows, key=lambda r: round(r[5], 12))
        out += [(*r, r is least) for r in rows]
    return out
