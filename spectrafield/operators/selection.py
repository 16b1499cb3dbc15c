"""Selection of columns and sparse partial correlations from the cross-products of the parts of a table.

The parts are folds. What is fitted outside a fold, and how far it is off
inside, follows from the folds' moments, so no candidate reads the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .multivariate import MOST_COLUMNS, Latent, Moments, importance_in_projection, partial_least_squares, successive_projections


def parted_moments(df: DataFrame, values: Column, part: Column) -> list[Moments]:
    """Moments of the places of an array column for each value of ``part``, in the order of these; incomplete rows are left out."""
    complete = df.select(part.cast("long").alias("part"), values.cast("array<double>").alias("v")).where(
        F.col("part").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    middle = complete.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m")).orderBy("at").limit(MOST_COLUMNS + 1).collect()
    if len(middle) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    if not middle:
        return []
    mean = np.array([r["m"] for r in middle] + [0.0])
    width = len(mean)
    upper = np.triu_indices(width)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, width - 1)
            x = np.column_stack((x, np.ones(len(x)))) - mean  # products with the ones are sums and counts
            parts = batch.column(0).to_numpy()
            for p in np.unique(parts):
                mine = x[parts == p]
                total[p] = total.get(p, 0.0) + mine.T @ mine
        for p, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), p)), pa.array(upper[0]), pa.array(upper[1]), pa.array(t[upper])], ["part", "i", "j", "c"])

    sums = complete.mapInArrow(products, "part long, i long, j long, c double").groupBy("part", "i", "j").agg(F.sum("c").alias("c")).toPandas()
    found = []
    for _, rows in sums.groupby("part"):
        c = np.zeros((width, width))
        c[rows["i"], rows["j"]] = rows["c"]
        c[rows["j"], rows["i"]] = rows["c"]
        n, shift = c[-1, -1], c[:-1, -1]
        found.append(Moments(int(round(n)), mean[:-1] + shift / n, c[:-1, :-1] - np.outer(shift, shift) / n))
    return found


def merged(parts: list[Moments]) -> Moments:
    """Moments of all rows of ``parts``, of which there is one at least."""
    n = sum(m.n for m in parts)
    mean = sum(m.n * m.mean for m in parts) / n
    return Moments(n, mean, sum(m.cross + m.n * np.outer(m.mean - mean, m.mean - mean) for m in parts))


def of_columns(m: Moments, columns: np.ndarray) -> Moments:
    return Moments(m.n, m.mean[columns], m.cross[np.ix_(columns, columns)])


def squared_error(model: Latent, m: Moments) -> float:
    """Sum of the squared errors of the model's line on the rows that ``m`` tells of."""
    line = np.append(-model.coefficients, 1.0)
    return float(line @ m.cross @ line + m.n * (line @ m.mean - model.intercept) ** 2)


def held_out_error(parts: list[Moments], components: int) -> float:
    """Root of the mean squared error on each part of the model of the others."""
    others = [merged(parts[:k] + parts[k + 1 :]) for k in range(len(parts))]
    return float(np.sqrt(sum(squared_error(partial_least_squares(o, components), p) for o, p in zip(others, parts, strict=True)) / sum(p.n for p in parts)))


def competitive_selection(parts: list[Moments], rounds: int = 50, components: int = 10, seed: int = 42) -> list[int]:
    """Columns of the round with the least held-out error: fewer are drawn from round to round, by their coefficients.

    The last column is the target. The number kept falls by a constant factor
    from all columns to two. Fewer than two parts or columns leave all columns.
    """
    width = len(parts[0].mean) - 1 if parts else 0
    active = np.arange(width)
    if len(parts) < 2 or width < 2 or rounds < 2:
        return active.tolist()
    rng, best = np.random.default_rng(seed), (np.inf, active)
    for keep in np.maximum(2, np.floor(width * (2 / width) ** (np.arange(rounds) / (rounds - 1)))).astype(int):
        mine = [of_columns(p, np.append(active, width)) for p in parts]
        weight = np.abs(partial_least_squares(merged(mine), components).coefficients)
        if not weight.sum():
            break
        best = min(best, (held_out_error(mine, components), active), key=lambda b: b[0])
        drawn = min(keep, len(active), np.count_nonzero(weight))
        if drawn < 2:
            break
        active = active[np.sort(rng.choice(len(active), drawn, replace=False, p=weight / weight.sum()))]
    return best[1].tolist()


def selected(parts: list[Moments], method: str = "cars_spa", most: int = 25, components: int = 10) -> list[int]:
    """Columns by ``vip``, ``spa``, ``cars`` or ``cars_spa``, which thins out what the former leaves by projections."""
    whole = merged(parts)
    plain = of_columns(whole, np.arange(len(whole.mean) - 1))
    match method:
        case "vip":
            return np.flatnonzero(importance_in_projection(partial_least_squares(whole, components)) >= 1).tolist()
        case "spa":
            return successive_projections(plain, most)
        case "cars":
            return competitive_selection(parts, components=components)
        case "cars_spa":
            left = np.array(competitive_selection(parts, components=components))
            return left.tolist() if len(left) <= most else left[successive_projections(of_columns(plain, left), most)].tolist()
    raise ValueError(f"unknown method: {method}")


def correlation(m: Moments) -> np.ndarray:
    """Correlations; a constant column has none with others and 1 with itself."""
    scale = np.sqrt(np.diag(m.cross))
    out = m.cross / np.outer(np.where(scale > 0, scale, 1.0), np.where(scale > 0, scale, 1.0))
    np.fill_diagonal(out, 1.0)
    return out


def graphical_lasso(s: np.ndarray, penalty: float, rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Precision matrix of greatest likelihood for covariances ``s``, its sides off the diagonal penalised.

    Column by column a lasso on the others, by coordinate descent, until no
    estimated covariance moves; ``RuntimeError`` if that takes more than ``rounds``.
    """
    width = len(s)
    w, beta = s.astype(float).copy(), np.zeros((width, width))
    for _ in range(rounds):
        before = w.copy()
        for j in range(width):
            rest = np.flatnonzero(np.arange(width) != j)
            block, b = w[np.ix_(rest, rest)], beta[rest, j]
            for _ in range(rounds):
                moved = 0.0
                for k in range(width - 1):
                    pull = s[rest[k], j] - block[k] @ b + block[k, k] * b[k]
                    new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / block[k, k]
                    moved, b[k] = max(moved, abs(new - b[k])), new
                if moved < tolerance:
                    break
            beta[rest, j] = b
            w[rest, j] = w[j, rest] = block @ b
        if np.abs(w - before).max(initial=0.0) < tolerance:
            break
    else:
        raise RuntimeError(f"the graphical lasso did not settle in {rounds} rounds")
    own = 1 / (np.diag(w) - (w * beta).sum(0))
    out = -beta * own
    out[np.diag_indices(width)] = own
    return (out + out.T) / 2


def sparse_partial_correlations(parts: list[Moments], grid: int = 10) -> list[tuple[int, int, float]]:
    """(a, b, partial correlation) of the columns that the sparse precision matrix of all parts links.

    The penalty, of ``grid`` ones between the strongest correlation and a
    hundredth of it, is the one under which the matrices fitted without a part make
    that part most likely. Fewer rows than columns and five give no links.
    """
    if not parts or (whole := merged(parts)).n < len(whole.mean) + 5 or len(parts) < 2:
        return []
    s = correlation(whole)
    top = np.abs(s - np.eye(len(s))).max()
    if top == 0:
        return []

    def fit(penalty: float) -> float:
        total = 0.0
        for k, p in enumerate(parts):
            found = graphical_lasso(correlation(merged(parts[:k] + parts[k + 1 :])), penalty)
            total += p.n * (np.linalg.slogdet(found)[1] - np.sum(correlation(p) * found))
        return total

    best = graphical_lasso(s, max(np.geomspace(top, top / 100, grid), key=fit))
    own = np.sqrt(np.diag(best))
    return [(i, j, float(-best[i, j] / own[i] / own[j])) for i in range(len(s)) for j in range(i + 1, len(s)) if abs(best[i, j]) > 1e-6]
