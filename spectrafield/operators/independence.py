"""Kernel independence of two columns with a p-value, without pairs of rows.

A Gaussian kernel of one number is told to rounding by the kernels to few
points: the distinct values, or a grid around the values whose step is a fraction
of the kernel's width. So the statistic of n rows is the squared length of a
small matrix of sums, and so is that of every permutation.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from math import gcd
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .ordered import bounds_of, running
from .quantiles import exact_quantiles
from .validation import hash_number

#: Even quantiles whose median gap is the width of the kernel.
LEVELS = 33
#: Steps of the grid within one width: what the grid leaves untold is below 1e-12.
STEPS = 2.5
#: Grid points kept on either side of a value, and the points that a column may have.
BESIDE, MOST_POINTS = 4, 2048
#: Distinct values up to which they are the points themselves.
FEW = 256
#: Numbers that a task sums up before it sends them.
MOST_NUMBERS = 1 << 23
#: Hashed multipliers that are tried for one without a common divisor with the number of rows.
TRIES = 16


class Grid(NamedTuple):
    """Kernels to ``points`` times ``root`` are independent directions of the kernel."""

    points: np.ndarray
    width: float
    root: np.ndarray

    def tell(self, v: np.ndarray) -> np.ndarray:
        return np.exp(-((v[:, None] - self.points) ** 2) / (2 * self.width**2)) @ self.root


def width_of(quantiles: np.ndarray) -> float:
    """The median gap of even quantiles, the mean one if that is 0, or 1 for a constant."""
    gaps = np.abs(quantiles[:, None] - quantiles)[np.triu_indices(len(quantiles), 1)]
    return float(np.median(gaps)) or float(gaps.mean()) or 1.0


def grid_of(rows: DataFrame, column: str, quantiles: np.ndarray) -> Grid:
    """The points of a column with these even quantiles; at most ``MOST_POINTS`` cells reach the driver."""
    width = width_of(quantiles)
    values = [r[0] for r in rows.select(column).distinct().limit(FEW + 1).collect()]
    if len(values) > FEW:
        low, step = float(quantiles[0]), width / STEPS
        cells = [r[0] for r in rows.select(F.floor((F.col(column) - low) / step).alias("cell")).distinct().limit(MOST_POINTS + 1).collect()]
        near = sorted({c + k for c in cells for k in range(-BESIDE, BESIDE + 2)})
        if len(near) > MOST_POINTS:
            raise ValueError(f"{column} needs more than {MOST_POINTS} points: many of its values are far apart, take ranks or logarithms")
        values = [low + step * c for c in near]
    points = np.sort(np.array(values, float))
    w, u = np.linalg.eigh(np.exp(-((points[:, None] - points) ** 2) / (2 * width**2)))
    keep = w > w[-1] * 1e-13
    return Grid(points, width, u[:, keep] / np.sqrt(w[keep]))


def dealings(permutations: int, n: int, seed: int) -> list[tuple[int, int]]:
    """(a, c) of i -> (a i + c) mod n, first the identity. These maps are a group, so the test's p is exact; they depend on hashes alone."""
    number = lambda *parts: int(md5(".".join(map(str, parts)).encode()).hexdigest()[:8], 16) % n
    out = [(1, 0)]
    for p in range(1, permutations + 1):
        a = next((v for v in (number(p, seed, "a", k) for k in range(TRIES)) if gcd(v, n) == 1), 1)
        out.append((a, number(p, seed, "c")))
    return out


def hsic_test(values: DataFrame, permutations: int = 199, seed: int = 42) -> DataFrame:
    """One row (n, hsic, n_permutations, p) for ``values`` (id, x, y) with distinct ids.

    The statistic is the biased one; the kernel's width is the median gap of 33
    even quantiles of a column. Rows are put in the order of a hash of their id
    and dealt anew by affine maps of their place. p is (1 + permutations that
    reach the observed statistic) / (1 + permutations). Rows with a missing or
    infinite number are left out; hsic and p are missing below ten rows. A
    column with hundreds of values far from all others raises ``ValueError``.
    The exchange has rows times permutations, and sums of points squared times
    permutations for each task.
    """
    spark, schema = values.sparkSession, "n long, hsic double, n_permutations long, p double"
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    word = F.col("id").cast("string")
    rows = values.where(known("x") & known("y")).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), hash_number(word, F.lit(str(seed))).alias("h"))
    n = rows.count()
    if n < 10:
        return spark.createDataFrame([(n, None, permutations, None)], schema)
    levels = [k / (LEVELS - 1) for k in range(LEVELS)]
    long = rows.select(F.explode(F.map_from_arrays(F.array(F.lit("x"), F.lit("y")), F.array("x", "y"))).alias("c", "v"))
    quantiles = {r["c"]: np.array(r["q"]) for r in exact_quantiles(long, ["c"], "v", levels).collect()}
    gx, gy = (grid_of(rows, c, quantiles[c]) for c in ("x", "y"))
    ship(spark)
    wide = gx.root.shape[1]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(wide + gy.root.shape[1])
        for batch in batches:
            t += np.append(gx.tell(batch.column(0).to_numpy()).sum(0), gy.tell(batch.column(1).to_numpy()).sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(t.size)), pa.array(t)], ["cell", "c"])

    added = rows.select("x", "y").mapInArrow(totals, "cell long, c double").groupBy("cell").agg(F.sum("c").alias("c")).orderBy("cell").collect()
    middle = np.array([r["c"] for r in added]) / n
    placed = running(rows, [], ["h", "id"], {"i": F.lit(1).cast("long")}, bounds_of(rows, "h", n))
    times, plus = (F.array(*[F.lit(v).cast("long") for v in column]) for column in zip(*dealings(permutations, n, seed), strict=True))
    copies = placed.select("i", "x", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("p"))
    to = F.pmod(F.get(times, F.col("p")) * (F.col("i") - 1) + F.get(plus, F.col("p")), F.lit(n)) + 1
    met = copies.select("p", "x", to.alias("to")).join(placed.select(F.col("i").alias("to"), "y"), "to").select(F.col("p").cast("long").alias("p"), "x", "y")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for q, t in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, q)), pa.array(np.arange(t.size)), pa.array(t.ravel())], ["p", "cell", "c"])
            total.clear()

        for batch in batches:
            p, x, y = (batch.column(k).to_numpy() for k in range(3))
            order = np.argsort(p, kind="stable")
            tx, ty = gx.tell(x[order]) - middle[:wide], gy.tell(y[order]) - middle[wide:]
            found, starts = np.unique(p[order], return_index=True)
            for q, a, b in zip(found.tolist(), starts, [*starts[1:], len(p)], strict=True):
                total[q] = total.get(q, 0.0) + tx[a:b].T @ ty[a:b]
                if len(total) * total[q].size > MOST_NUMBERS:
                    yield from sent()
        yield from sent()

    cells = met.mapInArrow(sums, "p long, cell long, c double").groupBy("p", "cell").agg((F.sum("c") / n).alias("c"))
    worth = {r["p"]: r["h"] for r in cells.groupBy("p").agg(F.sum(F.col("c") * F.col("c")).alias("h")).collect()}
    reached = sum(round(worth[p], 9) >= round(worth[0], 9) for p in range(1, permutations + 1))
    return spark.createDataFrame([(n, worth[0], permutations, (1 + reached) / (1 + permutations))], schema)
