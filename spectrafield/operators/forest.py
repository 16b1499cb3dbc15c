"""Random forests grown level by level from histograms, over any number of folds at once.

Features are cut into bins at exact quantiles. One pass over the rows grows one
level of all trees of all folds: every task adds up weights and targets by
(fold, tree, node, feature, bin), the sums meet by node, and the best cut of
each node is all that reaches the driver. Bootstrap weights and the features
that a node may use follow from hashes of row, tree, node and feature, and
targets are whole steps, so that sums are exact: a forest does not depend on how
rows are dealt to tasks. State is bounded by folds x trees x nodes x bins,
never by rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..shipping import ship
from .quantiles import exact_quantiles

MASK = (1 << 31) - 1
#: Odd multiplier of the 31-bit mixer: products stay below 2^58.
SPREAD = 0x45D9F3B
#: Steps that targets are told apart by, between their least and their largest.
STEPS = 1 << 20
#: Nodes of one level, over all folds and trees, at most.
MOST_NODES = 1 << 18
#: 31-bit thresholds of Poisson weights of mean 1: a draw at or above the k-th weighs more than k.
POISSON = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * (MASK + 1)) for k in range(8)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.int64) & MASK
    for _ in range(2):
        x = ((x ^ (x >> 16)) * SPREAD) & MASK
    return x ^ (x >> 16)


def hashed(a, b) -> np.ndarray:
    """31 bits of two whole numbers."""
    return mixed(mixed(a) + (np.asarray(b, np.int64) & 0xFFFFF) * 1000003)


def weights(key: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """How often each row (key) is drawn for each tree: (rows, trees)."""
    return np.searchsorted(POISSON, hashed(key[:, None], tree[None, :]), side="right")


def allowed(tree: int, node: int, features: int, most: int) -> list[int]:
    """The ``most`` features that a node may be cut by, those of least hash."""
    h = hashed(hashed(tree, node), np.arange(features))
    return sorted(np.lexsort((np.arange(features), h))[:most].tolist())


@dataclass
class Forest:
    """Nodes in heap order: the children of n are 2n and 2n + 1, the root is 1."""

    features: list[str]
    edges: list[list[float]]
    medians: list[float]
    feature: np.ndarray  # (folds, trees, nodes): number of the feature, -1 at leaves
    cut: np.ndarray  # bins up to the cut go left
    value: np.ndarray  # mean of the node's targets
    gain: np.ndarray = field(repr=False)

    def importance(self) -> np.ndarray:
        """(folds, features): shares of what cuts gain, averaged over trees."""
        folds, trees, _ = self.feature.shape
        out = np.zeros((folds, trees, len(self.features)))
        for j in range(len(self.features)):
            out[..., j] = np.where(self.feature == j, self.gain, 0).sum(2)
        total = out.sum(2, keepdims=True)
        return (out / np.where(total > 0, total, 1)).mean(1)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(fold, tree, node, feature, threshold, value, gain): one row a node; feature and threshold are null at leaves."""
        rows = []
        for f, t, n in zip(*np.nonzero(~np.isnan(self.value)), strict=True):
            j = int(self.feature[f, t, n])
            inner = j >= 0
            rows.append((int(f), int(t), int(n), self.features[j] if inner else None, self.edges[j][int(self.cut[f, t, n])] if inner else None, float(self.value[f, t, n]), float(self.gain[f, t, n])))
        return spark.createDataFrame(rows, "fold int, tree int, node int, feature string, threshold double, value double, gain double")

    def save(self, spark: SparkSession, path: str) -> None:
        """A bundle: the table of nodes, and what describes them, below ``path``."""
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"features": self.features, "edges": self.edges, "medians": self.medians, "shape": list(self.feature.shape)}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Forest:
    """The forest that ``Forest.save`` wrote; a folder without one is an error."""
    meta = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/meta").collect()))
    shape = tuple(meta["shape"])
    out = Forest(meta["features"], meta["edges"], meta["medians"], np.full(shape, -1), np.zeros(shape, int), np.full(shape, np.nan), np.zeros(shape))
    for r in spark.read.parquet(f"{path}/nodes").toLocalIterator():
        at = r["fold"], r["tree"], r["node"]
        out.value[at], out.gain[at] = r["value"], r["gain"]
        if r["feature"] is not None:
            j = out.features.index(r["feature"])
            out.feature[at], out.cut[at] = j, out.edges[j].index(r["threshold"])
    return out


def bins_of(forest: Forest, columns: list[np.ndarray]) -> np.ndarray:
    """(rows, features): bins of the values; missing values are in their feature's median's."""
    out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.int64)
    for j, x in enumerate(columns):
        x = np.asarray(x, float)
        out[:, j] = np.searchsorted(forest.edges[j], np.where(np.isnan(x), forest.medians[j], x), side="left")
    return out


def leaves(forest: Forest, fold: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
    """(rows, trees): the node of each row in each tree of its fold, at most ``depth`` below the root."""
    trees = np.arange(forest.feature.shape[1])
    node = np.ones((len(bins), len(trees)), np.int64)
    row, f = np.arange(len(bins))[:, None], fold[:, None]
    for _ in range(depth):
        j = forest.feature[f, trees, node]
        right = bins[row, np.maximum(j, 0)] > forest.cut[f, trees, node]
        node = np.where(j >= 0, 2 * node + right, node)
    return node


def edges_of(rows: DataFrame, features: list[str], bins: int) -> tuple[list[list[float]], list[float]]:
    """Distinct inner quantiles of every feature, and its median: features x bins numbers reach the driver."""
    at = [k / bins for k in range(1, bins)]
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], features, "feature", "x")
    found = {r["feature"]: r["q"] for r in exact_quantiles(long, ["feature"], "x", [*at, 0.5]).collect()}
    edges = [sorted(set(found[c][:-1])) if c in found else [] for c in features]
    return edges, [found[c][-1] if c in found else 0.0 for c in features]


def fit(
    rows: DataFrame, key: str, features: list[str], target: str, out: str | None = None, folds: int = 1, trees: int = 200, depth: int = 8, least: int = 3, bins: int = 32, most: int | None = None
) -> Forest:
    """Grow ``trees`` trees for each of ``folds`` folds.

    A row trains all folds but those in its array column ``out`` (its own fold,
    and those whose test rows lie inside its buffer); without ``out`` all rows
    train all folds. ``key`` is a whole number that rows are drawn by. A node is
    cut where the squared deviation falls most, both sides weighing ``least`` or
    more, by one of ``most`` features (the root of their number). Rows without a
    target teach nothing, missing features count as their median; a fold
    without rows predicts null.
    """
    spark = rows.sparkSession
    ship(spark)
    most = most or max(1, math.isqrt(len(features)))
    known = rows.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).select(
        F.col(key).cast("long").alias("_key"), F.col(target).cast("double").alias("_y"), (F.col(out) if out else F.array().cast("array<int>")).alias("_out"), *[F.col(c).cast("double").alias(f"_f{j}") for j, c in enumerate(features)]
    )
    # read once a level; a lost part is computed again from its lineage
    known = known.persist(StorageLevel.DISK_ONLY)
    try:
        names = [f"_f{j}" for j in range(len(features))]
        edges, medians = edges_of(known, names, bins)
        low, high = known.agg(F.min("_y"), F.max("_y")).first()
        step = (high - low) / STEPS if low is not None and high > low else 1.0
        shape = (folds, trees, 2 << depth)
        forest = Forest(features, edges, medians, np.full(shape, -1), np.zeros(shape, int), np.full(shape, np.nan), np.zeros(shape))
        if low is None:
            return forest
        active = {(f, t, 1) for f in range(folds) for t in range(trees)}
        for level in range(depth + 1):
            if not active:
                break
            if len(active) > MOST_NODES:
                raise ValueError("fewer folds, trees or levels: the nodes of a level do not fit a task")
            active = grow(known, forest, sorted(active), level, low, step, least, most, bins, last=level == depth)
        return forest
    finally:
        known.unpersist()


def grow(known: DataFrame, forest: Forest, active: list[tuple], level: int, low: float, step: float, least: int, most: int, bins: int, last: bool) -> set:
    """Add one level to the forest: values of the active nodes, and cuts unless it is the last; the nodes below."""
    folds, trees, size = forest.feature.shape
    features = len(forest.features)
    slot = np.full((folds, trees, size), -1)
    for s, at in enumerate(active):
        slot[at] = s
    use = np.array([allowed(t, n, features, min(most, features)) for _, t, n in active])
    all_trees = np.arange(trees)

    def run(batches):
        shape = (len(active), use.shape[1], bins)
        w_sum, y_sum = np.zeros(shape, np.int64).reshape(-1), np.zeros(shape, np.int64).reshape(-1)
        for batch in batches:
            columns = [batch.column(3 + j).to_numpy(zero_copy_only=False) for j in range(features)]
            x = bins_of(forest, columns)
            w = weights(batch.column(0).to_numpy(), all_trees)
            y = np.rint((batch.column(1).to_numpy() - low) / step).astype(np.int64)
            out = batch.column(2).to_pylist()
            for f in range(folds):
                there = np.array([f not in (o or ()) for o in out], bool)
                rows = np.flatnonzero(there)
                if not len(rows):
                    continue
                s = slot[f, all_trees, leaves(forest, np.full(len(rows), f), x[rows], level)]
                r, t = np.nonzero((s >= 0) & (w[rows] > 0))
                s, r = s[r, t], rows[r]
                for k in range(use.shape[1]):
                    cell = (s * use.shape[1] + k) * bins + x[r, use[s, k]]
                    weight = w[r, t]
                    w_sum += np.bincount(cell, weight, len(w_sum)).astype(np.int64)
                    y_sum += np.bincount(cell, weight * y[r], len(y_sum)).astype(np.int64)
        full = np.flatnonzero(w_sum.reshape(len(active), -1).any(1))
        for part in np.array_split(full, max(1, len(full) // 4096)):
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(len(active), -1)[part].reshape(-1)), use.shape[1] * bins).cast(pa.list_(pa.int64())) for a in (w_sum, y_sum)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *lists], ["slot", "w", "s"])

    def cut(key, table):
        w, s = (np.stack(table.column(c).to_numpy()).sum(0).reshape(-1, bins).astype(float) for c in ("w", "s"))
        total, whole = w[0].sum(), s[0].sum()
        at = key[0].as_py()
        left, gone = w.cumsum(1), s.cumsum(1)
        fine = (left >= least) & (total - left >= least)
        with np.errstate(all="ignore"):
            gain = np.where(fine, gone * gone / left + (whole - gone) * (whole - gone) / (total - left) - whole * whole / total, -1.0)
        k, b = np.unravel_index(np.argmax(gain), gain.shape)  # of equal ones the first feature, then the first bin
        best = float(gain[k, b])
        inner = best > 1e-9 and not last
        return pa.table({"slot": pa.array([at], pa.int32()), "value": [whole / total], "feature": pa.array([int(use[at, k]) if inner else -1], pa.int32()), "cut": pa.array([int(b)], pa.int32()), "gain": [best if inner else 0.0]})

    sums = known.mapInArrow(run, "slot int, w array<long>, s array<long>")
    found = sums.groupBy("slot").applyInArrow(cut, "slot int, value double, feature int, cut int, gain double")
    below = set()
    for r in found.toLocalIterator():
        f, t, n = at = active[r["slot"]]
        forest.value[at], forest.gain[at] = r["value"] * step + low, r["gain"] * step * step
        if r["feature"] >= 0:
            forest.feature[at], forest.cut[at] = r["feature"], r["cut"]
            below |= {(f, t, 2 * n), (f, t, 2 * n + 1)}
    return below


def predict(rows: DataFrame, forest: Forest, fold: str | None = None, valid: str | None = None) -> DataFrame:
    """``rows`` with ``predicted`` and ``spread``: mean and deviation of the trees' values.

    ``fold`` names the column of the fold whose trees are asked (the first one's
    without it); trees that drew no row say nothing. Null where that fold had no training rows, and where the
    column ``valid`` is not true. Columns named like the new ones are replaced.
    """
    ship(rows.sparkSession)
    folds, _, size = forest.feature.shape
    rows = rows.drop("predicted", "spread")
    names = rows.columns
    asked = rows.select(
        *names, (F.col(fold).cast("int") if fold else F.lit(0)).alias("__asked_fold"), (F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(True)).alias("__asked_valid"),
        *[F.col(c).cast("double").alias(f"__asked_{j}") for j, c in enumerate(forest.features)],
    )
    depth = size.bit_length() - 2
    at = len(names)

    def run(batches):
        for batch in batches:
            f = batch.column(at).to_numpy(zero_copy_only=False)
            inside = ~np.isnan(f.astype(float)) & (f >= 0) & (f < folds)
            f = np.where(inside, f, 0).astype(int)
            x = bins_of(forest, [batch.column(at + 2 + j).to_numpy(zero_copy_only=False) for j in range(len(forest.features))])
            values = forest.value[f[:, None], np.arange(forest.feature.shape[1])[None], leaves(forest, f, x, depth)]
            there = inside & np.array(batch.column(at + 1).to_pylist(), bool)
            grown = ~np.isnan(values)  # a tree may have drawn no row at all
            n = np.maximum(grown.sum(1), 1)
            mean = np.where(grown, values, 0).sum(1) / n
            spread = np.sqrt((np.where(grown, values - mean[:, None], 0) ** 2).sum(1) / n)
            gone = ~there | ~grown.any(1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(at)], pa.array(mean, mask=gone), pa.array(spread, mask=gone)], [*names, "predicted", "spread"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return asked.mapInArrow(run, f"{schema}, predicted double, spread double")
