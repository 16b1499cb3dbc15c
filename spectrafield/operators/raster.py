"""Raster operators on pixel tables (row, col, b0 ..): equi-joins on offsets, never a scan of windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def band_stats(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """(band, n, p2, p98) over valid pixels (> 0)."""
    long = pixels.unpivot([], bands, "band", "value").where("value > 0")
    return exact_quantiles(long, ["band"], "value", [0.02, 0.98]).select("band", "n", F.col("q")[0].alias("p2"), F.col("q")[1].alias("p98"))


def normalised(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """(row, col, band, value) stretched to 0 .. 1 between the 2nd and 98th percentile; no data is 0."""
    long = pixels.unpivot(["row", "col"], bands, "band", "value")
    joined = long.join(F.broadcast(band_stats(pixels, bands)), "band")  # one row a band
    unit = (F.col("value") - F.col("p2")) / (F.col("p98") - F.col("p2") + 1e-8)
    return joined.select("row", "col", "band", F.when(F.col("value") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), unit))).otherwise(0.0).alias("value"))


def tiles(pixels: DataFrame, size: int) -> DataFrame:
    return pixels.withColumns({"tile_r": F.floor(F.col("row") / size).cast("int"), "tile_c": F.floor(F.col("col") / size).cast("int")})


def stencil(pixels: DataFrame, half: int, value: str) -> DataFrame:
    """(row, col, value): every pixel's value at each position whose window covers it."""
    steps = F.sequence(F.lit(-half), F.lit(half))
    moved = pixels.select("row", "col", F.col(value).alias("value")).withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    return moved.select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "value")


#: Side of the tiles that neighbourhoods are computed in.
TILE = 64


def window_stats(pixels: DataFrame, value: str, window: int, tile: int = TILE) -> DataFrame:
    """(row, col, n, mean, std, median, p25, p75, cv) of the valid pixels (> 0) around each pixel; edges are clipped.

    Pixels are dealt to tiles, those near an edge to the neighbours too, and a
    tile's windows are one sliding view: a pixel is shuffled (1 + (window - 1) /
    tile)^2 times on average, not window^2 times. Pixels without a valid
    neighbour have no row.
    """
    half = window // 2
    span = lambda c: F.sequence(F.floor((F.col(c) - half) / tile).cast("int"), F.floor((F.col(c) + half) / tile).cast("int"))
    dealt = pixels.select("row", "col", F.col(value).cast("double").alias("value")).withColumn("tr", F.explode(span("row"))).withColumn("tc", F.explode(span("col")))

    def step(key, table):
        r0, c0 = (k.as_py() * tile - half for k in key)
        row, col = table.column("row").to_numpy() - r0, table.column("col").to_numpy() - c0
        grid, there = np.full((tile + 2 * half,) * 2, np.nan), np.zeros((tile + 2 * half,) * 2, bool)
        v = table.column("value").to_numpy(zero_copy_only=False)
        grid[row, col], there[row, col] = np.where(v > 0, v, np.nan), True
        inner = there[half : half + tile, half : half + tile]
        views = np.lib.stride_tricks.sliding_window_view(grid, (window, window))[inner].reshape(-1, window * window)
        views = np.sort(views, axis=1)  # missing values come last
        n = np.isfinite(views).sum(1)
        i, j = np.nonzero(inner)
        some = n > 0
        views, n, i, j = views[some], n[some], i[some] + r0 + half, j[some] + c0 + half
        mean = np.nansum(views, axis=1) / n
        std = np.sqrt(np.nansum((views - mean[:, None]) ** 2, axis=1) / n)

        def quantile(q):
            at = q * (n - 1)
            low = np.floor(at).astype(int)
            rows = np.arange(len(n))
            return views[rows, low] + (at - low) * (views[rows, np.minimum(low + 1, n - 1)] - views[rows, low])

        return pa.table({"row": i.astype(np.int32), "col": j.astype(np.int32), "n": n.astype(np.int64), "mean": mean, "std": std, "median": quantile(0.5), "p25": quantile(0.25), "p75": quantile(0.75), "cv": std / mean})

    return dealt.groupBy("tr", "tc").applyInArrow(step, "row int, col int, n long, mean double, std double, median double, p25 double, p75 double, cv double")


def glcm(pixels: DataFrame, level: str, size: int, distance: int = 1) -> DataFrame:
    """Co-occurrence properties by tile, over four angles, symmetric: contrast, dissimilarity, homogeneity, asm, energy."""
    # (0,d) (d,d) (d,0) (d,-d), and each reversed by symmetry
    steps = [(0, distance), (distance, distance), (distance, 0), (distance, -distance)]
    a = tiles(pixels, size).select("tile_r", "tile_c", "row", "col", F.col(level).alias("i"))
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps])
    moved = a.withColumn("o", F.explode(offsets)).select("tile_r", "tile_c", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), F.col("i").alias("j"))
    met = a.join(moved, ["tile_r", "tile_c", "row", "col"]).select("tile_r", "tile_c", "i", "j")
    both = met.unionByName(met.select("tile_r", "tile_c", F.col("j").alias("i"), F.col("i").alias("j")))
    cells = both.groupBy("tile_r", "tile_c", "i", "j").agg(F.count("*").alias("k"))
    d = F.abs(F.col("i") - F.col("j"))
    k, total = F.col("k"), F.sum("k")
    asm = F.sum(k * k) / (total * total)
    return cells.groupBy("tile_r", "tile_c").agg(
        (F.sum(k * d * d) / total).alias("contrast"), (F.sum(k * d) / total).alias("dissimilarity"), (F.sum(k / (1.0 + d * d)) / total).alias("homogeneity"), asm.alias("asm"), F.sqrt(asm).alias("energy"),
    )


def glcm_texture(pixels: DataFrame, level: str, size: int, distances: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(tile_r, tile_c, property, mean, std) over distances and angles: each of these has its own symmetric counts.

    Correlation is 1 where all levels are equal.
    """
    a = tiles(pixels, size).select("tile_r", "tile_c", "row", "col", F.col(level).alias("i"))
    steps = [(d, k, r, c) for d in distances for k, (r, c) in enumerate([(0, d), (d, d), (d, 0), (d, -d)])]
    offsets = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(k).alias("k"), F.lit(r).alias("r"), F.lit(c).alias("c")) for d, k, r, c in steps])
    moved = a.withColumn("o", F.explode(offsets)).select("tile_r", "tile_c", "o.d", "o.k", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), F.col("i").alias("j"))
    keys = ["tile_r", "tile_c", "d", "k"]
    met = a.join(moved, ["tile_r", "tile_c", "row", "col"])
    both = met.select(*keys, F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p")).groupBy(*keys, "p.i", "p.j").agg(F.count("*").alias("w"))
    w, gap, total = F.col("w"), F.abs(F.col("i") - F.col("j")), F.sum("w")
    mean = F.sum(w * F.col("i")) / total
    spread = F.sum(w * F.col("i") * F.col("i")) / total - mean * mean
    shared = F.sum(w * F.col("i") * F.col("j")) / total - mean * mean
    asm = F.sum(w * w) / (total * total)
    each = both.groupBy(*keys).agg(
        (F.sum(w * gap * gap) / total).alias("contrast"), (F.sum(w * gap) / total).alias("dissimilarity"), (F.sum(w / (1.0 + gap * gap)) / total).alias("homogeneity"),
        asm.alias("asm"), F.sqrt(asm).alias("energy"), F.when(spread < 1e-9, 1.0).otherwise(shared / spread).alias("correlation"),
    )
    long = each.unpivot(keys, ["contrast", "dissimilarity", "homogeneity", "asm", "energy", "correlation"], "property", "value")
    return long.groupBy("tile_r", "tile_c", "property").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def clamped_window(points: DataFrame, pixels: DataFrame, value: str, window: int, height: int, width: int) -> DataFrame:
    """(site, n, mean, std, least, most): whole windows around ``points`` (site, row, col), moved inside the raster at its edges."""
    half = window // 2
    start = lambda c, size: F.least(F.greatest(F.col(c) - half, F.lit(0)), F.lit(size - window))
    cells = points.select("site", F.explode(F.sequence(start("row", height), start("row", height) + window - 1)).alias("row"), start("col", width).alias("c0"))
    cells = cells.select("site", "row", F.explode(F.sequence(F.col("c0"), F.col("c0") + window - 1)).alias("col"))
    v = F.when(F.col(value) > 0, F.col(value))
    return cells.join(pixels, ["row", "col"]).groupBy("site").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))


def hann(place: Column, size: int) -> Column:
    """Raised cosine over 0 .. size - 1, never 0."""
    return 0.5 - 0.5 * F.cos(2 * 3.141592653589793 * (place + 1) / (size + 1))


def blend(pixels: DataFrame, value: str, size: int, overlap: int) -> DataFrame:
    """(row, col, value, weight): overlapping tiles' predictions, here the pixel's value plus its tile's number, weighted by Hann."""
    step = size - overlap
    for axis in ("row", "col"):
        first = F.greatest(F.lit(0), F.floor((F.col(axis) - size) / step) + 1).cast("int")
        pixels = pixels.withColumn(f"t_{axis}", F.explode(F.sequence(first, F.floor(F.col(axis) / step).cast("int"))))
    w = hann(F.col("row") - F.col("t_row") * step, size) * hann(F.col("col") - F.col("t_col") * step, size)
    seen = pixels.select("row", "col", w.alias("w"), (F.col(value) + (F.col("t_row") + F.col("t_col")) / 100.0).alias("p"))
    return seen.groupBy("row", "col").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("value"), F.sum("w").alias("weight"))


def map_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, min, mean, max, std, p5, p95) over finite values."""
    fine = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    out = fine.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.stddev_pop(value).alias("std")
    )
    out = out.join(exact_quantiles(fine, by, value, [0.05, 0.95]).drop("n"), by)
    return out.select(*by, "n", "least", "mean", "most", "std", F.col("q")[0].alias("p5"), F.col("q")[1].alias("p95"))


def overlapping_tiles(pixels: DataFrame, tile: int, overlap: int) -> DataFrame:
    """(row, col): upper left corners of tiles over the extent of ``pixels``; the last of a line is moved inside the raster."""
    def starts(size: Column) -> Column:
        last = F.greatest(size - tile, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last + (tile - overlap - 1), F.lit(tile - overlap)), lambda s: F.least(s, last)))

    extent = pixels.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")).where("h is not null")
    return extent.select(F.explode(starts(F.col("h"))).alias("row"), "w").select("row", F.explode(starts(F.col("w"))).alias("col"))


def pass_statistics(passes: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n_passes, mean, std): predictions of several passes over the same pixels."""
    return passes.groupBy(*by).agg(F.count(value).alias("n_passes"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def circle_samples(radius: float, points: int) -> list[tuple[int, int, int, float]]:
    """(point, row step, column step, weight): the pixels around each place of a circle, weighted by nearness."""
    found = []
    for p in range(points):
        r, c = round(-radius * math.sin(2 * math.pi * p / points), 5), round(radius * math.cos(2 * math.pi * p / points), 5)
        r0, c0 = math.floor(r), math.floor(c)
        for dr, dc in ((0, 0), (0, 1), (1, 0), (1, 1)):
            weight = (1 - abs(r - r0 - dr)) * (1 - abs(c - c0 - dc))
            if weight > 0:
                found.append((p, r0 + dr, c0 + dc, weight))
    return found


def binary_patterns(pixels: DataFrame, value: str, size: int = 32, radius: float = 2, points: int = 16, bins: int = 8) -> DataFrame:
    """(tile_r, tile_c, bin, density): histogram of uniform local binary patterns of each tile.

    A pixel's pattern tells which places of the circle are at least as bright;
    with two changes or fewer along it the pattern is their number, else
    points + 1. Outside a tile, and where pixels are missing, it is dark (0).
    """
    samples = circle_samples(radius, points)
    pad = math.ceil(radius) + 1

    def step(key, table):
        r0, c0 = (k.as_py() * size for k in key)
        i, j = table.column("row").to_numpy() - r0 + pad, table.column("col").to_numpy() - c0 + pad
        grid = np.zeros((size + 2 * pad,) * 2)
        grid[i, j] = np.nan_to_num(table.column("value").to_numpy(zero_copy_only=False))
        ring = np.zeros((points, len(i)))
        for p, dr, dc, weight in samples:
            ring[p] += weight * grid[i + dr, j + dc]
        bright = ring - grid[i, j] >= -1e-9
        changes = (bright[1:] != bright[:-1]).sum(0)
        code = np.where(changes <= 2, bright.sum(0), points + 1)
        counts = np.bincount(code * bins // (points + 2), minlength=bins)
        n = bins
        return pa.table({"tile_r": pa.array([key[0].as_py()] * n, pa.int32()), "tile_c": pa.array([key[1].as_py()] * n, pa.int32()), "bin": pa.array(range(n), pa.int32()), "density": counts * bins / (len(i) * (points + 2))})

    dealt = tiles(pixels.select("row", "col", F.col(value).cast("double").alias("value")), size)
    return dealt.groupBy("tile_r", "tile_c").applyInArrow(step, "tile_r int, tile_c int, bin int, density double")


def wave_kernel(frequency: float, angle: float, sigma: float = 2.0) -> np.ndarray:
    """A plane wave under a round bell of deviation ``sigma``, cut at three deviations along the axes turned by ``angle``."""
    reach = [math.ceil(max(abs(3 * sigma * math.cos(angle)), abs(3 * sigma * math.sin(angle)), 1))] * 2
    y, x = np.mgrid[-reach[0] : reach[0] + 1, -reach[1] : reach[1] + 1]
    along = x * math.cos(angle) + y * math.sin(angle)
    return np.exp(-(x**2 + y**2) / (2 * sigma**2)) / (2 * math.pi * sigma**2) * np.exp(2j * math.pi * frequency * along)


def wave_energy(pixels: DataFrame, value: str, size: int = 32, frequencies: tuple[float, ...] = (0.1, 0.25, 0.4), angles: int = 4) -> DataFrame:
    """(tile_r, tile_c, frequency, angle, mean, std): energy of a bank of Gabor filters over each tile.

    Angles are given as their number of ``angles`` steps to a half turn. Tiles are
    mirrored at their edges; missing pixels are 0.
    """

    def step(key, table):
        r0, c0 = (k.as_py() * size for k in key)
        grid = np.zeros((size, size))
        grid[table.column("row").to_numpy() - r0, table.column("col").to_numpy() - c0] = np.nan_to_num(table.column("value").to_numpy(zero_copy_only=False))
        rows = []
        for f in frequencies:
            for a in range(angles):
                kernel = wave_kernel(f, math.pi * a / angles)
                views = np.lib.stride_tricks.sliding_window_view(np.pad(grid, len(kernel) // 2, "symmetric"), kernel.shape)
                energy = np.abs(np.einsum("rcij,ij->rc", views, kernel))
                rows.append({"tile_r": key[0].as_py(), "tile_c": key[1].as_py(), "frequency": f, "angle": a, "mean": energy.mean(), "std": energy.std()})
        return pa.Table.from_pylist(rows, pa.schema([("tile_r", pa.int32()), ("tile_c", pa.int32()), ("frequency", pa.float64()), ("angle", pa.int32()), ("mean", pa.float64()), ("std", pa.float64())]))

    dealt = tiles(pixels.select("row", "col", F.col(value).cast("double").alias("value")), size)
    return dealt.groupBy("tile_r", "tile_c").applyInArrow(step, "tile_r int, tile_c int, frequency double, angle int, mean double, std double")
