"""Windows that are mirrored at the raster's edges, and patches around points with their turns and flips."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import TILE


def extent(pixels: DataFrame) -> tuple[int, int]:
    """(height, width) of a raster: two numbers on the driver."""
    h, w = pixels.agg(F.max("row") + 1, F.max("col") + 1).first()
    return h or 0, w or 0


def mirrored(place: Column, size: int, half: int) -> Column:
    """All places of the padded axis (-half .. size - 1 + half) that show what is at ``place``; the edge itself is not repeated."""
    low = F.when((place >= 1) & (place <= half), -place)
    high = F.when((place <= size - 2) & (place >= size - 1 - half), 2 * (size - 1) - place)
    return F.array_compact(F.array(place, low, high))


def reflected_stats(pixels: DataFrame, bands: list[str], window: int, tile: int = TILE) -> DataFrame:
    """(row, col, band, mean, std, median, p25, p75, cv) of the whole window around each pixel, mirrored at the edges.

    Pixels, with their mirror images, are dealt to tiles with halos. Missing
    pixels are 0, which is a value here; cv is std / (mean + 1e-8). The raster
    is larger than half a window.
    """
    half, (height, width) = window // 2, extent(pixels)
    if pixels.isEmpty():
        return pixels.select("row", "col", F.lit("").alias("band"), *[F.lit(0.0).alias(c) for c in ("mean", "std", "median", "p25", "p75", "cv")]).limit(0)
    if min(height, width) <= half:
        raise ValueError("the raster is smaller than half a window")
    span = lambda c: F.sequence(F.floor((F.col(c) - half) / tile).cast("int"), F.floor((F.col(c) + half) / tile).cast("int"))
    shown = pixels.select(F.explode(mirrored(F.col("row"), height, half)).alias("r"), "col", *[F.col(b).cast("double").alias(b) for b in bands])
    shown = shown.select("r", F.explode(mirrored(F.col("col"), width, half)).alias("c"), *bands)
    dealt = shown.withColumn("tr", F.explode(span("r"))).withColumn("tc", F.explode(span("c"))).where((F.col("tr") >= 0) & (F.col("tc") >= 0) & (F.col("tr") <= (height - 1) // tile) & (F.col("tc") <= (width - 1) // tile))

    def step(key, table):
        r0, c0 = (k.as_py() * tile - half for k in key)
        r, c = table.column("r").to_numpy() - r0, table.column("c").to_numpy() - c0
        real = np.zeros((tile + 2 * half,) * 2, bool)
        inner = (r >= half) & (r < half + tile) & (c >= half) & (c < half + tile) & (r + r0 < height) & (c + c0 < width)
        real[r[inner], c[inner]] = True
        there = real[half : half + tile, half : half + tile]
        i, j = np.nonzero(there)
        out = []
        for band in bands:
            grid = np.zeros((tile + 2 * half,) * 2)
            grid[r, c] = np.nan_to_num(table.column(band).to_numpy(zero_copy_only=False))
            views = np.lib.stride_tricks.sliding_window_view(grid, (window, window))[there].reshape(-1, window * window)
            mean, std = views.mean(1), views.std(1)
            p25, median, p75 = np.percentile(views, [25, 50, 75], axis=1) if len(views) else (np.zeros(0),) * 3
            out.append(pa.table({"row": (i + r0 + half).astype(np.int32), "col": (j + c0 + half).astype(np.int32), "band": pa.array([band] * len(i)), "mean": mean, "std": std, "median": median, "p25": p25, "p75": p75, "cv": std / (mean + 1e-8)}))
        return pa.concat_tables(out)

    return dealt.groupBy("tr", "tc").applyInArrow(step, "row int, col int, band string, mean double, std double, median double, p25 double, p75 double, cv double")


def patches(points: DataFrame, pixels: DataFrame, bands: list[str], size: int) -> DataFrame:
    """(site, r0, c0, patch): whole squares of ``size`` around points (site, row, col), moved inside the raster at its edges.

    A patch is one array: bands, then rows, then columns; missing pixels are 0.
    Points are joined with the pixels of their squares, never with the raster.
    """
    height, width = extent(pixels)
    start = lambda c, whole: F.greatest(F.least(F.col(c) - size // 2, F.lit(whole - size)), F.lit(0)).cast("int")
    placed = points.select("site", start("row", height).alias("r0"), start("col", width).alias("c0"))
    cells = placed.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    values = F.array(*[F.coalesce(F.col(b).cast("double"), F.lit(0.0)) for b in bands])
    met = cells.withColumns({"row": F.col("r0") + F.col("i"), "col": F.col("c0") + F.col("j")}).join(pixels.select("row", "col", *bands), ["row", "col"], "left").select("site", "r0", "c0", "i", "j", values.alias("v"))
    # size squared rows a point
    whole = met.groupBy("site", "r0", "c0").agg(F.array_sort(F.collect_list(F.struct("i", "j", "v"))).alias("all"))
    of_band = lambda b: F.transform("all", lambda x: x["v"][b])
    return whole.select("site", "r0", "c0", F.flatten(F.array(*map(of_band, range(len(bands))))).alias("patch"))


def turned(patch: Column, size: int, turn: Column, across: Column, down: Column) -> Column:
    """The patch after ``turn`` quarter turns, then mirrored ``across`` (columns) and ``down`` (rows) where these are true."""
    last = size - 1

    def at(p: Column) -> Column:
        i, j = F.floor(p / size) % size, p % size
        i, j = F.when(down, last - i).otherwise(i), F.when(across, last - j).otherwise(j)
        r = F.when(turn == 0, i).when(turn == 1, j).when(turn == 2, last - i).otherwise(last - j)
        c = F.when(turn == 0, j).when(turn == 1, last - i).when(turn == 2, last - j).otherwise(i)
        return F.get(patch, (p - p % (size * size) + r * size + c).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.size(patch) - 1), at)


def copies(squares: DataFrame, size: int, draw, n: int = 8) -> DataFrame:
    """(site, copy, turn, across, down, patch): ``n`` turned and mirrored copies of each patch (site, patch).

    ``draw(site, copy)`` gives the whole number whose last bits choose the turn and the mirrors.
    """
    drawn = squares.select("site", "patch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("copy")).withColumn("h", draw(F.col("site"), F.col("copy")))
    drawn = drawn.select("site", "copy", "patch", (F.col("h") % 4).cast("int").alias("turn"), (F.expr("shiftright(h, 2) & 1") == 1).alias("across"), (F.expr("shiftright(h, 3) & 1") == 1).alias("down"))
    return drawn.withColumn("patch", turned(F.col("patch"), size, F.col("turn"), F.col("across"), F.col("down")))
