"""Mirrored windows, patches and several targets outside buffers: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, patches, validation
from ..sources import tables as src
from . import oracle

BANDS = ["b2", "b4"]
SIZE = 5


def reflected_windows(spark, d):
    return patches.reflected_stats(src.raster(spark, d), BANDS, 5)


def _places(spark, d):
    return src.sites(spark, d).select("site", F.floor(F.col("x") / 2).cast("int").alias("row"), (F.col("site") % 128).cast("int").alias("col"))


def point_patches(spark, d):
    return patches.patches(_places(spark, d), src.raster(spark, d), BANDS, SIZE)


def patch_copies(spark, d):
    """Eight turned and mirrored copies of every point's patch, a row a value."""
    draw = lambda site, copy: validation.hash_number(site.cast("string"), copy.cast("string"))
    out = patches.copies(point_patches(spark, d).select("site", "patch"), SIZE, draw)
    return out.select("site", "copy", "turn", "across", "down", F.posexplode("patch").alias("at", "value"))


def target_loo(spark, d):
    """Two targets, one of them missing at every third site, each by the sites outside the buffer that have it."""
    s = src.sites(spark, d).select("site", "x", "y", (F.col("x") / 100).alias("e"), (F.col("y") / 100).alias("n"), F.when(F.col("site") % 3 != 0, F.col("v")).alias("v"), "u")
    return models.buffered_targets(s, ["e", "n"], ["v", "u"], 50.0, 0.5)


def queries() -> dict:
    return {f.__name__: f for f in (reflected_windows, point_patches, patch_copies, target_loo)}


def oracle_sql() -> dict[str, str]:
    half = SIZE // 2
    fold = lambda p, n: f"case when {p} < 0 then -({p}) when {p} > {n} - 1 then 2 * ({n} - 1) - ({p}) else {p} end"
    steps = f"(select unnest(range(-{half}, {half + 1})) dr), (select unnest(range(-{half}, {half + 1})) dc)"
    windows = f"""with {oracle.PIXELS}, ex as (select max(row) + 1 h, max(col) + 1 w from px), ce as (select px.row, px.col, {fold('px.row + dr', 'h')} r, {fold('px.col + dc', 'w')} c from px, ex, {steps}),
 va as (select ce.row, ce.col, unnest(['b2', 'b4']) band, unnest([coalesce(px.b2, 0), coalesce(px.b4, 0)]) v from ce left join px on px.row = r and px.col = c)
 select row, col, band, avg(v) mean, stddev_pop(v) std, median(v) median, quantile_cont(v, 0.25) p25, quantile_cont(v, 0.75) p75, stddev_pop(v) / (avg(v) + 1e-8) cv from va group by 1, 2, 3"""
    start = lambda c, n: f"greatest(least({c} - {half}, {n} - {SIZE}), 0)::int"
    squares = f"""{oracle.PIXELS}, {oracle.SITES}, ex as (select max(row) + 1 h, max(col) + 1 w from px), pl as (select site, {start('floor(x / 2)::int', 'h')} r0, {start('(site % 128)::int', 'w')} c0 from sites, ex),
 ce as (select site, r0, c0, i, j, coalesce(b2, 0) b2, coalesce(b4, 0) b4 from pl cross join (select unnest(range({SIZE})) i) cross join (select unnest(range({SIZE})) j) left join px on px.row = r0 + i and px.col = c0 + j),
 pa as (select site, r0, c0, list(b2 order by i, j) || list(b4 order by i, j) patch from ce group by 1, 2, 3)"""
    n, last = SIZE * SIZE, SIZE - 1
    copies = f"""cp as (select site, patch, copy, {oracle._hash("site::varchar || '.' || copy::varchar")} h from pa, (select unnest(range(8)) copy)), tu as (select site, patch, copy::int copy, (h % 4)::int turn, (h >> 2) & 1 = 1 across, (h >> 3) & 1 = 1 down, unnest(range({2 * n})) at_ from cp),
 ij as (select *, case when down then {last} - (at_ // {SIZE}) % {SIZE} else (at_ // {SIZE}) % {SIZE} end i, case when across then {last} - at_ % {SIZE} else at_ % {SIZE} end j from tu)
 select site, copy, turn, across, down, at_::int "at", patch[(at_ - at_ % {n} + (case turn when 0 then i when 1 then j when 2 then {last} - i else {last} - j end) * {SIZE} + case turn when 0 then j when 1 then {last} - i when 2 then {last} - j else i end + 1)::int] as value from ij"""
    parts = []
    for t, has in (("v", "site % 3 <> 0"), ("u", "true")):
        parts.append(f"""select a.site, '{t}' target, max(case when a.has then a.t end) y, max(a.e) e, max(a.n) n, count(b.site) k, avg(b.e) me, avg(b.n) mn, avg(b.t) mt, covar_pop(b.e, b.e) * count(b.site) + 0.5 ee, covar_pop(b.n, b.n) * count(b.site) + 0.5 nn, covar_pop(b.e, b.n) * count(b.site) en, covar_pop(b.e, b.t) * count(b.site) et, covar_pop(b.n, b.t) * count(b.site) nt
 from (select *, x / 100 e, y / 100 n, {t} t, {has} has from sites) a left join (select *, x / 100 e, y / 100 n, {t} t from sites where {has}) b on a.site <> b.site and not (sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < 50) group by 1""")
    return {
        "reflected_windows": windows,
        "point_patches": f"with {squares} select * from pa",
        "patch_copies": f"with {squares}, {copies}",
        "target_loo": f"with {oracle.SITES}, s as ({' union all '.join(parts)}) select site, target, k n, y, case when k >= 10 then mt + (et * nn - nt * en) / (ee * nn - en * en) * (e - me) + (nt * ee - et * en) / (ee * nn - en * en) * (n - mn) end predicted from s",
    }
