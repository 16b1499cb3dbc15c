"""Queries over many columns at once: latent components, projections, shared information, continuum."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spectra
from ..operators import multivariate as mv
from ..operators import raster, validation
from ..sources import tables as src
from . import inference, oracle


def _spectral(spark, d):
    s = src.spectra(spark, d)
    return s, mv.moments(s, F.concat("spectrum", F.array("target")))


def vip(spark, d):
    """Importance in projection of every band, and whether it is selected (1 or more)."""
    s, m = _spectral(spark, d)
    scores = mv.importance_in_projection(mv.partial_least_squares(m, 2))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(scores)], "band int, vip double").withColumn("selected", F.col("vip") >= 1)


def pls_predictions(spark, d):
    """The target by two latent components of the spectrum."""
    s, m = _spectral(spark, d)
    return s.select("point_id", "target", mv.predicted(mv.partial_least_squares(m, 2), F.col("spectrum")).alias("predicted"))


def spa_bands(spark, d):
    """Three bands by successive projections."""
    chosen = mv.successive_projections(mv.moments(src.spectra(spark, d), F.col("spectrum")), 3)
    return spark.createDataFrame(list(enumerate(chosen, 1)), "rank int, band int")


def pca_components(spark, d):
    return spark.createDataFrame(mv.principal_components(mv.moments(src.spectra(spark, d), F.col("spectrum"))), "component int, variance double, share double, cumulative double")


def canonical(spark, d):
    """The two measured columns against the two coordinates."""
    m = mv.moments(src.sites(spark, d), F.array("v", "u", "x", "y"))
    return spark.createDataFrame(list(enumerate(mv.canonical_correlations(m, 2), 1)), "component int, r double")


def _informed(spark, d):
    s = src.sites(spark, d).withColumn("w", (F.col("site") * 37 % 101).cast("double"))
    features = s.unpivot(["site", "v", "w"], ["u", "x", "y"], "feature", "x").withColumnRenamed("site", "id")
    return mv.mutual_information(features.unpivot(["id", "feature", "x"], ["v", "w"], "target", "y"), ["feature", "target"])


def mutual_information(spark, d):
    return _informed(spark, d)


def mi_ranking(spark, d):
    """Features by their share of the best feature's information, averaged over the targets."""
    share = F.coalesce(F.try_divide(F.col("mi"), F.max("mi").over(Window.partitionBy("target"))), F.lit(0.0))
    mean = _informed(spark, d).select("feature", share.alias("s")).groupBy("feature").agg(F.avg("s").alias("score"))
    return mean.orderBy(F.desc("score"), "feature").limit(2)  # the two best are what is asked


def continuum(spark, d):
    """Continuum-removed spectra, one row a band."""
    s = src.spectra(spark, d).select("point_id", spectra.continuum_removed(F.col("spectrum"), src.WAVELENGTHS).alias("s"))
    return s.select("point_id", F.posexplode("s").alias("band", "value"))


def chlorophyll(spark, d):
    return src.spectra(spark, d).select("point_id", spectra.chlorophyll_depth(F.col("spectrum"), src.WAVELENGTHS).alias("c")).select("point_id", "c.depth", "c.relative")


def noisy_spectra(spark, d):
    """A copy of every spectrum with noise of 2 % of each band's deviation."""
    long = src.spectra(spark, d).select("point_id", F.posexplode("spectrum").alias("band", "value"))
    return validation.with_noise(long, ["band"], ["point_id", "band"], "value")


def permutation_targets(spark, d):
    s = src.sites(spark, d).unpivot(["site", "u"], ["v", "x", "y"], "target", "value")
    return validation.permutation_targets(s, "site", "target", "u", "value", 199)


def spatial_folds(spark, d):
    return validation.spatial_folds(src.sites(spark, d), "site")


def bootstrap_interval(spark, d):
    """Interval of the R2 of the ridge outside buffers."""
    return validation.bootstrap_r2(inference.ridge_two(spark, d).withColumn("model", F.lit("ridge")), "site", "v", "predicted", ["model"])


def binary_patterns(spark, d):
    px = src.raster(spark, d).select("row", "col", F.least(F.lit(63), F.floor(F.col("b4") / 0.005 * 63)).cast("int").alias("level"))
    return raster.binary_patterns(px, "level", 32)


def queries() -> dict:
    return {f.__name__: f for f in (bootstrap_interval, binary_patterns, vip, pls_predictions, spa_bands, pca_components, canonical, mutual_information, mi_ranking, continuum, chlorophyll, noisy_spectra, permutation_targets, spatial_folds)}


#: Two latent components by their scores, step by step.
LATENT = oracle.LONG + """, z as (select point_id, band, (v - avg(v) over (partition by band)) / stddev_pop(v) over (partition by band) z from raw), ty as (select point_id, (target - avg(target) over ()) / stddev_pop(target) over () y from spec),
 s1 as (select band, avg(z * y) s from z join ty using (point_id) group by 1), w1 as (select band, s / sqrt((select sum(s * s) from s1)) w from s1), t1 as (select point_id, sum(z * w) t from z join w1 using (band) group by 1),
 p1 as (select band, sum(z * t) / (select sum(t * t) from t1) p from z join t1 using (point_id) group by 1), q1 as (select sum(y * t) / sum(t * t) q, sum(t * t) tt from t1 join ty using (point_id)),
 z2 as (select point_id, band, z - t * p z from z join t1 using (point_id) join p1 using (band)), s2 as (select band, avg(z * y) s from z2 join ty using (point_id) group by 1), w2 as (select band, s / sqrt((select sum(s * s) from s2)) w from s2),
 t2 as (select point_id, sum(z * w) t from z2 join w2 using (band) group by 1), q2 as (select sum(y * t) / sum(t * t) q, sum(t * t) tt from t2 join ty using (point_id))"""


def _circle():
    """Places of 16 points on a circle of radius 2, each between four pixels."""
    for p in range(16):
        r, c = round(-2 * math.sin(math.pi * p / 8), 5), round(2 * math.cos(math.pi * p / 8), 5)
        fr, fc = r - math.floor(r), c - math.floor(c)
        for dr, wr in ((0, 1 - fr), (1, fr)):
            for dc, wc in ((0, 1 - fc), (1, fc)):
                yield p, math.floor(r) + dr, math.floor(c) + dc, wr * wc


def oracle_sql() -> dict[str, str]:
    h = oracle._hash
    even = lambda tag: "((" + h(f"point_id::varchar || '.' || band::varchar || '.{tag}'") + ") + 0.5::double) / 4294967296.0::double"
    psi = lambda c: f"(list_sum(list_transform(range(1, greatest({c}, 2)), lambda i: case when i < {c} then 1.0::double / i else 0 end)) - 0.5772156649015329::double)"
    info = oracle.SITES + f""", f as (select site, v, (site * 37 % 101)::double w, unnest(['u', 'x', 'y']) feature, unnest([u, x, y]) a from sites), l as (select site id, feature, unnest(['v', 'w']) target, a, unnest([v, w]) b from f),
 un as (select id, feature, target, a, b, stddev_pop(a) over (partition by feature, target) sa, stddev_pop(b) over (partition by feature, target) sb from l),
 pr as (select p.feature, p.target, p.id, abs(p.a - q.a) / p.sa da, abs(p.b - q.b) / p.sb db from un p join un q on p.feature = q.feature and p.target = q.target and p.id <> q.id),
 rk as (select *, row_number() over (partition by feature, target, id order by greatest(da, db)) k from pr), rd as (select feature, target, id, max(greatest(da, db)) r from rk where k = 5 group by 1, 2, 3),
 ct as (select feature, target, id, count(*) filter (da < r) + 1 na, count(*) filter (db < r) + 1 nb from pr join rd using (feature, target, id) group by 1, 2, 3),
 mi as (select feature, target, count(*) n, greatest(0, {psi('count(*)')} + {psi('5')} - avg(pa + pb)) mi from (select *, {psi('na')} pa, {psi('nb')} pb from ct) group by 1, 2)"""
    gram = ", g as (select a.band i, b.band j, sum(a.v * b.v) g from raw a join raw b using (point_id) group by 1, 2)"
    step = lambda n, chosen: f", g{n + 1} as (select a.i, a.j, a.g - b.g * c.g / d.g g from g{n or ''} a join g{n or ''} b on b.i = a.i and b.j = (select band from c{n}) join g{n or ''} c on c.i = a.j and c.j = (select band from c{n}) join g{n or ''} d on d.i = (select band from c{n}) and d.j = d.i), c{n + 1} as (select i band from g{n + 1} where i = j and i not in ({chosen}) order by g desc, i limit 1)"
    density = lambda x: f"exp(-({x}) * ({x}) / 2) / sqrt(2 * pi())"
    below = lambda z: f"(0.5::double + {inference._simpson(density('@'), z, 2000)})"
    bound = lambda tail: f"{below(f'(z + (z + ({tail})) / (1 - acceleration * (z + ({tail}))))')} * 1999"
    at = lambda x: f"b[floor({x})::int + 1] + ({x} - floor({x})) * (b[least(floor({x})::int + 2, 2000)] - b[floor({x})::int + 1])"
    circle = ", ".join(f"({p}, {dr}, {dc}, {w!r}::double)" for p, dr, dc, w in _circle())
    return {
        "bootstrap_interval": f"""with recursive rg as ({inference.oracle_sql()["ridge_two"]}), d as (select v y, predicted p, row_number() over (order by site) - 1 i, count(*) over () n from rg where predicted is not null),
 r as (select count(*) n, 1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) r2 from d, (select avg(y) m from d)),
 jr as (select o.i, count(*) n, avg(d.y) m from d o join d on d.i <> o.i group by 1), jk as (select o.i, 1 - sum((d.y - d.p) * (d.y - d.p)) / sum((d.y - o.m) * (d.y - o.m)) j from jr o join d on d.i <> o.i group by 1),
 ac as (select sum(power(m - j, 3)) / (6 * power(sum((m - j) * (m - j)), 1.5) + 1e-12) acceleration from jk, (select avg(j) m from jk)),
 dr as (select k draw, t.y, t.p from (select unnest(range(1, 2001)) k) cross join d s join d t on t.i = {h("k::varchar || '.' || s.i::varchar")} % s.n) , bo as (select draw, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) b from dr group by 1),
 ba as (select list_sort(list(b)) b, count(*) filter (b < r2 - 1e-12) / 2000.0::double as below from bo, r),
 nw(k, z) as (select 0, 0.0::double union all select k + 1, z + (below - {below('z')}) / ({density('z')}) from nw, ba where k < 12), f as (select n, r2, below, acceleration, b, z from r, ac, ba, nw where k = 12),
 bn as (select *, {bound('-1.9599639845400536::double')} lo, {bound('1.9599639845400536::double')} hi from f) select 'ridge' model, n, r2, below, acceleration, {at('lo')} low, {at('hi')} high from bn""",
        "binary_patterns": f"""with {oracle.PIXELS}, lv as (select row, col, row // 32 tr, col // 32 tc, least(63, floor(b4 / 0.005 * 63))::int l from px), o(p, dr, dc, w) as (values {circle}),
 ri as (select a.tr, a.tc, a.row, a.col, p, sum(w * coalesce(b.l, 0)) - max(a.l) >= -1e-9 bright from lv a cross join o left join lv b on b.row = a.row + dr and b.col = a.col + dc and b.tr = a.tr and b.tc = a.tc group by 1, 2, 3, 4, 5),
 nx as (select *, lead(bright) over (partition by row, col order by p) after from ri), co as (select tr, tc, row, col, case when count(*) filter (bright <> after) <= 2 then count(*) filter (bright) else 17 end code from nx group by 1, 2, 3, 4),
 n as (select tr, tc, count(*) n from co group by 1, 2), c as (select tr, tc, floor(code / 2.25)::int bin, count(*) k from co group by 1, 2, 3)
 select n.tr::int tile_r, n.tc::int tile_c, i::int bin, coalesce(k, 0) / (n * 2.25::double) density from n cross join (select unnest(range(0, 8)) i) left join c on c.tr = n.tr and c.tc = n.tc and c.bin = i""",
        "vip": f"with {LATENT}, o as (select w1.band::int band, sqrt(64 * (q1.q * q1.q * q1.tt * w1.w * w1.w + q2.q * q2.q * q2.tt * w2.w * w2.w) / (q1.q * q1.q * q1.tt + q2.q * q2.q * q2.tt)) vip from w1 join w2 using (band), q1, q2) select *, vip >= 1 selected from o",
        "pls_predictions": f"with {LATENT} select point_id, target, (select avg(target) from spec) + (select stddev_pop(target) from spec) * (q1.q * t1.t + q2.q * t2.t) predicted from spec join t1 using (point_id) join t2 using (point_id), q1, q2",
        "spa_bands": f"with {oracle.LONG}{gram}, c0 as (select band from raw group by 1 order by var_pop(v) desc, band limit 1){step(0, 'select band from c0')}{step(1, 'select band from c0 union all select band from c1')} select 1 as rank, band::int band from c0 union all select 2, band::int from c1 union all select 3, band::int from c2",
        "canonical": f"""with {oracle.SITES}, c as (select var_pop(v) vv, var_pop(u) uu, covar_pop(v, u) vu, var_pop(x) xx, var_pop(y) yy, covar_pop(x, y) xy, covar_pop(v, x) vx, covar_pop(v, y) vy, covar_pop(u, x) ux, covar_pop(u, y) uy from sites),
 h as (select (uu * vx - vu * ux) / (vv * uu - vu * vu) a, (uu * vy - vu * uy) / (vv * uu - vu * vu) b, (vv * ux - vu * vx) / (vv * uu - vu * vu) c, (vv * uy - vu * vy) / (vv * uu - vu * vu) d,
 (yy * vx - xy * vy) / (xx * yy - xy * xy) e, (yy * ux - xy * uy) / (xx * yy - xy * xy) f, (xx * vy - xy * vx) / (xx * yy - xy * xy) g, (xx * uy - xy * ux) / (xx * yy - xy * xy) h from c),
 t as (select a * e + b * g + c * f + d * h t, (a * d - b * c) * (e * h - f * g) det from h) select 1 component, sqrt((t + sqrt(t * t - 4 * det)) / 2) r from t union all select 2, sqrt(2 * det / (t + sqrt(t * t - 4 * det))) from t""",
        "mutual_information": f"with {info} select * from mi",
        "mi_ranking": f"with {info} select feature, avg(s) score from (select feature, coalesce(mi / nullif(max(mi) over (partition by target), 0), 0) s from mi) group by 1 order by 2 desc, 1 limit 2",
        "continuum": f"""with {oracle.LONG}, x as (select point_id, band, v, 390.0::double + 10 * band w from raw),
 sl as (select a.point_id, a.band, min((a.v - b.v) / (a.w - b.w)) filter (b.band < a.band) low, max((a.v - b.v) / (a.w - b.w)) filter (b.band < a.band) high, min((b.v - a.v) / (b.w - a.w)) filter (b.band > a.band) least, max((b.v - a.v) / (b.w - a.w)) filter (b.band > a.band) most from x a join x b on a.point_id = b.point_id and a.band <> b.band group by 1, 2),
 k as (select point_id, band, v, w, coalesce(low > most or high < least, true) corner from x join sl using (point_id, band)),
 n as (select *, sum(corner::int) over (partition by point_id) corners, max(case when corner then band end) over (partition by point_id order by band) lo, min(case when corner then band end) over (partition by point_id order by band desc) hi from k),
 i as (select n.*, a.v + case when n.hi = n.lo then 0 else (b.v - a.v) / (b.w - a.w) * (n.w - a.w) end line from n join x a on a.point_id = n.point_id and a.band = n.lo join x b on b.point_id = n.point_id and b.band = n.hi)
 select point_id, band::int band, case when corners = 2 or line = 0 then v else v / line end as value from i""",
        "chlorophyll": f"with {oracle.LONG}, b as (select point_id, max(v) filter (band = 16) a, max(v) filter (band = 29) m, max(v) filter (band = 36) c from raw group by 1), l as (select point_id, m, a + (c - a) * (130 / 200.0::double) line from b) select point_id, line - m depth, (line - m) / (line + 1e-8) as relative from l",
        "noisy_spectra": f"with {oracle.LONG} select point_id, band::int band, v as value, v + 0.02::double * stddev_pop(v) over (partition by band) * sqrt(-2 * ln({even('u')})) * cos(2 * pi() * {even('v')}) noisy from raw",
        "permutation_targets": f"""with {oracle.SITES}, l as (select site, u, unnest(['v', 'x', 'y']) target, unnest([v, x, y]) y from sites), r as (select unnest(range(1, 200)) p),
 e as (select target, p, site, u, y, row_number() over (partition by target, p order by site) i, row_number() over (partition by target, p order by {h("site::varchar || '.' || p::varchar || '.' || target")}, site) j from l, r),
 s as (select a.target, a.p, round(power(corr(a.u, b.y), 2), 9) r from e a join e b on a.target = b.target and a.p = b.p and a.i = b.j group by 1, 2), o as (select target, count(*) n, round(power(corr(u, y), 2), 9) r2 from l group by 1)
 select target, n, r2, count(*) n_permutations, (count(*) filter (s.r >= r2) + 1) / (count(*) + 1.0::double) p from s join o using (target) group by 1, 2, 3""",
    }
