"""Queries with p-values and models over several columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions
from ..operators import independence, models, raster, spatial, stats, validation
from ..sources import readers
from ..sources import tables as src
from . import oracle
from . import queries as q

KEYS = ["date", "feature", "element"]
_LEVELS = "[" + ", ".join(f"{k / (independence.LEVELS - 1)!r}" for k in range(independence.LEVELS)) + "]"


def pearson_p(spark, d):
    r = stats.pearson(q.feature_pairs(spark, d), KEYS)
    return r.select(*KEYS, "n", "r", distributions.correlation_p(F.col("r"), F.col("n")).alias("p"))


def spearman_p(spark, d):
    r = stats.spearman(q.feature_pairs(spark, d), KEYS)
    return r.select(*KEYS, "n", "rho", distributions.correlation_p(F.col("rho"), F.col("n")).alias("p"))


def correlation_profile(spark, d):
    """Pearson and Spearman of every pair in one row, strongest first (a report's order)."""
    out = pearson_p(spark, d).withColumnRenamed("p", "pearson_p").join(spearman_p(spark, d).drop("n").withColumnRenamed("p", "spearman_p"), KEYS)
    return out.withColumn("label", stats.significance_label(F.col("pearson_p"))).orderBy(F.abs("r").desc(), *KEYS)


def kendall_p(spark, d):
    return stats.kendall_p(src.sites(spark, d).select(F.col("site").alias("id"), F.col("v").alias("x"), F.col("u").alias("y")))


def morans_p(spark, d):
    m = spatial.morans_i(src.sites(spark, d), 8)
    return m.withColumn("p", distributions.normal_two_sided(F.col("z")))


def partial_two(spark, d):
    """Bands against price, given the size and the number of observations."""
    long = src.band_points(spark, d).unpivot(["point_id", "date", "size", "price", "n_obs"], ["b", "g", "r", "e"], "feature", "x")
    return stats.partial_given(long, ["date", "feature"], "x", "price", ["size", "n_obs"])


def hsic(spark, d):
    return stats.hsic(src.sites(spark, d).select(F.col("site").alias("id"), F.col("v").alias("x"), F.col("u").alias("y")))


def hsic_p(spark, d):
    return independence.hsic_test(src.sites(spark, d).select(F.col("site").alias("id"), F.col("v").alias("x"), F.col("u").alias("y")))


def window_correlation(spark, d):
    """How much more the best window says of the next band than the single pixel."""
    px = src.raster(spark, d)
    wide = px.select("row", "col", F.col("b4").alias("y"))
    found = []
    for w in (1, 3, 5, 7):
        f = raster.window_stats(px, "b2", w).join(wide, ["row", "col"])
        found.append(f.select(F.lit(w).alias("window"), F.col("mean").alias("x"), "y"))
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    r = stats.pearson(pairs, ["window"]).select("window", "n", "r", F.abs("r").alias("strength"))
    one = F.max(F.when(F.col("window") == 1, F.col("strength"))).over(Window.partitionBy())  # four rows
    return r.withColumn("gain", F.col("strength") - one)


def ridge_two(spark, d):
    """Two-column ridge on the sites outside each buffer, in closed form."""
    return models.buffered_ridge(src.sites(spark, d).withColumn("w", F.col("x") / 100.0), ["u", "w"], "v", 50.0, 0.5).select("site", "n", "v", "predicted")


def variogram_fit(spark, d):
    return models.fit_variogram(spatial.semivariogram(src.sites(spark, d)))


def repeated_group_folds(spark, d):
    """Ten repeats of folds by point, each with its own seed."""
    points = src.band_points(spark, d).select("point_id").distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(9))))
    points = points.withColumn("key", F.concat_ws(".", "point_id", "repeat"))
    return points.select("repeat", validation.fold_of("key").alias("fold")).groupBy("repeat", "fold").agg(F.count("*").alias("points"))


def metrics_join(spark, d):
    """Baseline next to the model by element."""
    base = q.baseline_mean_r2(spark, d).select("l_returnflag", F.col("rmse").alias("rmse_base"))
    model = stats.regression_metrics(q._predicted(spark, d), ["l_returnflag"]).select("l_returnflag", "r2", "rmse")
    return base.join(model, "l_returnflag", "left").withColumn("gain", F.col("rmse_base") - F.col("rmse"))


def glcm_texture(spark, d):
    px = src.raster(spark, d).select("row", "col", F.least(F.lit(63), F.floor(F.col("b4") / 0.005 * 63)).cast("int").alias("level"))
    return raster.glcm_texture(px, "level", 32)


def clamped_windows(spark, d):
    s = src.sites(spark, d).select("site", F.floor(F.col("x") / 2).cast("int").alias("row"), (F.col("site") % 128).cast("int").alias("col"))
    return raster.clamped_window(s, src.raster(spark, d), "b2", 7, 100, 128)


def raster_window(spark, d):
    """The five bands of a window of the raster; only its rows are joined with their sums."""
    return src.raster(spark, d).where("row between 5 and 20 and col between 30 and 60")


def wavelength_map(spark, d):
    """Channels that spectra have, numbered from 1, and their wavelengths."""
    places = src.spectra(spark, d).select(F.explode(F.sequence(F.lit(1), F.size("spectrum"))).alias("channel")).groupBy("channel").agg(F.count("*").alias("n_spectra"))
    return readers.wavelength_map(spark, q.W).where("wavelength between 350 and 1100").join(places, "channel")


def parsed_channels(spark, d):
    p = src.table(spark, d, "part")
    stem = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.lpad(F.col("p_partkey").cast("string"), 8, "9"))
    return p.select("p_partkey", stem.alias("stem"), readers.channel_of(stem, 3).alias("channel"))


def last_set_wins(spark, d):
    """Per point and channel the value of the latest set; channels without a name are skipped."""
    names = {1: "blue", 2: "green", 3: "red", 4: "edge", 5: "nir"}
    obs = src.observations(spark, d).where(F.col("channel").isin(*names))
    wide = obs.groupBy("point_id").pivot("channel", list(names)).agg(F.max_by("value", F.struct("set_id", "value")))
    return wide.toDF("point_id", *names.values())


def valid_bands(spark, d):
    """Observations with a value and without one (zero) of every point."""
    v = F.nullif(F.col("value"), F.lit(0))
    return src.observations(spark, d).groupBy("point_id").agg(F.count(v).alias("valid"), (F.count("*") - F.count(v)).alias("missing"), F.countDistinct(F.when(v.isNotNull(), F.col("channel"))).alias("bands"))


def spectra_of_dates(spark, d):
    """Mean spectra of two dates, united, over the channels inside 500 to 900 nm."""
    s = src.spectra(spark, d).select("point_id", "spectrum", F.when(F.col("point_id") % 2 == 0, "date1").otherwise("date2").alias("date"))
    long = s.select("date", F.posexplode("spectrum").alias("at", "value")).withColumn("channel", F.col("at") + 1)
    dim = readers.wavelength_map(spark, q.W).where("wavelength between 500 and 900")
    return long.join(F.broadcast(dim), "channel").groupBy("date", "channel", "wavelength").agg(F.avg("value").alias("value"))


def buffer_map(spark, d):
    """Buffers by element, 50 where none is recommended."""
    known = spark.createDataFrame([(0, 30), (3, 100), (7, 55)], "element int, buffer int")
    return src.table(spark, d, "nation").select(F.col("n_nationkey").alias("element")).join(F.broadcast(known), "element", "left").withColumn("buffer", F.coalesce("buffer", F.lit(50)))


def gathered_textures(spark, d):
    """Feature sources aligned with all points: a source's median where a point is missing, else 0."""
    base = src.table(spark, d, "part").select(F.col("p_partkey").alias("point_id"))
    pts = src.band_points(spark, d)
    for date in ("A", "N", "R"):
        one = pts.where((F.col("date") == date) & (F.col("n_obs") > 6)).select("point_id", F.col("r").alias(f"r_{date.lower()}"))
        middle = one.agg(F.percentile(f"r_{date.lower()}", F.lit(0.5)).alias("_m"))
        base = base.join(one, "point_id", "left").join(F.broadcast(middle)).withColumn(f"r_{date.lower()}", F.coalesce(f"r_{date.lower()}", "_m", F.lit(0.0))).drop("_m")
    return base


def feature_names(spark, d):
    """Window, band and statistic out of a feature's name, and its label without a unit."""
    name = F.concat(F.lit("img_w"), (F.col("s_suppkey") % 4 * 2 + 1).cast("string"), F.lit("_b"), (F.col("s_suppkey") % 5).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "_mean").otherwise("_std"))
    unit = F.concat(F.lit("Fe"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ", %").otherwise(", mg/kg"))
    names = src.table(spark, d, "supplier").select("s_suppkey", name.alias("name"), unit.alias("unit"))
    return names.select(
        "s_suppkey", F.regexp_extract("name", r"_w(\d+)_", 1).cast("int").alias("window"), F.get(F.split("name", "_"), F.lit(2)).alias("band"), F.element_at(F.split("name", "_"), -1).alias("stat"),
        F.replace(F.replace("unit", F.lit(", mg/kg"), F.lit("")), F.lit(", %"), F.lit("")).alias("label"),
    )


def report_rows(spark, d):
    m = stats.regression_metrics(q._predicted(spark, d), ["l_returnflag"]).select("l_returnflag", "n", "r2", "mae")
    return m.select("l_returnflag", readers.markdown_row(m, 2).alias("line"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            pearson_p, spearman_p, correlation_profile, kendall_p, morans_p, partial_two, hsic, hsic_p, window_correlation, ridge_two, variogram_fit, repeated_group_folds, metrics_join, glcm_texture, clamped_windows,
            raster_window, wavelength_map, parsed_channels, last_set_wins, valid_bands, spectra_of_dates, buffer_map, gathered_textures, feature_names, report_rows,
        )
    } | {"window_stats_w1": q._window(1), "window_stats_w5": q._window(5)}


def _simpson(f: str, to: str, steps: int) -> str:
    """Integral of ``f`` over a from 0 to ``to``."""
    weight = f"(case when i in (0, {steps}) then 1 when i % 2 = 1 then 4 else 2 end)"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * {f.replace('@', f'(({to}) * i / {steps}.0::double)')})) * ({to}) / {3 * steps}.0::double)"


def _t_p(r: str, n: str) -> str:
    angle = f"atan(abs({r}) / sqrt(1 - {r} * {r}))"  # the tangent is t / sqrt(df)
    inside = _simpson(f"power(cos(@), {n} - 3)", angle, 20000)
    return f"greatest(0, 1 - 2 / sqrt(pi()) * exp(lgamma(({n} - 1) / 2.0::double) - lgamma(({n} - 2) / 2.0::double)) * {inside})"


def _normal_p(z: str) -> str:
    return f"greatest(0, 1 - 2 / sqrt(2 * pi()) * {_simpson('exp(-@ * @ / 2)', f'abs({z})', 4000)})"


def oracle_sql() -> dict[str, str]:
    spear = oracle.oracle_sql()["spearman_matrix"]
    pear = f"pq as (select date, feature, element, n, r, {_t_p('r', 'n')} p from pe)"
    sq = f"sm as ({spear}), sq as (select date, feature, element, n, rho, {_t_p('rho', 'n')} p from sm)"
    rad = "rad(radius) as (values (50.0::double))"
    moran = oracle.oracle_sql()["morans_i"].replace("<= 4)", "<= 8)")
    corr = oracle._corr
    first = lambda a, b, z: f"(({a}{b} - {a}{z} * {b}{z}) / sqrt((1 - {a}{z} * {a}{z}) * (1 - {b}{z} * {b}{z})))"
    win = lambda h: oracle._window(h)
    ladder = "case when r2 is null then 'unknown' when p < 0.05 and r2 > 0.5 then 'strong' when p < 0.05 and r2 > 0.2 then 'moderate' when p < 0.05 and r2 > 0 then 'weak' when r2 > 0 then 'not significant' else 'no signal' end category"
    return {
        "pearson_p": f"with {oracle.PEARSON}, {pear} select * from pq",
        "category_ladder": f"with {oracle.PEARSON}, {pear}, q as (select date, feature, element, r*r r2, p from pq) select *, {ladder} from q",
        "spearman_p": f"with {sq} select * from sq",
        "correlation_profile": f"with {oracle.PEARSON}, {pear}, {sq} select pq.date, pq.feature, pq.element, pq.n, r, pq.p pearson_p, rho, sq.p spearman_p, case when pq.p < 0.001 then '***' when pq.p < 0.01 then '**' when pq.p < 0.05 then '*' else '' end as label from pq join sq using (date, feature, element)",
        "kendall_p": f"""with {oracle.SITES}, c as (select count(*) n_pairs, sum(sign(b.v-a.v)*sign(b.u-a.u)) s, sum(abs(sign(b.v-a.v))) nx, sum(abs(sign(b.u-a.u))) ny from sites a join sites b on a.site < b.site),
 tx as (select sum(k*(k-1)) a1, sum(k*(k-1)*(k-2)) a2, sum(k*(k-1)*(2*k+5)) a3 from (select count(*)::double k from sites group by v)), ty as (select sum(k*(k-1)) b1, sum(k*(k-1)*(k-2)) b2, sum(k*(k-1)*(2*k+5)) b3 from (select count(*)::double k from sites group by u)),
 n as (select count(*)::double n from sites), z as (select n_pairs, s / sqrt(nx * ny) tau, s / sqrt((n*(n-1)*(2*n+5) - a3 - b3) / 18 + a1*b1 / (2*n*(n-1)) + a2*b2 / (9*n*(n-1)*(n-2))) z from c, tx, ty, n) select n_pairs, tau, z, {_normal_p('z')} p from z""",
        "morans_p": f"select n, s0, moran, expected, z, {_normal_p('z')} p from ({moran})",
        "partial_two": f"""with {oracle.POINTS}, lo as (select date, size z, n_obs w, price y, unnest(['b', 'g', 'r', 'e']) feature, unnest([b, g, r, e]) x from pts), c as (select date, feature, count(*) n, {corr('x', 'y')} xy, {corr('x', 'z')} xz, {corr('y', 'z')} yz, {corr('x', 'w')} xw, {corr('y', 'w')} yw, {corr('w', 'z')} wz from lo group by 1, 2),
 f as (select date, feature, n, xy r, {first('x', 'y', 'z')} a, {first('x', 'w', 'z')} b, {first('y', 'w', 'z')} c from c) select date, feature, n, r, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) partial from f""",
        "hsic_p": f"""with {oracle.SITES}, s as materialized (select v, u, row_number() over (order by {oracle._hash("site::varchar || '.42'")}, site) - 1 i from sites), q as (select unnest(quantile_cont(v, {_LEVELS})) a, unnest(quantile_cont(u, {_LEVELS})) b, unnest(range({independence.LEVELS})) k from sites),
 w as materialized (select median(abs(l.a - r.a)) wx, median(abs(l.b - r.b)) wy from q l join q r on l.k < r.k), kn as materialized (select l.i, r.i j, exp(-(l.v-r.v)*(l.v-r.v) / (2*wx*wx)) x, exp(-(l.u-r.u)*(l.u-r.u) / (2*wy*wy)) y from s l, s r, w),
 kc as materialized (select i, j, x - avg(x) over (partition by i) - avg(x) over (partition by j) + avg(x) over () x, y from kn), nn as (select count(*) n from sites),
 pm as materialized (select p, coalesce(list_filter([{oracle._hash("p::varchar || '.42.a.' || k::varchar")} % n for k in range({independence.TRIES})], lambda v: gcd(v, n) = 1)[1], 1) a, {oracle._hash("p::varchar || '.42.c'")} % n c from (select unnest(range(1, 200)) p), nn union all select 0, 1, 0),
 tw as materialized (select p, i, (a * i + c) % n t from pm, nn, s), st as materialized (select l.p, avg(k.x * m.y) h from tw l join tw r on l.p = r.p join kc k on k.i = l.i and k.j = r.i join kn m on m.i = l.t and m.j = r.t group by 1) select (select n from nn) n, o.h hsic, 199 n_permutations, (select (1 + count(*)) / 200::double from st where p > 0 and round(h, 9) >= round(o.h, 9)) p from st o where o.p = 0""",
        "hsic": f"""with {oracle.SITES}, m as (select (select median(abs(a.v-b.v)) from sites a join sites b on a.site < b.site) bx, (select median(abs(a.u-b.u)) from sites a join sites b on a.site < b.site) by_), k as (select a.site i, b.site j, exp(-(a.v-b.v)*(a.v-b.v) / (2*bx*bx)) x, exp(-(a.u-b.u)*(a.u-b.u) / (2*by_*by_)) y from sites a, sites b, m),
 c as (select x - avg(x) over (partition by i) - avg(x) over (partition by j) + avg(x) over () x, y from k) select (select count(*) from sites) n, avg(x * y) hsic from c""",
        "window_correlation": f"with {oracle.PIXELS.replace('sums as', 'sums as')}, w as (" + " union all ".join(f"select {2 * h + 1} as wn, a.row, a.col, avg(b.b2) x, max(a.b4) y from px a join (select unnest(range(-{h}, {h} + 1)) dr) r on true join (select unnest(range(-{h}, {h} + 1)) dc) c on true join px b on b.row = a.row + dr and b.col = a.col + dc where b.b2 > 0 group by 2, 3" for h in range(4))
        + f"), g as (select wn::int as \"window\", count(*) n, {corr('x', 'y')} r from w group by 1) select *, abs(r) strength, abs(r) - max(abs(r)) filter (\"window\" = 1) over () gain from g",
        "ridge_two": f"""with {oracle.SITES}, {rad}, t as (select a.site, a.v, a.u, a.x / 100 w, b.u bu, b.x / 100 bw, b.v bv from sites a join sites b on a.site <> b.site and not (sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < 50)),
 s as (select site, max(v) v, max(u) u, max(w) w, count(*) n, avg(bu) mu, avg(bw) mw, avg(bv) mv, covar_pop(bu, bu) * count(*) + 0.5 uu, covar_pop(bw, bw) * count(*) + 0.5 ww, covar_pop(bu, bw) * count(*) uw, covar_pop(bu, bv) * count(*) uv, covar_pop(bw, bv) * count(*) wv from t group by 1)
 select site, n, v, mv + (uv * ww - wv * uw) / (uu * ww - uw * uw) * (u - mu) + (wv * uu - uv * uw) / (uu * ww - uw * uw) * (w - mw) predicted from s union all select site, 0, v, null from sites where site not in (select site from s)""",
        "variogram_fit": models_sql(oracle.oracle_sql()["semivariogram"]),
        "repeated_group_folds": f"with f as (select distinct l_partkey p from lineitem) select rp::int as repeat, ({oracle._hash(chr(112) + '::varchar || ' + chr(39) + '.' + chr(39) + ' || rp::varchar || ' + chr(39) + '.42' + chr(39))} % 5)::int fold, count(*) points from f, (select unnest(range(0, 10)) rp) group by 1, 2",
        "metrics_join": f"with {oracle.PRED}, m as (select l_returnflag, stddev_pop(y) rmse_base, 1 - sum((y-p)*(y-p)) / (var_pop(y) * count(*)) r2, sqrt(avg((y-p)*(y-p))) rmse from pd group by 1) select *, rmse_base - rmse gain from m",
        "glcm_texture": f"""with {oracle.PIXELS}, lv as (select row, col, row // 32 tr, col // 32 tc, least(63, floor(b4 / 0.005 * 63))::int l from px), o(d, k, dr, dc) as (values (1, 0, 0, 1), (1, 1, 1, 1), (1, 2, 1, 0), (1, 3, 1, -1), (2, 0, 0, 2), (2, 1, 2, 2), (2, 2, 2, 0), (2, 3, 2, -2)),
 m as (select a.tr, a.tc, d, k, a.l i, b.l j from lv a cross join o join lv b on b.row = a.row + dr and b.col = a.col + dc and b.tr = a.tr and b.tc = a.tc), c as (select tr, tc, d, k, i, j, count(*)::double w from (select * from m union all select tr, tc, d, k, j, i from m) group by all),
 e as (select tr, tc, d, k, sum(w*(i-j)*(i-j)) / sum(w) contrast, sum(w*abs(i-j)) / sum(w) dissimilarity, sum(w/(1.0::double+(i-j)*(i-j))) / sum(w) homogeneity, sum(w*w)/(sum(w)*sum(w)) asm, sqrt(sum(w*w)/(sum(w)*sum(w))) energy,
 case when sum(w*i*i)/sum(w) - (sum(w*i)/sum(w))*(sum(w*i)/sum(w)) < 1e-9 then 1.0::double else (sum(w*i*j)/sum(w) - (sum(w*i)/sum(w))*(sum(w*i)/sum(w))) / (sum(w*i*i)/sum(w) - (sum(w*i)/sum(w))*(sum(w*i)/sum(w))) end correlation from c group by 1, 2, 3, 4),
 l as (unpivot e on contrast, dissimilarity, homogeneity, asm, energy, correlation into name property value x) select tr::int tile_r, tc::int tile_c, property, avg(x) mean, stddev_pop(x) std from l group by 1, 2, 3""",
        "clamped_windows": f"with {oracle.PIXELS}, {oracle.SITES}, s as (select site, least(greatest(floor(x / 2)::int - 3, 0), 93) r0, least(greatest((site % 128)::int - 3, 0), 121) c0 from sites) select site, count(b2) filter (b2 > 0) n, avg(b2) filter (b2 > 0) mean, stddev_pop(b2) filter (b2 > 0) std, min(b2) filter (b2 > 0) least, max(b2) filter (b2 > 0) most from s join px on row between r0 and r0 + 6 and col between c0 and c0 + 6 group by 1",
        "raster_window": f"with {oracle.PIXELS} select * from px where row between 5 and 20 and col between 30 and 60",
        "wavelength_map": "select i::int channel, 380.0::double + 10 * i wavelength, count(*) n_spectra from (select unnest(range(1, len(embedding) + 1)) i from embeddings) group by 1, 2",
        "parsed_channels": "with s as (select p_partkey, case when p_partkey % 3 = 0 then p_brand else lpad(p_partkey::varchar, 8, '9') end stem from part) select p_partkey, stem, case when regexp_full_match(stem, '[0-9]+') then substr(stem, 4)::int end channel from s",
        "last_set_wins": f"with {oracle.OBS}, l as (select point_id, channel, value, row_number() over (partition by point_id, channel order by set_id desc, value desc) k from obs where channel <= 5) select point_id, " + ", ".join(f"max(value) filter (channel = {i}) {n}" for i, n in enumerate(("blue", "green", "red", "edge", "nir"), 1)) + " from l where k = 1 group by 1",
        "valid_bands": f"with {oracle.OBS} select point_id, count(*) filter (value <> 0) valid, count(*) filter (value = 0) missing, count(distinct channel) filter (value <> 0) bands from obs group by 1",
        "spectra_of_dates": f"with {oracle.LONG} select case when point_id % 2 = 0 then 'date1' else 'date2' end date, (band + 1)::int channel, 390.0::double + 10 * band wavelength, avg(v) as value from raw where 390 + 10 * band between 500 and 900 group by 1, 2, 3",
        "buffer_map": "select n_nationkey element, case n_nationkey when 0 then 30 when 3 then 100 when 7 then 55 else 50 end buffer from nation",
        "gathered_textures": f"with {oracle.POINTS}, " + ", ".join(f"s{c} as (select point_id, r from pts where date = '{c}' and n_obs > 6)" for c in "ANR") + " select p_partkey point_id, " + ", ".join(f"coalesce(s{c}.r, (select median(r) from s{c}), 0) r_{c.lower()}" for c in "ANR") + " from part " + " ".join(f"left join s{c} on s{c}.point_id = p_partkey" for c in "ANR"),
        "feature_names": "select s_suppkey, (s_suppkey % 4 * 2 + 1)::int as \"window\", 'b' || (s_suppkey % 5)::varchar band, case when s_suppkey % 2 = 0 then 'mean' else 'std' end stat, 'Fe' || s_suppkey::varchar as label from supplier",
        "report_rows": f"with {oracle.PRED}, m as (select l_returnflag, count(*) n, 1 - sum((y-p)*(y-p)) / (var_pop(y) * count(*)) r2, avg(abs(y-p)) mae from pd group by 1) select l_returnflag, '| ' || l_returnflag || ' | ' || n::varchar || ' | ' || printf('%.2f', r2) || ' | ' || printf('%.2f', mae) || ' |' line from m",
        "window_stats_w1": win(0),
        "window_stats_w5": win(2),
    }


def models_sql(semivariogram: str) -> str:
    """The grid of ``models.fit_variogram``: for each model and range the least-squares nugget and sill."""
    shape = "case model when 'spherical' then case when distance < reach then 1.5*distance/reach - 0.5*power(distance/reach, 3) else 1 end when 'exponential' then 1 - exp(-3*distance/reach) else 1 - exp(-3*power(distance/reach, 2)) end"
    return f"""with e as ({semivariogram}), g as (select model, (select max(distance) from e) * k / 20.0::double reach, k from (select unnest(['spherical', 'exponential', 'gaussian']) model), (select unnest(range(1, 21)) k)),
 s as (select model, k, reach, distance, gamma, {shape} f from g, e), l as (select model, k, reach, coalesce(regr_slope(gamma, f), 0) a, avg(gamma) m, avg(f) mf from s group by 1, 2, 3), c as (select *, greatest(0, a) part, greatest(0, m - greatest(0, a) * mf) nugget from l),
 r as (select c.model, c.k, c.reach, nugget, part, sqrt(avg((gamma - nugget - part * f) * (gamma - nugget - part * f))) * case when c.k > 19 then 2 else 1 end rmse from c join s using (model, k) group by 1, 2, 3, 4, 5),
 flat as (select avg(gamma) m, max(gamma) - min(gamma) span from e) select case when span / m < 0.15 then 'nugget' else model end model, case when span / m < 0.15 then m else nugget end nugget, case when span / m < 0.15 then 0 else part end partial_sill, case when span / m < 0.15 then 0 else reach end as range, case when span / m < 0.15 then null else rmse end rmse from r, flat order by round(rmse, 9), model, k limit 1"""
