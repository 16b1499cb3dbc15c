"""Variograms with their buffers, correlograms, tuned and stacked models: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distributions, spectra
from ..operators import holdout, stats, tuning, validation, variogram
from ..operators.selection import parted_moments
from ..sources import tables as src
from . import inference, oracle

FEATURES = ["b", "g", "r", "e"]


def _surveys(spark, d):
    """Two elements at two dates: sites of even and of odd numbers."""
    s = src.sites(spark, d).withColumn("date", F.when(F.col("site") % 2 == 0, "date1").otherwise("date2"))
    return s.unpivot(["site", "date", "x", "y"], ["v", "u"], "element", "value").withColumnRenamed("value", "v")


def variogram_lags(spark, d):
    return variogram.empirical(_surveys(spark, d), ["element", "date"])


def variogram_ranges(spark, d):
    return variogram.fit(variogram_lags(spark, d), ["element", "date"])


def fitted_buffers(spark, d):
    return variogram.recommended_buffers(variogram_ranges(spark, d))


def correlogram_profile(spark, d):
    """Every band of every way to prepare spectra against the target: r with its p, and rho."""
    s = src.spectra(spark, d).select("spectrum", F.col("target").alias("y"))
    ways = {"raw": F.col("spectrum"), "snv": spectra.snv(F.col("spectrum")), "smooth": spectra.savitzky_golay(F.col("spectrum")), "derivative": spectra.savitzky_golay(F.col("spectrum"), degree=2, order=1)}
    long = s.select("y", F.explode(F.create_map(*[x for k, c in ways.items() for x in (F.lit(k), c)])).alias("variant", "s")).select("y", "variant", F.posexplode("s").alias("band", "x"))
    r, rho = stats.pearson(long, ["variant", "band"]).drop("r2"), stats.spearman(long, ["variant", "band"]).drop("n")
    return r.withColumn("p", distributions.correlation_p(F.col("r"), F.col("n"))).join(rho, ["variant", "band"])


def _folded(spark, d):
    return src.band_points(spark, d).select("point_id", "date", *FEATURES, "size", validation.fold_of("point_id").alias("fold"))


def ridge_curve(spark, d):
    """Errors of ridge by penalty, two bands against the size, folds by point."""
    parts = parted_moments(_folded(spark, d), F.array("b", "g", "size"), F.col("fold"))
    return spark.createDataFrame([(float(p[0]), rmse, r2) for p, rmse, r2 in tuning.curve(parts, "ridge")], "penalty double, rmse double, r2 double")


def tuned_models(spark, d):
    """Errors of every candidate of every model on the four bands, and which one is best of its model."""
    parts = parted_moments(_folded(spark, d), F.array(*FEATURES, "size"), F.col("fold"))
    rows = []
    for model in tuning.MODELS:
        best = tuning.tuned(parts, model)[0]
        rows += [(model, str(list(p)), rmse, r2, p == best) for p, rmse, r2 in tuning.curve(parts, model)]
    return spark.createDataFrame(rows, "model string, parameters string, rmse double, r2 double, best boolean")


def stacked_models(spark, d):
    """Two tuned ridges and the ridge that weighs them, each row told by the other folds."""
    out, _ = tuning.stacked(_folded(spark, d), FEATURES, "size", "fold", {"visible": (["b", "g"], "ridge"), "infrared": (["r", "e"], "ridge")})
    return out.select("point_id", "date", "fold", F.col("size").alias("y"), "visible", "infrared", "predicted")


def _sites(spark, d):
    return src.sites(spark, d).select("site", "u", (F.col("v") / 1000).alias("v"))


def mixed_sites(spark, d):
    return validation.mixup(_sites(spark, d), "site", ["u", "v"])


def mixup_leakage(spark, d):
    """What mixing rows before they are dealt to folds promises over folds of the rows themselves; suspect above 0.05."""
    plain = _sites(spark, d)
    both = plain.select("site", "u", "v").unionByName(mixed_sites(spark, d).select((F.col("i") + 1_000_000_000).alias("site"), "u", "v"))
    scored = lambda df, name: stats.regression_metrics(validation.kfold_line(df, "site", "u", "v"), [], "y", "predicted", quartiles=False).select(F.col("r2").alias(name))
    out = scored(both, "r2_mixup_before_split").join(scored(plain, "r2_no_augmentation"))
    gap = F.col("r2_mixup_before_split") - F.col("r2_no_augmentation")
    return out.select("*", gap.alias("inflation"), (gap > 0.05).alias("leakage_suspected"))


def holdout_choice(spark, d):
    """Two targets of the sites, judged on the block farthest from the centre by models that the other blocks choose."""
    s = src.sites(spark, d)
    s = s.select("site", "x", "y", (F.col("x") / 100).alias("e"), (F.col("y") / 100).alias("n"), "v", "u", F.pmod(F.floor(F.col("x") / 60) + F.floor(F.col("y") / 60), F.lit(4)).cast("int").alias("part"), validation.fold_of("site").alias("inner"))
    rows = holdout.holdout_models(s, ["e", "n"], ["v", "u"], "part", "inner", {"ridge": None, "elastic_net": None, "pls": [(1,), (2,)]})
    return spark.createDataFrame(rows, "target string, model string, parameters string, n_train long, n_test long, inner_rmse double, test_rmse double, test_r2 double, chosen boolean")


def queries() -> dict:
    return {f.__name__: f for f in (holdout_choice, mixed_sites, mixup_leakage, variogram_lags, variogram_ranges, fitted_buffers, correlogram_profile, ridge_curve, tuned_models, stacked_models)}


def _ridge(name: str, rows: str, a: str, b: str) -> str:
    """CTEs ``name``_e (penalty, rmse, r2) and ``name`` (id, fold, y, p): ridge on two columns outside each fold of ``rows`` (id, fold, y, a, b)."""
    grid = ", ".join(f"({p!r}::double)" for p in tuning.RIDGE)
    return f"""{name}_m as (select k, count(*)::double n, avg({a}) ma, avg({b}) mb, avg(y) my, case when stddev_pop({a}) > 1e-12 then stddev_pop({a}) else 1 end sa, case when stddev_pop({b}) > 1e-12 then stddev_pop({b}) else 1 end sb,
 var_pop({a}) va, var_pop({b}) vb, covar_pop({a}, {b}) ab, covar_pop({a}, y) ay, covar_pop({b}, y) yb from {rows}, (select distinct fold k from {rows}) where fold <> k group by 1),
{name}_g as (select *, n * va / (sa * sa) + penalty g1, n * vb / (sb * sb) + penalty g2, n * ab / (sa * sb) g12, n * ay / sa x1, n * yb / sb x2 from {name}_m, (values {grid}) t(penalty)),
{name}_l as (select penalty, k, (x1 * g2 - x2 * g12) / (g1 * g2 - g12 * g12) / sa c1, (x2 * g1 - x1 * g12) / (g1 * g2 - g12 * g12) / sb c2, ma, mb, my from {name}_g),
{name}_a as (select id, fold, y, penalty, my + c1 * ({a} - ma) + c2 * ({b} - mb) p from {rows} join {name}_l on k = fold),
{name}_e as (select penalty, sqrt(avg((y - p) * (y - p))) rmse, 1 - avg((y - p) * (y - p)) / var_pop(y) r2 from {name}_a group by 1),
{name} as (select id, fold, y, p from {name}_a where penalty = (select penalty from {name}_e order by round(rmse, 12), penalty limit 1))"""


def oracle_sql() -> dict[str, str]:
    surveys = "sv as (select site, case when site % 2 = 0 then 'date1' else 'date2' end date, x, y, unnest(['v', 'u']) element, unnest([v, u]) v from sites)"
    own = oracle.oracle_sql()
    ways = {"raw": "select point_id, band, v from raw", "snv": "select point_id, band, (v - m) / case when sd = 0 then 1 else sd end from raw join st using (point_id)"}
    parts = [f"select '{k}' variant, w.* from ({q}) w" for k, q in ways.items()] + [f"select '{k}' variant, point_id, band, value from ({own[q]}) w" for k, q in (("smooth", "sg_smooth_rows"), ("derivative", "sg_derivative_rows"))]
    rank = lambda c: f"rank() over (partition by variant, band order by {c}) + (count(*) over (partition by variant, band, {c}) - 1) / 2.0::double"
    fold = f"({oracle._hash('point_id::varchar || ' + chr(39) + '.42' + chr(39))} % 5)::int"
    rows = f"rw as (select point_id::varchar || date id, {fold} fold, size y, b, g, r, e from pts)"
    half = lambda text: f"(({oracle._hash(text)} + 0.5::double) / 4294967296)"
    powers = ", ".join("{'a': power(" + half(f"i::varchar || '.42.u{k}'") + ", 1 / 0.3::double), 'b': power(" + half(f"i::varchar || '.42.v{k}'") + ", 1 / 0.3::double)}" for k in range(16))
    mixed = f"""{oracle.SITES}, nu as (select row_number() over (order by site) i, site, u, v / 1000 v from sites), dw as (select i, {oracle._hash("i::varchar || '.42.a'")} % (select count(*) from nu) + 1 ia, {oracle._hash("i::varchar || '.42.b'")} % (select count(*) from nu) + 1 ib,
 list_filter([{powers}], lambda p: p.a + p.b <= 1 and p.a + p.b > 0)[1] f from nu), sh as (select i, ia, ib, coalesce(f.a / (f.a + f.b), 0.5) as share from dw), mx as (select sh.i, x.site a, y.site b, sh.share, sh.share * x.u + (1 - sh.share) * y.u u, sh.share * x.v + (1 - sh.share) * y.v v from sh join nu x on x.i = ia join nu y on y.i = ib)"""
    own_fold = f"({oracle._hash('site::varchar || ' + chr(39) + '.42' + chr(39))} % 5)::int"
    line = lambda rel: f"(select 1 - sum((v-p)*(v-p)) / (var_pop(v) * count(*)) from (select f.v, a * f.u + b p from {rel} f join (select k.fold, coalesce(regr_slope(v, u), 0) a, avg(v) - coalesce(regr_slope(v, u), 0) * avg(u) b from (select distinct fold from {rel}) k join {rel} g on g.fold <> k.fold group by 1) l using (fold)))"
    return {
        "mixed_sites": f"with {mixed} select * from mx",
        "mixup_leakage": f"with {mixed}, pl as (select {own_fold} fold, u, v / 1000 v from sites), bo as (select * from pl union all select {own_fold.replace('site::varchar', '(i + 1000000000)::varchar')}, u, v from mx), r as (select {line('bo')} r2_mixup_before_split, {line('pl')} r2_no_augmentation) select *, r2_mixup_before_split - r2_no_augmentation inflation, r2_mixup_before_split - r2_no_augmentation > 0.05 leakage_suspected from r",
        "variogram_lags": f"""with {oracle.SITES}, {surveys}, q as (select element, date, quantile_cont(v, 0.25) a, quantile_cont(v, 0.75) b from sv group by 1, 2), f as (select sv.* from sv join q using (element, date) where b - a <= 0 or v between a - 3 * (b - a) and b + 3 * (b - a) qualify count(*) over (partition by element, date) >= 10),
 p as (select l.element, l.date, sqrt((l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)) d, (l.v-r.v)*(l.v-r.v) s from f l join f r using (element, date) where l.site < r.site), m as (select element, date, median(d) far from p where d > 0 group by 1, 2),
 b as (select element, date, far, greatest(1, ceil(round(d / (far / 12), 9)))::int lag, s from p join m using (element, date) where d > 0 and d <= far) select element, date, lag, (lag - 0.5::double) * far / 12 distance, avg(s) / 2 gamma, count(*) n_pairs from b group by element, date, lag, far having count(*) >= 2""",
        "correlogram_profile": f"""with {oracle.SNV}, al as ({' union all '.join(parts)}), j as (select variant, a.band::int band, a.v x, target y from al a join spec using (point_id)), k as (select variant, band, x, y, {rank('x')} rx, {rank('y')} ry from j),
 g as (select variant, band, count(*) n, {oracle._corr('x', 'y')} r, {oracle._corr('rx', 'ry')} rho from k group by 1, 2 having count(*) >= 10) select variant, band, n, r, {inference._t_p('r', 'n')} p, rho from g""",
        "ridge_curve": f"with {oracle.POINTS}, {rows}, {_ridge('ra', 'rw', 'b', 'g')} select penalty, rmse, r2 from ra_e",
        "stacked_models": f"""with {oracle.POINTS}, {rows}, {_ridge('ra', 'rw', 'b', 'g')}, {_ridge('rb', 'rw', 'r', 'e')}, up as (select ra.id, ra.fold, ra.y, ra.p visible, rb.p infrared from ra join rb using (id)), {_ridge('rc', 'up', 'visible', 'infrared')}
 select substr(up.id, 1, length(up.id) - 1)::bigint point_id, right(up.id, 1) date, up.fold, up.y, visible, infrared, rc.p predicted from up join rc using (id)""",
    }
