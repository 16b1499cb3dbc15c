"""DuckDB SQL that says what each query must return."""

from __future__ import annotations

import re

import numpy as np

from . import formulas

#: Wavelengths of the 64 values of a spectrum.
W = [390.0 + 10 * i for i in range(64)]

BANDS = ("b0", "b1", "b2", "b3", "b4")


OBS = "obs as (select l_orderkey set_id, l_linenumber channel, l_partkey point_id, cast(round(l_discount * 100) as bigint) as value from lineitem)"
POINTS = """pts as (select l_partkey point_id, l_returnflag date, sum(cast(round(l_discount*100) as bigint)) / (count(*)*100.0::double) b,
 sum(cast(round(l_tax*100) as bigint)) / (count(*)*100.0::double) g, sum(cast(round(l_quantity*100) as bigint)) / (count(*)*100.0::double) / 50.0::double r,
 sum(cast(round(l_extendedprice*100) as bigint)) / (count(*)*100.0::double) / 100000.0::double e, max(p_retailprice) / 1000.0::double n,
 max(p_size)::double as size, max(p_retailprice) as price, count(*) n_obs
 from lineitem join part on l_partkey = p_partkey group by 1, 2)"""
SPEC = "spec as (select vec_id point_id, list_transform(embedding, lambda x: x::double) s, label::double target from embeddings)"
LONG = SPEC + ", raw as (select point_id, target, unnest(s) v, generate_subscripts(s, 1) - 1 band from spec)"
SNV = LONG + ", st as (select point_id, avg(v) m, stddev_pop(v) sd from raw group by 1)"
SITES = "sites as (select s_suppkey site, (s_suppkey % 10 * 20)::double x, (s_suppkey // 10 * 20)::double y, s_acctbal v, s_nationkey::double u from supplier)"
PAIRS = SITES + ", pr as (select a.site s1, b.site s2, a.v v1, b.v v2, a.u u1, b.u u2, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) d from sites a join sites b on a.site <> b.site)"
PIXELS = """sums as (select l_orderkey k, sum(cast(round(l_quantity*100) as bigint)) q, sum(cast(round(l_discount*100) as bigint)) d, sum(cast(round(l_tax*100) as bigint)) t, sum(cast(round(l_extendedprice*100) as bigint)) p from lineitem group by 1),
px as (select (o_orderkey // 128)::int as row, (o_orderkey % 128)::int as col, coalesce(d / 100.0::double, 0) b0, coalesce(t / 100.0::double, 0) b1, coalesce(q / 10000.0::double, 0) b2, coalesce(p / 1e8, 0) b3,
 case when q is not null then cast(round(o_totalprice*100) as bigint) / 1e8 else 0 end b4 from orders left join sums on o_orderkey = k)"""
PXLONG = PIXELS + ", pl as (" + " union all ".join(f"select row, col, '{b}' band, {b} as value from px" for b in BANDS) + ")"
BSTAT = PXLONG + ", bs as (select band, count(*) n, quantile_cont(value, 0.02) p2, quantile_cont(value, 0.98) p98 from pl where value > 0 group by 1)"
NORM = BSTAT + ", nm as (select row, col, band, case when value > 0 then least(1, greatest(0, (value - p2) / (p98 - p2 + 1e-8))) else 0 end as value from pl join bs using (band))"

FEATURES = (
    POINTS + ", ft as (" + " union all ".join(f"select point_id, date, '{i}' feature, {f} x from pts" for i, f in formulas.EXACT[1].items())
    + "), tg as (select point_id, date, 'size' element, size y from pts union all select point_id, date, 'price', price from pts), fp as (select date, feature, element, x, y from ft join tg using (point_id, date) where x is not null and y is not null)"
)
R = "case when stddev_pop(x) > 0 and stddev_pop(y) > 0 then covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) end"
PEARSON = FEATURES + f", pe as (select date, feature, element, count(*) n, {R} r from fp group by 1, 2, 3 having count(*) >= 10)"


def _tier(tier: int) -> str:
    cols = ", ".join(f"{f} {k}" for k, f in formulas.EXACT[tier].items())
    return f"with {POINTS} select point_id, date, {cols} from pts"


def _clip(sql: str, limit: int) -> str:
    return f"greatest(-{limit}, least({limit}, coalesce({sql}, 0)))"


def _narrow() -> str:
    # the value at the band nearest to a wavelength, the first on a tie
    band = lambda m: f"s[{min(range(64), key=lambda i: (abs(W[i] - int(m[1])), i)) + 1}]"
    cols = ", ".join(f"{re.sub(r'w([0-9]+)', band, f)} {k}" for k, f in formulas.NARROW.items())
    at = [i for i, w in enumerate(W) if 680 <= w <= 760]
    steps = ", ".join(f"s[{b + 1}] - s[{a + 1}]" for a, b in zip(at, at[1:], strict=False))
    mids = ", ".join(str((W[a] + W[b]) / 2) for a, b in zip(at, at[1:], strict=False))
    return f"with {SPEC} select point_id, {cols}, ([{mids}])[list_position([{steps}], list_max([{steps}]))]::double rep from spec"


def _fitted(order: int) -> np.ndarray:
    """Weights by which 11 values give the 2nd-degree polynomial's value or slope at each of the places."""
    x, out = np.arange(11) - 5.0, np.zeros((11, 11))
    for j in range(11):
        line = np.poly1d(np.polyfit(x, np.eye(11)[j], 2))
        out[:, j] = (line.deriv(order) if order else line)(x)
    return out


def _smooth(order: int, tail: str = "") -> str:
    m = _fitted(order)
    rows = ", ".join(f"({k}, {j}, {m[k, j]!r}::double)".replace("np.float64(", "").replace(")::", "::") for k in range(11) for j in range(11))
    return f"{LONG}, wt(k, j, w) as (values {rows}), aw as (select point_id, band, target, greatest(0, least(band - 5, 53)) st from raw), sm as (select a.point_id, a.band, sum(r.v * wt.w) v from aw a join raw r on r.point_id = a.point_id and r.band between a.st and a.st + 10 join wt on wt.k = a.band - a.st and wt.j = r.band - a.st group by 1, 2)"


def _shape() -> str:
    def span(low, high):
        at = [i for i, w in enumerate(W) if low <= w <= high]
        return f"s[{at[0] + 1}:{at[-1] + 1}]"

    def area(x):
        return f"(10.0 * (list_sum({x}) - ({x}[1] + {x}[len({x})]) / 2))"

    at = [i for i, w in enumerate(W) if 680 <= w <= 760]
    slopes = "[" + ", ".join(f"(s[{min(i + 1, at[-1]) + 1}] - s[{max(i - 1, at[0]) + 1}]) / {10.0 * (min(i + 1, at[-1]) - max(i - 1, at[0]))}" for i in at) + "]"
    places = "[" + ", ".join(str(W[i]) for i in at) + "]"
    nir, water = span(780, 900), span(950, 990)
    n = sum(780 <= w <= 900 for w in W)
    slope = " + ".join(f"({i - (n - 1) / 2}) * {nir}[{i + 1}]" for i in range(n))
    below = sum((i - (n - 1) / 2) ** 2 for i in range(n)) * 10
    return f"""with {SPEC} select point_id, ({places})[list_position({slopes}, list_max({slopes}))]::double red_edge_position, list_max({slopes}) red_edge_slope,
 ({area(span(680, 760))}) red_edge_area, list_max({span(500, 600)}) green_peak, list_avg({nir}) nir_mean, list_stddev_pop({nir}) nir_std,
 (({slope}) / {below}) nir_slope, (({water}[1] + {water}[len({water})]) / 2 - list_min({water})) water_depth, ({area(nir)} / nullif({area(span(400, 700))}, 0)) nir_vis_ratio from spec"""


METRICS = """count(*) n, (1 - sum((y-p)*(y-p)) / nullif(var_pop(y) * count(*), 0)) r2, (sqrt(avg((y-p)*(y-p)))) rmse, avg(abs(y-p)) mae"""
RADII = "rad(radius) as (values (0.0::double), (20.0), (30.0), (50.0), (75.0), (100.0))"
OUTSIDE = f"{PAIRS}, {RADII}, ou as (select s1 site, radius, max(v1) v, max(u1) u, count(*)::double n, avg(v2) m, count(*) * sum(u2 * v2) - sum(u2) * sum(v2) top, count(*) * sum(u2 * u2) - sum(u2) * sum(u2) below, sum(u2) su, sum(v2) sv from pr, rad where not (d < radius) group by 1, 2)"
LINE = OUTSIDE + ", ln as (select site, radius, v, n, (sv - coalesce(top / nullif(below, 0), 0) * su) / n + coalesce(top / nullif(below, 0), 0) * u predicted from ou)"
PRED = "pd as (select l_returnflag, l_extendedprice / 1000.0::double y, l_quantity * 1.5::double p from lineitem)"


def _window(h: int) -> str:
    return f"""with {PIXELS} select a.row, a.col, count(*) n, avg(b.b2) mean, stddev_pop(b.b2) std, median(b.b2) median, quantile_cont(b.b2, 0.25) p25, quantile_cont(b.b2, 0.75) p75,
 (stddev_pop(b.b2) / nullif(avg(b.b2), 0)) cv from px a join (select unnest(range(-{h}, {h} + 1)) dr) r on true join (select unnest(range(-{h}, {h} + 1)) dc) c on true join px b on b.row = a.row + dr and b.col = a.col + dc where b.b2 > 0 group by 1, 2"""


def _hann(place: str) -> str:
    return f"(0.5 - 0.5 * cos(2 * 3.141592653589793 * ({place} + 1) / 33))"


def _corr(x: str, y: str) -> str:
    return f"(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0))"


def _hash(parts: str) -> str:
    return f"('0x' || substr(md5({parts}), 1, 8))::bigint"


FOLD = "(" + _hash("point_id::varchar || '.42'") + " % 5)::int"


def oracle_sql() -> dict[str, str]:
    norm_bands = "select row, col, band, value as value from nm"
    out = {
        "band_pivot": f"with {OBS} select point_id, " + ", ".join(f"(sum(value) filter (channel = {i}) / count(*) filter (channel = {i}) / 100.0::double) ch{i}" for i in range(1, 6)) + " from obs where channel <= 5 group by 1",
        "hyper_aggregate_min_bands": f"with {OBS}, per as (select point_id, channel, (sum(value) / count(*) / 100.0::double) as value, count(*) n_sets from obs where value <> 0 group by 1, 2) select per.*, n_bands from per join (select point_id, count(*) n_bands from per group by 1 having count(*) >= 6) using (point_id)",
        "sets_per_point": f"with {OBS}, per as (select point_id, channel, count(*) n from obs group by 1, 2) select point_id, avg(n) mean_sets, min(n) least, median(n)::double median, max(n) most from per group by 1",
        "ms_indices_tier1": _tier(1),
        "ms_indices_tier2": _tier(2),
        "ms_indices_tier3": _tier(3),
        "ms_indices_eps_family": f"with {POINTS} select point_id, date, " + ", ".join(f"{_clip(f, 10)} {k}" for k, f in formulas.PADDED.items()) + " from pts",
        "ms_indices_channels": f"with {POINTS} select point_id, date, " + ", ".join(f"{_clip(f, 5)} {k}" for k, f in formulas.CHANNELS.items()) + " from pts",
        "index_catalogue": f"with {POINTS}, c as (select * from pts) " + " union all ".join(f"select '{k}' name, {tier} tier, count(case when isfinite({f}) then 1 end) n_valid from c" for tier, fs in formulas.EXACT.items() for k, f in fs.items()),
        "hyper_indices_all": _narrow(),
        "snv_rows": f"with {SNV} select point_id, band::int band, ((v - m) / case when sd = 0 then 1 else sd end) as value from raw join st using (point_id)",
        "snv_eps_rows": f"with {SNV} select point_id, band::int band, ((v - m) / (sd + 1e-10)) as value from raw join st using (point_id)",
        "sg_smooth_rows": f"with {_smooth(0)} select point_id, band::int band, v as value from sm",
        "sg_derivative_rows": f"with {_smooth(1)} select point_id, band::int band, v as value from sm",
        "finite_diff_deriv": f"with {LONG}, df as (select point_id, band, (lead(v) over (partition by point_id order by band) - v) / (10 + 1e-10) dv from raw) select point_id, band::int band, coalesce(dv, lag(dv) over (partition by point_id order by band)) as value from df",
        "band_subsample": f"with {LONG} select point_id, (band // 5)::int band, v as value from raw where band % 5 = 0",
        "noisy_band_removal": f"with {LONG} select point_id, (row_number() over (partition by point_id order by band) - 1)::int band, v as value from raw where 390 + 10 * band not between 925 and 975",
        "preprocess_pipeline": f"with {_smooth(0)}, st as (select point_id, avg(v) m, stddev_pop(v) sd from sm group by 1) select point_id, (row_number() over (partition by point_id order by band) - 1)::int band, ((v - m) / case when sd = 0 then 1 else sd end) as value from sm join st using (point_id) where 390 + 10 * band not between 925 and 975",
        "red_edge_features": _shape(),
        "pearson_matrix": f"with {PEARSON} select date, feature, element, n, r r, (r * r) r2 from pe",
        "spearman_matrix": f"with {FEATURES}, rk as (select date, feature, element, rank() over (partition by date, feature, element order by x) + (count(*) over (partition by date, feature, element, x) - 1) / 2.0::double x, rank() over (partition by date, feature, element order by y) + (count(*) over (partition by date, feature, element, y) - 1) / 2.0::double y from fp) select date, feature, element, count(*) n, {R} rho from rk group by 1, 2, 3 having count(*) >= 10",
        "kendall_tau": f"with {SITES} select count(*) n_pairs, (sum(sign(b.v-a.v)*sign(b.u-a.u)) / sqrt(sum(abs(sign(b.v-a.v))) * sum(abs(sign(b.u-a.u))))) tau from sites a join sites b on a.site < b.site",
        "distance_correlation": f"with {SITES}, di as (select a.site i, b.site j, abs(a.v-b.v) dx, abs(a.u-b.u) dy from sites a, sites b), ce as (select i, dx - avg(dx) over (partition by i) - avg(dx) over (partition by j) + avg(dx) over () ax, dy - avg(dy) over (partition by i) - avg(dy) over (partition by j) + avg(dy) over () ay from di) select count(distinct i) n, (sqrt(greatest(0, avg(ax*ay) / sqrt(avg(ax*ax) * avg(ay*ay))))) dcor from ce",
        "correlogram": f"with {SNV}, al as (select 'raw' variant, band, v x, target y from raw union all select 'snv', band, (v - m) / case when sd = 0 then 1 else sd end, target from raw join st using (point_id)), g as (select variant, band, count(*) n, {R} r from al group by 1, 2 having count(*) >= 10) select variant, band::int band, n, r r, (r * r) r2 from g",
        "top3_per_element": f"with {PEARSON}, q as (select date, feature, element, n, round(r, 6) r from pe) select *, row_number() over (partition by date, element order by abs(r) desc, feature)::int place from q qualify place <= 3",
        "best_index_per_element": f"with {PEARSON}, q as (select date, feature, element, round(r, 6) r from pe) select date, element, feature, r from q qualify row_number() over (partition by date, element order by abs(r) desc, feature desc) = 1",
        "corr_heatmap_pivot": f"with {PEARSON}, q as (select feature, date, (max(r) filter (element = 'price')) price, (max(r) filter (element = 'size')) as size from pe group by 1, 2) select *, greatest(abs(price), abs(size)) strongest from q",
        "significance_labels": "select l_discount p, count(*) n, case when l_discount < 0.05/50 then '***' when l_discount < 0.05/5 then '**' when l_discount < 0.05 then '*' else '' end as label, case when l_discount < 0.001 then '***' when l_discount < 0.01 then '**' when l_discount < 0.05 then '*' else 'ns' end stars from lineitem group by l_discount",
        "iqr_outlier_filter": "with q as (select l_returnflag, quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.75) q3 from lineitem group by 1) select l_returnflag, count(*) n, min(l_extendedprice) least, max(l_extendedprice) most from lineitem join q using (l_returnflag) where q3 - q1 <= 0 or l_extendedprice between q1 - 0.5*(q3-q1) and q3 + 0.5*(q3-q1) group by 1",
        "zscore_features": f"with {POINTS} select point_id, date, (case when stddev_pop(r) over (partition by date) > 0 then (r - avg(r) over (partition by date)) / stddev_pop(r) over (partition by date) else 0 end) z from pts",
        "constant_feature_filter": f"with {POINTS}, l as (" + " union all ".join(f"select '{c}' feature, {c} as value from pts" for c in "bgren") + " union all select 'fixed', 1.0 from pts) select feature, count(*) n, stddev_pop(value) std from l group by 1 having stddev_pop(value) > 1e-8",
        "median_impute": f"with {POINTS}, q as (select point_id, date, case when n_obs > 3 then r end as value from pts) select point_id, date, coalesce(value, median(value) over (partition by date), 0) as value from q",
        "semivariogram": f"with {PAIRS}, f as (select median(d) far from pr where d > 0), b as (select ceil(round(d / (far / 12), 9))::int lag, d, (v1-v2)*(v1-v2) sq from pr, f where s1 < s2 and d > 0 and d <= far) select lag, avg(d) distance, avg(sq) / 2 gamma, count(*) n_pairs from b group by 1 having count(*) >= 2",
        "variogram_models_eval": f"with h as (select lag, distance h from (with {PAIRS}, f as (select median(d) far from pr where d > 0), b as (select ceil(round(d / (far / 12), 9))::int lag, d, (v1-v2)*(v1-v2) sq from pr, f where s1 < s2 and d > 0 and d <= far) select lag, avg(d) distance, avg(sq) / 2 gamma, count(*) n_pairs from b group by 1 having count(*) >= 2)) select lag, h, (case when h < 120 then 0.1 + 0.9 * (1.5*h/120 - 0.5*(h/120)*(h/120)*(h/120)) else 1.0 end) spherical, (0.1 + 0.9 * (1 - exp(-3*h/120))) exponential, (0.1 + 0.9 * (1 - exp(-3*(h/120)*(h/120)))) gaussian from h",
        "morans_i": f"""with {PAIRS}, nn as (select s1 i, s2 j from pr qualify row_number() over (partition by s1 order by d, s2) <= 4), ed as (select i, j from nn union select j, i from nn), ce as (select site, v - avg(v) over () z from sites),
 t as (select sum(a.z*b.z) top, count(*)::double s0 from ed join ce a on a.site = i join ce b on b.site = j), w as (select sum(4.0 * k * k) s2 from (select i, count(*)::double k from ed group by 1)), n as (select count(*)::double n, sum(z*z) below from ce),
 r as (select n, s0, n * top / (s0 * below) moran, -1/(n-1) expected, (n*n*2*s0 - n*s2 + 3*s0*s0) / ((n*n-1)*s0*s0) - 1/((n-1)*(n-1)) va from t, w, n) select n::bigint n, s0, moran moran, expected expected, (case when va > 0 then (moran - expected) / sqrt(va) end) z from r""",
        "knn_edges": f"with {PAIRS} select s1 i, s2 j, d d, row_number() over (partition by s1 order by d, s2)::int place from pr qualify place <= 4",
        "buffered_train_counts": f"with {PAIRS}, {RADII} select s.site, radius, count(d)::bigint n from sites s cross join rad left join pr on pr.s1 = s.site and not (d < radius) group by 1, 2",
        "buffered_loo_mean": f"with {OUTSIDE} select site, radius, v v, n::bigint n, m predicted from ou where radius = 50 union all select site, 50.0, v, 0, null from sites where site not in (select site from ou where radius = 50)",
        "buffered_loo_simple_regression": f"with {LINE} select site, radius, v v, n::bigint n, predicted predicted from ln where radius = 50 union all select site, 50.0, v, 0, null from sites where site not in (select site from ou where radius = 50)",
        "buffer_sweep": f"with {OUTSIDE}, e as (select radius, v y, m p from ou) select radius, {METRICS} from e group by 1",
        "random_vs_buffered_inflation": f"with {LINE}, e as (select radius, v y, predicted p from ln), q as (select radius, 1 - sum((y-p)*(y-p)) / nullif(var_pop(y) * count(*), 0) r2 from e group by 1), w as (select max(r2) filter (radius = 0) a, max(r2) filter (radius = 50) b from q) select a r2_random, b r2_buffered, (a - b) inflation from w",
        "buffer_recommendation": f"with {PAIRS} select u1::int element, median(d) middle, least(100, greatest(20, trunc(median(d))))::int buffer from pr where s1 < s2 and d > 0 group by 1",
        "regression_metrics": f"with {PRED} select l_returnflag, {METRICS}, (stddev_pop(y) / sqrt(avg((y-p)*(y-p)))) rpd, ((quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / sqrt(avg((y-p)*(y-p)))) rpiq from pd group by 1",
        "baseline_mean_r2": f"with {PRED} select l_returnflag, count(*) n, 0.0::double r2, stddev_pop(y) rmse from pd group by 1",
        "masked_huber_loss": f"with {PRED} select l_returnflag, (avg(case when abs(y-p) <= 5 then 0.5*(y-p)*(y-p) else 5*(abs(y-p)-2.5) end) filter (y > 20)) loss, count(*) filter (y > 20) n from pd group by 1",
        "mixup_partner_weights": f"with {PAIRS}, b as (select median(abs(v1-v2)) / 2 bw from pr), w as (select s1 i, s2 j, exp(-abs(v1-v2)*abs(v1-v2) / (2*bw*bw)) w from pr, b) select i, j, (w / sum(w) over (partition by i)) weight from w",
        "band_stats_p2_p98": f"with {BSTAT} select band, n, p2 p2, p98 p98 from bs",
        "normalised_pixels": f"with {NORM} {norm_bands}",
        "rgb_stretch": f"with {NORM} select row, col, " + ", ".join(f"(max(value) filter (band = '{b}') * 255) {c}" for b, c in (("b2", "red"), ("b1", "green"), ("b0", "blue"))) + " from nm group by 1, 2",
        "tile_grid_stats": f"with {PIXELS} select (row // 32)::int tile_r, (col // 32)::int tile_c, count(*) n, avg(b4) mean, min(b4) least, max(b4) most from px group by 1, 2",
        "window_stats_w3": _window(1),
        "window_stats_w7": _window(3),
        "glcm_features": f"""with {PIXELS}, lv as (select row, col, row // 32 tr, col // 32 tc, least(15, floor(b4 / 0.005 * 15))::int l from px), o(dr, dc) as (values (0, 1), (1, 1), (1, 0), (1, -1)),
 m as (select a.tr, a.tc, a.l i, b.l j from lv a cross join o join lv b on b.row = a.row + dr and b.col = a.col + dc and b.tr = a.tr and b.tc = a.tc), c as (select tr, tc, i, j, count(*)::double k from (select * from m union all select tr, tc, j, i from m) group by 1, 2, 3, 4)
 select tr::int tile_r, tc::int tile_c, (sum(k*(i-j)*(i-j)) / sum(k)) contrast, (sum(k*abs(i-j)) / sum(k)) dissimilarity, (sum(k/(1.0+(i-j)*(i-j))) / sum(k)) homogeneity, (sum(k*k)/(sum(k)*sum(k))) asm, (sqrt(sum(k*k)/(sum(k)*sum(k)))) energy from c group by 1, 2""",
        "tile_blend": f"""with {PIXELS}, t as (select row, col, b4, tr, tc from px, (select unnest(range(0, 2000)) tr) r, (select unnest(range(0, 6)) tc) c where row - tr * 24 between 0 and 31 and col - tc * 24 between 0 and 31),
 w as (select row, col, b4 + (tr + tc) / 100.0::double p, {_hann('row - tr * 24')} * {_hann('col - tc * 24')} w from t) select row, col, (sum(p*w)/sum(w)) as value, sum(w) weight from w group by 1, 2""",
        "map_stats": f"with {PXLONG} select band, count(*) n, min(value) least, avg(value) mean, max(value) most, stddev_pop(value) std, quantile_cont(value, 0.05) p5, quantile_cont(value, 0.95) p95 from pl where value <> 0 group by 1",
        "nodata_masking": f"with {PIXELS} select row, col, (case when not (b0 = 0 and b1 = 0 and b2 = 0 and b3 = 0 and b4 = 0) then 2 * b2 + b4 end) prediction from px",
        "point_pixels": f"with {PIXELS}, {SITES}, s as (select site, floor((1000 - y) / 15)::int as row, floor(x / 15)::int as col from sites) select s.row, s.col, site, " + ", ".join(f"{b} {b}" for b in BANDS) + " from s join px on px.row = s.row and px.col = s.col where s.row >= 0 and s.col >= 0",
        "date_lookup": "with k(k, sampling, priority) as (values ('1-URG', 'first', 0), ('HIGH', 'second', 1), ('LOW', 'third', 2), ('E', 'other', 3)) select o_orderpriority, arg_min(sampling, priority) sampling from (select distinct o_orderpriority from orders) left join k on contains(o_orderpriority, k) group by 1",
        "partial_correlation": f"with {POINTS}, lo as (select date, size z, price y, 'b' feature, b x from pts union all select date, size, price, 'g', g from pts union all select date, size, price, 'r', r from pts union all select date, size, price, 'e', e from pts), c as (select date, feature, count(*) n, {_corr('x', 'y')} r, {_corr('x', 'z')} xz, {_corr('y', 'z')} yz from lo group by 1, 2) select date, feature, n, r r, ((r - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))) partial from c",
        "linear_importance": f"with {FEATURES}, l as (select date, feature, element, regr_slope(y, x) slope, avg(x) m from fp group by 1, 2, 3) select date, feature, element, max(slope) slope, (avg(abs(slope * (x - m)))) importance from fp join l using (date, feature, element) group by 1, 2, 3",
        "target_scaler": f"with {POINTS}, s as (select date, count(e) filter (n_obs > 3) n, avg(e) filter (n_obs > 3) m, stddev_pop(e) filter (n_obs > 3) sd from pts group by 1) select date, n, coalesce(m, 0) mean, (case when sd > 0 then sd else 1 end) std from s",
        "mean_target_top20": f"with {LONG}, t as (select point_id, (max(target) + avg(v)) / 2 y from raw group by 1), g as (select band::int band, round({_corr('v', 'y')}, 6) r from raw join t using (point_id) group by 1) select band, r from g order by abs(r) desc, band limit 20",
        "inflation_summary": f"with {LINE}, e as (select radius, v y, predicted p from ln), q as (select radius, 1 - sum((y-p)*(y-p)) / nullif(var_pop(y) * count(*), 0) r2 from e group by 1), g as (select (b.r2 - q.r2) inflation from q, q b where q.radius > 0 and b.radius = 0) select median(inflation) middle, max(inflation) most, count(*) filter (inflation > 0.01) n_over from g",
        "kfold_line": f"with {POINTS}, f as (select {FOLD} fold, b x, e y from pts), l as (select k.fold, regr_slope(y, x) a, regr_intercept(y, x) b from (select distinct fold from f) k join f on f.fold <> k.fold group by 1), pd as (select f.fold, y, a * x + b p from f join l using (fold)) select fold, {METRICS} from pd group by 1",
        "kfold_line_dates": f"with {POINTS}, f as (select date, {FOLD} fold, b x, e y from pts), l as (select k.date, k.fold, regr_slope(y, x) a, regr_intercept(y, x) b from (select distinct date, fold from f) k join f on f.date = k.date and f.fold <> k.fold group by 1, 2), pd as (select f.date, f.fold, y, a * x + b p from f join l using (date, fold)) select date, fold, {METRICS} from pd group by 1, 2",
        "group_folds": f"with {POINTS} select {FOLD} fold, count(*) n, count(distinct point_id) points from pts group by 1",
        "permutation_test": f"with {SITES}, c as (select site, u x, v y, unnest(range(1, 200)) p from sites), o as (select p, x, y, row_number() over (partition by p order by site) i, row_number() over (partition by p order by " + _hash("site::varchar || '.' || p::varchar") + f", site) j from c), w as (select a.p, round(power({_corr('a.x', 'b.y')}, 2), 9) drawn from o a join o b on a.p = b.p and a.i = b.j group by 1), ob as (select count(*) n, round(power({_corr('u', 'v')}, 2), 9) r2 from sites) select n, r2, count(*) n_permutations, avg((drawn >= r2)::int) p from w, ob group by n, r2",
        "overlapping_tiles": f"with {PIXELS}, x as (select greatest(max(row) + 1 - 64, 0) h, greatest(max(col) + 1 - 64, 0) w from px), a as (select distinct least(s, h)::int as row from x, (select unnest(range(0, 1000000, 48)) s) where s < h + 48), b as (select distinct least(s, w)::int as col from x, (select unnest(range(0, 10000, 48)) s) where s < w + 48) select row, col from a, b",
        "pass_statistics": f"with {PIXELS}, ps as (select row, col, b4 * (1 + 0.1::double * k) as value from px, (select unnest(range(0, 3)) k) where b4 <> 0) select row, col, count(*) n_passes, avg(value) mean, stddev_pop(value) std from ps group by 1, 2",
    }
    return out
