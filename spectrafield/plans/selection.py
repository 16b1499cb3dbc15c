"""Queries on features: selection, sparse dependence, wavelets, textures by waves, the table of all spectral variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices, spectra
from ..operators import raster, selection, validation
from ..sources import tables as src
from . import formulas, oracle

W = src.WAVELENGTHS


def _parts(spark, d, values):
    return selection.parted_moments(src.spectra(spark, d), values, validation.fold_of("point_id"))


def cars_bands(spark, d):
    """Bands that competitive selection keeps for the target."""
    chosen = selection.selected(_parts(spark, d, F.concat("spectrum", F.array("target"))), "cars")
    return spark.createDataFrame([(b,) for b in chosen], "band int")


def cars_spa_bands(spark, d):
    """At most ten of these, by projections, in the order of choice."""
    chosen = selection.selected(_parts(spark, d, F.concat("spectrum", F.array("target"))), "cars_spa", 10)
    return spark.createDataFrame(list(enumerate(chosen, 1)), "rank int, band int")


def sparse_links(spark, d):
    """Of bands, two indices and the target: what depends on each other given all others."""
    e, r = F.col("e"), F.col("r")
    named = {"b": F.col("b"), "g": F.col("g"), "r": r, "e": e, "normalised": F.try_divide(e - r, e + r), "ratio": F.try_divide(e, r), "size": F.col("size")}
    parts = selection.parted_moments(src.band_points(spark, d), F.array(*named.values()), validation.fold_of("point_id"))
    names = list(named)
    return spark.createDataFrame([(names[i], names[j], p) for i, j, p in selection.sparse_partial_correlations(parts)], "node_a string, node_b string, partial double")


def wavelet_rows(spark, d):
    return src.spectra(spark, d).select("point_id", F.inline(spectra.wavelet_features(F.col("spectrum"))))


def _level(spark, d):
    return src.raster(spark, d).select("row", "col", F.least(F.lit(63), F.floor(F.col("b4") / 0.005 * 63)).cast("int").alias("level"))


def wave_textures(spark, d):
    return raster.wave_energy(_level(spark, d), "level", 32)


def hyper_features(spark, d):
    """Every fifth band of four variants of each spectrum and the narrow-band indices of one, but for constant and mostly missing features."""
    smooth = src.spectra(spark, d).withColumn("smooth", spectra.savitzky_golay(F.col("spectrum")))
    slope = spectra.finite_difference(F.col("smooth"), W)
    made = {"raw": F.col("smooth"), "snv": spectra.snv(F.col("smooth"), 1e-10), "deriv1": slope, "deriv1_snv": spectra.snv(slope, 1e-10)}
    wide = smooth.select("point_id", *[v.alias(k) for k, v in made.items()])
    bands = F.array(*[F.struct(F.lit(f"{k}_{W[i]:.0f}nm").alias("feature"), F.col(k)[i].alias("value")) for k in made for i in range(0, len(W), 5)])
    named = indices.with_narrow_indices(wide.select("point_id", F.col("snv").alias("spectrum")), W)
    kinds = [*indices.NARROW, "rep"]
    long = wide.select("point_id", F.inline(bands)).unionByName(named.select("point_id", F.inline(F.array(*[F.struct(F.lit(f"index_{k}").alias("feature"), F.col(k).cast("double").alias("value")) for k in kinds]))))
    fine = F.when(~F.isnan("value"), F.col("value"))
    kept = long.groupBy("feature").agg(F.stddev_samp(fine).alias("s"), F.count(fine).alias("k"), F.count("*").alias("n")).where("s > 1e-10 and k > 0.5 * n")
    return long.join(F.broadcast(kept.select("feature")), "feature")  # one row a feature


def queries() -> dict:
    return {f.__name__: f for f in (cars_bands, cars_spa_bands, sparse_links, wavelet_rows, wave_textures, hyper_features)}


def oracle_sql() -> dict[str, str]:
    smooth = oracle._smooth(0)
    variants = f""", ra as (select point_id, band, v from sm), st0 as (select point_id, avg(v) m, stddev_pop(v) sd from ra group by 1), sn as (select point_id, band, (v - m) / (sd + 1e-10) v from ra join st0 using (point_id)),
 df0 as (select point_id, band, (lead(v) over (partition by point_id order by band) - v) / (10 + 1e-10) dv from ra), de as (select point_id, band, coalesce(dv, lag(dv) over (partition by point_id order by band)) v from df0),
 st1 as (select point_id, avg(v) m, stddev_pop(v) sd from de group by 1), ds as (select point_id, band, (v - m) / (sd + 1e-10) v from de join st1 using (point_id)), spec2 as (select point_id, list(v order by band) s from sn group by 1)"""
    narrow = oracle._narrow()
    narrow = narrow[narrow.index(" select point_id,") :].replace("from spec", "from spec2")
    kinds = [*formulas.NARROW, "rep"]
    listed = " union all ".join(f"select point_id, '{k}_' || (390 + 10 * band)::int || 'nm' feature, v as value from {t} where band % 5 = 0" for k, t in (("raw", "ra"), ("snv", "sn"), ("deriv1", "de"), ("deriv1_snv", "ds")))
    return {
        "wavelet_rows": f"""with {oracle.LONG}, hat as materialized (select k, sum(2 / sqrt(3) / power(pi(), 0.25) * (1 - x * x) * exp(-x * x / 2)) over (order by k) * 16.0::double / 1023 integral from (select k, -8 + 16.0::double * k / 1023 x from (select unnest(range(0, 1024)) k))),
 sc as (select unnest(range(2, 32, 2)) scale), ts as (select scale, unnest(range(0, 16 * scale + 1)) t from sc), rd as materialized (select scale, t, integral from ts join hat on hat.k = least(1023, floor(t / (scale * 16.0::double / 1023) + 1e-12)::int)),
 ke as materialized (select s.scale, 16 * s.scale + 1 - s.t t, sqrt(s.scale) * (coalesce(b.integral, 0) - coalesce(a.integral, 0)) w from (select scale, unnest(range(0, 16 * scale + 2)) t from sc) s left join rd b on b.scale = s.scale and b.t = s.t left join rd a on a.scale = s.scale and a.t = s.t - 1),
 we as materialized (select sc.scale, o, band, w from sc cross join (select unnest(range(0, 64)) o) cross join (select unnest(range(0, 64)) band) join ke on ke.scale = sc.scale and ke.t = o + 8 * sc.scale - band),
 co as (select point_id, scale, o, sum(v * w) c from raw join we using (band) group by 1, 2, 3)
 select point_id, scale::int scale, avg(abs(c)) abs_mean, max(c) most, min(c) least from co group by 1, 2""",
        "wave_textures": f"""with {oracle.PIXELS}, lv as (select row // 32 tr, col // 32 tc, row % 32 r, col % 32 c, least(63, floor(b4 / 0.005 * 63))::double l from px where b4 > 0), ti as (select distinct row // 32 tr, col // 32 tc from px),
 st as (select unnest([0.1, 0.25, 0.4])::double f, a from (select unnest(range(0, 4)) a)), re as (select f, a, pi() * a / 4 th, ceil(greatest(abs(6 * cos(pi() * a / 4)), abs(6 * sin(pi() * a / 4)), 1))::int h from st),
 of as (select f, a, dr, dc, exp(-(dr * dr + dc * dc) / 8.0::double) / (8 * pi()) e, 2 * pi() * f * (dc * cos(th) + dr * sin(th)) ph from re, (select unnest(range(-6, 7)) dr), (select unnest(range(-6, 7)) dc) where abs(dr) <= h and abs(dc) <= h),
 pl as (select unnest(range(0, 32)) p), mi as (select p, s, case when p + s < 0 then -1 - p - s when p + s > 31 then 63 - p - s else p + s end q from pl, (select unnest(range(-6, 7)) s)),
 en as (select tr, tc, f, a, m.p r, n.p c, sqrt(power(sum(l * e * cos(ph)), 2) + power(sum(l * e * sin(ph)), 2)) en from lv join mi m on m.q = lv.r join mi n on n.q = lv.c join of on dr = m.s and dc = n.s group by 1, 2, 3, 4, 5, 6),
 fu as (select tr, tc, f, a, coalesce(en, 0) en from ti cross join st cross join (select x.p r, y.p c from pl x, pl y) g left join en using (tr, tc, f, a, r, c))
 select tr::int tile_r, tc::int tile_c, f frequency, a::int as angle, avg(en) mean, stddev_pop(en) std from fu group by 1, 2, 3, 4""",
        "hyper_features": f"""with {smooth[5:] if smooth.startswith('with ') else smooth}{variants}, na as ({narrow.strip()}), lo as ({listed} union all select point_id, 'index_' || k, v from (select point_id, unnest([{", ".join(f"'{k}'" for k in kinds)}]) k, unnest([{", ".join(f"{k}::double" for k in kinds)}]) v from na)),
 ok as (select feature from lo group by 1 having stddev_samp(value) filter (isfinite(value)) > 1e-10 and count(value) filter (not isnan(value)) > 0.5 * count(*)) select feature, point_id, value from lo join ok using (feature)""",
    }
