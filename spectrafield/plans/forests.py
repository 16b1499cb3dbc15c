"""Forests over folds, buffers and pixels, and the SQL that grows the same trees level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest, spatial, stats, validation
from ..sources import tables as src
from . import oracle

BANDS = ["b", "g", "r", "e"]
PIXELS = ["b0", "b1", "b2", "b3", "b4"]
#: Sizes of the registered forests: their SQL is written out level by level. The operator's defaults are larger.
SIZE = {"trees": 5, "depth": 3, "least": 3, "bins": 16}
FOLDS, BUFFER = 3, 50.0


def _points(spark, d):
    day = F.when(F.col("date") == "A", 0).when(F.col("date") == "N", 1).otherwise(2)
    return src.band_points(spark, d).select("point_id", "date", (F.col("point_id") * 3 + day).alias("key"), *BANDS, "size", validation.fold_of("point_id", FOLDS).alias("fold"))


def forest_folds(spark, d):
    """Points' sizes by trees that have not seen any date of the point."""
    points = _points(spark, d)
    model = forest.fit(points.withColumn("out", F.array("fold")), "key", BANDS, "size", out="out", folds=FOLDS, most=2, **SIZE)
    return forest.predict(points, model, fold="fold").select("point_id", "date", "fold", F.col("size").alias("y"), "predicted", "spread")


def forest_scores(spark, d):
    return stats.regression_metrics(forest_folds(spark, d), ["fold"], "y", "predicted", quartiles=False).select("fold", "n", "r2", "rmse", "mae")


def forest_importance(spark, d):
    """How much of what cuts gain is each band's."""
    model = forest.fit(_points(spark, d), "key", BANDS, "size", most=2, **SIZE)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(BANDS, model.importance()[0], strict=True)], "feature string, importance double")


def forest_buffered(spark, d):
    """Sites' values by trees of spatial folds that have seen no site of the fold, nor any nearer than the buffer to one."""
    sites = src.sites(spark, d)
    folded = sites.withColumn("fold", F.pmod(F.floor(F.col("x") / 60) + F.floor(F.col("y") / 60), F.lit(FOLDS)).cast("int"))
    near = spatial.near_pairs(folded, BUFFER, ["site", "x", "y", "fold"]).where(F.col("d") < BUFFER)
    inside = near.groupBy(F.col("site1").alias("site")).agg(F.collect_set("fold2").alias("around"))  # no more than there are folds
    rows = folded.join(inside, "site", "left").withColumn("out", F.array_union(F.array("fold"), F.coalesce("around", F.array().cast("array<int>"))))
    model = forest.fit(rows, "site", ["u", "x", "y"], "v", out="out", folds=FOLDS, most=2, **SIZE)
    return forest.predict(folded, model, fold="fold").select("site", "fold", "v", "predicted", "spread")


def forest_pixels(spark, d):
    """A map of the sites' values over all pixels, and how far the trees are apart; pixels without data are null."""
    px = src.raster(spark, d)
    places = src.sites(spark, d).select("site", "v", F.floor(F.col("x") / 2).cast("int").alias("row"), (F.col("site") % 128).cast("int").alias("col"))
    model = forest.fit(places.join(px, ["row", "col"]).where("b4 <> 0"), "site", PIXELS, "v", most=2, **SIZE)
    out = forest.predict(px.withColumn("valid", F.greatest(*PIXELS) > 0), model, valid="valid")
    return out.select("row", "col", "predicted", "spread")


def queries() -> dict:
    return {f.__name__: f for f in (forest_folds, forest_scores, forest_importance, forest_buffered, forest_pixels)}


def _bound(x: str, of: str) -> str:
    """``of`` with its v bound to ``x``."""
    return f"list_transform([{x}], lambda v: {of})[1]"


def _mixed(x: str) -> str:
    for _ in range(2):
        x = _bound(x, f"(xor(v, v >> 16) * {forest.SPREAD}) & {forest.MASK}")
    return _bound(x, "xor(v, v >> 16)")


def _hashed(a: str, b: str) -> str:
    return _mixed(f"(({_mixed(f'({a})::bigint & {forest.MASK}')} + (({b})::bigint & 1048575) * 1000003) & {forest.MASK})")


def forest_sql(rows: str, names: list[str], excluded: str, asked: str, folds: int, most: int, trees: int, depth: int, least: int, bins: int) -> str:
    """CTEs after ``with``: ``nodes`` (model, tree, node, w, s), ``cuts`` (model, tree, node, j, gain) and ``told`` (rid, predicted, spread).

    rows (key, y, columns), excluded (key, fold), asked (rid, fold, columns).
    """
    at = ", ".join(f"{k / bins!r}" for k in range(1, bins)) + ", 0.5"
    long = lambda table, id: " union all ".join(f"select {id} id, {j} j, {c}::double x from {table}" for j, c in enumerate(names))
    binned = "len(list_filter(es, lambda e: e < coalesce(x, m)))"
    out = [
        f"fr as materialized ({rows})", f"aq as materialized ({asked})", f"lo as ({long('fr', 'key')})", f"qu as (select j, quantile_cont(x, [{at}]) q from lo where x is not null group by 1)",
        f"ed as materialized (select j, list_sort(list_distinct(q[:{bins - 1}])) es, q[{bins}] m from qu)",
        "ends as materialized (select min(y)::double a, case when max(y) > min(y) then (max(y) - min(y))::double / 1048576 else 1 end st from fr)",
        f"fx as materialized (select id key, j, {binned} b from lo join ed using (j))", f"al as ({long('aq', 'rid')})", f"ax as materialized (select id rid, j, {binned} b from al join ed using (j))",
        "yy as (select key, round_even((y - a) / st, 0)::bigint ys from fr, ends where y is not null)", f"hu as (select key, ys, t tree, {_hashed('key', 't')} u from yy, (select unnest(range({trees})) t))",
        f"dr as materialized (select key, tree, w, w * ys wy from (select *, {' + '.join(f'(u >= {t})::int' for t in forest.POISSON)} w from hu) where w > 0)",
        f"ex as ({excluded})", f"s0 as materialized (select model, tree, key, w, wy, 1 node from dr, (select unnest(range({folds})) model) where not exists (select 1 from ex where ex.key = dr.key and ex.fold = model))",
        "q0 as (select rid, fold model, tree, 1 node from aq, (select unnest(range(" + str(trees) + ")) tree))",
    ]
    for k in range(depth + 1):
        out.append(f"t{k} as materialized (select model, tree, node, sum(w)::double w, sum(wy)::double s from s{k} group by 1, 2, 3)")
        if k == depth:
            break
        out += [
            f"u{k} as materialized (select tree, node, j from (select tree, node, j, row_number() over (partition by tree, node order by {_hashed(_hashed('tree', 'node'), 'j')}, j) p from (select distinct tree, node from s{k}), (select unnest(range({len(names)})) j)) where p <= {most})",
            f"h{k} as (select model, tree, node, j, b, sum(w)::double w, sum(wy)::double s from s{k} join u{k} using (tree, node) join fx using (key, j) group by 1, 2, 3, 4, 5)",
            f"c{k} as (select model, tree, node, j, b, sum(w) over p wl, sum(s) over p sl from h{k} window p as (partition by model, tree, node, j order by b))",
            f"g{k} as (select c.*, sl * sl / wl + (t.s - sl) * (t.s - sl) / (t.w - wl) - t.s * t.s / t.w gain from c{k} c join t{k} t using (model, tree, node) where wl >= {least} and t.w - wl >= {least})",
            f"b{k} as materialized (select model, tree, node, j, b cut, gain from (select *, row_number() over (partition by model, tree, node order by gain desc, j, b) p from g{k}) where p = 1 and gain > 1e-9)",
            f"s{k + 1} as materialized (select s.model, s.tree, s.key, s.w, s.wy, 2 * s.node + (fx.b > b.cut)::int node from s{k} s join b{k} b using (model, tree, node) join fx on fx.key = s.key and fx.j = b.j)",
            f"q{k + 1} as (select q.rid, q.model, q.tree, case when b.j is null then q.node else 2 * q.node + (ax.b > b.cut)::int end node from q{k} q left join b{k} b using (model, tree, node) left join ax on ax.rid = q.rid and ax.j = b.j)",
        ]
    out += [
        "nodes as (" + " union all ".join(f"select * from t{k}" for k in range(depth + 1)) + ")", "cuts as (" + " union all ".join(f"select model, tree, node, j, gain from b{k}" for k in range(depth)) + ")",
        f"told as (select rid, avg(s / w * st + a) predicted, stddev_pop(s / w * st + a) spread from q{depth} join nodes using (model, tree, node), ends group by 1)",
    ]
    return ", ".join(out)


def oracle_sql() -> dict[str, str]:
    fold = f"({oracle._hash('point_id::varchar || ' + chr(39) + '.42' + chr(39))} % {FOLDS})::int"
    key = "point_id * 3 + case date when 'A' then 0 when 'N' then 1 else 2 end"
    named = f"pf as (select *, {key} key, {fold} fold from pts)"
    columns = ", ".join(BANDS)
    points = forest_sql(f"select key, size y, {columns} from pf", BANDS, "select key, fold from pf", f"select key rid, fold, {columns} from pf", folds=FOLDS, most=2, **SIZE)
    whole = forest_sql(f"select key, size y, {columns} from pf", BANDS, "select key, fold from pf where false", f"select key rid, 0 fold, {columns} from pf where false", folds=1, most=2, **SIZE)
    told = "select point_id, date, fold, size y, predicted, spread from pf join told on rid = key"
    folded = "sf as (select *, ((floor(x / 60) + floor(y / 60)) % 3)::int fold from sites)"
    within = f"select site key, fold from sf union select a.site, b.fold from sf a join sf b on a.site <> b.site and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < {BUFFER}"
    buffered = forest_sql("select site key, v y, u c0, x c1, y c2 from sf", ["c0", "c1", "c2"], within, "select site rid, fold, u c0, x c1, y c2 from sf", folds=FOLDS, most=2, **SIZE)
    bands = ", ".join(PIXELS)
    mapped = forest_sql(
        f"select site key, v y, {bands} from sites join px on row = floor(x / 2)::int and col = site % 128 where b4 <> 0", PIXELS, "select 0 key, 0 fold where false", f"select row * 128 + col rid, 0 fold, {bands} from px where greatest({bands}) > 0", folds=1, most=2, **SIZE
    )
    share = "gs as (select tree, j, sum(gain) g from cuts group by 1, 2), gt as (select tree, sum(g) t from gs group by 1)"
    of = " union all ".join(f"select '{c}' feature, {j} j" for j, c in enumerate(BANDS))
    return {
        "forest_folds": f"with {oracle.POINTS}, {named}, {points} {told}",
        "forest_scores": f"with {oracle.POINTS}, {named}, {points}, tl as ({told}) select fold, count(*) n, 1 - sum((y-predicted)*(y-predicted)) / (var_pop(y) * count(*)) r2, sqrt(avg((y-predicted)*(y-predicted))) rmse, avg(abs(y-predicted)) mae from tl group by 1",
        "forest_importance": f"with {oracle.POINTS}, {named}, {whole}, {share} select feature, coalesce((select sum(g / t) from gs join gt using (tree) where gs.j = f.j), 0) / {SIZE['trees']} importance from ({of}) f",
        "forest_buffered": f"with {oracle.SITES}, {folded}, {buffered} select site, fold, v, predicted, spread from sf left join told on rid = site",
        "forest_pixels": f"with {oracle.PIXELS}, {oracle.SITES}, {mapped} select px.row, px.col, predicted, spread from px left join told on rid = px.row * 128 + px.col",
    }
