"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

Vectors are scaled to unit length and quantised to int8; the length of what
quantisation left out bounds the error of every product. Only int8 values and
bounds are shuffled and multiplied, exactly, tile by tile. A pair whose lower
bound reaches the threshold is linked, one whose upper bound does not is not;
what lies between names its vectors, which alone are fetched in full precision
and compared again.

Equal vectors are one vector of some weight. Vectors are dealt to tiles by
their nearest of a few sampled vectors, and pairs of tiles whose caps on the
sphere are too far apart are never enumerated, which loses no link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, components, join_hot, load
from .kernels import tidy

#: Vectors of a tile; a product works on STRIP rows of it at a time.
TILE, STRIP = 4096, 512
#: Sampled vectors by which vectors are dealt to tiles.
CENTRES = 256


def usable(vector: Column) -> Column:
    """No null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """int8 values, scales, lengths of the quantised vectors, lengths of the rest, of unit rows."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    # the last factor covers rounding in double precision
    return q, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1) * (1 + 1e-12) + 1e-15


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bounded(threshold: float, own: bool, left: tuple, right: tuple):
    """(i, j, i, j) in parts: row pairs that reach ``threshold`` whatever was left out, and those that only may.

    left and right are (int8 values, scales, lengths, lengths of the rest); of
    an ``own`` product only i < j count.
    """
    (qa, sa, na, ea), (qb, sb, nb, eb) = left, right
    exact = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    other = np.ascontiguousarray(qb.astype(exact).T)
    slack = na * eb.max() + ea * (nb.max() + eb.max())
    # the least product of integers that any column could need, a little below for rounding
    least = ((threshold - slack - 1e-9) / (sa * (sb.max() if threshold > 0 else sb.min()))).astype(exact)
    least = np.where(threshold - slack - 1e-9 > 0, least * exact(1 - 1e-6), -np.inf)
    for lo in range(0, len(qa), STRIP):
        begin = lo if own else 0
        dots = qa[lo : lo + STRIP].astype(exact) @ other[:, begin:]
        i, j = np.nonzero(dots >= least[lo : lo + STRIP, None])
        value = dots[i, j].astype(np.float64)
        i, j = i + lo, j + begin
        if own:
            keep = i < j
            i, j, value = i[keep], j[keep], value[keep]
        value *= sa[i] * sb[j]
        error = na[i] * eb[j] + ea[i] * (nb[j] + eb[j])
        sure = value - error >= threshold + 1e-12
        maybe = ~sure & (value + error >= threshold - 1e-12)
        yield i[sure], j[sure], i[maybe], j[maybe]


class Links:
    """Links within one pair of tiles: what each vector has found, and the least number that it reaches."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.weights, self.found, self.pairs = ids, weights, np.zeros(len(ids), np.int64), []

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        self.found += np.bincount(p, self.weights[q], len(self.ids)).astype(np.int64) + np.bincount(q, self.weights[p], len(self.ids)).astype(np.int64)
        self.pairs.append((p, q))

    def rows(self) -> tuple[np.ndarray, ...]:
        order = np.argsort(self.ids, kind="stable")  # labels follow the order of the numbers
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = self.ids[order][roots(len(order), [(place[p], place[q]) for p, q in self.pairs])[place]]
        some = self.found > 0
        return self.ids[some], self.found[some], root[some]


def roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of n by the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for a, b in pairs:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def sides_of(unit: np.ndarray, centres: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the ``centres`` of the rows' dimension, and the angle to it; without one: -1 and a half turn."""
    fit = [k for k, c in enumerate(centres) if len(c) == unit.shape[1]]
    if not fit:
        return np.full(len(unit), -1, np.int32), np.full(len(unit), np.pi)
    dots = unit @ np.stack([centres[k] for k in fit]).T
    best = dots.argmax(1)
    return np.array(fit, np.int32)[best], np.arccos(np.clip(dots[np.arange(len(unit)), best], -1, 1)) + 1e-7


def met_groups(caps: list, centres: list[np.ndarray], threshold: float, tile: int) -> tuple[list, list]:
    """Groups of sides that fill tiles, as (d, side, group, parts), and pairs of groups that could hold a link.

    caps: (d, side, vectors, widest angle), of which there are as many as centres and dimensions.
    """
    placed, groups = [], []
    for d in sorted({c[0] for c in caps}):
        rest = [c for c in caps if c[0] == d]
        at, room = rest[0], 0
        while rest:
            # along the nearest next centre, so that a tile's sides lie close together
            at = min(rest, key=lambda c: -1.0 if c[1] < 0 or at[1] < 0 else -float(centres[c[1]] @ centres[at[1]]))
            rest.remove(at)
            if room < at[2] or not groups:
                groups.append([])
                room = tile
            groups[-1].append(at)
            room -= at[2]
            placed.append((d, at[1], len(groups) - 1))
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def close(a, b):
        if a[0] != b[0]:
            return False
        if a[1] == b[1] or min(a[1], b[1]) < 0:
            return True
        return np.arccos(np.clip(centres[a[1]] @ centres[b[1]], -1, 1)) <= a[3] + b[3] + reach

    parts = [max(1, -(-sum(c[2] for c in g) // tile)) for g in groups]
    pairs = [(g, h) for g in range(len(groups)) for h in range(g, len(groups)) if any(close(a, b) for a in groups[g] for b in groups[h])]
    return [(d, s, g, parts[g]) for d, s, g in placed], [(g, h, parts[g], parts[h]) for g, h in pairs]


def near_links(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for every row of ``vectors``.

    Null, zero or non-finite vectors, and vectors with null components, link
    with nothing; vectors link only with vectors of their dimension. Equal
    vectors, told by 128 bits, link with each other. Rows are told apart by
    themselves, whatever ids repeat: a row has the links of its own vector.
    component_id is the least id that links reach, ids that are null aside;
    kept is vec_id = component_id, and true where there is no such id. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    staging = Staging(spark, "embeddings")
    x = F.when(usable(F.col(embedding)), F.transform(embedding, lambda v: v.cast("double")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
    keyed = rows.withColumns({"k1": F.when(F.col("x").isNotNull(), F.xxhash64("x")), "k2": F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(1), F.col("x")))})
    good = keyed.where("x is not null")
    kinds = "d int, q binary, scale double, near double, far double"

    def code(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                column = part.column(3)
                dims, flat = pc.list_value_length(column).to_numpy(), column.flatten().to_numpy()
                at, q = np.cumsum(dims) - dims, [b""] * len(dims)
                numbers = np.zeros((3, len(dims)))
                for d in np.unique(dims):
                    some = np.flatnonzero(dims == d)
                    values, *bounds = quantise(units(flat[at[some][:, None] + np.arange(d)]))
                    numbers[:, some] = bounds
                    for r, raw in zip(some, values, strict=True):
                        q[r] = raw.tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(dims.astype(np.int32)), pa.array(q, pa.binary()), *map(pa.array, numbers)], names)

    names = ["k1", "k2", "vec_id", "d", "q", "scale", "near", "far"]
    coded = good.select("k1", "k2", "vec_id", "x").mapInArrow(tidy(code), f"k1 long, k2 long, vec_id long, {kinds}")
    one = coded.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), *[F.first(c).alias(c) for c in names[3:]])
    reps = staging.table(one.withColumn("rep", F.monotonically_increasing_id()))
    sample = reps.select("q", "k1", "rep").orderBy("k1", "rep").limit(CENTRES).collect()  # of bounded number; only says how tiles are dealt
    centres = [units(np.frombuffer(r["q"], np.int8)[None].astype(float))[0] for r in sample]

    def side(batches):
        for batch in batches:
            dims, q = batch.column(0).to_numpy(), batch.column(1)
            sides, angle = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            scale, far = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            for d in np.unique(dims):
                some = np.flatnonzero(dims == d)
                near = np.frombuffer(b"".join(q.take(pa.array(some)).to_pylist()), np.int8).reshape(-1, d)
                sides[some], angle[some] = sides_of(units(near.astype(float)), centres)
            # the quantised vector is off by an angle of at most asin(far), since the vector is of unit length
            angle += np.arcsin(np.minimum(far, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sides), pa.array(angle)], [*batch.schema.names, "side", "angle"])

    sided = reps.select("d", "q", "scale", "near", "far", "rep", "weight").mapInArrow(tidy(side), f"{kinds}, rep long, weight long, side int, angle double")
    sided = staging.table(sided)
    caps = [tuple(r) for r in sided.groupBy("d", "side").agg(F.count("*"), F.max("angle")).orderBy("d", "side").collect()]
    placed, pairs = met_groups(caps, centres, threshold, tile)
    where = spark.createDataFrame(placed or [(0, 0, 0, 1)], "d int, side int, grp int, parts int")
    tiled = sided.join(F.broadcast(where), ["d", "side"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))

    def block(key, table):
        packed = {c: pa.array([table.column(c).to_numpy().tobytes()]) for c in ("rep", "weight", "scale", "near", "far")}
        return pa.table({"grp": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "d": table.column("d").slice(0, 1).combine_chunks(), "q": pa.array([b"".join(table.column("q").to_pylist())]), **packed})

    packed = "d int, q binary, rep binary, weight binary, scale binary, near binary, far binary"
    blocks = staging.table(tiled.select("grp", "part", "d", "q", "rep", "weight", "scale", "near", "far").groupBy("grp", "part").applyInArrow(block, f"grp int, part int, {packed}"))
    # pairs of groups are as few as pairs of centres; their parts are enumerated by Spark
    met = spark.createDataFrame(pairs or [(0, 0, 0, 0)], "g int, h int, m int, n int").where("m > 0")
    met = met.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("g < h or i <= j")
    met = met.select("g", "h", "i", "j").repartition(max(1, sum(p[2] * p[3] for p in pairs) // 2), "g", "h", "i", "j")
    fields = ["q", "rep", "weight", "scale", "near", "far"]
    left = blocks.select(F.col("grp").alias("g"), F.col("part").alias("i"), "d", *[F.col(c).alias(f"{c}1") for c in fields])
    right = blocks.select(F.col("grp").alias("h"), F.col("part").alias("j"), *[F.col(c).alias(f"{c}2") for c in fields])

    def tile_of(batch, r, d, k):
        raw = {c: batch.column(f"{c}{k}")[r].as_buffer() for c in fields}
        numbers = tuple(np.frombuffer(raw[c]) for c in ("scale", "near", "far"))
        return np.frombuffer(raw["rep"], np.int64), np.frombuffer(raw["weight"], np.int64), (np.frombuffer(raw["q"], np.int8).reshape(-1, d), *numbers)

    def compare(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                g, h, i, j, d = (batch.column(c)[r].as_py() for c in ("g", "h", "i", "j", "d"))
                ids, weights, mine = tile_of(batch, r, d, 1)
                own, shift, theirs = (g, i) == (h, j), 0, mine
                if not own:
                    shift = len(ids)
                    more, heavy, theirs = tile_of(batch, r, d, 2)
                    ids, weights = np.concatenate((ids, more)), np.concatenate((weights, heavy))
                links, unsure = Links(ids, weights), np.zeros(len(ids), bool)
                for p, q, a, b in bounded(threshold, own, mine, theirs):
                    links.add(p, q + shift)
                    unsure[a] = unsure[b + shift] = True
                rep, found, root = links.rows()
                if len(rep):
                    none = pa.nulls(len(rep), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(found), pa.array(root), none, none, none, none, none.cast(pa.bool_())], kept)
                at = np.flatnonzero(unsure)
                if len(at):
                    none, same = pa.nulls(len(at), pa.int64()), [pa.array(np.full(len(at), v, np.int32)) for v in (g, h, i, j)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), none, none, *same, pa.array(~np.array(at < shift) if shift else np.zeros(len(at), bool))], kept)

    kept = ["rep", "links", "root", "g", "h", "i", "j", "other"]
    told = met.join(left, ["g", "i"]).join(right, ["h", "j"]).mapInArrow(tidy(compare), "rep long, links long, root long, g int, h int, i int, j int, other boolean")
    told = staging.table(told)
    unsure = told.where("links is null").select("rep", "g", "h", "i", "j", "other")
    asked = unsure.select("rep").distinct().join(reps.select("rep", "k1", "k2", "weight"), "rep")
    full = good.select("k1", "k2", "x").join(asked.hint("merge"), ["k1", "k2"]).groupBy("rep").agg(F.first("weight").alias("weight"), F.first("x").alias("x"))

    def again(table):
        ids, weights = table.column("rep").to_numpy(), table.column("weight").to_numpy()
        other = table.column("other").to_numpy(zero_copy_only=False)
        unit = units(table.column("x").combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
        links, coded = Links(ids, weights), quantise(unit)
        rows, own = (np.flatnonzero(~other), np.flatnonzero(other)), not other.any()
        mine, theirs = (tuple(c[k] for c in coded) for k in (rows[0], rows[0] if own else rows[1]))
        for _, _, a, b in bounded(threshold, own, mine, theirs) if len(rows[0]) else ():
            a, b = rows[0][a], (rows[0] if own else rows[1])[b]
            for at in range(0, len(a), 1 << 17):
                p, q = a[at : at + (1 << 17)], b[at : at + (1 << 17)]
                hit = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                links.add(p[hit], q[hit])
        return pa.table(dict(zip(("rep", "links", "root"), links.rows(), strict=True)))

    redone = unsure.join(full, "rep").groupBy("g", "h", "i", "j").applyInArrow(again, "rep long, links long, root long")
    found = staging.table(told.where("links is not null").select("rep", "links", "root").unionByName(redone))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), staging).withColumnRenamed("id", "rep")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("k1", "k2", "rep", "id", "weight").join(linked, "rep", "left").join(groups, "rep", "left").withColumn("class", F.coalesce("component", "rep"))
    named = known.where("component is not null").groupBy("class").agg(F.min("id").alias("least"))
    known = known.join(named, "class", "left").select(
        "k1", "k2", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("least")
    )
    narrow = keyed.select("vec_id", "k1", "k2")
    out = join_hot(narrow, known, ["k1", "k2"], "weight", narrow.count())
    least = F.coalesce("least", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), F.coalesce(F.col("vec_id") == least, least.isNull()).alias("kept")
    )


def op3_embeddings(spark, sf_dir):
    """Near-duplicate links and components of all embeddings."""
    return near_links(load(spark, sf_dir, "embeddings"))
