"""N-gram Jaccard join: MinHash bands for candidates, full n-gram sets for the verdict.

Documents with equal shingle sets are one set of some weight. Sets' band hashes
are shuffled. Sets with the same first partner live in blocks of bounded size;
two blocks meet if some of their sets share a band hash. There the
intersections of all full shingle sets are counted at once, by a sparse
product, and only link counts and one root per set leave, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, components, join_hot, likely, load
from .embeddings import roots
from .kernels import LOWER, POWER, mix, slices, span_hashes, tidy, utf8, words

_U = np.uint64
#: Words of a shingle, and the similarity from which two documents are linked.
WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9995
#: Documents and bytes of one side of a block.
BLOCK_ROWS, BLOCK_BYTES = 512, 4_000_000
#: Bytes of text that a task takes apart at once.
SLICE_BYTES = 2_000_000
#: Stands for a null id inside; nulls come out as nulls.
NO_ID = -(2**63)


def bands_for(similarity: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): most rows, so fewest false candidates, that find a pair at ``similarity`` with ``recall``.

    ``most`` is the number of hash functions; it is raised to what one row a band needs.
    """
    if not (0 < similarity <= 1 and 0 < recall < 1):
        raise ValueError("similarity must lie in (0, 1], recall in (0, 1)")
    alone = int(np.ceil(np.log1p(-recall) / np.log1p(-similarity))) if similarity < 1 else 1
    best, most = (alone, 1), max(most, alone)
    for rows in range(1, 17):
        chance = similarity**rows
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-chance))) if chance < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingle_sets(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, on end, and their offsets.

    Words are runs of non-blanks in lower-case (A-Z) bytes; a text of fewer
    than ``size`` words is one shingle, a text of none has none.
    """
    data, offsets = utf8(column)
    data = LOWER[data]
    n = len(offsets) - 1
    starts, ends, text = words(data, offsets)
    h = span_hashes(data, starts, ends)
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    total = np.zeros(len(h), _U)
    place = np.arange(len(h)) - first[text]
    for k in range(min(size, len(h))):
        moved = np.zeros_like(h)
        moved[: len(h) - k] = h[k:]
        inside = place + k < count[text]
        total = np.where(inside, mix(total * _U(POWER) + moved + _U(k + 1)), total)
    keep = np.flatnonzero(place <= (count - np.minimum(count, size))[text])
    s, t = total[keep], text[keep]
    order = np.lexsort((s, t))
    s, t = s[order], t[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    s, t = s[new], t[new]
    return s, np.concatenate(([0], np.cumsum(np.bincount(t, minlength=n)))).astype(np.int64)


def minhashes(s: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """``count`` minimum hashes of every non-empty set (rows of empty sets are undefined)."""
    filled = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, count), np.uint32)
    rng = np.random.default_rng(11)
    a, b = rng.integers(1, 1 << 63, count, dtype=np.uint64) | _U(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)
    for k in range(count):
        x = ((s * a[k] + b[k]) >> _U(32)).astype(np.uint32)
        out[filled, k] = np.minimum.reduceat(x, offsets[:-1][filled])
    return out


def text_digest(text: str) -> Column:
    """64 bits that tell texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sketches(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """(doc, digest, d1, d2, n, bytes, bands) of every row of ``docs`` (doc, digest, t): set digest, set size, band hashes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                s, offsets = shingle_sets(part.column(2), size)
                n = np.diff(offsets)
                m = minhashes(s, offsets, bands * rows)
                key = np.zeros((len(n), bands), _U)
                for r in range(rows):
                    key = mix(key * _U(31) + m[:, r::rows][:, :bands].astype(_U) + _U(1))
                key = mix(key + np.arange(bands, dtype=_U) * _U(0xD1342543DE82EF95))
                sums = np.zeros((2, len(s) + 1), _U)
                np.cumsum(mix(s), out=sums[0, 1:])
                np.cumsum(mix(s ^ _U(0xA5A5A5A55A5A5A5A)), out=sums[1, 1:])
                d1, d2 = (x[offsets[1:]] - x[offsets[:-1]] for x in sums)
                size_of = part.column(2).cast(pa.large_string())
                lengths = np.diff(utf8(size_of)[1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * bands, bands, dtype=np.int32)), pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(lengths), lists],
                    ["doc", "digest", "d1", "d2", "n", "bytes", "bands"],
                )

    return docs.select("doc", "digest", "t").mapInArrow(tidy(run), "doc long, digest long, d1 long, d2 long, n long, bytes long, bands array<long>")


def set_links(sets: list[np.ndarray], split: int | None, similarity: float):
    """Pairs (i, j), i < j, of sets with Jaccard similarity; with ``split``, only i < split <= j.

    Intersections come from the shared elements: elements' holders are listed
    once, and each row's counts are a bincount over the holders of its elements.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    value, held = flat[order], owner[order]
    edge = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1], [True])))
    shared = np.diff(edge)
    # position of every (element, owner) within the sorted list, by owner
    group = np.repeat(np.arange(len(shared)), shared)
    back = np.empty(len(flat), np.int64)
    back[order] = group
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(n if split is None else split):
        own = back[at[i] : at[i + 1]]
        own = own[shared[own] > 1]
        if not len(own):
            continue
        lengths = shared[own]
        spots = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - edge[own], lengths)
        common = np.bincount(held[spots], minlength=n)
        jaccard = common / np.maximum(sizes[i] + sizes - common, 1)
        js = np.flatnonzero(jaccard >= similarity)
        js = js[js > i] if split is None else js[js >= split]
        if len(js):
            yield np.full(len(js), i), js


def jaccard_join(
    docs: DataFrame, similarity: float = SIMILARITY, size: int = WORDS, recall: float = RECALL, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, digest, class_id, class_digest, n_links, kept), one row for every row of ``docs``.

    n_links counts the other rows whose shingle sets are as similar as
    ``similarity``; the class of a row, what links reach, is named by the least
    (doc_id, digest) in it, class_id and class_digest; kept marks one row of
    every class, one of that name. digest tells texts of one id apart. A text
    of fewer words than a shingle has its words as its one shingle; null and
    blank texts have none, link with nothing and are kept. Repeated rows are
    links of each other. A null id comes out as null, and before all others in
    the naming of classes. Other columns are ignored; an empty table gives an empty result. The candidates' recall
    at the threshold is ``recall``, more above it; equal sets are always found.
    """
    spark = docs.sparkSession
    staging = Staging(spark, "jaccard")
    bands, rows = bands_for(similarity, recall)
    least = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    docs = docs.select(least.alias("doc"), text_digest(text).alias("digest"), F.col(text).alias("t"))
    # rows and sets are numbered as they are staged, so that numbers hold whatever ids repeat
    sketch = staging.table(sketches(docs, bands, rows, size).withColumn("row", F.monotonically_increasing_id()))
    full = sketch.where("n > 0")
    place = F.struct("doc", "digest", "row")
    sets = full.groupBy("d1", "d2", "n").agg(F.min(place).alias("first"), F.count("*").alias("weight"), F.max("bytes").alias("bytes"))
    reps = staging.table(sets.withColumn("rep", F.monotonically_increasing_id()))
    banded = full.select("row", "bands").join(reps.select(F.col("first.row").alias("row"), "rep"), "row")
    keyed = banded.select("rep", F.explode("bands").alias("key"))
    lead = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("end")).where("lead <> end").select("key", "lead")
    near = staging.table(keyed.join(lead, "key").select("key", "rep", "lead"))
    staging.settle(2)  # each step's shuffle goes before the next one's comes
    # a set's block: its least partner's, in as many parts as keep each within rows and bytes
    home = near.groupBy("rep").agg(F.min("lead").alias("lead")).join(reps.select("rep", "first", "weight", "bytes"), "rep")
    extent = home.groupBy("lead").agg(F.count("*").alias("k"), F.sum("bytes").alias("size"))
    parts = F.greatest(F.ceil(F.col("k") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_BYTES), F.lit(1)).alias("parts")
    found_rows = near.agg(F.count_distinct("rep")).first()[0]
    placed = join_hot(home, extent.select("lead", "k", parts), ["lead"], "k", found_rows)
    placed = staging.table(placed.withColumn("block", F.xxhash64("lead", F.pmod(F.xxhash64("rep"), "parts"))).drop("lead", "bytes", "parts"))
    # blocks that share a band hash meet; every block meets itself
    met = near.join(placed.select("rep", "block"), "rep").groupBy("key").agg(F.collect_set("block").alias("q"))
    met = met.withColumn("p", F.explode("q")).withColumn("q", F.explode("q")).where("p <= q").select("p", "q").distinct()
    side = lambda at, right: met.select(F.col(at).alias("block"), F.struct("p", "q", F.lit(right).alias("right")).alias("meet"))
    partners = side("p", False).unionByName(side("q", True).where("meet.p <> meet.q")).groupBy("block").agg(F.collect_list("meet").alias("meets"))
    # shuffled at every size: the blocks' members grow with the input; the others' texts are not shuffled
    wanted = placed.join(partners, "block").select("first.doc", "first.digest", "rep", "weight", "meets")
    texts = likely(docs, placed.select("first.doc", "first.digest"), ["doc", "digest"], placed.count()).join(wanted.hint("merge"), ["doc", "digest"])
    sided = texts.select("rep", "weight", "t", F.explode("meets").alias("m")).select("m.p", "m.q", "m.right", "rep", "weight", "t")
    sided = sided.repartition("p", "q").sortWithinPartitions("p", "q", "right", "rep")

    def verify(group):
        # group: lists of (rep, weight, set, right) of one block pair, repeated rows of one set count once
        same = group[0][4] == group[0][5]
        reps_, weights, sets, right = [], [], [], 0
        for rep, weight, s, side, _, _ in group:
            if reps_ and reps_[-1] == rep:
                continue
            reps_.append(rep), weights.append(weight), sets.append(s)
            right += not side
        split = None if same else right
        ids, w = np.array(reps_, np.int64), np.array(weights, np.int64)
        if len(ids) < 2 or split in (0, len(ids)):
            return None
        links, pairs = np.zeros(len(ids), np.int64), []
        for i, j in set_links(sets, split, similarity):
            np.add.at(links, i, w[j])
            np.add.at(links, j, w[i])
            pairs.append((i, j))
        if not pairs:
            return None
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        p, q = (np.concatenate(x) for x in zip(*pairs, strict=True))
        root = ids[order][roots(len(ids), [(place[p], place[q])])[place]]
        some = links > 0
        return ids[some], links[some], root[some]

    def run(batches):
        group, key, found, held = [], None, [], 0
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("t"), SLICE_BYTES):
                s, offsets = shingle_sets(part.column("t"), size)
                columns = [part.column(c).to_pylist() for c in ("p", "q", "right", "rep", "weight")]
                for r, (p, q, right, rep, weight) in enumerate(zip(*columns, strict=True)):
                    if (p, q) != key:
                        if len(group) > 1 and (out := verify(group)):
                            found.append(out)
                            held += len(out[0])
                        group, key = [], (p, q)
                    group.append((rep, weight, s[offsets[r] : offsets[r + 1]].copy(), right, p, q))
                if held > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["rep", "links", "root"])
                    found, held = [], 0
        if len(group) > 1 and (out := verify(group)):
            found.append(out)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["rep", "links", "root"])

    found = staging.table(sided.mapInArrow(tidy(run), "rep long, links long, root long"))
    staging.settle(2)
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), staging).withColumnRenamed("id", "rep")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(classes, "rep", "left")
    joined = reps.join(linked, "rep", "left").withColumn("class", F.coalesce("component", "rep"))
    named = joined.where("component is not null").groupBy("class").agg(F.min("first").alias("class_first"))
    known = joined.join(named, "class", "left").select(
        "d1", "d2", "n", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("class_first", "first").alias("name")
    )
    out = join_hot(sketch.drop("bands"), known, ["d1", "d2", "n"], "weight", sketch.count())
    name = F.coalesce("name", place)
    return out.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "digest", F.nullif(name["doc"], F.lit(NO_ID)).alias("class_id"), name["digest"].alias("class_digest"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), (name["row"] == F.col("row")).alias("kept"),
    )


def drop_near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class of ``jaccard_join``; null and blank texts stay as they are."""
    solid = F.coalesce(F.col(text).rlike(r"[^ \t-\r]"), F.lit(False))
    full = docs.where(solid)
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    kept = jaccard_join(full, text=text, doc_id=doc_id).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("digest").alias("_digest"))
    keyed = full.withColumns({"_id": number, "_digest": text_digest(text)})
    # rows of one id and text are one row of their class
    one = keyed.join(kept, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"]).select(*docs.columns)
    return one.unionByName(docs.where(~solid))


def op6_jaccard(spark, sf_dir):
    """Near-duplicate classes of all documents by word shingles."""
    return jaccard_join(load(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")
