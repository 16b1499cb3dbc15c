"""Spelling variant grouping: an errata trie over heavy paths finds all one-edit pairs.

Words are sorted and dealt by ranges; every range walks the trie of its words,
level by level. At a node, the child with the most words goes on along the heavy
path; words below any other child merge into it with their next character
replaced by the heavy one or skipped, or with the heavy one skipped on the other
side. A merged word is a lookup: where it coincides with a word of the
vocabulary, the two are one edit apart. Words below two light children of one
node that only differ in that character meet under it. A word lies below at most
log2(words) light children, so there are that many merges for it, smaller into
larger. Nodes whose words lie in several ranges have their counts added up
first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, load, width
from .kernels import LOWER, ragged, slices, tidy, utf8

#: One in so many word occurrences, by hash, is altered for the query.
ODDS = 97
#: Code points of a word, and occurrences in all texts, at least; a form is so many times as frequent as its variant.
LEAST_CHARS, LEAST_COUNT, TIMES = 5, 3, 2
#: Bytes of text that a task works on at once, and distinct words that it adds up before they are shuffled.
SLICE_BYTES, COMBINE = 2_000_000, 400_000
#: Words of a range.
RANGE_WORDS = 40_000
#: Longest run of letters (bytes) that is hashed with all others at once.
SHORT = 48
#: Ends a word in the trie.
END = 0

_CRC = np.zeros(256, np.uint32)
for _b in range(256):
    _c = _b
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_b] = _c


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and text of the maximal runs of A-Z, a-z and U+00C0 to U+00FF."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    low = LOWER[data]
    ink = (low >= 97) & (low <= 122)
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0))
    ink[lead] = ink[lead + 1] = True
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first[n] = True
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1] | first[1:n]
    end[:-1] &= ~ink[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def crc32_after(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of what ``state`` is the CRC-32 of, followed by the byte spans."""
    out = state.astype(np.uint32)
    length = ends - starts
    for i in np.flatnonzero(length > SHORT):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(out[i]))
    order = np.argsort(-np.where(length > SHORT, 0, length), kind="stable")
    x, at, size = out[order] ^ np.uint32(0xFFFFFFFF), starts[order], np.where(length > SHORT, 0, length)[order]
    for k in range(int(size[0]) if len(size) else 0):
        m = np.searchsorted(-size, -k, side="left")  # those longer than k come first
        x[:m] = _CRC[(x[:m] ^ data[at[:m] + k]) & 0xFF] ^ (x[:m] >> np.uint32(8))
    out[order] = x ^ np.uint32(0xFFFFFFFF)
    return out


def word_counts(part: pa.RecordBatch, odds: int) -> pa.Table:
    """(word, n) of one batch (key, text), words of fewer than ``LEAST_CHARS`` code points left out."""
    data, offsets = utf8(part.column(1))
    data = LOWER[data]
    starts, ends, text = runs(data, offsets)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    length = chars[ends] - chars[starts]
    altered = []
    if odds:
        before = np.array([zlib.crc32(f"{k}:".encode()) for k in part.column(0).to_pylist()], np.uint32)
        h = crc32_after(before[text], data, starts, ends)
        hit = h % np.uint32(odds) == 0
        for i in np.flatnonzero(hit):
            word, at = data[starts[i] : ends[i]].tobytes().decode(), int(h[i]) % int(length[i])
            altered.append(word[:at] + word[at + 1 :])
        starts, ends, length = starts[~hit], ends[~hit], length[~hit]
    keep = length >= LEAST_CHARS
    starts, sizes = starts[keep], (ends - starts)[keep]
    places = pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))
    words = pa.LargeStringArray.from_buffers(len(sizes), places, pa.py_buffer(data[ragged(starts, sizes)]))
    words = pa.chunked_array([words, pa.array([w for w in altered if len(w) >= LEAST_CHARS], pa.large_string())])
    return pa.table({"word": words, "n": pa.array(np.ones(len(words), np.int64))}).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", odds: int = 0, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``LEAST_CHARS`` code points that occur ``least`` times in all texts.

    Words are runs of Latin-1 letters with A-Z in lower case. With ``odds``, of
    those occurrences whose CRC-32 of ``id:word`` it divides, one code point is
    left out, that at the CRC modulo the length. Null texts have no words, null
    ids are written as nothing.
    """

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                held.append(word_counts(part, odds))
                count += len(held[-1])
                if count > COMBINE:
                    held = [pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                    count = len(held[0])
                    if count > COMBINE // 2:
                        yield from out(held)
                        held, count = [], 0
        if held:
            yield from out(held)

    def out(held):
        done = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
        yield from done.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches()

    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return docs.select(key.alias("k"), F.col(text).alias("t")).mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def shared(a: str | None, b: str | None) -> int:
    """Characters that both begin with; -1 if either is missing."""
    if a is None or b is None:
        return -1
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def levels(words: list[str], left: int, right: int):
    """The trie of sorted ``words``, from the root down: depth, rows, node of each, child character of each, whether nodes are open.

    ``left`` and ``right`` say how many characters the first word shares with
    the range before and the last with the one after: nodes up to there are
    open, since they have words elsewhere. Nodes that are not and have one word
    are not visited.
    """
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    at = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    rows, node, depth, last = np.arange(len(words)), np.zeros(len(words), np.int64), 0, len(words) - 1
    while len(rows):
        child = np.full(len(rows), END, np.int64)
        more = lengths[rows] > depth
        child[more] = points[at[rows[more]] + depth]
        count = int(node[-1]) + 1
        open_ = np.zeros(count, bool)
        if rows[0] == 0 and depth <= left:
            open_[0] = True
        if rows[-1] == last and depth <= right:
            open_[-1] = True
        yield depth, rows, node, child, open_
        new = np.ones(len(rows), bool)
        new[1:] = (node[1:] != node[:-1]) | (child[1:] != child[:-1])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        keep = (child != END) & ((size[group] > 1) | ((rows == 0) & (depth < left)) | ((rows == last) & (depth < right)))
        rows, group = rows[keep], group[keep]
        node = np.unique(group, return_inverse=True)[1] if len(group) else group
        depth += 1


def child_counts(node: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, child, words) of the children of one level; rows of a child stand together."""
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (child[1:] != child[:-1])
    first = np.flatnonzero(new)
    return node[first], child[first], np.diff(np.concatenate((first, [len(node)])))


def heavy_children(node: np.ndarray, child: np.ndarray, size: np.ndarray, count: int) -> np.ndarray:
    """Of every node the character with the most words, the smallest of several; ``END`` if none goes on."""
    order = np.lexsort((-child, np.where(child == END, 0, size), node))
    out = np.full(count, END, np.int64)
    out[node[order]] = child[order]  # the last of each node stays
    return out


def merges(words: list[str], left: int, right: int, heavy: dict[str, int]):
    """(word's row, kind, key) of all merges: kind 0 looks a word up, 1 meets others under the key.

    heavy: the heavy children of the open nodes.
    """
    for depth, rows, node, child, open_ in levels(words, left, right):
        count = len(open_)
        nodes, children, size = child_counts(node, child)
        main = heavy_children(nodes, children, size, count)
        several = np.bincount(nodes, minlength=count)
        light = np.bincount(nodes, weights=(children != END) & (children != main[nodes]), minlength=count)
        for k in np.flatnonzero(open_):
            prefix = words[rows[0 if k == 0 else -1]][:depth]
            main[k] = heavy[prefix]
            several[k] = light[k] = 2  # elsewhere there may be more
        for i in np.flatnonzero((child != main[node]) & (several[node] > 1)):
            row, k = int(rows[i]), int(node[i])
            word, h = words[row], chr(main[k]) if main[k] != END else ""
            u, rest = word[:depth], word[depth + 1 :]
            if h:
                yield row, 0, u + h + word[depth:]  # the heavy character skipped on the other side
            if child[i] != END:
                if rest[:1] != word[depth]:  # of a doubled character only the last is skipped, or pairs would be found twice
                    yield row, 0, u + rest
                if h:
                    yield row, 0, u + h + rest
                if light[k] > 1:
                    yield row, 1, f"{u}\0{rest}"


def sorted_ranges(words: DataFrame, staging: Staging) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """``words`` with the range of each, and how far each range's ends share characters with its neighbours; two words a range reach the driver."""
    ranges = max(width(words.sparkSession), -(-words.count() // RANGE_WORDS))
    dealt = staging.table(words.repartitionByRange(ranges, "word").withColumn("part", F.spark_partition_id()))
    ends = sorted((r["part"], r["low"], r["high"]) for r in dealt.groupBy("part").agg(F.min("word").alias("low"), F.max("word").alias("high")).collect())
    if not ends:
        return dealt, {}
    joints = [shared(a[2], b[1]) for a, b in zip(ends, ends[1:], strict=False)]
    return dealt, {part: (before, after) for (part, _, _), before, after in zip(ends, [-1, *joints], [*joints, -1], strict=True)}


def near_words(words: DataFrame, staging: Staging) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n) that have others at one inserted, deleted or replaced code point.

    form is the most frequent of them, the smallest in code-point order of
    several. Words are distinct; pairs are found once, from the lighter side.
    """
    dealt, joints = sorted_ranges(words, staging)

    def open_counts(key, table):
        left, right = joints[key[0].as_py()]
        listed, found = sorted(table.column("word").to_pylist()), []
        if max(left, right) >= 0:
            for depth, rows, node, child, open_ in levels(listed, left, right):
                if depth > max(left, right):
                    break
                nodes, children, size = child_counts(node, child)
                for k in np.flatnonzero(open_):
                    prefix = listed[rows[0 if k == 0 else -1]][:depth]
                    found += [(prefix, int(c), int(s)) for c, s in zip(children[nodes == k], size[nodes == k], strict=True)]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["prefix", "child", "size"])

    # as many nodes as ranges share characters with their neighbours, each with one child a letter at most
    opened = dealt.select("part", "word").groupBy("part").applyInArrow(open_counts, "prefix string, child long, size long")
    best = opened.groupBy("prefix", "child").agg(F.sum("size").alias("size")).groupBy("prefix").agg(F.max(F.struct((F.col("child") != END).alias("on"), "size", (-F.col("child")).alias("c"))).alias("x"))
    heavy = {r["prefix"]: -r["c"] for r in best.select("prefix", "x.c").toLocalIterator()}

    def emit(key, table):
        pairs = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
        listed, n = [w for w, _ in pairs], np.array([n for _, n in pairs], np.int64)
        rows, kinds, keys = [], [], []
        for row, kind, found in merges(listed, *joints[key[0].as_py()], heavy):
            rows.append(row), kinds.append(kind), keys.append(found)
        rows = np.array(rows, np.int64)
        return pa.table([pa.array(kinds, pa.int32()), pa.array(keys, pa.string()), pa.array(listed, pa.string()).take(pa.array(rows)), pa.array(n[rows])], ["kind", "key", "word", "n"])

    merged = staging.table(dealt.groupBy("part").applyInArrow(emit, "kind int, key string, word string, n long"))
    hits = merged.where("kind = 0").join(words.select(F.col("word").alias("key"), F.col("n").alias("m")), "key")
    hits = hits.select(F.explode(F.array(F.struct("word", F.col("key").alias("other"), F.col("m").alias("other_n")), F.struct(F.col("key").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("x")).select("x.*", F.lit(1).cast("long").alias("k"))
    # words under one key differ in one character: no more of them than there are letters
    met = merged.where("kind = 1").groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("all")).where(F.size("all") > 1)
    met = met.select(F.explode("all").alias("x"), F.get("all", F.lit(0)).alias("one"), F.get("all", F.lit(1)).alias("two"), (F.size("all") - 1).cast("long").alias("k"))
    best = F.when(F.col("one.word") == F.col("x.word"), F.col("two")).otherwise(F.col("one"))
    met = met.select(F.col("x.word").alias("word"), best["word"].alias("other"), (-best["n"]).alias("other_n"), "k")
    first = F.min(F.struct((-F.col("other_n")).alias("n"), "other"))
    return hits.unionByName(met).groupBy("word").agg(F.sum("k").alias("n_near"), first.alias("x")).select("word", "n_near", F.col("x.other").alias("form"), (-F.col("x.n")).alias("form_n"))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each of ``words`` (word, n).

    form is the most frequent word at one edit, the smallest of several, if it
    occurs ``times`` as often; root is where forms lead to. Words are distinct;
    an empty table gives an empty result, other columns are ignored.
    """
    if times < 2:
        raise ValueError("forms have to be at least twice as frequent, or chains could not end")
    staging = Staging(words.sparkSession, "variants")
    words = staging.table(words.select("word", "n"))
    near = near_words(words, staging)
    enough = F.col("form_n") >= times * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")
    )
    known = staging.table(known)
    # every step doubles the frequency, so chains are short; each round doubles how far they are followed
    root = staging.table(known.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staging.table(root.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        done = moved.where("went").isEmpty()
        staging.drop(root)
        root = moved.select("word", "root")
        root._staged_path = moved._staged_path
        if done:
            break
    return known.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark, sf_dir):
    """Spelling variants among the words of all documents, one in ``ODDS`` occurrences altered."""
    staging = Staging(spark, "op12")
    return variants(staging.table(vocabulary(load(spark, sf_dir, "documents"), odds=ODDS)))
