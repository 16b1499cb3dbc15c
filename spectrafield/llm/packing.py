"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity``; pieces are packed into
sequences. Only the histogram of piece lengths, ``capacity`` numbers at most,
reaches the driver. There, bin after bin, a bitset subset-sum over the lengths
still available finds the fullest combination around the longest piece; the
combination is repeated while the lengths last, so the number of searches is
bounded by the number of lengths, not of pieces. Ranking the pieces of a length
and looking up their place is Spark's work again.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staging, load
from .kernels import slices, tidy

CAPACITY = 4096
END_ID = 1
#: Rows of one length that one ranking task orders.
RANK_ROWS = 50_000
#: Bytes of text that a task turns into tokens at once.
SLICE_BYTES = 1_000_000
#: Characters of a longer text that are taken apart at once.
PART = 1_000_000
_cache: dict = {}


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as (combination, repeats): a combination lists (length, pieces of it).

    Minimum bin slack: the longest available length seeds a bin; a bitset of
    reachable sums, filled length by length from long to short with binary
    splitting of their counts, gives the fullest total and the way to it.
    """
    left = {n: c for n, c in histogram.items() if c > 0 and 0 < n <= capacity}
    lengths = sorted(left, reverse=True)
    bins = []
    while lengths:
        seed = lengths[0]
        room = capacity - seed
        mask = (1 << (room + 1)) - 1
        sums, steps = 1, []
        target = 1 << room
        for n in lengths:
            if n > room:
                continue
            count = min(left[n] - (n == seed), room // n)
            k = 1
            while count > 0:
                k = min(k, count)
                grown = (sums | (sums << (n * k))) & mask
                if grown != sums:
                    steps.append((n, k, sums))
                    sums = grown
                count -= k
                k *= 2
            if sums & target:
                break
        total = sums.bit_length() - 1
        used = {seed: 1}
        for n, k, before in reversed(steps):
            if not before >> total & 1:
                used[n] = used.get(n, 0) + k
                total -= n * k
        repeats = min(left[n] // k for n, k in used.items())
        bins.append((sorted(used.items(), reverse=True), repeats))
        for n, k in used.items():
            left[n] -= k * repeats
        lengths = [n for n in lengths if left[n]]
    return bins


def _tables(bins: list) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, over the ranks of its pieces: interval starts, first sequence, pieces a sequence, offset."""
    taken: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for used, repeats in bins:
        offset = 0
        for n, k in used:
            start = taken.get(n, 0)
            rows.setdefault(n, []).append((start, sequence, k, offset))
            taken[n] = start + k * repeats
            offset += n * k
        sequence += repeats
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in rows.items()}


#: Words encoded whole and pieces that one generation of a worker's lookup holds together; two generations are kept.
KEPT = (400_000, 400_000)

# Kinds of characters in the tokenizer's own splitting rule, which takes apart
# 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
GAP, LETTER, NUMBER, OTHER, ODD, UNSEEN = range(6)
APOSTROPHE = ord("'")
#: What follows an apostrophe in a contraction.
ENDINGS = [np.frombuffer(x, np.uint8) for x in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")]
ASCII = bytes(
    GAP if x == 32 or 9 <= x <= 13 else LETTER if chr(x).isalpha() and x < 128 else NUMBER if 48 <= x <= 57 else OTHER
    for x in range(256)
)


class Lookup:
    """A tokenizer behind a lookup of pieces.

    Texts are taken apart into lower-case pieces by arrays of their characters,
    equal pieces are told by Arrow's dictionaries, and only new pieces are
    encoded, many at once, told apart by the tokens that end a piece. A word
    with one of the tokenizer's added tokens, with a character that has no
    single lower case, or with one that Python's Unicode does not know is a
    piece of its own, encoded as it is.
    """

    def __init__(self, path: str, kept: tuple[int, int] = KEPT):
        self.room = sum(kept)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        import regex
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        vocabulary = self.tool.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known, self.old = {}, {}
        self.whole = sorted((t.content for t in self.tool.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, self.whole)) + ")")
        self.gap = regex.compile(r"\s")
        self.rule = [(GAP, self.gap.match), (LETTER, regex.compile(r"\p{L}").match), (NUMBER, regex.compile(r"\p{N}").match)]
        self.kinds, self.lower = np.full(0x110000, UNSEEN, np.uint8), np.arange(0x110000, dtype=np.uint32)

    def encode(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def see(self, code: np.ndarray) -> None:
        """Kinds and lower case of characters seen for the first time."""
        for c in code.tolist():
            x = chr(c)
            if unicodedata.category(x) == "Cn" or len(x.lower()) > 1:
                self.kinds[c] = ODD
            else:
                self.kinds[c] = next((k for k, match in self.rule if match(x)), OTHER)
                self.lower[c] = ord(x.lower())

    def split(self, text: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Starts of the pieces of a text, the pieces in UTF-8, and which of them are words to encode as they are."""
        if text.isascii():
            raw = text.encode()
            code, low = np.frombuffer(raw, np.uint8), np.frombuffer(raw.lower(), np.uint8)
            kind = np.frombuffer(raw.translate(ASCII), np.uint8)
        else:
            code = np.frombuffer(text.encode("utf-32-le"), "<u4")
            kind = self.kinds[code]
            if (unseen := kind == UNSEEN).any():
                self.see(np.unique(code[unseen]))
                kind = self.kinds[code]
            low = self.lower[code]
        added = any(t in text for t in self.whole)
        if added or (kind == ODD).any():
            kind = kind.copy()
            for m in self.added.finditer(text) if added else ():
                kind[m.start() : m.end()] = ODD
            word = np.cumsum(kind == GAP)  # characters between two gaps share it
            hit = np.zeros(word[-1] + 1, bool)
            hit[word[kind == ODD]] = True
            kind[hit[word] & (kind != GAP)] = ODD
            low = np.where(kind == ODD, code, low)
        start = np.empty(len(kind), bool)
        start[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == NUMBER
        marks = np.flatnonzero(low == APOSTROPHE)
        marks = marks[start[marks] & (kind[marks] == OTHER)]
        for tail in ENDINGS:
            k = len(tail)
            at = marks[marks + k < len(low)]
            at = at[np.all([(low[at + 1 + j] == c) & (kind[at + 1 + j] == LETTER) for j, c in enumerate(tail)], axis=0)]
            start[at + 1] = False
            after = at[at + k + 1 < len(low)] + k + 1
            start[after] = True
        letters = kind != GAP
        start &= letters
        starts = np.flatnonzero(start)
        low, first = low[letters], np.flatnonzero(start[letters])
        if low.dtype == np.uint8:
            data, edges = low, np.append(first, len(low))
        else:
            data = low.tobytes().decode("utf-32-le").encode()
            sizes = 1 + (low >= 0x80).astype(np.int8) + (low >= 0x800) + (low >= 0x10000)
            edges = np.append(0, np.cumsum(np.add.reduceat(sizes, first, dtype=np.int64))) if len(first) else np.zeros(1, np.int64)
        buffers = [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]
        return starts, pa.Array.from_buffers(pa.large_binary(), len(starts), buffers), kind[starts] == ODD

    def learn(self, plain: list[bytes], odd: list[bytes]) -> None:
        """Put ids of new pieces into the lookup."""
        for at in range(0, len(plain), 200):
            some = plain[at : at + 200]
            ids = np.array(self.tool.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                raw, begin = ids.tobytes(), 0
                for p, stop in zip(some, (stops * 4).tolist(), strict=True):
                    self.known[p] = raw[begin:stop]
                    begin = stop
            else:
                odd = odd + some
        for p in odd:
            self.known[p] = self.encode(p.decode())

    def look(self, found: list[bytes], odd: np.ndarray) -> list[bytes]:
        """Ids of different pieces."""
        ids = list(map(self.known.get, found))
        missing = [i for i, raw in enumerate(ids) if raw is None]
        new = []
        for i in missing:
            raw = self.old.get(found[i])
            if raw is None:
                new.append(i)
            else:
                self.known[found[i]] = raw
        self.learn([found[i] for i in new if not odd[i]], [found[i] for i in new if odd[i]])
        for i in missing:
            ids[i] = self.known[found[i]]
        if len(self.known) > self.room:
            self.known, self.old = {}, self.known
        return ids

    def encode_joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are all in NFC."""
        starts, parts, odd = self.split("\n".join(texts))
        if not len(starts):
            return [b""] * len(texts)
        coded = parts.dictionary_encode()
        which = coded.indices.to_numpy()
        whole = np.zeros(len(coded.dictionary), bool)
        whole[which[odd]] = True
        ids = self.look(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), whole)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(sizes) - sizes
        sizes = sizes[which]
        ends = np.cumsum(sizes)
        take = np.repeat(begin[which] - ends + sizes, sizes)
        take += np.arange(len(take))
        raw = np.frombuffer(b"".join(ids), "<u4")[take].tobytes()
        # pieces before the end of each text, then tokens
        cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts]) - 1)
        cuts = np.append(0, ends)[cuts] * 4
        return [raw[a:b] for a, b in pairwise([0, *cuts.tolist()])]

    def compose(self, text: str) -> str:
        """The text in NFC, but for added tokens, which the tokenizer cuts out before."""
        if unicodedata.is_normalized("NFC", text):
            return text
        parts = self.added.split(text) if self.whole else [text]
        return "".join([p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(parts)])

    def cut(self, text: str):
        """Parts of a long text, which begin at white space."""
        at = 0
        while at < len(text):
            found = self.gap.search(text, at + PART)
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        out = [b"".join([self.encode_joined([self.compose(p)])[0] for p in self.cut(x)]) if len(x) > PART else b"" for x in texts]
        for ascii in (True, False):  # characters of one byte, of four
            rows = [i for i, x in enumerate(texts) if len(x) <= PART and x.isascii() == ascii]
            for i, raw in zip(rows, self.encode_joined([self.compose(texts[i]) for i in rows]), strict=True):
                out[i] = raw
        return out


def lookup(path: str, kept: tuple[int, int] = KEPT) -> Lookup:
    if (path, kept) not in _cache:
        _cache.clear()
        _cache[path, kept] = Lookup(path, kept)
    return _cache[path, kept]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", kept: tuple[int, int] = KEPT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; null texts are empty, which is one end token."""
    step = 4 * capacity
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                ids, texts = part.column(0).to_pylist(), [x or "" for x in part.column(1).to_pylist()]
                out = []
                for d, raw in zip(ids, lookup(tokenizer_path, kept).encode_many(texts), strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), step)):
                        cut = raw[at : at + step]
                        out.append((d, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(cut: DataFrame, staging: Staging, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``cut`` (doc_id, piece, length, ...).

    Sequences hold ``capacity`` at most and have no gaps. Pieces of equal
    length are exchangeable; ties go by a hash of the row, repeated rows each
    get a place. Lengths must lie in 1 .. ``capacity``. An empty table gives
    an empty result.
    """
    cut = staging.table(cut)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bins = plan_bins(histogram, capacity)
    tables = _tables(bins)
    # a rank within the length: buckets of bounded size, more of them for frequent lengths
    many = cut.sparkSession.createDataFrame([(n, -(-c // RANK_ROWS)) for n, c in histogram.items()], "length long, buckets long")
    dealt = cut.join(F.broadcast(many), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket")
    bases = sizes.withColumn("base", F.sum("n").over(before) - F.col("n")).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("place")).drop("buckets", "bucket", "place", "base")

    def run(batches):
        for batch in batches:
            n, rank = (batch.column(i).to_numpy() for i in (batch.schema.get_field_index("length"), batch.schema.get_field_index("rank")))
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            edges = np.flatnonzero(np.diff(n[order])) + 1
            for lo, hi in pairwise([0, *edges, len(n)]):
                if hi > lo:
                    rows = order[lo:hi]
                    length = int(n[rows[0]])
                    starts, first, k, at = tables[length]
                    i = np.searchsorted(starts, rank[rows], side="right") - 1
                    gone = rank[rows] - starts[i]
                    sequence[rows], offset[rows] = first[i] + gone // k[i], at[i] + gone % k[i] * length
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.drop("rank").dtypes)
    return ranked.mapInArrow(tidy(run), f"{schema}, sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, kept: tuple[int, int] = KEPT) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text; other columns are ignored) packed into sequences."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(pieces(docs, tokenizer_path, capacity, kept=kept), Staging(docs.sparkSession, "pack"), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op2_packing(spark, sf_dir):
    """All documents in sequences of 4096 tokens."""
    return best_fit(load(spark, sf_dir, "documents"))
