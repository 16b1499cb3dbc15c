"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

A word's context is the word before it, that of a text's first word the text
end. Every context has a restaurant of words; all share one parent, the
restaurant of words without context, whose dishes come from a spelling model:
bytes in restaurants of their last two bytes, which share the restaurants of
the last byte as parents, these the restaurant without context, and that a
uniform distribution. A table of a restaurant is a customer of its parent.
Seating is sampled by Gibbs sweeps: the customers of a dish are seated anew,
one by one, each by the Chinese-restaurant probabilities given all other
dishes' tables; the predictive probabilities of the sweeps after the burn-in
are averaged.

The work is a few exchanges of packed messages between three kinds of places.
A block holds the tokens of some megabytes of documents, a range the words
whose hashes start alike, a bucket the word pairs whose numbers hash alike. A
place is a group of rows that Spark brings together; it never holds more than
one message of each sender, and a message carries at least one word or pair, so
that frequent words and pairs weigh as much as rare ones. Numbers of places grow
with the text, their sizes do not. The spelling model has at most 258 * 258
contexts of 257 symbols, whatever the input; nothing else is collected or
broadcast.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, load
from .kernels import LOWER, mix, ragged, slices, span_hashes, tidy, utf8, words
from .language import held_out

_U = np.uint64
#: Symbols of a spelling: bytes and the end of a word. Contexts have the start of a word besides.
END, START, SYMBOLS, CONTEXTS = 256, 257, 257, 258
#: Strength of all restaurants, discount where counts say nothing, sweeps and those that are not averaged.
STRENGTH, DISCOUNT, SWEEPS, BURN_IN = 1.0, 0.5, 4, 1
#: Bytes of text in a block, if its documents are not longer, and for which there is a range and a bucket.
BLOCK_BYTES = 8_000_000
#: Of additive smoothing, that the base score uses.
ADDED = 0.1
#: Places and kinds of messages.
BLOCK, RANGE, BUCKET = 0, 1, 2
TEXTS, ASKED, WORDS, ANSWER, WANTED, PAIRS, SEEN, SINGLES, TABLES, TOLD, SAMPLE = range(11)
#: Steps of log10 in which blocks are told probabilities.
FINE = 1 << 14
MESSAGE = "place int, to long, kind int, sender long, n array<long>, x array<binary>"


def uniforms(seed: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the seeds and the step only."""
    x = mix(seed + _U(step * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
    return ((x >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def seat(c: np.ndarray, p: np.ndarray, others: np.ndarray, discount: float, strength: float, seed: np.ndarray) -> np.ndarray:
    """Tables of each dish after its ``c`` customers were seated.

    p: the dish's probability in the parent; others: tables of the restaurant's
    other dishes. Customers come one by one at first, then in groups of a
    sixteenth of those seated, which see the same probabilities.
    """
    t = np.minimum(c, 1).astype(np.int64)
    left, n, step = np.flatnonzero(c > 1), 1, 0
    while len(left):
        group = np.minimum(max(1, n // 16), c[left] - n)
        fresh = (strength + discount * (others[left] + t[left])) * p[left]
        chance = fresh / (fresh + n - discount * t[left])
        t[left] += np.minimum(group, np.floor(group * chance + uniforms(seed[left], step)).astype(np.int64))
        n, step = n + max(1, n // 16), step + 1
        left = left[c[left] > n]
    return t


def discount_of(c: np.ndarray) -> float:
    """From the numbers of dishes served once and twice."""
    one, two = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
    return float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one and two else DISCOUNT


@dataclass
class Spelling:
    """log10 probabilities of symbols: a row for each context seen, by number, then one for each last byte."""

    row: np.ndarray
    table: np.ndarray

    def log10(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 probability of each byte span as a whole word."""
        symbol, context, owner = symbols(data, starts, ends)
        return np.bincount(owner, weights=self.table[self.row[context], symbol], minlength=len(starts))


def symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, context, word) of all spelling steps of the byte spans."""
    n = ends - starts
    last = np.cumsum(n + 1) - 1
    first = last - n
    total = int(last[-1]) + 1 if len(last) else 0
    symbol = np.full(total, END, np.int64)
    inner = np.ones(total, bool)
    inner[last] = False
    symbol[inner] = data[ragged(starts, n)]
    one = np.concatenate(([START], symbol[:-1]))[:total]
    one[first] = START
    two = np.concatenate(([START], one[:-1]))[:total]
    two[first] = START
    return symbol, two * CONTEXTS + one, np.repeat(np.arange(len(n)), n + 1)


def sample_spelling(cell: np.ndarray, count: np.ndarray, tables: list | None, seed: int, rounds: int = 3) -> tuple[Spelling, list]:
    """One more sample of the spelling restaurants; cell: context * SYMBOLS + symbol, ascending.

    tables: those of the last sample by cell and depth, or None at first.
    """
    context, symbol = cell // SYMBOLS, cell % SYMBOLS
    last = context % CONTEXTS
    cell1, up1 = np.unique(last * SYMBOLS + symbol, return_inverse=True)
    cell0, up0 = np.unique(cell1 % SYMBOLS, return_inverse=True)
    contexts, owner2 = np.unique(context, return_inverse=True)
    lasts, owner1 = np.unique(cell1 // SYMBOLS, return_inverse=True)
    t2, t1, t0 = tables or (np.minimum(count, 1), np.ones(len(cell1), np.int64), np.ones(len(cell0), np.int64))
    owner0 = np.zeros(len(cell0), np.int64)
    uniform = np.full(SYMBOLS, 1 / SYMBOLS)

    def predict(c, t, owner, groups, column, parent, d):
        """Dense rows of one depth: parent (groups, SYMBOLS) are the rows that it falls back to."""
        total, tabled = np.bincount(owner, weights=c, minlength=groups), np.bincount(owner, weights=t, minlength=groups)
        dense = ((STRENGTH + d * tabled) / (STRENGTH + total))[:, None] * parent
        np.add.at(dense, (owner, column), (c - d * t) / (STRENGTH + total)[owner])
        return dense

    def others(t, owner, groups):
        return np.bincount(owner, weights=t, minlength=groups)[owner] - t

    for r in range(rounds):
        c1 = np.bincount(up1, weights=t2, minlength=len(cell1)).astype(np.int64)
        c0 = np.bincount(up0, weights=t1, minlength=len(cell0)).astype(np.int64)
        d2, d1, d0 = discount_of(count), discount_of(c1), discount_of(c0)
        p0 = predict(c0, t0, owner0, 1, cell0, uniform[None], d0)
        p1 = predict(c1, t1, owner1, len(lasts), cell1 % SYMBOLS, np.repeat(p0, len(lasts), 0), d1)
        mark = mix(cell.astype(_U) + _U(seed * 64 + r * 8))
        t2 = seat(count, p1[np.searchsorted(lasts, last), symbol], others(t2, owner2, len(contexts)), d2, STRENGTH, mark)
        c1 = np.bincount(up1, weights=t2, minlength=len(cell1)).astype(np.int64)
        t1 = seat(c1, p0[0, cell1 % SYMBOLS], others(t1, owner1, len(lasts)), d1, STRENGTH, mix(cell1.astype(_U) + _U(seed * 64 + r * 8 + 1)))
        c0 = np.bincount(up0, weights=t1, minlength=len(cell0)).astype(np.int64)
        t0 = seat(c0, uniform[cell0], others(t0, owner0, 1), d0, STRENGTH, mix(cell0.astype(_U) + _U(seed * 64 + r * 8 + 2)))
    p0 = predict(c0, t0, owner0, 1, cell0, uniform[None], d0)
    p1 = np.repeat(p0, CONTEXTS, 0)
    p1[lasts] = predict(c1, t1, owner1, len(lasts), cell1 % SYMBOLS, np.repeat(p0, len(lasts), 0), d1)
    p2 = predict(count, t2, owner2, len(contexts), symbol, p1[contexts % CONTEXTS], d2)
    row = len(contexts) + np.arange(CONTEXTS * CONTEXTS) % CONTEXTS
    row[contexts] = np.arange(len(contexts))
    return Spelling(row.astype(np.int32), np.log10(np.concatenate((p2, p1))).astype(np.float32)), [t2, t1, t0]


def put(x: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers, of ``rising`` ones the steps, byte by byte and compressed."""
    x = np.asarray(x).astype(_U)
    if not len(x):
        return b""
    if rising:
        x[1:] -= x[:-1].copy()
    k = max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T)
    return bytes([k]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def get(raw: bytes, rising: bool = False) -> np.ndarray:
    """The numbers (uint64) that ``put`` packed."""
    if not raw:
        return np.zeros(0, _U)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    x = np.zeros((planes.shape[1], 8), np.uint8)
    x[:, : raw[0]] = planes.T
    x = x.view("<u8").reshape(-1)
    return np.cumsum(x, dtype=_U) if rising else x


def put_real(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.asarray(x, np.float32).tobytes())


def get_real(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.float32).astype(np.float64)


def put_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Byte spans: their lengths and their bytes."""
    return [put(ends - starts), zstandard.ZstdCompressor(level=1).compress(data[ragged(starts, ends - starts)].tobytes())]


def get_bytes(lengths: bytes, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes on end and their offsets."""
    edges = np.concatenate(([0], np.cumsum(get(lengths).astype(np.int64))))
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), edges


def messages(rows: list[tuple]) -> pa.Table:
    """Rows (place, to, kind, sender, numbers, packed) as a table."""
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()))
    names = ("place", "to", "kind", "sender", "n", "x")
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=list(names))


def inbox(table: pa.Table) -> dict[int, list[tuple]]:
    """Messages by kind, those of a kind by sender: (sender, numbers, packed)."""
    out: dict[int, list[tuple]] = {}
    rows = zip(*(table.column(c).to_pylist() for c in ("kind", "sender", "n", "x")), strict=True)
    for kind, sender, n, x in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(kind, []).append((sender, n, x))
    return out


def joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the runs of equal values in ``x``."""
    if not len(x):
        return []
    edges = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]))
    return list(zip(x[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))


@dataclass(frozen=True)
class Layout:
    """How words and pairs are numbered: a word is its place in its range times the ranges, plus the range."""

    bits: int
    buckets: int
    span: int = 0  # above every word's number

    def range_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def by_range(self, words: np.ndarray) -> np.ndarray:
        """Order of word numbers by range, then place."""
        return np.lexsort((words >> self.bits, words & ((1 << self.bits) - 1)))

    def bucket_of(self, pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs.astype(_U)) % _U(self.buckets)).astype(np.int64)


def read(docs: DataFrame, layout: Layout) -> DataFrame:
    """A block's tokens, and what it asks of the words' ranges, from ``docs`` (doc, held, t)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2, BLOCK_BYTES):
                block, rows = uuid.uuid4().int >> 65, []
                data, offsets = utf8(part.column(2))
                data = LOWER[data]
                starts, ends, text = words(data, offsets)
                # the end follows the words of its text
                order = np.argsort(np.concatenate((text, np.arange(part.num_rows))), kind="stable")
                starts, ends = np.concatenate((starts, offsets[1:]))[order], np.concatenate((ends, offsets[1:]))[order]
                text = np.concatenate((text, np.arange(part.num_rows)))[order]
                h = span_hashes(data, starts, ends) if len(data) else np.zeros(len(starts), _U)
                h[starts == ends] = 0
                h, first, number, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(-count, kind="stable")  # small numbers for frequent words; ties by hash
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                held = np.array(part.column(1))
                taught = np.bincount(number[~held[text]], minlength=len(h))
                sizes = np.bincount(text, minlength=part.num_rows)
                new = first[taught == 0]
                packed = [put(rank[number]), put(count), put(sizes * 2 + held), *put_bytes(data, starts[new], ends[new]), put(np.flatnonzero(taught == 0), True)]
                rows.append((BLOCK, block, TEXTS, block, part.column(0).to_pylist(), packed))
                for q, lo, hi in runs(layout.range_of(h)):
                    some = first[lo:hi][taught[lo:hi] > 0]
                    rows.append((RANGE, q, ASKED, block, [], [put(h[lo:hi], True), put(taught[lo:hi]), *put_bytes(data, starts[some], ends[some])]))
                yield from messages(rows).to_batches()

    return docs.mapInArrow(tidy(run), MESSAGE)


def meet(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exchange(df: DataFrame, step, schema: str = MESSAGE) -> DataFrame:
    """``step`` at every place of ``df``: its messages in, others out."""
    return df.groupBy("place", "to").applyInArrow(step, schema)


def number_words(table: pa.Table) -> pa.Table:
    """A range counts its words and tells each block the counts and places of those asked for; words never taught have none."""
    asked, at = inbox(table)[ASKED], table.column("to")[0].as_py()
    h, n = [get(x[0], True) for _, _, x in asked], [get(x[1]).astype(np.int64) for _, _, x in asked]
    distinct, where = np.unique(joined(h, _U), return_inverse=True)
    count = np.bincount(where, joined(n), len(distinct)).astype(np.int64)
    known = count > 0
    place = np.cumsum(known) - 1
    spelled = [get_bytes(x[2], x[3]) for _, _, x in asked]
    shift = np.cumsum([0, *[len(d) for d, _ in spelled]])
    data = joined([d for d, _ in spelled], np.uint8)
    starts, ends = (joined([(e[:-1] if k == 0 else e[1:]) + s for (_, e), s in zip(spelled, shift, strict=False)]) for k in (0, 1))
    _, first = np.unique(where[joined(n) > 0], return_index=True)
    none = put(np.zeros(known.sum(), np.int64))
    rows = [(RANGE, at, WORDS, at, [int(known.sum()), 0, 0, 0, 0], [put(count[known]), *put_bytes(data, starts[first], ends[first]), none, none, none, none, put(np.ones(known.sum(), np.int64))])]
    cut = np.cumsum([0, *[len(x) for x in h]])
    for (sender, _, _), lo, hi in zip(asked, cut, cut[1:], strict=False):
        mine = where[lo:hi]
        rows.append((BLOCK, sender, ANSWER, at, [], [put(count[mine]), put(place[mine][known[mine]], True)]))
    return messages(rows)


class View:
    """A block's tokens with the numbers of their words and contexts, and its distinct pairs in the buckets' order."""

    def __init__(self, box: dict, layout: Layout):
        (_, self.docs, x), = box[TEXTS]
        answers = box.get(ANSWER, [])
        self.count = joined([get(a[0]).astype(np.int64) for _, _, a in answers])  # by hash
        places = [(get(a[1], True).astype(np.int64) << layout.bits) | q for q, _, a in answers]
        word = np.full(len(self.count), -1)
        word[self.count > 0] = joined(places)
        self.hashed = np.argsort(-get(x[1]).astype(np.int64), kind="stable")  # of a number its place by hash
        self.word = word[self.hashed]
        self.number = get(x[0]).astype(np.int64)
        both = get(x[2]).astype(np.int64)
        self.sizes, self.held = both >> 1, (both & 1).astype(bool)
        self.owner = np.repeat(np.arange(len(both)), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        self.before = np.concatenate(([0], self.number[:-1]))
        self.before[first] = int(np.flatnonzero(self.hashed == 0)[0])  # the end, whose hash is least
        self.new, self.untaught = (x[3], x[4]), get(x[5], True).astype(np.int64)
        w, u = self.word[self.number], self.word[self.before]
        self.known = (w >= 0) & (u >= 0)
        pair, where = np.unique(u[self.known] * layout.span + w[self.known], return_inverse=True)
        bucket = layout.bucket_of(pair)
        order = np.argsort(bucket, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.pair, self.bucket, self.where = pair[order], bucket[order], back[where]


def ask_pairs(layout: Layout):
    """A block sends its pairs to the buckets, and the ranges what words it will want to hear of."""

    def step(table: pa.Table) -> pa.Table:
        view, block = View(inbox(table), layout), table.column("to")[0].as_py()
        taught = np.bincount(view.where[~view.held[view.owner][view.known]], minlength=len(view.pair))
        rows = [(BUCKET, b, ASKED, block, [], [put(view.pair[lo:hi], True), put(taught[lo:hi])]) for b, lo, hi in runs(view.bucket)]
        mine = view.word[view.word >= 0]
        mine = mine[layout.by_range(mine)]
        rows += [(RANGE, q, WANTED, block, [], [put(mine[lo:hi] >> layout.bits, True)]) for q, lo, hi in runs(mine & ((1 << layout.bits) - 1))]
        return messages(rows)

    return step


def tables_of(pair: np.ndarray, t: np.ndarray, layout: Layout, kind: int, sender: int) -> list[tuple]:
    """What a bucket tells the ranges of its pairs' tables: by word, those of its own restaurant and those that serve it."""
    word, where = np.unique(np.concatenate((pair // layout.span, pair % layout.span)), return_inverse=True)
    own = np.bincount(where[: len(pair)], t, len(word)).astype(np.int64)
    served = np.bincount(where[len(pair) :], t, len(word)).astype(np.int64)
    order = layout.by_range(word)
    word, own, served = word[order], own[order], served[order]
    return [(RANGE, q, kind, sender, [], [put(word[lo:hi] >> layout.bits, True), put(own[lo:hi]), put(served[lo:hi])]) for q, lo, hi in runs(word & ((1 << layout.bits) - 1))]


def count_pairs(layout: Layout):
    """A bucket counts its pairs. Pairs seen once have one table for good; of the others each has one at first."""

    def step(table: pa.Table) -> pa.Table:
        if table.column("place")[0].as_py() == RANGE:
            return table
        asked, at = inbox(table)[ASKED], table.column("to")[0].as_py()
        each = [get(x[0], True).astype(np.int64) for _, _, x in asked]
        pair, where = np.unique(joined(each), return_inverse=True)
        count = np.bincount(where, joined([get(x[1]).astype(np.int64) for _, _, x in asked]), len(pair)).astype(np.int64)
        several = count >= 2
        place = np.cumsum(several) - 1
        n = int(several.sum())
        rows = [(BUCKET, at, PAIRS, at, [int((count == 1).sum()), int((count == 2).sum())], [put(pair[several], True), put(count[several]), put(np.ones(n, np.int64)), put(np.zeros(n, np.int64))])]
        cut = np.cumsum([0, *[len(x) for x in each]])
        for (sender, _, _), lo, hi in zip(asked, cut, cut[1:], strict=False):
            mine = where[lo:hi]
            rows.append((BUCKET, at, SEEN, sender, [], [put(np.minimum(count[mine], 2)), put(place[mine][several[mine]], True)]))
        one = pair[count == 1]
        rows += tables_of(one, np.ones(len(one)), layout, SINGLES, at) + tables_of(pair[several], np.ones(n), layout, TABLES, at)
        return messages(rows)

    return step


@dataclass
class Totals:
    """Customers and tables of the restaurant without context, discounts of it and of the contexts."""

    customers: int
    tables: int
    discount: float
    pairs: float

    def share(self) -> float:
        """Of the spelling model."""
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)

    def word(self, served: np.ndarray, t: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Probability of words without context."""
        return (served - self.discount * t) / (STRENGTH + self.customers) + self.share() * spelled

    def backed(self, own: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Share of the restaurant without context in contexts with ``own`` tables and ``count`` customers."""
        return (STRENGTH + self.pairs * own) / (STRENGTH + count)


class Words:
    """State of a range: counts, spellings, tables of pairs seen once and more often, own tables."""

    def __init__(self, box: dict):
        (_, self.n, self.x), = box[WORDS]
        self.count = get(self.x[0]).astype(np.int64)
        self.once, self.once_served, self.own, self.served, self.t = (get(r).astype(np.int64) for r in self.x[3:8])

    def spelled(self, spelling: Spelling) -> np.ndarray:
        data, edges = get_bytes(*self.x[1:3])
        return 10.0 ** spelling.log10(data, edges[:-1], edges[1:])

    def row(self, at: int) -> tuple:
        served = self.once_served + self.served
        n = [len(self.count), int(served.sum()), int(self.t.sum()), int((served == 1).sum()), int((served == 2).sum())]
        return (RANGE, at, WORDS, at, n, [*self.x[:3], *map(put, (self.once, self.once_served, self.own, self.served, self.t))])


def seat_words(totals: Totals | None, spelling: Spelling | None, sweep: int, keep: bool):
    """A range takes up the pairs' tables and seats them, its words' customers; at first (no ``totals``) one table a word."""

    def step(table: pa.Table) -> pa.Table:
        box, at = inbox(table), table.column("to")[0].as_py()
        w = Words(box)
        for kind, names in ((SINGLES, ("once", "once_served")), (TABLES, ("own", "served"))):
            if kind in box:
                place = joined([get(x[0], True).astype(np.int64) for _, _, x in box[kind]])
                for k, name in enumerate(names, 1):
                    setattr(w, name, np.bincount(place, joined([get(x[k]).astype(np.int64) for _, _, x in box[kind]]), len(w.count)).astype(np.int64))
        rows = []
        if totals is not None:
            data, edges = get_bytes(*w.x[1:3])
            spelled = w.spelled(spelling)
            served = w.once_served + w.served
            w.t = seat(served, spelled, np.maximum(totals.tables - w.t, 0), totals.discount, STRENGTH, span_hashes(data, edges[:-1], edges[1:]) + _U(sweep))
            if keep:
                rows.append((RANGE, at, SAMPLE, sweep, [], [put(w.once + w.own), put(served), put(w.t), put_real(spelled)]))
        return messages([w.row(at), *rows])

    return step


def tell_buckets(totals: Totals, spelling: Spelling):
    """A range tells buckets the probabilities of their pairs' words, and the tables of these words' restaurants."""

    def step(table: pa.Table) -> pa.Table:
        box, at = inbox(table), table.column("to")[0].as_py()
        if TABLES not in box:
            return messages([])
        w = Words(box)
        p, own = totals.word(w.once_served + w.served, w.t, w.spelled(spelling)), w.once + w.own
        rows = []
        for sender, _, x in box[TABLES]:
            place = get(x[0], True).astype(np.int64)
            rows.append((BUCKET, sender, TOLD, at, [], [put_real(p[place]), put(own[place])]))
        return messages(rows)

    return step


def seat_pairs(layout: Layout, totals: Totals, sweep: int, keep: bool):
    """A bucket seats the customers of its pairs, given the words' probabilities and the other tables of the contexts."""

    def step(table: pa.Table) -> pa.Table:
        box, at = inbox(table), table.column("to")[0].as_py()
        (_, n, x), = box[PAIRS]
        pair, count, t, total = get(x[0], True).astype(np.int64), *(get(r).astype(np.int64) for r in x[1:4])
        word = np.unique(np.concatenate((pair // layout.span, pair % layout.span)))
        order = layout.by_range(word)
        p, own = np.zeros(len(word)), np.zeros(len(word), np.int64)
        p[order] = joined([get_real(r[0]) for _, _, r in box.get(TOLD, [])], np.float64)
        own[order] = joined([get(r[1]).astype(np.int64) for _, _, r in box.get(TOLD, [])])
        u, w = np.searchsorted(word, pair // layout.span), np.searchsorted(word, pair % layout.span)
        t = seat(count, p[w], own[u] - t, totals.pairs, STRENGTH, mix(pair.astype(_U)) + _U(sweep))
        rows = [(BUCKET, at, PAIRS, at, n, [x[0], x[1], put(t), put(total + t if keep else total)])]
        return messages(rows + tables_of(pair, t, layout, TABLES, at))

    return step


def tell_blocks(samples: list[Totals]):
    """A range tells blocks, for every sample, their words' probabilities and the tables of these words' restaurants."""

    def step(table: pa.Table) -> pa.Table:
        box, at = inbox(table), table.column("to")[0].as_py()
        if WANTED not in box:
            return messages([])
        values = []
        for (_, _, x), totals in zip(box[SAMPLE], samples, strict=True):
            own, served, t = (get(r).astype(np.int64) for r in x[:3])
            values += [np.rint(-np.log10(totals.word(served, t, get_real(x[3]))) * FINE), own]
        return messages([(BLOCK, sender, WORDS, at, [], [put(v[get(x[0], True).astype(np.int64)]) for v in values]) for sender, _, x in box[WANTED]])

    return step


def tell_pairs(samples: int):
    """A bucket tells blocks their pairs' counts and mean tables."""

    def step(table: pa.Table) -> pa.Table:
        box, at = inbox(table), table.column("to")[0].as_py()
        (_, _, x), = box[PAIRS]
        several, mean = get(x[1]).astype(np.int64), get(x[3]).astype(np.int64) / max(samples, 1)
        rows = []
        for sender, _, r in box[SEEN]:
            count, place = get(r[0]).astype(np.int64), get(r[1], True).astype(np.int64)
            tables = np.minimum(count, 1).astype(np.float64)
            tables[count == 2], count[count == 2] = mean[place], several[place]
            rows.append((BLOCK, sender, PAIRS, at, [], [put(count), put_real(tables)]))
        return messages(rows)

    return step


def score_block(layout: Layout, samples: list[tuple[Totals, Spelling]], total: int, distinct: int):
    """Scores of a block's documents."""

    def step(table: pa.Table) -> pa.Table:
        box = inbox(table)
        view = View(box, layout)
        w, u = view.number, view.before
        count = view.count[view.hashed]
        known = view.word >= 0
        order = np.flatnonzero(known)
        order = order[layout.by_range(view.word[order])]
        p, back = np.zeros((len(samples), len(known))), np.ones((len(samples), len(known)))
        for s in range(len(samples)):
            told = [joined([get(x[2 * s + k]) for _, _, x in box.get(WORDS, [])], _U).astype(np.float64) for k in (0, 1)]
            p[s, order], back[s, order] = 10.0 ** (-told[0] / FINE), samples[s][0].backed(told[1], count[order])
        value = np.zeros(len(w))
        for s in range(len(samples)):
            value += back[s, u] * p[s, w] / len(samples)
        seen = joined([get(x[0]).astype(np.int64) for _, _, x in box.get(PAIRS, [])])
        tables = joined([get_real(x[1]) for _, _, x in box.get(PAIRS, [])], np.float64)
        here = np.flatnonzero(view.known)
        value[here] += (seen - samples[0][0].pairs * tables)[view.where] / (STRENGTH + count[u[here]])
        # words never taught stay in logarithms: their spellings may be of any length
        new = np.flatnonzero(~known)
        logs = np.zeros(len(w))
        logs[known[w]] = np.log10(value[known[w]])
        if len(new):
            data, edges = get_bytes(*view.new)
            at = np.searchsorted(view.untaught, view.hashed[new])
            some = np.flatnonzero(~known[w])
            spot = np.searchsorted(new, w[some])
            each = [np.log10(back[s, u[some]]) + np.log10(t.share()) + sp.log10(data, edges[:-1][at], edges[1:][at])[spot] for s, (t, sp) in enumerate(samples)]
            logs[some] = np.logaddexp.reduce(np.stack(each) * np.log(10), axis=0) / np.log(10) - np.log10(len(samples))
        plain = np.log10((count + ADDED) / (total + ADDED * (distinct + 1)))
        sums = [np.bincount(view.owner, x, len(view.sizes)) for x in ((count > 0)[w].astype(float), plain[w], logs)]
        return pa.table(
            {
                "doc_id": pa.array(view.docs, pa.int64()), "held_out": view.held, "n_tokens": view.sizes, "n_known": sums[0].astype(np.int64), "train_tokens": np.full(len(view.sizes), total, np.int64),
                "base_score": sums[1], "score": sums[2], "perplexity": 10.0 ** np.minimum(-sums[2] / view.sizes, 300),
            }
        )

    return step


def spelling_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Customers of the spelling cells: every table of a word in ``words`` (the ranges' states). At most 258 * 258 * 257 cells."""

    def run(batches):
        held, n = {}, 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                data, edges = get_bytes(x[1], x[2])
                symbol, context, owner = symbols(data, edges[:-1], edges[1:])
                cell, where = np.unique(context * SYMBOLS + symbol, return_inverse=True)
                count = np.bincount(where, get(x[7]).astype(np.int64)[owner], len(cell))
                for k, v in zip(cell.tolist(), count.tolist(), strict=True):
                    held[k] = held.get(k, 0) + v
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([int(v) for v in held.values()], pa.int64())], ["cell", "n"])

    found = words.select("x").mapInArrow(tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, count = found.column("cell").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(cell)
    return cell[order], count[order]


def score(docs: DataFrame, held: str = "held_out", text: str = "text", doc_id: str = "doc_id", sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one row a row of ``docs``.

    Learns from the texts of the rows whose boolean column ``held`` is not true.
    Tokens are the words between ASCII white space with A-Z in lower case, then
    one end; words are told apart by 64 bits. Null texts are empty: an end
    alone. Without training rows every probability comes from the spelling
    model's uniform base. Repeated rows count and are scored one by one; rows
    of one id, and of none, are rows of their own. Other columns are ignored;
    an empty table gives an empty result.
    """
    if not 0 <= burn_in < sweeps:
        raise ValueError("burn_in must lie in 0 .. sweeps - 1")
    spark = docs.sparkSession
    staging = Staging(spark, "scoring")
    base = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(held), F.lit(False)).alias("held"), F.col(text).alias("t"))
    size = base.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    places = -(-size // BLOCK_BYTES)
    layout = Layout(max(0, int(places - 1).bit_length()) if places else 0, max(1, places))
    first = staging.table(read(base, layout), by="place")
    blocks = first.where(F.col("place") == BLOCK)
    answers = staging.table(exchange(first.where(F.col("place") == RANGE), number_words))
    staging.drop_part(first, "place", RANGE)
    state, answers = answers.where(F.col("place") == RANGE), answers.where(F.col("place") == BLOCK)
    widest, distinct = state.agg(F.max(F.col("n")[0]), F.sum(F.col("n")[0])).first()
    layout = Layout(layout.bits, layout.buckets, max(1, widest or 0) << layout.bits)
    counted = staging.table(exchange(exchange(meet(blocks, answers), ask_pairs(layout)), count_pairs(layout)))
    of = lambda df, place, kind: df.where((F.col("place") == place) & (F.col("kind") == kind))
    pairs, seen = of(counted, BUCKET, PAIRS), of(counted, BUCKET, SEEN)
    wanted, tables, once = (of(counted, RANGE, k) for k in (WANTED, TABLES, SINGLES))
    ones, twos = pairs.agg(F.sum(F.col("n")[0]), F.sum(F.col("n")[1])).first()
    share = lambda one, two: float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one and two else DISCOUNT
    of_pairs = share(ones or 0, twos or 0)
    total = int(sum(r["c"] or 0 for r in state.select("x").mapInArrow(tidy(_sum_counts), "c long").collect()))  # a number a task

    def totals(words: DataFrame) -> Totals:
        customers, seated, one, two = (v or 0 for v in words.agg(*[F.sum(F.col("n")[k]) for k in range(1, 5)]).first())
        return Totals(customers, seated, share(one, two), of_pairs)

    state = staging.table(exchange(meet(state, once, tables), seat_words(None, None, 0, False)))
    staging.settle()
    now, seats, samples, drawn, old = totals(state), None, [], [], []
    for sweep in range(sweeps):
        keep = sweep >= burn_in
        cell, count = spelling_counts(state)
        spelling, seats = sample_spelling(cell, count, seats if seats and len(seats[0]) == len(cell) else None, sweep)
        told = exchange(meet(state, tables), tell_buckets(now, spelling))
        seated = staging.table(exchange(meet(told, pairs), seat_pairs(layout, now, sweep, keep)))
        pairs, tables = of(seated, BUCKET, PAIRS), of(seated, RANGE, TABLES)
        whole = staging.table(exchange(meet(state, tables), seat_words(now, spelling, sweep, keep)), by="kind")
        state = whole.where(F.col("kind") == WORDS)
        now = totals(state)
        if keep:
            samples.append((now, spelling))
            drawn.append(whole.where(F.col("kind") == SAMPLE))
        for table in old:
            table()
        old = [lambda t=seated: staging.drop(t), lambda t=whole: staging.drop_part(t, "kind", WORDS)]
        staging.settle()
    words_told = exchange(meet(*drawn, wanted), tell_blocks([t for t, _ in samples]))
    pairs_told = exchange(meet(pairs, seen), tell_pairs(len(samples)))
    return exchange(
        meet(blocks, answers, words_told, pairs_told), score_block(layout, samples, total, distinct or 0),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double",
    )


def _sum_counts(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(sum(int(get(x[0]).sum()) for x in batch.column(0).to_pylist()))], pa.int64())], ["c"])


def op8_scoring(spark, sf_dir):
    """Scores of all documents under a model of nine tenths of them."""
    return score(load(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 10, 0).alias("held_out")))
