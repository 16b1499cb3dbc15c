"""Vectorised text kernels that run inside Arrow tasks: bytes, words, hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_U = np.uint64
# An odd 64-bit multiplier and the finaliser constants of a public-domain 64-bit mixer.
POWER = 0x9E3779B97F4A7C15
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Blocks of eight bytes that are hashed at once.
BLOCKS_AT_ONCE = 1 << 18

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64."""
    x = (x ^ (x >> _U(30))) * _U(MIX_A)
    x = (x ^ (x >> _U(27))) * _U(MIX_B)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings on end and the offsets of each (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, most: int):
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    sizes = np.cumsum(np.diff(utf8(batch.column(column))[1]))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words between white space, and the text that each is of."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    ink = ~space[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first[n] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | first[1:n]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: blocks of eight bytes, each mixed with its place, summed and mixed with the length.

    Mixing is not linear in the bytes, so that no family of texts cancels out;
    hashes of two seeds are 128 bits.
    """
    lengths = ends - starts
    out = np.zeros(len(starts), _U)
    if not len(starts):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    blocks = (lengths + 7) >> 3
    cum = np.concatenate(([0], np.cumsum(blocks)))
    key = mix(np.array([seed + 1], _U))[0]
    for low in range(0, int(cum[-1]), BLOCKS_AT_ONCE):
        high = min(low + BLOCKS_AT_ONCE, int(cum[-1]))
        first, last = np.searchsorted(cum, low, side="right") - 1, np.searchsorted(cum, high, side="left") - 1
        part = np.minimum(cum[first + 1 : last + 2], high) - np.maximum(cum[first : last + 1], low)
        owner = np.repeat(np.arange(first, last + 1), part)
        k = np.arange(low, high) - cum[owner]
        x = eights[starts[owner] + 8 * k]
        rest = lengths[owner] - 8 * k
        short = np.flatnonzero(rest < 8)
        x[short] &= (_U(1) << (rest[short].astype(_U) << _U(3))) - _U(1)
        place = k.astype(_U) * _U(POWER)
        x = mix(x ^ (place + key)) * ((place << _U(1)) | _U(1))
        sums = np.concatenate(([0], np.cumsum(part)))[:-1][part > 0]
        out[np.arange(first, last + 1)[part > 0]] += np.add.reduceat(x, sums)
    return mix(out + lengths.astype(_U) * _U(MIX_B) + key)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(at - starts, lengths)


def tidy(run):
    """``run`` over a task's batches, giving memory back at the end: workers live for many stages.

    Arrow allocates from the C library, which can be told to return what is free.
    """

    def whole(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass

    return whole
