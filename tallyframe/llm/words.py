"""Words, byte hashes and window hashes of whole Arrow text batches, in numpy.

A word is a maximal run of bytes other than space and \\x09-\\x0D, which is the
same as ``[^\\x20\\x09-\\x0D]+`` over code points.  All hashes are sums of
powers modulo 2^64, so the hash of any span is a difference of two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def string_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def nullable(column):
    """The column with a type whose nested fields may all be null, as Spark expects of what comes back."""

    def wide(kind: pa.DataType) -> pa.DataType:
        if pa.types.is_struct(kind):
            return pa.struct([pa.field(f.name, wide(f.type)) for f in kind])
        if pa.types.is_list(kind):
            return pa.list_(pa.field(kind.value_field.name, wide(kind.value_type)))
        return kind

    return column.cast(wide(column.type))


def pieces(buf: np.ndarray, off: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch between texts into (first row, last row, bytes, offsets) of about ``size`` bytes.

    A text is never cut; one longer than ``size`` is a piece of its own.
    """
    row, n = 0, len(off) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield row, last, buf[off[row]:off[last]], off[row:last + 1] - off[row]
        row = last


def text_array(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """The string column of the given bytes and offsets."""
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words; words of text i are first[i]:first[i + 1]."""
    inside = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


class Local(dict):
    """A cache that stays in its process: a copy sent along with a task arrives empty."""

    def __reduce__(self):
        return Local, ()


_POWERS = Local()


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = _POWERS[base] = np.multiply.accumulate(held)
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hasher(values: np.ndarray):
    """A function from (start, end) to the mixed hashes of those spans of ``values``."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(n, BASE), out=total[1:])
    inverse = _powers(n + 1, pow(BASE, -1, 1 << 64))

    def hashes(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((total[end] - total[start]) * inverse[start])

    return hashes


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    return span_hasher(buf.astype(np.uint64) + np.uint64(1))(start, end)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values; text borders are not looked at."""
    at = np.arange(max(0, len(hashes) - size + 1))
    return span_hasher(hashes)(at, at + size)


def within(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Whether the run of ``size`` words from each of n - size + 1 places stays in one text."""
    ok = np.ones(max(0, n - size + 1), dtype=bool)
    for back in range(1, size):
        at = first[1:-1] - back
        at = at[(at >= 0) & (at < len(ok)) & (first[1:-1] < n)]
        ok[at] = False
    return ok


def sliding(values: np.ndarray, size: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over each run of ``size`` values, by doubling."""
    if len(values) < size:
        return values[:0]
    width, out = 1, values
    while 2 * width <= size:
        out = pick(out[:len(out) - width], out[width:])
        width *= 2
    if width < size and len(out):
        rest = size - width
        out = pick(out[:len(out) - rest], out[rest:])
    return out


def kept_text(buf: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray,
              keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each text's kept words, joined by one space."""
    texts = np.repeat(np.arange(len(off) - 1), np.diff(first))
    rows = np.flatnonzero(keep)
    of = texts[rows]
    leads = np.ones(len(rows), dtype=bool)
    leads[1:] = of[1:] != of[:-1]
    out = buf.copy()
    begin = start[rows] - ~leads
    # The byte before a word that is not its text's first is white space of the same text.
    out[begin[~leads]] = 0x20
    marks = np.zeros(len(buf) + 1, np.int8)
    np.add.at(marks, begin, 1)
    np.add.at(marks, end[rows], -1)
    mask = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return out[mask], total[off]
