"""Vectorised text helpers on the UTF-8 buffers of Arrow string columns.

Texts are cut into words and hashed without a Python loop over words. A word's hash sums a random value for each pair of
place and byte, so no regular pattern of letters makes two words meet. Runs of words, which overlap, are hashed by
differences of prefix sums of a polynomial over word hashes; runs are short (well under the thousand items from which
such a polynomial has weak patterns).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: Bytes of text handled at once inside a task.
PIECE_BYTES = 1 << 21


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Random values of the bytes at the first places of a word; those of later places are computed when needed.
_PLACES = 32
_PLACE_VALUES = mix(np.arange(_PLACES << 8, dtype=np.uint64), 1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept and grown when needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=np.uint64)
        if size <= 2 * PIECE_BYTES + 2:
            _powers[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return all_bytes[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most `limit` bytes of one column each, and at least a row."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    start, rows = 0, batch.num_rows
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows, start + 20_000)
        yield batch.slice(start, stop - start)
        start = stop


def packed_pieces(batch: pa.RecordBatch, columns: list[str], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose compressed columns hold at most `limit` bytes once unpacked, and at least a row.

    A compressed text says its length; text that repeats itself can pack to a ten-thousandth of it.
    """
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        packed = batch.column(batch.schema.get_field_index(c)).to_pylist()
        sizes += np.fromiter((0 if x is None else zstandard.frame_content_size(x) for x in packed), np.int64, len(packed))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    start, rows = 0, batch.num_rows
    while start < rows:
        stop = int(np.searchsorted(upto, upto[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows, start + 20_000)
        yield batch.slice(start, stop - start)
        start = stop


def _byte_table(separators: set[int]) -> np.ndarray:
    """For each byte 0 if it separates words, else the byte with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[sorted(separators)] = 0
    return table


#: Words of ASCII letters, digits and all other alphabets: everything but ASCII signs.
ALPHANUMERIC = _byte_table({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
#: Words between the six ASCII white space characters. NUL is given the value of an unused byte.
NON_SPACE = _byte_table({0x20, *range(0x09, 0x0E)})
NON_SPACE[0] = 0xFF


def _word_hashes(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words whose bytes stand one after the other."""
    if not len(sizes):
        return np.empty(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    kind = np.int32 if len(letters) < 1 << 22 else np.int64
    at = np.arange(len(letters), dtype=kind) - np.repeat(first.astype(kind), sizes)
    at <<= 8
    at |= letters
    if len(letters) and int(sizes.max()) <= _PLACES:
        values = _PLACE_VALUES[at]
    else:
        values = _PLACE_VALUES[np.minimum(at, (_PLACES << 8) - 1)]
        late = np.flatnonzero(at >= _PLACES << 8)
        values[late] = mix(at[late].astype(np.uint64), 1)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of integers; spans may be empty and in any order."""
    sizes = ends - starts
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes > 0)
    if len(full):
        own = sizes[full]
        first = np.cumsum(own) - own
        at = (np.arange(first[-1] + own[-1]) - np.repeat(first, own)).astype(np.uint64)
        with np.errstate(over="ignore"):
            x = values[ranges(starts[full], own)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            at *= np.uint64(0xD1342543DE82EF95)
            at ^= at >> np.uint64(32)
            x ^= at
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(33)
            out[full] = np.add.reduceat(x, first)
    with np.errstate(over="ignore"):
        return mix(out + sizes.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), 3)


def distinct_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of spans that differ from each other, and for each span the place of its equal among them.

    Spans are grouped by hash and then compared value by value; one that differs from its group stands for itself.
    """
    _, first, which = np.unique(span_hashes(values, starts, ends), return_index=True, return_inverse=True)
    sizes, model = ends - starts, first[which]
    same = sizes == sizes[model]
    checked = np.flatnonzero(same & (sizes > 0) & (model != np.arange(len(model))))
    if len(checked):
        own = sizes[checked]
        differ = values[ranges(starts[checked], own)] != values[ranges(starts[model[checked]], own)]
        if differ.any():
            same[checked] = ~np.logical_or.reduceat(differ, np.cumsum(own) - own)
    alone = np.flatnonzero(~same)
    which = which.copy()
    which[alone] = len(first) + np.arange(len(alone))
    return np.concatenate([first, alone]), which


class Words:
    """Words of several texts in one buffer.

    starts, ends: byte positions; of_doc: word offsets of the texts (one more than texts); hashes: 64-bit hashes of
    the lower-cased words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALPHANUMERIC):
        n = len(data)
        b = table[data]
        inside = b != 0
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.of_doc = np.searchsorted(self.starts, offsets)
        self.hashes = _word_hashes(b[inside], self.ends - self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.of_doc)

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.of_doc) - 1), self.counts())


def sequence_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which `sequence_hashes` hashes any run of consecutive values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(_MULTIPLIER, len(values)), out=sums[1:])
    return sums


def sequence_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the runs [start, end), which depend on the order of the values and on nothing else."""
    with np.errstate(over="ignore"):
        h = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F), seed)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    if len(counts) == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) - np.repeat(ends - counts - starts, counts)


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column; offsets count items of `data`."""
    size = data.dtype.itemsize
    if len(offsets) < 2:
        return pa.array([], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * size).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
