"""Vectorised text primitives shared by the corpus operators.

Texts arrive as Arrow columns. Everything here works on one flat byte array for a
bounded run of documents (``chunks``), so that the memory of a task depends on
``CHUNK_BYTES`` and on the longest single text, never on the size of a partition.

64-bit fingerprints absorb eight bytes at a time, with an avalanche mix between, so no
structure of a text makes them collide; up to seven bytes they are one-to-one. They choose
candidates. Where equal strings are taken as one (``groups``), their bytes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1_000_000
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each (for the substrings of
    a word that are no longer than a vocabulary's pieces)."""
    if len(_powers[0]) < n:
        size = max(n, 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_runs(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes (a longer row is alone)."""
    at, n = 0, len(off) - 1
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) for runs of rows of a batch."""
    buf, off = text_buffers(batch.column(batch.schema.get_field_index(name)))
    for a, b in row_runs(off, limit):
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes that stay in a row."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = off[(off > 0) & (off < n)]
    starts = member.copy()
    starts[1:] &= ~member[:-1]
    starts[edge] = member[edge]
    ends = np.empty(n + 1, bool)
    ends[0] = False
    ends[1:] = member
    ends[1:n] &= ~member[1:]
    ends[edge] = member[edge - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends)


#: Spans longer than this are hashed one by one.
LONG_SPAN = 256
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one word; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of buf[starts:ends], equal for equal strings."""
    size, word = ends - starts, words_at(buf)
    h = mix((word[starts] & _MASK[np.minimum(size, 8)]) ^ (size.astype(U64) << U64(57)))
    rest, k = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(rest):
        left = size[rest] - k
        h[rest] = mix(h[rest] * U64(0xA24BAED4963EE407) + (word[starts[rest] + k] & _MASK[np.minimum(left, 8)]))
        rest, k = rest[left > 8], k + 8
    for r in np.flatnonzero(size > LONG_SPAN).tolist():
        h[r] = xxhash.xxh3_64_intdigest(buf[starts[r] : ends[r]].tobytes())
    return h


def same_spans(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether left[a : a + size] and right[b : b + size] are the same bytes."""
    out, x, y = np.ones(len(size), bool), words_at(left), words_at(right)
    rest, k = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(rest):
        mask = _MASK[np.minimum(size[rest] - k, 8)]
        same = (x[a[rest] + k] & mask) == (y[b[rest] + k] & mask)
        out[rest[~same]] = False
        rest, k = rest[same & (size[rest] > k + 8)], k + 8
    for r in np.flatnonzero(size > LONG_SPAN).tolist():
        out[r] = np.array_equal(left[a[r] : a[r] + size[r]], right[b[r] : b[r] + size[r]])
    return out


def groups(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct string, group of each span), exactly:
    what the fingerprints join is compared byte by byte."""
    first, group = unique(span_hashes(buf, starts, ends))
    of, size = first[group], ends - starts
    # strings of up to seven bytes have fingerprints of their own
    check = np.flatnonzero((of != np.arange(len(of))) & ((size > 7) | (size[of] > 7)))
    if (size[check] == size[of[check]]).all() and same_spans(buf, starts[check], buf, starts[of[check]], size[check]).all():
        return first, group
    raw, number = buf.tobytes(), {}
    group = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return np.unique(group, return_index=True)[1], group


def unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct value, group of each value)."""
    n = len(h)
    bits = max(1, int(n - 1).bit_length()) if n else 1
    low = U64((1 << bits) - 1)
    # sorting plain words is several times as fast as sorting an index
    packed = np.sort((h & ~low) | np.arange(n, dtype=U64))
    order = (packed & low).astype(np.int64)
    sorted_h = h[order]
    new = np.ones(n, bool)
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    prefix = np.zeros(n, bool)
    prefix[1:] = ((packed[1:] ^ packed[:-1]) & ~low) == 0
    if (new & prefix).any():  # two values share the sorted prefix
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        new[1:] = sorted_h[1:] != sorted_h[:-1]
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out_at = np.cumsum(lengths) - lengths
    return np.repeat(starts - out_at, lengths) + np.arange(total)


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width], for every i for which that is inside."""
    out, have = x, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = op(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1])
    return out[: max(0, len(x) - width + 1)]


def byte_grams(buf: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all byte strings of a length that is a multiple of 8."""
    n = len(buf)
    if n < length:
        return np.zeros(0, U64)
    word = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(buf), strides=(1,))
    count = n - length + 1
    out = np.zeros(count, U64)
    for k in range(0, length, 8):
        out ^= word[k : k + count]
        out *= U64(0xA24BAED4963EE407)
        out ^= out >> U64(29)
    out *= U64(0xBF58476D1CE4E5B9)
    out ^= out >> U64(32)
    return out


def unit_grams(units: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all runs of ``length`` unit hashes."""
    count = len(units) - length + 1
    if count <= 0:
        return np.zeros(0, U64)
    out = units[:count].copy()
    for k in range(1, length):
        out = out * U64(0xA24BAED4963EE407) + units[k : k + count]
    return mix(out)


_ascii_space = np.zeros(256, bool)
_ascii_space[[9, 10, 11, 12, 13, 32]] = True
IS_WORD_BYTE = ~_ascii_space
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ascii_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words parted by ASCII white space: starts, ends, and offsets of words by row."""
    starts, ends = runs(IS_WORD_BYTE[buf], off)
    return starts, ends, np.searchsorted(starts, off)
