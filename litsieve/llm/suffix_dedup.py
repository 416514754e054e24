"""Suffix-array dedup over bytes: difference-cover blockwise sorting.

Removes each byte covered by a ``width``-byte string that also starts in a document with
a smaller doc_id. The suffixes that can matter, those whose window has a minimiser that
two documents share, are dealt to buckets (see ``repeats``), and one bucket is sorted at
a time. Suffixes only matter to the depth of a window. In a bucket, the positions whose
residue is in a difference cover are ranked beforehand by the PERIOD-shorter prefix.
Suffixes are then sorted by their first and last PERIOD bytes; a long tie is resolved by
splitting about a pivot: for the residues of any two positions there is a shift below
PERIOD that takes both to ranked positions, whose ranks compare the middle at once. So
memory is a few words for each byte of one bucket, whatever the length of the ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Windows, coverage, covered
from .vec import U64, byte_grams, mix, ranges

PERIOD = 16
GRAM_BYTES = 16


def difference_cover(period: int) -> list[int]:
    """The first smallest set of residues whose differences are all residues."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = [0, *rest]
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise AssertionError


def shifts(period: int, cover: list[int]) -> np.ndarray:
    """The least shift that takes residues i and j both into the cover."""
    inside = set(cover)
    return np.array([[next(d for d in range(period) if (i + d) % period in inside and (j + d) % period in inside) for j in range(period)] for i in range(period)])


COVER = difference_cover(PERIOD)
SHIFT = shifts(PERIOD, COVER)


def rank(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def prefix_ranks(words: np.ndarray, at: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Ranks of positions by the 8-byte words at the offsets."""
    out = rank(words[at + offsets[0]])
    for k in offsets[1:]:
        out = rank((out << np.uint64(32)) | rank(words[at + k]))
    return out.astype(np.int64)


def window_classes(width: int):
    middle = width - PERIOD

    def classes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in strings], np.int64)
        text = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
        words = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,)).astype(np.uint64)
        counts = sizes - width + 1
        at = ranges(np.cumsum(sizes) - sizes, counts)
        n = len(words)
        # ranks of the cover sample
        position = np.arange(0, n - middle + 8)
        sample = position[np.isin(position % PERIOD, COVER)]
        ranked = np.zeros(n, np.int64)
        ranked[sample] = prefix_ranks(words, sample, [*range(0, middle - 8, 8), middle - 8])
        # suffixes by first and last bytes, then long ties by the sample
        group = prefix_ranks(words, at, [0, 8, width - 16, width - 8])
        final = np.full(len(at), -1)
        todo, made = np.arange(len(at)), 0
        while len(todo):
            g = group[todo]
            order = np.argsort(g, kind="stable")
            todo, g = todo[order], g[order]
            new = np.append(True, g[1:] != g[:-1])
            pivot = at[todo[new]][np.cumsum(new) - 1]
            here = at[todo]
            shift = SHIFT[pivot % PERIOD, here % PERIOD]
            a, b = ranked[here + shift], ranked[pivot + shift]
            same = a == b
            final[todo[same]] = made + (np.cumsum(new) - 1)[same]
            made += int(new.sum())
            # what is less and what is greater than the pivot go on apart
            group[todo] = 2 * (np.cumsum(new) - 1) + (a > b)
            todo = todo[~same]
        return final, counts

    return classes


def split_bytes(buf: np.ndarray, off: np.ndarray):
    return byte_grams(buf, GRAM_BYTES), None, None, off


def extended(reach: int):
    """Hashes of the ``reach`` (at least 8) bytes before a gram, and of those after it."""
    offsets = [*range(0, reach - 8, 8), reach - 8]

    def both(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.ndarray((max(0, len(buf) - 7),), "<u8", np.ascontiguousarray(buf), strides=(1,))
        out = []
        for start in (at - reach, at + GRAM_BYTES):
            h = np.zeros(len(at), U64)
            for k in offsets:
                h = mix(h * U64(0xA24BAED4963EE407) + words[np.clip(start + k, 0, len(words) - 1)])
            out.append(h)
        return out[0], out[1]

    return both


def byte_windows(width: int) -> Windows:
    return Windows(width, GRAM_BYTES, split_bytes, window_classes(width), True, extended((width - GRAM_BYTES) // 2))


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes."""
    found = covered(docs, byte_windows(width))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, spans, digest, kept = [], [], [], [], []
            for text, copy, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                out = raw = text.encode()
                runs = 0
                if copy or marks.is_valid:
                    gone = coverage(copy, marks, len(raw), width)
                    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                total.append(len(raw))
                removed.append(len(raw) - len(out))
                spans.append(runs)
                digest.append(hashlib.sha256(out).hexdigest())
                kept.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return found.select("doc_id", "text", "copy", "marks").mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
