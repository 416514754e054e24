"""Substring dedup over words: super-k-mers sent to their minimiser's bucket.

Removes each word covered by a window of ``width`` words whose word sequence also
starts in a document with a smaller doc_id. See ``repeats`` for the plan and the
defined cases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Windows, coverage, covered
from .vec import U64, ascii_words, span_hashes, unit_grams

GRAM_WORDS = 8


def split_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, rows = ascii_words(buf, off)
    grams = unit_grams(span_hashes(buf, starts, ends), GRAM_WORDS) if len(starts) else np.zeros(0, U64)
    return grams, starts, ends, rows


def rank(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def word_window_classes(width: int):
    def classes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sorts all windows by prefix doubling over word numbers, so exactly."""
        number: dict[bytes, int] = {}
        words = [s.split() for s in strings]
        ids = np.array([number.setdefault(w, len(number)) for s in words for w in s], np.int64)
        sizes = np.array([len(s) for s in words], np.int64)
        have, ranks = 1, ids
        while have * 2 <= width:
            ranks = rank((ranks[:-have] << 32) | ranks[have:])
            have *= 2
        if have < width:
            n = len(ids) - width + 1
            ranks = rank((ranks[:n] << 32) | ranks[width - have :][:n])
        from .vec import ranges

        counts = sizes - width + 1
        return ranks[ranges(np.cumsum(sizes) - sizes, counts)], counts

    return classes


#: Runs of one minimiser beyond which its strings are dealt by context.
HOT = 1024


def word_windows(width: int, hot: int = HOT) -> Windows:
    return Windows(width, GRAM_WORDS, split_words, word_window_classes(width), False, hot=hot)


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, the kept text (words joined by one
    space), and the row's key."""
    return apply_marks(covered(docs, word_windows(width)), width)


def changed_texts(docs: DataFrame, width: int = 50) -> DataFrame:
    """rid and kept text of the rows that lose words, each row key once."""
    found = covered(docs, word_windows(width)).where("copy or marks is not null")
    return apply_marks(found, width).where("n_removed > 0").select("rid", "kept").distinct()


def apply_marks(found: DataFrame, width: int) -> DataFrame:

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest, kept = [], [], [], []
            for text, copy, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = text.encode().split()
                if copy or marks.is_valid:
                    gone = coverage(copy, marks, len(words), width)
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    left = words
                out = b" ".join(left)
                total.append(len(words))
                removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(out).hexdigest())
                kept.append(out.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept), batch.column(4)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "rid"])

    return found.select("doc_id", "text", "copy", "marks", "rid").mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, rid binary")
