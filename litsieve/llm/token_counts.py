"""Token counts without token ids.

Each distinct pre-token is counted once; a document's count is the sum over its own
pre-token frequencies. The ``hot`` most frequent pre-tokens (a fixed number, so the
size of what is broadcast is bounded) are summed where the text is read; the rest, of
which no single one is frequent, are joined by pre-token.

Rows that hold other characters than ASCII and U+00C0..U+00FF, or a possible special
string, are split by the library's own normaliser and pre-tokenizer; strings that it
treats as special count as the one id that they are.

Defined cases: null and empty texts have 0 bytes and tokens; repeated rows each get a
row; a pre-token of any length is one row of the join; an empty table has no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import byte_letters, odd_rows, spelt_out, word_pieces
from .shared import written
from .vec import chunks, groups, same_spans, span_hashes

HOT = 65_536
#: Longer pre-tokens are joined, however frequent, so that the hot ones are bounded in bytes.
HOT_BYTES = 64
HELD_WORDS = 100_000


class WordSplitter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.back = {v: k for k, v in self.letters.items()}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def count_pieces(self, word: bytes) -> int:
        if word.decode("utf-8", "replace") in self.special:
            return 1
        return len(self.model.tokenize(spelt_out(word, self.letters)))

    def by_library(self, text: str) -> list[bytes]:
        """Pre-tokens of a text, special strings whole."""
        import re

        out: list[bytes] = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text):
            if part in self.special:
                out.append(part.encode())
            elif part:
                plain = self.tokenizer.normalizer.normalize_str(part)
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
                    out.append(bytes(map(self.back.__getitem__, piece)))
        return out

    def split(self, buf: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, row of each): pre-tokens of all rows."""
        low, starts, ends = word_pieces(buf, off)
        odd = odd_rows(buf, off, b"<|")
        row = np.searchsorted(off, starts, "right") - 1
        if not len(odd):
            return low, starts, ends, row
        keep = ~np.isin(row, odd)
        starts, ends, row = starts[keep], ends[keep], row[keep]
        raw, at = buf.tobytes(), len(low)
        words, rows = [], []
        for r in odd.tolist():
            found = self.by_library(raw[off[r] : off[r + 1]].decode("utf-8", "replace"))
            words += found
            rows += [r] * len(found)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        more = np.cumsum(sizes) + at
        return (
            np.concatenate([low, np.frombuffer(b"".join(words), np.uint8)]),
            np.concatenate([starts, more - sizes]),
            np.concatenate([ends, more]),
            np.concatenate([row, np.array(rows, np.int64)]),
        )


@cache
def splitter_of(path: str) -> WordSplitter:
    """A worker loads its vocabulary once, for all its tasks."""
    return WordSplitter(path)


def distinct_words(docs: DataFrame, path: str) -> DataFrame:
    """word, n, pieces: each distinct pre-token with its frequency and token count."""

    def emit(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, held = splitter_of(path), Counter()
        for batch in batches:
            for _, _, buf, off in chunks(batch):
                low, starts, ends, _ = splitter.split(buf, off)
                if not len(starts):
                    continue
                first, group = groups(low, starts, ends)
                n = np.bincount(group, minlength=len(first))
                raw = low.tobytes()
                for a, b, k in zip(starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
                    held[raw[a:b]] += k
                if len(held) > HELD_WORDS:
                    yield emit(held)
                    held = Counter()
        if held:
            yield emit(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = splitter_of(path)
        for batch in batches:
            pieces = [splitter.count_pieces(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int32())], names=["word", "n", "pieces"])

    found = docs.select("text").mapInArrow(words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(found.mapInArrow(count, "word binary, n long, pieces int"), "words", settle=True)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    table = distinct_words(docs, path)
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # words of at least one in 16 * hot occurrences: there can't be more of them than that
    often = table.where(F.col("n") * (16 * hot) >= total).where(F.octet_length("word") <= HOT_BYTES)
    top = often.orderBy(F.desc("n"), "word").limit(hot).toPandas()
    blob = np.frombuffer(b"".join(top["word"]), np.uint8)
    top_ends = np.cumsum([len(w) for w in top["word"]], dtype=np.int64)
    top_starts = top_ends - [len(w) for w in top["word"]] if len(top) else top_ends
    keys = span_hashes(blob, top_starts, top_ends) if len(top) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((blob, top_starts[order], top_ends[order], keys[order], top["pieces"].to_numpy(np.int64)[order]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = splitter_of(path)
        blob, hot_starts, hot_ends, keys, pieces = shared.value
        for batch in batches:
            for a, b, buf, off in chunks(batch):
                low, starts, ends, row = splitter.split(buf, off)
                n = b - a
                first, group = groups(low, starts, ends)
                if len(keys) and len(first):
                    at = np.minimum(np.searchsorted(keys, span_hashes(low, starts[first], ends[first])), len(keys) - 1)
                    size = ends[first] - starts[first]
                    is_hot = size == hot_ends[at] - hot_starts[at]
                    is_hot[is_hot] = same_spans(low, starts[first][is_hot], blob, hot_starts[at][is_hot], size[is_hot])
                    value = np.where(is_hot, pieces[at], 0)
                else:
                    is_hot, value = np.zeros(len(first), bool), np.zeros(len(first), np.int64)
                hot_sum = np.bincount(row, weights=value[group], minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
                rest = np.flatnonzero(~is_hot[group]) if len(row) else np.zeros(0, np.int64)
                pair, times = np.unique(row[rest] * max(1, len(first)) + group[rest], return_counts=True)
                of, word = pair // max(1, len(first)), pair % max(1, len(first))
                used, code = np.unique(word, return_inverse=True)
                raw = low.tobytes()
                names = pa.array([raw[x:y] for x, y in zip(starts[first[used]].tolist(), ends[first[used]].tolist(), strict=True)], pa.binary())
                item = pa.StructArray.from_arrays([names.take(pa.array(code)), pa.array(times, pa.int64())], names=["word", "times"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, n) for c in range(2)), pa.array(np.diff(off)), pa.array(hot_sum), pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), item)],
                    names=["rid", "doc_id", "n_bytes", "hot", "rest"],
                )

    # with the doc_id, 64 bits tell rows apart: only texts of one doc_id could be taken as one
    base = docs.select(F.xxhash64("text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = base.mapInArrow(rows, "rid long, doc_id long, n_bytes long, hot long, rest array<struct<word: binary, times: long>>")
    spread = each.select("rid", "doc_id", "n_bytes", "hot", F.posexplode_outer("rest").alias("k", "item")).select("rid", "doc_id", "n_bytes", "hot", "k", "item.word", "item.times")
    joined = spread.join(table.select("word", "pieces"), "word", "left")
    # repeated rows share a key: each of them brought its words, and each gets a row
    summed = joined.groupBy("rid", "doc_id", "n_bytes", "hot").agg(
        F.sum(F.when(F.coalesce("k", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"), F.coalesce(F.sum(F.col("times") * F.col("pieces")), F.lit(0)).alias("rest")
    )
    tokens = F.col("hot") + (F.col("rest") / F.col("copies")).cast("long")
    out = summed.select("doc_id", "n_bytes", tokens.alias("n_tokens"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
