"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``width`` consecutive words of a benchmark item; an item of
fewer words is one shorter pattern. For the patterns of one length, a table over hashed
blocks of two words says how far a block ends from the nearest pattern end that it
allows: a block in no pattern skips a whole window. Where the shift is nought, the
block's bucket holds the patterns that end so, and their words are compared directly.
All stretches of a chunk of documents are searched in step, one array operation a move.

The benchmark is the query set: it is read in blocks of at most ``BLOCK_BYTES`` of text,
each block searched against all documents, and the blocks' hits are merged by document.

Defined cases: a document without words (or null) has no hits; an item without words
has no windows; items with null item_id are left out, as there is no id to report; an
item_id that repeats is one item with all its texts' windows; repeated documents each
get a row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import row_key
from .vec import LOWER, U64, chunks, mix, ranges, runs, span_hashes

BLOCK_BYTES = 16 << 20
STRETCH_WORDS = 512
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, and word offsets by row."""
    low = LOWER[buf]
    starts, ends = runs(IS_WORD[low], off)
    return low, starts, ends, np.searchsorted(starts, off)


class PatternTable:
    """All patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.words = list(patterns)
        self.items = [sorted(patterns[p]) for p in self.words]
        self.length = len(self.words[0])
        self.block = min(2, self.length)
        spelt = [w for p in self.words for w in p]
        ends = np.cumsum([len(w) for w in spelt])
        raw = np.frombuffer(b"".join(spelt), np.uint8)
        self.hashes = span_hashes(raw, ends - [len(w) for w in spelt], ends).reshape(-1, self.length)
        self.bits = max(12, (8 * self.hashes.size).bit_length())
        slots = self.slots(self.hashes.reshape(-1)).reshape(self.hashes.shape)[:, : self.length - self.block + 1] if self.block == 1 else self.slots2(self.hashes)
        last = self.length - self.block
        self.shift = np.full(1 << self.bits, last + 1, np.int64)
        for j in range(last + 1):
            np.minimum.at(self.shift, slots[:, j], last - j)
        self.order = np.argsort(slots[:, last], kind="stable")
        self.bucket = np.searchsorted(slots[self.order, last], np.arange((1 << self.bits) + 1))

    def slots(self, block_hashes: np.ndarray) -> np.ndarray:
        return (block_hashes >> U64(64 - self.bits)).astype(np.int64)

    def slots2(self, h: np.ndarray) -> np.ndarray:
        return self.slots(mix(h[..., :-1] * U64(0xA24BAED4963EE407) + h[..., 1:]))

    def search(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, pattern) pairs that agree in all word hashes."""
        none = np.zeros(0, np.int64)
        if len(h) < self.length:
            return none, none
        slot = self.slots(h) if self.block == 1 else self.slots2(h)
        last = self.length - self.block
        room = np.maximum(0, np.diff(rows) - self.length + 1)
        stretches = -(-room // STRETCH_WORDS)
        k = ranges(np.zeros(len(room), np.int64), stretches) * STRETCH_WORDS
        row = np.repeat(np.arange(len(room)), stretches)
        at = rows[row] + k
        limit = np.minimum(at + STRETCH_WORDS, rows[row] + room[row])
        found = []
        while len(at):
            shift = self.shift[slot[at + last]]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at < limit
            at, limit = at[going], limit[going]
        at = np.concatenate(found) if found else none
        bucket = slot[at + last]
        size = self.bucket[bucket + 1] - self.bucket[bucket]
        pattern = self.order[ranges(self.bucket[bucket], size)]
        at = np.repeat(at, size)
        for j in range(self.length):
            same = h[at + j] == self.hashes[pattern, j]
            at, pattern = at[same], pattern[same]
        return at, pattern


def pattern_tables(items: list[tuple[str, str]], width: int) -> list[PatternTable]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        low, starts, ends, _ = words_of(raw, np.array([0, len(raw)]))
        spelt = low.tobytes()
        words = [spelt[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        size = min(width, len(words))
        for k in range(len(words) - size + 1) if size else ():
            by_length[size][tuple(words[k : k + size])].add(item)
    return [PatternTable(p) for p in by_length.values()]


def find_windows(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items,
    spans (pairs of 32-bit word numbers) of hit words, and the row's key."""
    spark = docs.sparkSession
    base = docs.select(row_key("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))

    def scan(block: int) -> DataFrame:
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        tables = spark.sparkContext.broadcast(pattern_tables([(r.item, r.text) for r in part.collect()], width))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, buf, off in chunks(batch):
                    low, starts, ends, bounds = words_of(buf, off)
                    h = span_hashes(low, starts, ends) if len(starts) else np.zeros(0, U64)
                    cover = np.zeros(len(h) + 1, np.int64)
                    names: dict[int, set[str]] = defaultdict(set)
                    raw = low.tobytes()
                    for table in tables.value:
                        at, pattern = table.search(h, bounds)
                        row = np.searchsorted(bounds, at, "right") - 1
                        confirmed = []
                        for x, p, r in zip(at.tolist(), pattern.tolist(), row.tolist(), strict=True):
                            here = tuple(raw[starts[k] : ends[k]] for k in range(x, x + table.length))
                            if here == table.words[p]:
                                confirmed.append(x)
                                names[r].update(table.items[p])
                        np.add.at(cover, confirmed, 1)
                        np.add.at(cover, np.array(confirmed, np.int64) + table.length, -1)
                    first, last = runs(np.cumsum(cover[:-1]) > 0, bounds)
                    row = np.searchsorted(bounds, first, "right") - 1
                    local = np.stack([first - bounds[row], last - bounds[row]], 1).astype("<i4")
                    edge = np.searchsorted(row, np.arange(b - a + 1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(c).slice(a, b - a) for c in range(2)),
                            pa.array(np.diff(bounds)),
                            pa.array([local[edge[r] : edge[r + 1]].tobytes() for r in range(b - a)], pa.binary()),
                            pa.array([sorted(names[r]) if r in names else [] for r in range(b - a)], pa.list_(pa.string())),
                        ],
                        names=["rid", "doc_id", "n_words", "spans", "items"],
                    )

        return base.mapInArrow(rows, "rid binary, doc_id long, n_words long, spans binary, items array<string>")

    found = scan(0).withColumn("spans", F.array("spans"))
    if blocks > 1:
        for block in range(1, blocks):
            found = found.unionByName(scan(block).withColumn("spans", F.array("spans")))
        merged = found.groupBy("rid", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.count("*").alias("times"))
        found = merged.select("rid", "doc_id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), (F.col("times") / blocks).cast("int")))).drop("col")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, spans, digest, items, number = [], [], [], [], []
            for parts, ids in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                pairs = np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2)
                if len(parts) > 1 and len(pairs):
                    cover = np.zeros(int(pairs.max()) + 1, np.int64)
                    np.add.at(cover, pairs[:, 0], 1)
                    np.add.at(cover, pairs[:, 1], -1)
                    inside = np.cumsum(cover) > 0
                    pairs = np.stack(runs(inside, np.array([0, len(inside)])), 1).astype("<i4")
                ids = sorted(ids)
                hit.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
                spans.append(pairs.tobytes())
                items.append(ids)
                number.append(len(ids))
                digest.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            n_hit = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), n_hit, pa.array(number, pa.int64()), pa.array(digest), pa.array([x > 0 for x in hit], pa.bool_()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.binary()), batch.column(4)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", "rid"],
            )

    return found.select("doc_id", "n_words", "spans", "items", "rid").mapInArrow(finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans binary, rid binary")
