"""Token-id files compressed by a Re-Pair grammar, with random access.

Documents are range-partitioned by doc_id, encoded in order, and packed into blocks.
A block is one record of a Parquet dataset (so that writing commits atomically on any
shared store and survives lost executors):

- ``shard``, ``block``: its place in the order of all blocks; ``n_ids``: ids in it
- ``doc_ids``, ``doc_null``, ``doc_sizes``: its documents, with their numbers of ids
- ``rules``: two symbols for each nonterminal; nonterminal k has symbol base + k
- ``rule_sizes``: how many ids each nonterminal expands to
- ``sequence``: the symbols (16 bits; ids and nonterminals together stay below 65,536)

Symbols' sizes give the id offset of every symbol, so a range of ids is decoded from
the symbols that it overlaps alone (``decode_range``).

Defined cases: null and empty texts have the end id alone; documents with equal doc_id
are ordered by text; null doc_ids come first; an empty table has no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import PieceIds, byte_letters, byte_pieces, odd_rows, spelt_out
from .shared import partitions, written
from .vec import chunks, ranges

BLOCK_IDS = 2_000_000
ENCODE_BYTES = 3_000_000
RULES_PER_ROUND = 2048
MIN_PAIRS = 16
SYMBOLS = 1 << 16

BLOCK_SCHEMA = "shard int, block int, n_ids long, base int, doc_ids binary, doc_null binary, doc_sizes binary, rules binary, rule_sizes binary, sequence binary"


@cache
def encoder_of(path: str) -> LibraryEncoder:
    """A worker loads its vocabulary once, for all its tasks."""
    return LibraryEncoder(path)


class LibraryEncoder:
    """The tokenizers library's ids of whole texts, each distinct piece encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.piece_ids = PieceIds(self.encode_piece, limit=400_000)

    def encode_piece(self, raw: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(spelt_out(raw, self.letters))]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = byte_pieces(buf, off)
        odd = odd_rows(buf, off, b"<|")
        if len(odd):
            row = np.searchsorted(off, starts, "right") - 1
            starts, ends = starts[keep := ~np.isin(row, odd)], np.append(starts[1:], len(buf))[keep]
        else:
            ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        ids, counts = self.piece_ids(buf, starts, ends)
        total = np.append(0, np.cumsum(counts))[np.searchsorted(starts, off)]
        sizes = np.diff(total)
        if not len(odd):
            return ids, sizes
        raw = buf.tobytes()
        texts = [raw[off[r] : off[r + 1]].decode("utf-8", "replace") for r in odd.tolist()]
        whole = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        sizes[odd] = [len(w) for w in whole]
        parts = np.split(ids, total[odd])
        return np.concatenate([x for pair in zip(parts, [*whole, ids[:0]], strict=True) for x in pair]), sizes


def _pairs(seq: np.ndarray) -> np.ndarray:
    return (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]


SLOT_BITS = 18


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)


def compress(ids: np.ndarray, base: int, per_round: int = RULES_PER_ROUND, least: int = MIN_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, rule sizes, sequence). Each round counts all pairs of symbols, gives the
    most frequent ones a nonterminal each, and replaces them from left to right, until no
    pair occurs ``least`` times or the symbols have run out."""
    seq = ids.astype(np.uint16)
    rules: list[np.ndarray] = []
    sizes = np.ones(SYMBOLS, np.uint32)
    made = 0
    while True:
        room = min(per_round, SYMBOLS - base - made)
        if len(seq) < 2 or room <= 0:
            break
        pairs = _pairs(seq)
        ordered = np.sort(pairs)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        counts = np.diff(edge)
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        chosen = ordered[edge[often[np.argsort(-counts[often], kind="stable")[:room]]]]
        # one pair a slot, the most frequent; the others wait for the next round
        _, first = np.unique(_slot(chosen), return_index=True)
        chosen = chosen[np.sort(first)]
        symbol = np.zeros(1 << SLOT_BITS, np.uint16)
        holder = np.zeros(1 << SLOT_BITS, np.uint32)
        symbol[_slot(chosen)] = np.arange(base + made, base + made + len(chosen))
        holder[_slot(chosen)] = chosen
        slot = _slot(pairs)
        hit = np.flatnonzero((holder[slot] == pairs) & (symbol[slot] > 0))
        # of overlapping hits, which are neighbours, every second one counts
        new = np.ones(len(hit), bool)
        new[1:] = hit[1:] != hit[:-1] + 1
        run = hit[new][np.cumsum(new) - 1]
        hit = hit[(hit - run) % 2 == 0]
        seq = seq.copy()
        seq[hit] = symbol[slot[hit]]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
        left, right = chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)
        sizes[base + made : base + made + len(chosen)] = sizes[left] + sizes[right]
        rules.append(np.stack([left, right], 1).astype(np.uint16))
        made += len(chosen)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)), sizes[base : base + made], seq


def expansions(rules: np.ndarray, rule_sizes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each symbol stands for: flat ids, and where each symbol's begin and how many."""
    spelt: list[np.ndarray] = []
    part = lambda s: spelt[s - base] if s >= base else np.array([s], np.uint16)
    for a, b in rules.tolist():
        spelt.append(np.concatenate([part(a), part(b)]))
    sizes = np.concatenate([np.ones(base, np.int64), rule_sizes.astype(np.int64)])
    flat = np.concatenate([np.arange(base, dtype=np.uint16), *spelt])
    return flat, np.cumsum(sizes) - sizes, sizes


def decode(rules: np.ndarray, rule_sizes: np.ndarray, sequence: np.ndarray, base: int) -> np.ndarray:
    flat, at, sizes = expansions(rules, rule_sizes, base)
    return flat[ranges(at[sequence], sizes[sequence])]


def decode_range(rules: np.ndarray, rule_sizes: np.ndarray, sequence: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a block, expanding only the symbols that overlap them."""
    sizes = np.concatenate([np.ones(base, np.int64), rule_sizes.astype(np.int64)])[sequence]
    ends = np.cumsum(sizes)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    out: list[int] = []
    for symbol in sequence[a:b].tolist():
        stack = [symbol]
        while stack:
            top = stack.pop()
            if top < base:
                out.append(top)
            else:
                stack += rules[top - base, ::-1].tolist()
    skip = start - int(ends[a] - sizes[a]) if a < len(sizes) else 0
    return np.array(out[skip : skip + stop - start], np.uint16)


def write_blocks(docs: DataFrame, tokenizer_path: str, base: int = 50257, end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode, order and compress; returns the written blocks, read from the shared folder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        waiting, shard, block = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, waiting, block
            ids, sizes, keys, null = (np.concatenate(x) for x in zip(*held, strict=True))
            rules, rule_sizes, seq = compress(ids, base)
            values = [shard, block, len(ids), base, keys.astype("<i8").tobytes(), np.packbits(null).tobytes(), sizes.astype("<u4").tobytes(), rules.astype("<u2").tobytes(), rule_sizes.astype("<u4").tobytes(), seq.astype("<u2").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 6
            held, waiting, block = [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            keys = batch.column(0)
            null = np.asarray(keys.is_null())
            keys = keys.fill_null(0).to_numpy(zero_copy_only=False)
            shard = batch.column(2)[0].as_py() if batch.num_rows else shard
            for a, b, buf, off in chunks(batch, limit=min(ENCODE_BYTES, block_ids)):
                ids, sizes = encoder.encode(buf, off)
                ends = np.cumsum(sizes)
                held.append((np.insert(ids, ends, end_id).astype(np.uint16), sizes + 1, keys[a:b], null[a:b]))
                waiting += len(ids) + b - a
                if waiting >= block_ids:
                    yield flush()
        if held:
            yield flush()

    ordered = (
        docs.selectExpr("cast(doc_id as long) doc_id", "text")
        .repartitionByRange(partitions(docs.sparkSession), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("shard", F.spark_partition_id())
    )
    return written(ordered.mapInArrow(rows, BLOCK_SCHEMA), "token-files")


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in written blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, block, _, base, *raw = (batch.column(c)[r].as_py() for c in range(10))
                keys, sizes = np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[2], "<u4").astype(np.int64)
                null = np.unpackbits(np.frombuffer(raw[1], np.uint8), count=len(keys)).astype(bool)
                ids = decode(np.frombuffer(raw[3], "<u2").reshape(-1, 2), np.frombuffer(raw[4], "<u4"), np.frombuffer(raw[5], "<u2"), base)
                spelt = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(spelt[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(keys, mask=null), pa.array(ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                    names=["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    decoded = blocks.mapInArrow(rows, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("shard", "block", "n_ids")
    # ids before a block: of its shard by a window in the shard, of earlier shards by one over a row for each shard
    inside = sizes.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids"))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = shards.select("shard", (F.sum("shard_ids").over(Window.orderBy("shard")) - F.col("shard_ids")).alias("before"))
    bases = inside.join(before, "shard").select("shard", "block", (F.col("inside") + F.col("before")).alias("base_id"))
    return decoded.join(bases, ["shard", "block"]).select("doc_id", (F.col("base_id") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
