"""Byte-level BPE by monoid tree reduction.

A text is cut into halves down to leaves; leaves are encoded by themselves; two
neighbours are joined by encoding a window over their border anew. The window starts
where the left side's pieces can no longer change (the pattern looks at most three
characters past the end of a piece, and a match depends only on the text from its
start), and grows to the right until one of its settled piece borders is also a border
of the right side: from there on both readings are the same. Inside one long piece the
same reduction runs on tokens: there a sequence of tokens is the encoding of its bytes
exactly if every two neighbours are the encoding of theirs, so the window grows until
both pairs at its ends hold. Decoding spells leaves of ids and concatenates neighbours up the
tree.

Defined cases: a null or empty text has no ids; a text of any length goes through the tree;
rows are independent, so repeated rows and repeated or null doc_ids each get a row; an empty
table has no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .pieces import PieceIds, byte_pieces, load_ranks, odd_rows, scan
from .vec import chunks, ranges

LEAF_BYTES = 4096
LEAF_IDS = 4096
#: Bytes that decide where a piece ends: three characters past it.
LOOKAHEAD = 12
LONG_PIECE = 1024


@dataclass
class Node:
    """An encoded stretch of text: byte range, starts of pieces, ids of each, ids."""

    begin: int
    end: int
    starts: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


class TreeCodec:
    def __init__(self, ranks_path: str, pattern: str, leaf_bytes: int = LEAF_BYTES):
        import tiktoken

        self.pattern, self.leaf = regex.compile(pattern), leaf_bytes
        ranks = load_ranks(ranks_path)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece_ids = PieceIds(self.encode_piece)
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    # one piece

    def encode_piece(self, raw: bytes) -> list[int]:
        if len(raw) <= LONG_PIECE:
            return self.core._encode_single_piece(raw)
        half = len(raw) // 2
        return self.join_tokens(self.encode_piece(raw[:half]), self.encode_piece(raw[half:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        spell, one = self.core.decode_single_token_bytes, self.core._encode_single_piece
        stable = lambda a, b: one(spell(a) + spell(b)) == [a, b]
        k = 2
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            middle = one(b"".join(map(spell, left[i:] + right[:j])))
            if (i == 0 or stable(left[i - 1], middle[0])) and (j == len(right) or stable(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            k *= 2

    # texts

    def join(self, buf: np.ndarray, left: Node, right: Node) -> Node:
        ends = np.append(left.starts[1:], left.end)
        keep = int(np.searchsorted(ends, left.end - LOOKAHEAD, "right"))
        at = int(ends[keep - 1]) if keep else left.begin
        reach = 64
        while True:
            to = min(right.begin + reach, right.end)
            while to < right.end and (buf[to] & 0xC0) == 0x80:
                to += 1
            borders = np.array(scan(self.pattern, buf[at:to].tobytes()), np.int64) + at
            cut = right.end
            if to < right.end:
                settled = borders[(borders >= right.begin) & (borders <= to - LOOKAHEAD)]
                same = settled[np.isin(settled, right.starts)]
                if not len(same):
                    reach *= 2
                    continue
                cut = int(same[0])
            break
        borders = borders[borders < cut]
        ids, counts = self.piece_ids(buf[at:cut], borders - at, np.append(borders[1:], cut) - at)
        k = int(np.searchsorted(right.starts, cut))
        return Node(
            left.begin,
            right.end,
            np.concatenate([left.starts[:keep], borders, right.starts[k:]]),
            np.concatenate([left.counts[:keep], counts, right.counts[k:]]),
            np.concatenate([left.ids[: int(left.counts[:keep].sum())], ids, right.ids[int(right.counts[:k].sum()) :]]),
        )

    def reduce(self, buf: np.ndarray, leaves: list[Node]) -> Node:
        if len(leaves) == 1:
            return leaves[0]
        half = len(leaves) // 2
        return self.join(buf, self.reduce(buf, leaves[:half]), self.reduce(buf, leaves[half:]))

    def leaf_offsets(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        sizes = np.diff(off)
        counts = np.maximum(1, -(-sizes // self.leaf))
        row = np.repeat(np.arange(len(sizes)), counts)
        k = ranges(np.zeros(len(sizes), np.int64), counts)
        cut = off[row] + k * sizes[row] // counts[row]
        for _ in range(3):  # not inside a character
            inside = (cut < len(buf)) & (k > 0)
            inside[inside] = (buf[cut[inside]] & 0xC0) == 0x80
            cut[inside] += 1
        return np.append(cut, off[-1])

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and how many each row has."""
        cuts = self.leaf_offsets(buf, off)
        starts = byte_pieces(buf, cuts)
        odd = odd_rows(buf, off)
        if len(odd):
            row = np.searchsorted(off, starts, "right") - 1
            parts = [starts[~np.isin(row, odd)]]
            for r in odd.tolist():
                inner = cuts[(cuts >= off[r]) & (cuts < off[r + 1])]
                for a, b in zip(inner, np.append(inner[1:], off[r + 1]), strict=True):
                    parts.append(np.array(scan(self.pattern, buf[a:b].tobytes()), np.int64) + a)
            starts = np.sort(np.concatenate(parts))
        ids, counts = self.piece_ids(buf, starts, np.append(starts[1:], len(buf)))
        total = np.append(0, np.cumsum(counts))
        bounds = np.searchsorted(starts, cuts)
        first = np.searchsorted(cuts[:-1], off)
        # of empty rows, several start at one place: a row's leaves begin inside it
        out, sizes = [], []
        for r in range(len(off) - 1):
            if off[r + 1] - off[r] <= self.leaf:
                a, b = np.searchsorted(starts, (off[r], off[r + 1]))
                node_ids = ids[total[a] : total[b]]
            else:
                leaves = []
                for k in range(first[r], first[r + 1]):
                    a, b = bounds[k], bounds[k + 1]
                    leaves.append(Node(int(cuts[k]), int(cuts[k + 1]), starts[a:b], counts[a:b], ids[total[a] : total[b]]))
                node_ids = self.reduce(buf, leaves).ids
            out.append(node_ids)
            sizes.append(len(node_ids))
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), np.array(sizes, np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, and how many each row has. Leaves of ``LEAF_IDS`` ids are spelt
        each by itself; neighbours are then concatenated, level by level, up to the text."""
        leaves = np.maximum(1, -(-counts // LEAF_IDS))
        row = np.repeat(np.arange(len(counts)), leaves)
        begin = (np.cumsum(counts) - counts)[row] + ranges(np.zeros(len(counts), np.int64), leaves) * LEAF_IDS
        spelt = [self.spell(ids[a:b]) for a, b in zip(begin.tolist(), np.append(begin[1:], len(ids)).tolist(), strict=True)]
        texts, at = [], 0
        for n in leaves.tolist():
            level, at = spelt[at : at + n], at + n
            while len(level) > 1:
                level = [level[k] + level[k + 1] if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            texts.append(level[0])
        return np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))

    def spell(self, ids: np.ndarray) -> bytes:
        size = self.token_size[ids]
        return self.token_bytes[ranges(self.token_at[ids], size)].tobytes()


@cache
def codec_of(ranks_path: str, pattern: str, leaf_bytes: int) -> TreeCodec:
    """A worker loads its vocabulary once, for all its tasks."""
    return TreeCodec(ranks_path, pattern, leaf_bytes)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, leaf_bytes: int = LEAF_BYTES, keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, digests of the ids and of the decoded bytes, and the
    decoded text; with ``keep_ids`` also the ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks_path, pattern, leaf_bytes)
        for batch in batches:
            for a, b, buf, off in chunks(batch):
                ids, counts = codec.encode(buf, off)
                spelt, sizes = codec.decode(ids, counts)
                raw_ids, raw = ids.astype("<u4").tobytes(), spelt.tobytes()
                at = np.append(0, np.cumsum(counts)).tolist()
                to = np.append(0, np.cumsum(sizes)).tolist()
                pairs = range(b - a)
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(raw_ids[4 * at[k] : 4 * at[k + 1]]).hexdigest() for k in pairs]),
                    pa.array([hashlib.sha256(raw[to[k] : to[k + 1]]).hexdigest() for k in pairs]),
                ]
                if keep_ids:
                    columns.append(pa.array([ids[at[k] : at[k + 1]].astype(np.int32) for k in pairs], pa.list_(pa.int32())))
                    columns.append(pa.array([raw[to[k] : to[k + 1]].decode("utf-8", "replace") for k in pairs], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(rows, schema)
