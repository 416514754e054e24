"""Removal of what a fixed-width window repeats from a document with a smaller doc_id.

Shared by the byte and the word operator. A window of ``width`` units is covered by the
least hash (minimiser) among the grams in it, so equal windows have equal minimisers.

1. Each document sends its minimisers, six bytes each, packed by bucket; a bucket finds
   those that two documents share and sends them back by document. Where grams are so
   short that they repeat by chance, what is sent is the gram with what stands before it
   and with what stands after it: any window that holds the gram holds one of the two.
2. Consecutive windows that have one shared minimiser travel as one packed string
   (a super-k-mer) to the minimiser's bucket. Strings are first reduced to distinct
   ones with the least doc_id of each, so a group of copies of any size is one row.
3. A bucket sorts the windows of its distinct strings exactly, and marks in each string
   the windows that also start in a document with a smaller doc_id than the string's
   least. Rows of later documents repeat their whole string anyway. The strings of a hot
   minimiser are cut in two and dealt by what stands before the minimiser's gram, or
   after it: one of the two lies in a window whole, so equal windows still meet.
4. Marks are joined back by string, gathered by document, and applied to its text.

Whole exact copies of a smaller doc_id are found by digest and skip steps 2 to 4.

Defined cases: null and empty texts have no units and lose nothing; a null doc_id is
neither smaller nor larger than any other: its row loses nothing and takes nothing;
rows with equal doc_id don't take from each other; repeated rows each get a row; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, row_key, written
from .vec import U64, chunks, mix, ranges, sliding

Split = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
#: (text of all strings, unit offsets of each string's windows ...) -> class of each window
Classes = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]

HASH_BYTES = 6
BUCKETS_A_PARTITION = 16


@dataclass(frozen=True)
class Windows:
    """What windows are made of. ``split`` gives (gram hashes, starts, ends, offsets by
    row) of units; ``classes`` gives, for distinct strings, the class of every window and
    how many windows each string has; ``extended``, if given, the hashes of a gram with
    the ``reach`` units before it and after it. A minimiser of more than ``hot`` runs, and of
    more than a quarter of a partition's share of them, is split by context (0: none is)."""

    width: int
    gram: int
    split: Split
    classes: Classes
    bytes_apart: bool
    extended: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None
    hot: int = 0

    @property
    def reach(self) -> int:
        return (self.width - self.gram) // 2


@dataclass
class Runs:
    """Runs of windows with one minimiser: first and last window, row, the minimiser and its
    gram's place, and the names (two for each run, 0 for none) under which runs are looked up."""

    first: np.ndarray
    last: np.ndarray
    row: np.ndarray
    h: np.ndarray
    at: np.ndarray
    names: np.ndarray
    rows: np.ndarray


POSITION_BITS = 26
LOW48 = U64((1 << 48) - 1)


def minimisers(windows: Windows, buf: np.ndarray, off: np.ndarray) -> Runs:
    """A window's minimiser is the leftmost of the grams with its least hash."""
    grams, _, _, rows = windows.split(buf, off)
    n, span = int(rows[-1]), windows.width - windows.gram + 1
    if not (np.diff(rows) >= windows.width).any():
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, np.zeros(0, U64), none, np.zeros((0, 2), U64), rows)
    low = U64((1 << POSITION_BITS) - 1)
    least = sliding((grams & ~low) | (np.arange(len(grams), dtype=U64) & low), span, np.minimum)
    new = np.zeros(n, bool)
    np.not_equal(least[1:], least[:-1], out=new[1 : len(least)])
    tops = rows[1:] - windows.width  # each row's last window
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        new[max(a, b - windows.width + 1) : b] = False
        if b - a >= windows.width:
            new[a] = True
    first = np.flatnonzero(new)
    row = np.searchsorted(rows, first, "right") - 1
    last = np.minimum(np.append(first[1:], n) - 1, tops[row])
    at = first + ((least[first] - first.astype(U64)) & low).astype(np.int64)
    h = mix(grams[at]) & LOW48
    names = np.zeros((len(at), 2), U64)
    if windows.extended is None:
        names[:, 0] = h
    else:
        before, after = at - windows.reach >= rows[row], at + windows.gram + windows.reach <= rows[row + 1]
        left, right = windows.extended(buf, at)
        names[:, 0] = np.where(before, mix(left ^ h) & LOW48, U64(0))
        names[:, 1] = np.where(after, mix(right + h) & LOW48, U64(0))
    return Runs(first, last, row, h, at, names, rows)


def _six(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return out.reshape(-1).view("<u8")


def shared_minimisers(base: DataFrame, windows: Windows, buckets: int) -> DataFrame:
    """doc_id, hashes: the names of minimisers that each document shares with another."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, _, buf, off in chunks(batch):
                runs = minimisers(windows, buf, off)
                row, h = np.repeat(runs.row, 2), runs.names.ravel()
                row, h = row[h > 0], h[h > 0]
                if not len(h):
                    continue
                bucket = (h % U64(buckets)).astype(np.int64)
                order = np.lexsort((row, bucket))
                bucket, row, h = bucket[order], row[order], h[order]
                edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                keys, counts, hashes = [], [], []
                for x, y in zip(edge.tolist(), np.append(edge[1:], len(h)).tolist(), strict=True):
                    who, n = np.unique(row[x:y], return_counts=True)
                    keys.append(ids[a + who].astype("<i8").tobytes())
                    counts.append(n.astype("<u4").tobytes())
                    hashes.append(_six(h[x:y]))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), pa.array(hashes, pa.binary())], names=["bucket", "ids", "counts", "hashes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, value = [], []
        for batch in batches:
            for ids, counts, hashes in zip(*(batch.column(c).to_pylist() for c in range(1, 4)), strict=True):
                doc.append(np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<u4")))
                value.append(_from_six(hashes))
        if not value:
            return
        docs, h = np.concatenate(doc), np.concatenate(value)
        del doc, value
        order = np.argsort(h)
        edge = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        by = docs[order]
        low, high = np.minimum.reduceat(by, edge), np.maximum.reduceat(by, edge)
        many = np.repeat(low != high, np.diff(np.append(edge, len(h))))
        keep = order[many]
        if not len(keep):
            return
        docs, h = docs[keep], h[keep]
        # one row for each partition of documents, not for each document
        target = (mix(docs.astype(U64)) % U64(buckets)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        target, docs, h = target[order], docs[order], h[order]
        edge = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        for x, y in zip(edge.tolist(), np.append(edge[1:], len(target)).tolist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([target[x]], pa.int32()), pa.array([docs[x:y].astype("<i8").tobytes()], pa.binary()), pa.array([_six(h[x:y])], pa.binary())], names=["target", "ids", "hashes"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes = [], []
        for batch in batches:
            ids += [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(1)]
            hashes += [_from_six(x.as_py()) for x in batch.column(2)]
        if not ids:
            return
        docs, h = np.concatenate(ids), np.concatenate(hashes)
        order = np.lexsort((h, docs))
        docs, h = docs[order], h[order]
        edge = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        ends = np.append(edge[1:], len(docs))
        for k in range(0, len(edge), 10_000):
            part = range(k, min(k + 10_000, len(edge)))
            yield pa.RecordBatch.from_arrays([pa.array(docs[edge[part.start : part.stop]]), pa.array([_six(np.unique(h[edge[i] : ends[i]])) for i in part], pa.binary())], names=["doc_id", "hashes"])

    sent = base.select("doc_id", "text").where("doc_id is not null").mapInArrow(send, "bucket int, ids binary, counts binary, hashes binary")
    met = sent.repartition(buckets, "bucket").mapInArrow(meet, "target int, ids binary, hashes binary")
    return met.repartition(buckets, "target").mapInArrow(gather, "doc_id long, hashes binary")


def super_kmers(base: DataFrame, shared: DataFrame, copies: DataFrame, windows: Windows) -> DataFrame:
    """h, digest, string, rid, doc_id, start, n: runs of windows with a shared minimiser h.
    The minimiser and the digest, 112 bits, name the string from here on."""
    import xxhash

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ids = batch.column(0), batch.column(1)
            lists = batch.column(3)
            for a, b, buf, off in chunks(batch):
                runs = minimisers(windows, buf, off)
                sets = [_from_six(lists[r].as_py()) for r in range(a, b)]
                owner = np.repeat(np.arange(b - a), [len(s) for s in sets]).astype(U64)
                wanted = np.sort(mix(np.concatenate(sets) ^ (owner << U64(48))))
                mine = mix(runs.names ^ (runs.row.astype(U64) << U64(48))[:, None])
                at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                keep = np.flatnonzero(((wanted[at] == mine) & (runs.names > 0)).any(1)) if len(wanted) and len(mine) else np.zeros(0, np.int64)
                first, last, row, h, rows = runs.first[keep], runs.last[keep], runs.row[keep], runs.h[keep], runs.rows
                n = last - first + windows.width
                if windows.bytes_apart:
                    raw = buf.tobytes()
                    strings = [raw[x : x + k] for x, k in zip(first.tolist(), n.tolist(), strict=True)]
                else:
                    words = [buf[off[r] : off[r + 1]].tobytes().split() for r in range(b - a)]
                    local = (first - rows[row]).tolist()
                    strings = [b" ".join(words[r][x : x + k]) for r, x, k in zip(row.tolist(), local, n.tolist(), strict=True)]
                which = pa.array(a + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.astype(np.int64)), pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in strings], U64).view(np.int64)), pa.array(strings, pa.binary()), rids.take(which), ids.take(which), pa.array((first - rows[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["h", "digest", "string", "rid", "doc_id", "start", "n"],
                )

    # rows that are copies are named beside the hashes, so that the text is dealt out once
    gone = copies.groupBy("doc_id").agg(F.collect_list("rid").alias("gone"))
    wanted = shared.join(gone, "doc_id", "left")
    fresh = base.where("doc_id is not null").join(wanted, "doc_id").where("gone is null or not array_contains(gone, rid)")
    return fresh.select("rid", "doc_id", "text", "hashes").mapInArrow(cut, "h long, digest long, string binary, rid binary, doc_id long, start int, n int")


def by_context(hot: DataFrame, windows: Windows) -> DataFrame:
    """part, h, digest, string, least, start: each string cut at the last window that holds
    the ``reach`` units before its minimiser's gram. Windows up to it are dealt by the gram
    and those units, windows after it by the gram and the ``reach`` units after it, which they
    hold. start is the piece's first unit in the whole string."""
    import xxhash

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in chunks(batch, "string"):
                runs = minimisers(windows, buf, off)
                raw = buf.tobytes()
                units = [raw[off[r] : off[r + 1]] if windows.bytes_apart else raw[off[r] : off[r + 1]].split() for r in range(b - a)]
                glue = b"" if windows.bytes_apart else b" "
                parts, pieces, rows, starts = [], [], [], []
                for row, first, last, at in zip(runs.row.tolist(), *((x - runs.rows[runs.row]).tolist() for x in (runs.first, runs.last, runs.at)), strict=True):
                    edge, whole = at - windows.reach, units[row]
                    for side, x, y, context in ((1, first, min(last, edge), (edge, at + windows.gram)), (2, max(first, edge + 1), last, (at, at + windows.gram + windows.reach))):
                        if x <= y:
                            text = whole[slice(*context)]
                            parts.append(xxhash.xxh3_64_intdigest(text if windows.bytes_apart else glue.join(text), seed=side))
                            piece = whole[x : y + windows.width]
                            pieces.append(piece if windows.bytes_apart else glue.join(piece))
                            rows.append(a + row)
                            starts.append(x)
                which = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.array(parts, U64).view(np.int64)), batch.column(0).take(which), batch.column(1).take(which), pa.array(pieces, pa.binary()), batch.column(3).take(which), pa.array(starts, pa.int32())], names=["part", "h", "digest", "string", "least", "start"])

    return hot.select("h", "digest", "string", "least").mapInArrow(cut, "part long, h long, digest long, string binary, least long, start int")


def hot_minimisers(strings: DataFrame, least: int) -> DataFrame:
    """h of more than ``least`` runs and more than a quarter of a partition's share of all: fewer
    than four for each partition, 8 bytes each, so they are broadcast."""
    share = strings.count() // (4 * partitions(strings.sparkSession))
    return strings.groupBy("h").agg(F.count("*").alias("_n")).where(F.col("_n") > max(least, share)).select("h", F.lit(True).alias("_hot"))


def marked_strings(strings: DataFrame, windows: Windows) -> DataFrame:
    """h, digest, least, runs: in each distinct string, the stretches (pairs of 32-bit
    unit numbers) covered by windows that also start in a smaller document than least."""
    spark = strings.sparkSession

    def mark(group: list[bytes], least: np.ndarray) -> list[bytes]:
        classes, counts = windows.classes(group)
        row = np.repeat(np.arange(len(group)), counts)
        lowest = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, classes, least[row])
        hit = lowest[classes] < least[row]
        at = ranges(np.zeros(len(group), np.int64), counts)
        found = np.flatnonzero(hit)
        new = np.append(True, (row[found[1:]] != row[found[:-1]]) | (found[1:] != found[:-1] + 1)) if len(found) else np.zeros(0, bool)
        begin = found[new]
        end = found[np.append(np.flatnonzero(new)[1:], len(found)) - 1] if len(found) else begin
        pairs = np.stack([at[begin], at[end] + windows.width], 1).astype("<i4")
        bound = np.searchsorted(row[begin], np.arange(len(group) + 1))
        return [pairs[bound[k] : bound[k + 1]].tobytes() for k in range(len(group))]

    def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket at a time; the rows come ordered by bucket."""
        held: list[bytes] = []
        least: list[int] = []
        names: list[tuple[int, int]] = []
        starts: list[int] = []
        at = -1

        def flush() -> pa.RecordBatch:
            out = [(np.frombuffer(x, "<i4") + np.int32(s)).tobytes() for x, s in zip(mark(held, np.array(least, np.int64)), starts, strict=True)]
            h, digest = zip(*names, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(digest, pa.int64()), pa.array(least, pa.int64()), pa.array(out, pa.binary())], names=["h", "digest", "least", "runs"])

        for batch in batches:
            for bucket, h, digest, string, low, start in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if bucket != at and held:
                    yield flush()
                    held, least, names, starts = [], [], [], []
                at = bucket
                held.append(string)
                starts.append(start)
                least.append(low)
                names.append((h, digest))
        if held:
            yield flush()

    distinct = strings.groupBy("h", "digest", "string").agg(F.min("doc_id").alias("least"))
    whole = lambda df: df.select(F.col("h").alias("part"), "h", "digest", "string", "least", F.lit(0).alias("start"))
    if windows.hot:
        flagged = distinct.join(F.broadcast(hot_minimisers(strings, windows.hot)), "h", "left")
        parts = whole(flagged.where("_hot is null")).unionByName(by_context(flagged.where("_hot"), windows))
    else:
        parts = whole(distinct)
    bucket = F.pmod("part", F.lit(partitions(spark) * BUCKETS_A_PARTITION)).cast("int")
    placed = parts.select(bucket.alias("bucket"), "h", "digest", "string", "least", "start").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(sort_buckets, "h long, digest long, least long, runs binary")


def covered(docs: DataFrame, windows: Windows) -> DataFrame:
    """rid, doc_id, text, copy (a whole copy of a smaller doc_id), marks (array of
    start, n, runs; without runs the whole n units) for every row of docs."""
    spark = docs.sparkSession
    base = docs.select(row_key("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = base.where("doc_id is not null").select("rid", "doc_id", F.sha2("text", 256).alias("digest"))
    firsts = keyed.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = keyed.join(firsts, "digest").where("doc_id > first").select("rid", "doc_id").distinct()
    shared = shared_minimisers(base, windows, partitions(spark))
    strings = written(super_kmers(base, shared, copies, windows), "super-kmers", settle=True)
    marked = written(marked_strings(strings, windows), "marks", settle=True)
    hits = strings.drop("string").join(marked, ["h", "digest"]).where("doc_id > least or length(runs) > 0")
    marks = hits.groupBy("rid").agg(F.collect_list(F.struct("start", "n", F.when(F.col("doc_id") == F.col("least"), F.col("runs")).alias("runs"))).alias("marks"))
    flags = copies.select("rid", F.lit(True).alias("copy"))
    return base.join(marks, "rid", "left").join(flags, "rid", "left").select("rid", "doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "marks")


def coverage(copy: bool, marks: pa.Scalar, units: int, width: int) -> np.ndarray:
    """Which units of a document its marks cover."""
    out = np.zeros(units + 1, np.int64)
    if copy and units >= width:
        out[0] = 1
    for m in marks.as_py() or ():
        if m["runs"] is None:
            out[m["start"]] += 1
            out[m["start"] + m["n"]] -= 1
        else:
            for a, b in np.frombuffer(m["runs"], "<i4").reshape(-1, 2) + m["start"]:
                out[a] += 1
                out[b] -= 1
    return np.cumsum(out[:units]) > 0
