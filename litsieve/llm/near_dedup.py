"""MinHash near-dedup: one-permutation hashing, optimal densification, star candidates.

A document's set is its distinct word shingles (64-bit fingerprints). Rows with equal
sets are one class from the start. Each class gets one signature: a shingle's top bits
name its bin and the least shingle of a bin is the bin's value; an empty bin borrows
the value of a full one, found by a universal hash of bin and attempt. Bands of bins
are buckets. A bucket's centre is the class that meets most others over all its buckets
(an original rather than one of its variants), and the others are its rays, so a bucket
of n classes gives n - 1 candidate pairs, and each pair is confirmed on the full sets.

Rays that their centre didn't bring into one component may still be linked with each
other. Two sets differ in what their differences from the centre differ in, so rays a and b
are linked only if their difference sets D share enough elements:

    2 * |D(a) & D(b)| >= |D(a)| + |D(b)| - k * (|a| + |b|),  k = (100 - percent) / (100 + percent)

A ray that isn't linked with the centre has a large D, so it needs many in common with any
other. That is a prefix filter: with the elements of a centre's rays in one order, rare
ones first, a linked pair shares one of the first |D| - need + 1 of both. As most of a copy's
differences are its own, few of these are shared, and few pairs are left to confirm in a
group of any size. No pair is lost by it: rays of a centre whose pair isn't generated are
connected already, or can't be linked. The elements that are in all variants' reach are
still shared by a part of them all, so a pair that meets must also pass its bits: each ray
has 1,024, each telling whether an odd number of D's elements fall on it. A bit in which a
and b are unlike needs an element that only one of them has, so they are linked only if

    number of unlike bits <= k * (|a| + |b|)

which is as exact, and leaves hardly a pair that isn't linked, up to sets of some thousand.

Components are found on the cluster by pointing to the least neighbour, pointer jumping, and
going on with the links between what is left; nothing but counts goes to the driver.

Defined cases: texts without words (or null) have empty sets and are linked with nothing;
a null doc_id is linked with nothing and is its own (null) component; repeated rows and
rows with equal doc_id are linked as any others and each get a row; an empty table has no
rows; a text of any length is one set; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, row_key, written
from .vec import LOWER, U64, ascii_words, chunks, mix, span_hashes

BINS = 256
#: 64-bit words of a ray's bits.
WORDS = 16
BANDS = 42
ROWS = 6
#: Probes that are tried one by one, and those that are tried at once for what is left.
ATTEMPTS, MORE_ATTEMPTS = 64, 4096


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of every row."""
    low = LOWER[buf]
    starts, ends, bounds = ascii_words(low, off)
    if not len(starts):
        return [np.zeros(0, U64)] * (len(off) - 1)
    h = span_hashes(low, starts, ends)
    grams = h[: max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        grams = mix(grams * U64(0xA24BAED4963EE407) + h[k : k + len(grams)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(grams[a : b - size + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:  # the whole sequence is one shingle; its length tells it from others
            whole = U64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    whole = mix(np.array([whole * U64(0xA24BAED4963EE407) + x]))[0]
            out.append(np.array([whole], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


_probe = (mix(np.arange(BINS * MORE_ATTEMPTS, dtype=U64) + U64(0x5851F42D4C957F2D)) % U64(BINS)).astype(np.int16).reshape(MORE_ATTEMPTS, BINS)


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation MinHash with optimal densification, of a set that isn't empty."""
    bins = (s >> U64(64 - BINS.bit_length() + 1)).astype(np.int64)
    new = np.append(True, bins[1:] != bins[:-1])
    if new.sum() == 1:  # every probe ends in the one full bin
        return np.full(BINS, s[0])
    out, full = np.zeros(BINS, U64), np.zeros(BINS, bool)
    out[bins[new]], full[bins[new]] = s[new], True
    empty = np.flatnonzero(~full)
    for attempt in range(ATTEMPTS):
        if not len(empty):
            break
        donor = _probe[attempt, empty]
        good = full[donor]
        out[empty[good]] = out[donor[good]]
        empty = empty[~good]
    if len(empty):  # few full bins: with two, a probe in 10 ** 13 finds none
        donor = _probe[ATTEMPTS:, empty]
        out[empty] = out[donor[full[donor].argmax(0), np.arange(len(empty))]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=U64)
    for k in range(ROWS):
        key = mix(key * U64(0xA24BAED4963EE407) + parts[:, k])
    return key


def digests(base: DataFrame, size: int) -> DataFrame:
    """rid, doc_id, n_shingles and a 128-bit digest of the set of every row."""
    import hashlib

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in chunks(batch):
                sets = shingle_sets(buf, off, size)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in range(2)), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())],
                    names=["rid", "doc_id", "n_shingles", "digest"],
                )

    return base.select("rid", "doc_id", "text").mapInArrow(rows, "rid binary, doc_id long, n_shingles long, digest binary")


def bucket_rows(texts: DataFrame, size: int) -> DataFrame:
    """bucket, id, n of every band of every class (id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, buf, off in chunks(batch):
                sets = shingle_sets(buf, off, size)
                some = [k for k, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                keys = np.concatenate([band_keys(signature(sets[k])) for k in some])
                n = np.array([len(sets[k]) for k in some], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(ids[a + np.array(some)], BANDS)), pa.array(np.repeat(n, BANDS))], names=["bucket", "id", "n"])

    return texts.select("id", "text").mapInArrow(rows, "bucket long, id long, n int")


def set_rows(texts: DataFrame, size: int) -> DataFrame:
    """id and its set as bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in chunks(batch):
                sets = shingle_sets(buf, off, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(rows, "id long, shingles binary")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the sets left and right."""
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
    return with_b.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a").select(*pairs.columns, "left", "right")


def shared_count(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of right's members left has."""
    return left[np.minimum(np.searchsorted(left, right), len(left) - 1)] == right


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = int(shared_count(left, right).sum())
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return written(with_sets(pairs.select("a", "b"), sets).mapInArrow(rows, "a long, b long"), "confirmed")


def least_neighbours(edges: DataFrame) -> DataFrame:
    """id, component of everything in edges: the end of the path from each to its least
    neighbour, to that one's, and so on. A table of its own."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component"))
    over = lambda x: x.join(x.select(F.col("id").alias("component"), F.col("component").alias("above")), "component")
    table = None
    while True:
        up = over(up).select("id", F.col("above").alias("component"))
        new = written(over(up).select("id", F.col("component").alias("was"), F.col("above").alias("component")), "labels")
        if table is not None:
            discard(table)
        table, up = new, new.select("id", "component")
        if new.where("was <> component").isEmpty():
            return table


def renamed(edges: DataFrame, label: DataFrame) -> DataFrame:
    """a, b of edges (in order, once each), with both ends' components in their place; what
    is within one component is left out."""
    of = lambda x: label.select(F.col("id").alias(x), F.col("component").alias(f"{x}_in"))
    ends = edges.join(of("b"), "b", "left").join(of("a"), "a", "left").select(F.coalesce("a_in", "a").alias("x"), F.coalesce("b_in", "b").alias("y"))
    return ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def relabelled(label: DataFrame, over: DataFrame) -> DataFrame:
    """label, whose components are members of components in over."""
    above = over.select(F.col("id").alias("component"), F.col("component").alias("above"))
    return label.join(above, "component", "left").select("id", F.coalesce("above", "component").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """id, component (its least member) of everything in links (a, b). Each round leaves at
    most half of a component's members, and only the links between these."""
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    label = None
    while True:
        over = least_neighbours(edges)
        left = written(renamed(edges, over), "links")
        discard(edges)
        label = over.select("id", "component") if label is None else relabelled(label, over)
        edges = left
        if edges.isEmpty():
            discard(edges)
            return label


def similar(x: str, y: str, percent: int) -> str:
    """Sizes of sets that may reach the threshold."""
    return f"100L * least({x}, {y}) >= {percent} * greatest({x}, {y})"


def star_rays(keyed: DataFrame) -> DataFrame:
    """c, id, nc, n: the centre and another class of a bucket, with their sizes, once each.
    A bucket's centre is who meets most others. keyed, a written table, is deleted."""
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = written(keyed.join(sizes, "bucket"), "shared", settle=True)
    discard(keyed)
    popular = shared.groupBy("id").agg(F.sum("members").alias("met"))
    met = written(shared.join(popular, "id").select("bucket", "id", "n", F.struct((-F.col("met")).alias("rank"), "id", "n").alias("key")), "members")
    heads = met.groupBy("bucket").agg(F.min("key").alias("head"))
    rays = met.join(heads, "bucket").where("id <> head.id").select(F.col("head.id").alias("c"), "id", F.col("head.n").alias("nc"), "n").distinct()
    out = written(rays, "rays", settle=True)
    discard(shared, met)
    return out


def differences(rays: DataFrame, sets: DataFrame) -> DataFrame:
    """c, id, nc, n, component, at (the centre's component), d, elements, bits: the elements
    that one of a ray and its centre has (named together with the centre), their number, and
    for each of some bits whether an odd number of elements fall on it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, elements, bits = [], [], [np.zeros(0, np.int64)]
            for c, x, y in zip(batch.column(0).to_pylist(), batch.column(6), batch.column(7), strict=True):
                left, right = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                apart = np.concatenate([left[~shared_count(right, left)], right[~shared_count(left, right)]])
                number.append(len(apart))
                named = mix(apart ^ mix(np.array([c], np.int64).view(U64)))
                elements.append(named.view(np.int64))
                odd = np.bincount((named & U64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            at = np.append(0, np.cumsum(number))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*elements, np.zeros(0, np.int64)])))
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(number) + 1) * WORDS, pa.int32()), pa.array(np.concatenate(bits)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(number, pa.int32()), lists, words], names=["c", "id", "nc", "n", "component", "at", "d", "elements", "bits"])

    named = rays.select(F.col("c").alias("a"), F.col("id").alias("b"), "nc", "n", "component", "at")
    return with_sets(named, sets).mapInArrow(rows, "c long, id long, nc int, n int, component long, at long, d int, elements array<long>, bits array<long>")


def ray_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """a, b: rays of one centre, of different components, that may be linked, by the prefix
    filter on their differences from the centre and by their bits (all numbers are whole:
    bounds are exact)."""
    p, q = 100 + percent, 100 - percent
    up = lambda x, by: -F.floor(-x / F.lit(by))
    largest = lambda n: F.floor(100 * F.col(n) / percent)
    excess = p * F.col("d").cast("long") - q * F.col("n").cast("long")
    far = excess > q * F.col("nc")
    with_far = up(excess + q * F.col("nc") + 1, 2 * p)
    by_size = lambda most: up(excess - q * most, p)
    one = F.lit(1).cast("long")
    rays = apart.withColumn("far", far).withColumn("need_far", F.when(far, F.greatest(one, with_far, by_size(largest("n")))).otherwise(F.greatest(one, with_far)))
    # against rays near the centre; a near ray needs the same against every far one
    rays = rays.withColumn("need_near", F.when(far, F.greatest(one, by_size(F.least(largest("n"), largest("nc"))))).otherwise(F.col("need_far")))
    rays = rays.where("d >= least(need_far, need_near)")
    each = rays.select("c", "id", "n", "component", "at", "d", "far", "need_far", "need_near", F.explode("elements").alias("t"))
    met = each.groupBy("t").agg(F.count("*").alias("times"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("t", "times")
    # elements in rays of one component only are first in order: no pair needs them
    of = F.collect_list(F.struct("times", "t"))
    first = each.join(met, "t").groupBy("c", "id", "n", "component", "at", "d", "far", "need_far", "need_near").agg(F.array_sort(of).alias("shared"))
    own = F.col("d") - F.size("shared")
    first = first.join(apart.select("c", "id", "bits"), ["c", "id"])
    listed = first.select("id", "n", "component", "at", "far", "bits", (F.col("d") - F.col("need_far") + 1 - own).alias("to_far"), (F.col("d") - F.col("need_near") + 1 - own).alias("to_near"), F.posexplode("shared").alias("k", "e"))
    listed = listed.where("k < greatest(to_far, to_near)").select("id", "n", "component", "at", "far", "bits", (F.col("k") < F.col("to_far")).alias("pre_far"), (F.col("k") < F.col("to_near")).alias("pre_near"), F.col("e.t").alias("t"))
    listed = written(listed, "prefixes")
    left = listed.where("far").select("t", F.col("id").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), "at", F.col("bits").alias("x"), F.col("pre_far").alias("a_far"), F.col("pre_near").alias("a_near"))
    right = listed.select("t", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), "far", F.col("bits").alias("y"), "pre_far")
    both = (F.col("far") & F.col("a_far") & F.col("pre_far") & (F.col("a") < F.col("b"))) | (~F.col("far") & F.col("a_near") & F.col("pre_far") & (F.col("ca") != F.col("at")))
    unlike = sum((F.bit_count(F.get("x", F.lit(k)).bitwiseXOR(F.get("y", F.lit(k)))) for k in range(WORDS)), F.lit(0))
    within = p * unlike <= q * (F.col("na") + F.col("nb"))
    met = left.join(right, "t").where(both & (F.col("ca") != F.col("cb"))).where(similar("na", "nb", percent)).where(within)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_classes(texts: Callable[[DataFrame], DataFrame], classes: DataFrame, size: int, percent: int) -> DataFrame:
    """id, component of the classes (id) that are linked with another; texts gives id, text of
    some of the classes."""
    rays = star_rays(written(bucket_rows(texts(classes), size), "bands", settle=True))
    # all that is compared from here on is a ray or a centre
    ids = rays.select("id").union(rays.select("c")).distinct()
    sets = written(set_rows(texts(classes.join(ids, "id", "left_semi")), size), "sets", settle=True)
    stars = rays.where(similar("n", "nc", percent)).select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b")).distinct()
    links = confirmed(stars, sets, percent)
    label = components(links)
    # centres with rays of several components
    named = rays.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    at = label.select(F.col("id").alias("c"), F.col("component").alias("at"))
    named = written(named.join(at, "c", "left").withColumn("at", F.coalesce("at", "c")), "rays")
    several = named.groupBy("c").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("c")
    mixed = named.join(several, "c", "left_semi").select("c", "id", "nc", "n", "component", "at")
    apart = written(differences(mixed, sets), "differences", settle=True)
    fresh = confirmed(ray_pairs(apart, percent).join(stars, ["a", "b"], "left_anti"), sets, percent)
    discard(apart, named, rays, sets)
    if fresh.isEmpty():
        return label
    # those without a label are linked by these only
    more = components(renamed(fresh, label))
    alone = more.join(label, "id", "left_anti")
    return relabelled(label, more).unionByName(alone)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, the row's key, and whether it leads
    its group."""
    base = docs.select(row_key("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(digests(base, size), "rows")
    some = rows.where("doc_id is not null and n_shingles > 0")
    classes = some.groupBy("digest").agg(F.min(F.struct("doc_id", "rid")).alias("first"))
    # numbered once, in the written table: an id names one class
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "digest", "first.doc_id", "first.rid"), "classes")
    # repeated rows share a key: one of them is read
    texts = lambda some: base.join(some.select("rid", "id"), "rid").dropDuplicates(["rid"]).select("id", "text")
    label = linked_classes(texts, classes, size, percent)
    of = classes.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = of.groupBy("component").agg(F.min(F.struct("doc_id", "rid")).alias("head"))
    by_digest = of.join(least, "component").select("digest", "head")
    linked = some.join(by_digest, "digest").select("doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), (F.col("doc_id") == F.col("head.doc_id")).alias("kept"), "rid", (F.col("rid") == F.col("head.rid")).alias("leads"))
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "rid", F.lit(True).alias("leads"))
    return linked.unionByName(alone)


def first_of_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each group; rows without words or doc_id all stay. Of repeated
    rows with other columns unlike, the one with the least of these (as JSON) stays."""
    found = near_duplicates(docs, size, percent).where("leads").select("rid", (F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).alias("every")).distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key("doc_id", "text").alias("rid"), _order(docs).alias("nth"))
    joined = whole.join(found, "rid")
    one = joined.where("not every").groupBy("rid").agg(F.min_by("row", "nth").alias("row"))
    return one.select("row.*").unionByName(joined.where("every").select("row.*"))


def _order(docs: DataFrame) -> Column:
    """What tells rows of one doc_id and text apart."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))), {"ignoreNullFields": "false"})
