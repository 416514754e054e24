"""Vector arithmetic on array columns: folds inside the JVM, in double precision; all
against all in Arrow blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Vectors of a block; a pair of blocks is one row.
BLOCK = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of unequal length, 0 if one is zero."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(size == 0, 0.0).otherwise(dot(a, b) / size)


def cosine_clamped(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))


def cosine_unit(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(a, b) + 1) / 2))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def mean_vectors(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """Elementwise mean of each group's vectors (partial sums before the shuffle)."""
    long = df.select(*by, F.posexplode(vector).alias("pos", "x"))
    each = long.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean_vector"))


def _unit(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    ids, vectors = rows.flatten()
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    size = np.sqrt((x * x).sum(1))
    return ids, x / np.where(size == 0, 1, size)[:, None]


def _nearest(a: pa.StructArray, b: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """Ids of a, and the greatest cosine of each with any of b of another id (-inf: none)."""
    (ids, x), (others, y) = _unit(a), _unit(b)
    if x.shape[1] != y.shape[1]:
        return ids, np.full(len(ids), -np.inf)
    return ids, np.where(ids.to_numpy()[:, None] == others.to_numpy(), -np.inf, x @ y.T).max(1)


def nearest_other(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """vec_id, best: for each row (vec_id, v), the greatest cosine with any row of another
    vec_id whose vector is as long, 0 if one is zero. Every block is compared with every
    block, so the work grows with the square of the table."""
    count = max(1, -(-df.count() // block))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias("k")
    # a block holds vectors of one length
    blocks = df.where("v is not null").groupBy(F.size("v").alias("size"), number).agg(F.collect_list(F.struct("vec_id", "v")).alias("a")).select("a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                ids, near = _nearest(a.values, b.values)
                seen = np.isfinite(near)
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(seen)), pa.array(near[seen])], names=["vec_id", "best"])

    blocks = blocks.coalesce(2 * math.ceil(math.sqrt(count)))  # a task for each pair of partitions
    pairs = blocks.crossJoin(blocks.withColumnRenamed("a", "b"))
    return pairs.mapInArrow(compare, "vec_id long, best double").groupBy("vec_id").agg(F.max("best").alias("best"))


def lonely_in_group(df: DataFrame, below: float, block: int = 4 * BLOCK) -> DataFrame:
    """vec_id, best of the rows (vec_id, v, label) whose ``nearest_other`` among the rows of
    their label is under a bound. A row that has met one at the bound within its block is done;
    only the others are compared with all rows of their label. A vec_id that has several
    rows is judged by the nearest of them all."""
    rows = df.where("label is not null and not exists(v, x -> x is null)").select("vec_id", "v", "label", F.size("v").alias("size"))
    counts = rows.groupBy("label", "size").agg(F.ceil(F.count("*") / block).alias("count"))
    kind = "vec_id long, v array<double>, label int, size int, best double"

    def blocks(x: DataFrame, name: str) -> DataFrame:
        number = F.pmod(F.xxhash64("vec_id"), "count").alias("k")
        return x.join(counts, ["label", "size"]).groupBy("label", "size", number).agg(F.collect_list(F.struct("vec_id", "v")).alias(name))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, label, size in zip(batch.column("a"), batch.column("label"), batch.column("size"), strict=True):
                ids, near = _nearest(a.values, a.values)
                yield pa.RecordBatch.from_arrays([*a.values.flatten(), pa.repeat(label, len(ids)), pa.repeat(size, len(ids)), pa.array(near)], names=["vec_id", "v", "label", "size", "best"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                ids, near = _nearest(a.values, b.values)
                yield pa.RecordBatch.from_arrays([ids, pa.array(near)], names=["vec_id", "best"])

    each = blocks(rows, "a")
    # read twice, not worked out twice; a margin, as products of other blocks may round otherwise
    first = written(each.mapInArrow(within, kind), "nearest")
    open_ids = first.groupBy("vec_id").agg(F.max("best").alias("best")).where(F.col("best") < below + 1e-6).select("vec_id")
    left = first.join(open_ids, "vec_id", "left_semi").drop("best")
    pairs = blocks(left, "a").drop("k").join(each.withColumnRenamed("a", "b").drop("k"), ["label", "size"])
    best = pairs.select("a", "b").mapInArrow(compare, "vec_id long, best double").groupBy("vec_id").agg(F.max("best").alias("best"))
    return best.where(F.col("best") > float("-inf"))
