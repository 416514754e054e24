"""Comparisons of classifiers, candidate lists, audits: joins and grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import count_if


def by_method(results: DataFrame, item: str, method: str, value: str, methods: Sequence[str]) -> DataFrame:
    """One row an item, one column a method."""
    return results.groupBy(item).pivot(method, list(methods)).agg(F.first(value, ignorenulls=True))


def agreement(results: DataFrame, item: str, method: str, value: str) -> DataFrame:
    """first, second, n, percent: how often two methods say the same of an item."""
    left = results.select(item, F.col(method).alias("first"), F.col(value).alias("_x"))
    right = results.select(item, F.col(method).alias("second"), F.col(value).alias("_y"))
    both = left.join(right, item).where("first < second")
    return both.groupBy("first", "second").agg(F.count("*").alias("n"), F.round(F.avg(F.col("_x").eqNullSafe(F.col("_y")).cast("double")) * 100, 4).alias("percent"))


def latencies(results: DataFrame, method: str, seconds: str) -> DataFrame:
    x = F.col(seconds)
    return results.groupBy(method).agg(F.count("*").alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.avg(x), 6).alias("mean"), F.round(F.sum(x), 4).alias("total"))


def accuracy(results: DataFrame, truth: DataFrame, item: str, method: str, value: str, right: str) -> DataFrame:
    """Share of right answers by method, over items whose truth is known."""
    both = results.join(truth.select(item, F.col(right).alias("_truth")), item)
    return both.groupBy(method).agg(F.count("*").alias("n"), F.round(F.avg((F.col(value) == F.col("_truth")).cast("double")), 6).alias("accuracy"))


def mismatches(results: DataFrame, truth: DataFrame, item: str, value: str, right: str) -> DataFrame:
    both = results.join(truth.select(item, F.col(right).alias("truth")), item)
    return both.where(~F.col(value).eqNullSafe(F.col("truth")))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The most frequent values; of equally frequent ones the least."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), column).limit(n)


def ranked(df: DataFrame, column: str, order: Sequence[object], *then: Column) -> DataFrame:
    """Sorted by the place of a value in a list (others last), then by other keys."""
    rank = F.lit(len(order))
    for k, value in reversed(list(enumerate(order))):
        rank = F.when(F.col(column) == value, k).otherwise(rank)
    return df.orderBy(rank, *then)


def eligible_for_references(papers: DataFrame, screened: DataFrame, key: str, stage: str, stages: Sequence[str]) -> DataFrame:
    """Papers with a DOI whose screening is at one of the stages."""
    return papers.where("doi is not null").join(screened.where(F.col(stage).isin(list(stages))), key)


def split_references(papers: DataFrame, key: str = "id", references: str = "references") -> tuple[DataFrame, DataFrame]:
    """References with a DOI and those without, each with its place from 1 on."""
    each = papers.select(key, F.posexplode(references).alias("at", "reference")).withColumn("at", F.col("at") + 1)
    known = F.coalesce(F.trim("reference.doi") != "", F.lit(False))
    return each.where(known), each.where(~known)


def to_fetch(papers: DataFrame, path: str, *order: Column) -> tuple[DataFrame, DataFrame]:
    """Papers without a file, in order with nulls last, and papers that have one."""
    return papers.where(F.col(path).isNull()).orderBy(*order), papers.where(F.col(path).isNotNull())


def stage_summary(screened: DataFrame, stage: str, similarity: str, prefix: str) -> DataFrame:
    """One row: counts of a stage's outcomes and figures of its similarities."""
    here = F.col(stage).startswith(prefix)
    x = F.when(here, F.col(similarity))
    return screened.agg(
        count_if(here).alias("processed"), count_if(F.col(stage) == f"{prefix}pass").alias("passed"), count_if(F.col(stage) == f"{prefix}review").alias("review"), count_if(F.col(stage) == f"{prefix}fail").alias("failed"),
        F.round(F.avg(x), 4).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"),
    )


def cache_audit(cache: DataFrame, payload: str = "payload") -> DataFrame:
    """By year (null for none): entries, those that aren't JSON, those with references."""
    good = F.try_parse_json(F.col(payload)).isNotNull()
    year = F.when(good, F.get_json_object(payload, "$.year").try_cast("int"))
    refs = F.coalesce(F.get_json_object(payload, "$.references[0]").isNotNull() & good, F.lit(False))
    return cache.groupBy(year.alias("year")).agg(F.count("*").alias("entries"), count_if(~good).alias("broken"), count_if(refs).alias("with_references"))


def chunk_hits(chunks: DataFrame, vectors: DataFrame, papers: DataFrame, score: Column, k: int) -> DataFrame:
    """Chunks with their vectors and papers, the k with the greatest score."""
    both = chunks.join(vectors, "chunk_id").join(papers, "paper_id").withColumn("score", score)
    return both.orderBy(F.desc("score"), "chunk_id").limit(k)


def similar(df: DataFrame, score: Column, threshold: float, k: int, tie: str) -> DataFrame:
    """Rows from a threshold on, the k best."""
    return df.withColumn("score", score).where(F.col("score") >= threshold).orderBy(F.desc("score"), tie).limit(k)
