"""Reports: each is one grouped aggregate, with totals by grouping sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import decision, is_included


def count_if(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1)))


def percent(n: Column, total: Column) -> Column:
    return F.round(100.0 * n / total, 1)


def duplicate_stats(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, with key, distinct keys, groups with several rows, largest group."""
    by = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    inner = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("with_key"), F.count("*").alias("unique_keys"), count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("max_per_key"))
    return df.agg(F.count("*").alias("total")).crossJoin(inner)


def duplicate_groups(df: DataFrame, key: str, value: str = "id", collected: bool = True) -> DataFrame:
    by = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), *([F.array_sort(F.collect_list(value)).alias("members")] if collected else []))
    return by.where("n > 1")


def tabulate(df: DataFrame, field: Column, label: int = 30) -> DataFrame:
    """value, n, pct; null is a bucket and long labels are cut."""
    by = df.groupBy(F.substring(F.coalesce(field.cast("string"), F.lit("(none)")), 1, label).alias("value")).agg(F.count("*").alias("n"))
    return by.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def funnel(df: DataFrame, group: Column, **conditions: Column) -> DataFrame:
    """Counts of each condition by group, with the grand total as group ALL."""
    named = df.select(F.coalesce(group, F.lit("Unknown")).alias("group_name"), *(c.alias(n) for n, c in conditions.items()))
    rows = named.rollup("group_name").agg(F.count("*").alias("total"), *(count_if(F.col(n)).alias(n) for n in conditions), F.grouping("group_name").alias("all_groups"))
    return rows.withColumn("group_name", F.when(F.col("all_groups") == 1, "ALL").otherwise(F.col("group_name"))).drop("all_groups")


def screening_funnel(df: DataFrame, by: str = "paper_type") -> DataFrame:
    s = F.col("screening")
    return funnel(
        df, F.col(by), metadata_failed=~s["metadata_screening"]["passed"], keyword_failed=~s["keyword_screening"]["passed"], semantic_failed=s["semantic_screening"]["decision"] == "excluded",
        uncertain=decision() == "uncertain", manual_review=decision() == "manual_review", included=is_included(),
    )


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    out = df.groupBy(row).pivot(column, list(values)).count()
    return out.na.fill(0, list(values))


def distribution(counts: DataFrame, n: str = "n_in") -> DataFrame:
    """How many rows have each count, and their share."""
    by = counts.groupBy(n).agg(F.count("*").alias("rows_with"))
    return by.withColumn("pct", percent(F.col("rows_with"), F.sum("rows_with").over(Window.partitionBy())))


def completeness(df: DataFrame) -> DataFrame:
    has = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    words = F.coalesce(F.size("keywords") > 0, F.lit(False))
    return df.agg(F.count("*").alias("papers"), count_if(words).alias("with_keywords"), count_if(has("abstract")).alias("with_abstract"), count_if(words & has("abstract")).alias("with_both"), count_if(F.col("pdf_path").isNotNull()).alias("with_pdf"), count_if(has("doi")).alias("with_doi"))


def summary(df: DataFrame) -> DataFrame:
    """One row of totals and distinct counts over the exploded lists."""
    base = df.agg(F.count("*").alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), count_if(F.col("doi").isNotNull()).alias("with_doi"), count_if(F.col("abstract").isNotNull()).alias("with_abstract"))
    people = df.select(F.explode("authors.full_name").alias("x")).agg(F.count("*").alias("author_mentions"), F.countDistinct("x").alias("distinct_authors"))
    words = df.select(F.explode("keywords").alias("x")).agg(F.countDistinct("x").alias("distinct_keywords"))
    return base.crossJoin(people).crossJoin(words)


def included_by_iteration_year(df: DataFrame) -> DataFrame:
    kept = df.where(is_included()).groupBy(F.col("discovery.iteration").alias("iteration"), F.coalesce("year", F.lit(0)).alias("year")).agg(F.count("*").alias("n"))
    return kept.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy()))).orderBy(F.desc("iteration"), F.desc("year"))


def citation_stats(df: DataFrame) -> DataFrame:
    """Papers, citations and those with DOI by iteration, and the total as null."""
    rows = df.select("id", F.col("discovery.iteration").alias("iteration"), F.explode_outer("citations").alias("c"))
    return rows.rollup("iteration").agg(F.countDistinct("id").alias("papers"), F.count("c").alias("citations"), F.count("c.doi").alias("with_doi"))


def bar(n: Column, most: Column, width: int = 40) -> Column:
    return F.repeat(F.lit("#"), F.ceil(n / most * width).cast("int"))
