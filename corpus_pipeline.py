"""A training-corpus pipeline out of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns documents with their own columns; the
last returns a row of figures and digests for each document that is left. A stage works
on all that its predecessor kept, and its decisions take effect:

1. language ID: documents go that are of none of the learnt languages
2. MinHash near-dedup: one document of each group stays (five-word shingles, 0.8)
3. substring dedup: words go that a 50-word window repeats from a smaller doc_id
4. benchmark decontamination: documents go that hold a benchmark window
5. byte-level BPE: what is left is encoded and decoded

Defined for all stages: an empty table gives an empty one; texts are taken whole, whatever
their length; other columns pass unchanged, whatever their names, as a row travels as one
struct beside the operator's own columns. Each stage says what it does with nulls, ties
and repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm import byte_bpe, decontamination, language_id, near_dedup, substring_dedup
from litsieve.llm.shared import row_key


def packed(docs: DataFrame) -> DataFrame:
    """rid, row: every row as a struct beside its key."""
    return docs.select(row_key("doc_id", "text").alias("rid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without text or letters go, and rows whose text is likelier random pieces than of
    any learnt language, by a documented margin (see ``language_id.accepted``): gibberish, or
    a language that no label taught. Null doc_ids and langs aren't learnt from and are
    judged as any others; repeated rows are judged alike. Without any labels, rows with
    letters stay."""
    return language_id.accepted(docs, public_tokenizers.path("piece_bpe_32k.model"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays; of several
    with that doc_id, and of repeated rows, one by a fixed order. Rows with null doc_id,
    and rows without words, are in no group and all stay."""
    return near_dedup.first_of_group(docs, size=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose words are their kept words, joined by one space, with their new
    n_chars; others stay as they are. A document that loses all its words goes. Rows with
    null doc_id or text lose nothing; rows of one doc_id don't take from each other, and
    repeated rows stay alike."""
    changed = substring_dedup.changed_texts(docs)
    left = packed(docs).join(changed.select("rid", "kept"), "rid", "left").where("kept is null or kept <> ''")

    def column(name: str) -> Column:
        old = F.col(f"row.`{name}`")
        if name == "text":
            return F.coalesce("kept", old).alias(name)
        if name == "n_chars":
            return F.when(F.col("kept").isNull(), old).otherwise(F.length("kept").cast(docs.schema[name].dataType)).alias(name)
        return old.alias(name)

    return left.select(*map(column, docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose text holds a window of ten words of a benchmark item, or a shorter item
    whole. Rows without text stay, as do all if there is no item; null doc_ids are searched
    as any others, and repeated rows share their fate."""
    found = decontamination.find_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = found.where("contaminated").select("rid").distinct()
    return packed(docs).join(leaks, "rid", "left_anti").select("row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes of every row. A null
    text counts as empty; null and repeated doc_ids each get their rows."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", bpe_stage),
]

#: Classifiers and sketches are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
