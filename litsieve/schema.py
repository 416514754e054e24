"""The paper record: one wide, nested, declared schema, and its allowed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enumerations of the data model.
PAPER_TYPES = ["journal_article", "conference_paper", "book", "book_chapter", "thesis", "technical_report", "working_paper", "preprint", "patent", "report", "dataset", "other"]
STUDY_TYPES = ["empirical_qualitative", "empirical_quantitative", "empirical_mixed", "literature_review", "meta_analysis", "conceptual", "editorial", "theoretical", "book_review", "case_study", "unknown"]
QUALITY_TIERS = ["peer_reviewed_journal", "non_peer_reviewed_article", "peer_reviewed_conference", "book_chapter", "working_paper", "preprint", "grey_literature", "unknown"]
DISCOVERY_METHODS = ["file_path", "keyword_search", "backward_citation", "forward_citation", "literature_review_mining", "recommendation", "manual", "api"]
DECISIONS = ["included", "included_manual", "excluded", "excluded_duplicate", "excluded_incomplete", "excluded_manual", "pending", "manual_review", "uncertain"]

PLAIN = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def parts(text: str) -> list[str]:
    """Splits at commas that aren't inside angle brackets."""
    out, depth = [""], 0
    for c in text:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out]


def kind(text: str) -> T.DataType:
    """A type from its text, without a running session."""
    if text.startswith("array<"):
        return T.ArrayType(kind(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(*(n, kind(k))) for n, k in (p.split(": ", 1) for p in parts(text[7:-1]))])
    return PLAIN[text]


AUTHOR = "struct<given_name: string, family_name: string, full_name: string, affiliation: string, orcid: string, email: string>"
CITATION = "struct<doi: string, title: string, year: int, author: string, direction: string, confidence: double>"
SCREENING = (
    "struct<deduplication: struct<is_duplicate: boolean, duplicate_of: string, method: string, similarity: double>,"
    " journal_screening: struct<passed: boolean, acronym: string, iso4: string>,"
    " metadata_screening: struct<passed: boolean, reason: string>,"
    " keyword_screening: struct<passed: boolean, decision: string, study_type: string, score: double, inclusion_keywords: array<string>, exclusion_keywords: array<string>, reason: string>,"
    " semantic_screening: struct<decision: string, score: double, dominant: string>,"
    " relevance_scoring: struct<relevance: double, confidence: double, justification: string>,"
    " final_decision: string, final_decision_by: string>"
)
FIELDS = (
    "ord long, id string, cite_key string, source_key string, doi string, isbn string, issn string, url string, duplicate_of string,"
    f" title string, abstract string, keywords array<string>, authors array<{AUTHOR}>, year int, journal string, journal_acronym string, journal_iso4 string,"
    " booktitle string, publisher string, paper_type string, volume string, issue string, number string, pages string, language string,"
    " title_abstract_embedding array<double>, discovery struct<method: string, iteration: int, source_database: string>,"
    f" screening {SCREENING}, citations array<{CITATION}>, cited_by array<{CITATION}>, pdf_path string, research_method string,"
    " camo array<struct<context: string, action: string, mechanism: string, outcome: string, confidence: double>>, raw string"
)
PAPER = T.StructType([T.StructField(n, kind(k)) for n, k in (p.split(" ", 1) for p in parts(FIELDS))])


def conform(df: DataFrame) -> DataFrame:
    """All columns of the schema, in order: missing ones null, extra ones left out."""
    have = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in PAPER.fields))


def decision() -> Column:
    return F.coalesce(F.col("screening.final_decision"), F.lit("pending"))


def is_included(d: Column | None = None) -> Column:
    return (decision() if d is None else d).isin("included", "included_manual")


def is_excluded(d: Column | None = None, duplicate_of: Column | None = None) -> Column:
    link = F.col("duplicate_of") if duplicate_of is None else duplicate_of
    return (decision() if d is None else d).startswith("excluded") | link.isNotNull()


def is_primary() -> Column:
    return F.col("duplicate_of").isNull()


def undecided() -> Column:
    return ~is_included() & ~is_excluded()


def is_duplicate() -> Column:
    return F.col("duplicate_of").isNotNull() | F.coalesce(F.col("screening.deduplication.is_duplicate"), F.lit(False))


def is_processed() -> Column:
    return (decision() != "pending") & (~is_included() | F.col("pdf_path").isNotNull())


def set_screening(df: DataFrame, **fields: Column) -> DataFrame:
    """Replace fields of the screening struct (which may still be null)."""
    kind = PAPER["screening"].dataType
    old = F.col("screening")
    parts = [(fields[f.name] if f.name in fields else old[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields]
    return df.withColumn("screening", F.struct(*parts))


def decide(df: DataFrame, open_when: Column, value: Column, by: str, **fields: Column) -> DataFrame:
    """Set the final decision where it is still open and a value is given."""
    change = open_when & value.isNotNull()
    return set_screening(
        df,
        final_decision=F.when(change, value).otherwise(F.col("screening.final_decision")),
        final_decision_by=F.when(change, F.lit(by)).otherwise(F.col("screening.final_decision_by")),
        **fields,
    )
