"""DOIs, citation keys, names and journal abbreviations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import collapse, literal_map, title_case, trimmed

# Journal-title abbreviation.
ISO4_STOP = [
    "and", "or", "the", "a", "an", "of", "in", "to", "for", "on", "at", "by", "with", "from", "as", "is", "are", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "must", "can",
]
ISO4_ACRONYMS = {"ieee": "IEEE", "acm": "ACM", "mis": "MIS", "vhb": "VHB", "ais": "AIS"}
ISO4_WORDS = {
    "journal": "J.", "transactions": "Trans.", "international": "Int.", "european": "Eur.", "american": "Am.", "british": "Br.", "proceedings": "Proc.", "letters": "Lett.", "studies": "Stud.", "systems": "Syst.", "science": "Sci.",
    "management": "Manag.", "organization": "Organ.", "business": "Bus.", "technology": "Technol.", "information": "Inf.", "research": "Res.", "review": "Rev.", "quarterly": "Q.", "annual": "Ann.", "archive": "Arch.", "engineering": "Eng.",
    "environmental": "Environ.", "sustainable": "Sustain.", "sustainability": "Sustain.", "development": "Dev.", "advances": "Adv.", "economics": "Econ.", "electronic": "Electron.", "production": "Prod.",
}


def doi_stem(x: Column) -> Column:
    """The normalised DOI, or null if it isn't one."""
    stem = F.regexp_replace(F.lower(F.trim(x)), r"^(https?://doi\.org/|doi[:.])", "")
    return F.when(stem.rlike(r"^10\.[^/]*/.+"), stem)


def doi_url(stem: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), stem)


def doi_safe(stem: Column) -> Column:
    return F.regexp_replace(stem, r"[/.:()]+", "_")


def doi_key(stem: Column) -> Column:
    return F.concat(F.lit("doi_"), F.substring(F.md5(stem), 1, 8))


def split_name(name: Column) -> Column:
    """Last, First or First Last as a struct of given, family and full name."""
    name = collapse(name)
    comma = name.contains(",")
    family = F.when(comma, F.trim(F.substring_index(name, ",", 1))).otherwise(F.substring_index(name, " ", -1))
    given = F.when(comma, F.trim(F.regexp_extract(name, r"^[^,]*,(.*)$", 1))).otherwise(F.trim(F.regexp_extract(name, r"^(.*)\s\S+$", 1)))
    given = F.when(given != "", given)
    none = F.lit(None).cast("string")
    return F.struct(given.alias("given_name"), family.alias("family_name"), F.concat_ws(" ", given, family).alias("full_name"), none.alias("affiliation"), none.alias("orcid"), none.alias("email"))


def parse_authors(x: Column) -> Column:
    """Names joined by and, as an array of author structs."""
    return F.transform(F.filter(trimmed(F.split(x, r"(?i)\s+and\s+")), lambda n: n != ""), lambda n: split_name(title_case(n)))


def author_string(authors: Column) -> Column:
    family = lambda k: F.get(authors, F.lit(k))["family_name"]
    n = F.coalesce(F.size(authors), F.lit(0))
    return F.when(n <= 0, "Unknown").when(n == 1, family(0)).when(n == 2, F.concat(family(0), F.lit(" & "), family(1))).otherwise(F.concat(family(0), F.lit(" et al.")))


def apa(authors: Column, year: Column, title: Column, journal: Column, volume: Column, number: Column, pages: Column, doi: Column) -> Column:
    """A reference line; absent parts are left out."""
    names = F.transform(authors, lambda a: a["full_name"])
    n = F.coalesce(F.size(authors), F.lit(0))
    who = F.when(n <= 0, F.lit(None).cast("string")).when(n <= 3, F.array_join(names, " & ")).otherwise(F.concat(F.get(names, F.lit(0)), F.lit(" et al.")))
    issue = F.concat(volume, F.coalesce(F.concat(F.lit("("), number, F.lit(")")), F.lit("")))
    venue = F.concat_ws(", ", journal, issue, pages)
    return F.concat_ws(" ", who, F.concat(F.lit("("), year.cast("string"), F.lit(").")), F.concat(title, F.lit(".")), F.when(venue != "", F.concat(venue, F.lit("."))), doi_url(doi))


def quality_score(title: Column, keywords: Column, abstract: Column) -> Column:
    """Completeness: 0.20, and 0.20, 0.25 and 0.25 for title, keywords and abstract."""
    has = lambda x: F.coalesce(F.length(F.trim(x)) > 0, F.lit(False))
    part = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    total = F.lit(0.20) + part(has(title), 0.20) + part(F.coalesce(F.size(keywords) > 0, F.lit(False)), 0.25) + part(has(abstract), 0.25)
    return F.round(F.least(F.lit(1.0), total), 2)


def citation_confidence(asserted: Column, doi: Column, title: Column, year: Column) -> Column:
    part = lambda c, w: F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    total = F.lit(0.5) + part(doi.isNotNull(), 0.35) + part(F.length(title) > 10, 0.10) + part(year.isNotNull(), 0.05)
    return F.when(asserted, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), total), 2))


def iso4(x: Column) -> Column:
    """Abbreviated journal title, or null if nothing is left."""
    separated = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "-", " "), "&", " and "), "/", " or ")
    words = F.filter(F.regexp_extract_all(separated, F.lit(r"\b([a-zA-Z]+)\b"), 1), lambda w: ~F.lower(w).isin(ISO4_STOP))
    special = literal_map(ISO4_ACRONYMS | ISO4_WORDS)

    def short(w: Column) -> Column:
        start = F.when(F.length(w) <= 4, w).otherwise(F.substring(w, 1, 3))
        plain = F.concat(F.upper(F.substring(start, 1, 1)), F.lower(F.substring(start, 2, 9)), F.lit("."))
        return F.coalesce(F.element_at(special, F.lower(w)), plain)

    line = F.array_join(F.transform(words, short), " ")
    return F.when(F.size(words) > 0, F.when(line.endswith("."), line).otherwise(F.concat(line, F.lit("."))))


def cite_key_base(family: Column, year: Column) -> Column:
    return F.concat(F.regexp_replace(family, r"[\s-]", ""), year.cast("string"))


def suffix(index: Column) -> Column:
    """a..z, aa..az, aaa..: letters of the index, and one more a for each round."""
    letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(index, F.lit(26)) + 1, F.lit(1))
    return F.concat(F.repeat(F.lit("a"), F.floor(index / 26).cast("int")), letter)


def resolve_cite_keys(df: DataFrame, base: str = "base_key", order: str = "ord", taken: DataFrame | None = None) -> DataFrame:
    """Adds cite_key: the first row of a base keeps it (unless taken), others get the next
    free suffix. Keys that are taken, or someone's base, are skipped, however many."""
    busy = df.select(F.col(base).alias("cite_key")).distinct()
    if taken is not None:
        busy = busy.unionByName(taken.select("cite_key")).distinct()
    rank = F.row_number().over(Window.partitionBy(base).orderBy(order)) - 1
    out = df.withColumn("_rank", rank)
    if taken is not None:
        known = taken.select(F.col("cite_key").alias(base), F.lit(1).alias("_taken")).distinct()
        out = out.join(known, base, "left").withColumn("_rank", F.col("_rank") + F.coalesce("_taken", F.lit(0))).drop("_taken")
    need = out.groupBy(base).agg(F.max("_rank").alias("need")).where("need > 0")
    # a busy key counts for every base that it extends by letters: as many more suffixes are tried
    letters_at_end = F.length(F.regexp_extract("cite_key", "([a-z]*)$", 1))
    extends = busy.where(letters_at_end > 0).select(F.explode(F.transform(F.sequence(F.lit(1), letters_at_end), lambda n: F.expr("cite_key").substr(F.lit(1), F.length("cite_key") - n))).alias(base))
    need = need.join(extends.groupBy(base).agg(F.count("*").alias("more")), base, "left")
    indexes = F.sequence(F.lit(0).cast("long"), F.col("need") + F.coalesce("more", F.lit(0)))
    letters = need.select(base, F.explode(indexes).alias("index")).withColumn("cite_key", F.concat(base, suffix(F.col("index"))))
    free = letters.join(busy, "cite_key", "left_anti")
    free = free.withColumn("_rank", F.row_number().over(Window.partitionBy(base).orderBy("index"))).select(base, "_rank", "cite_key")
    return out.join(free, [base, "_rank"], "left").withColumn("cite_key", F.coalesce("cite_key", base)).drop("_rank")
