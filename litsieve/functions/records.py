"""Rules for records of outside services, as column expressions over their JSON fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PAPER_TYPES
from . import identifiers as ids
from . import text as t

# The services' types and ours.
CROSSREF_TYPES = {"journal-article": "journal_article", "proceedings-article": "conference_paper", "book": "book", "book-chapter": "book_chapter", "report": "technical_report", "dataset": "dataset", "preprint": "preprint"}
OPENALEX_TYPES = {"article": "journal_article", "book": "book", "book-chapter": "book_chapter", "dataset": "dataset", "dissertation": "thesis", "report": "technical_report", "preprint": "preprint"}
# Fields of export formats, ours first; of several the entry's last one counts.
TRANSLATED = ["title", "year", "journal", "journal_iso", "volume", "issue", "pages", "doi", "publisher", "abstract", "paper_type"]
_COMMON = {"title": ["title"], "year": ["year"], "journal": ["journal"], "volume": ["volume"], "issue": ["number"], "pages": ["pages"], "doi": ["doi"], "publisher": ["publisher"], "abstract": ["abstract"], "paper_type": ["type"]}
TRANSLATIONS = {
    "wos": {
        "name": "Web of Science", "fields": _COMMON | {"journal_iso": ["journal-iso"], "pages": ["pages", "pages-range"]}, "keywords": "keywords", "keywords_extra": "keywords-plus",
        "details": ["address", "affiliation", "affiliations", "doc-delivery-number", "earlyaccessdate", "eissn", "issn", "funding-acknowledgement", "language", "unique-id", "web-of-science-categories", "web-of-science-index"],
    },
    "scopus": {"name": "Scopus", "fields": _COMMON, "keywords": "author_keywords", "keywords_extra": "keywords", "details": ["url", "source", "publication_stage", "note"]},
    "ieee": {"name": "IEEE Xplore", "fields": _COMMON | {"journal": ["journal", "booktitle"]}, "keywords": "keywords", "keywords_extra": None, "details": ["url", "issn", "isbn", "month", "note", "series"]},
}
# What is taken out of exported keywords, in this order.
KEYWORD_MARKS = [
    ("``|''", ""), (r"`\s+s\b", "'s"), ("`", ""), (r'^["\\]+|["\\]+$', ""), (r"^\s+|\s+$", ""), (r"^[{}]+|[{}]+$", ""), (r"^\s+|\s+$", ""), (r"\\[`'\"^~]\{[^}]*\}", ""), (r"\\[`'\"^~]", ""),
    (r"\\&", "&"), (r"~\{\}", ""), (r"\{\}\s*", ""), (r"&\w*;?", ""), (r"\\", ""), (r"\s+", " "), (r"^\s+|\s+$", ""),
]
# Words that raise a similarity.
BOOST_WORDS = ["digital", "innovation", "transformation", "supplier", "vendor", "partner", "incumbent", "firm", "organization"]


def crossref_type(kind: Column) -> Column:
    return F.element_at(t.literal_map(CROSSREF_TYPES), F.lower(kind))


def openalex_type(kind: Column, crossref: Column) -> Column:
    """Conference papers are told by the other service's type alone."""
    return F.when(crossref == "proceedings-article", "conference_paper").otherwise(F.element_at(t.literal_map(OPENALEX_TYPES), F.lower(kind)))


def year_from_parts(record: Column) -> Column:
    """The first element of the first date-parts that has one: print, online, issued, created."""
    part = lambda k: F.get_json_object(record, f"$['{k}']['date-parts'][0][0]").try_cast("int")
    return F.coalesce(*map(part, ("published-print", "published-online", "issued", "created")))


def _names(items: Column) -> Column:
    return F.filter(F.transform(items, lambda c: F.trim(c["display_name"])), lambda n: n != "")


def concept_keywords(concepts: Column, least: float = 0.3) -> Column:
    """Names of concepts (display_name, score) above a score."""
    return _names(F.filter(concepts, lambda c: c["score"] > least))


def topics(named: Column, concepts: Column) -> Column:
    """Names of topics; if there are none, of concepts of level 0 or 1 with a score over 0.5."""
    found = F.coalesce(_names(named), F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(_names(F.filter(concepts, lambda c: (c["level"] <= 1) & (c["score"] > 0.5))))


def valid_paper_type(kind: Column) -> Column:
    """The type in lower case, or null if it isn't one."""
    return F.when(F.lower(F.trim(kind)).isin(PAPER_TYPES), F.lower(F.trim(kind)))


#: Which rule normalises which field; others pass as they are.
NORMALIZERS = {"title": t.normalize_title, "abstract": t.normalize_abstract, "authors": ids.parse_authors, "keywords": t.normalize_keywords, "journal": t.normalize_title, "publisher": t.normalize_title, "year": t.normalize_year, "doi": ids.doi_stem, "paper_type": valid_paper_type}


def normalized(df):
    """A table of raw records with every known field normalised."""
    return df.select(*(NORMALIZERS[c](F.col(f"`{c}`")).alias(c) if c in NORMALIZERS else F.col(f"`{c}`") for c in df.columns))


def legacy_cite_key(family: Column, year: Column, doi: Column, path: Column, seed: Column) -> Column:
    """Family name and year, else the DOI's last part, else the file's name, else a code drawn
    from the seed."""
    family = F.lower(family)
    by_name = F.when(F.length(family) > 0, F.concat(family, F.coalesce(year.cast("string"), F.lit(""))))
    part = F.substring(F.regexp_replace(F.substring_index(doi, "/", -1), r"[.()]", ""), 1, 12)
    by_doi = F.when(doi.contains("/") & (part != ""), F.concat(F.lit("doi"), part))
    name = F.replace(F.substring_index(path, "/", -1), F.lit(".pdf"), F.lit(""))
    code = F.md5(seed.cast("string").cast("binary"))
    drawn = F.when(year.isNotNull(), F.concat(F.lit("auto"), year.cast("string"), F.substring(code, 1, 4))).otherwise(F.concat(F.lit("auto"), F.upper(F.substring(code, 1, 8))))
    return F.coalesce(by_name, by_doi, F.when(F.length(name) > 3, F.substring(name, 1, 12)), drawn)


def record_source(fields: Column, key: Column, scopus: list[str], wos: list[str]) -> Column:
    """scopus, wos or ieee by a map of fields: an explicit source, fields that only one has,
    the form of the key, fields that go together; wos if nothing tells."""
    names = F.transform(F.map_keys(fields), F.lower)
    has = lambda *any_of: F.arrays_overlap(names, F.array(*map(F.lit, any_of)))
    said = F.coalesce(F.lower(F.element_at(fields, "source")).contains("scopus"), F.lit(False))
    return (
        F.when(said | has(*scopus), "scopus").when(has(*wos), "wos").when(key.rlike(r"^\d+$"), "ieee").when(key.startswith("WOS:"), "wos")
        .when(has("booktitle") & has("issn", "month"), "ieee").otherwise("wos")
    )


def exported_keywords(x: Column) -> Column:
    """Keywords split at ; and , without TeX marks, quotes and entities; null if none is left."""

    def clean(k: Column) -> Column:
        for pattern, put in KEYWORD_MARKS:
            k = F.regexp_replace(k, f"(?U){pattern}", put)
        return k

    found = F.filter(F.transform(F.filter(F.split(x, "[;,]"), lambda k: ~k.rlike(r"(?U)^\s*$")), lambda k: clean(F.regexp_replace(k, r"(?U)^\s+|\s+$", ""))), lambda k: k != "")
    return F.when(F.size(found) > 0, found)


def exported_authors(x: Column) -> Column:
    """last_name, first_name, initials, order of names joined by and; order counts all parts."""

    def author(name: Column, order: Column) -> Column:
        comma, words = name.contains(","), F.split(name, r"\s+")
        last = F.when(comma, F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(words, -1))
        first = F.when(comma, F.trim(F.get(F.split(name, ","), F.lit(1)))).otherwise(F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
        initials = F.array_join(F.transform(F.split(first, r"\s+"), lambda w: F.upper(F.substring(w, 1, 1))), "")
        return F.struct(last.alias("last_name"), first.alias("first_name"), initials.alias("initials"), order.alias("order"))

    parts = t.trimmed(F.split(x, r"(?i)\s+and\s+"))
    found = F.filter(F.transform(parts, author), lambda a: (a["last_name"] != "") | (a["first_name"] != ""))
    return F.when(F.size(found) > 0, found)


def translated(fields: Column, key: Column, kind: Column, source: str) -> Column:
    """A record of an export (map of lower-case fields) in one form for wos, scopus and ieee."""
    rule = TRANSLATIONS[source]
    one = lambda name: F.element_at(fields, name) if name else F.lit(None).cast("string")

    def last_of(names: list[str]) -> Column:
        return F.try_element_at(F.filter(F.map_entries(fields), lambda e: e["key"].isin(names)), F.lit(-1))["value"] if names else one(None)

    taken = {n: last_of(rule["fields"].get(n, [])) for n in TRANSLATED}
    taken["year"] = F.trim(taken["year"]).try_cast("int")
    taken["paper_type"] = F.coalesce(taken["paper_type"], kind)
    details = F.map_concat(F.create_map(F.lit("source"), F.lit(rule["name"])), F.map_filter(fields, lambda k, _: k.isin([d for d in rule["details"] if d != "source"])))
    if "source" in rule["details"]:  # the entry's own source takes the place of ours
        details = F.transform_values(details, lambda k, v: F.when(k == "source", F.coalesce(one("source"), v)).otherwise(v))
    return F.struct(
        key.alias("citekey"), F.lit(rule["name"]).alias("source_type"), *(taken[n].alias(n) for n in TRANSLATED), exported_authors(one("author")).alias("authors"),
        exported_keywords(one(rule["keywords"])).alias("keywords"), exported_keywords(one(rule["keywords_extra"])).alias("keywords_extra"), details.alias("source_details"),
    )


def doi_list(x: Column) -> Column:
    """DOIs of a field, with commas between and braces around or not."""
    inner = F.regexp_replace(F.coalesce(x, F.lit("")), r"^[\s{}]+|[\s{}]+$", "")
    return F.filter(t.trimmed(F.split(inner, ",")), lambda d: d != "")


def cited_dois(x: Column, direction: str) -> Column:
    """Citations of the list's valid DOIs, stated by hand: confidence 1."""
    stems = F.filter(F.transform(doi_list(x), ids.doi_stem), lambda d: d.isNotNull())
    none = F.lit(None)
    return F.transform(stems, lambda d: F.struct(d.alias("doi"), none.cast("string").alias("title"), none.cast("int").alias("year"), none.cast("string").alias("author"), F.lit(direction).alias("direction"), F.lit(1.0).alias("confidence")))


S2_RECORD = (
    "paperId string, corpusId string, title string, abstract string, venue string, year string, publicationTypes string, authors array<string>, s2FieldsOfStudy array<string>,"
    " publicationVenue string, journal string, isOpenAccess boolean, openAccessPdf string, externalIds string"
)


def _named(items: Column, field: str) -> Column:
    """A field of each item that is an object, the item itself if it is text; empty ones go."""
    found = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.when(x.startswith("{"), F.get_json_object(x, f"$.{field}")).otherwise(x))
    return F.filter(found, lambda x: x != "")


def semantic_scholar(record: Column) -> Column:
    """title, abstract, authors, topics, paper_type, year, journal, oa_status, source_key,
    download_url and doi of a record of that service (JSON)."""
    r = F.from_json(record, S2_RECORD)
    types, filled = r["publicationTypes"], lambda x: F.when(x != "", x)
    kind = F.when(types.startswith("["), F.get_json_object(types, "$[0]")).otherwise(filled(types))
    place = lambda x: F.get_json_object(x, "$.name")
    journal = F.when(r["venue"] != "", r["venue"]).when(r["publicationVenue"].startswith("{"), place(r["publicationVenue"])).when(r["journal"].startswith("{"), place(r["journal"]))
    year = r["year"].try_cast("int")
    return F.struct(
        filled(t.clean_html(r["title"])).alias("title"), r["abstract"].alias("abstract"), _named(r["authors"], "name").alias("authors"), _named(r["s2FieldsOfStudy"], "category").alias("topics"), kind.alias("paper_type"),
        F.when(year != 0, year).alias("year"), journal.alias("journal"), F.when(r["isOpenAccess"], "open").when(~r["isOpenAccess"], "closed").alias("oa_status"),
        F.concat(F.lit("s2:"), F.coalesce(filled(r["paperId"]), filled(r["corpusId"]))).alias("source_key"), filled(F.get_json_object(r["openAccessPdf"], "$.url")).alias("download_url"),
        ids.doi_stem(F.get_json_object(r["externalIds"], "$.DOI")).alias("doi"),
    )


def semantic_scholar_cited_by(answer: Column) -> Column:
    """Forward citations from that service's list of citing papers (JSON with data)."""
    items = F.from_json(F.get_json_object(answer, "$.data"), "array<struct<citingPaper: string>>")
    each = F.transform(items, lambda c: F.struct(semantic_scholar(c["citingPaper"]).alias("p")))
    return F.transform(each, lambda c: F.struct(
        c["p"]["doi"].alias("doi"), c["p"]["title"].alias("title"), c["p"]["year"].alias("year"), F.array_join(c["p"]["authors"], " and ").alias("author"), F.lit("forward").alias("direction"),
        ids.citation_confidence(F.lit(False), c["p"]["doi"], c["p"]["title"], c["p"]["year"]).alias("confidence"),
    ))


def keyword_boost(keywords: Column, similarity: Column, words: list[str] = BOOST_WORDS) -> Column:
    """passed, method, boosted, boost, for_review: 0.02 for each word in the keywords, 0.10 at
    most; from 0.60 on high, from 0.50 on moderate."""
    text = F.lower(F.coalesce(F.array_join(keywords, " "), F.lit("")))
    n = sum((text.contains(w).cast("int") for w in words), F.lit(0))
    boost = F.round(F.least(F.lit(0.10), n * 0.02), 4)
    total = F.round(similarity + boost, 4)
    middle = F.when(boost > 0, "moderate_similarity_with_boost").otherwise("moderate_similarity")
    method = F.when(total >= 0.60, "high_similarity").when(total >= 0.50, middle).otherwise("insufficient_similarity")
    return F.struct((total >= 0.50).alias("passed"), method.alias("method"), total.alias("boosted"), boost.alias("boost"), ((total >= 0.50) & (total < 0.60)).alias("for_review"))


def first_screen(text: Column, required: list[str], excluded: list[str], least: int = 2) -> Column:
    """decision, matched, barred: exclude on any barred word, include from ``least`` required
    words on, else ambiguous. Words are whole words of lower-case text."""
    found = lambda words: F.filter(F.array(*(F.when(F.lower(text).rlike(rf"(^|\W)\Q{w}\E(\W|$)"), F.lit(w)) for w in words)), lambda w: w.isNotNull())
    matched, barred = found(required), found(excluded)
    decision = F.when(F.size(barred) > 0, "exclude").when(F.size(matched) >= least, "include").otherwise("ambiguous")
    return F.struct(decision.alias("decision"), matched.alias("matched"), barred.alias("barred"))
