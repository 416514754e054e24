"""Analyses in markdown, as column expressions: sections, header, methods, mechanisms,
suppliers, numbered lists. Null text gives null; a text without headers an empty map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import literal_map

# Other names of sections.
SECTION_NAMES = {
    "TITLE_AND_AUTHORS": "PAPER_HEADER", "RESEARCH_QUESTIONS": "RESEARCH_QUESTION", "RESEARCH_OBJECTIVES": "RESEARCH_QUESTION", "HYPOTHESIS": "RESEARCH_QUESTION", "METHODS": "METHODOLOGY", "RESEARCH_METHODOLOGY": "METHODOLOGY", "APPROACH": "METHODOLOGY",
    "FINDINGS": "KEY_FINDINGS", "LIMITATIONS_AND_CONSTRAINTS": "LIMITATIONS", "CONSTRAINTS": "LIMITATIONS", "STUDY_LIMITATIONS": "LIMITATIONS", "FUTURE_RESEARCH": "FUTURE_WORK", "FURTHER_WORK": "FUTURE_WORK",
    "RESULTS": "CONCLUSIONS", "REFERENCES": "CITATIONS", "BIBLIOGRAPHY": "CITATIONS", "CITED_WORKS": "CITATIONS",
}
# Lines and paragraphs. (?d): only \n ends a line.
HEADER = r"(?md)^##[^\S\n]+(?:\d+\.[^\S\n]+)?([A-Z_:]+)[^\S\n]*$"
HEADER_FIELD = r"(?d)\d+\.\d+\.\s+(?:\*\*([A-Za-z_]+)(?::\*\*|\*\*:)|([A-Za-z_]+):)\s*(.*)"
PARAGRAPH_FIELD = r"(?d)\d+\.\d+\.\s+\**([A-Z_]*):\**\s+(.*)"
MECHANISM = r"(?d)^\[(.+)\], \[(.+)\], \[(.+)\], \[(.+)\] - (.+)$"
NUMBERED = r"(?s)\d+\.\s*(.+?)(?=\d+\.|\z)"
BULLETED = r"(?s)[•*-]\s*(.+?)(?=[•*-]|\z)"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, where x is worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def section_name(x: Column) -> Column:
    name = F.regexp_replace(F.upper(x), "[^A-Z0-9_]", "")
    return F.coalesce(F.element_at(literal_map(SECTION_NAMES), name), name)


def sections(text: Column) -> Column:
    """Map from section name to content; headers have two hashes and a name in capitals, and
    of sections with one name the last counts. What is above the first header is left out."""
    bodies = F.transform(F.slice(F.split(text, HEADER), 2, 1 << 30), strip)

    def last(names: Column) -> Column:
        each = F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("key"), b.alias("value")))
        return F.filter(each, lambda e, i: ~F.array_contains(F.slice(names, i + 2, 1 << 30), e["key"]))

    return F.map_from_entries(bound(F.transform(F.regexp_extract_all(text, F.lit(HEADER), 1), section_name), last))


def _last(found: Column, key: str) -> Column:
    """The value of the last (key, value) with a key."""
    return F.try_element_at(F.filter(found, lambda e: e["key"] == key), F.lit(-1))["value"]


def header_fields(section: Column) -> Column:
    """key, value of 1.1. **NAME:** value, **NAME**: value or NAME: value."""
    lines = F.filter(F.split(section, "\n"), lambda x: x.rlike(HEADER_FIELD))
    part = lambda x, k: F.regexp_extract(x, HEADER_FIELD, k)
    return F.transform(lines, lambda x: F.struct(F.upper(F.concat(part(x, 1), part(x, 2))).alias("key"), strip(part(x, 3)).alias("value")))


def header_field(section: Column, name: str) -> Column:
    """Of several values the last."""
    return _last(header_fields(section), name)


def paragraph_fields(section: Column, whole: bool = False) -> Column:
    """key, value of 2.1. **NAME:** value at a paragraph's first such line: the rest of that
    line, or of the whole paragraph."""
    pattern = PARAGRAPH_FIELD.replace("(?d)", "(?s)") if whole else PARAGRAPH_FIELD
    found = F.filter(F.split(section, "\n\n"), lambda x: x.rlike(pattern))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("key"), strip(F.regexp_extract(x, pattern, 2)).alias("value")))


def paragraph_field(section: Column, name: str, whole: bool = False) -> Column:
    """Of several values the last."""
    return _last(paragraph_fields(section, whole), name)


def mechanisms(section: Column) -> Column:
    """[context], [action], [mechanism], [outcome] - description, one a paragraph."""
    found = F.filter(F.split(section, "\n\n"), lambda x: x.rlike(MECHANISM))
    fields = ["c", "a", "m", "o", "description"]
    return F.transform(found, lambda x: F.struct(*(strip(F.regexp_extract(x, MECHANISM, k + 1)).alias(f) for k, f in enumerate(fields))))


def questions(section: Column) -> Column:
    """Numbered parts, else those with bullets, else sentences, else the text."""
    all_of = lambda p: F.transform(F.regexp_extract_all(section, F.lit(p), 1), strip)
    sentences = F.transform(F.filter(F.transform(F.split(section, r"\."), strip), lambda s: s != ""), lambda s: F.concat(s, F.lit(".")))
    other = F.when(section.contains("."), sentences).otherwise(F.array(strip(section)))
    some = lambda found, other: bound(found, lambda x: F.when(F.size(x) > 0, x).otherwise(other))
    return some(all_of(NUMBERED), some(all_of(BULLETED), other))


def steps(section: Column) -> Column:
    """Each line's numbered parts, or the line."""
    lines = F.filter(F.transform(F.split(section, "\n"), strip), lambda x: x != "")
    one_line = NUMBERED.replace("(?s)", "(?d)")

    def parts(x: Column) -> Column:
        return bound(F.regexp_extract_all(x, F.lit(one_line), 1), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(x)))

    return F.flatten(F.transform(lines, parts))


def analysis(text: Column) -> Column:
    """sections and what is read from them: title, authors, year, empirical_base,
    methodology_class, camo, it_supplier, regular_supplier; null where there is none."""

    def of(found: Column, head: Column, method: Column, vendors: Column) -> Column:
        return F.struct(
            found.alias("sections"), *(_last(head, k).alias(k.lower()) for k in ("TITLE", "AUTHORS", "YEAR")), *(_last(method, k).alias(k.lower()) for k in ("EMPIRICAL_BASE", "METHODOLOGY_CLASS")),
            mechanisms(F.element_at(found, "INNOVATION_MECHANISMS")).alias("camo"), *(F.split(_last(vendors, k), "\n").alias(k.lower()) for k in ("IT_SUPPLIER", "REGULAR_SUPPLIER")),
        )

    def parts(found: Column) -> Column:
        head, method, vendors = header_fields(F.element_at(found, "PAPER_HEADER")), paragraph_fields(F.element_at(found, "METHODOLOGY")), paragraph_fields(F.element_at(found, "VENDORS"), True)
        return bound(head, lambda h: bound(method, lambda m: bound(vendors, lambda w: of(found, h, m, w))))

    return bound(sections(text), parts)
