"""Text rules as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that title case treats apart.
PARTICLES = ["de", "van", "von", "der", "den", "el", "la", "le", "di", "da", "du", "the"]
CAPITALS = ["usa", "uk", "eu", "un", "nasa", "nato", "oem", "r&d", "ai", "ml", "it", "b2b", "b2c", "b2g", "ibm", "hp", "amd", "sap", "sql", "html", "css", "json", "xml", "soap", "rest", "soa", "esbnfv", "erp", "ocr", "esg", "ict", "cpu", "gpu", "ram", "3g", "4g", "5g", "6g", "uav"]
SMALL_WORDS = [
    "a", "an", "the", "and", "or", "nor", "but", "yet", "so", "in", "on", "at", "by", "to", "from", "into", "onto", "through", "across", "above", "below", "under", "over", "between", "among", "around", "behind",
    "before", "after", "inside", "outside", "near", "beside", "against", "during", "since", "until", "throughout", "within", "of", "with", "without", "for", "about", "regarding", "concerning", "except", "besides",
    "like", "unlike", "as", "than", "because", "if", "unless", "while", "when",
]
ACRONYMS = {
    "ltd": "Ltd", "inc": "Inc", "corp": "Corp", "llc": "LLC", "co": "Co", "plc": "PLC", "bv": "BV", "nv": "NV", "vof": "VOF", "sarl": "SARL", "sa": "SA", "sas": "SAS", "eurl": "EURL", "gmbh": "GmbH", "ag": "AG", "kg": "KG",
    "ohg": "oHG", "phd": "PhD", "mba": "MBA", "bsc": "BSc", "msc": "MSc", "ieee": "IEEE", "aims": "AIMS", "acm": "ACM", "iot": "IoT",
}
# Phrases that make an abstract boilerplate.
BOILERPLATE = ["authors declare no", "no conflicts of interest", "conflict of interest", "no competing interests", "competing interests", "authors would like to thank"]


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def trimmed(parts: Column) -> Column:
    """Each text of an array without spaces at its ends. (F.trim itself would get an item's
    index as the characters to trim.)"""
    return F.transform(parts, lambda p: F.trim(p))


def collapse(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def strip_markup(x: Column) -> Column:
    x = F.regexp_replace(x, r"\$([%&_#])\$", "$1")
    return F.regexp_replace(F.regexp_replace(x, r"[{}]", ""), r"<[^>]+>", "")


def clean_html(x: Column) -> Column:
    """Tags as spaces, white space collapsed."""
    return collapse(F.regexp_replace(x, r"<[^>]+>", " "))


def parse_abstract(x: Column) -> Column:
    return F.regexp_replace(clean_html(x), r"(?i)^abstract[\s:.]*", "")


def unescape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\\&|&amp;", "&"), r"\\%", "%")


def normalize_abstract(x: Column) -> Column:
    return collapse(unescape(strip_markup(F.trim(x))))


def _capitalize(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def title_case(x: Column) -> Column:
    """Title case with small words, particles, acronyms, hyphenated parts and et al."""
    acronyms = literal_map(ACRONYMS)
    words = F.split(collapse(F.regexp_replace(F.lower(x), r"\bet\s+al(?=[.\s,;:]|$)", "__et_al__")), " ")
    core = lambda w: F.regexp_replace(w, r"[.,;:]+$", "")

    def part(p: Column) -> Column:
        known = F.element_at(acronyms, core(p))
        return F.when(known.isNotNull(), known).when(core(p).isin(CAPITALS), F.upper(p)).otherwise(_capitalize(p))

    def word(w: Column, i: Column) -> Column:
        first = (i == 0) | F.get(words, i - 1).endswith(":")
        known = F.element_at(acronyms, core(w))
        return (
            F.when(w.contains("__et_al__"), F.regexp_replace(w, "__et_al__", "et al"))
            .when(w.contains("-"), F.array_join(F.transform(F.split(w, "-"), part), "-"))
            .when(known.isNotNull(), F.concat(known, F.regexp_extract(w, r"([.,;:]*)$", 1)))
            .when(core(w).isin(SMALL_WORDS), F.when(first, _capitalize(w)).otherwise(w))
            .when(core(w).isin(CAPITALS), F.upper(w))
            .when(core(w).isin(PARTICLES) & ~first, w)
            .otherwise(_capitalize(w))
        )

    dashed = F.transform(words, lambda w: F.regexp_replace(w, "–", "-"))
    return F.when(F.length(x) > 0, F.array_join(F.transform(dashed, word), " ")).otherwise(x)


def normalize_title(x: Column) -> Column:
    return title_case(unescape(collapse(strip_markup(F.trim(x)))))


def normalize_keywords(x: Column) -> Column:
    """Split on ; or else , or else and; trimmed, lower case, distinct in order."""
    parts = F.when(x.contains(";"), F.split(x, ";")).when(x.contains(","), F.split(x, ",")).otherwise(F.split(x, r"\s+and\s+"))
    return F.array_distinct(F.filter(F.transform(parts, lambda k: F.lower(F.trim(k))), lambda k: k != ""))


def normalize_year(x: Column) -> Column:
    """The first word of four digits, if from 1000 to 2100."""
    year = F.regexp_extract(x.cast("string"), r"\b([0-9]{4})\b", 1)
    number = F.when(year != "", year.cast("int"))
    return F.when(number.between(1000, 2100), number)


def title_key(x: Column) -> Column:
    return F.trim(F.lower(F.substring(x, 1, 50)))


def dedup_title(x: Column) -> Column:
    return collapse(F.lower(x))


def substantive(abstract: Column) -> Column:
    """At least 20 characters, and no boilerplate in the first 25 words."""
    start = F.array_join(F.slice(F.split(collapse(F.lower(abstract)), " "), 1, 25), " ")
    any_of = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(start, p))
    thanks = start.contains("acknowledge") | start.contains("acknowledgment")
    return F.coalesce((F.length(F.trim(abstract)) >= 20) & ~any_of(BOILERPLATE) & ~(thanks & any_of(["funding", "thank", "support", "gratitude"])), F.lit(False))


def token_estimate(x: Column) -> Column:
    return F.floor(F.length(x) / 4)


def wildcard_pattern(keyword: str) -> str:
    """A regular expression of kw, kw*, *kw or *kw* over lower-case text. Word borders are
    spelt out, so that they mean the same in every engine."""
    keyword = keyword.lower().strip()
    left, right = keyword.startswith("*"), keyword.endswith("*")
    core = "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c for c in keyword.strip("*"))
    edge, word = r"[^\p{L}\p{N}_]", r"[\p{L}\p{N}_]*"
    if left and right:
        return core
    before = word if left else f"(^|{edge})"
    after = word if right else f"($|{edge})"
    return f"{before}{core}{after}"


def matches_keyword(text: Column, keyword: str) -> Column:
    return F.lower(text).rlike(wildcard_pattern(keyword))


def extract_json(x: Column) -> Column:
    """From the first { to the last }."""
    found = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def inverted_index_text(index: Column) -> Column:
    """Text of a map from word to positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["word"]), " ")
