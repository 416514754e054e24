"""Text structure: sections, sentences, chunks, citation removal.

Sentence, paragraph and citation rules are native expressions. Section detection and
greedy sentence packing carry state from line to line, so they are Arrow UDFs that turn
a text into an array, exploded afterwards.
"""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Canonical sections and the names that belong to each, in order.
CANONICAL = {
    "title": ["title", "paper title"],
    "abstract": ["abstract", "summary", "executive summary"],
    "keywords": ["keywords", "key words", "key terms", "keywords and phrases"],
    "introduction": ["introduction", "context", "overview"],
    "background": ["background", "background and context", "theoretical background", "conceptual background"],
    "research_question": ["research question", "research questions", "research objectives", "research aims", "research questions:"],
    "literature": ["literature review", "related work", "theoretical framework", "literature"],
    "methods": ["methods", "methodology", "research design", "approach", "technical approach", "materials and methods"],
    "findings": ["results", "findings", "results and discussion", "analysis", "empirical results", "evaluation"],
    "conclusion": ["conclusion", "conclusions", "summary", "concluding remarks"],
}
# Names of sections that stand on a line of their own, by rules of our own: one regular
# expression a name, s? marking plurals.
HEADERS = [
    "Abstracts?", "Executive Summary", "Introduction", "Background", "Literature Review", "Related Work", "Theoretical Framework", "Conceptual Framework", "Research Questions?", "Hypothes[ei]s", "Methods?", "Methodology",
    "Materials? and Methods?", "Research Methods?", "Research Design", "Experimental Design", "Data Collection", "Data Analysis", "Analytical Approach", "Case Study", "Sample", "Participants?", "Results?", "Findings?", "Empirical Results?",
    "Empirical Findings?", "Analysis", "Empirical Analysis", "Discussion", "Interpretation", "Results? and Discussion", "Implications?", "Theoretical Implications?", "Practical Implications?", "Managerial Implications?", "Policy Implications?",
    "Contributions?", "Theoretical Contributions?", "Limitations?", "Future Research", "Future Work", "Research Agenda", "Conclusions?", "Concluding Remarks?", "Summary", "Summary and Conclusions?", "References?", "Bibliography", "Works? Cited",
    "Appendix", "Appendices", "Supplementary Materials?", "Acknowledge?ments?", "Funding", "Conflict of Interests?", "Author Contributions?", "Data Availability", "Overview", "Definitions?", "Propositions?", "Model", "Framework", "Approach",
    "Context", "Setting", "Procedure", "Measures?", "Variables?", "Instruments?", "Statistics", "Statistical Analysis", "Business Model", "Value Proposition", "Competitive Advantage", "Strategy", "Implementation", "Digital Transformation",
    "Digital Strategy", "Technology Adoption", "Innovation", "Capabilit(?:y|ies)", "Resources?", "Case Description", "Company Background", "Industry Context", "Within-case Analysis", "Cross-case Analysis",
]
# How citations look in running text.
CITATIONS = [
    r"\[\s*[A-Z][a-z]+(?:\s+et\s+al\.?)?\s*,\s*\d{4}\s*\]",
    r"\(\s*[A-Z][a-z]+(?:\s+et\s+al\.?)?\s*,\s*\d{4}\s*\)",
    r"[A-Z][a-z]+\s+\(\d{4}\)",
    r"^\s*(References|Bibliography|Works Cited|Citations)\s*$",
    r"\[[\d\s,]+\]",
]

SECTION = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())]))


@cache
def header_pattern() -> re.Pattern:
    names = "|".join(h.replace(" ", r"\s+") for h in HEADERS)
    shapes = [
        r"#+\s+(?P<mark>.+)",
        r"(?P<number>(?:\d+(?:\.\d+){0,2}|[IVX]+|[A-Z])\.?\s+[A-Z][^.!?]+)",
        r"(?P<caps>[A-Z][A-Z\s]{2,}):?",
        rf"(?P<name>{names})",
        r".*:\s+(?P<late>Abstracts?)",
        r"(?P<question>.+?research\s+question.*)",
    ]
    return re.compile("^(?:" + "|".join(shapes) + r")$|^(?P<words>Keywords?(?:\s+and\s+Phrases)?):?", re.IGNORECASE)


# Words of headers that belong to the journal or the publisher.
IMPRINT = [
    "journal", "issn", "doi", "homepage", "correspondence", "department", "university", "affiliation", "institute", "group", "psychology", "ergonomics", "aesthetics", "url", "https://", "www.", "@",
    "research", "license", "supplementary", "article", "terms", "conditions", "access", "open access",
]


def canonical(title: str) -> str | None:
    """The first canonical section one of whose names contains the title or is in it."""
    title = title.lower().strip()
    return next((group for group, names in CANONICAL.items() if any(n in title or title in n for n in names)), None)


def is_imprint(title: str) -> bool:
    return len(title) < 5 or any(w in title.lower() for w in IMPRINT)


def sections_of(text: str) -> list[dict]:
    """Lines under their headers; what comes before the first header is dropped. A title is
    the longest text above the abstract that isn't the journal's or the publisher's, if no
    section is one. Research questions written as RQ1: get a section of their own."""
    found: list[dict] = []
    title, lines = None, []

    def close() -> None:
        if title is not None:
            found.append({"title": title, "content": "\n".join(lines)})

    for line in map(str.strip, text.split("\n")):
        m = header_pattern().match(line) if line else None
        if m:
            close()
            title = next(g for g in m.groups() if g is not None).strip()
            rest = line[m.end() :].strip(": ") if m.lastgroup == "words" else ""
            lines = [rest] if rest else []
        elif line:
            lines.append(line)
    close()
    groups = [canonical(s["title"]) for s in found]
    if "title" not in groups and "abstract" in groups:
        above = [s["content"].strip() for s in found[: groups.index("abstract")] if not is_imprint(s["title"])]
        if above := [c for c in above if len(c) > 20]:
            found.insert(0, {"title": "title", "content": " ".join(max(above, key=len).split())})
    out = []
    for s in found:
        if re.search(r"abstract\s+key\s?words", s["title"], re.IGNORECASE):
            out += [{"title": t, "content": s["content"]} for t in ("abstract", "keywords")]
        else:
            out.append(s)
    questions = [line for s in out if "introduction" in s["title"].lower() for line in s["content"].split("\n") if re.match(r"RQ\d+:", line)]
    if questions and not any("research question" in s["title"].lower() for s in out):
        out.append({"title": "research questions", "content": "\n".join(questions)})
    return out


def detect_sections(x: Column | str) -> Column:
    @F.pandas_udf(SECTION)
    def detect(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sections_of(t) if t else [])

    return detect(x)


def section_group(title: Column) -> Column:
    """The first canonical section one of whose names contains the title or is in it."""
    title = F.lower(F.trim(title))
    out = None
    for group, names in CANONICAL.items():
        hit = None
        for n in names:
            one = title.contains(n) | F.contains(F.lit(n), title)
            hit = one if hit is None else hit | one
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out


def coverage(sections: DataFrame, key: str = "id") -> DataFrame:
    """Of the canonical sections: those found, those missing, and the percentage."""
    groups = F.array(*map(F.lit, CANONICAL))
    by = sections.withColumn("g", section_group(F.col("title"))).groupBy(key).agg(F.array_sort(F.collect_set("g")).alias("found"))
    return by.withColumn("missing", F.array_sort(F.array_except(groups, "found"))).withColumn("coverage", F.round(100.0 * F.size("found") / len(CANONICAL), 1))


def sentences(x: Column) -> Column:
    return F.filter(F.split(F.trim(x), r"(?<=[.!?])\s+"), lambda s: s != "")


def paragraphs(x: Column, least: int = 20) -> Column:
    joined = F.transform(F.split(x, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " ")))
    return F.filter(joined, lambda p: F.length(p) > least)


def pack_sentences(x: Column, size: int = 512, overlap: int = 50) -> Column:
    """Chunks of whole sentences of at most ``size`` tokens (a longer sentence is alone);
    a chunk starts with its predecessor's last sentences of at most ``overlap`` tokens."""

    @F.pandas_udf("array<string>")
    def pack(lists: pd.Series) -> pd.Series:
        def one(items) -> list[str]:
            out, chunk, used = [], [], 0
            for s in items if items is not None else ():
                n = len(s) // 4
                if chunk and used + n > size:
                    out.append(" ".join(chunk))
                    keep, kept = [], 0
                    for t in reversed(chunk):
                        if kept + len(t) // 4 > overlap:
                            break
                        keep.insert(0, t)
                        kept += len(t) // 4
                    chunk, used = keep, kept
                chunk.append(s)
                used += n
            return [*out, " ".join(chunk)] if chunk else out

        return lists.map(one)

    return pack(sentences(x))


def fixed_chunks(x: Column, size: int, overlap: int = 0) -> Column:
    """Pieces of ``size`` characters, each starting ``size - overlap`` after the last."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(x) - 1), F.lit(step))
    return F.when(F.length(x) > 0, F.transform(starts, lambda s: F.substring(x, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def remove_citations(x: Column) -> Column:
    for p in CITATIONS:
        x = F.regexp_replace(x, "(?im)" + p, "")
    return x


def citation_count(x: Column) -> Column:
    n = F.lit(0)
    for p in CITATIONS:
        n = n + F.regexp_count(x, F.lit("(?im)" + p))
        x = F.regexp_replace(x, "(?im)" + p, "")
    return n


def chunk_tree(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, chunk_index, level, parent_index, text: the text's first 100 characters, its
    sections' first 100, and their paragraphs of over 20 characters, in running order."""
    short = lambda x: F.when(F.length(x) > 100, F.concat(F.substring(x, 1, 100), F.lit("…"))).otherwise(x)
    parts = df.select(key, text, F.posexplode_outer(detect_sections(F.coalesce(text, F.lit("")))).alias("s", "section"))
    lines = F.filter(F.split("section.content", r"\n"), lambda p: F.length(p) > 20)
    root = df.select(key, F.lit(-1).alias("s"), F.lit(-1).alias("p"), F.lit("paper").alias("level"), short(F.col(text)).alias("chunk"))
    heads = parts.where("section is not null").select(key, "s", F.lit(-1).alias("p"), F.lit("section").alias("level"), short(F.concat_ws("\n", "section.title", "section.content")).alias("chunk"))
    leaves = parts.select(key, "s", F.posexplode(lines).alias("p", "chunk")).select(key, "s", "p", F.lit("paragraph").alias("level"), "chunk")
    rows = root.unionByName(heads).unionByName(leaves)
    w = Window.partitionBy(key).orderBy("s", "p")
    index = rows.withColumn("chunk_index", F.row_number().over(w) - 1)
    parent = F.when(F.col("level") == "section", F.lit(0)).when(F.col("level") == "paragraph", F.max(F.when(F.col("level") == "section", F.col("chunk_index"))).over(w))
    return index.withColumn("parent_index", parent).select(key, "chunk_index", "level", "parent_index", F.col("chunk").alias("text"))


def hashed_embedding(x: Column, size: int = 64) -> Column:
    """A stand-in for a model: a normalised bag of hashed words, for demonstrations."""
    words = F.filter(F.split(F.lower(x), r"\W+"), lambda w: w != "")
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(size))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(words, lambda w: slot(w) == k)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(length > 0, F.transform(counts, lambda v: v / length)).otherwise(counts)
