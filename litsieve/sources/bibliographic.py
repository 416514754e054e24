"""Readers of BibTeX, RIS, JSON lines and files.

Records are cut from files by Spark (a file is one row of text, so files spread over the
cluster); parsing a file's grammar needs state and is one mapInPandas; everything after
it, field mapping and normalising, is native.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.identifiers import doi_key, doi_stem, parse_authors, split_name
from ..functions.records import cited_dois, doi_list, translated
from ..schema import PAPER, conform

# Entry and record types.
BIBTEX_TYPES = {
    "article": ("journal_article", 0.95), "inproceedings": ("conference_paper", 0.95), "book": ("book", 0.95), "incollection": ("book_chapter", 0.90), "inbook": ("book_chapter", 0.90), "phdthesis": ("thesis", 0.95),
    "mastersthesis": ("thesis", 0.95), "techreport": ("technical_report", 0.90), "unpublished": ("working_paper", 0.75), "misc": ("other", 0.5),
}
RIS_TYPES = {
    "jour": "journal_article", "article": "journal_article", "conf": "conference_paper", "cpaper": "conference_paper", "inproceedings": "conference_paper", "book": "book", "chap": "book_chapter", "book_chapter": "book_chapter",
    "thes": "thesis", "thesis": "thesis", "rep": "technical_report", "report": "technical_report", "phdthesis": "thesis", "mastersthesis": "thesis", "unpublished": "working_paper", "misc": "other",
}
SOURCES = ["scopus", "wos", "ieee"]


def bibtex_entries(text: str) -> Iterator[tuple[str, str, dict[str, str], str]]:
    """(type, key, fields, raw) of each entry; braces and quotes may nest."""
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]*)\s*,", text):
        if m[1].lower() in ("comment", "string", "preamble"):
            continue
        at, fields = m.end(), {}
        while True:
            f = re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(text, at)
            if not f:
                break
            at = f.end()
            if at < len(text) and text[at] in '{"':
                close, depth, start = ("}" if text[at] == "{" else '"'), 0, at + 1
                at += 1
                while at < len(text) and (depth or text[at] != close):
                    depth += {"{": 1, "}": -1}.get(text[at], 0)
                    at += 1
                value, at = text[start:at], at + 1
            else:
                bare = re.compile(r"[^,}\s]*").match(text, at)
                value, at = bare[0], bare.end()
            fields[f[1].lower()] = " ".join(value.split())
        end = text.find("}", at)
        yield m[1].lower(), m[2], fields, text[m.start() : end + 1 if end >= 0 else len(text)]


def ris_records(text: str) -> Iterator[dict[str, list[str]]]:
    """Tags of each record: TY starts one, ER ends it; a last one may lack ER."""
    record: dict[str, list[str]] | None = None
    for line in text.splitlines():
        tag, dash, value = line.partition(" - ")
        tag = tag.strip()
        if not dash:  # only the end of a record may lack a value
            tag = line.strip().removesuffix("-").strip()
            if tag != "ER":
                continue
        if tag == "ER":
            if record:
                yield record
            record = None
            continue
        if tag == "TY":
            if record:
                yield record
            record = {}
        if record is not None:
            record.setdefault(tag, []).append(value.strip())
    if record:
        yield record


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _ordered(df: DataFrame) -> DataFrame:
    """ord: the place of a record (path, at, counted from 0 in its file) among all. Only a
    count a file is summed up in order; records stay where they are."""
    counts = df.groupBy("path").agg(F.count("*").alias("_n"))
    before = counts.select("path", (F.sum("_n").over(Window.orderBy("path")) - F.col("_n")).alias("_before"))
    return df.join(before, "path").withColumn("ord", F.col("_before") + F.col("at")).drop("_before")


def paper_type(kind, source_type, overrides: Mapping[str, Mapping[str, str]] | None = None, custom: Mapping[str, str] | None = None):
    """(type, confidence) of a BibTeX record by source override, entry type, own mapping,
    then words in its type fields."""
    types = t.literal_map({k: v[0] for k, v in BIBTEX_TYPES.items()})
    sure = F.create_map(*(F.lit(x) for k, v in BIBTEX_TYPES.items() for x in (k, v[1])))
    said = F.lower(F.coalesce("fields.type", "fields.document_type", "fields.article_type"))
    guess = F.when(said.contains("article"), "journal_article").when(said.contains("conference") | said.contains("proceedings"), "conference_paper").when(said.contains("book") & said.contains("chapter"), "book_chapter").when(said.contains("book"), "book")
    special = F.lit(None).cast("string")
    for source, values in (overrides or {}).items():
        special = F.when(source_type == source, F.element_at(t.literal_map(dict(values)), F.col("fields.type"))).otherwise(special)
    own = F.element_at(t.literal_map(dict(custom)), kind) if custom else F.lit(None).cast("string")
    known = F.element_at(types, kind)
    return F.coalesce(special, known, own, guess), F.when(special.isNotNull(), 0.85).when(known.isNotNull(), F.element_at(sure, kind)).when(own.isNotNull(), 0.5).when(guess.isNotNull(), 0.6).otherwise(0.0)


FIELDS = ["title", "abstract", "author", "year", "date", "doi", "isbn", "issn", "url", "journal", "booktitle", "publisher", "volume", "issue", "number", "pages", "keyword", "keywords", "author_keywords", "keywords-plus", "language", "type", "document_type", "article_type"]


def read_entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, at, kind, key, all_fields (in order, empty ones left out), raw, ord of entries."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, at, kind, key, {k: v for k, v in fields.items() if v.strip()}, raw) for path, text in zip(frame.path, frame.text, strict=True) for at, (kind, key, fields, raw) in enumerate(bibtex_entries(text))]
            yield pd.DataFrame(rows, columns=["path", "at", "kind", "key", "all_fields", "raw"])

    return _ordered(_files(spark, paths).mapInPandas(parse, "path string, at int, kind string, key string, all_fields map<string,string>, raw string"))


def read_cited_bibtex(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Papers of entries that state their citations by hand (cites, citedby: lists of DOIs),
    with study_type, cited_by_count and last_checked; and (key, reason) of entries that are
    skipped: DOI, title, abstract and keywords are needed."""
    rows = read_entries(spark, paths)
    f = lambda name: F.trim(F.element_at("all_fields", name))
    doi = doi_stem(f("doi"))
    missing = [F.when(f(n).isNull(), f"Missing {said}") for n, said in (("title", "title"), ("abstract", "abstract"), ("keywords", "keywords"))]
    rows = rows.withColumn("_reason", F.coalesce(F.when(f("doi").isNull(), "Missing DOI"), F.when(doi.isNull(), F.concat(F.lit("Invalid DOI: "), f("doi"))), *missing))
    good = rows.where("_reason is null").select(
        "ord", doi.alias("id"), F.col("key").alias("cite_key"), doi.alias("source_key"), doi.alias("doi"), f("title").alias("title"), f("abstract").alias("abstract"),
        F.filter(t.trimmed(F.split(f("keywords"), ",")), lambda k: k != "").alias("keywords"), F.transform(F.filter(t.trimmed(F.split(f("author"), " and ")), lambda n: n != ""), split_name).alias("authors"),
        f("year").try_cast("int").alias("year"), f("journal").alias("journal"), f("publisher").alias("publisher"), F.element_at(t.literal_map({k: v[0] for k, v in BIBTEX_TYPES.items()}), F.col("kind")).alias("paper_type"),
        F.struct(F.lit("manual").alias("method"), F.lit(0).alias("iteration"), F.lit("manual").alias("source_database")).alias("discovery"), cited_dois(f("cites"), "backward").alias("citations"),
        cited_dois(f("citedby"), "forward").alias("cited_by"), "raw", f("studytype").alias("study_type"), F.coalesce(f("citedbycount").try_cast("int"), F.size(doi_list(f("citedby")))).alias("cited_by_count"),
        F.coalesce(f("lastchecked"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("last_checked"),
    )
    names = PAPER.fieldNames()
    none = [F.lit(None).cast(PAPER[n].dataType).alias(n) for n in names if n not in good.columns]
    good = good.select("*", *none).select(*(F.col(n).cast(PAPER[n].dataType).alias(n) for n in names), "study_type", "cited_by_count", "last_checked")
    return good, rows.where("_reason is not null").select("key", F.col("_reason").alias("reason"))


def read_exports(spark: SparkSession, paths: str | list[str], source: str) -> DataFrame:
    """Entries of an export of wos, scopus or ieee in one form, in order."""
    rows = read_entries(spark, paths)
    return rows.select("ord", translated(F.col("all_fields"), F.col("key"), F.col("kind"), source).alias("r")).select("ord", "r.*")


def read_bibtex(spark: SparkSession, paths: str | list[str], source: str | None = None, method: str = "keyword_search", iteration: int = 0, overrides=None, custom=None) -> DataFrame:
    """One paper a BibTeX entry; an entry without key or title fails the read."""

    rows = read_entries(spark, paths).withColumn("fields", F.struct(*(F.element_at("all_fields", f).alias(f) for f in FIELDS)))
    file_name = F.lower(F.element_at(F.split("path", "/"), -1))
    found = F.lit(source) if source else F.coalesce(*(F.when(file_name.contains(s), s) for s in SOURCES), F.lit("bibtex"))
    kind, _ = paper_type(F.col("kind"), found, overrides, custom)
    words = F.concat_ws(";", "fields.keyword", "fields.keywords", "fields.author_keywords", F.col("fields")["keywords-plus"])
    need = lambda x, what: F.when(F.coalesce(x, F.lit("")) == "", F.raise_error(F.lit(f"entry without {what}")).cast("string")).otherwise(x)
    return conform(_papers(rows, need(F.col("key"), "key"), need(F.col("fields.title"), "title"), words, "fields.author", kind, found, method, iteration))


def _papers(rows: DataFrame, key, title, words, author, kind, source, method, iteration) -> DataFrame:
    f = lambda n: F.col(f"fields.{n}")
    return rows.select(
        "ord", key.alias("id"), key.alias("cite_key"), key.alias("source_key"), doi_stem(f("doi")).alias("doi"), f("isbn").alias("isbn"), f("issn").alias("issn"), f("url").alias("url"),
        t.normalize_title(title).alias("title"), t.normalize_abstract(f("abstract")).alias("abstract"), t.normalize_keywords(words).alias("keywords"), parse_authors(F.col(author)).alias("authors"),
        t.normalize_year(F.coalesce(f("year"), f("date"))).alias("year"), t.normalize_title(f("journal")).alias("journal"), t.normalize_title(f("booktitle")).alias("booktitle"), f("publisher").alias("publisher"),
        kind.alias("paper_type"), f("volume").alias("volume"), f("issue").alias("issue"), f("number").alias("number"), f("pages").alias("pages"), F.coalesce(f("language"), F.lit("en")).alias("language"),
        F.struct(F.lit(method).alias("method"), F.lit(iteration).alias("iteration"), source.alias("source_database")).alias("discovery"), "raw",
    )


def read_ris(spark: SparkSession, paths: str | list[str], source: str = "ris", method: str = "keyword_search", iteration: int = 0) -> DataFrame:
    """One paper a RIS record; its key comes from the accession number, the DOI, or title
    and first author. A record without title fails the read."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, at, tags) for path, text in zip(frame.path, frame.text, strict=True) for at, tags in enumerate(ris_records(text))]
            yield pd.DataFrame(rows, columns=["path", "at", "tags"])

    rows = _ordered(_files(spark, paths).mapInPandas(parse, "path string, at int, tags map<string,array<string>>"))
    one = lambda *tags: F.coalesce(*(F.when(F.get(F.element_at("tags", k), F.lit(0)) != "", F.get(F.element_at("tags", k), F.lit(0))) for k in tags))
    many = lambda tag, sep: F.array_join(F.element_at("tags", tag), sep)
    pages = F.concat_ws("-", one("SP"), one("EP"))
    fields = F.struct(
        one("T1", "TI").alias("title"), one("AB", "N2").alias("abstract"), F.coalesce(many("AU", " and "), many("A1", " and ")).alias("author"), one("PY", "Y1", "DA").alias("year"), F.lit(None).cast("string").alias("date"), one("DO").alias("doi"),
        F.lit(None).cast("string").alias("isbn"), one("SN").alias("issn"), one("UR").alias("url"), one("JF", "JO", "T2").alias("journal"), F.lit(None).cast("string").alias("booktitle"), one("PB").alias("publisher"), one("VL").alias("volume"),
        one("IS").alias("issue"), F.lit(None).cast("string").alias("number"), F.when(pages != "", pages).alias("pages"), one("LA").alias("language"),
    )
    rows = rows.withColumn("fields", fields).withColumn("raw", F.to_json("tags"))
    first = F.coalesce(F.get(F.element_at("tags", "AU"), F.lit(0)), F.lit(""))
    auto = F.concat(F.lit("ris_auto_"), F.substring(F.md5(F.concat_ws("|", "fields.title", first)), 1, 8))
    key = F.coalesce(F.concat(F.lit("ris_an_"), one("AN")), F.concat(F.lit("ris_doi_"), doi_stem(one("DO"))), auto)
    title = F.when(F.col("fields.title").isNull(), F.raise_error(F.lit("record without title")).cast("string")).otherwise(F.col("fields.title"))
    kind = F.coalesce(F.element_at(t.literal_map(RIS_TYPES), F.lower(one("TY"))), F.lit("other"))
    return conform(_papers(rows, key, title, F.coalesce(many("KW", ";"), F.lit("")), "fields.author", kind, F.lit(source), method, iteration))


def read_jsonl(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """Papers from JSON lines (also gzipped): bad lines are skipped, or fail if strict."""
    return spark.read.schema(PAPER).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(paths)


def bad_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The lines that aren't JSON."""
    return spark.read.text(paths).where("trim(value) <> '' and try_parse_json(value) is null")


def read_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(PAPER).option("multiLine", True).json(paths)


DOI_IN_TEXT = [r"(?i)doi\.org/(10\.\d{4,9}/[^\s\"<>]+)", r"(?i)doi:\s*(10\.\d{4,9}/[^\s\"<>]+)", r"(10\.\d{4,9}/[^\s\"<>]+)"]


def doi_in_text(x):
    """The first DOI in running text, without trailing punctuation, in lower case."""
    found = F.coalesce(*(F.when(F.regexp_extract(x, p, 1) != "", F.regexp_extract(x, p, 1)) for p in DOI_IN_TEXT))
    return F.lower(F.regexp_replace(found, r"[.,;:)\]]+$", ""))


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", extract=None) -> DataFrame:
    """path, sha256, size, doi of files in order of path. ``extract`` turns a pandas Series
    of contents into texts; without it the bytes are read as Latin-1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    text = F.pandas_udf(extract, "string")("content") if extract else F.decode("content", "ISO-8859-1")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), doi_in_text(text).alias("doi")).orderBy("path")


def literal_papers(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of {doi, cite_key?, paper_type?}; a key is made from the DOI if there is none."""
    plain = spark.createDataFrame([(k, r.get("doi"), r.get("cite_key"), r.get("paper_type")) for k, r in enumerate(rows)], "ord long, raw_doi string, cite_key string, paper_type string")
    out = plain.withColumn("doi", doi_stem(F.col("raw_doi"))).withColumn("cite_key", F.coalesce("cite_key", doi_key(F.col("doi"))))
    return conform(out.withColumn("id", F.col("cite_key")).withColumn("discovery", F.struct(F.lit("manual").alias("method"), F.lit(0).alias("iteration"), F.lit("manual").alias("source_database"))))


def sample(df: DataFrame, limit: int | None = None, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """The first rows, or a seeded random choice; without limit nothing is shuffled."""
    if limit is None:
        return df
    return (df.orderBy(F.xxhash64("ord", F.lit(seed))) if shuffle else df.orderBy("ord")).limit(limit)


def merge_sources(target: DataFrame, sources: list[DataFrame], columns: list[str], key: str = "doi") -> DataFrame:
    """Fills columns from the first source that has a value: the order is the priority."""
    from ..operators.table import coalesce_join

    for s in sources:
        target = coalesce_join(target, s.dropDuplicates([key]), key, columns)
    return target


def due(keys: DataFrame, cache: DataFrame, ttl_days: float | None = 30, key: str = "doi") -> DataFrame:
    """What must be fetched: not in the cache, or older than the TTL (None never, 0 always)."""
    fresh = cache if ttl_days is None else cache.where(F.col("fetched_at") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(ttl_days) * 86400)))
    return keys.join(cache.limit(0) if ttl_days == 0 else fresh.select(key), key, "left_anti")
