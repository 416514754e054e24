"""Writers: JSON lines, BibTeX, partitioned and split files, projections, checkpoints."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAPER, is_duplicate, is_included

# Named partial projections.
PROJECTIONS = {
    "minimal": ["id", "cite_key", "title", "year", "doi"],
    "bibliographic": ["id", "cite_key", "title", "abstract", "authors", "year", "journal", "booktitle", "publisher", "volume", "issue", "number", "pages", "doi", "isbn", "issn", "url", "keywords", "paper_type"],
    "screening": ["id", "cite_key", "title", "screening"],
    "camo": ["id", "cite_key", "title", "camo"],
}
# Entry types of paper types.
ENTRY_TYPES = {"journal_article": "article", "conference_paper": "inproceedings", "book": "book", "book_chapter": "incollection", "thesis": "phdthesis", "technical_report": "techreport", "working_paper": "unpublished"}


def three_way(df: DataFrame, condition: Column, flag: str) -> DataFrame:
    """only, no, or yes (no filter)."""
    return {"only": df.where(condition), "no": df.where(~condition), "yes": df}[flag]


def select_for_export(df: DataFrame, doi: str = "only", duplicates: str = "no", includes: str = "only") -> DataFrame:
    df = three_way(df, F.col("doi").isNotNull(), doi)
    return three_way(three_way(df, is_duplicate(), duplicates), is_included(), includes)


def bibtex_line(c: str, value: Column) -> Column:
    return F.concat(F.lit(f"  {c} = {{"), F.regexp_replace(value.cast("string"), r"(?<!\\)&", r"\\&"), F.lit("}"))


def bibtex(df: DataFrame) -> DataFrame:
    """cite_key, value: one BibTeX entry a row."""
    from ..functions.text import literal_map

    kind = F.coalesce(F.element_at(literal_map(ENTRY_TYPES), F.col("paper_type")), F.lit("misc"))
    names = F.array_join(F.transform("authors", lambda a: F.concat_ws(", ", a["family_name"], a["given_name"])), " and ")
    values = {"title": F.col("title"), "author": F.when(F.size("authors") > 0, names), "year": F.col("year"), **{c: F.col(c) for c in ("journal", "booktitle", "publisher", "volume", "issue", "number", "pages", "doi", "url", "abstract")}, "keywords": F.when(F.size("keywords") > 0, F.array_join("keywords", "; "))}
    body = F.concat_ws(",\n", *(bibtex_line(c, v) for c, v in values.items()))
    return df.select("cite_key", F.concat(F.lit("@"), kind, F.lit("{"), F.col("cite_key"), F.lit(",\n"), body, F.lit("\n}\n")).alias("value"))


def export(df: DataFrame, path: str, kind: str = "jsonl", overwrite: bool = False, exclude_none: bool = True, gzip: bool = False, rows_per_file: int = 0, partition_by: str | None = None, **flags: str) -> None:
    """Writes what the flags select; an existing target is an error unless overwriting."""
    df = select_for_export(df, **flags)
    if kind == "bibtex":
        writer = bibtex(df).orderBy("cite_key").select("value").write
    else:
        if partition_by == "final_decision":
            df = df.withColumn("final_decision", F.coalesce("screening.final_decision", F.lit("pending")))
        writer = df.write.option("ignoreNullFields", exclude_none)
        writer = writer.partitionBy(partition_by) if partition_by else writer
    writer = writer.mode("overwrite" if overwrite else "error")
    writer = writer.option("compression", "gzip") if gzip else writer
    writer = writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer
    writer.text(path) if kind == "bibtex" else writer.json(path)


def append_errors(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def project(df: DataFrame, name: str) -> DataFrame:
    return df.select(*PROJECTIONS[name])


def checkpoint_path(folder: str, project_name: str, step: int) -> str:
    return f"{folder}/checkpoint_{hashlib.md5(project_name.encode()).hexdigest()[:8]}_step_{step:03d}"


def write_checkpoint(df: DataFrame, folder: str, project_name: str, step: int) -> DataFrame:
    path = checkpoint_path(folder, project_name, step)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest_checkpoint(spark: SparkSession, folder: str, project_name: str, steps: int) -> tuple[int, DataFrame] | None:
    """The last step with a complete checkpoint, and its table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for step in reversed(range(steps)):
        path = checkpoint_path(folder, project_name, step)
        done = hadoop.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(conf).exists(done):
            return step, spark.read.schema(PAPER).parquet(path)
    return None


def same_after_round_trip(df: DataFrame, path: str) -> bool:
    """Writes and reads JSON lines; whether all rows came back."""
    df.write.mode("overwrite").json(path)
    back = df.sparkSession.read.schema(df.schema).json(path)
    text = lambda x: x.select(F.to_json(F.struct("*")).alias("row"))
    return text(df).exceptAll(text(back)).isEmpty() and text(back).exceptAll(text(df)).isEmpty()


def save_table(df: DataFrame, name: str, keys: list[str], mode: str = "skip") -> None:
    """Upserts into a catalogue table (papers by cite_key, edges by both ends, chunks by paper
    and index, vectors by chunk): skip keeps old rows, update takes new ones. The new state is
    written aside first, as a table can't be overwritten while it is read."""
    from ..operators.table import upsert
    from ..storage import written

    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        df = upsert(spark.table(name), df, keys, mode)
    written(df, "upsert").write.mode("overwrite").saveAsTable(name)


def load_table(spark: SparkSession, name: str, **equal: object) -> DataFrame:
    """Rows of a catalogue table whose columns have the given values (by cite_key, by DOI)."""
    out = spark.table(name)
    for c, v in equal.items():
        out = out.where(F.col(c) == F.lit(v))
    return out


def load_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an outside database; filters reach it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def clear_tables(spark: SparkSession, names: list[str]) -> None:
    """Empties tables, those that point to others first, as they are given."""
    for name in names:
        if spark.catalog.tableExists(name):
            spark.sql(f"TRUNCATE TABLE {name}")


def cache_files(spark: SparkSession, folder: str) -> DataFrame:
    """kind, files, bytes, newest of a cache folder's files by their endings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"))
