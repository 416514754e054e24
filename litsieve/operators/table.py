"""The fluent query builder and set operations over paper tables.

A query is an immutable list of lazy steps on a DataFrame: filters are Columns that reach
the scan, ordering plus a limit becomes one top-k operator. Callables are accepted as an
escape hatch and run as an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.identifiers import doi_stem
from ..functions.text import title_key, trimmed
from ..schema import decision, is_duplicate, is_excluded, is_included


def contains(x: Column, term: str) -> Column:
    return F.coalesce(F.contains(F.lower(x), F.lit(term.lower())), F.lit(False))


@dataclass(frozen=True)
class Query:
    """filter, by_* and grep narrow; the last order_by counts; top(0) is no limit."""

    df: DataFrame
    order: tuple[Column, ...] = ()
    size: int = 0
    tie: str = "ord"

    def filter(self, condition: Column | Callable[[Row], bool]) -> Query:
        if not isinstance(condition, Column):
            test = F.udf(condition, "boolean", useArrow=True)
            condition = test(F.struct("*"))
        return replace(self, df=self.df.where(condition))

    def by_topic(self, topic: str) -> Query:
        return self.filter(F.exists("keywords", lambda k: contains(k, topic)))

    def by_author(self, name: str) -> Query:
        return self.filter(F.exists("authors", lambda a: contains(a["full_name"], name)))

    def by_year(self, low: int, high: int | None = None) -> Query:
        return self.filter(F.col("year").between(low, low if high is None else high))

    def by_doi(self, doi: str) -> Query:
        wanted = doi_stem(F.lit(doi))
        return self.filter(doi_stem(F.col("doi")) == F.coalesce(wanted, F.raise_error(F.lit(f"not a DOI: {doi}"))))

    def by_id(self, key: str) -> Query:
        return self.filter(F.col("id") == key)

    def by_cite_key(self, key: str) -> Query:
        return self.filter(F.col("cite_key") == key)

    def by_title_prefix(self, title: str) -> Query:
        return self.filter(title_key(F.col("title")) == title_key(F.lit(title)))

    def near_year(self, year: int, tolerance: int = 1, primary_only: bool = True) -> Query:
        q = self.by_year(year - tolerance, year + tolerance)
        return q.exclude_duplicates() if primary_only else q

    def grep(self, term: str, columns: Sequence[str] = ("title", "abstract")) -> Query:
        condition = F.lit(False)
        for c in columns:
            condition = condition | contains(F.col(c), term)
        return self.filter(condition)

    def sidebar(self, term: str) -> Query:
        """A term in the title (or else the key), names, journal, year, DOI, tags or research
        questions, of those that the table has."""
        have = set(self.df.columns)
        text = [F.when(F.coalesce("title", F.lit("")) == "", F.col("cite_key")).otherwise(F.col("title")) if "cite_key" in have else F.col("title")]
        if "authors" in have:
            text.append(F.array_join(F.transform("authors", lambda a: F.concat_ws(" ", a["family_name"], a["given_name"])), " "))
        text += [F.col(c).cast("string") for c in ("journal", "year", "doi", "tags", "research_questions") if c in have]
        condition = F.lit(False)
        for x in text:
            condition = condition | contains(x, term)
        return self.filter(condition)

    def show(self, what: str = "all") -> Query:
        """The named filters of the console."""
        named = {"manual": lambda: decision() == "manual_review", "included": is_included, "excluded": is_excluded, "duplicates": is_duplicate, "all": lambda: F.lit(True)}
        if what not in named:
            raise ValueError(f"unknown filter {what}")
        return self.filter(named[what]())

    def exclude_duplicates(self) -> Query:
        return self.filter(F.col("duplicate_of").isNull())

    def order_by_year(self, descending: bool = True) -> Query:
        year = F.coalesce("year", F.lit(0))
        return replace(self, order=(year.desc() if descending else year.asc(),))

    def order_by_title(self, descending: bool = False) -> Query:
        title = F.coalesce(F.lower("title"), F.lit(""))
        return replace(self, order=(title.desc() if descending else title.asc(),))

    def order_by(self, *keys: Column) -> Query:
        return replace(self, order=keys)

    def top(self, n: int) -> Query:
        return replace(self, size=n)

    limit = top

    def result(self) -> DataFrame:
        out = self.df
        if self.order:
            out = out.orderBy(*self.order, self.tie)  # a stable sort keeps the order of ties
        elif self.size:
            out = out.orderBy(self.tie)
        return out.limit(self.size) if self.size else out

    def first(self) -> Row | None:
        return self.top(1).result().first()

    def count(self) -> int:
        return self.result().count()

    def exists(self) -> bool:
        return not self.df.isEmpty()

    def page(self, number: int, size: int) -> DataFrame:
        """The numbered page (from 1) in the query's order."""
        order = self.order or (F.col(self.tie),)
        return self.df.orderBy(*order, self.tie).offset((number - 1) * size).limit(size)

    def __getitem__(self, index: int | slice) -> DataFrame:
        at = index if isinstance(index, slice) else slice(index, index + 1)
        start = at.start or 0
        out = self.df.orderBy(*self.order, self.tie).offset(start)
        return out if at.stop is None else out.limit(at.stop - start)


def first_per_key(df: DataFrame, key: str, order: str, name: str = "first_id", value: str = "id") -> DataFrame:
    """The value of the first row of each key, beside every row (null keys have none)."""
    w = Window.partitionBy(key)
    return df.withColumn(name, F.when(F.col(key).isNotNull(), F.min_by(value, order).over(w)))


def union_by_id(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """All of left, and what is only in right."""
    return left.unionByName(right.join(left.select(key), key, "left_anti").select(*left.columns))


def difference_by_id(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def equal_tables(left: DataFrame, right: DataFrame) -> bool:
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def merge(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Dictionary merge: MERGE adds right's columns, INTERSECT and EXCEPT filter left."""
    return left.join(right, list(keys), {"MERGE": "left", "INTERSECT": "left_semi", "EXCEPT": "left_anti"}[how.upper()])


def add(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Appends; a key that would repeat fails when the result is used."""
    both = table.unionByName(new, allowMissingColumns=True)
    times = F.count("*").over(Window.partitionBy(key))
    return both.withColumn(key, F.when(times > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string"))).cast(both.schema[key].dataType)).otherwise(F.col(key)))


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], mode: str = "skip") -> DataFrame:
    """skip keeps old rows, update takes new ones, raise fails on a conflict."""
    keys = list(keys)
    new = new.select(*table.columns)
    if mode == "update":
        return table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(new)
    if mode == "raise" and not table.join(new.select(*keys), keys, "left_semi").isEmpty():
        raise ValueError("conflicting keys")
    return table.unionByName(new.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def coalesce_join(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Fills target's columns from source, or prefers source's if overwriting."""
    renamed = source.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    pick = lambda c: F.coalesce(f"_new_{c}", c) if overwrite else F.coalesce(c, f"_new_{c}")
    return target.join(renamed, key, "left").select(*(pick(c).alias(c) if c in columns else F.col(c) for c in target.columns))


def patch(df: DataFrame, patches: DataFrame, key: str, replaced: Sequence[str] = (), appended: Sequence[str] = ()) -> DataFrame:
    """Applies patches (key, replace_<column>, append_<column>): replacing where a value is
    given, appending text or list elements."""
    out = df.join(patches, key, "left")
    for c in replaced:
        out = out.withColumn(c, F.coalesce(f"replace_{c}", c))
    for c in appended:
        empty = F.array().cast(df.schema[c].dataType) if df.schema[c].dataType.typeName() == "array" else F.lit("")
        out = out.withColumn(c, F.when(F.col(f"append_{c}").isNull(), F.col(c)).otherwise(F.concat(F.coalesce(c, empty), f"append_{c}")))
    return out.select(*df.columns)


def mark_duplicates(df: DataFrame, marks: DataFrame, key: str = "id") -> DataFrame:
    """marks (key, duplicate_of); a null duplicate_of makes the paper primary again. A mark
    whose paper, or whose primary paper, isn't in the table fails when the result is used."""
    known = df.select(F.col(key).alias("_key"))
    there = marks.select(F.col(key).alias("_of"), F.col("duplicate_of").alias("_to"))
    lost = there.join(known, F.col("_of") == F.col("_key"), "left_anti").select(F.col("_of").alias("_lost"))
    lost = lost.union(there.where("_to is not null").join(known, F.col("_to") == F.col("_key"), "left_anti").select("_to")).agg(F.first("_lost").alias("_lost"))
    out = df.join(there, F.col(key) == F.col("_of"), "left").crossJoin(F.broadcast(lost))  # one row
    mark = F.when(F.col("_lost").isNotNull(), F.raise_error(F.concat(F.lit("no paper "), F.col("_lost").cast("string"))).cast("string"))
    changed = mark.otherwise(F.when(F.col("_of").isNotNull(), F.col("_to").cast("string")).otherwise(F.col("duplicate_of")))
    return out.withColumn("duplicate_of", changed).select(*df.columns)


def duplicates_of(df: DataFrame, key: str) -> DataFrame:
    """The papers marked as duplicates of one."""
    return df.where(F.col("duplicate_of") == key)


def touched(df: DataFrame, changed: Column, column: str = "updated_at") -> DataFrame:
    """Sets the time of update where rows change."""
    return df.withColumn(column, F.when(changed, F.current_timestamp()).otherwise(F.col(column)))


def json_paths(df: DataFrame, key: str, record: str) -> DataFrame:
    """key, field, value: every leaf of a flat or nested JSON object of text values."""
    top = df.select(key, F.explode(F.from_json(record, "map<string,string>")).alias("field", "value"))
    inner = top.where("value like '{%'").select(key, "field", F.explode(F.from_json("value", "map<string,string>")).alias("f", "v"))
    return top.where("value is null or value not like '{%'").unionByName(inner.select(key, F.concat_ws(".", "field", "f").alias("field"), F.col("v").alias("value")))


def json_search(df: DataFrame, key: str, record: str, term: str) -> DataFrame:
    """The leaves whose name or value has the term."""
    found = json_paths(df, key, record)
    return found.where(contains(F.col("field"), term) | contains(F.col("value"), term))


def split_tags(x: Column) -> Column:
    return F.array_distinct(F.filter(trimmed(F.split(x, ":")), lambda t: t != ""))
