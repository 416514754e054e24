"""Duplicate papers: exact DOI, fuzzy title, fuzzy title with first author.

A row is a duplicate if it matches an earlier row that is still primary. Similarity
doesn't depend on what is primary, so the matches are found once, between distinct titles,
as a static table of edges to earlier rows, and then resolved in rounds until none is open: a row all of whose
earlier matches are decided is decided; the last few edges are resolved in order. Candidate pairs come from blocks of rows with a common key; the
ratio's own upper bounds (lengths, then character counts) discard most of them in the
JVM before the pairwise comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identifiers import doi_stem
from ..functions.text import dedup_title
from ..storage import written

#: Open edges that the driver resolves at most, a few MB.
AT_ONCE = 100_000
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def ratio(new: Column | str, old: Column | str) -> Column:
    """difflib's 2M/T; its two arguments can't be exchanged."""

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    return compare(new, old)


def profile(x: Column) -> Column:
    """How often each common character occurs, and all others together."""
    rest = F.length(F.regexp_replace(x, f"[{LETTERS}]", ""))
    return F.array(*(F.length(x) - F.length(F.replace(x, F.lit(c))) for c in LETTERS), rest)


def length_bound(a: Column, b: Column) -> Column:
    return 2 * F.least(a, b) / (a + b)


def profile_bound(a: Column, b: Column) -> Column:
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    total = F.aggregate(F.concat(a, b), F.lit(0), lambda s, x: s + x)
    return 2 * common / total


def similar_titles(classes: DataFrame, threshold: float, block: Sequence[Column]) -> DataFrame:
    """new, old of classes (first, t, family) whose titles are similar, in both directions,
    as the ratio depends on it; also of each class with itself. A pair is compared if it
    shares any of the block keys."""
    keyed = classes.withColumn("n", F.length("t")).withColumn("p", profile(F.col("t"))).withColumn("key", F.explode(F.array(*block))).where("key is not null")
    old = keyed.select("key", F.col("first").alias("old"), F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("p").alias("p2"))
    pairs = keyed.join(old, "key").where("first <> old").where(length_bound(F.col("n"), F.col("n2")) >= threshold)
    pairs = pairs.where(profile_bound(F.col("p"), F.col("p2")) >= threshold).select(F.col("first").alias("new"), "old", "t", "t2").distinct()
    itself = keyed.select(F.col("first").alias("new"), F.col("first").alias("old")).distinct()
    return pairs.where(ratio("t", "t2") >= threshold).select("new", "old").unionByName(itself)


def length_bands(threshold: float) -> list[Column]:
    """Two overlapping bands of length on a logarithmic scale: titles whose lengths may
    reach the threshold share one."""
    import math

    width = -math.log(threshold / (2 - threshold)) * 2
    scale = F.log(F.col("n").cast("double")) / width
    return [F.concat(F.lit("a"), F.floor(scale).cast("string")), F.concat(F.lit("b"), F.floor(scale + 0.5).cast("string"))]


def in_order(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(ord, target) of open edges, one row after another."""
    found: dict[int, int] = {}
    for row, earlier in sorted(edges):  # a row's edges from the least earlier one on
        if row not in found and earlier not in found:
            found[row] = earlier
    return list(found.items())


def greedy(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = written, at_once: int = AT_ONCE) -> DataFrame:
    """ord, target: edges to earlier rows resolved first to last. A row is a duplicate of
    the least earlier row that ends up primary. Rounds go on until at most ``at_once``
    edges are open; these are resolved on the driver. ``cut`` must cut the lineage."""
    open_edges, found = cut(edges.select("ord", "earlier")), None
    primary = open_edges.select(F.col("earlier").alias("ord")).distinct().join(open_edges.select("ord").distinct(), "ord", "left_anti")
    rounds = 0
    while open_edges.count() > at_once:
        hits = open_edges.join(primary.select(F.col("ord").alias("earlier")), "earlier").groupBy("ord").agg(F.min("earlier").alias("target"))
        hits = cut(hits)
        found = hits if found is None else found.unionByName(hits)
        rounds += 1
        found = cut(found) if rounds % 16 == 0 else found  # else the plan grows with the rounds
        gone = hits.select("ord")
        # edges from decided rows, and edges to duplicates, say nothing more
        rest = open_edges.join(gone, "ord", "left_anti").join(gone.withColumnRenamed("ord", "earlier"), "earlier", "left_anti").select("ord", "earlier")
        rest = cut(rest)
        waiting = rest.select("ord").distinct()
        freed = open_edges.join(gone, "ord", "left_anti").select("ord").distinct().join(waiting, "ord", "left_anti")
        heads = rest.select(F.col("earlier").alias("ord")).distinct().join(waiting, "ord", "left_anti")
        primary = cut(primary.unionByName(freed).unionByName(heads).distinct())
        open_edges = rest
    last = edges.sparkSession.createDataFrame(in_order([(r.ord, r.earlier) for r in open_edges.collect()]), T.StructType([T.StructField(c, edges.schema["ord"].dataType) for c in ("ord", "target")]))
    return last if found is None else found.unionByName(last)


def deduplicate(papers: DataFrame, methods: Sequence[dict], cut: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """ord, target, method for every duplicate. Methods, tried in order: doi_exact,
    title_author_fuzzy and title_fuzzy (with threshold)."""
    rows = papers.select("ord", doi_stem(F.col("doi")).alias("stem"), dedup_title(F.col("title")).alias("t"), F.lower(F.get("authors", F.lit(0))["family_name"]).alias("family"))
    firsts = rows.where("stem is not null").groupBy("stem").agg(F.min("ord").alias("target"))
    same = rows.join(firsts, "stem").where("ord > target").select("ord", "target", F.lit("doi_exact").alias("method"))
    rest = rows.join(same.select("ord"), "ord", "left_anti").where("t <> ''")
    # rows of one title and family are similar to the same rows: only the first can be primary
    classes = cut(rest.groupBy("t", "family").agg(F.min("ord").alias("first")))
    parts = []
    for k, m in enumerate(methods):
        if m["method"] == "title_author_fuzzy":
            parts.append(similar_titles(classes, m.get("threshold", 0.90), [F.col("family")]).withColumn("k", F.lit(k)))
        elif m["method"] == "title_fuzzy":
            parts.append(similar_titles(classes, m.get("threshold", 0.95), length_bands(m.get("threshold", 0.95))).withColumn("k", F.lit(k)))
    out = same if any(m["method"] == "doi_exact" for m in methods) else same.limit(0)
    if parts:
        pairs = parts[0]
        for p in parts[1:]:
            pairs = pairs.unionByName(p)
        pairs = cut(pairs)
        edges = pairs.where("old < new").select(F.col("new").alias("ord"), F.col("old").alias("earlier")).distinct()
        duplicates = greedy(edges, cut)
        primary = pairs.join(duplicates.select(F.col("ord").alias("old")), "old", "left_anti")
        same_class = (F.col("r.t") == F.col("c.t")) & F.col("r.family").eqNullSafe(F.col("c.family"))
        members = rest.alias("r").join(classes.alias("c"), same_class).select("r.ord", F.col("c.first").alias("new"))
        best = members.join(primary, "new").where("old < ord").groupBy("ord").agg(F.min(F.struct("k", "old")).alias("best"))
        names = F.array(*(F.lit(m["method"]) for m in methods))
        out = out.unionByName(best.select("ord", F.col("best.old").alias("target"), F.get(names, F.col("best.k")).alias("method")))
    return out
