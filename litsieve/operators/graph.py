"""The citation graph as an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(papers: DataFrame) -> DataFrame:
    """Distinct (citing, cited) by DOI, from both directions of citation lists."""
    out = papers.select(F.col("doi").alias("citing"), F.explode("citations.doi").alias("cited"))
    back = papers.select(F.explode("cited_by.doi").alias("citing"), F.col("doi").alias("cited"))
    return out.union(back).where("citing is not null and cited is not null").distinct()


def degrees(nodes: DataFrame, edge: DataFrame, node: str = "id", citing: str = "citing", cited: str = "cited") -> DataFrame:
    """Nodes with their counts of incoming and outgoing edges (0 if none)."""
    inbound = edge.groupBy(F.col(cited).alias(node)).agg(F.count("*").alias("n_in"))
    outbound = edge.groupBy(F.col(citing).alias(node)).agg(F.count("*").alias("n_out"))
    out = nodes.join(inbound, node, "left").join(outbound, node, "left")
    return out.withColumn("n_in", F.coalesce("n_in", F.lit(0))).withColumn("n_out", F.coalesce("n_out", F.lit(0)))


def resolve(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """citations (doi, title, year, ...) with resolved_id: by DOI, else by title and year;
    of several papers the first by ord; unresolved ones keep null."""
    first = lambda *k: papers.where(" and ".join(f"{c} is not null" for c in k)).groupBy(*k).agg(F.min_by("id", "ord").alias("found"))
    out = citations.join(first("doi").withColumnRenamed("found", "_by_doi"), "doi", "left")
    out = out.join(first("title", "year").withColumnRenamed("found", "_by_title"), ["title", "year"], "left")
    return out.withColumn("resolved_id", F.coalesce("_by_doi", "_by_title")).select(*citations.columns, "resolved_id")


def snowball(seeds: DataFrame, edge: DataFrame, depth: int, forward: bool = False, keep: Column | None = None, cut=None) -> DataFrame:
    """id, iteration of everything reached from seeds (id) in at most ``depth`` steps,
    backward along citing -> cited, or forward. ``cut`` writes a round's result (for deep
    expansions, as a lineage grows by a join a round)."""
    a, b = ("cited", "citing") if forward else ("citing", "cited")
    step = edge.select(F.col(a).alias("id"), F.col(b).alias("next"))
    step = step if keep is None else step.where(keep)
    reached = seeds.select("id").distinct().withColumn("iteration", F.lit(0))
    wave = reached
    for k in range(1, depth + 1):
        wave = wave.select("id").join(step, "id").select(F.col("next").alias("id")).distinct().join(reached.select("id"), "id", "left_anti").withColumn("iteration", F.lit(k))
        wave = cut(wave) if cut else wave
        reached = reached.unionByName(wave)
    return reached


def network(nodes: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with degrees and a colour group, and links whose ends are both nodes."""
    rank = F.row_number().over(Window.orderBy("id")) - 1
    seen = degrees(nodes, edge).withColumn("group", F.pmod(rank, F.lit(10)))
    ids = nodes.select("id")
    links = edge.join(ids.withColumnRenamed("id", "citing"), "citing", "left_semi").join(ids.withColumnRenamed("id", "cited"), "cited", "left_semi")
    return seen, links


def reading_list(neighbours: DataFrame, start, length: int) -> list:
    """Breadth-first walk over a neighbour table (id, rank, near). The walk itself visits
    ``length`` nodes on the driver; each wave is one filtered read."""
    seen, wave = [start], [start]
    while wave and len(seen) < length:
        rows = neighbours.where(F.col("id").isin(wave)).orderBy("id", "rank").collect()
        by = {w: [r.near for r in rows if r.id == w] for w in wave}
        found = [x for w in wave for x in by[w]]
        wave = [x for x in dict.fromkeys(found) if x not in seen][: length - len(seen)]
        seen += wave
    return seen
