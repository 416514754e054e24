"""Queries over the driver's tables, each with the SQL that gives the same rows.

There is no bibliographic table, so every operator runs on columns of the same shape:
documents are papers (title: first line; abstract: text), labels their recorded
screening, lineitem the citation edges (order cites part), embeddings the vectors,
conversations the chunks, pages the marked-up text, events the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import text as t
from ..functions import vectors as v
from ..operators import chunks, dedup, graph, reports, screening, table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paper view of documents."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("language"), F.col("source").alias("source_database"), "n_chars")


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated papers."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderpriority", "o_totalprice", F.col("o_custkey").alias("author_id"))


def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


# §2.3 predicates and lookups, §2.6 order, limits and set operations


@query("SELECT doc_id AS id, split_part(text, chr(10), 1) AS title FROM documents WHERE contains(lower(split_part(text, chr(10), 1)), 'tion') OR contains(lower(text), 'tion')")
def grep_text(spark, d):
    return table.Query(papers(spark, d)).grep("tion").result().select("id", "title")


@query("SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, n_chars FROM documents WHERE contains(lower(text), 'license') ORDER BY n_chars DESC, doc_id LIMIT 10")
def grep_top(spark, d):
    return table.Query(papers(spark, d)).grep("license").order_by(F.desc("n_chars")).top(10).result().select("id", "title", "n_chars")


@query("SELECT p_partkey AS id, p_type FROM part WHERE list_contains(list_transform(string_split(p_type, ' '), lambda k: contains(lower(k), 'brush')), true)")
def by_topic(spark, d):
    df = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type", F.split("p_type", " ").alias("keywords"))
    return table.Query(df).by_topic("brush").result().select("id", "p_type")


@query("SELECT c_custkey AS id, c_name FROM customer WHERE contains(lower(c_name), '00012')")
def by_author(spark, d):
    df = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.array(ids.split_name(F.col("c_name"))).alias("authors"))
    return table.Query(df).by_author("00012").result().select("id", "c_name")


@query("SELECT o_orderkey AS id, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1995")
def year_range_inclusive(spark, d):
    return table.Query(years(spark, d)).by_year(1994, 1995).result().select("id", "year")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE year(o_orderdate) END::INT AS year FROM orders ORDER BY coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE year(o_orderdate) END, 0) DESC, o_orderkey LIMIT 25")
def order_null_as_zero_topk(spark, d):
    df = years(spark, d).withColumn("year", F.when(F.col("o_orderstatus") != "P", F.col("year")))
    return table.Query(df).order_by_year().top(25).result().select("id", "year")


@query("SELECT c_custkey AS id, c_name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 20 OFFSET 40")
def page_slice(spark, d):
    df = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("title"), "c_name")
    return table.Query(df).order_by_title().page(3, 20).select("id", "c_name")


@query("SELECT o_orderkey AS id, o_orderpriority FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderpriority FROM orders o WHERE o_totalprice > 100000 AND NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_orderstatus = 'F' AND f.o_orderkey = o.o_orderkey)")
def set_union_by_id(spark, d):
    y = years(spark, d).select("id", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return table.union_by_id(y.where("o_orderstatus = 'F'"), y.where("o_totalprice > 100000")).select("id", "o_orderpriority")


@query("SELECT o_orderkey AS id, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)")
def set_difference_by_id(spark, d):
    y = years(spark, d)
    return table.difference_by_id(y.where("o_orderstatus = 'F'"), y.where("o_totalprice > 100000")).select("id", "o_orderpriority")


@query("SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def jsonl_merge(spark, d):
    return table.merge(read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "MERGE")


@query("SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def jsonl_intersect(spark, d):
    return table.merge(read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels"), ["doc_id"], "INTERSECT")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def jsonl_except(spark, d):
    return table.merge(read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels"), ["doc_id"], "EXCEPT")


# §2.4 joins, duplicates, graph


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents")
def dup_first_wins(spark, d):
    df = papers(spark, d).select("id", "ord", F.sha2("abstract", 256).alias("key"))
    return table.first_per_key(df, "key", "ord").select("id", "first_id")


@query("SELECT min(doc_id) AS first_id, count(*) AS n FROM (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS key FROM documents) GROUP BY key HAVING count(*) > 1")
def dup_groups_normalized(spark, d):
    df = papers(spark, d).select("id", F.sha2(t.dedup_title(F.col("abstract")), 256).alias("key"))
    return df.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "n")


@query("SELECT (SELECT count(*) FROM documents) AS total, coalesce(sum(n), 0)::BIGINT AS with_key, count(*) AS unique_keys, count(*) FILTER (n > 1) AS duplicate_groups, coalesce(max(n), 0) AS max_per_key FROM (SELECT sha256(text) k, count(*) n FROM documents WHERE text IS NOT NULL GROUP BY 1)")
def db_stats(spark, d):
    return reports.duplicate_stats(papers(spark, d).select(F.sha2("abstract", 256).alias("key")), "key")


@query("SELECT source, count(*) AS papers, count(*) - count(DISTINCT sha256(text)) AS duplicates FROM documents GROUP BY source")
def count_duplicates(spark, d):
    df = papers(spark, d).select("source_database", F.sha2("abstract", 256).alias("key"))
    return df.groupBy(F.col("source_database").alias("source")).agg(F.count("*").alias("papers"), (F.count("*") - F.countDistinct("key")).alias("duplicates"))


@query("SELECT p_partkey AS id, coalesce(n_in, 0) AS n_in FROM part LEFT JOIN (SELECT l_partkey, count(*) n_in FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1) ON l_partkey = p_partkey")
def degree_counts(spark, d):
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return graph.degrees(nodes, citation_edges(spark, d).distinct()).select("id", "n_in")


@query("SELECT p_partkey AS id, p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY n DESC, id LIMIT 20")
def most_cited(spark, d):
    n = citation_edges(spark, d).groupBy(F.col("cited").alias("p_partkey")).agg(F.count("*").alias("n"))
    return read(spark, d, "part").join(n, "p_partkey").select(F.col("p_partkey").alias("id"), "p_name", "n").orderBy(F.desc("n"), "id").limit(20)


@query("SELECT o_orderkey AS id, count(DISTINCT l_partkey) AS citations FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def papers_with_citations(spark, d):
    n = citation_edges(spark, d).groupBy(F.col("citing").alias("id")).agg(F.countDistinct("cited").alias("citations"))
    return years(spark, d).select("id").join(n, "id", "left").select("id", F.coalesce("citations", F.lit(0)).alias("citations"))


@query("SELECT DISTINCT p_partkey AS id, p_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7 ORDER BY p_name")
def cited_papers_of(spark, d):
    mine = years(spark, d).where("author_id = 7").select(F.col("id").alias("citing"))
    cited = citation_edges(spark, d).join(mine, "citing").select(F.col("cited").alias("p_partkey")).distinct()
    return read(spark, d, "part").join(cited, "p_partkey").select(F.col("p_partkey").alias("id"), "p_name").orderBy("p_name")


@query("SELECT l_orderkey AS citing, l_partkey AS cited, o_orderstatus, p_brand FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey")
def network_links(spark, d):
    e = citation_edges(spark, d).join(years(spark, d).select(F.col("id").alias("citing"), "o_orderstatus"), "citing")
    return e.join(read(spark, d, "part").select(F.col("p_partkey").alias("cited"), "p_brand"), "cited").select("citing", "cited", "o_orderstatus", "p_brand")


@query("SELECT o.o_orderkey AS id, coalesce(a.s_suppkey, b.s_suppkey) AS resolved_id FROM orders o LEFT JOIN supplier a ON a.s_suppkey = o.o_custkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) s_suppkey FROM supplier GROUP BY 1) b ON b.s_nationkey = o.o_custkey % 31")
def resolve_doi_else_title(spark, d):
    s = read(spark, d, "supplier")
    known = s.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("doi"), F.lit("t").alias("title"), F.col("s_nationkey").alias("year"))
    cites = years(spark, d).select("id", F.col("author_id").cast("string").alias("doi"), F.lit("t").alias("title"), F.pmod("author_id", F.lit(31)).cast("int").alias("year"))
    return graph.resolve(cites, known).select("id", "resolved_id")


@query("SELECT DISTINCT a, b FROM (SELECT l_partkey a, l_suppkey b FROM lineitem UNION ALL SELECT l_suppkey, l_partkey FROM lineitem)")
def edges_distinct_bidirectional(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return e.union(e.select("b", "a")).distinct()


@query("""WITH e AS (SELECT DISTINCT l_partkey AS citing, l_suppkey AS cited FROM lineitem), l0 AS (SELECT DISTINCT s_suppkey AS id FROM supplier WHERE s_nationkey = 3),
l1 AS (SELECT DISTINCT cited AS id FROM e JOIN l0 ON citing = id WHERE cited NOT IN (SELECT id FROM l0)),
l2 AS (SELECT DISTINCT cited AS id FROM e JOIN l1 ON citing = id WHERE cited NOT IN (SELECT id FROM l0 UNION SELECT id FROM l1))
SELECT id, 0 AS iteration FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2""")
def snowball_levels(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_partkey").alias("citing"), F.col("l_suppkey").alias("cited")).distinct()
    seeds = read(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("id"))
    return graph.snowball(seeds, e, 2)


@query("SELECT c_custkey AS id, coalesce(n_name, 'unknown') AS journal FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def journal_lookup_fallback(spark, d):
    n = read(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return read(spark, d, "customer").join(n, "c_nationkey", "left").select(F.col("c_custkey").alias("id"), F.coalesce("n_name", F.lit("unknown")).alias("journal"))


# §2.5 aggregations and reports


@query("SELECT count(*) AS papers, min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year, count(DISTINCT o_custkey) AS distinct_authors, count(*) FILTER (o_orderstatus <> 'P') AS with_doi FROM orders")
def summary_report(spark, d):
    return years(spark, d).agg(F.count("*").alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("author_id").alias("distinct_authors"), reports.count_if(F.col("o_orderstatus") != "P").alias("with_doi"))


@query("SELECT lang AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM documents GROUP BY lang")
def tabulate_field(spark, d):
    return reports.tabulate(papers(spark, d), F.col("language"))


@query("""SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS group_name, count(*) AS total, count(*) FILTER (quality IS NULL) AS unscreened, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (toxic = 1) AS manual_review, count(*) FILTER (quality = 1 AND toxic = 0) AS included
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)""")
def screening_funnel(spark, d):
    df = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    q, x = F.col("quality"), F.col("toxic")
    return reports.funnel(df, F.col("source"), unscreened=q.isNull(), failed=q == 0, manual_review=x == 1, included=(q == 1) & (x == 0))


@query("SELECT source, count(*) FILTER (decision = 'included') AS included, count(*) FILTER (decision = 'excluded') AS excluded, count(*) FILTER (decision = 'pending') AS pending FROM (SELECT source, CASE WHEN quality = 1 AND toxic = 0 THEN 'included' WHEN quality IS NOT NULL THEN 'excluded' ELSE 'pending' END AS decision FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY source")
def source_decision_pivot(spark, d):
    df = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    df = df.withColumn("decision", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "included").when(F.col("quality").isNotNull(), "excluded").otherwise("pending"))
    return reports.pivot_counts(df, "source", "decision", ["included", "excluded", "pending"])


@query("SELECT n_in, count(*) AS rows_with, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM (SELECT count(l_partkey) AS n_in FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey) GROUP BY n_in")
def citation_distribution(spark, d):
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return reports.distribution(graph.degrees(nodes, citation_edges(spark, d)).select("n_in"))


@query("SELECT year(o_orderdate)::INT AS iteration, count(DISTINCT o_orderkey) AS papers, count(l_orderkey) AS citations, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS with_doi FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY GROUPING SETS ((year(o_orderdate)), ())")
def citation_stats_rollup(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.when(F.col("l_returnflag") != "N", F.lit("10.1/x")).alias("doi")).alias("c"))
    per = li.groupBy("id").agg(F.collect_list("c").alias("citations"))
    df = years(spark, d).join(per, "id", "left").select("id", F.struct(F.col("year").alias("iteration")).alias("discovery"), "citations")
    return reports.citation_stats(df)


@query("SELECT (o_custkey % 3)::INT AS iteration, year(o_orderdate)::INT AS year, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def included_by_iteration_year(spark, d):
    df = years(spark, d).select("year", F.lit(None).cast("string").alias("duplicate_of"), F.struct(F.pmod("author_id", F.lit(3)).cast("int").alias("iteration")).alias("discovery"), F.struct(F.when(F.col("o_orderstatus") == "F", "included").alias("final_decision")).alias("screening"))
    return reports.included_by_iteration_year(df)


@query("SELECT count(*) FILTER (s >= 0.65) AS high, count(*) FILTER (s >= 0.55 AND s < 0.65) AS good, count(*) FILTER (s >= 0.45 AND s < 0.55) AS fair, count(*) FILTER (s < 0.45) AS low FROM (SELECT o_totalprice / max(o_totalprice) OVER () AS s FROM orders)")
def similarity_buckets(spark, d):
    top = years(spark, d).agg(F.max("o_totalprice").alias("top"))
    s = years(spark, d).crossJoin(top).select((F.col("o_totalprice") / F.col("top")).alias("s"))  # one row
    x = F.col("s")
    return s.agg(reports.count_if(x >= 0.65).alias("high"), reports.count_if((x >= 0.55) & (x < 0.65)).alias("good"), reports.count_if((x >= 0.45) & (x < 0.55)).alias("fair"), reports.count_if(x < 0.45).alias("low"))


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders WHERE o_totalprice > 400000 GROUP BY 1")
def year_overview_nested(spark, d):
    y = years(spark, d).where("o_totalprice > 400000")
    return y.groupBy("year").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


@query("SELECT year(o_orderdate)::INT AS year, (o_orderkey // 65536)::BIGINT AS piece, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2")
def year_overview_all(spark, d):
    """Every order with a year; year_overview_nested, as its SQL, takes the dear ones. A year's
    list comes in pieces numbered by ranges of ids, so that no row holds more than a range."""
    y = years(spark, d).where("year is not null")
    return y.groupBy("year", F.floor(F.col("id") / 65536).alias("piece")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


@query("SELECT o_orderstatus AS status, year(o_orderdate)::INT AS year, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS processed FROM orders GROUP BY 1, 2")
def processing_status_overview(spark, d):
    return years(spark, d).groupBy(F.col("o_orderstatus").alias("status"), "year").agg(F.count("*").alias("n"), reports.count_if(F.col("o_totalprice") > 150000).alias("processed"))


@query("SELECT count(*) AS papers, count(*) FILTER (length(trim(text)) > 0) AS with_abstract, count(*) FILTER (lang IS NOT NULL) AS with_keywords, count(*) FILTER (contains(text, 'http')) AS with_doi FROM documents")
def completeness_report(spark, d):
    p = papers(spark, d).select("abstract", F.when(F.col("language").isNotNull(), F.array("language")).alias("keywords"), F.lit(None).cast("string").alias("pdf_path"), F.when(F.col("abstract").contains("http"), F.lit("10.1/x")).alias("doi"))
    return reports.completeness(p).select("papers", "with_abstract", "with_keywords", "with_doi")


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def stage_dashboard(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# §2.7 mutation


@query("SELECT s_suppkey AS id, s_name, CASE WHEN s_nationkey = 5 THEN 0.0 ELSE s_acctbal END AS acctbal FROM supplier")
def patch_apply(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", F.col("s_acctbal").alias("acctbal"))
    p = read(spark, d, "supplier").where("s_nationkey = 5").select(F.col("s_suppkey").alias("id"), F.lit(0.0).alias("replace_acctbal"))
    return table.patch(s, p, "id", replaced=["acctbal"])


@query("SELECT doc_id, coalesce(CASE WHEN lang <> 'en' THEN lang END, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END) AS lang FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL) USING (doc_id) WHERE quality IS NOT NULL OR lang <> 'en'")
def merge_coalesce(spark, d):
    left = read(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"))
    right = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("lang"))
    return table.coalesce_join(left, right, "doc_id", ["lang"]).where("lang is not null")


@query("SELECT o_orderkey AS id, o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderstatus = 'O'")
def upsert_skip(spark, d):
    y = years(spark, d)
    return table.upsert(y.where("o_orderstatus <> 'O'").select("id", F.col("o_orderpriority").alias("p")), y.select("id", F.lit("new").alias("p")), ["id"])


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice > 100000 THEN 'new' ELSE o_orderpriority END AS p FROM orders")
def upsert_update(spark, d):
    y = years(spark, d)
    return table.upsert(y.select("id", F.col("o_orderpriority").alias("p")), y.where("o_totalprice > 100000").select("id", F.lit("new").alias("p")), ["id"], "update")


@query("SELECT DISTINCT p_partkey AS id, trim(tag) AS tag FROM part, unnest(string_split(replace(p_type, ' ', ' : '), ':')) AS u(tag) WHERE trim(tag) <> ''")
def tag_upsert(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(table.split_tags(F.replace("p_type", F.lit(" "), F.lit(" : ")))).alias("tag"))
    return p.distinct()


# §2.8 scalar functions


@query("SELECT page_id, url, CASE WHEN regexp_matches(s, '^10\\.[^/]*/.+') THEN s END AS stem FROM (SELECT page_id, url, regexp_replace(lower(trim('DOI:10.' || page_id || '/' || url)), '^(https?://doi\\.org/|doi[:.])', '') AS s FROM pages)")
def doi_normalize(spark, d):
    raw = F.concat(F.lit("DOI:10."), F.col("page_id").cast("string"), F.lit("/"), F.col("url"))
    return read(spark, d, "pages").select("page_id", "url", ids.doi_stem(raw).alias("stem"))


@query("SELECT doc_id, trim(lower(left(split_part(text, chr(10), 1), 50)), ' ') AS title_key FROM documents")
def title_key(spark, d):
    return papers(spark, d).select(F.col("id").alias("doc_id"), t.title_key(F.col("title")).alias("title_key"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(list_transform(string_split(p_name || ', ' || p_type, ','), lambda k: lower(trim(k))), lambda k: k <> ''), '|') AS keywords FROM part")
def keywords_split(spark, d):
    x = F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(t.normalize_keywords(x), "|").alias("keywords"))


@query("SELECT o_orderkey AS id, year(o_orderdate)::INT AS year FROM orders")
def year_extract(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), t.normalize_year(F.date_format("o_orderdate", "'dated' yyyy-MM-dd")).alias("year"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS clean FROM pages")
def html_clean(spark, d):
    return read(spark, d, "pages").select("page_id", t.clean_html(F.col("html")).alias("clean"))


@query("SELECT c_custkey AS id, split_part(c_name, '#', 1) AS given_name, split_part(c_name, '#', 2) AS family_name FROM customer")
def author_parse(spark, d):
    name = ids.split_name(F.concat(F.substring_index("c_name", "#", -1), F.lit(", "), F.substring_index("c_name", "#", 1)))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), name["given_name"].alias("given_name"), name["family_name"].alias("family_name"))


@query("SELECT n_regionkey, CASE WHEN n = 1 THEN a WHEN n = 2 THEN a || ' & ' || b ELSE a || ' et al.' END AS authors FROM (SELECT n_regionkey, count(*) n, list(n_name ORDER BY n_nationkey)[1] a, list(n_name ORDER BY n_nationkey)[2] b FROM nation GROUP BY 1)")
def author_string(spark, d):
    n = read(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_name"].alias("family_name"))).alias("a"))
    return n.select("n_regionkey", ids.author_string(F.col("a")).alias("authors"))


@query("SELECT o_orderkey AS id, 'Customer ' || o_custkey || ' (' || year(o_orderdate) || '). ' || o_orderpriority || '. ' || 'Orders, 1.' AS apa FROM orders")
def apa_format(spark, d):
    who = F.array(F.struct(F.concat(F.lit("Customer "), F.col("author_id").cast("string")).alias("full_name")))
    none = F.lit(None).cast("string")
    return years(spark, d).select("id", ids.apa(who, F.col("year"), F.col("o_orderpriority"), F.lit("Orders"), F.lit("1"), none, none, none).alias("apa"))


@query("SELECT p_partkey AS id, string_agg(CASE WHEN length(w) <= 4 THEN upper(w[1]) || lower(w[2:]) || '.' ELSE upper(w[1]) || lower(w[2:3]) || '.' END, ' ' ORDER BY i) AS iso4 FROM (SELECT p_partkey, unnest(regexp_extract_all(p_name, '[a-zA-Z]+')) w, generate_subscripts(regexp_extract_all(p_name, '[a-zA-Z]+'), 1) i FROM part) WHERE lower(w) NOT IN ('and', 'or', 'the', 'a', 'an', 'of', 'in') GROUP BY 1")
def iso4_abbrev(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), ids.iso4(F.regexp_replace("p_name", r"[^a-zA-Z]+", " ")).alias("iso4")).where("iso4 is not null")


@query("SELECT doc_id AS id, round(0.2 + CASE WHEN length(trim(split_part(text, chr(10), 1))) > 0 THEN 0.2 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.25 ELSE 0 END + CASE WHEN length(trim(text)) > 0 THEN 0.25 ELSE 0 END, 2)::DOUBLE AS score FROM documents")
def quality_score(spark, d):
    words = F.when(F.col("language") == "en", F.array("language"))
    return papers(spark, d).select("id", ids.quality_score(F.col("title"), words, F.col("abstract")).alias("score"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events")
def json_field_extract(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""SELECT id, base_key || CASE WHEN r = 0 THEN '' ELSE repeat('a', ((r - 1) // 26)::INT) || chr((97 + (r - 1) % 26)::INT) END AS cite_key FROM (SELECT c_custkey AS id, 'k' || c_nationkey AS base_key, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r FROM customer)""")
def cite_key_collision_rank(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), F.concat(F.lit("k"), F.col("c_nationkey").cast("string")).alias("base_key"))
    return ids.resolve_cite_keys(c).select("id", "cite_key")


@query("SELECT doc_id AS id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return papers(spark, d).select("id", t.token_estimate(F.col("abstract")).alias("tokens"))


@query()
def smart_title_case(spark, d):
    return papers(spark, d).select("id", t.normalize_title(F.col("title")).alias("title"))


# §2.9 text structure


@query("SELECT doc_id AS id, len(list_filter(regexp_split_to_array(regexp_replace(trim(text), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))::INT AS n FROM documents")
def sentence_split(spark, d):
    return papers(spark, d).select("id", F.size(chunks.sentences(F.col("abstract"))).alias("n"))


@query("SELECT role, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY role")
def chunk_counts_by_level(spark, d):
    return read(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("SELECT doc_id AS id, count(*) AS n, sum(length(p))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE length(p) > 20 GROUP BY 1")
def paragraph_filter(spark, d):
    p = papers(spark, d).select("id", F.explode(F.filter(F.split("abstract", r"\n"), lambda x: F.length(x) > 20)).alias("p"))
    return p.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("chars"))


@query("SELECT doc_id AS id, i AS piece, substr(text, (1 + 900 * i)::BIGINT, 1000) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, length(text) - 1) // 900)) AS i FROM documents WHERE length(text) > 0)")
def fixed_chunks(spark, d):
    return papers(spark, d).select("id", F.posexplode(chunks.fixed_chunks(F.col("abstract"), 1000, 100)).alias("piece", "chunk")).withColumn("piece", F.col("piece").cast("long"))


@query()
def section_detect(spark, d):
    s = papers(spark, d).select("id", F.explode(chunks.detect_sections("abstract")).alias("s"))
    return s.select("id", F.col("s.title").alias("title"), F.length("s.content").alias("chars"))


@query()
def chunk_tree(spark, d):
    return chunks.chunk_tree(papers(spark, d), "id", "abstract").groupBy("id", "level").agg(F.count("*").alias("n"))


@query()
def sentence_chunks(spark, d):
    return papers(spark, d).select("id", F.posexplode(chunks.pack_sentences(F.col("abstract"))).alias("piece", "chunk")).select("id", "piece", F.length("chunk").alias("chars"))


# §2.10 screening


@query("SELECT doc_id AS id, CASE WHEN contains(lower(lang), 'de') THEN 'language: ' || lang WHEN contains(lower(source), 'src1') THEN 'paper_types: ' || source END AS reason FROM documents")
def metadata_screen(spark, d):
    return papers(spark, d).select("id", screening.metadata_reason({"language": ["de"], "paper_types": ["src1"]}, {"paper_types": "source_database"}).alias("reason"))


@query("SELECT doc_id AS id, CASE WHEN NOT contains(lower(lang), 'en') THEN 'language: ' || lang END AS reason FROM documents")
def metadata_not_operator(spark, d):
    return papers(spark, d).select("id", screening.metadata_reason({"language": "NOT: en"}).alias("reason"))


GROUPS = {"articles": ["the", "der*"], "endings": ["*tion", "*ment*"], "words": ["license"]}


def _kw(pattern: str) -> str:
    return f"regexp_matches(lower(text), '{pattern}')::INT"


_HITS = [_kw(t.wildcard_pattern(k).replace("'", "''")) for g in GROUPS.values() for k in g]


@query(f"SELECT doc_id AS id, round(0.7 * ((a + b > 0)::INT + (c + e > 0)::INT + f) / 3 + 0.3 * (a + b + c + e + f) / 5, 6)::DOUBLE AS score FROM (SELECT doc_id, {_HITS[0]} a, {_HITS[1]} b, {_HITS[2]} c, {_HITS[3]} e, {_HITS[4]} f FROM documents)")
def keyword_screen_score(spark, d):
    return papers(spark, d).select("id", screening.inclusion_score(F.col("abstract"), GROUPS).alias("score"))


def _sum(patterns):
    return " + ".join("regexp_matches(lower(text), '" + p.replace("'", "''") + "')::INT" for p in patterns)


@query(f"SELECT doc_id AS id, ({_sum(screening.QUALITATIVE)})::INT AS qualitative, ({_sum(screening.CASE)})::INT AS case_score, ({_sum(screening.METHOD)})::INT AS method FROM documents")
def study_type_scores(spark, d):
    s = screening.study_scores(F.lower("abstract"))
    return papers(spark, d).select("id", s["qualitative"].alias("qualitative"), s["case"].alias("case_score"), s["method"].alias("method"))


@query()
def study_type(spark, d):
    return papers(spark, d).select("id", screening.study_type(F.col("title"), F.col("abstract"), F.array("language")).alias("study_type"))


@query("SELECT doc_id AS id, CASE WHEN quality IS NULL THEN NULL WHEN quality >= 1 AND toxic IS NULL THEN NULL WHEN quality >= 1 AND toxic = 0 THEN 'included' WHEN toxic >= 1 THEN 'excluded' ELSE 'manual_review' END AS decision FROM documents LEFT JOIN labels USING (doc_id)")
def decision_rules(spark, d):
    df = papers(spark, d).join(read(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id", "left")
    return df.select("id", screening.rule_decision({"quality": ">= 1", "toxic": "== 0"}, {"toxic": ">= 1"}, "manual_review").alias("decision"))


@query("SELECT doc_id AS id, NOT (quality >= 0.5 AND 1 - toxic >= 0.7) AS fails_and, NOT (quality >= 0.5 OR 1 - toxic >= 0.7) AS fails_or FROM labels")
def relevance_filter_and_or(spark, d):
    r, c = F.col("quality").cast("double"), (1 - F.col("toxic")).cast("double")
    return read(spark, d, "labels").select(F.col("doc_id").alias("id"), screening.relevance_fails(r, c).alias("fails_and"), screening.relevance_fails(r, c, require_both=False).alias("fails_or"))


# vectors

_COS = "(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"


@query(f"SELECT b.vec_id, round({_COS}, 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY sim DESC, b.vec_id LIMIT 10")
def cosine_topk(spark, d):
    e = unit_vectors(spark, d)
    q = e.where("vec_id = 0").select(F.col("v").alias("q"))
    scored = e.where("vec_id <> 0").crossJoin(F.broadcast(q)).select("vec_id", F.round(v.cosine(F.col("v"), F.col("q")), 6).alias("sim"))  # one row
    return scored.orderBy(F.desc("sim"), "vec_id").limit(10)


@query(f"SELECT vec_id, best FROM (SELECT a.vec_id, round(max({_COS}), 6) AS best FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1) WHERE best < 0.4")
def nearest_neighbor_gap(spark, d):
    near = v.lonely_in_group(unit_vectors(spark, d), 0.4)
    return near.select("vec_id", F.round("best", 6).alias("best")).where("best < 0.4")


@query(f"SELECT vec_id, best FROM (SELECT a.vec_id, round(max({_COS}), 6) AS best FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1) WHERE best < 0.4")
def nearest_neighbor_gap_all(spark, d):
    """Against all other rows; nearest_neighbor_gap, as its SQL, within a label."""
    near = v.nearest_other(unit_vectors(spark, d).select("vec_id", "v"))
    return near.select("vec_id", F.round("best", 6).alias("best")).where("best < 0.4")


@query("SELECT conv_id, turn, n FROM (SELECT conv_id, turn, length(text)::INT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r = 1")
def best_chunk_per_paper(spark, d):
    c = read(spark, d, "conversations").withColumn("n", F.length("text"))
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "turn"))
    return c.withColumn("r", r).where("r = 1").select("conv_id", "turn", "n")


@query("SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def centroid_mean(spark, d):
    m = v.mean_vectors(unit_vectors(spark, d), "v", "label")
    return m.select("label", F.posexplode("mean_vector").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("mean"))


@query("""WITH q AS (SELECT generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id = 0),
m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE label IN (1, 2)) GROUP BY 1, 2),
r AS (SELECT list(q.x + 0.75 * a.x - 0.15 * b.x ORDER BY q.pos) AS v FROM q JOIN m a ON a.pos = q.pos AND a.label = 1 JOIN m b ON b.pos = q.pos AND b.label = 2)
SELECT vec_id, round((list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))) + 1) / 2, 6) AS score FROM embeddings, r""")
def rocchio_score(spark, d):
    e = unit_vectors(spark, d)
    m = v.mean_vectors(e.where("label in (1, 2)"), "v", "label").groupBy().agg(F.max(F.when(F.col("label") == 1, F.col("mean_vector"))).alias("a"), F.max(F.when(F.col("label") == 2, F.col("mean_vector"))).alias("r"))
    q = e.where("vec_id = 0").select(F.col("v").alias("q")).crossJoin(m).select(screening.rocchio_query(F.col("q"), F.col("a"), F.col("r")).alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(v.cosine_unit(F.col("v"), F.col("q")), 6).alias("score"))  # one row


@query("""WITH c AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, dominant, similarity FROM (SELECT vec_id, c.label AS dominant, round(list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))), 6) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))), 6) DESC, c.label) AS r FROM embeddings, c) WHERE r = 1""")
def dimension_argmax(spark, d):
    e = unit_vectors(spark, d)
    c = v.mean_vectors(e, "v", "label").select(F.col("label").alias("dominant"), "mean_vector")
    s = e.crossJoin(F.broadcast(c)).withColumn("similarity", F.round(v.cosine(F.col("v"), F.col("mean_vector")), 6))  # one row a dimension
    return s.groupBy("vec_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "dominant")).alias("b")).select("vec_id", F.col("b.dominant").alias("dominant"), (-F.col("b.s")).alias("similarity"))


# no SQL form


@query()
def fuzzy_dedup_greedy(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("doi"), F.array(F.struct(F.substring_index("p_type", " ", 1).alias("family_name"))).alias("authors"))
    return dedup.deduplicate(p, [{"method": "doi_exact"}, {"method": "title_author_fuzzy", "threshold": 0.90}])


@query()
def kmeans_clusters(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = unit_vectors(spark, d).withColumn("features", array_to_vector("v"))
    model = KMeans(k=3, seed=42).fit(e)
    centres = F.array(*(F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()))
    out = model.transform(e).withColumn("distance", v.euclidean(vector_to_array("features"), F.get(centres, F.col("prediction"))))
    return out.select("vec_id", F.col("prediction").alias("cluster"), F.round("distance", 6).alias("distance"), F.round(1 / (1 + F.col("distance")), 6).alias("confidence"))


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, d):
    from ..streaming import streams

    e = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return streams.run_to_end(e.select(F.col("user_id").cast("long").alias("user_id")).dropDuplicates(["user_id"]), "litsieve_first_seen", "append")


@query("SELECT event_id, user_id, event_type FROM events WHERE value > 50 AND event_type <> 'view'")
def stream_stateless_screen(spark, d):
    from ..streaming import streams

    e = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return streams.run_to_end(e.where("value > 50 and event_type <> 'view'").select("event_id", "user_id", "event_type"), "litsieve_screen", "append")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more_queries  # noqa: F401  (adds its queries)

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    from . import more_queries  # noqa: F401

    return dict(SQL)
