"""More queries of the catalogue: lookups and marks, rules for records of services, and
comparisons, over the same views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import markdown, records
from ..functions import text as t
from ..functions import vectors as v
from ..operators import analysis, graph, reports, screening, table
from .catalog import citation_edges, papers, query, read, unit_vectors, years

# lookups, order, marks


@query("SELECT p_partkey AS id, p_type FROM part WHERE contains(lower(p_type), 'econ')")
def by_topic_hits(spark, d):
    df = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type", F.split("p_type", " ").alias("keywords"))
    return table.Query(df).by_topic("Econ").result().select("id", "p_type")


@query("SELECT c_custkey AS id, c_name FROM customer WHERE contains(lower(c_name), '07') OR contains(lower(c_mktsegment), '07') OR contains((1990 + c_nationkey)::VARCHAR, '07')")
def sidebar_search(spark, d):
    df = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("journal"), (F.col("c_nationkey") + 1990).alias("year"))
    return table.Query(df).sidebar("07").result().select("id", "c_name")


@query("SELECT event_id, 'k' AS field, props::JSON ->> '$.k' AS value FROM events WHERE contains(props::JSON ->> '$.k', '7')")
def json_search(spark, d):
    return table.json_search(read(spark, d, "events"), "event_id", "props", "7")


@query("SELECT o_orderkey AS id, o_orderpriority, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END DESC NULLS LAST, o_orderkey LIMIT 50")
def ranked_nulls_last(spark, d):
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return analysis.ranked(years(spark, d), "o_orderpriority", ["2-HIGH", "1-URGENT"], F.desc_nulls_last(price), F.col("id")).limit(50).select("id", "o_orderpriority", "o_totalprice")


@query("SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey <> m THEN m::VARCHAR END AS duplicate_of FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey) AS m FROM customer)")
def duplicate_marks(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("ord"), "c_nationkey", F.lit("0").alias("duplicate_of"))
    first = table.first_per_key(c, "c_nationkey", "ord")
    return table.mark_duplicates(c, first.select("id", F.when(F.col("first_id") != F.col("id"), F.col("first_id")).alias("duplicate_of"))).select("id", "duplicate_of")


@query("SELECT c_nationkey AS key, count(*) AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS members FROM customer GROUP BY 1 HAVING count(*) > 1")
def duplicate_group_members(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key"))
    return reports.duplicate_groups(c, "key").select("key", "n", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


# graph


@query("SELECT DISTINCT '10.1/' || l_orderkey AS citing, '10.2/' || l_partkey AS cited FROM lineitem")
def edges_from_lists(spark, d):
    """Half of the edges from citation lists, half from cited-by lists, some in both."""
    e = citation_edges(spark, d).select(F.concat(F.lit("10.1/"), F.col("citing").cast("string")).alias("x"), F.concat(F.lit("10.2/"), F.col("cited").cast("string")).alias("y"), "cited")
    out = e.where("cited % 3 <> 0").groupBy(F.col("x").alias("doi")).agg(F.collect_list(F.struct(F.col("y").alias("doi"))).alias("citations"))
    back = e.where("cited % 3 <> 1").groupBy(F.col("y").alias("doi")).agg(F.collect_list(F.struct(F.col("x").alias("doi"))).alias("cited_by"))
    both = out.withColumn("cited_by", F.lit(None).cast(back.schema["cited_by"].dataType)).unionByName(back.withColumn("citations", F.lit(None).cast(out.schema["citations"].dataType)))
    return graph.edges(both)


@query("SELECT DISTINCT l_partkey AS citing, l_suppkey AS cited FROM lineitem WHERE l_partkey IN (SELECT s_suppkey FROM supplier)")
def network_inner_links(spark, d):
    """Links whose ends are both nodes."""
    nodes = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    e = read(spark, d, "lineitem").select(F.col("l_partkey").alias("citing"), F.col("l_suppkey").alias("cited")).distinct()
    return graph.network(nodes, e)[1].select("citing", "cited")


@query("SELECT p_partkey AS id, p_name, n_in FROM part JOIN (SELECT l_partkey, count(*) AS n_in FROM lineitem GROUP BY 1) ON l_partkey = p_partkey ORDER BY n_in DESC, id LIMIT 20")
def most_cited_by_degree(spark, d):
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return graph.degrees(nodes, citation_edges(spark, d)).where("n_in > 0").orderBy(F.desc("n_in"), "id").limit(20).select("id", "p_name", "n_in")


# rules for names, keys and records


@query("""SELECT page_id, CASE page_id % 5 WHEN 4 THEN NULL ELSE '10.' || page_id || '/a' END AS stem FROM pages""")
def doi_forms(spark, d):
    stem = F.concat(F.lit("10."), F.col("page_id").cast("string"), F.lit("/A"))
    forms = F.array(stem, F.concat(F.lit(" https://doi.org/"), stem), F.concat(F.lit("http://DOI.org/"), stem), F.concat(F.lit("doi.10."), F.col("page_id").cast("string"), F.lit("/A ")), F.concat(F.lit("x"), stem))
    return read(spark, d, "pages").select("page_id", ids.doi_stem(F.get(forms, (F.col("page_id") % 5).cast("int"))).alias("stem"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Ann Mary' ELSE 'N.' || c_nationkey END AS given_name, 'K' || c_custkey AS family_name FROM customer")
def author_forms(spark, d):
    """First Last and Last, First."""
    family = F.concat(F.lit("K"), F.col("c_custkey").cast("string"))
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" Ann  Mary "), family)).otherwise(F.concat(family, F.lit(" ,  N."), F.col("c_nationkey").cast("string")))
    split = ids.split_name(name)
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), split["given_name"].alias("given_name"), split["family_name"].alias("family_name"))


@query("SELECT n_regionkey, CASE WHEN count(*) <= 3 THEN string_agg(n_name, ' & ' ORDER BY n_nationkey) ELSE list(n_name ORDER BY n_nationkey)[1] || ' et al.' END || ' (2020). T.' AS apa FROM nation WHERE n_nationkey % 5 < n_regionkey + 1 GROUP BY 1")
def apa_several_authors(spark, d):
    n = read(spark, d, "nation").where("n_nationkey % 5 < n_regionkey + 1").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_name"].alias("full_name"))).alias("a"))
    none = F.lit(None).cast("string")
    return n.select("n_regionkey", ids.apa(F.col("a"), F.lit(2020), F.lit("T"), none, none, none, none, none).alias("apa"))


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Int. J. ' WHEN 1 THEN 'IEEE Trans. ' ELSE 'Rev. ' END || upper(p_type[1]) || lower(p_type[2:3]) || '.' AS iso4 FROM part""")
def iso4_with_dictionary(spark, d):
    start = F.when(F.col("p_size") % 3 == 0, "The International Journal of ").when(F.col("p_size") % 3 == 1, "IEEE Transactions on ").otherwise("A Review-of ")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), ids.iso4(F.concat(start, "p_type")).alias("iso4"))


@query("""SELECT id, base_key || CASE WHEN r = 0 THEN '' ELSE repeat('a', (20 + r) // 26) || chr((97 + (20 + r) % 26)::INT) END AS cite_key
FROM (SELECT c_custkey AS id, 'k' || c_nationkey AS base_key, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r FROM customer)""")
def cite_keys_with_taken_suffixes(spark, d):
    """The suffixes a to u of every base are taken."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), F.concat(F.lit("k"), F.col("c_nationkey").cast("string")).alias("base_key"))
    taken = c.select("base_key").distinct().select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.concat("base_key", ids.suffix(k)))).alias("cite_key"))
    return ids.resolve_cite_keys(c, taken=taken).select("id", "cite_key")


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'low' || (2000 + c_nationkey) WHEN 1 THEN 'doi' || 'x' || c_custkey WHEN 2 THEN 'file' || c_custkey ELSE 'auto' || (2000 + c_nationkey) || substr(md5(c_custkey::VARCHAR), 1, 4) END AS cite_key FROM customer""")
def legacy_cite_keys(spark, d):
    n, key = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    found = records.legacy_cite_key(F.when(n == 0, "Low"), F.col("c_nationkey") + 2000, F.when(n == 1, F.concat(F.lit("10.1/a/(x)."), key)), F.when(n == 2, F.concat(F.lit("/a/file"), key, F.lit(".pdf"))), key)
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), found.alias("cite_key"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE year(o_orderdate) END::INT AS year, CASE o_orderstatus WHEN 'F' THEN 'journal_article' WHEN 'O' THEN 'conference_paper' END AS kind FROM orders""")
def service_dates_and_types(spark, d):
    """Dates in one of three places of a record, or nowhere."""
    k, year = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy")
    place = F.when(k == 0, "published-print").when(k == 1, "published-online").when(k == 2, "created").otherwise("deposited")
    record = F.concat(F.lit('{"issued": {"date-parts": [[null]]}, "'), place, F.lit('": {"date-parts": [['), year, F.lit(", 3]]}}"))
    kind = F.when(F.col("o_orderstatus") == "F", "Journal-Article").when(F.col("o_orderstatus") == "O", "proceedings-article").otherwise("poster")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), records.year_from_parts(record).alias("year"), records.crossref_type(kind).alias("kind"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 15 THEN p_type ELSE '' END AS keywords, CASE WHEN p_partkey % 2 = 0 THEN p_brand WHEN p_size > 25 THEN p_type ELSE '' END AS topics,
CASE WHEN p_partkey % 3 = 0 THEN 'conference_paper' WHEN p_partkey % 3 = 1 THEN 'thesis' END AS kind FROM part""")
def service_topics(spark, d):
    concepts = F.array(F.struct(F.concat(F.lit(" "), F.col("p_type")).alias("display_name"), (F.col("p_size") / 50).alias("score"), F.lit(1).alias("level")), F.struct(F.lit("broad").alias("display_name"), F.lit(0.3).alias("score"), F.lit(0).alias("level")))
    named = F.when(F.col("p_partkey") % 2 == 0, F.array(F.struct(F.col("p_brand").alias("display_name"))))
    n = F.col("p_partkey") % 3
    kind = records.openalex_type(F.when(n == 1, "Dissertation").otherwise("other"), F.when(n == 0, "proceedings-article"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(records.concept_keywords(concepts), ",").alias("keywords"), F.array_join(records.topics(named, concepts), ",").alias("topics"), kind.alias("kind"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'scopus' WHEN 1 THEN 'scopus' WHEN 2 THEN 'wos' WHEN 3 THEN 'ieee' WHEN 4 THEN 'ieee' ELSE 'wos' END AS source FROM part""")
def record_sources(spark, d):
    n = F.col("p_partkey") % 6
    field = F.when(n == 0, "source").when(n == 1, "Art_Number").when(n == 2, "unique-id").when(n == 4, "Booktitle").otherwise("title")
    fields = F.create_map(field, F.lit("Scopus export"), F.lit("issn"), F.lit("1"))
    key = F.when(n == 3, F.col("p_partkey").cast("string")).otherwise("K1")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), records.record_source(fields, key, ["art_number"], ["unique-id"]).alias("source"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Deep Maps of the Town' END AS title, CASE WHEN p_size > 30 THEN 1990 + p_size END::INT AS year, CASE WHEN p_size % 3 = 0 THEN 'thesis' END AS paper_type, p_brand FROM part""")
def normalized_records(spark, d):
    raw = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "{Deep}  maps <i>of</i> the town").alias("title"), F.when(F.col("p_size") > 30, F.concat(F.lit("in "), (F.col("p_size") + 1990).cast("string"))).otherwise("x1999").alias("year"), F.when(F.col("p_size") % 3 == 0, " Thesis").otherwise("poem").alias("paper_type"), "p_brand")
    return records.normalized(raw)


@query("""SELECT p_partkey AS id, 'T ' || p_name AS title, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_brand END AS journal, CASE WHEN p_size % 2 = 0 THEN 1990 + p_size END::INT AS year, CASE p_size % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' END AS oa_status,
CASE WHEN p_size % 5 = 0 THEN 's2:c' || p_partkey ELSE 's2:p' || p_partkey END AS source_key, 'A. One;B. Two' AS authors, p_type || ';plain' AS topics, '10.1/' || p_partkey AS doi FROM part""")
def semantic_records(spark, d):
    """Records of a service: a venue in one of three places, names as objects or texts."""
    k, size = F.col("p_partkey"), F.col("p_size")
    venue = F.when(k % 3 == 0, F.concat(F.lit('"venue": "'), "p_type", F.lit('"'))).when(k % 3 == 1, F.concat(F.lit('"venue": "", "journal": {"name": "'), "p_brand", F.lit('"}'))).otherwise(F.concat(F.lit('"publicationVenue": {"id": 1}, "journal": {"name": "'), "p_brand", F.lit('"}')))
    record = F.concat(
        F.lit('{"title": "T <i></i> '), "p_name", F.lit('", '), venue, F.when(size % 2 == 0, F.concat(F.lit(', "year": '), (size + 1990).cast("string"))).otherwise(', "year": null'), F.when(size % 3 == 0, ', "isOpenAccess": true').when(size % 3 == 1, ', "isOpenAccess": false').otherwise(""),
        F.when(size % 5 == 0, ', "corpusId": "c').otherwise(', "paperId": "p'), k.cast("string"), F.lit('", "authors": [{"name": "A. One"}, "B. Two", {"id": 3}], "s2FieldsOfStudy": [{"category": "'), "p_type", F.lit('"}, "plain"], "externalIds": {"DOI": "10.1/'), k.cast("string"), F.lit('"}}'),
    )
    r = records.semantic_scholar(record)
    rows = read(spark, d, "part").select(k.alias("id"), r.alias("r"))
    return rows.select("id", "r.title", "r.journal", "r.year", "r.oa_status", "r.source_key", F.array_join("r.authors", ";").alias("authors"), F.array_join("r.topics", ";").alias("topics"), "r.doi")


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 2 THEN p_brand ELSE 'J' END AS journal, (1990 + p_size)::INT AS year, CASE WHEN p_partkey % 3 = 0 THEN 'p2' ELSE 'p1' END AS pages, 'Doe:' || p_size || ':' || 'AM' AS author,
CASE p_partkey % 3 WHEN 1 THEN p_type || '|b c' ELSE 'x y|' || p_type END AS keywords, CASE p_partkey % 3 WHEN 0 THEN p_type || '|b c' WHEN 1 THEN 'x y|' || p_type END AS keywords_extra, CASE p_partkey % 3 WHEN 0 THEN 'Web of Science' WHEN 1 THEN 'mine' ELSE 'IEEE Xplore' END AS source FROM part""")
def exported_records(spark, d):
    """Exports of three sources in one form."""
    first = F.concat(F.lit("{x y}; "), "p_type", F.lit(" ,"))
    second = F.concat(F.lit('"'), F.col("p_type"), F.lit('"; b \\&  c'))
    values = {"journal": F.lit("J"), "booktitle": F.col("p_brand"), "year": F.concat(F.lit(" "), (F.col("p_size") + 1990).cast("string")), "pages": F.lit("p1"), "pages-range": F.lit("p2"), "author": F.concat(F.lit("Doe, Ann Mary and Roe"), F.col("p_size").cast("string")), "keywords": first, "keywords-plus": second, "author_keywords": second, "source": F.lit("mine")}
    fields = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))
    key = F.col("p_partkey").cast("string")
    found = {k: records.translated(fields, key, F.lit("article"), k) for k in records.TRANSLATIONS}
    n = F.col("p_partkey") % 3
    r = F.when(n == 0, found["wos"]).when(n == 1, found["scopus"]).otherwise(found["ieee"])
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), r.alias("r"))
    author = F.concat_ws(":", F.get("r.authors", F.lit(0))["last_name"], F.regexp_extract(F.get("r.authors", F.lit(1))["last_name"], r"(\d+)", 1), F.get("r.authors", F.lit(0))["initials"])
    return rows.select("id", "r.journal", "r.year", "r.pages", author.alias("author"), F.array_join("r.keywords", "|").alias("keywords"), F.array_join("r.keywords_extra", "|").alias("keywords_extra"), F.element_at("r.source_details", "source").alias("source"))


@query("""SELECT c_nationkey AS id, string_agg(CASE WHEN c_custkey % 4 <> 0 THEN '10.1/' || c_custkey END, ',' ORDER BY c_custkey) AS dois, count(*) AS listed FROM customer GROUP BY 1""")
def stated_citations(spark, d):
    """Lists of DOIs, some of which aren't any."""
    doi = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("https://doi.org/10.1/"), F.col("c_custkey").cast("string")))
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", doi.alias("doi")))), lambda x: x["doi"]).alias("dois"))
    field = F.concat(F.lit(" {"), F.array_join("dois", ", "), F.lit(",}"))
    cited = F.transform(records.cited_dois(field, "backward"), lambda x: x["doi"])
    return c.select("id", F.array_join(cited, ",").alias("dois"), F.size(records.doi_list(field)).cast("long").alias("listed"))


@query("""SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'A and B' END AS authors, p_type AS methodology_class, 'last ' || p_size AS conclusions, 'c' || p_size || '>o' AS camo, 's1|' || p_brand AS it_supplier, 'first|' || p_type AS questions, 'one|' || p_name AS steps FROM part""")
def analysis_markdown(spark, d):
    """What is read from analyses in markdown."""
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.lit("above\n## 1. TITLE_AND_AUTHORS \n1.1. **TITLE:** other\n### 1.1. title: "), "p_name", F.when(F.col("p_size") % 2 == 0, "\n1.2. **AUTHORS**: A and B").otherwise("\n1.2. **AUTHORS A and B"), F.lit("\n## RESULTS\nfirst\n### RESULTS\n## METHODS\n2.1. **METHODOLOGY_CLASS:** "), "p_type",
        F.lit("\nmore\n\n2.2. **OTHER:** x\n## CONCLUSIONS\n\nlast "), size, F.lit("\n\n## INNOVATION_MECHANISMS\n[c"), size, F.lit("], [a], [m], [o] - all\n\n[c], [a] - none\n## VENDORS\n3.1. **IT_SUPPLIER:** s1\n"), "p_brand", F.lit("\n\n3.2. **NO_SUPPLIER:** s2\n## HYPOTHESIS\n- first\n- "), "p_type", F.lit("\n## STEPS\n1. one\n\n"), "p_name",
    )
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), markdown.analysis(text).alias("a"))
    camo = F.transform("a.camo", lambda c: F.concat(c["c"], F.lit(">"), c["o"]))
    part = lambda name: F.element_at("a.sections", name)
    return rows.select(
        "id", "a.title", "a.authors", "a.methodology_class", part("CONCLUSIONS").alias("conclusions"), F.array_join(camo, ";").alias("camo"), F.array_join("a.it_supplier", "|").alias("it_supplier"),
        F.array_join(markdown.questions(part("RESEARCH_QUESTION")), "|").alias("questions"), F.array_join(markdown.steps(part("STEPS")), "|").alias("steps"),
    )


# screening


@query("SELECT doc_id AS id, CASE WHEN contains(lower(coalesce(lang, 'en')), 'de') THEN 'language: ' || lang WHEN NOT contains(lower(coalesce(lang, 'en')), 'en') THEN 'language: ' || lang WHEN contains(lower(source), '1') THEN 'quality_tier: ' || source END AS reason FROM (SELECT doc_id, source, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang FROM documents)")
def metadata_screen_defaults(spark, d):
    p = papers(spark, d).withColumn("language", F.when(F.col("id") % 7 != 0, F.col("language")))
    return p.select("id", screening.metadata_reason({"language": ["NOT: en", "de"], "quality_tier": ["1"]}, {"quality_tier": "source_database"}).alias("reason"))


@query("""SELECT id, s >= 0.5 AS passed, CASE WHEN s >= 0.6 THEN 'high_similarity' WHEN s >= 0.5 THEN CASE WHEN b > 0 THEN 'moderate_similarity_with_boost' ELSE 'moderate_similarity' END ELSE 'insufficient_similarity' END AS method, s AS boosted, s >= 0.5 AND s < 0.6 AS for_review
FROM (SELECT id, b, round(p_size / 64.0::DOUBLE + b, 4) AS s FROM (SELECT p_partkey AS id, p_size, round(least(0.1::DOUBLE, 0.02::DOUBLE * (contains(lower(p_type), 'eco')::INT + contains(lower(p_type), 'promo')::INT + contains(lower(p_type), 'o')::INT)), 4) AS b FROM part))""")
def keyword_boost(spark, d):
    b = records.keyword_boost(F.array(F.upper("p_type")), F.col("p_size") / 64, ["eco", "promo", "o"])
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), b.alias("b")).select("id", "b.passed", "b.method", "b.boosted", "b.for_review")


@query("""SELECT doc_id AS id, CASE WHEN regexp_matches(lower(text), '(^|[^a-zA-Z0-9_])rights([^a-zA-Z0-9_]|$)') THEN 'exclude' WHEN regexp_matches(lower(text), '(^|[^a-zA-Z0-9_])the([^a-zA-Z0-9_]|$)')::INT + regexp_matches(lower(text), '(^|[^a-zA-Z0-9_])of([^a-zA-Z0-9_]|$)')::INT >= 2 THEN 'include' ELSE 'ambiguous' END AS decision FROM documents WHERE text IS NOT NULL""")
def first_screen(spark, d):
    s = records.first_screen(F.col("abstract"), ["the", "of"], ["rights"])
    return papers(spark, d).where("abstract is not null").select("id", s["decision"].alias("decision"))


# comparisons, lists, audits


def _said(spark, d):
    """What two methods say of documents."""
    return read(spark, d, "labels").select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("method"), F.col("quality").alias("value")), F.struct(F.lit("toxic").alias("method"), F.col("toxic").alias("value")))).alias("x")).select("doc_id", "x.method", "x.value")


@query("SELECT doc_id, any_value(quality) AS quality, any_value(toxic) AS toxic FROM labels GROUP BY 1")
def method_pivot(spark, d):
    return analysis.by_method(_said(spark, d), "doc_id", "method", "value", ["quality", "toxic"])


@query("SELECT 'quality' AS \"first\", 'toxic' AS \"second\", count(*) AS n, round(100 * avg((quality IS NOT DISTINCT FROM toxic)::INT), 4) AS percent FROM labels")
def method_agreement(spark, d):
    return analysis.agreement(_said(spark, d), "doc_id", "method", "value")


@query("SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM events GROUP BY 1")
def method_latencies(spark, d):
    return analysis.latencies(read(spark, d, "events"), "event_type", "value")


@query("SELECT source, count(*) AS n, round(avg(((length(text) > 400)::INT = quality)::INT), 6) AS accuracy FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY 1")
def method_accuracy(spark, d):
    guess = read(spark, d, "documents").where("text is not null").select("doc_id", "source", (F.length("text") > 400).cast("int").alias("guess"))
    return analysis.accuracy(guess, read(spark, d, "labels"), "doc_id", "source", "guess", "quality")


@query("SELECT doc_id, source, (length(text) > 400)::INT AS guess, quality AS truth FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND (length(text) > 400)::INT IS DISTINCT FROM quality")
def method_mismatches(spark, d):
    guess = read(spark, d, "documents").where("text is not null").select("doc_id", "source", (F.length("text") > 400).cast("int").alias("guess"))
    return analysis.mismatches(guess, read(spark, d, "labels"), "doc_id", "guess", "quality").select("doc_id", "source", "guess", "truth")


@query("SELECT source, count(*) AS papers FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY papers DESC, source LIMIT 3")
def top_values(spark, d):
    return analysis.top_values(read(spark, d, "documents"), "source", 3)


@query("SELECT p_partkey AS key, p_name, c_mktsegment FROM part JOIN customer ON c_custkey = p_partkey WHERE p_size > 10 AND c_mktsegment IN ('FURNITURE', 'BUILDING')")
def eligible_for_references(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_name", F.when(F.col("p_size") > 10, "10.1/x").alias("doi"))
    screened = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    return analysis.eligible_for_references(p, screened, "key", "c_mktsegment", ["FURNITURE", "BUILDING"]).select("key", "p_name", "c_mktsegment")


@query("SELECT o_orderkey AS id, count(*) FILTER (l_returnflag <> 'N') AS with_doi, count(*) FILTER (l_returnflag = 'N') AS without FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def references_by_doi(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.when(F.col("l_returnflag") != "N", "10.1/x").otherwise(" ").alias("doi")).alias("r"))
    known, unknown = analysis.split_references(li.groupBy("id").agg(F.collect_list("r").alias("references")))
    a, b = (x.groupBy("id").agg(F.count("*").alias(n)) for x, n in ((known, "with_doi"), (unknown, "without")))
    return a.join(b, "id", "full").na.fill(0)


@query("SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderstatus <> 'F' ORDER BY CASE WHEN o_orderstatus = 'O' THEN o_totalprice END DESC NULLS LAST, o_orderkey LIMIT 100")
def papers_to_fetch(spark, d):
    y = years(spark, d).withColumn("file_path", F.when(F.col("o_orderstatus") == "F", "x.pdf"))
    lacking, _ = analysis.to_fetch(y, "file_path", F.desc_nulls_last(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), F.col("id"))
    return lacking.limit(100).select("id", "o_totalprice")


@query("SELECT count(*) AS processed, count(*) FILTER (p_type = 'ECONOMY') AS passed, count(*) FILTER (p_type = 'PROMO') AS review, count(*) FILTER (p_type NOT IN ('ECONOMY', 'PROMO', 'LARGE')) AS failed, round(avg(p_size), 4) AS mean, min(p_size) AS least, max(p_size) AS most FROM part WHERE p_type <> 'LARGE'")
def stage_summary(spark, d):
    kind = F.when(F.col("p_type") == "ECONOMY", "stage2_pass").when(F.col("p_type") == "PROMO", "stage2_review").when(F.col("p_type") == "LARGE", "stage1_pass").otherwise("stage2_fail")
    return analysis.stage_summary(read(spark, d, "part").withColumn("stage", kind), "stage", "p_size", "stage2_")


@query("SELECT CASE WHEN event_id % 5 <> 0 THEN 2000 + event_id % 3 END::INT AS year, count(*) AS entries, count(*) FILTER (event_id % 5 = 0) AS broken, count(*) FILTER (event_id % 5 <> 0 AND user_id % 2 = 0) AS with_references FROM events GROUP BY 1")
def cache_audit(spark, d):
    good = F.concat(F.lit('{"year": '), (F.col("event_id") % 3 + 2000).cast("string"), F.lit(', "references": ['), F.when(F.col("user_id") % 2 == 0, '{"doi": "10.1/x"}').otherwise(""), F.lit("]}"))
    e = read(spark, d, "events").select(F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(good).alias("payload"))
    return analysis.cache_audit(e)


@query("SELECT conv_id * 1000 + turn AS chunk_id, source, round(embedding[1]::DOUBLE, 6) AS score FROM conversations JOIN embeddings ON vec_id = conv_id * 1000 + turn JOIN documents ON doc_id = conv_id ORDER BY embedding[1]::DOUBLE DESC, chunk_id LIMIT 20")
def chunk_hits(spark, d):
    c = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("paper_id"))
    p = read(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), "source")
    hits = analysis.chunk_hits(c, unit_vectors(spark, d).withColumnRenamed("vec_id", "chunk_id"), p, F.get("v", F.lit(0)), 20)
    return hits.select("chunk_id", "source", F.round("score", 6).alias("score"))


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT b.vec_id, round({_DOT} / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND score >= 0.2 ORDER BY score DESC, b.vec_id LIMIT 15")
def similar_from_threshold(spark, d):
    e = unit_vectors(spark, d)
    both = e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("v").alias("q"))))  # one row
    return analysis.similar(both, F.round(v.cosine(F.col("v"), F.col("q")), 6), 0.2, 15, "vec_id").select("vec_id", "score")


@query("SELECT event_id, props AS found, length(props) AS size FROM events")
def json_from_answers(spark, d):
    """The JSON object that an answer's prose holds."""
    answer = F.concat(F.lit("Sure, here it is:\n"), F.col("props"), F.lit("\nAnything else?"))
    return read(spark, d, "events").select("event_id", t.extract_json(answer).alias("found"), F.length(t.extract_json(answer)).alias("size"))
