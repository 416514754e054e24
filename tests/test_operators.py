import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from litsieve.operators import chunks, dedup, graph, reports, screening, table
from litsieve.schema import PAPER, conform


def paper_table(spark, rows):
    return conform(spark.createDataFrame(rows, "ord long, id string, title string, abstract string, keywords array<string>, year int, doi string, family string, language string, paper_type string").withColumn("cite_key", F.col("id")).withColumn("authors", F.array(F.struct(F.lit(None).cast("string").alias("given_name"), F.col("family").alias("family_name"), F.col("family").alias("full_name"), F.lit(None).cast("string").alias("affiliation"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("email")))))


ROWS = [
    (0, "a", "Deep learning for maps", "A survey with 120 participants and statistical analysis of results.", ["Maps", "AI"], 2019, "10.1/a", "Smith", "en", "journal_article"),
    (1, "b", "Systems of roads", "We interviewed experts; thematic analysis was used in this qualitative study.", ["roads"], 2021, None, "Jones", "de", "book"),
    (2, "c", "deep Learning for Maps", None, None, None, "10.1/c", "smith", "en", "book_chapter"),
    (3, "d", "A systematic review of maps", "The literature is old and there is much of it to be read.", ["review"], 2020, "10.1/d", "Doe", None, None),
]


def test_query_builder(spark):
    q = table.Query(paper_table(spark, ROWS))
    ids = lambda x: [r.id for r in x.result().collect()]
    assert ids(q.by_topic("map")) == ["a"] and ids(q.by_author("JON")) == ["b"] and ids(q.by_year(2019, 2020)) == ["a", "d"]
    assert ids(q.by_doi("https://doi.org/10.1/C")) == ["c"] and ids(q.grep("deep").order_by_year()) == ["a", "c"]
    assert ids(q.order_by_year()) == ["b", "d", "a", "c"] and ids(q.order_by_year(False)) == ["c", "a", "d", "b"]
    assert ids(q.order_by_title().top(2)) == ["d", "a"] and len(ids(q.top(0))) == 4
    assert [r.id for r in q[1:3].collect()] == ["b", "c"] and [r.id for r in q.page(2, 3).collect()] == ["d"]
    assert ids(q.filter(lambda r: r["year"] == 2021)) == ["b"] and ids(q.near_year(2020)) == ["a", "b", "d"]
    with pytest.raises(Exception, match="not a DOI"):
        ids(q.by_doi("nonsense"))


def test_set_operations_and_mutation(spark):
    df = paper_table(spark, ROWS)
    left, right = df.where("ord < 2"), df.where("ord > 0")
    assert sorted(r.id for r in table.union_by_id(left, right).collect()) == ["a", "b", "c", "d"]
    assert [r.id for r in table.difference_by_id(left, right).collect()] == ["a"]
    assert table.equal_tables(df, df.orderBy(F.desc("ord")))
    with pytest.raises(Exception, match="duplicate key"):
        table.add(left, right).collect()
    with pytest.raises(ValueError, match="conflict"):
        table.upsert(left, right, ["id"], "raise")
    patches = spark.createDataFrame([("a", "New", ["x"])], "id string, replace_title string, append_keywords array<string>")
    got = table.patch(df, patches, "id", ["title"], ["keywords"]).where("id = 'a'").first()
    assert got.title == "New" and got.keywords == ["Maps", "AI", "x"]


def greedy_reference(items, similar):
    primary, out = [], {}
    for k, x in enumerate(items):
        hit = next((p for p in primary if similar(x, items[p])), None)
        if hit is None:
            primary.append(k)
        else:
            out[k] = hit
    return out


def test_fuzzy_dedup_is_greedy(spark):
    rnd = random.Random(4)
    titles = []
    for base in ("the quick growth of green cities", "on the theory of large firms and markets", "maps"):
        x = base
        for _ in range(12):
            k = rnd.randrange(len(x))
            x = x[:k] + rnd.choice("abcdef ") + x[k + 1 :]
            titles.append(" ".join(x.split()))
    rnd.shuffle(titles)
    rows = spark.createDataFrame([(k, x, None, [("f",)]) for k, x in enumerate(titles)], "ord long, title string, doi string, authors array<struct<family_name: string>>")
    for method, threshold in (("title_fuzzy", 0.95), ("title_author_fuzzy", 0.85)):
        want = greedy_reference(titles, lambda a, b, t=threshold: SequenceMatcher(None, a, b).ratio() >= t)
        got = {r.ord: r.target for r in dedup.deduplicate(rows, [{"method": method, "threshold": threshold}]).collect()}
        assert got == want and want


def test_long_chains_are_resolved(spark):
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 300)], "ord long, earlier long")
    assert {r.ord: r.target for r in dedup.greedy(chain).collect()} == {k: k - 1 for k in range(1, 300, 2)}
    rnd = random.Random(2)
    edges = [(k, e) for k in range(60) for e in range(max(0, k - 12), k) if rnd.random() < 0.25]
    want = greedy_reference(range(60), lambda a, b: (a, b) in set(edges))
    for at_once in (0, 5, 100_000):  # in rounds, by both ways, on the driver alone
        got = dedup.greedy(spark.createDataFrame(edges, "ord long, earlier long"), at_once=at_once).select("ord").collect()
        assert sorted(r.ord for r in got) == sorted(want)


def test_dedup_rounds_go_on(spark):
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 110)], "ord long, earlier long").coalesce(1)
    got = dedup.greedy(chain, at_once=0).collect()
    assert sorted(r.ord for r in got) == list(range(1, 110, 2))


def test_dedup_methods_in_order(spark):
    df = paper_table(spark, [*ROWS, (4, "e", "other", None, None, None, "10.1/A", "Smith", "en", None)])
    got = {r.ord: (r.target, r.method) for r in dedup.deduplicate(df, [{"method": "doi_exact"}, {"method": "title_author_fuzzy"}]).collect()}
    assert got == {4: (0, "doi_exact"), 2: (0, "title_author_fuzzy")}


def test_graph(spark):
    papers = spark.createDataFrame([("a", 0, "10.1/a", "A", 2000), ("b", 1, "10.1/b", "B", 2001), ("c", 2, None, "C", 2002)], "id string, ord long, doi string, title string, year int")
    cites = spark.createDataFrame([("10.1/b", None, None), ("10.9/x", "C", 2002), (None, "C", 2001), (None, None, None)], "doi string, title string, year int")
    assert [r.resolved_id for r in graph.resolve(cites, papers).orderBy(F.col("doi").asc_nulls_last(), F.col("year").asc_nulls_last()).collect()] == ["b", "c", None, None]
    edge = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "citing int, cited int")
    seeds = spark.createDataFrame([(1,)], "id int")
    assert {(r.id, r.iteration) for r in graph.snowball(seeds, edge, 3).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {(r.id, r.iteration) for r in graph.snowball(seeds, edge, 1, forward=True).collect()} == {(1, 0), (3, 1)}
    near = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 4), (3, 1, 1)], "id int, rank int, near int")
    assert graph.reading_list(near, 1, 4) == [1, 2, 3, 4]


def test_study_types(spark):
    cases = {
        "A systematic literature review of x": "literature_review",
        "Case study of two firms": "case_study",
        "An editorial on things": "editorial",
        "A conceptual paper": "conceptual",
        "Interviews and a focus group": "empirical_qualitative",
        "Regression on a sample": "empirical_quantitative",
        "Nothing to see": "unknown",
        "One survey": "unknown",
    }
    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, x string")
    got = [r[0] for r in df.orderBy("k").select(screening.study_type(F.lower(F.col("x")), F.lit(""), F.lit(None).cast("array<string>"))).collect()]
    want = list(cases.values())
    assert got == want


def test_keyword_and_metadata_screening(spark):
    df = paper_table(spark, ROWS)
    out = screening.metadata_screening(df, {"language": "NOT: en", "paper_types": ["book"], "doi_not_set": True})
    got = {r.id: (r.screening.metadata_screening.reason, r.screening.final_decision) for r in out.collect()}
    assert got == {"a": (None, None), "b": ("language: de", "excluded"), "c": ("paper_types: book_chapter", "excluded"), "d": (None, None)}
    again = screening.metadata_screening(out, {"doi_not_set": True})
    assert again.exceptAll(out).isEmpty()
    out = screening.keyword_screening(out, include={"keywords": {"m": ["map*"], "a": ["ai", "survey"]}, "thresholds": {"auto_accept": 0.8, "manual_review": 0.3}}, exclude={"study_types": ["literature_review"]})
    got = {r.id: r.screening for r in out.collect()}
    assert got["a"].final_decision == "included" and round(got["a"].keyword_screening.score, 3) == 1.0
    assert got["d"].final_decision == "excluded" and got["d"].keyword_screening.study_type == "literature_review"
    assert got["b"].keyword_screening is None and got["c"].final_decision_by == "metadata_screening"


def test_decision_rules(spark):
    rows = [(0.9, True), (0.9, None), (None, True), (0.1, None), (0.1, False), (0.1, True)]
    df = spark.createDataFrame(rows, "relevance double, passed boolean")
    rule = screening.rule_decision({"relevance": ">= 0.6", "passed": "== true"}, {"passed": "== false"}, "manual_review")
    got = [r.d for r in df.select(rule.alias("d")).collect()]
    assert got == ["included", None, None, "manual_review", "excluded", "manual_review"]


def test_relevance_and_vectors(spark):
    df = paper_table(spark, ROWS).withColumn("title_abstract_embedding", F.when(F.col("ord") < 2, F.array(F.lit(1.0), F.col("ord").cast("double"))).otherwise(F.array(F.lit(-1.0), F.lit(0.0))))
    payload = spark.createDataFrame([("a", 'ok {"relevance": 0.9, "confidence": 0.8, "justification": "x"}'), ("b", '{"relevance": 0.4, "confidence": 0.9}'), ("c", '{"relevance": 7, "confidence": 1}'), ("d", "broken")], "id string, payload string")
    scored = screening.relevance_scoring(df, payload)
    got = {r.id: r.screening.final_decision for r in screening.relevance_filter(scored).collect()}
    assert got == {"a": None, "b": "excluded", "c": None, "d": None}
    sem = {r.id: r.screening.final_decision for r in screening.semantic_screening(df, [1.0, 0.0]).collect()}
    assert sem == {"a": "included", "b": "included", "c": "excluded", "d": "excluded"}
    cls = {r.id: (r.screening.final_decision, r.screening.semantic_screening.dominant) for r in screening.rocchio_classifier(df, {"x": [1.0, 0.0], "y": [0.0, 1.0]}).collect()}
    assert cls == {"a": ("included", "x"), "b": ("manual_review", "x"), "c": ("excluded", "y"), "d": ("excluded", "y")}
    roc = {r.id: r.screening.final_decision for r in screening.rocchio_screening(df, [1.0, 0.0]).collect()}
    assert roc == {"a": "included", "b": "included", "c": "excluded", "d": "excluded"}


def test_reports(spark):
    df = paper_table(spark, ROWS)
    row = reports.summary(df).first()
    assert (row.papers, row.author_mentions, row.distinct_authors, row.first_year, row.distinct_keywords) == (4, 4, 4, 2019, 4)
    assert {(r.value, r.n) for r in reports.tabulate(df, F.col("language")).collect()} == {("en", 2), ("de", 1), ("(none)", 1)}
    done = screening.metadata_screening(df, {"paper_types": ["book"]})
    got = {r.group_name: (r.total, r.metadata_failed) for r in reports.screening_funnel(done).collect()}
    assert got["ALL"] == (4, 2) and got["Unknown"] == (1, 0)


def test_sections_and_chunks(spark):
    text = "My paper\n\n1. Introduction\nWords here.\nRQ1: why so?\nII. METHODS\nWe did things in many ways here.\nResults\nKeywords: a; b\nConclusion\nDone."
    s = {x["title"]: x["content"] for x in chunks.sections_of(text)}
    assert s["1. Introduction"].startswith("Words here.") and s["research questions"] == "RQ1: why so?" and s["Keywords"] == "a; b" and s["Conclusion"] == "Done."
    df = spark.createDataFrame([("p", text), ("q", None), ("r", "")], "id string, text string")
    tree = {(r.id, r.level): r.n for r in chunks.chunk_tree(df).groupBy("id", "level").agg(F.count("*").alias("n")).collect()}
    assert tree["p", "paper"] == 1 and tree["p", "paragraph"] == 1 and tree["p", "section"] >= 5
    one = df.select(chunks.sentences(F.lit("A b. C d! E? f")), chunks.pack_sentences(F.lit("aaaa aaaa. bbbb bbbb. cccc cccc."), 4, 2)).first()
    assert one[0] == ["A b.", "C d!", "E?", "f"] and one[1] == ["aaaa aaaa. bbbb bbbb.", "bbbb bbbb. cccc cccc."]
    cut = df.select(chunks.remove_citations(F.lit("As said [Smith, 2020] and (Doe et al., 1999) by Ray (2001) in [1, 2].")), chunks.citation_count(F.lit("As said [Smith, 2020] and [1, 2]."))).first()
    assert cut[0] == "As said  and  by  in ." and cut[1] == 2
    assert df.limit(1).select(chunks.fixed_chunks(F.lit("abcdefg"), 3, 1)).first()[0] == ["abc", "cde", "efg", "g"]
    found = chunks.coverage(df.where("id = 'p'").select("id", F.explode(chunks.detect_sections("text")).alias("s")).select("id", "s.title")).first()
    assert "methods" in found.found and "conclusion" in found.found and found.coverage > 30


def test_schema_is_complete():
    assert len(PAPER.fields) > 30 and PAPER["screening"].dataType["final_decision"]
