import numpy as np
import pytest
from pyspark.sql import functions as F

from litsieve.functions import identifiers as ids
from litsieve.functions import markdown, records
from litsieve.functions import text as t
from litsieve.functions import vectors as v
from litsieve.operators import table
from litsieve.plans import catalog


def values(spark, column_of, inputs, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r.y for r in rows.select("k", column_of(F.col("x")).alias("y")).orderBy("k").collect()]


def test_doi(spark):
    raw = ["https://doi.org/10.1/AbC", "http://doi.org/10.2/x/y", "doi:10.3/z", "DOI.10.4/q", " 10.5/a(b):c.d ", "10.6", "11.1/x", "", None, "https://dx.doi.org/10.1/a", "10./x"]
    assert values(spark, ids.doi_stem, raw) == ["10.1/abc", "10.2/x/y", "10.3/z", "10.4/q", "10.5/a(b):c.d", None, None, None, None, None, "10./x"]
    assert values(spark, ids.doi_safe, ["10.5/a(b):c.d"]) == ["10_5_a_b_c_d"]
    assert values(spark, ids.doi_key, ["10.1/abc"])[0].startswith("doi_") and len(values(spark, ids.doi_key, ["10.1/abc"])[0]) == 12


def test_title_case(spark):
    raw = ["the rise of ai in the usa", "jean-claude van damme", "smith & co. ltd", "müller gmbh", "models: a review of iot", "smith et al. on peer–to–peer", "ludwig von beethoven", "", None, "b2b and the 5g era"]
    want = ["The Rise of AI in the USA", "Jean-Claude van Damme", "Smith & Co. Ltd", "Müller GmbH", "Models: A Review of IoT", "Smith et al. on Peer-To-Peer", "Ludwig von Beethoven", "", None, "B2B and the 5G Era"]
    assert values(spark, t.title_case, raw) == want


def test_normalisers(spark):
    assert values(spark, t.normalize_title, [" {On} <b>big</b>  data $\\&$ x ", r"a \& b"]) == ["On Big Data $&$ X", "A & B"]
    assert values(spark, t.normalize_abstract, ["  A <i>b</i>\n c &amp; d  "]) == ["A b c & d"]
    assert values(spark, t.parse_abstract, ["<jats:p>Abstract We show</jats:p>", "Nothing"]) == ["We show", "Nothing"]
    assert values(spark, t.normalize_keywords, ["B; a,c ;b; ", "x, Y ,x", "a and b", None, ""]) == [["b", "a,c"], ["x", "y"], ["a", "b"], None, []]
    assert values(spark, t.normalize_year, ["999", "1000", "2100", "2101", "2020-05-01", "in 1999.", "x", None, "12345"]) == [None, 1000, 2100, None, 2020, 1999, None, None, None]
    assert values(spark, t.title_key, ["  ABC  ", "x" * 60]) == ["abc", "x" * 50]
    assert values(spark, t.extract_json, ['so {"a": {"b": 1}} ok', "none"]) == ['{"a": {"b": 1}}', None]


def test_substantive(spark):
    raw = ["short", "The authors declare no conflict of anything in this.", "We thank them and acknowledge the funding of all.", "A study of many things and how they are made.", None, "words " * 30 + "conflict of interest"]
    assert values(spark, t.substantive, raw) == [False, False, False, True, False, True]


@pytest.mark.parametrize(("keyword", "hits"), [("art", ["art", "an art.", "éart art"]), ("art*", ["art", "artful", "an art."]), ("*art", ["art", "smart", "an art.", "éart"]), ("*art*", ["art", "smartly", "smart", "artful"]), ("c++", ["c++ code"]), ("caf", [])])
def test_wildcards(spark, keyword, hits):
    raw = ["art", "artful", "smart", "smartly", "an art.", "éart", "éart art", "c++ code", "café"]
    got = values(spark, lambda x: t.matches_keyword(x, keyword), raw)
    for h in hits:
        assert got[raw.index(h)]
    if keyword in ("art", "caf"):
        assert not got[raw.index("café")] and not got[raw.index("smart")] and not got[raw.index("éart")]


def test_names(spark):
    got = values(spark, ids.parse_authors, ["Last, First and plato AND ada m. lovelace", ""])
    assert [(a.given_name, a.family_name) for a in got[0]] == [("First", "Last"), (None, "Plato"), ("Ada M.", "Lovelace")]
    assert got[1] == []
    fold = values(spark, lambda x: ids.author_string(ids.parse_authors(x)), ["", "A, B", "A, B and C, D", "A, B and C, D and E, F", None])
    assert fold == ["Unknown", "A", "A & C", "A et al.", "Unknown"]


def test_iso4(spark):
    raw = ["Journal of Business Research", "IEEE Transactions on Systems", "Academy of Management Journal", "Nature", "MIS Quarterly", "of the", "", None, "Mind"]
    assert values(spark, ids.iso4, raw) == ["J. Bus. Res.", "IEEE Trans. Syst.", "Aca. Manag. J.", "Nat.", "MIS Q.", None, None, None, "Mind."]


def test_suffix(spark):
    assert values(spark, ids.suffix, [0, 25, 26, 27, 51, 52], "int") == ["a", "z", "aa", "ab", "az", "aaa"]


def test_cite_keys_skip_taken_ones(spark):
    rows = spark.createDataFrame([(0, "S20"), (1, "S20"), (2, "S20a"), (3, "S20"), (4, "T1"), (5, None)], "ord int, base_key string")
    got = {r.ord: r.cite_key for r in ids.resolve_cite_keys(rows).collect()}
    assert got[0] == "S20" and got[2] == "S20a" and got[1] == "S20b" and got[3] == "S20c" and got[4] == "T1"
    taken = spark.createDataFrame([("T1",), ("T1a",)], "cite_key string")
    got = {r.ord: r.cite_key for r in ids.resolve_cite_keys(rows, taken=taken).collect()}
    assert got[4] == "T1b" and got[0] == "S20"


def test_quality_and_confidence(spark):
    words = F.when(F.col("x") == "full", F.array(F.lit("k")))
    title = F.when(F.col("x") != "none", F.col("x"))
    assert values(spark, lambda x: ids.quality_score(title, words, title), ["full", "part", "none"]) == [0.9, 0.65, 0.2]
    none = F.lit(None).cast("string")
    assert values(spark, lambda x: ids.citation_confidence(x == "p", none, x, F.lit(2000)), ["p", "a long enough title"]) == [1.0, 0.65]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [-1.0, -1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in rows.select(v.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0 and abs(got[1] + 1) < 1e-12 and got[2] == 0 and got[3] is None
    assert [round(r[0], 9) for r in rows.limit(2).select(v.cosine_unit(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]
    mean = v.mean_vectors(rows.limit(2).withColumn("g", F.lit(1)), "a", "g").first().mean_vector
    assert mean == [1.0, 0.5]


def test_inverted_index(spark):
    df = spark.createDataFrame([({"world": [1], "hello": [0, 2]},)], "x map<string, array<int>>")
    assert df.select(t.inverted_index_text(F.col("x"))).first()[0] == "hello world hello"


def test_nearest_is_among_all_other_rows(spark, tmp_path):
    # 1 and 3 are near each other, but of different labels
    rows = [(1, [1.0, 0.1, 0.0], 0), (2, [0.0, 1.0, 0.0], 0), (3, [1.0, 0.0, 0.0], 1), (4, [0.0, 0.0, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["nearest_neighbor_gap_all"](spark, str(tmp_path)).collect()
    assert {(r.vec_id, r.best) for r in got} == {(2, 0.099504), (4, 0.0)}
    e = np.random.default_rng(1).normal(size=(70, 5))
    e[9] = 0
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(e)] + [(70, [1.0]), (71, None)], "vec_id long, v array<double>")
    u = e / np.maximum(np.linalg.norm(e, axis=1), 1e-9)[:, None]
    want = (u @ u.T - 9 * np.eye(70)).max(1)
    best = {r.vec_id: r.best for r in v.nearest_other(table, block=16).collect()}
    assert sorted(best) == list(range(70)) and np.allclose([best[k] for k in range(70)], want)


def test_nearest_within_a_label_pairs_few_rows(spark, tmp_path):
    """Rows with a near neighbour in their block are done; results are those of all pairs."""
    rnd = np.random.default_rng(3)
    rows = [(k, x.tolist(), k % 3) for k, x in enumerate(rnd.normal(size=(160, 30)))]
    rows += [(k + 160, (np.array(rows[k][1]) * 2).tolist(), rows[k][2]) for k in range(0, 90, 2)]  # copies
    rows += [(500, [0.0] * 30, 0), (501, None, 0), (502, [1.0] * 30, None), (503, [1.0, 2.0], 1), (504, [1.0] * 30, 7), (7, rows[40][1], 2), (505, [-1.0, 1.0], 2), (506, [1.0, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
    best = {}
    for i, x, a in rows:
        for j, y, b in rows:
            if i != j and a == b and a is not None and x and y and len(x) == len(y):
                size = np.linalg.norm(x) * np.linalg.norm(y)
                best[i] = max(best.get(i, -1), np.dot(x, y) / size if size else 0.0)
    for block in (8, 4096):
        got = {r.vec_id: r.best for r in v.lonely_in_group(df, 0.4, block).where("best < 0.4").collect()}
        want = {k: x for k, x in best.items() if x < 0.4}
        assert len(want) > 5 and sorted(got) == sorted(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    df.withColumnRenamed("v", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = catalog.queries()["nearest_neighbor_gap"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "zipwith" not in plan  # no pair of rows is a row


def test_analysis_markdown(spark):
    text = "intro\n##  2. METHODS\r\n2.1. **EMPIRICAL_BASE:** ten firms\nmore\n\n2.2. METHODOLOGY_CLASS: case\n### METHODS\n## VENDORS\n**3.1. **REGULAR_SUPPLIER:** a\nb\n## VENDORS:\n\n3.1. **IT_SUPPLIER:** c"
    rows = spark.createDataFrame([(0, text), (1, None), (2, ""), (3, "## lower\nx"), (4, "## PAPER_HEADER\n## METHODOLOGY")], "id int, x string")
    got = {r.id: r.a for r in rows.select("id", markdown.analysis(F.col("x")).alias("a")).collect()}
    assert got[0].sections["METHODOLOGY"].endswith("### METHODS") and got[0].empirical_base == "ten firms" and got[0].methodology_class == "case"
    assert got[0].regular_supplier is None and got[0].it_supplier == ["c"] and set(got[0].sections) == {"METHODOLOGY", "VENDORS"}
    assert got[1].sections is None and got[2].sections == {} and got[3].sections == {} and got[4].sections == {"PAPER_HEADER": "", "METHODOLOGY": ""} and got[4].title is None
    lists = spark.createDataFrame([("1. one two\n2. three",), ("* a\n* b",), ("First. Second",), ("Only",), ("",)], "x string")
    assert [r[0] for r in lists.select(markdown.questions(F.col("x"))).collect()] == [["one two", "three"], ["a", "b"], ["First.", "Second."], ["Only"], [""]]
    assert lists.select(markdown.steps(F.col("x"))).first()[0] == ["one two", "three"]


def test_an_analysis_reads_its_text_once(spark):
    """Fields of an analysis, and the search for names that come again, don't repeat the
    search for headers."""
    rows = spark.createDataFrame([("## A\nx\n## B\n## A\ny",)], "x string")
    a = rows.select(markdown.analysis(F.col("x")).alias("a")).select("a.title", "a.authors", "a.it_supplier", "a.sections")
    assert a.first().sections == {"A": "y", "B": ""}
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1, plan


def test_items_keep_digits_at_their_ends(spark):
    """An item's place isn't taken for characters to trim."""
    assert values(spark, table.split_tags, ["0a0: 1b1 :2"]) == [["0a0", "1b1", "2"]]
    assert [a.full_name for a in values(spark, ids.parse_authors, ["0ne Two0 and 1st Roe1"])[0]] == ["0ne Two0", "1st Roe1"]


def test_semantic_scholar(spark):
    answer = '{"data": [{"citingPaper": {"title": "A long enough title", "year": 2020, "externalIds": {"DOI": "10.1/A"}, "authors": [{"name": "A B"}]}}, {"citingPaper": {"title": "T"}}]}'
    rows = spark.createDataFrame([(answer,), ("{}",), (None,)], "x string")
    got = [r[0] for r in rows.select(records.semantic_scholar_cited_by(F.col("x"))).collect()]
    assert [(c.doi, c.author, c.year, c.direction, c.confidence) for c in got[0]] == [("10.1/a", "A B", 2020, "forward", 1.0), (None, "", None, "forward", 0.5)] and not got[1] and not got[2]
    record = '{"publicationTypes": ["Review", "X"], "openAccessPdf": {"url": "u"}, "corpusId": 5, "isOpenAccess": false, "year": "n.d.", "abstract": "t"}'
    r = spark.createDataFrame([(record,)], "x string").select(records.semantic_scholar(F.col("x")).alias("r")).first().r
    assert (r.paper_type, r.download_url, r.source_key, r.oa_status, r.year, r.authors, r.journal, r.title) == ("Review", "u", "s2:5", "closed", None, [], None, None)
