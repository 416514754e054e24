import pytest
from pyspark.sql import functions as F

from litsieve import __main__ as cli
from litsieve.functions import identifiers as ids
from litsieve.functions import text as t
from litsieve.operators import chunks, screening, table
from litsieve.plans import pipeline
from litsieve.plans.definition import Definition
from litsieve.schema import decision, set_screening
from litsieve.sources import bibliographic, sinks
from litsieve.streaming import streams

from .test_operators import ROWS, paper_table


def test_cite_keys_with_thirty_taken_suffixes(spark):
    taken = ["Smith2020"] + [f"Smith2020{'a' * (k // 26)}{chr(97 + k % 26)}" for k in range(30)]
    rows = spark.createDataFrame([(k, "Smith2020") for k in range(3)] + [(9, "Smith2020b")], "ord int, base_key string")
    got = {r.ord: r.cite_key for r in ids.resolve_cite_keys(rows, taken=spark.createDataFrame([(x,) for x in taken], "cite_key string")).collect()}
    assert len(set(got.values())) == 4 and not set(got.values()) & set(taken)
    assert [got[k] for k in range(3)] == ["Smith2020ae", "Smith2020af", "Smith2020ag"]


def test_years_are_words(spark):
    df = spark.createDataFrame([("x2019",), ("in 2019.",), ("20191",), ("0999 and 2019",)], "y string")
    assert [r[0] for r in df.select(t.normalize_year(F.col("y"))).collect()] == [None, 2019, None, None]


def test_missing_language_is_english(spark):
    df = paper_table(spark, ROWS)
    got = {r.id: r.why for r in df.select("id", screening.metadata_reason({"language": "NOT: de"}).alias("why")).collect()}
    assert got["d"] == "language: en" and got["b"] is None
    got = {r.id: r.why for r in df.select("id", screening.metadata_reason({"language": ["NOT: en", "de"]}).alias("why")).collect()}
    assert got["d"] is None and got["b"] == "language: de"


def test_sections_drop_what_is_above_and_find_the_title():
    text = "Some words. Above it.\n1. A study of maps\nit is about many large cities, old and new\n2. Open access\nCC BY, and so on for some while\nAbstract\nWe study maps.\nConclusion\nDone."
    got = [(s["title"], s["content"]) for s in chunks.sections_of(text)]
    assert got[0] == ("title", "it is about many large cities, old and new") and "Above it" not in str(got)
    assert chunks.sections_of("It has, no header.\nat all, is there.") == []


def test_citations_go_on_over_fetched_papers(spark):
    def cites(*dois):
        return [(d, None, None, None, "backward", 1.0) for d in dois]

    kind = "array<struct<doi: string, title: string, year: int, author: string, direction: string, confidence: double>>"
    ctx = pipeline.Context(spark)
    df, _ = pipeline.run(spark, {"project": {"name": "x"}, "steps": [{"builtin.paper": {"papers": [{"doi": "10.1/a", "cite_key": "a"}]}}]}, ctx)
    a = spark.createDataFrame([(cites("10.1/b"),)], f"c {kind}")
    df = set_screening(df.drop("citations").crossJoin(a.withColumnRenamed("c", "citations")).select(*df.columns), final_decision=F.lit("included"))
    ctx.fetched = spark.createDataFrame([("b", "b", "10.1/b", cites("10.1/c", "10.1/a")), ("c", "c", "10.1/c", cites("10.1/d")), ("d", "d", "10.1/d", None)], f"id string, cite_key string, doi string, citations {kind}")
    got = {r.id: r.discovery.iteration for r in pipeline.citations(df, ctx, iterations=2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2} and ctx.edges.count() == 4
    ctx.templates = {"drop": [{"builtin.decision": {"include_when": {}, "otherwise": "excluded"}}]}
    got = pipeline.citations(df, ctx, iterations=3, screening="drop")
    assert {r.id: r.d for r in got.withColumn("d", decision()).collect()} == {"a": "included", "b": "excluded"}


def test_duplicate_marks(spark):
    df = paper_table(spark, ROWS)
    marks = spark.createDataFrame([("c", "a"), ("b", None)], "id string, duplicate_of string")
    out = table.mark_duplicates(df, marks)
    assert [r.id for r in table.duplicates_of(out, "a").collect()] == ["c"] and [r.id for r in table.Query(out).show("duplicates").result().collect()] == ["c"]
    with pytest.raises(Exception, match="no paper zz"):
        table.mark_duplicates(df, spark.createDataFrame([("c", "zz")], "id string, duplicate_of string")).collect()
    with pytest.raises(ValueError, match="unknown filter"):
        table.Query(df).show("none")


def test_records_are_numbered_over_files(spark, tmp_path):
    for name, keys in (("b.bib", "xyz"), ("a.bib", "uv")):
        (tmp_path / name).write_text("\n".join(f"@article{{{k}, title={{T {k}}}}}" for k in keys))
    got = bibliographic.read_bibtex(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.id) for r in got] == list(enumerate("uvxyz"))


def test_catalogue_tables(spark):
    name = "litsieve_test_papers"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        sinks.save_table(spark.createDataFrame([("a", 1), ("b", 1)], "cite_key string, v int"), name, ["cite_key"])
        sinks.save_table(spark.createDataFrame([("b", 2), ("c", 2)], "cite_key string, v int"), name, ["cite_key"])
        assert {r.cite_key: r.v for r in spark.table(name).collect()} == {"a": 1, "b": 1, "c": 2}
        sinks.save_table(spark.createDataFrame([("b", 3)], "cite_key string, v int"), name, ["cite_key"], "update")
        assert sinks.load_table(spark, name, cite_key="b").first().v == 3
        sinks.clear_tables(spark, [name, "litsieve_no_such"])
        assert spark.table(name).count() == 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_cache_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text("{}")
    (tmp_path / "b.PDF").write_text("12345")
    assert {r.kind: (r.files, r.bytes) for r in sinks.cache_files(spark, str(tmp_path)).collect()} == {"json": (1, 2), "pdf": (1, 5)}


def test_session_state_and_time_to_live(spark, tmp_path):
    first = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 0.0]), ("r", [4.0, 4.0])], "side string, v array<double>")
    streams.update_centroid(first, f"{tmp_path}/state", "v", "side")
    got = streams.update_centroid(spark.createDataFrame([("a", [2.0, 3.0])], "side string, v array<double>"), f"{tmp_path}/state", "v", "side")
    assert {r.side: r.mean_vector for r in got.collect()} == {"a": [1.0, 1.0], "r": [4.0, 4.0]}
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 00:00:00")], "id string, at string").selectExpr("id", "cast(at as timestamp) at").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, at timestamp").parquet(f"{tmp_path}/in")
    assert sorted(r.id for r in streams.run_to_end(streams.with_ttl(stream, "id", "at", "1 hour"), "ttl").collect()) == ["a", "b"]


def test_definitions_round_trip_and_command_line(spark, tmp_path, capsys):
    made = Definition("x", {"cache_dir": "/c"}).step("paper", papers=[{"doi": "10.1/a", "cite_key": "a"}]).step("echo", template="end", message="hi").run_template("end").step("halt", enabled=False)
    assert Definition.from_yaml(made.to_yaml()) == made
    with pytest.raises(ValueError, match="unknown step"):
        made.step("nope")
    path = tmp_path / "d.yml"
    path.write_text(made.to_yaml())
    assert cli.main(["validate", str(path)]) == 0 and cli.main(["info", str(path)]) == 0 and cli.main(["run", str(path), "--out", str(tmp_path / "out")]) == 0
    said = capsys.readouterr().out
    assert "valid" in said and "3. halt (halt), disabled" in said and spark.read.parquet(str(tmp_path / "out")).count() == 1
    path.write_text("steps: []")
    assert cli.main(["validate", str(path)]) == 1


def test_repeated_titles_are_one_class(spark):
    import random
    from difflib import SequenceMatcher

    from litsieve.operators import dedup

    rnd = random.Random(6)
    titles = ["cold widget of the north", "cold widgets of the north", "cold wodgets of the north", "warm thing", "warm things", "", "a quite different title"]
    rows = [(k, rnd.choice(titles), rnd.choice(["f", "g", None])) for k in range(120)]
    df = spark.createDataFrame([(k, x, None, [(f,)]) for k, x, f in rows], "ord long, title string, doi string, authors array<struct<family_name: string>>")
    methods = [{"method": "title_author_fuzzy", "threshold": 0.9}, {"method": "title_fuzzy", "threshold": 0.97}]

    def near(a, b, m):
        same = SequenceMatcher(None, a[1], b[1]).ratio() >= m["threshold"] and a[1]
        return same and (m["method"] == "title_fuzzy" or (a[2] is not None and a[2] == b[2]))

    primary, want = [], {}
    for r in rows:
        hits = [(k, p[0]) for k, m in enumerate(methods) for p in primary if near(r, p, m)]
        if hits:
            k, target = min(hits)
            want[r[0]] = (target, methods[k]["method"])
        else:
            primary.append(r)
    assert {r.ord: (r.target, r.method) for r in dedup.deduplicate(df, methods).collect()} == want
