import pytest
from pyspark.sql import functions as F

from litsieve.schema import PAPER, set_screening
from litsieve.sources import bibliographic as b
from litsieve.sources import sinks

BIB = r"""
@comment{ignored, x = {y}}
@ARTICLE{Smith2020, title = {The {Deep} learning of \& maps}, author = {Smith, Ann and bob m. jones}, year = 2020, journal = "Journal of Maps",
  author_keywords = {Maps; AI}, keywords = {maps;roads}, doi = {https://doi.org/10.1/ABC}, pages = { }}
@inproceedings{123, title={Second {one
  over} lines}, booktitle = {Proc. of X}, year={n.d.}}
@weird{w1, title = {Third}, type = {Conference Review}}
"""
RIS = """TY  - JOUR
T1  - a first title
AU  - Doe, Jane
AU  - Roe, Rick
KW  - one
KW  - Two
PY  - 2019/05/01
AN  - 77
SP  - 1
EP  - 9
ER  -

TY  - CONF
TI  - second
DO  - 10.2/x
ER  -
TY  - XYZ
T1  - third without end
"""


def test_bibtex(spark, tmp_path):
    (tmp_path / "scopus_export.bib").write_text(BIB)
    rows = b.read_bibtex(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.id for r in rows] == ["Smith2020", "123", "w1"]
    first = rows[0]
    assert first.title == "The Deep Learning of & Maps" and first.doi == "10.1/abc" and first.year == 2020 and first.keywords == ["maps", "roads", "ai"]
    assert [(a.given_name, a.family_name) for a in first.authors] == [("Ann", "Smith"), ("Bob M.", "Jones")]
    assert first.paper_type == "journal_article" and first.discovery.source_database == "scopus" and first.pages is None
    assert rows[1].title == "Second One over Lines" and rows[1].year is None and rows[2].paper_type == "conference_paper"
    (tmp_path / "bad.bib").write_text("@article{k, year = 2000}")
    with pytest.raises(Exception, match="entry without title"):
        b.read_bibtex(spark, str(tmp_path / "bad.bib")).collect()


def test_ris(spark, tmp_path):
    (tmp_path / "x.ris").write_text(RIS)
    rows = b.read_ris(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.id for r in rows[:2]] == ["ris_an_77", "ris_doi_10.2/x"] and rows[2].id.startswith("ris_auto_")
    assert rows[0].year == 2019 and rows[0].pages == "1-9" and rows[0].keywords == ["one", "two"] and len(rows[0].authors) == 2
    assert [r.paper_type for r in rows] == ["journal_article", "conference_paper", "other"]


CITED = """
@article{k1, doi = {doi:10.1/A}, title = {One title}, abstract = {Text}, keywords = {x, y}, author = {Doe, Ann and Bo Roe}, year = {2020}, cites = {{10.2/b, 10.3/C, nothing}}, citedby = {10.4/d}, citedbycount = {many}, lastchecked = {2024-01-01}}
@misc{k2, doi = {10.1/b}, title = {Two}, abstract = {Text}, keywords = {x}, citedbycount = {7}}
@book{k3, title = {Three}, abstract = {Text}, keywords = {x}}
@book{k4, doi = {zz}, title = {Four}, abstract = {Text}, keywords = {x}}
@book{k5, doi = {10.1/e}, title = {Five}, abstract = { }, keywords = {x}}
"""


def test_bibtex_with_stated_citations(spark, tmp_path):
    (tmp_path / "x.bib").write_text(CITED)
    good, skipped = b.read_cited_bibtex(spark, str(tmp_path))
    one, two = good.orderBy("ord").collect()
    assert [(c.doi, c.direction, c.confidence) for c in one.citations] == [("10.2/b", "backward", 1.0), ("10.3/c", "backward", 1.0)]
    assert [(c.doi, c.direction) for c in one.cited_by] == [("10.4/d", "forward")] and one.cited_by_count == 1 and one.last_checked == "2024-01-01"
    assert (one.id, one.cite_key, one.title, one.year, one.keywords) == ("10.1/a", "k1", "One title", 2020, ["x", "y"]) and [a.family_name for a in one.authors] == ["Doe", "Roe"]
    assert two.cited_by_count == 7 and two.citations == [] and two.last_checked and two.paper_type == "other" and two.authors is None
    assert {r.key: r.reason for r in skipped.collect()} == {"k3": "Missing DOI", "k4": "Invalid DOI: zz", "k5": "Missing abstract"}


def test_exports_of_three_sources(spark, tmp_path):
    entry = r"@inproceedings{k, title={T}, author={Doe, Ann Mary and Bo Roe}, year={2020}, journal={J}, booktitle={B}, number={3}, pages={1}, keywords={a; a\"{o}b, `` c ''}, author_keywords={``x'', y\&z}, note={n}, series={s}, unique-id={u}}"
    (tmp_path / "x.bib").write_text(entry)
    wos, scopus, ieee = (b.read_exports(spark, str(tmp_path), s).first() for s in ("wos", "scopus", "ieee"))
    assert (wos.journal, ieee.journal, wos.issue, wos.year, wos.paper_type, wos.citekey) == ("J", "B", "3", 2020, "inproceedings", "k")
    assert wos.keywords == ["a", "ab", "c"] and wos.keywords_extra is None and scopus.keywords == ["x", "y"] and scopus.keywords_extra == ["a", "ab", "c"]
    assert [(a.last_name, a.first_name, a.initials, a.order) for a in wos.authors] == [("Doe", "Ann Mary", "AM", 0), ("Roe", "Bo", "B", 1)]
    assert wos.source_details == {"source": "Web of Science", "unique-id": "u"} and ieee.source_details == {"source": "IEEE Xplore", "note": "n", "series": "s"}


def papers(spark):
    rows = b.literal_papers(spark, [{"doi": "10.1/a", "cite_key": "a"}, {"doi": "10.1/b", "cite_key": "b"}, {"doi": None, "cite_key": "c"}, {"doi": "10.1/d"}])
    rows = rows.withColumn("title", F.concat(F.lit("Salt & "), "cite_key"))
    return set_screening(rows, final_decision=F.when(F.col("ord") != 1, "included"))


def test_json_round_trip_and_bad_lines(spark, tmp_path):
    df = papers(spark)
    assert sinks.same_after_round_trip(df, f"{tmp_path}/rt")
    (tmp_path / "x.jsonl").write_text('{"id": "a", "year": 2000}\n\nnot json\n{"id": "b"}\n')
    assert [r.id for r in b.read_jsonl(spark, f"{tmp_path}/x.jsonl").collect()] == ["a", "b"]
    assert b.bad_lines(spark, f"{tmp_path}/x.jsonl").count() == 1
    with pytest.raises(Exception):
        b.read_jsonl(spark, f"{tmp_path}/x.jsonl", strict=True).collect()


def test_export(spark, tmp_path):
    df = papers(spark)
    assert sorted(r.cite_key for r in sinks.select_for_export(df).collect())[:1] == ["a"]
    assert sinks.select_for_export(df, "no", "yes", "yes").count() == 1
    sinks.export(df, f"{tmp_path}/e", gzip=True)
    assert spark.read.json(f"{tmp_path}/e").count() == 2
    with pytest.raises(Exception, match="already exists"):
        sinks.export(df, f"{tmp_path}/e")
    sinks.export(df, f"{tmp_path}/b", "bibtex", doi="yes", includes="yes")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/b").collect())
    assert text.count("@misc{") == 4 and r"Salt \& a" in text
    sinks.export(df, f"{tmp_path}/p", includes="yes", doi="yes", partition_by="final_decision")
    assert {r.final_decision for r in spark.read.json(f"{tmp_path}/p").collect()} == {"included", "pending"}
    assert sinks.project(df, "minimal").columns == ["id", "cite_key", "title", "year", "doi"]


def test_checkpoints(spark, tmp_path):
    df = papers(spark)
    assert sinks.latest_checkpoint(spark, str(tmp_path), "p", 5) is None
    sinks.write_checkpoint(df, str(tmp_path), "p", 1)
    step, back = sinks.latest_checkpoint(spark, str(tmp_path), "p", 5)
    assert step == 1 and back.count() == 4 and back.schema.names == PAPER.names


def test_files_and_cache(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(b"%PDF see https://doi.org/10.1234/Ab.c). more")
    (tmp_path / "two.pdf").write_bytes(b"nothing")
    rows = b.scan_files(spark, str(tmp_path)).collect()
    assert [r.doi for r in rows] == ["10.1234/ab.c", None] and len(rows[0].sha256) == 64
    cache = spark.sql("select '10.1/a' doi, current_timestamp() fetched_at union all select '10.1/b', current_timestamp() - interval 90 days")
    keys = papers(spark).where("doi is not null").select("doi")
    assert b.due(keys, cache).count() == 2 and b.due(keys, cache, None).count() == 1 and b.due(keys, cache, 0).count() == 3
