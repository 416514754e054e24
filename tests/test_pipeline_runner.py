import pytest
from pyspark.sql import functions as F

from litsieve.plans import pipeline
from litsieve.schema import decision
from litsieve.streaming import streams

DEFINITION = """
project: {name: demo, checkpoints: "%s"}
templates:
  - template: screen
    steps:
      - {step: meta, builtin.metadata_screening: {exclude: {doi_not_set: true}}}
      - step: words
        builtin.keyword_screening: {include: {keywords: {m: ["map*"]}, thresholds: {auto_accept: 0.6, manual_review: 0.3}}, complete: loose}
steps:
  - {step: load, builtin.bibtex_import: {path: "%s"}}
  - {step: extra, builtin.paper: {papers: [{doi: 10.9/z, cite_key: zed}]}}
  - {step: off, enabled: false, builtin.halt: {message: never}}
  - {step: fix, builtin.patch: {patches: [{doi: 10.9/z, set: {title: Maps of Z, abstract: "A long text on the maps of Z and all that is in them."}, append_fields: {keywords: [maps]}}]}}
  - {step: dedup, builtin.deduplication: {}}
  - {step: screen, builtin.run-template: {template: screen}}
  - {step: save, builtin.checkpoint: {step: 6}}
  - {step: vectors, builtin.generate_embeddings: {with_chunks: true}}
  - {step: keys, builtin.fix_cite_keys: {}}
  - {step: count, builtin.report: {reports: [summary, decisions, completeness, funnel]}}
  - {step: stop, builtin.halt: {message: enough}}
  - {step: never, builtin.echo: {message: x}}
"""
BIB = """
@article{A1, title={On maps of cities}, abstract={We study maps of many cities in the world.}, author={Low, Ann}, year=2020, doi={10.1/a}}
@article{A2, title={On maps of cities.}, abstract={We study maps of many cities in the world.}, author={Low, Ann}, year=2020, doi={10.1/b}}
@article{A3, title={A copy by DOI}, author={Else, Bo}, year=2021, doi={10.1/A}}
@article{A4, title={No DOI at all}, author={Low, Ann}, year=2020}
"""


def test_runs_a_definition(spark, tmp_path):
    (tmp_path / "x.bib").write_text(BIB)
    text = DEFINITION % (tmp_path / "cp", tmp_path / "x.bib")
    df, ctx = pipeline.run(spark, text)
    got = {r.id: (r.duplicate_of, r.d, r.cite_key) for r in df.withColumn("d", decision()).collect()}
    assert got["A2"][:2] == ("A1", "excluded_duplicate") and got["A3"][0] == "A1" and got["A4"][1] == "excluded"
    assert got["A1"][1] == "included" and got["zed"][1] == "included" and got["A1"][2] == "Low2020" and got["A2"][2] == "Low2020a"
    assert [r.status for r in ctx.log][-1] == "halted" and "skipped" in [r.status for r in ctx.log]
    assert ctx.reports["summary"].first().papers == 3 and ctx.chunks.count() > 2
    again, log = pipeline.run(spark, text, resume=True)
    assert again.count() == 5 and sum(r.status == "skipped" for r in log.log) == 7


def test_every_registered_step_is_known():
    assert len(pipeline.STEPS) == 31


def test_definitions_are_validated(spark):
    assert pipeline.validate({"steps": [{"builtin.none": {}}, {"builtin.run-template": {"template": "t"}}]}) == ["project.name is missing", "unknown step none", "unknown template t"]
    with pytest.raises(ValueError, match="unknown step"):
        pipeline.run(spark, {"project": {"name": "x"}, "steps": [{"builtin.nope": {}}]})


def test_citations_and_metadata(spark):
    ctx = pipeline.Context(spark)
    df, _ = pipeline.run(spark, {"project": {"name": "x"}, "steps": [{"builtin.paper": {"papers": [{"doi": "10.1/a", "cite_key": "a"}, {"doi": "10.1/b", "cite_key": "b"}]}}]}, ctx)
    cites = F.array(F.struct(F.lit("10.1/c").alias("doi"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("author"), F.lit("backward").alias("direction"), F.lit(1.0).alias("confidence")))
    from litsieve.schema import set_screening

    df = set_screening(df.withColumn("citations", F.when(F.col("id") == "a", cites)), final_decision=F.when(F.col("id") == "a", "included"))
    ctx.fetched = spark.createDataFrame([("c", "c", "10.1/c", "Cited"), ("a2", "a2", "10.1/a", "Known")], "id string, cite_key string, doi string, title string")
    out = pipeline.citations(df, ctx)
    row = out.where("id = 'c'").first()
    assert out.count() == 3 and row.discovery.iteration == 1 and row.discovery.method == "backward_citation" and ctx.edges.count() == 1
    assert pipeline.retrieve_metadata(out, ctx).where("id = 'a'").first().title == "Known"
    pipeline.upload_database(out, ctx)
    assert ctx.database["papers"].count() == 3


def test_streams(spark, tmp_path):
    from litsieve.sources.bibliographic import literal_papers

    literal_papers(spark, [{"doi": d, "cite_key": k} for d, k in (("10.1/a", "x"), ("10.1/A", "y"), (None, "z"))]).coalesce(1).write.json(f"{tmp_path}/in")
    stream = streams.papers_stream(spark, f"{tmp_path}/in")
    assert streams.run_to_end(streams.first_seen(stream), "t_first").count() == 2
    done = spark.createDataFrame([("x",)], "id string")
    query = streams.to_files(streams.only_new(streams.papers_stream(spark, f"{tmp_path}/in"), done), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    counts = streams.run_to_end(streams.windowed_counts(events, "ts", "event_type", "value", "1 day"), "t_windows", "complete")
    assert counts.agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    mean = streams.run_to_end(streams.running_mean(events, "event_type", "value"), "t_mean", "complete")
    assert mean.count() == 5
