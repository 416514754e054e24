"""The declarative pipeline: a YAML list of steps over one paper table.

A definition has project{name, checkpoints, cache_dir}, templates[{template, steps}] and
steps[{step, enabled, builtin.<name>: {parameters}}]. A step is a function
(table, context, parameters) -> table, so that a whole pipeline stays one lazy plan;
only checkpoints, exports and reports run it. Services that the steps would call are
tables of pre-fetched answers in the context: ``responses[<step>]``, ``fetched``, ``vectors``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import cite_key_base, resolve_cite_keys
from ..operators import chunks, dedup, graph, reports, screening, table
from ..schema import PAPER, conform, decision, is_duplicate, is_excluded, is_included, is_primary, set_screening
from ..sources import bibliographic, sinks
from ..storage import shared_folder, written


class Halt(Exception):
    """Raised by the halt step: the pipeline ends well, with the table so far."""


@dataclass
class StepResult:
    name: str
    status: str = "ok"  # ok, warning, error, halted, skipped
    message: str = ""
    stats: dict[str, int] = field(default_factory=dict)


@dataclass
class Context:
    spark: SparkSession
    project: dict[str, Any] = field(default_factory=dict)
    templates: dict[str, list] = field(default_factory=dict)
    responses: dict[str, DataFrame] = field(default_factory=dict)
    journals: DataFrame | None = None
    fetched: DataFrame | None = None
    vectors: DataFrame | None = None
    embed: Callable = chunks.hashed_embedding
    database: dict[str, DataFrame] = field(default_factory=dict)
    reports: dict[str, DataFrame] = field(default_factory=dict)
    chunks: DataFrame | None = None
    edges: DataFrame | None = None
    log: list[StepResult] = field(default_factory=list)
    run: Callable | None = None


def ingest(old: DataFrame, new: DataFrame, limit: int | None = None, randomize: bool = False, resolve_duplicates: bool = True, expected_count: int | None = None, ctx: Context | None = None, **_: Any) -> DataFrame:
    """Appends new papers after the old ones; a DOI that was there before marks a duplicate
    of its first paper."""
    new = bibliographic.sample(new, limit, randomize and limit is not None)
    if expected_count is not None and ctx is not None and (n := new.count()) != expected_count:
        ctx.log.append(StepResult("import", "warning", f"expected {expected_count} papers, found {n}"))
    last = old.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("_base"))
    moved = new.crossJoin(F.broadcast(last)).withColumn("ord", F.col("ord") + F.col("_base")).select(*old.columns)  # one row
    both = old.unionByName(moved)
    if not resolve_duplicates:
        return both
    first = table.first_per_key(both, "doi", "ord", "_first")
    link = F.when(F.col("_first").isNotNull() & (F.col("_first") != F.col("id")), F.col("_first"))
    return first.withColumn("duplicate_of", F.coalesce("duplicate_of", link)).select(*old.columns)


def bibtex_import(df, ctx, path, source_type=None, discovery_method="keyword_search", **more):
    return ingest(df, bibliographic.read_bibtex(ctx.spark, path, source_type, discovery_method), ctx=ctx, **more)


def ris_import(df, ctx, path, source_type="ris", discovery_method="keyword_search", **more):
    new = bibliographic.read_ris(ctx.spark, path, source_type, discovery_method)
    w = Window.partitionBy("cite_key").orderBy("ord")
    k = F.row_number().over(w) - 1
    key = F.when(k > 0, F.concat("cite_key", F.format_string("_%02d", k))).otherwise(F.col("cite_key"))
    return ingest(df, new.withColumn("cite_key", key).withColumn("id", F.col("cite_key")), ctx=ctx, **more)


def input_step(df, ctx, path, strict=False, **more):
    return ingest(df, bibliographic.read_jsonl(ctx.spark, path, strict), ctx=ctx, **more)


def load_files(df, ctx, path, pattern="*.pdf", **more):
    found = bibliographic.scan_files(ctx.spark, path, pattern).where("doi is not null")
    rows = found.orderBy("path").select(F.monotonically_increasing_id().alias("ord"), "doi", F.col("path").alias("pdf_path"))  # ids follow the sort
    from ..functions.identifiers import doi_key

    return ingest(df, conform(rows.withColumn("id", doi_key(F.col("doi"))).withColumn("cite_key", F.col("id"))), ctx=ctx, **more)


def paper(df, ctx, papers, **more):
    return ingest(df, bibliographic.literal_papers(ctx.spark, papers), ctx=ctx, **more)


def deduplication(df, ctx, methods=({"method": "doi_exact"}, {"method": "title_author_fuzzy", "threshold": 0.90}, {"method": "title_fuzzy", "threshold": 0.95}), **_):
    fresh = df.where(F.col("screening.deduplication").isNull())
    found = dedup.deduplicate(fresh, list(methods))
    names = df.select(F.col("ord").alias("target"), F.col("id").alias("_target"))
    marks = found.join(names, "target").select("ord", "_target", F.col("method").alias("_method"))
    out = df.join(marks, "ord", "left")
    hit = F.col("_target").isNotNull()
    record = F.when(hit, F.struct(F.lit(True).alias("is_duplicate"), F.col("_target").alias("duplicate_of"), F.col("_method").alias("method"), F.lit(None).cast("double").alias("similarity")))
    record = record.when(F.col("screening.deduplication").isNull(), F.struct(F.lit(False).alias("is_duplicate"), F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("similarity"))).otherwise(F.col("screening.deduplication"))
    fuzzy = hit & (F.col("_method") != "doi_exact")  # duplicates known since the import keep their decision
    out = set_screening(out, deduplication=record, final_decision=F.when(fuzzy, "excluded_duplicate").otherwise(F.col("screening.final_decision")), final_decision_by=F.when(fuzzy, "deduplication").otherwise(F.col("screening.final_decision_by")))
    return out.withColumn("duplicate_of", F.coalesce("duplicate_of", "_target")).select(*df.columns)


def sinks_cut(ctx: Context, df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration in the folder that the cluster shares."""
    return written(df, "iteration")


def citations(df, ctx, direction="backward", iterations=1, min_year=None, included_only=True, screening=None, **_):
    """An iteration takes the papers found by the last one (first the seeds), follows their
    citations (forward: who cites them) and adds what ``fetched`` knows and the table doesn't;
    the edges of added papers count in the next one. Seeds are included papers, or all that
    aren't excluded. Added papers go on unless excluded; with a screening template, which runs
    on each iteration's table, only included ones do."""
    forward = direction == "forward"
    a, b = ("cited", "citing") if forward else ("citing", "cited")
    for k in range(1 if forward or ctx.fetched is None else iterations):
        if ctx.fetched is None:
            break
        go = is_included() if included_only and (k == 0 or screening) else ~is_excluded()
        seeds = df.where((F.coalesce("discovery.iteration", F.lit(0)) == k) & go & is_primary() & F.col("doi").isNotNull()).select(F.col("doi").alias(a)).distinct()
        reached = graph.edges(df).join(seeds, a, "left_semi").select(F.col(b).alias("doi")).distinct()
        wanted = reached.join(df.select("doi"), "doi", "left_anti")
        found = conform(ctx.fetched).join(wanted, "doi", "left_semi").dropDuplicates(["doi"])
        found = found if min_year is None else found.where(F.coalesce(F.col("year") >= min_year, F.lit(False)))
        how = "forward_citation" if forward else "backward_citation"
        found = found.withColumn("discovery", F.struct(F.lit(how).alias("method"), F.lit(k + 1).alias("iteration"), F.lit("citations").alias("source_database")))
        found = found.withColumn("ord", F.coalesce("ord", F.lit(0).cast("long")))
        df = sinks_cut(ctx, ingest(df, found.select(*df.columns)))
        if screening:
            df = run_template(df, ctx, screening)
    ctx.edges = graph.edges(df)
    return df


def journal_step(df, ctx, **_):
    empty = ctx.spark.createDataFrame([], "name string, acronym string, iso4 string")
    return screening.journal_screening(df, ctx.journals if ctx.journals is not None else empty)


def generate_embeddings(df, ctx, with_chunks=False, **_):
    """Vectors from the context where it has them, else from the embedder."""
    text = F.concat_ws(" ", "title", "abstract")
    if ctx.vectors is not None:
        df = table.coalesce_join(df, ctx.vectors.select("id", F.col("embedding").cast("array<double>").alias("title_abstract_embedding")), "id", ["title_abstract_embedding"])
    if with_chunks:
        ctx.chunks = chunks.chunk_tree(df, "id", "abstract").where(F.length("text") > 5).withColumn("embedding", ctx.embed(F.col("text")))
    return df.withColumn("title_abstract_embedding", F.coalesce("title_abstract_embedding", F.when(F.length(text) > 5, ctx.embed(text))))


def retrieve_metadata(df, ctx, columns=("title", "abstract", "keywords", "authors", "year", "journal"), overwrite=False, **_):
    return df if ctx.fetched is None else table.coalesce_join(df, conform(ctx.fetched).dropDuplicates(["doi"]), "doi", list(columns), overwrite)


def download_pdfs(df, ctx, **_):
    """pdf_path from the table of downloads (doi, path)."""
    found = ctx.responses.get("download_pdfs")
    return df if found is None else table.coalesce_join(df, found.select("doi", F.col("path").alias("pdf_path")), "doi", ["pdf_path"])


def fix_cite_keys(df, ctx, **_):
    """New keys from first author and year; papers without them keep theirs."""
    base = F.coalesce(cite_key_base(F.get("authors", F.lit(0))["family_name"], F.col("year")), F.col("cite_key"))
    return resolve_cite_keys(df.withColumn("base_key", base).drop("cite_key")).select(*df.columns)


def patch_step(df, ctx, patches, **_):
    """patches: [{doi, replace_fields|set: {column: value}, append_fields: {column: [..]}}]."""
    from ..functions.identifiers import doi_stem

    out = df
    for p in patches:
        here = is_primary() & (F.col("doi") == doi_stem(F.lit(p["doi"])))
        for name, value in {**p.get("replace_fields", {}), **p.get("set", {})}.items():
            top, _, rest = name.partition(".")
            if top not in df.columns:
                ctx.log.append(StepResult("patch", "warning", f"no field {name}"))
                continue
            if rest:
                kind = df.select(f"{top}.{rest}").schema[0].dataType
                changed = F.coalesce(F.col(top), F.from_json(F.lit("{}"), df.schema[top].dataType)).withField(rest, F.lit(value).cast(kind))
            else:
                changed = (F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)).cast(df.schema[top].dataType)
            out = out.withColumn(top, F.when(here, changed).otherwise(F.col(top)))
        for name, value in p.get("append_fields", {}).items():
            if df.schema[name].dataType.typeName() == "array":
                more = F.array(*map(F.lit, value if isinstance(value, list) else [value])).cast(df.schema[name].dataType)
                out = out.withColumn(name, F.when(here, F.concat(F.coalesce(name, F.array().cast(df.schema[name].dataType)), more)).otherwise(F.col(name)))
            else:
                out = out.withColumn(name, F.when(here, F.concat(F.coalesce(name, F.lit("")), F.lit(value))).otherwise(F.col(name)))
    return out


def checkpoint(df, ctx, folder=None, step=None, **_):
    folder = folder or ctx.project.get("checkpoints") or f"{ctx.project.get('cache_dir') or shared_folder(ctx.spark)}/checkpoints"
    return sinks.write_checkpoint(df, folder, ctx.project.get("name", ""), len(ctx.log) if step is None else step)


def export_step(df, ctx, path, format="jsonl", **more):  # noqa: A002
    sinks.export(df, path, format, **more)
    return df


def upload_database(df, ctx, table_name="papers", mode="skip", **_):
    """Upserts by cite_key into a table of the context (a JDBC or catalogue table)."""
    old = ctx.database.get(table_name)
    ctx.database[table_name] = df if old is None else table.upsert(old, df, ["cite_key"], mode)
    return df


REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "summary": reports.summary,
    "completeness": reports.completeness,
    "funnel": reports.screening_funnel,
    "funnel_by_source": lambda df: reports.screening_funnel(df.withColumn("source", F.col("discovery.source_database")), "source"),
    "decisions": lambda df: reports.tabulate(df, decision()),
    "paper_types": lambda df: reports.tabulate(df, F.col("paper_type")),
    "years": lambda df: reports.tabulate(df, F.col("year")),
    "citations": reports.citation_stats,
    "included": reports.included_by_iteration_year,
    "duplicates": lambda df: reports.duplicate_groups(df, "doi"),
}


def report(df, ctx, reports=("summary",), duplicates=False, **_):  # noqa: A002
    seen = df if duplicates is True else df.where(is_duplicate() if duplicates == "only" else ~is_duplicate())
    for r in reports:
        ctx.reports[r] = REPORTS[r](seen)
    return df


def echo(df, ctx, message="", **_):
    ctx.log.append(StepResult("echo", message=message))
    return df


def halt(df, ctx, message="", **_):
    raise Halt(message)


def run_template(df, ctx, template, **_):
    return run_steps(df, ctx, ctx.templates[template])


def with_responses(step):
    def go(df, ctx, **more):
        name = step.__name__
        return df if name not in ctx.responses else step(df, ctx.responses[name], **more)

    return go


def plain(step):
    return lambda df, ctx, **more: step(df, **more)


STEPS: dict[str, Callable[..., DataFrame]] = {
    "bibtex_import": bibtex_import,
    "camo_extraction": with_responses(screening.camo_extraction),
    "checkpoint": checkpoint,
    "citations": citations,
    "decision": plain(screening.decision_step),
    "deduplication": deduplication,
    "download_pdfs": download_pdfs,
    "echo": echo,
    "export": export_step,
    "fix_cite_keys": fix_cite_keys,
    "generate_embeddings": generate_embeddings,
    "halt": halt,
    "input": input_step,
    "journal_screening": journal_step,
    "keyword_screening": plain(screening.keyword_screening),
    "llm_classification": with_responses(screening.llm_classification),
    "load_files": load_files,
    "metadata_extraction": with_responses(screening.metadata_extraction),
    "metadata_screening": plain(screening.metadata_screening),
    "paper": paper,
    "patch": patch_step,
    "relevance_filter": plain(screening.relevance_filter),
    "relevance_scoring": with_responses(screening.relevance_scoring),
    "report": report,
    "retrieve_metadata": retrieve_metadata,
    "ris_import": ris_import,
    "rocchio_classifier": plain(screening.rocchio_classifier),
    "rocchio_screening": plain(screening.rocchio_screening),
    "run-template": run_template,
    "semantic_screening": plain(screening.semantic_screening),
    "upload_database": upload_database,
}


def parse_step(entry: Mapping[str, Any]) -> tuple[str, str, dict[str, Any], bool]:
    """(label, registered name, parameters, enabled) of a step entry."""
    names = [k for k in entry if k.startswith("builtin.")]
    if len(names) != 1:
        raise ValueError(f"a step needs one builtin: {dict(entry)}")
    name = names[0].removeprefix("builtin.")
    if name not in STEPS:
        raise ValueError(f"unknown step {name}")
    return entry.get("step", name), name, dict(entry[names[0]] or {}), entry.get("enabled", True)


def validate(definition: Mapping[str, Any]) -> list[str]:
    """What is wrong with a definition; empty if nothing."""
    wrong = [] if definition.get("project", {}).get("name") else ["project.name is missing"]
    known = {t.get("template") for t in definition.get("templates", [])}
    for entry in [*definition.get("steps", []), *(s for t in definition.get("templates", []) for s in t.get("steps", []))]:
        try:
            _, name, parameters, _ = parse_step(entry)
            if name == "run-template" and parameters.get("template") not in known:
                wrong.append(f"unknown template {parameters.get('template')}")
        except ValueError as e:
            wrong.append(str(e))
    return wrong


def run_steps(df: DataFrame, ctx: Context, steps: list, dry_run: bool = False) -> DataFrame:
    for entry in steps:
        label, name, parameters, enabled = parse_step(entry)
        if not enabled:
            ctx.log.append(StepResult(label, "skipped"))
            continue
        dry = parameters.pop("dry_run", dry_run)
        try:
            out = STEPS[name](df, ctx, **parameters)
        except Halt as e:
            ctx.log.append(StepResult(label, "halted", str(e)))
            raise
        ctx.log.append(StepResult(label))
        df = df if dry else out
    return df


def run(spark: SparkSession, definition: Mapping[str, Any] | str, ctx: Context | None = None, start: DataFrame | None = None, resume: bool = False) -> tuple[DataFrame, Context]:
    """Runs a definition (a mapping, or YAML text). With resume it goes on after the last
    checkpoint."""
    if isinstance(definition, str):
        import yaml

        definition = yaml.safe_load(definition)
    if wrong := validate(definition):
        raise ValueError("; ".join(wrong))
    ctx = ctx or Context(spark)
    ctx.project = dict(definition["project"])
    ctx.templates = {t["template"]: t["steps"] for t in definition.get("templates", [])}
    df = start if start is not None else spark.createDataFrame([], PAPER)
    steps = list(definition.get("steps", []))
    if resume and ctx.project.get("checkpoints"):
        found = sinks.latest_checkpoint(spark, ctx.project["checkpoints"], ctx.project["name"], len(steps))
        if found:
            done, df = found
            ctx.log += [StepResult(parse_step(s)[0], "skipped", "before the checkpoint") for s in steps[: done + 1]]
            steps = steps[done + 1 :]
    for entry in steps:
        try:
            df = run_steps(df, ctx, [entry])
        except Halt:
            break
    return df, ctx


def metrics(df: DataFrame) -> dict[str, int]:
    """Counts of a table by decision, in one aggregate."""
    row = df.agg(F.count("*").alias("papers"), reports.count_if(is_included()).alias("included"), reports.count_if(is_excluded()).alias("excluded"), reports.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates")).first()
    return row.asDict()
