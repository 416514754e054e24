"""Screening steps: pure functions of the paper table, each idempotent by its own
eligibility rule."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.identifiers import iso4
from ..functions.text import collapse, matches_keyword, substantive
from ..schema import decide, decision, is_excluded, is_included, is_primary, set_screening, undecided

# What tells study types.
EDITORIAL = ["editorial", "news", "commentary", "letter", "correction", "erratum"]
REVIEW_TITLES = ["systematic literature review", "systematic review", "literature review"]
REVIEW = ["systematic review", "systematic literature review", "literature review", "scoping review", "scopus", "web of science", "bibliometric analysis", "narrative review", "meta-analysis", "metaanalysis", "meta analysis", "state of the art", "bibliometric"]
CONCEPTUAL = ["conceptual", "theoretical", "theory", "framework", "taxonomy", "typology", "opinion", "perspective", "model"]
QUANTITATIVE = [
    r"\bn\s*=\s*\d+", r"survey.*\d+.*participants?", r"statistical analysis", r"regression|correlation|anova|t[- ]?test|chi[- ]?square", r"questionnaire|measurement|hypothesis", r"significant.*p\s*[<>]|p\s*[<>]\s*0\.", r"quantitative|quantitatively", r"survey", r"numerical",
    r"sample size|sample", r"participants?|subjects?|respondents?", r"data from[\s\S]*?(?:firm|company|provider|organization|source)", r"significant[\s\S]*?(?:impact|effect|relationship)", r"sensitivity (?:test|analysis)", r"heterogeneity analysis",
    r"sample[\s\S]*?(?:\d+|firms?|companies?|organizations?|pairs?)", r"empirical data|empirical (?:evidence|findings)", r"results (?:imply|show|indicate|suggest|reveal)", r"analyze[\s\S]{0,100}?(?:data|firms?|companies?|organizations?)",
    r"(?:\d+)\s+(?:firms?|companies?|organizations?|respondents?|participants?|subjects?)", r"affects?[\s\S]{0,100}?(?:volume|quality|performance|outcome)", r"configuration.*affects?|affects?.*configuration",
]
QUALITATIVE = [
    r"interview[s]?.*(?:participant|expert|user|developer)", r"interviews?", r"survey.*\d+.*participants?|survey of", r"ethnograph", r"grounded theory", r"thematic analysis", r"content analysis", r"observational study|observation", r"field work|fieldwork", r"focus group",
    r"phenomenological", r"qualitative|qualitatively", r"in-depth|in depth", r"semi-structured|unstructured", r"evaluate[\s\S]*?(?:with|of|for)[\s\S]*?(?:\d+|organization|company|firm|provider|practitioner)", r"assess(?:ed|ment|ments?)[\s\S]*?(?:organization|company|firm|provider|case)",
    r"(?:study|research)[\s\S]*?(?:investigated|examined|analyzed|explored)", r"examines[\s\S]*?(?:case|firm|company|scenario)",
]
CASE = [
    r"case study|case studies|case-study|case[- ]based", r"multiple[- ]case|single[- ]case|comparative[- ]case",
    r"study of (?:two|three|four|five|six|seven|eight|nine|ten|\d+)[\s\S]*?(?:cases?|firms?|companies?|organizations?|relationships?)",
]
METHOD = [
    r"data collection|data gathered|data were collected", r"empirical study|empirical investigation", r"experimental design|experiment", r"quasi-experimental", r"study design", r"methodology|methods", r"longitudinal|cross-sectional", r"validation|evaluated",
    r"structural model|path model|SEM|sem|m-TISM|TISM", r"modeling approach|model evaluation|model development", r"text mining|data mining|machine learning|computational", r"validated (?:by|using|with) real|real (?:data|information)", r"evolutionary (?:algorithm|heuristic)", r"process view|process approach|process model",
]


def hits(text: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns the text has."""
    return reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in patterns))


def has_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def study_scores(text: Column) -> dict[str, Column]:
    return {"quantitative": hits(text, QUANTITATIVE), "qualitative": hits(text, QUALITATIVE), "case": hits(text, CASE), "method": hits(text, METHOD)}


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def study_type(title: Column, abstract: Column, keywords: Column) -> Column:
    """Review phrases are looked up in the title as it is written, all else in lower case."""
    title, abstract = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    parts = F.filter(F.array(title, abstract, F.coalesce(F.array_join(keywords, " "), F.lit(""))), lambda x: x != "")
    scored = let(F.lower(F.array_join(parts, " ")), lambda x: F.struct(x.alias("text"), *(c.alias(n) for n, c in study_scores(x).items())))

    def kind(s: Column) -> Column:
        total = s["quantitative"] + s["qualitative"] + s["case"] + s["method"]
        empirical = F.when(s["case"] > 0, "case_study").when(s["qualitative"] > s["quantitative"], "empirical_qualitative").otherwise("empirical_quantitative")
        return (
            F.when(has_any(s["text"], EDITORIAL), "editorial")
            .when(has_any(s["text"], REVIEW) & (total <= 2), "literature_review")
            .when((s["case"] > 0) | (total >= 2), empirical)
            .when(total > 0, "unknown")
            .when(has_any(s["text"], CONCEPTUAL), "conceptual")
            .otherwise("unknown")
        )

    early = F.when(has_any(title, REVIEW_TITLES) | abstract.contains("bibliometric") | title.contains("bibliometric"), "literature_review").when(F.size(parts) == 0, "unknown")
    return F.coalesce(early, let(scored, kind))


def inclusion_score(text: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """0.7 of the share of groups with a match, and 0.3 of matches over all keywords."""
    if not groups:
        return F.lit(0.0)
    found = {g: reduce(lambda a, b: a + b, (matches_keyword(text, k).cast("int") for k in words)) for g, words in groups.items()}
    covered = reduce(lambda a, b: a + b, ((n > 0).cast("int") for n in found.values()))
    total = reduce(lambda a, b: a + b, found.values())
    size = sum(len(w) for w in groups.values())
    return F.round(0.7 * covered / len(groups) + 0.3 * F.least(total / size, F.lit(1.0)), 6)


def matched(text: Column, words: Sequence[str]) -> Column:
    if not words:
        return F.array().cast("array<string>")
    return F.filter(F.array(*(F.when(matches_keyword(text, k), F.lit(k)) for k in words)), lambda x: x.isNotNull())


def flat(keywords: Mapping[str, Sequence[str] | str] | Sequence[str]) -> list[str]:
    if isinstance(keywords, Mapping):
        return [k for v in keywords.values() for k in ([v] if isinstance(v, str) else v)]
    return list(keywords)


def keyword_screening(df: DataFrame, include: Mapping | None = None, exclude: Mapping | None = None, mode: str = "inclusion_required", complete: str = "strict") -> DataFrame:
    include, exclude = include or {}, exclude or {}
    groups = include.get("keywords", {})
    limits = {"auto_accept": 0.7, "manual_review": 0.4} | include.get("thresholds", {})
    no_title = F.coalesce(F.trim("title") == "", F.lit(True))
    no_abstract = F.coalesce(F.trim("abstract") == "", F.lit(True)) | (F.upper(F.trim("abstract")) == "N/A")
    thin = ~substantive(F.col("abstract"))
    no_keywords = ~F.coalesce(F.exists("keywords", lambda k: F.trim(k) != ""), F.lit(False)) if complete == "strict" else F.lit(False)
    missing = F.concat_ws(", ", F.when(no_title, "title"), F.when(no_abstract, "abstract").when(thin, "abstract (boilerplate)"), F.when(no_keywords, "keywords"))
    text = F.concat_ws(" ", F.trim("title"), F.trim("abstract"), F.array_join("keywords", " "))
    kind = study_type(F.trim("title"), F.trim("abstract"), F.col("keywords"))
    score, bad = inclusion_score(text, groups), matched(text, flat(exclude.get("keywords", {})))
    verdict = F.when(missing != "", "excluded_incomplete").when(kind.isin(list(exclude.get("study_types", []))), "excluded")
    if mode == "soft":
        verdict = verdict.otherwise("pending")
    elif mode == "inclusion_required":
        # exclusion keywords only count if there are no inclusion keywords
        none = (score == 0) | (F.size(bad) > 0) if not groups else score == 0
        verdict = verdict.when(none, "excluded").when(score > limits["auto_accept"], "included").when(score > limits["manual_review"], "manual_review").otherwise("excluded")
    else:
        verdict = verdict.when(F.size(bad) > 0, "excluded").otherwise("uncertain")
    why = F.when(missing != "", F.concat(F.lit("incomplete metadata: missing '"), missing, F.lit("'"))).when(kind.isin(list(exclude.get("study_types", []))), F.concat(F.lit("study_type: '"), kind, F.lit("' is excluded")))
    out = df.withColumn("_go", is_primary() & undecided() & F.col("screening.keyword_screening").isNull()).withColumn("_verdict", verdict)
    result = F.struct(
        F.col("_verdict").isin("included", "pending", "uncertain").alias("passed"), F.col("_verdict").alias("decision"), F.when(missing != "", "unknown").otherwise(kind).alias("study_type"), score.alias("score"),
        matched(text, flat(groups)).alias("inclusion_keywords"), bad.alias("exclusion_keywords"), why.alias("reason"),
    )
    result = F.when(F.col("_go"), result).otherwise(F.col("screening.keyword_screening"))
    return decide(out, F.col("_go") & (decision() == "pending"), F.col("_verdict"), "keyword_screening", keyword_screening=result).drop("_go", "_verdict")


def not_predicate(value: str | Mapping[str, str]) -> str | None:
    """The value of {"NOT": v} or "NOT: v"."""
    if isinstance(value, Mapping):
        return value.get("NOT")
    m = re.fullmatch(r"NOT:\s*(.+)", value)
    return m[1] if m else None


def metadata_reason(rules: Mapping[str, object], columns: Mapping[str, str] | None = None) -> Column:
    """The first failing rule in the order given, or null; of one field's, values to exclude
    come before the one to keep. Values match as substrings in any case; a missing value
    passes, but for doi_not_set, and a missing language is English. quality_tier counts only
    if ``columns`` names its column."""
    columns = {"language": "language", "paper_types": "paper_type", "doi": "doi"} | dict(columns or {})
    reasons = []
    for field, values in rules.items():
        if field == "doi_not_set":
            reasons.append(F.when(F.lit(bool(values)) & F.coalesce(F.trim(columns["doi"]) == "", F.lit(True)), F.lit("doi_not_set")))
        elif field in ("language", "paper_types", "quality_tier") and field in columns:
            x = F.col(columns[field])
            x = F.when(F.coalesce(x, F.lit("")) == "", "en").otherwise(x) if field == "language" else F.when(x != "", x)
            values = values if isinstance(values, list) else [values]
            for v in sorted(values, key=lambda v: not_predicate(v) is not None):
                wanted = not_predicate(v)
                bad = ~F.contains(F.lower(x), F.lit(wanted.lower())) if wanted else F.contains(F.lower(x), F.lit(str(v).lower()))
                reasons.append(F.when(x.isNotNull() & bad, F.concat(F.lit(f"{field}: "), x)))
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def metadata_screening(df: DataFrame, exclude: Mapping[str, object]) -> DataFrame:
    go = is_primary() & undecided() & F.col("screening.metadata_screening").isNull()
    out = df.withColumn("_go", go).withColumn("_why", metadata_reason(exclude))
    result = F.when(F.col("_go"), F.struct(F.col("_why").isNull().alias("passed"), F.col("_why").alias("reason"))).otherwise(F.col("screening.metadata_screening"))
    fail = F.when(F.col("_why").isNotNull(), "excluded")
    return decide(out, F.col("_go") & decision().isin("pending", "uncertain"), fail, "metadata_screening", metadata_screening=result).drop("_go", "_why")


def journal_screening(df: DataFrame, definitions: DataFrame) -> DataFrame:
    """Acronym and short title by name, else a generated short title. definitions: name,
    acronym, iso4."""
    known = definitions.select(F.lower(collapse(F.col("name"))).alias("_name"), F.col("acronym").alias("_acronym"), F.col("iso4").alias("_iso4")).dropDuplicates(["_name"])
    out = df.withColumn("_name", F.lower(collapse(F.col("journal")))).join(known, "_name", "left")
    short = F.coalesce("_iso4", iso4(F.col("journal")))
    out = out.withColumn("journal_acronym", F.when(is_primary(), F.coalesce("_acronym", "journal_acronym")).otherwise(F.col("journal_acronym")))
    out = out.withColumn("journal_iso4", F.when(is_primary(), F.coalesce(short, "journal_iso4")).otherwise(F.col("journal_iso4")))
    result = F.when(is_primary(), F.struct((F.coalesce(F.trim("journal"), F.lit("")) != "").alias("passed"), F.col("journal_acronym").alias("acronym"), F.col("journal_iso4").alias("iso4"))).otherwise(F.col("screening.journal_screening"))
    return set_screening(out, journal_screening=result).select(*df.columns)


def semantic_decision(score: Column, include: float = 0.65, review: float = 0.55) -> Column:
    return F.when(score >= include, "included").when(score >= review, "manual_review").otherwise("excluded")


def semantic_screening(df: DataFrame, question: Sequence[float], include: float = 0.65, review: float = 0.55) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in question))
    go = is_primary() & undecided() & F.col("screening.semantic_screening").isNull() & F.col("title_abstract_embedding").isNotNull()
    out = df.withColumn("_go", go).withColumn("_score", vectors.cosine_clamped(F.col("title_abstract_embedding"), q))
    verdict = semantic_decision(F.col("_score"), include, review)
    result = F.when(F.col("_go"), F.struct(verdict.alias("decision"), F.col("_score").alias("score"), F.lit(None).cast("string").alias("dominant"))).otherwise(F.col("screening.semantic_screening"))
    return decide(out, F.col("_go") & decision().isin("pending", "uncertain"), verdict, "semantic_screening", semantic_screening=result).drop("_go", "_score")


def rocchio_query(question: Column, accepted: Column, rejected: Column, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15) -> Column:
    """alpha q + beta mean(accepted) - gamma mean(rejected); an absent mean counts as 0."""
    zero = F.transform(question, lambda x: F.lit(0.0))
    both = F.zip_with(question, F.coalesce(accepted, zero), lambda q, a: alpha * q.cast("double") + beta * a)
    return F.zip_with(both, F.coalesce(rejected, zero), lambda x, r: x - gamma * r)


def rocchio_screening(df: DataFrame, question: Sequence[float], accept: float = 0.7, reject: float = 0.3, **weights: float) -> DataFrame:
    """The means come from the keyword step's decisions; a row of one query vector joins
    every paper."""
    vector = F.col("title_abstract_embedding")
    seen = F.col("screening.keyword_screening.decision")
    judged = df.where(vector.isNotNull()).withColumn("_side", F.when(seen.startswith("included"), "a").when(seen.startswith("excluded"), "r")).where("_side is not null")
    means = vectors.mean_vectors(judged, "title_abstract_embedding", "_side").groupBy().agg(F.max(F.when(F.col("_side") == "a", F.col("mean_vector"))).alias("a"), F.max(F.when(F.col("_side") == "r", F.col("mean_vector"))).alias("r"))
    q = means.select(rocchio_query(F.array(*(F.lit(float(x)) for x in question)), F.col("a"), F.col("r"), **weights).alias("_q"))
    out = df.crossJoin(F.broadcast(q))  # one row
    go = is_primary() & F.col("screening.semantic_screening").isNull() & decision().isin("uncertain", "pending", "manual_review") & vector.isNotNull()
    out = out.withColumn("_go", go).withColumn("_score", vectors.cosine_unit(vector, F.col("_q")))
    verdict = F.when(F.col("_score") >= accept, "included").when(F.col("_score") <= reject, "excluded").otherwise("manual_review")
    result = F.when(F.col("_go"), F.struct(verdict.alias("decision"), F.col("_score").alias("score"), F.lit(None).cast("string").alias("dominant"))).otherwise(F.col("screening.semantic_screening"))
    return decide(out, F.col("_go"), verdict, "rocchio_screening", semantic_screening=result).drop("_go", "_score", "_q")


def rocchio_classifier(df: DataFrame, dimensions: Mapping[str, Sequence[float]], threshold: float = 0.5) -> DataFrame:
    """Cosine with each named dimension: none applies excluded, one included, more manual."""
    vector = F.col("title_abstract_embedding")
    each = F.array(*(F.struct(vectors.cosine(vector, F.array(*(F.lit(float(x)) for x in v))).alias("s"), F.lit(name).alias("d")) for name, v in dimensions.items()))
    go = is_primary() & ~decision().isin("included", "excluded") & vector.isNotNull()
    out = df.withColumn("_go", go).withColumn("_each", each)
    n = F.size(F.filter("_each", lambda x: x["s"] >= threshold))
    best = F.reduce("_each", F.get("_each", F.lit(0)), lambda a, x: F.when(x["s"] > a["s"], x).otherwise(a))
    verdict = F.when(n == 0, "excluded").when(n == 1, "included").otherwise("manual_review")
    result = F.when(F.col("_go"), F.struct(verdict.alias("decision"), best["s"].alias("score"), best["d"].alias("dominant"))).otherwise(F.col("screening.semantic_screening"))
    return decide(out, F.col("_go") & decision().isin("pending", "uncertain"), verdict, "rocchio_classifier", semantic_screening=result).drop("_go", "_each")


def snap(x: Column) -> Column:
    """A model's dominance as 0, 0.5 or 1."""
    return F.when(x < 0.25, 0.0).when(x < 0.75, 0.5).otherwise(1.0)


def llm_classification(df: DataFrame, responses: DataFrame) -> DataFrame:
    """responses: id, label, scores (array of dominance per dimension), error."""
    out = df.join(responses.select("id", F.col("label").alias("_label"), F.col("scores").alias("_scores"), F.col("error").alias("_error")), "id", "left")
    mean = F.aggregate(F.transform("_scores", lambda x: snap(x)), F.lit(0.0), lambda s, x: s + x) / F.size("_scores")
    go = is_primary() & ~decision().isin("included", "excluded") & (F.col("_error").isNotNull() | F.col("_label").isNotNull() | F.col("_scores").isNotNull())
    verdict = F.when(F.col("_error").isNotNull(), "manual_review").when((F.col("_label") == "include") | (mean >= 0.75), "included").when((F.col("_label") == "exclude") | (mean < 0.55), "excluded").otherwise("manual_review")
    return decide(out, go, verdict, "llm_classification").select(*df.columns)


def relevance_scoring(df: DataFrame, responses: DataFrame) -> DataFrame:
    """responses: id, payload (text with a JSON object of relevance, confidence and
    justification); scores outside 0..1 are errors and leave the row unscored."""
    from ..functions.text import extract_json

    kind = "relevance double, confidence double, justification string"
    out = df.join(responses.select("id", F.from_json(extract_json(F.col("payload")), kind).alias("_r")), "id", "left")
    good = F.col("_r.relevance").between(0, 1) & F.col("_r.confidence").between(0, 1)
    go = ~is_excluded() & F.col("screening.relevance_scoring").isNull() & good
    return set_screening(out, relevance_scoring=F.when(go, F.col("_r")).otherwise(F.col("screening.relevance_scoring"))).select(*df.columns)


def relevance_fails(relevance: Column, confidence: Column, low: float = 0.5, sure: float = 0.7, require_both: bool = True) -> Column:
    fine = (relevance >= low) & (confidence >= sure) if require_both else (relevance >= low) | (confidence >= sure)
    return ~fine


def relevance_filter(df: DataFrame, relevance: float = 0.5, confidence: float = 0.7, require_both: bool = True, action: str = "exclude") -> DataFrame:
    r = F.col("screening.relevance_scoring")
    fails = F.coalesce(relevance_fails(r["relevance"], r["confidence"], relevance, confidence, require_both), F.lit(False)) & ~is_excluded()
    return decide(df, fails, F.lit("excluded" if action == "exclude" else "manual_review"), "relevance_filter")


def comparison(x: Column, rule: object) -> Column:
    """">= 0.6", "== true" or a plain value as a condition; null if x is missing."""
    m = re.fullmatch(r"\s*(>=|<=|==|!=|>|<)\s*(.+?)\s*", rule) if isinstance(rule, str) else None
    op, raw = (m[1], m[2]) if m else ("==", rule)
    value = {"true": True, "false": False}.get(str(raw).lower())
    value = F.lit(value if value is not None else float(raw))
    x = x if isinstance(raw, bool) or str(raw).lower() in ("true", "false") else x.cast("double")
    return {">=": x >= value, "<=": x <= value, "==": x == value, "!=": x != value, ">": x > value, "<": x < value}[op]


def rule_decision(include_when: Mapping[str, object], exclude_when: Mapping[str, object], otherwise: str | None, field=F.col) -> Column:
    """include_when in order: the first false field ends it as false, the first missing one
    leaves the row as it is; then exclude_when (missing ones don't count); then otherwise."""
    verdict: Column = F.lit("yes") if include_when else F.lit("no")
    for name, rule in reversed(list(include_when.items())):
        c = comparison(field(name), rule)
        verdict = F.when(c.isNull(), "missing").when(~c, "no").otherwise(verdict)
    out = reduce(lambda a, b: a & b, (F.coalesce(comparison(field(n), r), F.lit(True)) for n, r in exclude_when.items())) if exclude_when else F.lit(False)
    some = reduce(lambda a, b: a | b, (field(n).isNotNull() for n in exclude_when)) if exclude_when else F.lit(False)
    return F.when(verdict == "missing", F.lit(None).cast("string")).when(verdict == "yes", "included").when(out & some, "excluded").otherwise(F.lit(otherwise).cast("string"))


# Names that decision rules use for the recorded results of earlier steps.
RULE_FIELDS = {"relevance": "screening.relevance_scoring.relevance", "confidence": "screening.relevance_scoring.confidence", "keyword_passed": "screening.keyword_screening.passed", "metadata_passed": "screening.metadata_screening.passed", "semantic_score": "screening.semantic_screening.score"}


def decision_step(df: DataFrame, include_when: Mapping[str, object] | None = None, exclude_when: Mapping[str, object] | None = None, otherwise: str | None = "manual_review") -> DataFrame:
    verdict = rule_decision(include_when or {}, exclude_when or {}, otherwise, lambda n: F.col(RULE_FIELDS.get(n, n)))
    return decide(df, is_primary() & decision().isin("pending", "uncertain") & ~is_excluded(), verdict, "decision")


def metadata_extraction(df: DataFrame, responses: DataFrame, overwrite: bool = False) -> DataFrame:
    """responses: id, research_method, keywords, journal: filled in where missing."""
    from .table import coalesce_join

    columns = [c for c in ("research_method", "keywords", "journal") if c in responses.columns]
    return coalesce_join(df, responses, "id", columns, overwrite)


def camo_extraction(df: DataFrame, responses: DataFrame) -> DataFrame:
    """responses: id, payload with a JSON list of statements; all four parts are required,
    the confidence is clamped to 0..1 and 0.5 by default."""
    kind = "array<struct<context: string, action: string, mechanism: string, outcome: string, confidence: double>>"
    found = F.from_json(F.regexp_extract("payload", r"(?s)(\[.*\])", 1), kind)
    whole = F.filter(found, lambda s: reduce(lambda a, b: a & b, (F.coalesce(F.trim(s[p]) != "", F.lit(False)) for p in ("context", "action", "mechanism", "outcome"))))
    clamped = F.transform(whole, lambda s: s.withField("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(s["confidence"], F.lit(0.5))))))
    out = df.join(responses.select("id", clamped.alias("_camo")), "id", "left")
    return out.withColumn("camo", F.when(is_included() & F.coalesce(F.size("camo") <= 0, F.lit(True)), F.col("_camo")).otherwise(F.col("camo"))).select(*df.columns)
