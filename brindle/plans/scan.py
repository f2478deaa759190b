"""From source files to verdicts as one plan: frontend, patterns, evidence, score, decision, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import vocabulary as V
from brindle.operators import effects, patterns, scoring
from brindle.sources import frontend, lexical
from brindle.sources.storage import checkpointed


def scan(sources: DataFrame, strategy: str = "semantic-top8-v1", model: DataFrame | None = None, **limits) -> dict[str, DataFrame]:
    """analyses, events, paths, evidence, decisions and purposes of source rows (target_id, path, content)."""
    analyses = checkpointed(frontend.extract(sources, **limits))  # each text is parsed once
    events = frontend.events_of(analyses)
    exact = patterns.exact_paths(frontend.exact_of(analyses))
    paths = patterns.behavior_paths(events, exact)
    rows = scoring.evidence(events, paths, frontend.limited_of(analyses))
    return _decided(sources, analyses, events, paths, rows, scoring.rule_scores(rows, (strategy,)), model)


def scan_lexically(sources: DataFrame, **limits) -> dict[str, DataFrame]:
    """The same by the lexical frontend and its own profile, for texts that no parser takes."""
    analyses = checkpointed(lexical.extract(sources, **limits))
    events = frontend.events_of(analyses)
    paths = patterns.behavior_paths(events, unproven=V.LEXICAL_UNPROVEN)
    rows = checkpointed(scoring.evidence(events, paths, frontend.limited_of(analyses)))
    return _decided(sources, analyses, events, paths, rows, scoring.lexical_top8(rows), None) | {"summaries": effects.effect_summary(analyses, events, paths, lexical=True)}


def _decided(sources, analyses, events, paths, rows, scores, model) -> dict[str, DataFrame]:
    scores = sources.select("target_id").distinct().join(scores.select("target_id", "score"), "target_id", "left").select("target_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return {"analyses": analyses, "events": events, "paths": paths, "evidence": scoring.ranked_evidence(rows), "decisions": scoring.decide(scores, model), "purposes": effects.purpose_candidates(paths, events)}


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """(target_id, report): one JSON document per target; scores are rounded here only."""
    evidence = parts["evidence"].groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.round("score", 3).alias("score"), "name", "kind", "path", "line", "occurrences", "reason"))).alias("evidence"))
    files = parts["analyses"].groupBy("target_id").agg(F.count("*").alias("files"), F.sum("bytes_read").alias("bytes_read"), F.count("parse_error").alias("parse_errors"))
    j = parts["decisions"].join(evidence, "target_id", "left").join(files, "target_id", "left")
    fields = F.struct(F.lit("brindle.scan.v1").alias("schema"), "target_id", "verdict", F.round("risk_score", 3).alias("risk_score"), F.round("rule_score", 3).alias("rule_score"), F.round("probability", 6).alias("probability"), "model_used", "files", "bytes_read", "parse_errors", "evidence")
    return j.select("target_id", F.to_json(fields).alias("report"))


def scan_warnings(parts: dict[str, DataFrame], files: DataFrame | None = None) -> DataFrame:
    """(target_id, warning): what was left out and why; files are the rows of readers.plan_files with their target_id."""
    a = parts["analyses"]
    out = a.filter("parse_error is not null").select("target_id", F.concat(F.lit("parse error in "), "path", F.lit(": "), "parse_error").alias("warning"))
    out = out.unionByName(a.filter("event_limit_reached").select("target_id", F.concat(F.lit("event limit reached in "), "path").alias("warning")))
    if files is not None:
        what = F.when(F.col("state") == "oversized", F.concat(F.lit("oversized file skipped: "), "relative")).when(F.col("state") == "unreadable", F.concat(F.lit("cannot read "), "relative")).otherwise(F.col("state"))
        out = out.unionByName(files.filter("state <> 'taken'").select("target_id", what.alias("warning")))
    return out


def rendered(parts: dict[str, DataFrame]) -> DataFrame:
    """(target_id, text): a report to read, a line for the verdict and one for each kind of evidence."""
    line = F.format_string("  [%.1f] %s (%s) %s:%d x%d", "score", "name", "kind", "path", "line", "occurrences")
    evidence = parts["evidence"].groupBy("target_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.format_string("%s: %s, risk %.1f", "target_id", "verdict", "risk_score")
    j = parts["decisions"].join(evidence, "target_id", "left")
    return j.select("target_id", F.array_join(F.concat(F.array(head), F.coalesce("lines", F.array().cast("array<string>"))), "\n").alias("text"))
