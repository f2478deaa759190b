"""The commands of the engine as functions over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import vocabulary as V
from brindle.operators import comparison, evaluation, governance, micro_training, models, records, support
from brindle.plans import scan as scans
from brindle.sources import archives, frontend, sinks
from brindle.sources.storage import checkpointed

FAIL_ON = {"review": 25.0, "suspicious": 50.0, "high-risk": 75.0}


def scan(sources: DataFrame, fail_on: str | None = None, **options) -> DataFrame:
    """Decisions per target, with failed where the verdict is as grave as fail_on or graver."""
    d = scans.scan(sources, **options)["decisions"]
    return d.withColumn("failed", F.lit(False) if fail_on is None else F.col("risk_score") >= FAIL_ON[fail_on])


def extract(sources: DataFrame, **limits) -> DataFrame:
    return frontend.events_of(frontend.extract(sources, **limits))


def fit_sparse(examples: DataFrame, **options) -> DataFrame:
    return models.train(examples, **options)


def train_micro(examples: DataFrame, **options) -> DataFrame:
    """A checkpoint and an account of its training for each model key; see operators.micro_training."""
    return micro_training.train_micro(examples, **options)


def audit(rows: DataFrame, strict: bool = False) -> DataFrame:
    """The audit's row with failed: errors, or warnings too if strict."""
    a = governance.audit(rows)
    return a.withColumn("failed", (F.col("errors") > 0) | F.lit(strict) & (F.col("warnings") > 0))


def evaluate(rows: DataFrame, **options) -> DataFrame:
    return evaluation.report(rows, **options)


def compare(baseline: DataFrame, candidate: DataFrame, **options) -> dict[str, DataFrame]:
    return comparison.compare(baseline, candidate, **options)


def two_variants(sources: DataFrame, labels: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Prediction rows of both scan variants (flow on and off) for labelled targets (target_id, label, split, group_id), and audit rows.

    Audit rows name each target's rank in the preregistered order, which variant goes first on it, what was read, parse
    errors, exact paths and both scores.
    """
    runs = {name: scans.scan(sources, flow=flow) for name, flow in (("flow_off", False), ("flow_on", True))}
    both = None
    for name, parts in runs.items():
        d = parts["decisions"].select(F.col("target_id").alias("sample_id"), (F.col("risk_score") / 100.0).alias("score"), F.lit(name).alias("system"))
        both = d if both is None else both.unionByName(d)
    named = labels.select(F.col("target_id").alias("sample_id"), "label", "split", "group_id")
    on = runs["flow_on"]
    files = on["analyses"].groupBy(F.col("target_id").alias("sample_id")).agg(F.count("*").alias("python_files"), F.sum("bytes_read").alias("python_bytes"), F.count("parse_error").alias("parse_errors"), F.sum(F.size("exact")).alias("exact_paths"))
    score = lambda name, alias: runs[name]["decisions"].select(F.col("target_id").alias("sample_id"), F.col("risk_score").alias(alias))
    audits = records.scan_order(named, seed).join(files, "sample_id", "left").join(score("flow_off", "baseline_score"), "sample_id", "left").join(score("flow_on", "candidate_score"), "sample_id", "left")
    audits = audits.withColumn("status", F.when(F.col("python_files").isNull(), "empty").otherwise("ok"))
    return both.join(named, "sample_id"), audits


def artifact_rows(found: DataFrame, limits: archives.Limits = archives.Limits()) -> DataFrame:
    """One row per archive (path, content): its digest, the content hash and the levelled hash of its sources, counts of events and paths, and status."""
    files = checkpointed(archives.expand(found, limits))
    read = files.filter("error is null")
    analyses = checkpointed(frontend.extract(read))
    counts = analyses.groupBy("target_id").agg(F.sum(F.size("events")).alias("events"), F.sum(F.size("exact")).alias("exact_paths"), F.count("parse_error").alias("parse_errors"))
    return archives.fingerprints(found, files).join(frontend.normalised_hash(read), "target_id", "left").join(counts, "target_id", "left")


def pilot(sources: DataFrame, labels: DataFrame, seed: int = 0, target_fpr: float = 0.01, repetitions: int = 2000) -> dict[str, DataFrame]:
    """A study from sources to its record: order, two variants, paired comparison, claim and account."""
    rows, audits = two_variants(sources, labels, seed)
    rows, audits = checkpointed(rows), checkpointed(audits)
    problems = records.study_problems(rows.filter("system = 'flow_on'"))
    more = [F.lit(None).cast("string").alias("period"), F.lit(None).cast("boolean").alias("model_invoked"), F.lit(None).cast("double").alias("latency_ms")]
    side = lambda name: rows.filter(F.col("system") == name).select("sample_id", "label", "score", "split", "group_id", *more)
    parts = comparison.compare(side("flow_off"), side("flow_on"), target_fpr, repetitions, seed)
    claim = checkpointed(parts["claim"])
    outputs = audits.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.sha2(F.concat_ws("|", "sample_id", "status"), 256)))), 256).alias("sha256")).select(F.lit("audits").alias("path"), "sha256")
    record = records.study_record(side("flow_on"), audits, "pilot", {"seed": seed, "target_fpr": target_fpr, "repetitions": repetitions}, claim.first().status, outputs)
    return parts | {"claim": claim, "audits": audits, "problems": problems, "record": record}


def train_and_export(examples: DataFrame, path: str, dimensions: int = 1 << 16, epochs: int = 5) -> dict[str, DataFrame]:
    """Fits a sparse model to training rows (sample_id, group_id, tokens, label, split, pair_id, variant), saves it, and reports on validation.

    Returns weights, the support profile (known, prototypes), pair metrics and variant drift of all rows, and quality on validation.
    """
    examples = governance.require_isolated(examples.withColumn("representation_hash", F.sha2(F.array_join("tokens", "\x01"), 256)))
    ordered = examples.filter("split = 'train'").select(F.lit("sparse").alias("system"), F.col("sample_id").alias("ord"), "tokens", "label")
    weights = checkpointed(models.train(ordered, epochs, dimensions=dimensions))
    bias = weights.filter("index = -1").first().weight
    own = weights.filter("index >= 0").select("index", "weight")
    sinks.save_weights(weights.select("index", "weight"), path, dimensions)
    scored = checkpointed(models.predict(examples, own, bias, dimensions).join(examples, "sample_id").withColumn("score", F.col("probability")))
    known, prototypes = support.profile(examples.filter("split = 'train'").withColumn("ord", F.col("sample_id")))
    return {
        "weights": weights, "known": known, "prototypes": prototypes, "pairs": support.pair_metrics(scored), "drift": support.variant_drift(scored),
        "validation": evaluation.micro_metrics(scored.filter("split = 'validation'")),
    }


def verify_lock(lock: DataFrame, observed: DataFrame) -> DataFrame:
    """(name, problem) where a study's inputs are not those it was locked with: configuration, code and input digests as (name, sha256)."""
    j = lock.select("name", F.col("sha256").alias("_a")).join(observed.select("name", F.col("sha256").alias("_b")), "name", "full_outer")
    problem = F.when(F.col("_b").isNull(), "is missing").when(F.col("_a").isNull(), "was not locked").when(F.col("_a") != F.col("_b"), "has changed")
    return j.select("name", problem.alias("problem")).filter("problem is not null")


def verified(rows: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """rows, which raise when read where a fingerprint column differs from the expected table (sample_id, columns)."""
    e = expected.select("sample_id", F.struct(*columns).alias("_e"))
    j = rows.join(e, "sample_id", "left")
    same = F.struct(*columns).eqNullSafe(F.col("_e"))
    return j.filter(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("fingerprints differ: "), "sample_id")).cast("boolean"))).drop("_e")


def sealed(rows: DataFrame, allowed: tuple[str, ...] = V.SPLITS[:2]) -> DataFrame:
    """rows, which raise when read if any is of a split that may not be seen yet."""
    return rows.filter(F.when(F.col("split").isin(*allowed), True).otherwise(F.raise_error(F.concat(F.lit("sealed split: "), F.coalesce("split", F.lit("null")))).cast("boolean")))
