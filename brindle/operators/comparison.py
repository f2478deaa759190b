"""Paired comparison of two systems on the same rows: alignment, effects, transitions, resampling, claim gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import statistics as S
from brindle.operators import evaluation as E
from brindle.sources.storage import checkpointed

METADATA = ("label", "split", "group_id", "period")
DIRECTION = {"recall": "higher", "false_positive_rate": "lower", "average_precision": "higher", "brier_score": "lower", "aurc": "lower", "model_invocation_rate": "lower", "mean_latency_ms": "lower", "median_latency_ms": "lower"}


def align(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Pairs (sample_id, metadata, b_*, c_*); raises when read if ids differ, repeat, or metadata do not match."""
    own = ("score", "model_invoked", "latency_ms")
    side = lambda d, p: d.groupBy("sample_id").agg(F.count("*").alias(f"{p}n"), *[F.first(c).alias(f"{p}{c}") for c in (*METADATA, *own)])
    j = side(baseline, "b_").join(side(candidate, "c_"), "sample_id", "full_outer")
    same = F.lit(True)
    for m in METADATA:
        same = same & F.col(f"b_{m}").eqNullSafe(F.col(f"c_{m}"))
    wrong = (
        F.when(F.col("b_n").isNull() | F.col("c_n").isNull(), F.concat(F.lit("sample_id sets differ: "), "sample_id"))
        .when((F.col("b_n") > 1) | (F.col("c_n") > 1), F.concat(F.lit("sample_id is not unique: "), "sample_id"))
        .when(~same, F.concat(F.lit("metadata differ for "), "sample_id"))
    )
    checked = j.withColumn("sample_id", F.when(wrong.isNull(), F.col("sample_id")).otherwise(F.raise_error(wrong)))
    return checked.select("sample_id", *[F.col(f"b_{m}").alias(m) for m in METADATA], *[f"{p}{c}" for p in ("b_", "c_") for c in own])


def mixed_groups(pairs: DataFrame) -> DataFrame:
    """Groups that cross labels or splits; a comparison needs none."""
    return pairs.groupBy("group_id").agg(F.count_distinct(F.struct("label", "split")).alias("identities")).filter("identities > 1")


def alignment_summary(pairs: DataFrame) -> DataFrame:
    g = pairs.groupBy("group_id", "split").agg(F.count("*").alias("n"))
    by = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"{s}_rows")
    return g.agg(F.sum("n").alias("rows"), by("train"), by("validation"), by("test"), F.count_distinct("group_id").alias("groups"), F.count_distinct(F.when(F.col("split") == "test", F.col("group_id"))).alias("test_groups"))


def systems(pairs: DataFrame) -> DataFrame:
    """Both systems' rows one under the other, with a system column."""
    side = lambda p, name: pairs.select("sample_id", *METADATA, F.col(f"{p}score").alias("score"), F.col(f"{p}model_invoked").alias("model_invoked"), F.col(f"{p}latency_ms").alias("latency_ms"), F.lit(name).alias("system"))
    return side("b_", "baseline").unionByName(side("c_", "candidate"))


def _values(table: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    m = E.at_threshold(table, thresholds, by).select(*by, "recall", "false_positive_rate", "rows")
    for part in (E.average_precision(table, by), E.calibration(table, by=by).select(*by, "brier_score"), E.selective(table, thresholds, by=by).select(*by, "aurc")):
        m = m.join(part, by)
    return m


def point_effects(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metric, baseline, candidate, delta, better, paired_rows; thresholds has system and threshold."""
    table = E.score_table(systems(pairs), ["system"])
    v = _values(table, thresholds, ["system"])
    names = ("recall", "false_positive_rate", "average_precision", "brier_score", "aurc")
    long = v.select("system", "rows", F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("metric", "value"))
    # gate and latency count only where both sides report
    both = pairs.agg(
        *[F.avg(F.when(F.col("b_model_invoked").isNotNull() & F.col("c_model_invoked").isNotNull(), F.col(f"{p}_model_invoked").cast("double"))).alias(f"{p}_rate") for p in "bc"],
        F.count_if(F.col("b_model_invoked").isNotNull() & F.col("c_model_invoked").isNotNull()).alias("gates"),
        *[f(F.when(F.col("b_latency_ms").isNotNull() & F.col("c_latency_ms").isNotNull(), F.col(f"{p}_latency_ms"))).alias(f"{p}_{n}") for p in "bc" for n, f in (("mean", F.avg), ("median", lambda c: F.percentile(c, F.lit(0.5))))],
        F.count_if(F.col("b_latency_ms").isNotNull() & F.col("c_latency_ms").isNotNull()).alias("latencies"),
    )
    extra = [F.struct(F.lit(s).alias("system"), F.col(rows).alias("rows"), F.lit(m).alias("metric"), F.col(f"{s[0]}_{c}").alias("value")) for s in ("baseline", "candidate") for m, c, rows in (("model_invocation_rate", "rate", "gates"), ("mean_latency_ms", "mean", "latencies"), ("median_latency_ms", "median", "latencies"))]
    long = long.unionByName(both.select(F.explode(F.array(*extra)).alias("x")).select("x.*").filter("value is not null"))
    wide = long.groupBy("metric").agg(F.max(F.when(F.col("system") == "baseline", F.col("value"))).alias("baseline"), F.max(F.when(F.col("system") == "candidate", F.col("value"))).alias("candidate"), F.max("rows").alias("paired_rows"))
    better = F.create_map(*[F.lit(x) for kv in DIRECTION.items() for x in kv])
    return wide.select("metric", "baseline", "candidate", (F.col("candidate") - F.col("baseline")).alias("delta"), better[F.col("metric")].alias("better"), "paired_rows")


BENIGN = {(False, False): "both_clear", (True, False): "candidate_fixed_false_alert", (False, True): "candidate_introduced_false_alert", (True, True): "both_alert"}
MALICIOUS = {(False, False): "both_missed", (False, True): "candidate_recovered_detection", (True, False): "candidate_lost_detection", (True, True): "both_detected"}


def transitions(pairs: DataFrame, baseline_threshold: DataFrame, candidate_threshold: DataFrame) -> DataFrame:
    """unit (rows, groups_any_alert), class, state, n; states that do not occur have 0."""
    d = pairs.crossJoin(F.broadcast(baseline_threshold.select(F.col("threshold").alias("bt")))).crossJoin(F.broadcast(candidate_threshold.select(F.col("threshold").alias("ct"))))
    d = d.select("group_id", "label", (F.col("b_score") >= F.col("bt")).alias("b"), (F.col("c_score") >= F.col("ct")).alias("c"))
    groups = d.groupBy("group_id").agg(F.max("label").alias("label"), F.bool_or("b").alias("b"), F.bool_or("c").alias("c"))
    seen = d.withColumn("unit", F.lit("rows")).groupBy("unit", "label", "b", "c").agg(F.count("*").alias("n")).unionByName(groups.withColumn("unit", F.lit("groups_any_alert")).groupBy("unit", "label", "b", "c").agg(F.count("*").alias("n")))
    cells = [(u, int(k == "malicious"), b, c, k, s) for u in ("rows", "groups_any_alert") for k, states in (("benign", BENIGN), ("malicious", MALICIOUS)) for (b, c), s in states.items()]
    all_cells = pairs.sparkSession.createDataFrame(cells, "unit string, label int, b boolean, c boolean, class string, state string")
    return all_cells.join(seen.withColumn("label", F.col("label").cast("int")), ["unit", "label", "b", "c"], "left").select("unit", "class", "state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def paired_bootstrap(pairs: DataFrame, thresholds: DataFrame, repetitions: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Intervals of candidate - baseline per metric; both systems share the drawn groups."""
    drawn = checkpointed(E.resampled(pairs, repetitions, seed, ("label", "b_score", "c_score")))  # read by every metric
    both = drawn.select("replicate", "label", "w", F.explode(F.create_map(F.lit("baseline"), F.col("b_score"), F.lit("candidate"), F.col("c_score"))).alias("system", "score"))
    by = ["replicate", "system"]
    table = E.score_table(both, by, F.col("w"))
    mixed = E.totals(table, by).filter("positives > 0 and positives < rows").select(*by)
    table = table.join(mixed, by)
    limits = mixed.join(F.broadcast(thresholds.select("system", "threshold")), "system").select(*by, "threshold")
    v = _values(table, limits, by)
    names = ["recall", "false_positive_rate", "average_precision", "brier_score", "aurc"]
    delta = v.groupBy("replicate").agg(*[(F.max(F.when(F.col("system") == "candidate", F.col(n))) - F.max(F.when(F.col("system") == "baseline", F.col(n)))).alias(n) for n in names])
    return E.interval(delta, names, confidence)


def claim_gate(intervals: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: status and supported, from the paired intervals and both systems' FPR evidence."""
    i = intervals.agg(F.max(F.when(F.col("metric") == "recall", F.col("lower"))).alias("recall_lower"), F.max(F.when(F.col("metric") == "false_positive_rate", F.col("upper"))).alias("fpr_upper"))
    e = evidence.agg(F.bool_and("target_supported").alias("target_supported"))
    j = i.crossJoin(F.broadcast(e))
    effect = (F.col("recall_lower") > 0) & (F.col("fpr_upper") <= 0)
    missing = F.col("recall_lower").isNull() | F.col("fpr_upper").isNull()
    status = F.when(missing, "not-assessed").when(~F.col("target_supported"), "underpowered-target-fpr").when(effect, "supported").otherwise("not-supported")
    return j.select(status.alias("status"), (status == "supported").alias("supported"), F.coalesce(effect, F.lit(False)).alias("paired_effect_supported"), "target_supported")


def compare(baseline: DataFrame, candidate: DataFrame, target_fpr: float = 0.001, repetitions: int = 200, seed: int = 0, confidence: float = 0.95) -> dict[str, DataFrame]:
    """All parts of a paired report; each system's bounds share the error rate, hence the narrower confidence of each."""
    pairs = checkpointed(align(baseline, candidate))  # every part reads it
    both = systems(pairs)
    each = 1.0 - (1.0 - confidence) / 2.0
    lock = E.once(E.select_threshold(E.score_table(both.filter("split = 'validation'"), ["system"]), target_fpr, ["system"]).select("system", "threshold"))
    test = pairs.filter("split = 'test'")
    evidence = E.fpr_evidence(both.filter("split = 'test'"), lock, target_fpr, each, ["system"])
    intervals = checkpointed(paired_bootstrap(test, lock, repetitions, seed, confidence))  # a row a metric, which the claim reads too
    own = lambda s: lock.filter(F.col("system") == s)
    return {
        "alignment": alignment_summary(pairs), "mixed_groups": mixed_groups(pairs), "thresholds": lock, "effects": point_effects(test, lock), "evidence": evidence,
        "transitions": transitions(test, own("baseline"), own("candidate")), "intervals": intervals, "claim": claim_gate(intervals, evidence),
    }
