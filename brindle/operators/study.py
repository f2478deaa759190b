"""Operating points of a study: group maxima, development thresholds, fixed thresholds, holdout decisions, timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import statistics as S
from brindle.operators import evaluation as E


def group_maxima(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by, "group_id").agg(F.max("label").alias("label"), F.max("score").alias("score"))


def development_point(rows: DataFrame, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Just above the highest benign group: the threshold, and the share of malicious groups that reach it."""
    g = group_maxima(rows, by)
    t = g.groupBy(*by).agg(S.next_up(F.max(F.when(F.col("label") == 0, F.col("score")))).alias("threshold"))
    d = E.keyed(g, t, by)
    bad = F.count_if(F.expr("label = 1"))
    hit = F.count_if((F.col("label") == 1) & (F.col("score") >= F.col("threshold")))
    return d.groupBy(*by, "threshold").agg(F.count_if(F.expr("label = 0")).alias("benign_groups"), bad.alias("malicious_groups"), hit.alias("detected_groups"), S.ratio(hit, bad).alias("recall"))


def valid_points(points: DataFrame, highest: float = 100.0, least_recall: float = 0.20) -> DataFrame:
    return points.withColumn("valid", F.col("threshold") <= highest).withColumn("eligible", (F.col("threshold") <= highest) & (F.col("recall") >= least_recall))


def hard_negatives(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k benign groups that score highest."""
    return group_maxima(rows).filter("label = 0").orderBy(F.desc("score"), "group_id").limit(k)


def operating_points(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Metrics at fixed thresholds; a few thresholds meet the distinct scores, not the rows."""
    t = rows.sparkSession.createDataFrame([(float(x), i) for i, x in enumerate(thresholds)], "threshold double, _k int")
    table = E.score_table(rows).crossJoin(F.broadcast(t))
    d = table.groupBy("threshold").agg(
        F.sum("n").alias("rows"), F.sum("tp").alias("positives"), F.sum(F.col("n") - F.col("tp")).alias("benign"),
        F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("tp")).otherwise(0)).alias("true_positive"), F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("n") - F.col("tp")).otherwise(0)).alias("false_positive"),
    )
    return E._rates(d, [])


def holdout_report(pairs: DataFrame, baseline: float, candidate: float, least_groups: int = 450, confidence: float = 0.975, limit: float = 0.01) -> DataFrame:
    """One row per system and one row of both: alerts of benign groups, exact upper bounds, and whether the candidate passes.

    pairs have group_id, b_score and c_score. A group alerts where any of its rows does.
    """
    g = pairs.groupBy("group_id").agg(F.max("b_score").alias("b"), F.max("c_score").alias("c"))
    b, c = F.col("b") >= baseline, F.col("c") >= candidate
    r = g.agg(F.count("*").alias("n"), F.count_if(b).alias("kb"), F.count_if(c).alias("kc"), F.count_if(b & ~c).alias("only_b"), F.count_if(~b & c).alias("only_c"), F.count_if(b & c).alias("both"), F.max("b").alias("mb"), F.max("c").alias("mc")).first()
    upper = lambda k: S.clopper_pearson_upper(k, r.n, confidence) if r.n else 1.0
    passed = r.n >= least_groups and r.kc == 0 and upper(r.kc) < limit
    none = r.n - r.only_b - r.only_c - r.both
    rows = [("baseline", baseline, r.kb, r.n, upper(r.kb), r.mb, None), ("candidate", candidate, r.kc, r.n, upper(r.kc), r.mc, passed)]
    counts = [(r.only_b, r.only_c, r.both, none)] * 2
    schema = "system string, threshold double, alert_groups long, `groups` long, fpr_upper_bound double, maximum_score double, passed boolean, baseline_only long, candidate_only long, both long, neither long"
    return pairs.sparkSession.createDataFrame([(*a, *c) for a, c in zip(rows, counts)], schema)


def holdout_decision(rows: DataFrame, threshold: float, least_groups: int = 450, confidence: float = 0.975, limit: float = 0.01) -> dict:
    """Whether benign holdout groups pass: enough of them, no alert, and an exact upper bound under the limit."""
    r = group_maxima(rows).filter("label = 0").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= threshold).alias("k")).first()
    upper = S.clopper_pearson_upper(r.k, r.n, confidence) if r.n else 1.0
    return {"groups": r.n, "alerts": r.k, "upper": upper, "passed": r.n >= least_groups and r.k == 0 and upper < limit}


def group_changes(pairs: DataFrame, baseline: float, candidate: float) -> dict:
    """Groups whose any-alert error changed between two systems, and the exact symmetry p of the change."""
    g = pairs.groupBy("group_id").agg(F.max("label").alias("y"), F.max("b_score").alias("b"), F.max("c_score").alias("c"))
    be, ce = (F.col("b") >= baseline) != (F.col("y") == 1), (F.col("c") >= candidate) != (F.col("y") == 1)
    r = g.agg(F.count_if(be & ~ce).alias("improved"), F.count_if(~be & ce).alias("regressed")).first()
    return {"improved": r.improved, "regressed": r.regressed, "p": S.symmetry_p(r.improved, r.regressed)}


def timings(rows: DataFrame, value: str = "elapsed_ms", by: Sequence[str] = ()) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("runs"), F.avg(v).alias("mean_ms"), F.percentile(v, F.lit(0.5)).alias("median_ms"), F.expr(f"percentile_disc(0.95D) WITHIN GROUP (ORDER BY {value})").alias("p95_ms"),
        F.expr(f"percentile_disc(0.99D) WITHIN GROUP (ORDER BY {value})").alias("p99_ms"), (1000.0 * F.count(v) / F.sum(v)).alias("per_second"),
    )


def overhead(timing: DataFrame, variant: str, base: str, other: str) -> DataFrame:
    """Percent that one variant's timings lie above another's."""
    a = timing.filter(F.col(variant) == base).select(*[F.col(c).alias(f"b_{c}") for c in ("mean_ms", "median_ms", "p95_ms")])
    b = timing.filter(F.col(variant) == other).select("mean_ms", "median_ms", "p95_ms")
    return b.crossJoin(F.broadcast(a)).select(*[(100.0 * (F.col(c) / F.col(f"b_{c}") - 1.0)).alias(f"{c}_overhead_percent") for c in ("mean_ms", "median_ms", "p95_ms")])
