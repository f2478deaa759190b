"""Evaluation, comparison and governance operators over the stand-in views, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import statistics as S
from brindle.operators import comparison as C
from brindle.operators import evaluation as E
from brindle.operators import governance as G
from brindle.plans import views as V
from brindle.sources.storage import checkpointed

TARGET = 0.05
REPLICATES = 2000  # as the reference
Z95, Z975 = NormalDist().inv_cdf(0.95), NormalDist().inv_cdf(0.975)


def _rounded(d: DataFrame, *skip: str) -> DataFrame:
    return d.select(*[(F.round(F.col(c), 6) + 0.0).alias(c) if t == "double" and c not in skip else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in d.dtypes])


def _lock(pred: DataFrame, target: float = TARGET) -> DataFrame:
    return E.once(E.select_threshold(E.score_table(pred.filter("split = 'validation'")), target).select("threshold"))


def _lock_sql(score: str = "score", name: str = "lock") -> str:
    """CTEs that end in <name>(threshold, ...): the locked threshold of the validation split."""
    return f"""{name}_g AS (SELECT {score} s, sum(label) tp, count(*) - sum(label) fp FROM pred WHERE split = 'validation' GROUP BY 1),
    {name}_r AS (SELECT s, sum(tp) OVER (ORDER BY s DESC) tp, sum(fp) OVER (ORDER BY s DESC) fp FROM {name}_g UNION ALL SELECT nextafter(max(s), 'infinity'::DOUBLE), 0, 0 FROM {name}_g),
    {name} AS (SELECT s threshold, tp::BIGINT tp, fp::BIGINT fp, (SELECT sum(tp) FROM {name}_g)::BIGINT pos, (SELECT sum(fp) FROM {name}_g)::BIGINT neg FROM {name}_r WHERE fp::DOUBLE / (SELECT sum(fp) FROM {name}_g) <= {TARGET}
        ORDER BY tp DESC, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END DESC, s LIMIT 1)"""


RATES = """round(threshold, 6) threshold, (pos + neg)::BIGINT AS "rows", pos::BIGINT positives, neg::BIGINT benign, tp::BIGINT true_positive, fp::BIGINT false_positive, (pos - tp)::BIGINT false_negative, (neg - fp)::BIGINT true_negative,
    round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN pos = 0 THEN 0 ELSE tp::DOUBLE / pos END, 6) recall, round(CASE WHEN neg = 0 THEN 0 ELSE fp::DOUBLE / neg END, 6) false_positive_rate,
    round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / pos) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / pos) END, 6) f1, round(CASE WHEN neg = 0 THEN 0 ELSE fp::DOUBLE / neg END * 10000, 6) false_alerts_per_10000_benign"""
COUNTS = "sum(CASE WHEN label = 1 AND {s} >= {t} THEN 1 ELSE 0 END) tp, sum(CASE WHEN label = 0 AND {s} >= {t} THEN 1 ELSE 0 END) fp, sum(label) pos, count(*) - sum(label) neg"


def a8_confusion(spark, d):
    p = V.predictions(spark, d)
    t = spark.createDataFrame([("train", 0.4), ("validation", 0.5), ("test", 0.6)], "split string, threshold double")
    return _rounded(E.at_threshold(E.score_table(p, ["split"]), t, ["split"]))


def a9_locked_threshold(spark, d):
    p = V.predictions(spark, d)
    return _rounded(E.select_threshold(E.score_table(p.filter("split = 'validation'")), TARGET))


def a9_frozen_test_metrics(spark, d):
    p = V.predictions(spark, d)
    return _rounded(E.at_threshold(E.score_table(p.filter("split = 'test'")), _lock(p)))


def a10_average_precision(spark, d):
    return _rounded(E.average_precision(E.score_table(V.predictions(spark, d), ["split"]), ["split"]))


def a11_calibration(spark, d):
    return _rounded(E.calibration(E.score_table(V.predictions(spark, d), ["split"]), by=["split"]))


def a12_selective(spark, d):
    p = V.predictions(spark, d)
    t, lock = E.score_table(p.filter("split = 'test'")), _lock(p)
    kinds = [E.selective(t, lock, k).withColumn("confidence_kind", F.lit(k)) for k in ("decision-margin", "max-probability")]
    return _rounded(kinds[0].unionByName(kinds[1]))


def a12_risk_coverage(spark, d):
    p = V.predictions(spark, d)
    return _rounded(E.risk_coverage(E.score_table(p.filter("split = 'test'")), _lock(p)))


def a13_fpr_evidence(spark, d):
    p = V.predictions(spark, d)
    return _rounded(E.fpr_evidence(p.filter("split = 'test'"), _lock(p), TARGET))


def a14_group_bootstrap(spark, d):
    p = V.predictions(spark, d)
    return _rounded(E.group_bootstrap(p.filter("split = 'test'"), _lock(p), REPLICATES))


def a15_conditional_compute(spark, d):
    return _rounded(E.conditional_compute(V.predictions(spark, d), ["split"]))


def a16_period_metrics(spark, d):
    p = V.predictions(spark, d)
    return _rounded(E.period_metrics(p.filter("split = 'test'"), _lock(p)))


def a17_evaluation_report(spark, d):
    return E.report(V.predictions(spark, d), TARGET)


def a17_report_points(spark, d):
    """The parts of a locked report that are no intervals, from its nested row."""
    r = E.report(V.predictions(spark, d), TARGET, bootstrap=0)
    return r.select(
        F.round("selection.threshold", 6).alias("threshold"), F.round("test.recall", 6).alias("recall"), F.round("test.false_positive_rate", 6).alias("false_positive_rate"), F.col("fpr_evidence.benign").cast("long").alias("benign"), F.round("fpr_evidence.upper_confidence_bound", 6).alias("upper"),
        F.round("decision_margin.aurc", 6).alias("aurc"), F.col("conditional_compute.reported_gate_rows").cast("long").alias("gate_rows"), F.size("periods").cast("long").alias("periods"), F.size("decision_margin_points").cast("long").alias("points"),
    )


def a41_micro_metrics(spark, d):
    return _rounded(E.micro_metrics(V.predictions(spark, d), by=["split"]))


def _pairs(spark, d):
    return C.align(V.predictions(spark, d), V.predictions(spark, d, 11))


def _both_locks(pairs):
    return E.once(E.select_threshold(E.score_table(C.systems(pairs).filter("split = 'validation'"), ["system"]), TARGET, ["system"]).select("system", "threshold"))


def j1_alignment(spark, d):
    return _rounded(C.alignment_summary(_pairs(spark, d)))


def a18_point_effects(spark, d):
    p = checkpointed(_pairs(spark, d))  # read by the locks and by every metric
    return _rounded(C.point_effects(p.filter("split = 'test'"), _both_locks(p)))


def a19_transitions(spark, d):
    p = checkpointed(_pairs(spark, d))
    lock = _both_locks(p)
    return C.transitions(p.filter("split = 'test'"), lock.filter("system = 'baseline'"), lock.filter("system = 'candidate'"))


def a20_paired_bootstrap(spark, d):
    p = checkpointed(_pairs(spark, d))
    return _rounded(C.paired_bootstrap(p.filter("split = 'test'"), _both_locks(p), REPLICATES))


def a21_claim_gate(spark, d):
    return C.compare(V.predictions(spark, d), V.predictions(spark, d, 11), TARGET, REPLICATES)["claim"]


def a22_mixed_groups(spark, d):
    """Groups of customers by the first digits of their key, which are in several splits or of both labels."""
    p = _pairs(spark, d).withColumn("group_id", F.substring("group_id", 1, 2))
    return C.mixed_groups(p).select("group_id", F.col("identities").cast("long"))


def f30_rate_bounds(spark, d):
    """Bounds of the share of urgent orders per priority month, from counts."""
    p = V.predictions(spark, d).filter("model_invoked is not null").groupBy("period").agg(F.count("*").alias("n"), F.count_if("model_invoked").alias("events"))
    return _rounded(p.select("period", "n", "events", S.zero_event_upper(F.col("n"), 0.95).alias("zero_upper"), S.wilson_upper(F.col("events"), F.col("n"), 0.95).alias("wilson_upper")))


def f17_f26_scores(spark, d):
    p = V.predictions(spark, d)
    s = F.col("score")
    return _rounded(p.select("sample_id", S.sigmoid((s - 0.5) * 20).alias("sigmoid"), S.max_probability(s).alias("max_probability"), S.decision_margin(s, F.lit(0.6)).alias("margin"), S.next_up(s).alias("next_up")), "next_up")


def a25_duplicates(spark, d):
    return G.duplicate_issues(V.manifest(spark, d)).select("severity", "code", "value", "n", F.array_join("sample_ids", ",").alias("sample_ids"))


def a26_split_leaks(spark, d):
    return G.leak_issues(V.manifest(spark, d)).select("severity", "code", "value", "n", F.array_join("sample_ids", ",").alias("sample_ids"))


def a26_package_fragmentation(spark, d):
    return G.fragmented_packages(V.manifest(spark, d)).select("severity", "code", "value", "n", F.array_join("sample_ids", ",").alias("sample_ids"))


def a27_temporal_order(spark, d):
    return G.temporal_issues(V.manifest(spark, d)).select("severity", "code", "value", "n")


def a28_manifest_audit(spark, d):
    m = V.manifest(spark, d).drop("version")
    a = G.audit(m)
    return a.select("fingerprint", "errors", "warnings", "n_issues", "passed", "truncated", *[F.col("splits")[s].alias(f"split_{s}") for s in ("train", "validation", "test", "unassigned")], F.col("labels")["1"].alias("label_1"))


def a29_split_isolation(spark, d):
    return G.split_isolation(V.manifest(spark, d))


def g1_duplicate_groups(spark, d):
    return G.duplicate_groups(V.closure_edges(spark, d))


def a33_grouping_summary(spark, d):
    return G.grouping_summary(G.duplicate_groups(V.closure_edges(spark, d)))


def w8_alternating_split(spark, d):
    return G.alternating_split(V.manifest(spark, d).select(F.col("group_id").alias("group")), "study-1").select("group", F.col("position").cast("long").alias("position"), "split")


def j9_group_exclusion(spark, d):
    m = V.manifest(spark, d)
    return G.exclude_overlapping_groups(m.filter("split = 'test'"), m.filter("split = 'train'"), ["sha256", "representation_hash"]).select("sample_id", "group_id")


def j8_overlap_counts(spark, d):
    m = V.manifest(spark, d)
    return G.overlap_counts(m.filter("split = 'test'"), m.filter("split = 'train'"), ["sha256", "representation_hash", "family"])


def g3_closest_subset(spark, d):
    m = V.manifest(spark, d)
    return G.closest_subset(m.groupBy("label", "group_id").agg(F.count("*").alias("n")), 100).groupBy("label").agg(F.sum(F.when(F.col("chosen"), F.col("n")).otherwise(0)).alias("chosen_rows"))


def a30_group_maxima(spark, d):
    from brindle.operators.study import development_point

    return _rounded(development_point(V.predictions(spark, d).filter("split = 'validation'")))


def a31_holdout(spark, d):
    from brindle.operators.study import group_maxima

    p = V.predictions(spark, d)
    return group_maxima(p.filter("split = 'test'")).join(F.broadcast(_lock(p))).groupBy("label").agg(F.count("*").alias("groups"), F.count_if(F.col("score") >= F.col("threshold")).alias("alerts"))


def a32_fixed_thresholds(spark, d):
    from brindle.operators.study import operating_points

    return _rounded(operating_points(V.predictions(spark, d).filter("split = 'test'"), [0.25, 0.5, 0.75]))


WITH = f"WITH {V.SQL['pred']}, "
_SYSTEM = "long AS (SELECT *, score AS s, 'baseline' AS system FROM pred UNION ALL SELECT *, score_b AS s, 'candidate' AS system FROM pred)"
_BOTH = f"{_lock_sql('score', 'bl')}, {_lock_sql('score_b', 'cl')}"
_AP = """SELECT {k}round(coalesce(sum(CASE WHEN pos = 0 THEN 0 ELSE tp::DOUBLE / pos * run_tp / run_n END), 0), 6) average_precision FROM (SELECT {k}s, tp, sum(tp) OVER (PARTITION BY {k1} ORDER BY s DESC) run_tp, sum(n) OVER (PARTITION BY {k1} ORDER BY s DESC) run_n, sum(tp) OVER (PARTITION BY {k1}) pos
    FROM (SELECT {k}{s} s, count(*) n, sum(label) tp FROM {frm} GROUP BY ALL)) GROUP BY ALL"""
_MARGIN = "CASE WHEN score >= threshold THEN CASE WHEN threshold < 1 THEN (score - threshold) / (1 - threshold) ELSE 0 END ELSE CASE WHEN threshold > 0 THEN (threshold - score) / threshold ELSE 0 END END"


def _curve(confidence: str) -> str:
    return f"""SELECT c, n, run_n::DOUBLE / total coverage, run_w::DOUBLE / run_n risk, run_n::BIGINT retained, n::DOUBLE / total step FROM (SELECT c, n, sum(n) OVER (ORDER BY c DESC) run_n, sum(w) OVER (ORDER BY c DESC) run_w, sum(n) OVER () total
        FROM (SELECT {confidence} c, count(*) n, sum(CASE WHEN (score >= threshold) <> (label = 1) THEN 1 ELSE 0 END) w FROM pred, lock WHERE split = 'test' GROUP BY 1))"""


def _wilson(k: str, n: str, z: float) -> str:
    return f"least(1.0, ({k}::DOUBLE / {n} + {z * z!r} / (2.0 * {n}) + {z!r} * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + {z * z!r} / (4.0 * {n} * {n}))) / (1 + {z * z!r} / {n}))"


def _upper(k: str, n: str, z: float, confidence: float) -> str:
    return f"CASE WHEN {k} = 0 THEN 1 - pow({1 - confidence!r}, 1.0::DOUBLE / {n}) ELSE {_wilson(k, n, z)} END"


_MANIFEST = f"WITH {V.SQL['manifest']}, "
_KEY = "CASE WHEN lower(ecosystem) IN ('pypi', 'python') THEN lower(ecosystem) || ':' || regexp_replace(lower(trim(package)), '[-_.]+', '-', 'g') ELSE lower(ecosystem) || ':' || lower(trim(package)) END"
_IDS = "array_to_string(list_sort(list(DISTINCT sample_id))[1:10], ',')"
_LEAK = " UNION ALL ".join(f"SELECT '{sev}' severity, '{code}' code, {_KEY if f == 'package' else f} AS value, sample_id, split FROM manifest" for f, code, sev in G.LEAKS)
_ISSUES = f"""SELECT 'error' severity, 'duplicate-sample-id' code, sample_id AS value FROM manifest GROUP BY sample_id HAVING count(*) > 1
    UNION ALL SELECT CASE WHEN count(DISTINCT label) > 1 OR count(DISTINCT split) > 1 THEN 'error' ELSE 'warning' END, 'd', sha256 FROM manifest GROUP BY sha256 HAVING count(*) > 1
    UNION ALL SELECT severity, code, value FROM ({_LEAK}) WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'warning', 'f', {_KEY} FROM manifest GROUP BY 3 HAVING count(DISTINCT group_id) > 1
    UNION ALL SELECT 'warning', 't', a.split || b.split FROM tt a, tt b WHERE a.o < b.o AND a.l >= b.f"""
_FIELDS = " || ',' || ".join(f"""'"{c}":' || coalesce({f'{c}::VARCHAR' if c == 'label' else f"'" + '"' + f"' || {c}::VARCHAR || '" + '"' + "'"}, 'null')""" for c in sorted(("sample_id", "label", "ecosystem", "package", "sha256", "group_id", "first_seen", "split", "representation_hash", "family", "campaign")))
_TT = "tt AS (SELECT split, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END o, max(first_seen) l, min(first_seen) f, count(*) n FROM manifest WHERE split IS NOT NULL GROUP BY 1)"
_CLOSURE = """e AS (SELECT doc_id s, unnest(['a' || sha256(text), 'b' || sha256(lower(text)), 'c' || sha256(string_split(text, chr(10))[1])]) k FROM documents WHERE text IS NOT NULL),
    pairs AS (SELECT DISTINCT a.s a, b.s b FROM e a JOIN (SELECT k, min(s) s FROM e GROUP BY k) b USING (k)), und AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    reach(s, r) AS (SELECT s, s FROM e UNION SELECT reach.s, und.b FROM reach JOIN und ON und.a = reach.r), g AS (SELECT s AS sample, min(r) AS "group" FROM reach GROUP BY s)"""

_EFFECT_ROWS = """m AS (SELECT system, sum(CASE WHEN label = 1 AND s >= t THEN 1 ELSE 0 END)::DOUBLE / sum(label) recall, sum(CASE WHEN label = 0 AND s >= t THEN 1 ELSE 0 END)::DOUBLE / sum(1 - label) false_positive_rate, avg((s - label) * (s - label)) brier_score, count(*) AS n
        FROM (SELECT *, CASE system WHEN 'baseline' THEN (SELECT threshold FROM bl) ELSE (SELECT threshold FROM cl) END t FROM long WHERE split = 'test') GROUP BY system)"""

SQL = {
    "a8_confusion": WITH + f"c AS (SELECT split, {COUNTS.format(s='score', t='threshold')}, threshold FROM pred JOIN (VALUES ('train', 0.4::DOUBLE), ('validation', 0.5::DOUBLE), ('test', 0.6::DOUBLE)) v(sp, threshold) ON sp = split GROUP BY split, threshold) SELECT split, {RATES} FROM c",
    "a9_locked_threshold": WITH + _lock_sql() + f" SELECT {RATES} FROM lock",
    "a9_frozen_test_metrics": WITH + _lock_sql() + f", c AS (SELECT {COUNTS.format(s='score', t='threshold')}, threshold FROM pred, (SELECT threshold FROM lock) WHERE split = 'test' GROUP BY threshold) SELECT {RATES} FROM c",
    "a10_average_precision": WITH[:-2] + " " + _AP.format(k="split, ", k1="split", s="score", frm="pred"),
    "a11_calibration": WITH + "b AS (SELECT split, least(9, floor(score * 10)) b, count(*) n, sum(label) y, sum(score) s, sum((score - label) * (score - label)) q FROM pred GROUP BY 1, 2) SELECT split, round(sum(q) / sum(n), 6) brier_score, round(sum(abs(s - y)) / sum(n), 6) ece, 10::BIGINT ece_bins, count(*)::BIGINT occupied_bins FROM b GROUP BY split",
    "a12_selective": WITH + _lock_sql() + f", m AS ({_curve(_MARGIN)}), p AS ({_curve('greatest(score, 1 - score)')}) SELECT round(sum(step * risk), 6) aurc, count(*)::BIGINT confidence_levels, 'decision-margin' confidence_kind FROM m UNION ALL SELECT round(sum(step * risk), 6), count(*)::BIGINT, 'max-probability' FROM p",
    "a12_risk_coverage": WITH + _lock_sql() + f", m AS ({_curve(_MARGIN)}) SELECT r::DOUBLE requested_coverage, round(min_by(coverage, retained), 6) coverage, round(min_by(risk, retained), 6) risk, min(retained)::BIGINT retained, round(min_by(c, retained), 6) confidence_floor FROM m, (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (1.0::DOUBLE)) v(r) WHERE coverage >= r GROUP BY r",
    "a13_fpr_evidence": WITH + _lock_sql() + f""", g AS (SELECT group_id, count(*) n, sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END) fp FROM pred, (SELECT threshold FROM lock) WHERE split = 'test' AND label = 0 GROUP BY 1),
        t AS (SELECT sum(n)::BIGINT n, sum(fp)::BIGINT fp, count(*)::BIGINT gn, sum(CASE WHEN fp > 0 THEN 1 ELSE 0 END)::BIGINT gfp FROM g), u AS (SELECT *, {_upper('fp', 'n', Z95, 0.95)} ru, {_upper('gfp', 'gn', Z95, 0.95)} gu FROM t)
        SELECT {TARGET}::DOUBLE target_fpr, 0.95::DOUBLE confidence, n benign, fp false_positive, round(fp::DOUBLE / n, 6) empirical_fpr, gn benign_groups, gfp false_positive_groups, round(gfp::DOUBLE / gn, 6) empirical_group_alert_rate, round(ru, 6) row_upper_confidence_bound, round(gu, 6) upper_confidence_bound,
        CASE WHEN gfp = 0 THEN 'exact-zero-event-binomial' ELSE 'one-sided-wilson' END bound_method, CASE WHEN fp = 0 THEN 'exact-zero-event-binomial' ELSE 'one-sided-wilson' END row_bound_method, ru <= {TARGET} AND gu <= {TARGET} target_supported, {S.minimum_trials(TARGET, 0.95)}::BIGINT minimum_benign_if_zero_fp FROM u""",
    "a15_conditional_compute": WITH[:-2] + " SELECT split, count(model_invoked)::BIGINT reported_gate_rows, round(avg(model_invoked::INTEGER), 6) model_invocation_rate, count(latency_ms)::BIGINT reported_latency_rows, round(quantile_cont(latency_ms, 0.5), 6) median_latency_ms, round(quantile_disc(latency_ms, 0.95), 6) p95_latency_ms FROM pred GROUP BY split",
    "a16_period_metrics": WITH + _lock_sql() + f""", c AS (SELECT period, {COUNTS.format(s='score', t='threshold')}, threshold, avg(greatest(score, 1 - score)) mp, avg({_MARGIN}) mm, avg(model_invoked::INTEGER) mi FROM pred, (SELECT threshold FROM lock) WHERE split = 'test' AND period IS NOT NULL GROUP BY period, threshold)
        SELECT period, {RATES}, round(mp, 6) mean_max_probability, round(mm, 6) mean_decision_margin, round(mi, 6) model_invocation_rate FROM c""",
    "a41_micro_metrics": WITH + """t AS (SELECT split, label, CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END::DOUBLE r, greatest(score, 1 - score) c, (score - label) * (score - label) q, -ln(greatest(1e-12::DOUBLE, CASE WHEN label = 1 THEN score ELSE 1 - score END)) nll FROM pred),
        b AS (SELECT split, ceil(c * 10) b, count(*) n, sum(r) r, sum(c) c, sum(q) q, sum(nll) nll, sum(CASE WHEN label = 1 THEN r END) r1, sum(label) n1, sum(CASE WHEN label = 0 THEN r END) r0, sum(1 - label) n0 FROM t GROUP BY 1, 2)
        SELECT split, round(sum(r) / sum(n), 6) accuracy, round((coalesce(sum(r1), 0) / greatest(1, sum(n1)) + coalesce(sum(r0), 0) / greatest(1, sum(n0))) / 2, 6) balanced_accuracy, round(sum(nll) / sum(n), 6) nll, round(sum(q) / sum(n), 6) brier, round(sum(abs(r - c)) / sum(n), 6) ece, sum(n)::BIGINT AS "rows" FROM b GROUP BY split""",
    "j1_alignment": WITH[:-2] + " SELECT count(*)::BIGINT AS \"rows\", count_if(split = 'train')::BIGINT train_rows, count_if(split = 'validation')::BIGINT validation_rows, count_if(split = 'test')::BIGINT test_rows, count(DISTINCT group_id)::BIGINT AS \"groups\", count(DISTINCT CASE WHEN split = 'test' THEN group_id END)::BIGINT test_groups FROM pred",
    "a18_point_effects": WITH + f"{_BOTH}, {_SYSTEM}, {_EFFECT_ROWS}, ap AS ({_AP.format(k='system, ', k1='system', s='s', frm=chr(40) + 'SELECT * FROM long WHERE split = ' + chr(39) + 'test' + chr(39) + chr(41))})," + """
        cv AS (SELECT system, s c0, label, CASE WHEN s >= t THEN (s - t) / (1 - t) ELSE (t - s) / t END c, CASE WHEN (s >= t) <> (label = 1) THEN 1 ELSE 0 END w FROM (SELECT *, CASE system WHEN 'baseline' THEN (SELECT threshold FROM bl) ELSE (SELECT threshold FROM cl) END t FROM long WHERE split = 'test')),
        au AS (SELECT system, sum(n::DOUBLE / total * run_w / run_n) aurc FROM (SELECT system, n, sum(n) OVER (PARTITION BY system ORDER BY c DESC) run_n, sum(w) OVER (PARTITION BY system ORDER BY c DESC) run_w, sum(n) OVER (PARTITION BY system) total FROM (SELECT system, c, count(*) n, sum(w) w FROM cv GROUP BY 1, 2)) GROUP BY system),
        v AS (SELECT system, 'recall' metric, recall v, n FROM m UNION ALL SELECT system, 'false_positive_rate', false_positive_rate, n FROM m UNION ALL SELECT system, 'brier_score', brier_score, n FROM m UNION ALL SELECT ap.system, 'average_precision', average_precision, n FROM ap JOIN m USING (system) UNION ALL SELECT au.system, 'aurc', aurc, n FROM au JOIN m USING (system)
          UNION ALL SELECT system, 'model_invocation_rate', avg(model_invoked::INTEGER), count(model_invoked) FROM long WHERE split = 'test' GROUP BY system UNION ALL SELECT system, 'mean_latency_ms', avg(latency_ms), count(latency_ms) FROM long WHERE split = 'test' GROUP BY system UNION ALL SELECT system, 'median_latency_ms', quantile_cont(latency_ms, 0.5), count(latency_ms) FROM long WHERE split = 'test' GROUP BY system)
        SELECT metric, round(max(CASE WHEN system = 'baseline' THEN v END), 6) baseline, round(max(CASE WHEN system = 'candidate' THEN v END), 6) candidate, round(max(CASE WHEN system = 'candidate' THEN v END) - max(CASE WHEN system = 'baseline' THEN v END), 6) + 0.0 delta, CASE WHEN metric IN ('recall', 'average_precision') THEN 'higher' ELSE 'lower' END better, max(n)::BIGINT paired_rows FROM v GROUP BY metric""",
    "a19_transitions": WITH + f"{_BOTH}, r AS (SELECT group_id, label, score >= (SELECT threshold FROM bl) b, score_b >= (SELECT threshold FROM cl) c FROM pred WHERE split = 'test'), u AS (SELECT 'rows' unit, label, b, c FROM r UNION ALL SELECT 'groups_any_alert', max(label), bool_or(b), bool_or(c) FROM r GROUP BY group_id)," + """
        cells(class, l, b, c, state) AS (VALUES ('benign', 0, false, false, 'both_clear'), ('benign', 0, true, false, 'candidate_fixed_false_alert'), ('benign', 0, false, true, 'candidate_introduced_false_alert'), ('benign', 0, true, true, 'both_alert'), ('malicious', 1, false, false, 'both_missed'), ('malicious', 1, false, true, 'candidate_recovered_detection'), ('malicious', 1, true, false, 'candidate_lost_detection'), ('malicious', 1, true, true, 'both_detected'))
        SELECT un.unit, class, state, (SELECT count(*) FROM u WHERE u.unit = un.unit AND u.label = cells.l AND u.b = cells.b AND u.c = cells.c)::BIGINT n FROM cells, (VALUES ('rows'), ('groups_any_alert')) un(unit)""",
    "a22_mixed_groups": WITH[:-2] + " SELECT group_id[1:2] group_id, count(DISTINCT (label, split))::BIGINT identities FROM pred GROUP BY 1 HAVING count(DISTINCT (label, split)) > 1",
    "f30_rate_bounds": WITH + f"c AS (SELECT period, count(*)::BIGINT n, count_if(model_invoked)::BIGINT k FROM pred WHERE model_invoked IS NOT NULL GROUP BY period) SELECT period, n, k AS events, round(1 - pow({1 - 0.95!r}, 1.0::DOUBLE / n), 6) zero_upper, round({_wilson('k', 'n', Z95)}, 6) wilson_upper FROM c",
    "f17_f26_scores": WITH[:-2] + " SELECT sample_id, round(1 / (1 + exp(-((score - 0.5) * 20))), 6) sigmoid, round(greatest(score, 1 - score), 6) max_probability, round(CASE WHEN score >= 0.6::DOUBLE THEN (score - 0.6::DOUBLE) / (1 - 0.6::DOUBLE) ELSE (0.6::DOUBLE - score) / 0.6::DOUBLE END, 6) margin, nextafter(score, 'infinity'::DOUBLE) next_up FROM pred",
    "a25_duplicates": _MANIFEST[:-2] + f" SELECT CASE WHEN count(DISTINCT label) > 1 OR count(DISTINCT split) > 1 THEN 'error' ELSE 'warning' END severity, CASE WHEN count(DISTINCT label) > 1 THEN 'conflicting-label-duplicate' ELSE 'exact-duplicate' END code, sha256 AS value, count(*)::BIGINT n, {_IDS} sample_ids FROM manifest GROUP BY sha256 HAVING count(*) > 1",
    "a26_split_leaks": _MANIFEST[:-2] + f" SELECT severity, code, value, count(*)::BIGINT n, {_IDS} sample_ids FROM ({_LEAK}) WHERE value IS NOT NULL GROUP BY severity, code, value HAVING count(DISTINCT split) > 1",
    "a26_package_fragmentation": _MANIFEST[:-2] + f" SELECT 'warning' severity, 'package-group-fragmentation' code, {_KEY} AS value, count(*)::BIGINT n, {_IDS} sample_ids FROM manifest GROUP BY 3 HAVING count(DISTINCT group_id) > 1",
    "a27_temporal_order": _MANIFEST + _TT + " SELECT 'warning' severity, 'temporal-order' code, a.split || '>' || b.split AS value, (a.n + b.n)::BIGINT n FROM tt a, tt b WHERE a.o < b.o AND a.l >= b.f",
    "a28_manifest_audit": _MANIFEST + _TT + f", i AS ({_ISSUES}) SELECT (SELECT sha256('[' || string_agg('{{' || {_FIELDS} || '}}', ',' ORDER BY sample_id) || ']') FROM manifest) fingerprint, count_if(severity = 'error')::BIGINT errors, count_if(severity = 'warning')::BIGINT warnings, count(*)::BIGINT n_issues, count_if(severity = 'error') = 0 passed, count(*) > 100 truncated, (SELECT count(*) FROM manifest WHERE split = 'train')::BIGINT split_train, (SELECT count(*) FROM manifest WHERE split = 'validation')::BIGINT split_validation, (SELECT count(*) FROM manifest WHERE split = 'test')::BIGINT split_test, (SELECT count(*) FROM manifest WHERE split IS NULL)::BIGINT split_unassigned, (SELECT count(*) FROM manifest WHERE label = 1)::BIGINT label_1 FROM i",
    "a29_split_isolation": _MANIFEST[:-2] + " SELECT 'group-crosses-splits' code, group_id AS value, count(*)::BIGINT n FROM manifest WHERE group_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'representation-crosses-splits', representation_hash, count(*)::BIGINT FROM manifest WHERE representation_hash IS NOT NULL GROUP BY 2 HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'conflicting-labels', representation_hash, count(*)::BIGINT FROM manifest WHERE representation_hash IS NOT NULL GROUP BY 2 HAVING count(DISTINCT label) > 1",
    "g1_duplicate_groups": f"WITH RECURSIVE {_CLOSURE} SELECT * FROM g",
    "a33_grouping_summary": f"WITH RECURSIVE {_CLOSURE}, c AS (SELECT \"group\", count(*) n FROM g GROUP BY 1) SELECT sum(n)::BIGINT samples, count(*)::BIGINT AS \"groups\", count_if(n > 1)::BIGINT duplicate_groups, coalesce(sum(CASE WHEN n > 1 THEN n END), 0)::BIGINT samples_in_duplicate_groups, max(n)::BIGINT largest_group FROM c",
    "w8_alternating_split": _MANIFEST + "n AS (SELECT g, row_number() OVER (ORDER BY sha256('study-1|' || g)) - 1 p FROM (SELECT DISTINCT group_id g FROM manifest)) SELECT g AS \"group\", p::BIGINT AS position, CASE WHEN p % 2 = 0 THEN 'development' ELSE 'holdout' END split FROM n",
    "j9_group_exclusion": _MANIFEST + "tr AS (SELECT * FROM manifest WHERE split = 'train'), te AS (SELECT * FROM manifest WHERE split = 'test'), bad AS (SELECT group_id FROM te WHERE sha256 IN (SELECT sha256 FROM tr) OR representation_hash IN (SELECT representation_hash FROM tr WHERE representation_hash IS NOT NULL)) SELECT sample_id, group_id FROM te WHERE group_id NOT IN (SELECT group_id FROM bad)",
    "j8_overlap_counts": _MANIFEST[:-2] + " " + " UNION ALL ".join(f"SELECT '{k}' AS key, count(*)::BIGINT shared FROM (SELECT {k} FROM manifest WHERE split = 'test' AND {k} IS NOT NULL INTERSECT SELECT {k} FROM manifest WHERE split = 'train' AND {k} IS NOT NULL)" for k in ("sha256", "representation_hash", "family")),
    "g3_closest_subset": _MANIFEST.replace("WITH ", "WITH RECURSIVE ", 1) + """g AS (SELECT label, n, row_number() OVER (PARTITION BY label ORDER BY group_id) i FROM (SELECT label, group_id, count(*) n FROM manifest GROUP BY 1, 2)),
        r(label, i, s) AS (SELECT DISTINCT label, 0::BIGINT, 0::BIGINT FROM g UNION SELECT r.label, g.i, r.s + x * g.n FROM r JOIN g ON g.label = r.label AND g.i = r.i + 1, (VALUES (0), (1)) t(x) WHERE r.s + x * g.n <= 200) SELECT label, arg_min(s, abs(s - 100) * 1000 + s)::BIGINT chosen_rows FROM r GROUP BY label""",
    "a30_group_maxima": WITH + "g AS (SELECT group_id, max(label) l, max(score) s FROM pred WHERE split = 'validation' GROUP BY 1), t AS (SELECT nextafter(max(CASE WHEN l = 0 THEN s END), 'infinity'::DOUBLE) t FROM g) SELECT round(t, 6) threshold, count_if(l = 0)::BIGINT benign_groups, count_if(l = 1)::BIGINT malicious_groups, count_if(l = 1 AND s >= t)::BIGINT detected_groups, round(count_if(l = 1 AND s >= t)::DOUBLE / greatest(1, count_if(l = 1)), 6) recall FROM g, t GROUP BY t",
    "a31_holdout": WITH + _lock_sql() + ", g AS (SELECT group_id, max(label) AS label, max(score) s FROM pred WHERE split = 'test' GROUP BY 1) SELECT label, count(*)::BIGINT AS \"groups\", count_if(s >= (SELECT threshold FROM lock))::BIGINT alerts FROM g GROUP BY label",
    "a32_fixed_thresholds": WITH + f"c AS (SELECT {COUNTS.format(s='score', t='threshold')}, threshold FROM pred, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) v(threshold) WHERE split = 'test' GROUP BY threshold) SELECT {RATES} FROM c",
}

SQL["a17_report_points"] = f"""SELECT t.threshold, t.recall, t.false_positive_rate, e.benign, e.upper_confidence_bound AS upper, s.aurc, c.reported_gate_rows gate_rows, (SELECT count(*) FROM ({SQL["a16_period_metrics"]}))::BIGINT periods, 5::BIGINT points
    FROM ({SQL["a9_frozen_test_metrics"]}) t, ({SQL["a13_fpr_evidence"]}) e, ({SQL["a12_selective"]}) s, ({SQL["a15_conditional_compute"]}) c WHERE s.confidence_kind = 'decision-margin' AND c.split = 'test'"""
