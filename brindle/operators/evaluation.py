"""Evaluation of detectors from prediction rows: thresholds, quality, bounds, calibration, selection, resampling.

Rows have sample_id, label (0 or 1), score in [0, 1], split, group_id, period, model_invoked and latency_ms. Every
function works per key columns ``by`` (none, a system, a replicate, ...) and returns one row per key
unless it says otherwise. Rows are first summed by distinct score, so what is sorted is the distinct
scores, and running sums take two passes over score buckets, so no single task sorts them all.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import statistics as S
from brindle.sources.storage import checkpointed

BUCKETS = 1024
COVERAGES = (0.5, 0.8, 0.9, 0.95, 1.0)


def keyed(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins a side with one row per key; without keys that side is one row. Keys may be many, so Spark chooses the join."""
    return left.join(right, list(by), how) if by else left.crossJoin(F.broadcast(right))


def once(few: DataFrame) -> DataFrame:
    """A table of a row per system or less, computed now, so that its readers do not each compute it again."""
    return few.sparkSession.createDataFrame(few.collect(), few.schema)


def score_table(rows: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Per key and distinct score: n rows and tp positive rows, weighted if asked."""
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    return rows.groupBy(*by, "score").agg(F.sum(w).alias("n"), F.sum(w * F.col("label")).alias("tp"))


def running_sums(table: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """table with run_<column>: sums over all rows of the key whose value in [0, 1] is as high or higher; values are distinct."""
    t = table.withColumn("_b", F.floor(F.col(value) * BUCKETS))
    higher = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy(*by, "_b").agg(*[F.sum(s).alias(s) for s in sums]).select(*by, "_b", *[F.coalesce(F.sum(s).over(higher), F.lit(0)).alias(f"_{s}") for s in sums])
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    joined = t.join(blocks, [*by, "_b"])
    return joined.select(*table.columns, *[(F.col(f"_{s}") + F.sum(s).over(inside)).alias(f"run_{s}") for s in sums])


def totals(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("tp").alias("positives"))


def _rates(d: DataFrame, keep: Sequence[str]) -> DataFrame:
    c = F.col
    precision, recall = S.ratio(c("true_positive"), c("true_positive") + c("false_positive")), S.ratio(c("true_positive"), c("positives"))
    fpr = S.ratio(c("false_positive"), c("benign"))
    return d.select(
        *keep, "threshold", "rows", "positives", "benign", "true_positive", "false_positive",
        (c("positives") - c("true_positive")).alias("false_negative"), (c("benign") - c("false_positive")).alias("true_negative"),
        precision.alias("precision"), recall.alias("recall"), fpr.alias("false_positive_rate"),
        S.ratio(2.0 * precision * recall, precision + recall).alias("f1"), (fpr * 10_000.0).alias("false_alerts_per_10000_benign"),
    )


def at_threshold(table: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates of a score table at the threshold of its key; alerts are scores as high or higher."""
    alert = F.col("score") >= F.col("threshold")
    d = keyed(table, thresholds.select(*by, "threshold"), by).groupBy(*by, "threshold").agg(
        F.sum("n").alias("rows"), F.sum("tp").alias("positives"), F.sum(F.col("n") - F.col("tp")).alias("benign"),
        F.coalesce(F.sum(F.when(alert, F.col("tp"))), F.lit(0)).alias("true_positive"),
        F.coalesce(F.sum(F.when(alert, F.col("n") - F.col("tp"))), F.lit(0)).alias("false_positive"),
    )
    return _rates(d, by)


def select_threshold(table: DataFrame, target_fpr: float, by: Sequence[str] = ()) -> DataFrame:
    """The threshold with the highest recall, then precision, then lowest value, among those within the FPR budget.

    One candidate lies just above the highest score, so a budget that no score meets still has an answer.
    """
    run = running_sums(table, "score", ["n", "tp"], by).select(*by, F.col("score").alias("threshold"), F.col("run_tp").alias("true_positive"), (F.col("run_n") - F.col("run_tp")).alias("false_positive"))
    none = table.groupBy(*by).agg(S.next_up(F.max("score")).alias("threshold")).select(*by, "threshold", F.lit(0).cast("long").alias("true_positive"), F.lit(0).cast("long").alias("false_positive"))
    total = totals(table, by).withColumn("benign", F.col("rows") - F.col("positives"))
    metrics = _rates(keyed(run.unionByName(none), total, by), by)
    ok = metrics.filter((F.col("benign") > 0) & (F.col("false_positive_rate") <= target_fpr))
    names = [c for c in metrics.columns if c not in by]
    best = ok.groupBy(*by).agg(F.max_by(F.struct(*names), F.struct("recall", "precision", -F.col("threshold"))).alias("m"))
    return best.select(*by, "m.*")


def average_precision(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    run = keyed(running_sums(table, "score", ["n", "tp"], by), totals(table, by), by)
    step = S.ratio(F.col("tp"), F.col("positives")) * F.col("run_tp").cast("double") / F.col("run_n").cast("double")
    return run.groupBy(*by).agg(F.sum(step).alias("average_precision"))


def calibration(table: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Brier score and expected calibration error over equal-width bins of the score, the last one closed."""
    n, s = F.col("n").cast("double"), F.col("score")
    squares = F.col("tp") * (1.0 - s) * (1.0 - s) + (F.col("n") - F.col("tp")) * s * s
    binned = table.groupBy(*by, F.least(F.lit(bins - 1), F.floor(s * bins)).alias("bin")).agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"), F.sum(n * s).alias("score"), F.sum(squares).alias("squares"))
    gap = F.abs(F.col("score") - F.col("tp"))
    return binned.groupBy(*by).agg((F.sum("squares") / F.sum("n")).alias("brier_score"), (F.sum(gap) / F.sum("n")).alias("ece"), F.lit(bins).alias("ece_bins"), F.count("*").alias("occupied_bins"))


def _confidence_table(table: DataFrame, thresholds: DataFrame, kind: str, by: Sequence[str]) -> DataFrame:
    if kind not in ("decision-margin", "max-probability"):
        raise ValueError("confidence kind is decision-margin or max-probability")
    d = keyed(table, thresholds.select(*by, "threshold"), by)
    wrong = F.when(F.col("score") >= F.col("threshold"), F.col("n") - F.col("tp")).otherwise(F.col("tp"))
    confidence = S.max_probability(F.col("score")) if kind == "max-probability" else S.decision_margin(F.col("score"), F.col("threshold"))
    t = d.groupBy(*by, confidence.alias("confidence")).agg(F.sum("n").alias("n"), F.sum(wrong).alias("wrong"))
    run = keyed(running_sums(t, "confidence", ["n", "wrong"], by), t.groupBy(*by).agg(F.sum("n").alias("rows")), by)
    return run.select(*by, "confidence", "n", (F.col("run_n") / F.col("rows")).alias("coverage"), (F.col("run_wrong") / F.col("run_n")).alias("risk"), F.col("run_n").alias("retained"), (F.col("n") / F.col("rows")).alias("step"))


def selective(table: DataFrame, thresholds: DataFrame, kind: str = "decision-margin", by: Sequence[str] = ()) -> DataFrame:
    """Area under the risk-coverage curve; whole ties of confidence enter together."""
    run = _confidence_table(table, thresholds, kind, by)
    return run.groupBy(*by).agg(F.sum(F.col("step") * F.col("risk")).alias("aurc"), F.count("*").alias("confidence_levels"))


def risk_coverage(table: DataFrame, thresholds: DataFrame, kind: str = "decision-margin", coverages: Sequence[float] = COVERAGES, by: Sequence[str] = ()) -> DataFrame:
    """Per requested coverage the first point of the curve that reaches it."""
    run = _confidence_table(table, thresholds, kind, by)
    asked = F.array(*[F.lit(float(c)) for c in coverages])
    each = run.select(*by, "coverage", "risk", "retained", F.col("confidence").alias("confidence_floor"), F.explode(asked).alias("requested_coverage"))
    point = F.min_by(F.struct("coverage", "risk", "retained", "confidence_floor"), "retained").alias("p")
    return each.filter("coverage >= requested_coverage").groupBy(*by, "requested_coverage").agg(point).select(*by, "requested_coverage", "p.*")


def fpr_evidence(rows: DataFrame, thresholds: DataFrame, target_fpr: float, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """False-positive rate of rows and of groups, their upper bounds, and whether both meet the target."""
    d = keyed(rows.filter("label = 0"), thresholds.select(*by, "threshold"), by)
    groups = d.groupBy(*by, "group_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("threshold")).alias("fp"))
    d = groups.groupBy(*by).agg(F.sum("n").alias("benign"), F.sum("fp").alias("false_positive"), F.count("*").alias("benign_groups"), F.count_if(F.expr("fp > 0")).alias("false_positive_groups"))
    row, group = S.rate_upper(F.col("false_positive"), F.col("benign"), confidence), S.rate_upper(F.col("false_positive_groups"), F.col("benign_groups"), confidence)
    return d.select(
        *by, F.lit(target_fpr).alias("target_fpr"), F.lit(confidence).alias("confidence"), "benign", "false_positive", S.ratio(F.col("false_positive"), F.col("benign")).alias("empirical_fpr"),
        "benign_groups", "false_positive_groups", S.ratio(F.col("false_positive_groups"), F.col("benign_groups")).alias("empirical_group_alert_rate"),
        row.alias("row_upper_confidence_bound"), group.alias("upper_confidence_bound"), S.bound_method(F.col("false_positive_groups")).alias("bound_method"), S.bound_method(F.col("false_positive")).alias("row_bound_method"),
        ((row <= target_fpr) & (group <= target_fpr)).alias("target_supported"), F.lit(S.minimum_trials(target_fpr, confidence)).cast("long").alias("minimum_benign_if_zero_fp"),
    )


def conditional_compute(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often the model ran, and its latency where reported; null where nothing is."""
    return rows.groupBy(*by).agg(
        F.count("model_invoked").alias("reported_gate_rows"), F.avg(F.col("model_invoked").cast("double")).alias("model_invocation_rate"), F.count("latency_ms").alias("reported_latency_rows"),
        F.expr("percentile(latency_ms, 0.5D)").alias("median_latency_ms"), F.expr("percentile_disc(0.95D) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_latency_ms"),
    )


def period_metrics(rows: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics per non-null period."""
    keys = [*by, "period"]
    seen = keyed(rows.filter("period is not null"), thresholds.select(*by, "threshold"), by)
    per = seen.select(*keys, "threshold").distinct()
    m = at_threshold(score_table(seen, keys), per, keys)
    more = seen.groupBy(*keys).agg(F.avg(S.max_probability(F.col("score"))).alias("mean_max_probability"), F.avg(S.decision_margin(F.col("score"), F.col("threshold"))).alias("mean_decision_margin"), F.avg(F.col("model_invoked").cast("double")).alias("model_invocation_rate"))
    return m.join(more, keys)


def quality(table: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = at_threshold(table, thresholds, by)
    for part in (average_precision(table, by), calibration(table, by=by)):
        out = keyed(out, part, by)
    return out


def numbered(groups: DataFrame) -> tuple[DataFrame, int]:
    """(group_id, at), at the place of an id among the sorted distinct ids, and how many there are; nulls have none.

    Ids are sorted and counted in the cluster; the driver sees a number for each partition of the sort.
    """
    ids = checkpointed(groups.filter("group_id is not null").distinct().sort("group_id").withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)  # as monotonically_increasing_id makes them: partition, place in it
    starts, n = [], 0
    for p, size in sorted(map(tuple, ids.groupBy(part).count().collect())):
        starts.append((p, n))
        n += size
    starts = groups.sparkSession.createDataFrame(starts, "_part long, _start long")
    return ids.join(F.broadcast(starts), part == F.col("_part")).select("group_id", (F.col("_start") + F.col("_m") - F.shiftleft("_part", 33)).alias("at")), n


def _states(n: int, repetitions: int, seed: int) -> list[tuple[int, bytes, int]]:
    """(replicate, words, position): the generator where a replicate of n draws begins, as random.Random(seed) gets there."""
    *key, position = random.Random(seed).getstate()[1]
    ahead, states = np.random.RandomState(), []
    ahead.set_state(("MT19937", np.array(key, dtype=np.uint32), position))
    for k in range(repetitions):
        _, words, at, *_ = ahead.get_state()
        states.append((k, words.tobytes(), int(at)))
        for lo in range(0, n, DRAWN_AT_ONCE):
            ahead.random_sample(min(DRAWN_AT_ONCE, n - lo))
    return states


def _sums(incoming, columns: Sequence[str], block: int, counters: int):
    """Adds up weights over the groups of each block, for rows (key, range, replicate, payload, at, n, columns) sorted by key, weights first.

    Weights of one block are held at a time, and that many sums at most; what is given out are parts of the sums of
    (replicate, columns).
    """
    state = {"key": None, "range": None, "drawn": {}, "cells": {}, "kinds": None, "held": [], "rows": 0, "acc": None, "replicates": None}

    def given():
        cells, acc, replicates = state["cells"], state["acc"], state["replicates"]
        if cells:
            values = [pa.array(c, t) for c, t in zip(zip(*cells), state["kinds"])]
            step = max(1, (1 << 18) // len(replicates))
            for lo in range(0, len(cells), step):
                cell, j = np.nonzero(acc[lo : min(lo + step, len(cells))])
                if len(cell):
                    yield pa.RecordBatch.from_arrays([pa.array(replicates[j]), *[v.take(pa.array(cell + lo)) for v in values], pa.array(acc[cell + lo, j])], names=["replicate", *columns, "w"])
        state["cells"] = {}

    def added():
        if not state["held"]:
            return
        t = pa.Table.from_batches(state["held"])
        state["held"], state["rows"] = [], 0
        code, at, n = np.zeros(len(t), dtype=np.int64), t["at"].to_numpy(), t["n"].to_numpy()
        for c in columns:
            d = t[c].combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * len(d.dictionary) + d.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        own = list(zip(*(t[c].take(pa.array(order[starts])).to_pylist() for c in columns)))
        drawn = sorted(state["drawn"].items())
        most = max(1, counters // len(drawn))
        for lo in range(0, len(own), most):
            hi = min(lo + most, len(own))
            if len(state["cells"]) + hi - lo > most:
                yield from given()
            if not state["cells"]:
                state["acc"], state["replicates"] = np.zeros((most, len(drawn)), dtype=np.int64), np.array([k for k, _ in drawn], dtype=np.int32)
            cell = np.array([state["cells"].setdefault(x, len(state["cells"])) for x in own[lo:hi]])
            some = order[starts[lo] : starts[hi] if hi < len(own) else len(order)]
            groups, times, edge = at[some], n[some], starts[lo:hi] - starts[lo]
            plain = bool((times == 1).all())
            for j, (_, payload) in enumerate(drawn):
                w = np.frombuffer(payload, dtype=f"u{payload[0]}", offset=8)[groups]
                state["acc"][cell, j] += np.add.reduceat(w if plain else w * times, edge, dtype=np.int64)

    for b in incoming:
        keys = b.column("key").to_numpy()
        state["kinds"] = [b.schema.field(c).type for c in columns]
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            some = b.slice(lo, hi - lo)
            if keys[lo] != state["key"]:
                yield from added()
                if some.column("range")[0].as_py() != state["range"]:
                    yield from given()
                state["key"], state["range"], state["drawn"] = keys[lo], some.column("range")[0].as_py(), {}
            weights = len(some) - some.column("payload").null_count
            for k, payload in zip(some.column("replicate").slice(0, weights).to_pylist(), some.column("payload").slice(0, weights).to_pylist()):
                state["drawn"][k] = payload
            if weights < len(some):
                state["held"].append(some.slice(weights).select(["at", "n", *columns]))
                state["rows"] += len(some) - weights
            if state["rows"] >= 1 << 18:
                yield from added()
    yield from added()
    yield from given()


DRAWN_AT_ONCE = 1 << 20
GROUPS_A_BLOCK, SUMS_AT_ONCE = 1 << 12, 1 << 22


def resampled(rows: DataFrame, repetitions: int, seed: int, columns: Sequence[str] = ("label", "score")) -> DataFrame:
    """(replicate, columns, w): distinct rows of each replicate with how often they were drawn.

    Groups are drawn as random.Random(seed).choices over the sorted ids, the one definition at every size. The driver
    only runs the generator ahead and keeps its state at the start of each replicate. Tasks draw from there and send
    weights in blocks of groups, a byte a group, to where the rows of these groups are, summed by group and columns;
    these are added up at once, so no row is made for a replicate's group.
    """
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in columns)
    places, n = numbered(rows.select("group_id"))
    if n < 2 or repetitions < 1:
        return spark.createDataFrame([], f"replicate int, {fields}, w long")
    block, counters, columns = GROUPS_A_BLOCK, SUMS_AT_ONCE, list(columns)
    blocks, tasks = -(-n // block), 4 * spark.sparkContext.defaultParallelism
    ranges = min(repetitions, -(-tasks // blocks))
    parts = min(blocks * ranges, max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def draw(incoming):
        generator = np.random.RandomState()
        for batch in incoming:
            for k, words, at in zip(*(c.to_pylist() for c in batch.columns)):
                generator.set_state(("MT19937", np.frombuffer(words, dtype=np.uint32), at))
                weight = np.zeros(n, dtype=np.int32)
                for lo in range(0, n, DRAWN_AT_ONCE):
                    np.add.at(weight, (generator.random_sample(min(DRAWN_AT_ONCE, n - lo)) * float(n)).astype(np.int64), 1)
                weight = weight.astype(np.min_scalar_type(int(weight.max())))
                head = bytes([weight.itemsize]) + bytes(7)
                own = k * ranges // repetitions
                for lo in range(0, blocks, 256):
                    some = range(lo, min(lo + 256, blocks))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([own * blocks + i for i in some], pa.int64()), pa.array([own] * len(some), pa.int32()), pa.array([k] * len(some), pa.int32()),
                        pa.array([head + weight[i * block : (i + 1) * block].tobytes() for i in some], pa.binary()),
                    ], names=["key", "range", "replicate", "payload"])

    weights = spark.createDataFrame(_states(n, repetitions, seed), "replicate int, words binary, position int").repartition(min(repetitions, tasks))
    weights = weights.mapInArrow(draw, "key long, `range` int, replicate int, payload binary")
    per = rows.groupBy("group_id", *columns).agg(F.count("*").alias("n")).join(places, "group_id")
    per = per.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).select(
        (F.col("range").cast("long") * blocks + F.floor(F.col("at") / block)).alias("key"), "range", (F.col("at") % block).alias("at"), "n", *columns,
    )
    both = weights.unionByName(per, allowMissingColumns=True)
    dealt = both.repartitionById(parts, F.floor(F.col("key") * parts / (blocks * ranges)).cast("int")).sortWithinPartitions("key", F.col("payload").isNull())
    sums = dealt.mapInArrow(lambda b: _sums(b, columns, block, counters), f"replicate int, {fields}, w long")
    return sums.groupBy("replicate", *columns).agg(F.sum("w").alias("w"))


def interval(values: DataFrame, names: Sequence[str], confidence: float, by: Sequence[str] = ()) -> DataFrame:
    """metric, lower, upper, replicates: interpolated percentiles over replicates."""
    tail = (1.0 - confidence) / 2.0
    long = values.select(*by, F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])).alias("metric", "value"))
    return long.filter("value is not null").groupBy(*by, "metric").agg(F.percentile("value", F.lit(tail)).alias("lower"), F.percentile("value", F.lit(1.0 - tail)).alias("upper"), F.count("*").alias("replicates"))


def group_bootstrap(rows: DataFrame, thresholds: DataFrame, repetitions: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Percentile intervals of recall, FPR, average precision and AURC over resampled groups; one-class replicates are skipped."""
    drawn = checkpointed(resampled(rows, repetitions, seed))  # read by every metric
    table = score_table(drawn, ["replicate"], F.col("w"))
    mixed = totals(table, ["replicate"]).filter("positives > 0 and positives < rows").select("replicate")
    table = table.join(F.broadcast(mixed), "replicate")
    limits = mixed.crossJoin(F.broadcast(thresholds.select("threshold")))
    out = at_threshold(table, limits, ["replicate"]).select("replicate", "recall", "false_positive_rate").join(average_precision(table, ["replicate"]), "replicate").join(selective(table, limits, by=["replicate"]).select("replicate", "aurc"), "replicate")
    return interval(out, ["recall", "false_positive_rate", "average_precision", "aurc"], confidence)


def report(rows: DataFrame, target_fpr: float = 0.001, bootstrap: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """The locked evaluation as one nested row: the threshold comes from validation, everything else from test."""
    if not 0.0 < target_fpr < 1.0:
        raise ValueError("a target rate lies between 0 and 1, both left out")
    rows = checkpointed(rows.filter("split in ('validation', 'test')").select("label", "score", "split", "group_id", "period", "model_invoked", "latency_ms"))  # every part reads it
    validation, test = rows.filter("split = 'validation'"), rows.filter("split = 'test'")
    vt, tt = checkpointed(score_table(validation)), checkpointed(score_table(test))
    lock = once(select_threshold(vt, target_fpr).select("threshold"))
    one = lambda d, name: d.select(F.struct(*d.columns).alias(name))
    many = lambda d, name, order: d.agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in d.columns if c != order]))).alias(name))
    parts = [one(quality(vt, lock), "validation"), one(quality(tt, lock), "test"), one(fpr_evidence(test, lock, target_fpr, confidence), "fpr_evidence")]
    for kind, name in (("decision-margin", "decision_margin"), ("max-probability", "max_probability")):
        parts += [one(selective(tt, lock, kind), name), many(risk_coverage(tt, lock, kind), f"{name}_points", "requested_coverage")]
    parts += [one(conditional_compute(test), "conditional_compute"), many(period_metrics(test, lock), "periods", "period")]
    if bootstrap:
        parts.append(many(group_bootstrap(test, lock, bootstrap, seed, confidence), "bootstrap", "metric"))
    out = one(lock.withColumn("target_fpr", F.lit(target_fpr)), "selection")
    for p in parts:
        out = out.crossJoin(F.broadcast(checkpointed(p)))  # a row, so the driver holds the plan of one part at a time
    return out


def micro_metrics(rows: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, NLL, Brier score and the ECE on confidence with bins open below (label, score at 0.5)."""
    s, y = F.col("score"), F.col("label")
    right = ((s >= 0.5) == (y == 1)).cast("double")
    confidence = S.max_probability(s)
    t = rows.select(*by, "label", right.alias("right"), confidence.alias("confidence"), ((s - y) * (s - y)).alias("square"), (-F.log(F.greatest(F.lit(1e-12), F.when(y == 1, s).otherwise(1.0 - s)))).alias("nll"))
    t = t.withColumn("bin", F.ceil(F.col("confidence") * bins))
    b = t.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum("right").alias("right"), F.sum("confidence").alias("confidence"), F.sum("square").alias("square"), F.sum("nll").alias("nll"),
        F.sum(F.when(y == 1, F.col("right"))).alias("right1"), F.count_if(y == 1).alias("n1"), F.sum(F.when(y == 0, F.col("right"))).alias("right0"), F.count_if(y == 0).alias("n0"))
    n = F.sum("n")
    return b.groupBy(*by).agg(
        (F.sum("right") / n).alias("accuracy"), ((F.coalesce(F.sum("right1"), F.lit(0.0)) / F.greatest(F.lit(1), F.sum("n1")) + F.coalesce(F.sum("right0"), F.lit(0.0)) / F.greatest(F.lit(1), F.sum("n0"))) / 2.0).alias("balanced_accuracy"),
        (F.sum("nll") / n).alias("nll"), (F.sum("square") / n).alias("brier"), (F.sum(F.abs(F.col("right") - F.col("confidence"))) / n).alias("ece"), n.alias("rows"),
    )
