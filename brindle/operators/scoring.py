"""Evidence, rule scores by five strategies, verdicts and fusion with a model, per target.

Events and paths are rows of patterns.py. Every score is a few aggregates per target; nothing is collected per target but
at most eight largest values, so a target with very many events is as cheap as many small ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import policy as P
from brindle.functions import vocabulary as V
from brindle.sources.storage import checkpointed

EXACT = ("dataflow", "summary")
STRONG = ("dataflow", "summary", "structural")
MOST_EVIDENCE = 12


def evidence(events: DataFrame, paths: DataFrame, limited: DataFrame | None = None) -> DataFrame:
    """Weighted events, paths and hit event limits (target_id, path) as rows.

    context_path and function are those of the event, or of a path's first event; kind is event or the path's evidence kind;
    name is the operation or motif; event_index and covered tie events to the paths that cover them.
    """
    weight = F.create_map(*[F.lit(x) for kv in V.WEIGHTS.items() for x in kv])
    own = events.withColumn("score", weight[F.col("op")]).filter("score is not null").select(
        "target_id", "path", F.col("path").alias("context_path"), "function", F.lit("event").alias("kind"), F.col("op").alias("name"), "score", F.col("detail").alias("reason"), F.col("line").cast("int").alias("line"), "op",
        F.col("event_index").cast("long").alias("event_index"), F.lit(None).cast("array<long>").alias("covered"), F.lit(None).cast("string").alias("confidence"),
    )
    first = events.select("target_id", "path", F.col("event_index").cast("long").alias("first"), "function", F.col("line").cast("int").alias("line"))
    p = paths.withColumn("first", F.element_at("event_indexes", 1).cast("long")).join(first, ["target_id", "path", "first"])
    found = p.select(
        "target_id", "path", F.col("path").alias("context_path"), "function", F.col("evidence_kind").alias("kind"), F.col("motif").alias("name"), "score", "reason", "line", F.lit("BEHAVIOR_PATH").alias("op"),
        F.lit(None).cast("long").alias("event_index"), F.col("event_indexes").cast("array<long>").alias("covered"), "confidence",
    )
    out = own.unionByName(found)
    if limited is not None:
        out = out.unionByName(limited.select(
            "target_id", "path", F.col("path").alias("context_path"), F.lit("<module>").alias("function"), F.lit("event").alias("kind"), F.lit("ANALYSIS_LIMIT").alias("name"), F.lit(V.LIMIT_WEIGHT).alias("score"),
            F.lit(V.LIMIT_REASON).alias("reason"), F.lit(0).alias("line"), F.lit("ANALYSIS_LIMIT").alias("op"), F.lit(None).cast("long").alias("event_index"), F.lit(None).cast("array<long>").alias("covered"), F.lit(None).cast("string").alias("confidence"),
        ))
    return out


def ranked_evidence(rows: DataFrame, most: int | None = MOST_EVIDENCE) -> DataFrame:
    """Per target and (kind, name) the best row and the number of rows, in order; the first most of them."""
    best = F.min_by(F.struct("score", "reason", "path", "line", "op", "confidence"), F.struct(-F.col("score"), "path", "line", "op")).alias("b")
    g = rows.groupBy("target_id", "kind", "name").agg(best, F.count("*").alias("occurrences")).select("target_id", "kind", "name", "b.*", "occurrences")
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("score"), "path", "line", "op", "kind", "name"))
    g = g.withColumn("rank", rank)
    return g if most is None else g.filter(F.col("rank") <= most)


def _top(rows: DataFrame, by: list[str], k: int, score: str = "score") -> DataFrame:
    """Sum of the k largest scores per key; the key's rows are already few (one per name), or are cut by partial ranks."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score)))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy(*by).agg(F.sum(score).alias("score"))


def _targets(rows: DataFrame, scores: DataFrame) -> DataFrame:
    return rows.select("target_id").distinct().join(scores, "target_id", "left").select("target_id", F.least(F.lit(100.0), F.coalesce("score", F.lit(0.0))).alias("score"))


def _uncovered_by_summaries(rows: DataFrame) -> DataFrame:
    covered = rows.filter("kind = 'summary'").select("target_id", "path", F.explode("covered").alias("event_index")).distinct()
    return rows.join(covered, ["target_id", "path", "event_index"], "left_anti")


def semantic_top8(rows: DataFrame) -> DataFrame:
    """Each kind of evidence counts once, at its best; the eight best add up. Events under a summary path do not count."""
    best = _uncovered_by_summaries(rows).groupBy("target_id", "kind", "name").agg(F.max("score").alias("score"))
    return _targets(rows, _top(best, ["target_id"], 8))


def legacy_top8(rows: DataFrame) -> DataFrame:
    """The eight best rows add up, repeats included. At most eight of each score matter, so rows are counted first."""
    counted = _uncovered_by_summaries(rows).groupBy("target_id", "score").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("target_id").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), 8 - before))
    return _targets(rows, counted.withColumn("s", F.col("score") * taken).groupBy("target_id").agg(F.sum("s").alias("score")))


def lexical_top8(rows: DataFrame) -> DataFrame:
    """The profile of the lexical frontend: events under an install-time network pattern do not count; each kind once; the eight best.

    Also returns how many rows repeat a kind (suppressed).
    """
    covered = rows.filter("kind = 'structural' and name = 'install_time_network_access'").select("target_id", "path", F.explode("covered").alias("event_index")).distinct()
    left = rows.join(covered, ["target_id", "path", "event_index"], "left_anti")
    best = left.groupBy("target_id", "kind", "name").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    more = best.groupBy("target_id").agg((F.sum("n") - F.count("*")).alias("suppressed"))
    return _targets(rows, _top(best, ["target_id"], 8)).join(more, "target_id", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(0)))


CONTEXT = ["target_id", "context_path", "function"]


def context_max(rows: DataFrame) -> DataFrame:
    """Within a function each kind of evidence counts once and the four best add up; the best function counts."""
    best = rows.groupBy(*CONTEXT, "kind", "name").agg(F.max("score").alias("score"))
    return _targets(rows, _top(best, CONTEXT, 4).groupBy("target_id").agg(F.max("score").alias("score")))


def _groups(rows: DataFrame, kinds: tuple[str, ...] | None) -> DataFrame:
    """One row per (context, kind, name): best score, the strongest event that paths of these kinds cover, and kept.

    Events and what covers them meet once, by event; then one aggregate makes the groups. Event groups are kept where
    some event of theirs is not covered; path groups always.
    """
    own = rows.filter("event_index is not null").select(*CONTEXT, "path", "event_index", F.col("score").alias("event_score"), F.col("name").alias("event"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"))
    paths = rows.filter("covered is not null")
    covering = paths if kinds is None else paths.filter(F.col("kind").isin(*kinds))
    cover = covering.select(*CONTEXT, "path", F.explode("covered").alias("event_index"), F.lit(None).cast("double").alias("event_score"), F.lit(None).cast("string").alias("event"), "kind", "name")
    met = own.unionByName(cover).groupBy(*CONTEXT, "path", "event_index").agg(
        F.max("event_score").alias("event_score"), F.max("event").alias("event"), F.collect_set(F.when(F.col("kind").isNotNull(), F.struct("kind", "name"))).alias("by"),
    )
    none, zero = F.lit(None).cast("double"), F.lit(0)
    part = lambda kind, name, score, strongest, free: F.struct(kind.alias("kind"), name.alias("name"), score.alias("score"), strongest.alias("strongest"), free.alias("free"))
    event = F.when(F.col("event").isNotNull(), F.array(part(F.lit("event"), F.col("event"), F.col("event_score"), none, (F.size("by") == 0).cast("int"))))
    covered = F.transform("by", lambda x: part(x["kind"], x["name"], none, F.col("event_score"), zero))
    spread = met.select(*CONTEXT, F.explode(F.concat(F.coalesce(event, F.array().cast("array<struct<kind:string,name:string,score:double,strongest:double,free:int>>")), covered)).alias("g")).select(*CONTEXT, "g.*")
    # events under an analysis limit have no index, and no path covers them
    bare = rows.filter("event_index is null and covered is null").select(*CONTEXT, "kind", "name", "score", none.alias("strongest"), F.lit(1).alias("free"))
    whole = paths.select(*CONTEXT, "kind", "name", "score", none.alias("strongest"), F.lit(1).alias("free"))
    g = spread.unionByName(bare).unionByName(whole).groupBy(*CONTEXT, "kind", "name")
    return g.agg(F.max("score").alias("score"), F.coalesce(F.max("strongest"), F.lit(0.0)).alias("strongest"), F.max("free").alias("free")).filter("free = 1 and score is not null").drop("free")


def context_cover(rows: DataFrame) -> DataFrame:
    """Strong paths absorb the events they cover and count at least as much as the strongest of them."""
    best = _groups(rows, STRONG).select(*CONTEXT, F.greatest("score", "strongest").alias("score"))
    return _targets(rows, _top(best, CONTEXT, 4).groupBy("target_id").agg(F.max("score").alias("score")))


def contributions(rows: DataFrame) -> DataFrame:
    """What each kind of evidence adds to its context under the causal strategy."""
    exact = F.max(F.col("kind").isin(*EXACT).cast("int")).over(Window.partitionBy(*CONTEXT, "name")) == 1
    strongest = F.col("strongest")
    score = (
        F.when(F.col("kind") == "proximity", F.col("score") + strongest)
        .when((F.col("kind") == "structural") & (F.col("name") == "destructive_file_action"), F.when(strongest > 0, strongest).otherwise(F.col("score")))
        .otherwise(F.greatest("score", "strongest"))
    )
    g = _groups(rows, None).withColumn("dominated", (F.col("kind") == "proximity") & exact).filter(~F.col("dominated"))
    return g.select(*CONTEXT, "kind", "name", score.alias("score"))


def context_causal(rows: DataFrame) -> DataFrame:
    """Context-only operations count once together; test and documentation paths take their best; scripts the two best causes."""
    c = contributions(rows)
    path, only = F.col("context_path"), (F.col("kind") == "event") & F.col("name").isin(*V.CONTEXT_ONLY)
    c = c.withColumn("role", F.when(P.is_auxiliary_path(path), "auxiliary").when(P.is_orchestration_path(path), "orchestration").otherwise("code"))
    cause = F.col("kind").isin(*EXACT) | (F.col("kind") == "structural") & F.col("name").isin("install_time_execution", "persistence_write")
    flow = F.max(F.col("kind").isin(*EXACT).cast("int")).over(Window.partitionBy(*CONTEXT)) == 1
    c = c.withColumn("cause", cause).withColumn("flow", flow)
    best = c.filter((F.col("role") == "auxiliary") | (F.col("role") == "orchestration") & ~F.col("flow")).groupBy(*CONTEXT).agg(F.max("score").alias("score"))
    causes = _top(c.filter((F.col("role") == "orchestration") & F.col("flow") & F.col("cause")), CONTEXT, 2)
    code = c.filter("role = 'code'").withColumn("only", only)
    kept = code.filter("not only").select(*CONTEXT, "score").unionByName(code.filter("only").groupBy(*CONTEXT).agg(F.max("score").alias("score")))
    every = reduce(DataFrame.unionByName, [best, causes, _top(kept, CONTEXT, 4)])
    return _targets(rows, every.groupBy("target_id").agg(F.max("score").alias("score")))


STRATEGIES = {"semantic-top8-v1": semantic_top8, "legacy-top8": legacy_top8, "context-max-v1": context_max, "context-cover-v2": context_cover, "context-causal-v6": context_causal}


def rule_scores(rows: DataFrame, strategies: tuple[str, ...] = ("semantic-top8-v1",)) -> DataFrame:
    """(target_id, system, score) by the named strategies."""
    if unknown := set(strategies) - set(STRATEGIES):
        raise ValueError(f"unknown strategies: {', '.join(sorted(unknown))}")
    rows = checkpointed(rows)  # every strategy reads the evidence several times
    return reduce(DataFrame.unionByName, [STRATEGIES[s](rows).withColumn("system", F.lit(s)) for s in strategies])


def fused_risk(rule: Column, probability: Column, supported: Column, low: float = 20.0, high: float = 80.0, weight: float = 0.65) -> Column:
    """The rule score, or its mean with the model's where the model supports the target and rules are unsure; never less."""
    used = supported & rule.between(low, high) & probability.isNotNull()
    return F.when(used, F.greatest(rule, 100.0 * (weight * (rule / 100.0) + (1.0 - weight) * probability))).otherwise(rule)


def decide(scores: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """(target_id, rule_score, probability, supported, model_used, risk_score, verdict); model has target_id, probability, supported."""
    s = scores.select("target_id", F.col("score").alias("rule_score"))
    if model is None:
        s = s.withColumn("probability", F.lit(None).cast("double")).withColumn("supported", F.lit(None).cast("boolean"))
    else:
        s = s.join(model.select("target_id", "probability", "supported"), "target_id", "left")
    ok = F.coalesce("supported", F.lit(False))
    risk = fused_risk(F.col("rule_score"), F.col("probability"), ok)
    used = ok & F.col("rule_score").between(20.0, 80.0) & F.col("probability").isNotNull()
    return s.select("target_id", "rule_score", "probability", "supported", used.alias("model_used"), risk.alias("risk_score"), P.verdict(risk).alias("verdict"))
