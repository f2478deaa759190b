"""Whether a model knows enough of a token set to be used: coverage of known tokens and the nearest prototype."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """known (token) and prototypes (group_id, tokens): the first example of each group, by ord."""
    known = examples.select(F.explode("tokens").alias("token")).distinct()
    first = examples.groupBy("group_id").agg(F.min_by("tokens", "ord").alias("tokens")).select("group_id", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    return known, first


def nearest(samples: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(sample_id, nearest): the largest Jaccard similarity to any prototype.

    Sets meet through an equi-join on tokens, so only pairs that share one are counted. The largest similarity needs them
    all: with tokens that nearly every prototype has this is every sample against every prototype, which a profile of one
    prototype a group keeps small.
    """
    s = samples.select("sample_id", F.array_distinct("tokens").alias("t"))
    p = prototypes.select("group_id", F.array_distinct("tokens").alias("t"))
    met = s.select("sample_id", F.size("t").alias("a"), F.explode("t").alias("token")).join(p.select("group_id", F.size("t").alias("b"), F.explode("t").alias("token")), "token")
    pairs = met.groupBy("sample_id", "group_id").agg(F.count("*").alias("both"), F.first("a").alias("a"), F.first("b").alias("b"))
    best = pairs.groupBy("sample_id").agg(F.max(F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("nearest"))
    return samples.select("sample_id").join(best, "sample_id", "left").select("sample_id", F.coalesce("nearest", F.lit(0.0)).alias("nearest"))


def assess(samples: DataFrame, known: DataFrame, prototypes: DataFrame, least_coverage: float = 1.0, least_jaccard: float = 0.2) -> DataFrame:
    """sample_id, token_coverage, nearest, unknown_tokens and supported; an empty token set is never supported."""
    each = samples.select("sample_id", F.explode(F.array_distinct("tokens")).alias("token")).join(known.select("token", F.lit(1).alias("known")), "token", "left")
    cover = each.groupBy("sample_id").agg(F.count("*").alias("n"), F.count("known").alias("k"), F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("token")))).alias("unknown_tokens"))
    j = nearest(samples, prototypes).join(cover, "sample_id", "left")
    coverage = F.coalesce(F.col("k") / F.col("n"), F.lit(0.0))
    ok = F.coalesce(F.col("n") > 0, F.lit(False)) & (coverage >= least_coverage) & (F.col("nearest") >= least_jaccard)
    return j.select("sample_id", coverage.alias("token_coverage"), "nearest", F.coalesce("unknown_tokens", F.array().cast("array<string>")).alias("unknown_tokens"), ok.alias("supported"))


def pair_metrics(scores: DataFrame) -> DataFrame:
    """Scores of (pair_id, variant, label): how often the malicious side ranks higher, and the gaps."""
    p = scores.groupBy("pair_id", "variant").agg(F.max(F.when(F.col("label") == 1, F.col("score"))).alias("hi"), F.max(F.when(F.col("label") == 0, F.col("score"))).alias("lo")).filter("hi is not null and lo is not null")
    gap = F.col("hi") - F.col("lo")
    return p.agg(F.avg((gap > 0).cast("double")).alias("pair_order_accuracy"), F.avg(gap).alias("pair_gap_mean"), F.min(gap).alias("pair_gap_min"), F.count("*").alias("pairs"))


def variant_drift(scores: DataFrame) -> DataFrame:
    g = scores.groupBy("group_id").agg((F.max("score") - F.min("score")).alias("d"))
    return g.agg(F.avg("d").alias("variant_drift_mean"), F.max("d").alias("variant_drift_max"))
