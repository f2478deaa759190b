"""Records of a study: the order of its scans, its support, its links to a plan, and the one-row account of what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import policy as P
from brindle.operators import governance as G


def scan_order(items: DataFrame, seed: int, key: str = "sample_id") -> DataFrame:
    """items with rank, by which they are scanned, and candidate_first, whether the second system goes first on them.

    Both are fixed by the seed before anything is scanned: rank is a digest, and the last digit of another one is odd.
    """
    last = F.substring(P.seeded_rank(seed, "order", F.col(key)), -1, 1)
    return items.withColumn("rank", P.seeded_rank(seed, "scan", F.col(key))).withColumn("candidate_first", F.conv(last, 16, 10).cast("int") % 2 == 1)


def study_support(rows: DataFrame) -> DataFrame:
    """(unit, split, label, n): samples and groups of each split and label."""
    samples = rows.groupBy("split", "label").agg(F.count("*").alias("n")).select(F.lit("samples").alias("unit"), "split", "label", "n")
    groups = rows.groupBy("split", "label").agg(F.count_distinct("group_id").alias("n")).select(F.lit("groups").alias("unit"), "split", "label", "n")
    return samples.unionByName(groups)


def study_problems(rows: DataFrame, splits: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """(problem, value): repeated ids, splits that lack a label, and groups of several labels or splits."""
    ids = rows.groupBy("sample_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("sample_id is not unique").alias("problem"), F.col("sample_id").alias("value"))
    need = rows.sparkSession.createDataFrame([(s, y) for s in splits for y in (0, 1)], "split string, label int")
    lacks = need.join(rows.select("split", F.col("label").cast("int").alias("label")).distinct(), ["split", "label"], "left_anti")
    lacks = lacks.select(F.lit("split lacks a label").alias("problem"), F.concat_ws(" ", "split", "label").alias("value"))
    mixed = rows.groupBy("group_id").agg(F.count_distinct(F.struct("label", "split")).alias("n")).filter("n > 1")
    return ids.unionByName(lacks).unionByName(mixed.select(F.lit("group crosses labels or splits").alias("problem"), F.col("group_id").alias("value")))


LINKED = ("rank", "project", "version", "sha256", "size", "storage_name")


def plan_problems(rows: DataFrame, plan: DataFrame, fields: tuple[str, ...] = LINKED, key: str = "storage_name") -> DataFrame:
    """(key, problem) of rows that do not match exactly one row of an acquisition plan in all fields."""
    once = plan.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*fields)).alias("_plan"))
    j = rows.select(key, F.struct(*fields).alias("_own")).join(once, key, "left")
    differ = [F.when(~F.col(f"_own.{f}").eqNullSafe(F.col(f"_plan.{f}")), F.lit(f)) for f in fields]
    problem = F.when(F.col("_n").isNull(), "is not in the plan").when(F.col("_n") > 1, "is in the plan more than once").when(~F.col("_own").eqNullSafe(F.col("_plan")), F.concat(F.lit("differs in "), F.concat_ws(", ", *differ)))
    return j.select(key, problem.alias("problem")).filter("problem is not null")


def study_record(items: DataFrame, audits: DataFrame, name: str, configuration: dict, claim: str, outputs: DataFrame) -> DataFrame:
    """One row: a study's name, configuration, support, grouping, results and the digests of its outputs, with JSON of it all.

    items have sample_id, label, split and group_id; audits status, python_files, python_bytes, parse_errors, baseline_score
    and candidate_score; outputs path and sha256.
    """
    import platform

    entries = lambda d, k, v, as_: d.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v)))).alias(as_))
    support = study_support(items).withColumn("k", F.concat_ws("_", "unit", "split", F.when(F.col("label") == 1, "malicious").otherwise("benign")))
    parts = [
        entries(support, "k", "n", "support"), G.grouping_summary(items.select(F.col("group_id").alias("group"))).select(F.struct("*").alias("grouping")),
        entries(audits.groupBy("status").agg(F.count("*").alias("n")), "status", "n", "status_counts"),
        audits.agg(
            F.sum("python_files").alias("python_files"), F.sum("python_bytes").alias("python_bytes"), F.sum("parse_errors").alias("parse_errors"),
            F.count_if(F.abs(F.coalesce("candidate_score", F.lit(0.0)) - F.coalesce("baseline_score", F.lit(0.0))) > 1e-12).alias("score_changed"),
        ),
        entries(outputs, "path", "sha256", "output_sha256"),
    ]
    row = items.sparkSession.createDataFrame([(name, {k: str(v) for k, v in configuration.items()}, platform.python_version(), claim)], "study string, configuration map<string,string>, python string, claim_status string")
    for p in parts:
        row = row.crossJoin(F.broadcast(p))  # every part is one row
    return row.withColumn("record", F.to_json(F.struct("*")))
