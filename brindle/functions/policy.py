"""Classification of calls, paths and targets as Spark columns; everything stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import vocabulary as V


def seeds(spark: SparkSession) -> DataFrame:
    """The call table: call_name, op, category, detail."""
    return spark.createDataFrame([(n, op, c, d) for op, c, d, names in V.CALLS for n in names], "call_name string, op string, category string, detail string")


def classify_calls(calls: DataFrame, name: str = "name") -> DataFrame:
    """calls with op, category and detail (null where nothing applies): exact name, then prefix, then suffix."""
    n = F.col(name)
    ends = lambda xs: n.rlike("(?:" + "|".join(map(re.escape, xs)) + ")$")
    begins = n.rlike("^(?:" + "|".join(map(re.escape, V.PROCESS_PREFIXES)) + ")")
    other = (
        F.when(begins, F.struct(F.lit("PROCESS_EXEC").alias("op"), F.lit("sink").alias("category"), F.lit("process or shell execution").alias("detail")))
        .when(ends(V.READ_SUFFIXES), F.struct(F.lit("FILE_READ").alias("op"), F.lit("source").alias("category"), F.lit("file read").alias("detail")))
        .when(ends(V.WRITE_SUFFIXES), F.struct(F.lit("FILE_WRITE").alias("op"), F.lit("sink").alias("category"), F.lit("file write").alias("detail")))
    )
    table = seeds(calls.sparkSession).select("call_name", F.struct("op", "category", "detail").alias("_exact"))
    out = calls.join(F.broadcast(table), n == F.col("call_name"), "left").withColumn("_c", F.coalesce("_exact", other))
    return out.select(*calls.columns, "_c.op", "_c.category", "_c.detail")


def slashed(value: Column) -> Column:
    return F.translate(F.lower(value), "\\", "/")


def contains_marker(value: Column, markers: tuple[str, ...]) -> Column:
    """Whether any marker occurs, lower-cased and with forward slashes; false for null and empty."""
    return F.coalesce(slashed(value).rlike("|".join(map(re.escape, markers))), F.lit(False))


def is_sensitive_env(value: Column) -> Column:
    return contains_marker(value, V.SENSITIVE_ENV)


def is_sensitive_path(value: Column) -> Column:
    return contains_marker(value, V.SENSITIVE_PATH)


def is_persistence_path(value: Column) -> Column:
    return contains_marker(value, V.PERSISTENCE_PATH) | F.coalesce(slashed(value).endswith(".pth"), F.lit(False))


def process_target_class(value: Column) -> Column:
    text = F.trim(slashed(value))
    head = F.regexp_replace(F.regexp_extract(text, r"^(\S+)", 1), "^[\"']+|[\"']+$", "")
    name = F.substring_index(head, "/", -1)
    out = F.lit(None).cast("string")
    for kind, names in reversed(V.PROCESS_CLASSES):
        hit = name.isin(*names) | F.substring_index(name, "_", 1).isin(*names)
        out = F.when(hit | (text == "sys.executable") if kind == "interpreter" else hit, kind).otherwise(out)
    return F.coalesce(out, F.lit("generic"))


def delete_target_class(value: Column) -> Column:
    text = F.trim(slashed(value))
    base = F.substring_index(F.regexp_replace(text, "/+$", ""), "/", -1)
    temporary = base.isin(*V.DELETE_TEMPORARY_NAMES) | base.rlike(r"\.(?:pyc|tmp)$|^(?:cache|tmp)\.") | text.rlike("|".join(map(re.escape, V.DELETE_TEMPORARY_PARTS)))
    framed = F.concat(F.lit("/"), F.regexp_replace(text, "^/+|/+$", ""), F.lit("/"))
    return (
        F.when(value.isNull() | (value == ""), "generic").when(text.isin(*V.DELETE_BROAD) | text.contains("*"), "broad").when(temporary, "temporary")
        .when(framed.rlike("|".join(map(re.escape, V.DELETE_USER_DATA))), "user_data").otherwise("generic")
    )


def is_destructive_delete(value: Column, recursive: Column) -> Column:
    kind = delete_target_class(value)
    return kind.isin("broad", "user_data") | (recursive & (kind != "temporary"))


def model_target_class(op: Column, target: Column) -> Column:
    """The coarse target of a model token."""
    text = F.translate(slashed(target), " ", "_")
    process, delete = F.concat(F.lit("process_"), process_target_class(target)), F.concat(F.lit("delete_"), delete_target_class(target))
    return (
        F.when(op.isin("NETWORK_SEND", "NETWORK_RECEIVE"), "network").when(op == "BROWSER_COOKIE_READ", "browser_session").when(op.isin("SENSITIVE_FILE_READ", "PERSISTENCE_WRITE"), "sensitive")
        .when((op == "ENV_READ") & is_sensitive_env(target), "sensitive")
        .when(op == "PROCESS_EXEC", F.when(target.isin("process_generic", *[f"process_{k}" for k, _ in V.PROCESS_CLASSES]), target).otherwise(process))
        .when(op == "FILE_DELETE", F.when(target.isin("delete_broad", "delete_generic", "delete_temporary", "delete_user_data"), target).otherwise(delete))
        .when(op.isin("FILE_READ", "FILE_WRITE"), "file").when(text.contains("/") | text.startswith("."), "path").otherwise("generic")
    )


def _parts(path: Column) -> tuple[Column, Column]:
    parts = F.split(slashed(path), "/")
    return F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)


def is_auxiliary_path(path: Column) -> Column:
    """Tests, documentation, examples and benchmarks, by directory or file name."""
    folders, name = _parts(path)
    return F.arrays_overlap(folders, F.array(*map(F.lit, V.AUXILIARY_PARTS))) | (name == "conftest.py") | name.startswith("test_") | name.endswith("_test.py")


def is_orchestration_path(path: Column) -> Column:
    folders, name = _parts(path)
    return is_auxiliary_path(path) | F.arrays_overlap(folders, F.array(*map(F.lit, V.ORCHESTRATION_PARTS))) | name.isin(*V.ORCHESTRATION_FILES)


def verdict(score: Column) -> Column:
    out = F.lit(V.VERDICTS[-1][1])
    for least, name in reversed(V.VERDICTS[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def lifecycle_phase(path: Column, function: Column, is_import: Column) -> Column:
    """import for imports, install for module-level code of a setup script, else runtime."""
    setup = F.substring_index(slashed(path), "/", -1) == "setup.py"
    return F.when(is_import, "import").when(setup & (function == "<module>"), "install").otherwise("runtime")


def label(value: Column) -> Column:
    """0 or 1 from the accepted spellings; anything else, booleans included, raises when read."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(*V.NEGATIVE_LABELS), 0).when(text.isin(*V.POSITIVE_LABELS), 1).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(text, F.lit("null")))).cast("int"))


def safe_member_name(name: Column) -> Column:
    """Whether an archive member's name is relative, without NUL, control characters, backslashes, or empty, . and .. parts."""
    parts = F.split(F.regexp_replace(name, "/$", ""), "/")
    return ~(F.coalesce(name, F.lit("")).rlike(r"[\x00-\x1f\x7f\\]") | name.startswith("/") | name.rlike("^[A-Za-z]:") | F.exists(parts, lambda x: x.isin("", ".", "..")))


def display_path(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^" + re.escape(root.rstrip("/") + "/"), "")


def seeded_rank(seed: int, namespace: str, value: Column) -> Column:
    """The digest by which a seed orders values within a namespace."""
    return F.sha2(F.concat_ws("\x00", F.lit(str(seed)), F.lit(namespace), value.cast("string")), 256)
