"""Contract-checked readers: files of a tree, prediction rows, manifests, training rows and corpus lists.

A row that breaks its contract raises when it is read; problems() lists all breaches instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import policy as P
from brindle.functions import vocabulary as V

PREDICTION = "sample_id string, label string, score double, split string, group_id string, period string, model_invoked boolean, latency_ms double"
MANIFEST = "sample_id string, ecosystem string, package string, version string, sha256 string, group_id string, provenance string, license string, content_kind string, label string, first_seen string, split string, representation_hash string, family string, campaign string"
OPTIONAL = {"period", "model_invoked", "latency_ms", "split", "representation_hash", "family", "campaign"}
# Payload fields that metadata rows must not have, and the longest text of a field.
FORBIDDEN = ("archive", "archive_path", "bytes", "content", "path", "payload", "source", "tokens")
LONGEST = 2048


MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 10_000, 1_000_000, 100_000_000


def walk_key(relative: Column) -> Column:
    """Sorts paths as a walk does: the files of a folder, then its folders, each by name."""
    parts = F.split(relative, "/")
    return F.transform(parts, lambda x, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), x))


def plan_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, max_files: int = MAX_FILES, max_total: int = MAX_TOTAL_BYTES) -> DataFrame:
    """(path, relative, length, state) of files (path, relative, length): what a scan of a folder takes, in walk order.

    state is taken, oversized, unreadable (no length), or the limit that ends the scan, for the first file that breaks
    it; files behind that one and files below excluded folders have no row. Limits concern max_files files at most, so
    that many are sorted, however many there are.
    """
    parts = F.split("relative", "/")
    inside = F.lower("relative").endswith(".py") & ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, V.EXCLUDED_DIRECTORIES)))
    rows = files.filter(inside).select("path", "relative", "length", walk_key(F.col("relative")).alias("k"))
    fits = F.col("length") <= max_bytes
    order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    first = rows.filter(fits).orderBy("k").limit(max_files + 1)
    n, total = F.count("*").over(order), F.sum("length").over(order)
    run = first.withColumn("state", F.when(n > max_files, "file limit reached").when(total > max_total, "total byte limit reached").otherwise("taken"))
    ends = run.agg(F.min(F.when(F.col("state") != "taken", F.struct("k", "state"))).alias("stop"), F.max(F.when(F.col("state") == "taken", F.col("k"))).alias("last"), F.count_if(F.col("state") == "taken").alias("n"))
    # the file limit ends the scan at the next file of any size
    after = rows.crossJoin(F.broadcast(ends)).filter((F.col("n") >= max_files) & (F.col("k") > F.col("last"))).agg(F.min("k").alias("k"))
    stop = ends.crossJoin(F.broadcast(after.select(F.col("k").alias("next")))).select(
        F.least("stop.k", "next").alias("at"), F.when(F.col("next").isNotNull(), "file limit reached").otherwise(F.col("stop.state")).alias("why")
    )
    taken = run.filter("state = 'taken'").select("path", "relative", "length", "state", "k")
    left = rows.filter(~F.coalesce(fits, F.lit(False))).withColumn("state", F.when(F.col("length").isNull(), "unreadable").otherwise("oversized")).select(*taken.columns)
    both = taken.unionByName(left).crossJoin(F.broadcast(stop)).filter(F.col("at").isNull() | (F.col("k") < F.col("at"))).select("path", "relative", "length", "state")
    breach = rows.crossJoin(F.broadcast(stop)).filter(F.col("k") == F.col("at")).select("path", "relative", "length", F.col("why").alias("state"))
    return both.unionByName(breach)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, length, content) of the Python files below root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][yY]").option("recursiveFileLookup", True).load(root)
    return files.select("path", P.display_path(F.regexp_replace("path", "^[A-Za-z]+:/*(?=/)", ""), root).alias("relative"), "length", "content")


def source_files(spark: SparkSession, root: str, target: str = "target", max_bytes: int = MAX_FILE_BYTES, max_files: int = MAX_FILES, max_total: int = MAX_TOTAL_BYTES) -> DataFrame:
    """(target_id, path, content) of the Python files below root that plan_files takes; contents are read only of these."""
    files = listed(spark, root)
    taken = plan_files(files.drop("content"), max_bytes, max_files, max_total).filter("state = 'taken'")
    return files.select("path", "content").join(taken, "path").select(F.lit(target).alias("target_id"), F.col("relative").alias("path"), "content")


@dataclass(frozen=True)
class Caps:
    """Most bytes and rows of an input, and most bytes of a line; none by default, as inputs here may be large tables."""

    total_bytes: int | None = None
    rows: int | None = None
    line_bytes: int | None = None

    def __post_init__(self):
        if any(x is not None and x < 1 for x in (self.total_bytes, self.rows, self.line_bytes)):
            raise ValueError("caps are positive")


#: what a command line on one machine holds its inputs to
ONE_MACHINE = Caps(20_000_000, 1_000_000, 1_000_000)


def capped(lines: DataFrame, caps: Caps) -> DataFrame:
    """lines (value), which raise when read where the input is over its caps; blank lines count as bytes only."""
    if caps == Caps():
        return lines
    most = lambda v, limit: F.lit(False) if limit is None else F.coalesce(v > limit, F.lit(False))
    size = F.octet_length("value") + 1
    total = lines.agg(F.sum(size).alias("b"), F.count_if(F.trim("value") != "").alias("n"), F.max(size).alias("longest"))
    why = F.when(most(F.col("b"), caps.total_bytes), "too many bytes").when(most(F.col("longest"), caps.line_bytes), "a line is too long").when(most(F.col("n"), caps.rows), "too many rows")
    checked = lines.crossJoin(F.broadcast(total.select(why.alias("_why"))))
    return checked.filter(F.when(F.col("_why").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("input over its caps: "), "_why")).cast("boolean"))).select("value")


def _checked(lines: DataFrame, fields: str, extra: list[tuple[Column, str]], forbidden: tuple[str, ...] = ()) -> DataFrame:
    """Parsed lines with a problem column, null where a row keeps the contract."""
    names = [f.split()[0] for f in fields.split(", ")]
    keys = F.json_object_keys("value")
    d = lines.filter(F.trim("value") != "").select("value", F.from_json("value", fields, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"}).alias("r"), keys.alias("k"))
    d = d.select("value", "k", "r.*")
    tests = [
        (F.col("k").isNull(), "is not a JSON object"), (F.arrays_overlap("k", F.array(*map(F.lit, forbidden or ("\x00",)))), "holds a payload field"), (F.size(F.array_except("k", F.array(*map(F.lit, names)))) > 0, "has unknown fields"),
        (F.col("value").rlike(r":\s*-?(?:NaN|Infinity)\b"), "has a non-finite number"), *[(F.col(n).isNull(), f"lacks {n}") for n in names if n not in OPTIONAL],
        *[((F.trim(n) == "") | (F.length(n) > LONGEST), f"{n} is blank or too long") for n, t in (f.split() for f in fields.split(", ")) if t == "string"], *extra,
    ]
    problem = F.lit(None).cast("string")
    for test, what in reversed(tests):
        problem = F.when(F.coalesce(test, F.lit(False)), what).otherwise(problem)
    d = d.withColumn("problem", problem)
    repeated = F.count("*").over(Window.partitionBy("sample_id")) > 1
    return d.withColumn("problem", F.coalesce("problem", F.when(repeated & F.col("sample_id").isNotNull(), "sample_id is not unique"))).drop("k")


def _raising(d: DataFrame) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("row "), F.col("problem"), F.lit(": "), F.substring("value", 1, 200)))
    return d.filter(F.when(F.col("problem").isNull(), True).otherwise(bad.cast("boolean"))).drop("problem", "value")


def _label_tests() -> list[tuple[Column, str]]:
    raw = F.lower(F.trim("label"))
    return [(~raw.isin(*V.NEGATIVE_LABELS, *V.POSITIVE_LABELS), "has an unknown label"), (F.col("value").rlike(r'"label"\s*:\s*(?:true|false)'), "has a boolean label")]


def prediction_problems(lines: DataFrame) -> DataFrame:
    """Rows of JSON lines (value) with the problem of each, null where it keeps the contract."""
    tests = [*_label_tests(), (~F.col("score").between(0.0, 1.0), "score is not in [0, 1]"), (~F.col("split").isin(*V.SPLITS), "has an unknown split"), (F.col("latency_ms") < 0, "latency is negative"), (F.col("split").isNull(), "lacks split")]
    return _checked(lines, PREDICTION, tests)


def predictions(spark: SparkSession, path: str, caps: Caps = Caps()) -> DataFrame:
    return _raising(prediction_problems(capped(spark.read.text(path), caps))).withColumn("label", P.label(F.col("label")))


def manifest_problems(lines: DataFrame) -> DataFrame:
    tests = [*_label_tests(), (~F.col("sha256").rlike("^[0-9a-f]{64}$"), "sha256 is not lower-case hex"), (~F.col("first_seen").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date("first_seen", "yyyy-MM-dd").isNull(), "first_seen is not a date"), (F.col("split").isNotNull() & ~F.col("split").isin(*V.SPLITS), "has an unknown split")]
    return _checked(lines, MANIFEST, tests, FORBIDDEN)


def manifest(spark: SparkSession, path: str, caps: Caps = Caps()) -> DataFrame:
    return _raising(manifest_problems(capped(spark.read.text(path), caps))).withColumn("label", P.label(F.col("label"))).withColumn("first_seen", F.to_date("first_seen"))


TRAINING = "sample_id string, group_id string, split string, role string, pair_id string, variant string, label string, tokens array<string>, source string, source_path string, path string"


def training_rows(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """sample_id, group_id, split, role, pair_id, label, tokens and source of JSON lines (value), with defaults.

    A row has tokens, or source to be read by the frontend, or path of one of files (path, content). Raises when read
    where a row has unknown fields, none of the three, a path without a file, or a sample_id that another has.
    """
    names = [f.split()[0] for f in TRAINING.split(", ")]
    raw = lines.filter(F.trim("value") != "").select(F.from_json("value", TRAINING, {"mode": "FAILFAST"}).alias("r"), F.json_object_keys("value").alias("k")).select("r.*", "k")
    if files is not None:
        raw = raw.join(files.select("path", F.decode("content", "utf-8").alias("_file")), "path", "left")
    else:
        raw = raw.withColumn("_file", F.lit(None).cast("string"))
    text = F.coalesce("source", "_file")
    none = F.col("tokens").isNull() & text.isNull()
    problem = F.when(F.size(F.array_except("k", F.array(*map(F.lit, names)))) > 0, "unknown fields").when(none & F.col("path").isNotNull(), "no such file").when(none, "neither tokens nor source")
    digest = F.sha2(F.coalesce(F.to_json("tokens"), text), 256)
    rows = raw.select(
        F.coalesce("sample_id", digest).alias("sample_id"), F.coalesce("group_id", "sample_id", digest).alias("group_id"), F.coalesce("split", F.lit("train")).alias("split"), F.coalesce("role", F.lit("example")).alias("role"), "pair_id",
        P.label(F.when(F.col("label") == "true", "1").when(F.col("label") == "false", "0").otherwise(F.col("label"))).alias("label"), "tokens", F.when(F.col("tokens").isNull(), text).alias("source"), F.coalesce("source_path", "path", F.lit("<row>")).alias("source_path"), problem.alias("_p"),
    )
    again = F.count("*").over(Window.partitionBy("sample_id")) > 1
    rows = rows.withColumn("_p", F.coalesce("_p", F.when(again, "sample_id is not unique")))
    return rows.filter(F.when(F.col("_p").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("training row: "), "_p")).cast("boolean"))).drop("_p")


def study_rows(spark: SparkSession, path: str, schema: str, caps: Caps = ONE_MACHINE) -> DataFrame:
    """JSON lines of a study's own files by an explicit schema; a malformed line or an input over its caps raises."""
    return capped(spark.read.text(path), caps).filter(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def corpus_list(spark: SparkSession, path: str, ecosystem: str | None = None) -> DataFrame:
    """folder_name, ecosystem, label of a CSV with exactly these headers."""
    d = spark.read.option("header", True).csv(path)
    if d.columns != ["folder_name", "ecosystem", "label_true"]:
        raise ValueError(f"unexpected headers {d.columns}")
    d = d.select("folder_name", "ecosystem", P.label(F.col("label_true")).alias("label"))
    return d if ecosystem is None else d.filter(F.col("ecosystem") == ecosystem)


def remaining(plan: DataFrame, journal: DataFrame, key: str = "rank") -> DataFrame:
    """What a journal has not done yet."""
    return plan.join(journal.select(key).distinct(), key, "left_anti")


def journal_candidates(journal: DataFrame, key: str = "rank") -> DataFrame:
    """The latest candidate entry of each rank."""
    newest = F.max_by(F.struct(*[c for c in journal.columns if c != key]), "attempt")
    return journal.groupBy(key).agg(newest.alias("r")).select(key, "r.*").filter("status = 'candidate'")


def storage_name(project: Column, version: Column, filename: Column, sha256: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(project), "[-_.]+", "-"), F.lit("-"), version, F.lit("-"), F.substring(sha256, 1, 12), F.lit("-"), F.substring_index(filename, "/", -1))
