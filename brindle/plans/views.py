"""Stand-in views of the driver's tables with the schemas that the operators expect.

Each view is a DataFrame here and a DuckDB common table expression (SQL) below, with the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str, factor: int = 7) -> DataFrame:
    """One row per order; the customer is the group and its market segment the label."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    label = F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)
    part = F.pmod(F.col("o_custkey"), F.lit(4))
    return o.join(c, o.o_custkey == c.c_custkey).withColumn("label", label).select(
        F.col("o_orderkey").cast("string").alias("sample_id"), "label", (((F.col("o_orderkey") * factor + 37 * F.col("label")) % 101 + 20 * F.col("label")).cast("double") / F.lit(120.0)).alias("score"),
        F.when(part == 0, "train").when(part == 1, "validation").otherwise("test").alias("split"), F.col("o_custkey").cast("string").alias("group_id"), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.when(F.col("o_orderpriority").startswith("5"), F.lit(None)).otherwise(F.col("o_orderpriority").substr(1, 1).isin("1", "2")).alias("model_invoked"),
        F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_totalprice")).alias("latency_ms"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: text digest, language as ecosystem, source as package, and derived splits and groups."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    return d.join(l, "doc_id", "left").select(
        k.cast("string").alias("sample_id"), F.coalesce("quality", F.lit(0)).cast("int").alias("label"), F.col("lang").alias("ecosystem"), F.col("source").alias("package"), (k % 7).cast("string").alias("version"),
        F.sha2("text", 256).alias("sha256"), F.concat(F.lit("g"), (k % 41).cast("string")).alias("group_id"), F.date_add(F.to_date(F.lit("2024-01-01")), (k % 365).cast("int")).alias("first_seen"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 3 == 0, "train").when(k % 3 == 1, "validation").otherwise("test").alias("split"),
        F.when(k % 5 != 0, F.sha2(F.regexp_replace(F.lower("text"), "[ \t\r\n]+", " "), 256)).alias("representation_hash"), F.when(k % 2 == 0, F.concat(F.lit("f"), (k % 13).cast("string"))).alias("family"), F.when(k % 4 == 0, F.concat(F.lit("c"), (k % 17).cast("string"))).alias("campaign"),
    )


OPS = (("signup", "ENV_READ"), ("view", "FILE_READ"), ("click", "DECODE"), ("purchase", "NETWORK_SEND"), ("error", "DYNAMIC_EXEC"))


def behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target of event rows: a user is a function, an event type an operation."""
    e = table(spark, sf_dir, "events")
    op = F.create_map(*[F.lit(x) for kv in OPS for x in kv])[F.col("event_type")]
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("target_id"), F.concat(F.lit("pkg/mod"), (F.col("user_id") % 10).cast("string"), F.lit(".py")).alias("path"), F.lit(0).alias("file_ord"),
        (F.col("user_id") * 100000 + F.row_number().over(order)).alias("event_index"), op.alias("op"), F.when(F.col("event_id") % 3 == 0, "API_TOKEN").otherwise("HOME").alias("target"), (F.col("event_id") % 500).cast("int").alias("line"),
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("function"), F.when(F.col("user_id") % 5 == 0, "install").otherwise("runtime").alias("phase"), F.lower(op).alias("detail"),
    )


def closure_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, key): a document and its text, lower-cased text and first line digests."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    keys = F.array(F.concat(F.lit("a"), F.sha2("text", 256)), F.concat(F.lit("b"), F.sha2(F.lower("text"), 256)), F.concat(F.lit("c"), F.sha2(F.substring_index("text", "\n", 1), 256)))
    return d.select(F.col("doc_id").alias("sample"), F.explode(keys).alias("key"))


SQL = {
    "pred": """pred AS (SELECT o_orderkey::VARCHAR sample_id, label, ((((o_orderkey * 7 + 37 * label) % 101) + 20 * label)::DOUBLE / 120.0::DOUBLE) score, (((o_orderkey * 11 + 37 * label) % 101 + 20 * label)::DOUBLE / 120.0::DOUBLE) score_b,
        CASE o_custkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END split, o_custkey::VARCHAR group_id, strftime(o_orderdate, '%Y-%m') period,
        CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority[1] IN ('1', '2') END model_invoked, CASE WHEN o_orderpriority NOT LIKE '4%' THEN o_totalprice END latency_ms
        FROM (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END label FROM orders JOIN customer ON o_custkey = c_custkey))""",
    "manifest": """manifest AS (SELECT d.doc_id::VARCHAR sample_id, coalesce(quality, 0)::INTEGER AS label, lang ecosystem, source package, sha256(text) sha256, 'g' || (d.doc_id % 41) group_id, (DATE '2024-01-01' + (d.doc_id % 365)::INTEGER)::DATE first_seen,
        CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 3 = 0 THEN 'train' WHEN d.doc_id % 3 = 1 THEN 'validation' ELSE 'test' END split,
        CASE WHEN d.doc_id % 5 <> 0 THEN sha256(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) END representation_hash, CASE WHEN d.doc_id % 2 = 0 THEN 'f' || (d.doc_id % 13) END family, CASE WHEN d.doc_id % 4 = 0 THEN 'c' || (d.doc_id % 17) END campaign FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "behavior": """behavior AS (SELECT 't' || (user_id % 10) target_id, 'pkg/mod' || (user_id % 10) || '.py' AS path, user_id * 100000 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) event_index,
        CASE event_type WHEN 'signup' THEN 'ENV_READ' WHEN 'view' THEN 'FILE_READ' WHEN 'click' THEN 'DECODE' WHEN 'purchase' THEN 'NETWORK_SEND' WHEN 'error' THEN 'DYNAMIC_EXEC' END op,
        CASE WHEN event_id % 3 = 0 THEN 'API_TOKEN' ELSE 'HOME' END target, (event_id % 500)::INTEGER line, 'f' || user_id AS function, CASE WHEN user_id % 5 = 0 THEN 'install' ELSE 'runtime' END phase FROM events)""",
}
