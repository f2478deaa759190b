"""From raw documents to packed training sequences: five stages over the documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.jaccard_join import jaccard_join
from brindle.llm.packed import checkpointed
from brindle.llm.packing import pack_documents
from brindle.llm.quality_ledger import quality_filter
from brindle.llm.substring_dedup import self_dedup
from brindle.llm.surrogates import replace_private

#: the setting that holds the key of the surrogates, and the key of the synthetic tables where it is not set
KEY_SETTING, SYNTHETIC = "spark.brindle.surrogateKey", "key of the synthetic tables"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule of the current policy rejects, unchanged, extra columns included.

    Null and empty texts have no words and go as short ones; rows without doc_id are judged like others. An empty
    table gives no rows.
    """
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id, unchanged, extra columns included.

    Rows without doc_id and texts without words link with nothing and stay. Rows that repeat the doc_id of one that
    stays, stay. An empty table gives no rows.
    """
    members, _ = jaccard_join(docs)
    others = members.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without word windows that occurred before; n_chars as it is then.

    Null texts stay null. Rows without doc_id lose only what they repeat themselves. Extra columns keep their names
    and values, whatever they are called. An empty table gives no rows.
    """
    return _counted(self_dedup(docs), docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars as it is then.

    Null texts stay null; repeated rows get the same surrogates; extra columns keep their names and values. An empty
    table gives no rows. The key of the surrogates is the session's KEY_SETTING.
    """
    return _counted(replace_private(docs, spark.conf.get(KEY_SETTING, SYNTHETIC)), docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    A null or empty text is the end id alone; rows without doc_id and repeated ones are documents of their own; extra
    columns are ignored. An empty table gives no rows.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes).get("n_chars")
    return out.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("private_data", private_data),
    ("packed_sequences", packed_sequences),
]

#: Surrogates and packing have no SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is stored in the shared checkpoint folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
