"""Order-independent fingerprints of tables, over canonical JSON with Python's spelling of numbers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, json): each row's columns as compact JSON with sorted keys, numbers as Python writes them."""
    import pyarrow as pa

    def plain(v):
        return v if v is None or isinstance(v, str | int | float | bool) else str(v)

    def run(batches):
        for b in batches:
            records = b.select(columns).to_pylist()
            text = [json.dumps({k: None if isinstance(v, float) and v != v else plain(v) for k, v in r.items()}, sort_keys=True, separators=(",", ":")) for r in records]
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(text, pa.string())], names=["key", "json"])

    keyed = rows.select(*columns, F.col(key).alias("_k"))
    return keyed.mapInArrow(run, f"key {dict(rows.dtypes)[key]}, json string")


def row_digests(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(digest): SHA-256 of each row as compact JSON with sorted keys."""
    return json_lines(rows, columns, columns[0]).select(F.sha2("json", 256).alias("digest"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: SHA-256 over the sorted row digests.

    Digests are summed by their first three digits (4,096 groups), so no task sorts them all.
    """
    d = row_digests(rows, columns).withColumn("b", F.substring("digest", 1, 3))
    groups = d.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("h"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ","), 256).alias("fingerprint"))


def canonical_fingerprint(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One row: SHA-256 of all rows as one compact JSON list with sorted keys, in the order of key, as reports publish it.

    A digest of one text is sequential: rows are made and sorted in the cluster, and one task streams through their JSON
    in constant memory. For tables too large for that, fingerprint() is the way.
    """
    import pyarrow as pa

    def digest(batches):
        h, first = hashlib.sha256(b"["), True
        for b in batches:
            for text in b.column("json").to_pylist():
                h.update(text.encode() if first else b"," + text.encode())
                first = False
        h.update(b"]")
        yield pa.RecordBatch.from_pydict({"fingerprint": [h.hexdigest()]})

    lines = json_lines(rows, columns, key)
    return lines.repartition(1).sortWithinPartitions("key").select("json").mapInArrow(digest, "fingerprint string")
