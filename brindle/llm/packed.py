"""Shuffle rows that hold numpy arrays: one row for many entries of a bucket.

Entries that go to one bucket travel as one binary cell, so that the JVM handles one row
where it would else handle thousands, and reducers sort them with numpy.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import struct
import time
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "bucket int, kind int, payload binary"
ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        code = a.dtype.str.encode().ljust(4)
        out += [code, struct.pack("<Q", a.nbytes), np.ascontiguousarray(a).tobytes()]
    return b"".join(out)


def unpack(payload: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(payload[0]):
        kind, size = payload[at : at + 4].decode().strip(), struct.unpack_from("<Q", payload, at + 4)[0]
        at += 12
        out.append(np.frombuffer(payload, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def planes(x: np.ndarray, width: int = 8) -> np.ndarray:
    """The lower bytes of sorted 64-bit numbers, bytes of one weight together, which then compress."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width].T).reshape(-1)


def from_planes(x: np.ndarray, width: int = 8) -> np.ndarray:
    if width == 8:
        return np.ascontiguousarray(x.reshape(8, -1).T).reshape(-1).view(np.uint64)
    out = np.zeros((len(x) // width, 8), dtype=np.uint8)
    out[:, :width] = x.reshape(width, -1).T
    return out.reshape(-1).view(np.uint64)


def trim() -> None:
    """Gives freed memory back to the system, as workers live long beside each other."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batches(rows: Iterable[tuple[int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Packed rows as Arrow batches of about that many bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2]) + 16
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), ARROW.types)], schema=ARROW)
            held, size = [], 0
            trim()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), ARROW.types)], schema=ARROW)
    trim()


def rows_of(incoming: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for b in incoming:
        yield from zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), b.column("payload").to_pylist())


def by_bucket(incoming: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """The packed rows of one bucket after another: (bucket, kind -> payloads). Rows come as ``dealt`` sorts them."""
    held: dict[int, list[bytes]] = defaultdict(list)
    last = None
    for bucket, kind, payload in rows_of(incoming):
        if bucket != last and held:
            yield last, held
            held = defaultdict(list)
        last = bucket
        held[kind].append(payload)
    if held:
        yield last, held


def scattered(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of parallel arrays, dealt by bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    for part in np.split(order, np.flatnonzero(np.diff(ordered)) + 1):
        yield int(bucket[part[0]]), [a[part] for a in arrays]


ARROW_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """Keeps what Arrow holds at once small where rows are whole documents; a smaller setting stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_bits(spark: SparkSession) -> int:
    """Buckets are a power of two, at least two to a shuffle partition."""
    return min(20, max(6, (2 * partitions(spark) - 1).bit_length()))


def dealt(df: DataFrame, n: int, bits: int, *then: str) -> DataFrame:
    """Each of 2 ** bits buckets to one of n partitions, as many to each as can be, in order of bucket.

    The sort spills where it must, so readers hold one bucket at a time and not a partition.
    """
    part = F.shiftright(F.col("bucket").cast("long") * n, bits).cast("int")
    return df.repartitionById(n, part).sortWithinPartitions("bucket", *then)


def released(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to, which else stay until the driver's heap fills.

    References go in turns (Python's, the bridge's, those of the last events), so one collection isn't enough.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that spark.checkpoint.dir names, or the context's.

    Where none is set, a local master gets one below /tmp, and any other raises: its executors would not share the folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or "/tmp/brindle-checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, which goes when the driver ends.

    Unlike the rows of a checkpoint, a table tells the planner its size, so small sides are seen to be small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/brindle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
