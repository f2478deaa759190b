"""Checkpoints of dense models: tensors as rows, checked against a manifest of shapes and digests when they are loaded."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "brindle.tensors.v1"
LARGEST = 64 << 20


def exported(weights: dict[str, np.ndarray], details: dict | None = None) -> tuple[bytes, dict]:
    """All tensors as little-endian float32 one after another, and the manifest that tells where each is."""
    raw = [(name, np.ascontiguousarray(w, dtype="<f4")) for name, w in sorted(weights.items())]
    data = b"".join(w.tobytes() for _, w in raw)
    at, tensors = 0, []
    for name, w in raw:
        tensors.append({"name": name, "shape": list(w.shape), "offset": at, "bytes": w.nbytes})
        at += w.nbytes
    return data, {"format": FORMAT, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "tensors": tensors, "details": details or {}}


def imported(data: bytes, manifest: dict) -> dict[str, np.ndarray]:
    """The tensors of exported bytes; raises where digest, bounds, sizes or names are not the manifest's."""
    if manifest.get("format") != FORMAT:
        raise ValueError("unknown checkpoint format")
    if len(data) > LARGEST or len(data) != manifest["bytes"] or hashlib.sha256(data).hexdigest() != manifest["sha256"]:
        raise ValueError("checkpoint bytes differ from their manifest")
    out, end = {}, 0
    for t in sorted(manifest["tensors"], key=lambda t: t["offset"]):
        size = 4 * int(np.prod(t["shape"], dtype=np.int64))
        if t["offset"] != end or t["bytes"] != size or t["name"] in out or any(n < 1 for n in t["shape"]):
            raise ValueError(f"tensor {t['name']!r} does not fit its manifest")
        end += size
        out[t["name"]] = np.frombuffer(data, dtype="<f4", count=size // 4, offset=t["offset"]).reshape(t["shape"])
    if end != len(data):
        raise ValueError("checkpoint holds more than its tensors")
    return out


def save(spark: SparkSession, path: str, weights: dict[str, np.ndarray], details: dict | None = None) -> None:
    """One row (manifest, data) below path; the commit protocol makes the write all or nothing."""
    data, manifest = exported(weights, details)
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True), bytearray(data))], "manifest string, data binary").coalesce(1).write.mode("error").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], dict]:
    """Tensors and details of a checkpoint; its size is checked before its bytes come to the driver."""
    rows = spark.read.parquet(path)
    if rows.filter(F.octet_length("data") > LARGEST).count() or rows.count() != 1:
        raise ValueError("not one checkpoint of a size that can be broadcast")
    r = rows.first()
    manifest = json.loads(r.manifest)
    return imported(bytes(r.data), manifest), manifest["details"]


def tensors(weights: dict[str, np.ndarray], spark: SparkSession) -> DataFrame:
    """(name, shape, offset, bytes) of a checkpoint's manifest."""
    _, m = exported(weights)
    return spark.createDataFrame([(t["name"], t["shape"], t["offset"], t["bytes"]) for t in m["tensors"]], "name string, shape array<int>, offset long, bytes long")
