"""Members of zip, wheel and tar.gz archives as rows, read in memory under limits and never unpacked to disk."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    archive_bytes: int = 50_000_000
    members: int = 5_000
    member_bytes: int = 1_000_000
    source_bytes: int = 20_000_000
    expanded_bytes: int = 200_000_000
    ratio: float = 200.0
    name_length: int = 512


class Unsafe(ValueError):
    pass


def _name(name: str, limits: Limits) -> str:
    parts = name.rstrip("/").split("/")
    if not name or len(name) > limits.name_length or re.search(r"[\x00-\x1f\x7f\\]", name) or name.startswith("/") or re.match("[A-Za-z]:", name) or any(p in ("", ".", "..") for p in parts):
        raise Unsafe(f"unsafe member name {name!r}")
    return name


def _zip(raw: bytes, limits: Limits) -> Iterator[tuple[str, bytes, bool]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos = z.infolist()
        if len(infos) > limits.members:
            raise Unsafe("too many members")
        seen: set[str] = set()
        for i in infos:
            if (key := _name(i.filename, limits).casefold()) in seen:
                raise Unsafe(f"repeated member {i.filename!r}")
            seen.add(key)
            if i.flag_bits & 1:
                raise Unsafe("encrypted member")
            if i.external_attr >> 28 == 0xA:
                raise Unsafe("linked member")
            if i.file_size > limits.ratio * max(1, i.compress_size):
                raise Unsafe("compression ratio")
        if sum(i.file_size for i in infos) > min(limits.expanded_bytes, limits.ratio * max(1, len(raw))):
            raise Unsafe("expanded size")
        for i in infos:
            if i.filename.endswith(".py") and not i.is_dir():
                with z.open(i) as f:
                    data = f.read(limits.member_bytes + 1)
                if len(data) <= limits.member_bytes and len(data) != i.file_size:
                    raise Unsafe("member size differs from its entry")
                yield i.filename, data[: limits.member_bytes], len(data) > limits.member_bytes


def _tar(raw: bytes, limits: Limits) -> Iterator[tuple[str, bytes, bool]]:
    total, seen = 0, set()
    with tarfile.open(fileobj=io.BytesIO(raw), mode="r|gz") as t:
        for n, m in enumerate(t):
            total += m.size
            key = _name(m.name, limits).casefold()
            if n >= limits.members or total > limits.expanded_bytes or total > limits.ratio * max(1, len(raw)):
                raise Unsafe("too many members or bytes")
            if m.isdir():
                continue
            if key in seen or not m.isreg():
                raise Unsafe(f"repeated or special member {m.name!r}")
            seen.add(key)
            if m.name.endswith(".py"):
                data = t.extractfile(m).read(limits.member_bytes)
                yield m.name, data, m.size > limits.member_bytes


def members(name: str, raw: bytes, limits: Limits = Limits()) -> list[tuple[str, bytes, bool]]:
    """(path, payload, truncated) of the Python members in name order; raises Unsafe."""
    if len(raw) > limits.archive_bytes:
        raise Unsafe("archive size")
    lower = name.lower()
    reader = _zip if lower.endswith((".zip", ".whl")) else _tar if lower.endswith((".tar.gz", ".tgz")) else None
    if reader is None:
        raise Unsafe("unknown archive type")
    out, total = [], 0
    try:
        for m in reader(raw, limits):
            total += len(m[1])
            if total > limits.source_bytes:
                raise Unsafe("source size")
            out.append(m)
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, NotImplementedError) as e:
        raise Unsafe(str(e)) from e
    return sorted(out)


SCHEMA = "target_id string, path string, content binary, truncated boolean, error string"


def expand(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row per member of binaryFile rows (path, content); an archive that is refused gives one row with the error."""
    arrow = pa.schema([("target_id", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("truncated", pa.bool_()), ("error", pa.string())])
    bounds = asdict(limits)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                target = (name or "").rsplit("/", 1)[-1]
                try:
                    rows = [(target, p, data, cut, None) for p, data, cut in members(target, raw or b"", Limits(**bounds))]
                except Unsafe as e:
                    rows = [(target, None, None, None, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return archives.select("path", "content").mapInArrow(run, SCHEMA)


def fingerprints(archives: DataFrame, files: DataFrame) -> DataFrame:
    """Per archive: digest of its bytes, content hash of its members whatever their paths, and status."""
    from brindle.functions.tokens import entries_hash, payload_entry

    whole = archives.select(F.substring_index("path", "/", -1).alias("target_id"), F.sha2("content", 256).alias("archive_sha256"), F.length("content").alias("bytes"))
    per = files.groupBy("target_id").agg(F.max("error").alias("error"), F.count("content").alias("python_files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("python_bytes"), F.collect_list(payload_entry(F.col("content"))).alias("c"))
    j = whole.join(per, "target_id", "left")
    status = F.when(F.col("error").isNotNull(), "rejected").when(F.coalesce("python_files", F.lit(0)) == 0, "empty").otherwise("ok")
    return j.select("target_id", "archive_sha256", "bytes", status.alias("status"), "error", F.coalesce("python_files", F.lit(0)).alias("python_files"), F.coalesce("python_bytes", F.lit(0)).alias("python_bytes"), F.when(status == "ok", entries_hash(F.col("c"))).alias("source_set_hash"))
