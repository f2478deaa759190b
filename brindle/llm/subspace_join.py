"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to length one, so cosine >= c means squared distance <= 2 - 2c. All are turned by
one fixed random rotation, which spreads any difference evenly, and split into blocks of WIDTH
dimensions. If every block of two vectors were farther apart than its share of that budget
(proportional to its dimensions), the sum would exceed the budget; so close vectors are within
the share in one block at least. Each block is range-joined on a grid of its first dimensions
with cells as wide as the share's radius: a vector visits its own cell and is copied to half of the
neighbours.

The grid is met twice. First only the block itself travels, a byte a dimension: a row is a candidate in a cell if some
other row there is within the share, widened by the rounding to bytes. Cells of more than CROWD rows keep all theirs.
Then whole vectors go to the cells where they are candidates. A pair found in several blocks counts in the first block
that is within its share, and is verified with the exact cosine of the unrotated vectors in double precision.

Exact copies (same label and bytes) are one vector with a multiplicity. A cell is cut into tiles of
TILE vectors, and pairs of tiles are tasks of their own, so neither memory nor a single task grows
with a crowded cell. Pairs are counted inside the tasks and never written out; only per-vector
counts and a spanning forest of each tile pair's links leave them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import packed, words
from brindle.llm.components import connected_components
from brindle.llm.packed import checkpointed

WIDTH = 16
GRID = 2
TILE = 2048
CROWD = 8192
SCALE = 127.0
COSINE = 0.98
SLACK = 1e-5  # on squared distances, above the rounding of float32 input in double arithmetic


def rotation(d: int, seed: int = 20240613) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _bounds(d: int, width: int) -> list[tuple[int, int]]:
    return [(a, min(a + width, d)) for a in range(0, d, width)]


def _rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length, held as bytes of doubles or floats, as a matrix of doubles."""
    values = column.to_pylist()
    kind = values[0][:1]
    return np.stack([np.frombuffer(v, dtype="<f4" if kind == b"f" else "<f8", offset=1) for v in values]).astype(np.float64)


def _read(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes with a digest of label and bytes; the others with nulls."""
    schema = pa.schema([("vec_id", pa.int64()), ("sig", pa.binary()), ("label", pa.string()), ("dims", pa.int32()), ("v", pa.binary())])
    for batch in incoming:
        rows = []
        single = pa.types.is_float32(batch.column("embedding").type.value_type)
        for k, label, v in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding")):
            x = None
            if k is not None and label is not None and v.is_valid and len(v) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False) + 0.0  # one zero for both signs
                if not np.isfinite(x).all() or not x.any():
                    x = None
            if x is None:
                rows.append((k, None, None, None, None))
            else:
                raw = b"f" + x.astype("<f4").tobytes() if single else b"d" + x.astype("<f8").tobytes()
                rows.append((k, hashlib.blake2b(f"{len(label)}|{label}|".encode() + raw, digest_size=16).digest(), label, len(x), raw))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _label_hash(label: str, d: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{d}|{label}".encode(), digest_size=8).digest(), "little")


def _place(cosine: float, width: int, grid: int, bits: int):
    """Each vector's blocks to its grid cells: its own (home) and the neighbours that come after it; packed by bucket."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed.batches(rows(incoming))

    def rows(incoming):
        for batch in incoming:
            groups: dict[int, list[int]] = {}
            for i, v in enumerate(batch.column("dims").to_pylist()):
                groups.setdefault(v, []).append(i)
            for d, mine in groups.items():
                for some in np.array_split(mine, -(-len(mine) // 2048)):
                    part = batch.take(pa.array(some))
                    y = _unit(_rows(part.column("v"))) @ rotation(d)
                    labels = np.array([_label_hash(x, d) for x in part.column("label").to_pylist()], dtype=np.uint64)
                    yield from placed(d, y, labels, part.column("rep").to_numpy())

    def placed(d, y, labels, rep):
        budget = 2 - 2 * cosine + SLACK
        for k, (a, b) in enumerate(_bounds(d, width)):
            radius = np.sqrt(budget * (b - a) / d)
            cell = np.floor(y[:, a : min(a + grid, b)] / radius).astype(np.int64)
            part = np.round(y[:, a:b] * SCALE).astype(np.int8)
            for step in _half(cell.shape[1]):
                g = labels ^ words.mix(np.full(len(rep), k + 1, dtype=np.uint64))
                for c in (cell + step).T:
                    g = words.mix(g ^ c.view(np.uint64))
                home = not any(step)
                for bucket, (h, r, p) in packed.scattered((g >> np.uint64(64 - bits)).astype(np.int64), g, rep, part):
                    yield bucket, 2 * k + home, packed.pack(np.array([d]), h, r, p)

    return run


def _candidates(cosine: float, width: int):
    """Reduce side: rows of a cell that have another within the block's share; (g, block, home, rep)."""
    schema = pa.schema([("g", pa.int64()), ("block", pa.int32()), ("home", pa.bool_()), ("rep", pa.int64())])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kinds in packed.by_bucket(incoming):
            for k in sorted({kind // 2 for kind in kinds}):
                # vectors of other lengths have other cells, but may share a bucket
                by_length: dict[int, list] = {}
                for home in (1, 0):
                    for p in kinds.pop(2 * k + home, ()):
                        d, h, r, part = packed.unpack(p)
                        by_length.setdefault(int(d[0]), []).append((h, r, np.full(len(h), bool(home)), part.reshape(len(h), -1)))
                for d, columns in sorted(by_length.items()):
                    g, rep, home, part = (np.concatenate(c) for c in zip(*columns))
                    keep = near(g, home, part, d)
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([pa.array(g[keep].view(np.int64)), pa.array(np.full(keep.sum(), k, dtype=np.int32)), pa.array(home[keep]), pa.array(rep[keep])], schema=schema)
        packed.trim()

    def near(g, home, part, d):
        order = np.lexsort((~home, g))
        begins = np.flatnonzero(words.first_of_run(g[order]))
        keep = np.zeros(len(g), dtype=bool)
        for a, z in zip(begins, np.append(begins[1:], len(g))):
            rows = order[a:z]
            n = int(home[rows].sum())
            if z - a < 2 or not n:
                continue
            if z - a > CROWD:
                keep[rows] = True
                continue
            x = part[rows].astype(np.float32)
            size = (x * x).sum(1)
            # half a step of rounding in each dimension of both rows
            reach = (np.sqrt((2 - 2 * cosine + SLACK) * x.shape[1] / d) * SCALE + np.sqrt(x.shape[1]) + 0.01) ** 2
            for lo in range(0, n, 256):
                some = slice(lo, min(lo + 256, n))
                close = size[some, None] + size[None] - 2 * (x[some] @ x.T) <= reach
                close[np.arange(close.shape[0]), np.arange(lo, lo + close.shape[0])] = False
                keep[rows[some]] |= close.any(1)
                keep[rows] |= close.any(0)
        return keep

    return run


def _half(n: int) -> list[tuple[int, ...]]:
    """The zero step and one of each pair of opposite steps to neighbour cells."""
    import itertools

    return [s for s in itertools.product((-1, 0, 1), repeat=n) if s >= (0,) * n]


def _tile(cosine: float, width: int):
    """Joins the two tiles of a task: links counted per vector, and a forest of them."""
    out = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        home, i, j, label = (table.column(c).to_numpy(zero_copy_only=False) for c in ("home", "i", "j", "label"))
        tile, rep, mult = (table.column(c).to_numpy() for c in ("tile", "rep", "mult"))
        block = table.column("block")[0].as_py()
        i, j = i[0], j[0]
        x = _rows(table.column("v").combine_chunks())
        u = _unit(x)
        d = x.shape[1]
        y = u @ rotation(d)
        a, b = np.flatnonzero(home & (tile == i)), np.flatnonzero(~home & (tile == j) | home & (tile == j) & (i <= j))
        links, edges = np.zeros(len(rep), dtype=np.int64), []
        budget = 2 - 2 * cosine + SLACK
        for part in np.array_split(a, max(1, -(-len(a) // 128))):
            # first block within its share must be this one
            fine = np.ones((len(part), len(b)), dtype=bool)
            for k, (lo, hi) in enumerate(_bounds(d, width)[: block + 1]):
                p, q = y[part, lo:hi], y[b, lo:hi]
                within = (p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * p @ q.T <= budget * (hi - lo) / d
                fine &= within if k == block else ~within
            r, c = np.nonzero(fine)
            r, c = part[r], b[c]
            same = label[r] == label[c]  # cells are told by hashes
            r, c = r[same], c[same]
            # two home rows of one tile meet once; between different tiles only where i < j
            ok = ~home[c] | (i < j) | (rep[r] < rep[c])
            r, c = r[ok], c[ok]
            for lo in range(0, len(r), 1 << 16):
                p, q = r[lo : lo + (1 << 16)], c[lo : lo + (1 << 16)]
                ok = (u[p] * u[q]).sum(axis=1) >= cosine
                p, q = p[ok], q[ok]
                np.add.at(links, p, mult[q])
                np.add.at(links, q, mult[p])
                edges += _forest(rep, p, q)
        some = np.flatnonzero(links)
        rows = [(int(rep[s]), int(links[s]), None) for s in some] + [(p, 0, q) for p, q in _forest_of(edges)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, out)], schema=out)

    return run


def _forest(rep, r, c) -> list[tuple[int, int]]:
    return _forest_of(zip(rep[r].tolist(), rep[c].tolist()))


def _forest_of(pairs) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(v):
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for p, q in pairs:
        a, b = find(p), find(q)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((p, q))
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", width: int = WIDTH, grid: int = GRID) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id and kept for every row.

    Rows link when labels are equal and not null and the cosine in double precision is at least the
    threshold. Vectors that are null, empty, zero, or hold null or non-finite components, and rows with
    a null key, link with nothing (a row without a key has no component and is kept). Vectors of
    different lengths never link. Repeated keys count as copies. An empty table gives no rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).cast("string").alias("label"))
    rows = rows.mapInArrow(_read, "vec_id long, sig binary, label string, dims int, v binary")
    classes = checkpointed(
        rows.filter("sig is not null").groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.min("label").alias("label"), F.min("dims").alias("dims"), F.min("v").alias("v"))
    )
    bits, n = packed.bucket_bits(vectors.sparkSession), packed.partitions(vectors.sparkSession)
    blocks = packed.dealt(classes.mapInArrow(_place(cosine, width, grid, bits), packed.SCHEMA), n, bits)
    found = checkpointed(blocks.mapInArrow(_candidates(cosine, width), "g long, block int, home boolean, rep long"))
    # a cell without two vectors, or without one at home, joins nothing; a crowded cell is cut into tiles
    counts = found.groupBy("g", "block").agg(F.count("*").alias("m"), F.count_if("home").alias("h")).filter("m > 1 and h > 0")
    tiled = found.join(counts.select("g", "block", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")), ["g", "block"]).join(classes.select("rep", "mult", "label", "dims", "v"), "rep")
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    t = F.col("tile")
    # task (i, j): home rows of tile i against tile j; two home tiles meet in (i, j) with i <= j only
    as_home = F.concat(F.transform(every, lambda x: pair(t, x)), F.transform(F.filter(every, lambda x: x < t), lambda x: pair(x, t)))
    as_copy = F.transform(every, lambda x: pair(x, t))
    tasks = tiled.select("g", "block", "dims", "label", "home", "rep", "mult", "v", "tile", F.explode(F.when(F.col("home"), as_home).otherwise(as_copy)).alias("p")).select("*", "p.i", "p.j").drop("p")
    found = checkpointed(tasks.groupBy("g", "block", "dims", "i", "j").applyInArrow(_tile(cosine, width), "rep long, links long, other long"))
    links = found.filter("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.filter("other is not null"), "rep", "other")
    per_class = (
        classes.select("sig", "rep", "mult").join(links, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
        .select("sig", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.select("vec_id", "sig").join(per_class, "sig", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
