"""Exact Jaccard join of documents on word shingles, as a metric-space join with Voronoi cells.

Jaccard distance d = 1 - J is a metric. Documents that link have d <= theta = 1/4.

1. Pivots and cells. The pivots are the one-element sets {s} of all shingles s. A document x
   has the distance 1 - 1/|x| to the pivots inside it and 1 to all others, so its nearest pivots
   are its own shingles; ties go to the pivot in the fewest documents, then to the smaller hash.
   x lives in the Voronoi cell of its first pivot in that order.
2. Windows. By the triangle inequality on set differences, a partner lacks at most
   floor(theta |x|) of x's shingles, so its own nearest pivot and x's windows meet in one of x's
   first floor(theta |x|) + 1 pivots: x is replicated to these cells and no others. A pivot that no
   second document has holds a cell of one, so its replica is never made. A document whose
   window holds only such pivots is isolated, and that is proved without comparing it.
3. Recursion. Inside a cell the smallest member is the next pivot p; exact distances to it are
   computed once. Members within theta of p are one component with it and need no further
   pairs. Members x, y in different components are compared only if |d(p,x) - d(p,y)| <= theta,
   their sizes allow it and parity sketches (a lower bound of the symmetric difference, itself a
   metric) allow it; these are then verified exactly. No other pair of the cell can change a component.
   Inside a large cell the same is done once more: rings around p are its regions, windows copy members
   to the neighbouring rings, and rings are cut into tiles that meet in tasks of their own. All links between classes, also
   inside a component, come from the same join without the components, when they are asked for.

Exact copies form one class by a 64-bit hash of the shingle set before any of this, so copies
never meet as pairs. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import packed, words
from brindle.llm.components import connected_components

U64 = np.uint64
WIDTH = 5
FLUSH = 1_500_000
HEAVY = 64
_DOC, _CLASS, _ENTRY, _HEAVY_COUNT, _OWN, _SHARED = range(6)
_MANY = np.uint32(2**32 - 1)
SKETCH_WORDS = 8
TILE = 512


def shingle_sets(t: words.Texts, w: words.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, document by document; where each document begins; a 64-bit hash of each set."""
    first, h = words.windows(w, width)
    n_words = np.diff(w.lo)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    doc = w.doc[first]
    if len(short):
        h = np.concatenate([h, [words.sequence_hash(w.hash[w.lo[d] : w.lo[d + 1]]) for d in short]]).astype(np.uint64)
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    at = np.searchsorted(doc, np.arange(len(t) + 1))
    h = h.copy()
    for a, b in zip(at[:-1], at[1:]):
        h[a:b].sort()
    new = words.first_of_run(doc, h)
    h, doc = h[new], doc[new]
    at = np.searchsorted(doc, np.arange(len(t) + 1))
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(words.mix(h ^ U64(0x5851F42D4C957F2D)), out=total[1:])
    return h, at, words.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def _cells(bits: int, buckets: int, width: int, text: str, key: str):
    """Map side: documents with their class, classes with their size, and (shingle, class) entries packed by bucket."""
    shift = U64(64 - bits)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed.batches(rows(incoming))

    def rows(incoming):
        held: list = []
        size = count = 0
        for batch in incoming:
            for t in words.texts(batch, text, key):
                h, at, sig = shingle_sets(t, words.split(t, lower=True), width)
                held.append((t.ids.copy(), h, at, sig))
                size, count = size + len(h), count + len(t)
                if size >= FLUSH or count >= 60_000:
                    yield from flush(held)
                    held, size, count = [], 0, 0
        yield from flush(held)

    def flush(held):
        if not held:
            return
        ids = np.concatenate([x[0] for x in held])
        sig = np.concatenate([x[3] for x in held])
        n = np.concatenate([np.diff(x[2]) for x in held]).astype(np.int64)
        h = np.concatenate([x[1] for x in held])
        yield int(ids[0] % buckets), _DOC, packed.pack(ids, sig, n)
        order = np.lexsort((ids, sig))
        lead = order[words.first_of_run(sig[order])]
        lead = lead[n[lead] > 0]
        for b, (s, m, i) in packed.scattered((sig[lead] >> shift).astype(np.int64), sig[lead], n[lead], ids[lead]):
            yield b, _CLASS, packed.pack(s, m, i)
        start = np.concatenate([[0], np.cumsum(n)])
        lead.sort()
        take = np.zeros(len(ids), dtype=bool)
        take[lead] = True
        cls = np.repeat(np.cumsum(take) - 1, n)
        keep = np.repeat(take, n)
        h, cls, sig = h[keep], cls[keep].astype(np.uint16), sig[take]
        order = np.argsort(h, kind="stable")
        h, cls = h[order], cls[order]
        new = words.first_of_run(h)
        run_of = np.cumsum(new) - 1
        df = np.diff(np.append(np.flatnonzero(new), len(h)))
        many = df[run_of] > HEAVY if len(h) else np.zeros(0, dtype=bool)
        if many.any():
            # a shingle in very many documents of this flush goes out once; its documents keep it themselves
            hot = h[many & new]
            for b, (x,) in packed.scattered((hot >> shift).astype(np.int64), hot):
                yield b, _HEAVY_COUNT, packed.pack(x)
            own, who = h[many], cls[many]
            for b, (s, x) in packed.scattered((sig[who] >> shift).astype(np.int64), sig[who], own):
                yield b, _OWN, packed.pack(*_tabled(s), x)
            h, cls = h[~many], cls[~many]
        if len(h):
            bucket = (h >> shift).astype(np.int64)
            for part in np.split(np.arange(len(h)), np.flatnonzero(np.diff(bucket)) + 1):
                a, z = part[0], part[-1] + 1
                used, short = np.unique(cls[a:z], return_inverse=True)
                yield int(bucket[a]), _ENTRY, packed.pack(sig[used], packed.planes((h[a:z] << U64(16)) | short.astype(np.uint64)))

    return run


def _tabled(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    table, short = np.unique(s, return_inverse=True)
    return table, short.astype(np.uint32)


def _shared(bits: int):
    """Reduce side by shingle: drops shingles of one class; sends the others back to their classes with their frequency."""
    shift, low = U64(64 - bits), U64(0xFFFF)
    keep = U64((2**64 - 1) & ~0xFFFF)

    def run(incoming):
        yield from packed.batches(rows(incoming))

    def rows(incoming):
        found = []
        for bucket, kinds in packed.by_bucket(incoming):
            for kind in (_DOC, _CLASS, _OWN):
                for payload in kinds.pop(kind, ()):
                    yield bucket, kind, payload
            entries = [(table, packed.from_planes(x)) for table, x in map(packed.unpack, kinds.pop(_ENTRY, ()))]
            heavy = [packed.unpack(p)[0] for p in kinds.pop(_HEAVY_COUNT, ())]
            if not entries:
                continue
            # the bucket's bits are gone from the entry after the shift by 16; they are put back by the bucket
            x = np.concatenate([e[1] for e in entries])
            sig = np.concatenate([e[0][(e[1] & low).astype(np.int64)] for e in entries])
            h = x & keep
            heavy = np.unique(np.concatenate(heavy) << U64(16)) if heavy else np.zeros(0, dtype=np.uint64)
            order = np.argsort(h, kind="stable")
            h, sig = h[order], sig[order]
            new = words.first_of_run(h)
            df = np.diff(np.append(np.flatnonzero(new), len(h)))
            is_heavy = np.isin(h[new], heavy)
            some = (df > 1) | is_heavy
            pick = np.repeat(some, df)
            h, sig, is_heavy = h[pick], sig[pick], np.repeat(is_heavy, df)[pick]
            order = np.lexsort((sig, h))
            h, sig, is_heavy = h[order], sig[order], is_heavy[order]
            one = words.first_of_run(h, sig)
            h, sig, is_heavy = h[one], sig[one], is_heavy[one]
            new = words.first_of_run(h)
            df = np.diff(np.append(np.flatnonzero(new), len(h)))
            df = np.repeat(df, df).astype(np.uint32)
            df[is_heavy] = _MANY
            pick = df > 1
            h, sig, df = h[pick], sig[pick], df[pick]
            found.append((sig, (h >> U64(16)) | (U64(bucket) << U64(48)), np.minimum(df, 255).astype(np.uint8)))
        if found:
            sig, h, df = (np.concatenate(c) for c in zip(*found))
            for b, (s, x, f) in packed.scattered((sig >> shift).astype(np.int64), sig, h, df):
                yield b, _SHARED, packed.pack(*_tabled(s), x, f)

    return run


SURVIVORS = "kind int, sig long, rep long, n long, cells array<long>, shared array<long>, sketch array<long>, ids binary"


def _survivors(bits: int, top: int):
    """Reduce side by class: the smallest document, and for classes that may link their window cells and shared shingles."""
    arrow = pa.schema([("kind", pa.int32()), ("sig", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("cells", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(incoming):
        held, size = [], 0
        for r in rows(incoming):
            held.append(r)
            size += 64 + 8 * len(r[5] if r[5] is not None else ()) + len(r[7] or b"")
            if size > 8 << 20:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)

    def rows(incoming):
        for _, kinds in packed.by_bucket(incoming):
            for payload in kinds.pop(_DOC, ()):
                yield _DOC, None, None, None, None, None, None, payload
            if _CLASS not in kinds:
                continue
            sig, n, rep = (np.concatenate(c) for c in zip(*map(packed.unpack, kinds[_CLASS])))
            order = np.lexsort((rep, sig))
            order = order[words.first_of_run(sig[order])]
            sig, n, rep = sig[order], n[order], rep[order]
            parts = []
            for p in kinds.get(_SHARED, ()):
                table, short, h, f = packed.unpack(p)
                parts.append((table[short], h, f))
            for p in kinds.get(_OWN, ()):
                table, short, h = packed.unpack(p)
                # as entries carry them: the bucket's bits, then 48 bits below them
                parts.append((table[short], ((h << U64(16)) >> U64(16)) | ((h >> U64(64 - bits)) << U64(48)), np.full(len(h), 255, dtype=np.uint8)))
            if parts:
                s, h, f = (np.concatenate(c) for c in zip(*parts))
                order = np.lexsort((h, f, s))
                s, h, f = s[order], h[order], f[order]
                lo, hi = np.searchsorted(s, sig), np.searchsorted(s, sig, "right")
            else:
                lo = hi = np.zeros(len(sig), dtype=np.int64)
            window = n - (n * top + 99) // 100 + 1 - (n - (hi - lo))
            for k in range(len(sig)):
                if window[k] > 0 and hi[k] > lo[k]:
                    mine = np.unique(h[lo[k] : hi[k]], return_index=True)
                    got = h[lo[k] : hi[k]]
                    if len(mine[0]) < len(got):
                        got = got[np.sort(mine[1])]
                        left = int(n[k] - (n[k] * top + 99) // 100 + 1 - (n[k] - len(got)))
                    else:
                        left = int(window[k])
                    if left > 0:
                        yield _CLASS, int(sig[k].view(np.int64)), int(rep[k]), int(n[k]), got[:left].view(np.int64), np.sort(got.view(np.int64)), sketch(got), None
                        continue
                yield _ENTRY, int(sig[k].view(np.int64)), int(rep[k]), int(n[k]), None, None, None, None

    return run


def _documents(incoming):
    schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("n_shingles", pa.int64())])
    for b in incoming:
        for payload in b.column("ids").to_pylist():
            ids, sig, n = packed.unpack(payload)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sig.view(np.int64)), pa.array(n)], schema=schema)


def _links(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Exact distances of candidate pairs (a, b), by intersecting what they share with any document."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("shared").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .select("a", "b", both.cast("long").alias("i"), (F.col("na") + F.col("nb") - both).alias("u"))
        .withColumn("linked", 100 * F.col("i") >= percent * F.col("u"))
    )


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """Documents with their class and component, and the links between classes.

    Returns (members, links): members has doc_id, n_shingles, component_id, class_id, one row per input row; links has
    (a, b), a < b, every pair of different classes that link, named by their class_id, the smallest doc_id of equal
    sets. links is computed when it is read; members doesn't need it. Words are lower-cased in A-Z. Null or wordless
    texts have no shingles and link with nothing; texts of fewer than width words are one shingle. Rows with a null key
    cannot be referred to and are left out; a repeated key gives a row each time. An empty table gives none. Extra
    columns are ignored.
    """
    spark = docs.sparkSession
    bits, n = packed.bucket_bits(spark), packed.partitions(spark)
    rows = packed.small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    cells = packed.dealt(rows.mapInArrow(_cells(bits, 1 << bits, width, "text", "doc_id"), packed.SCHEMA), n, bits)
    shared = packed.dealt(cells.mapInArrow(_shared(bits), packed.SCHEMA), n, bits)
    state = packed.checkpointed(shared.mapInArrow(_survivors(bits, percent), SURVIVORS))
    del cells, shared
    packed.released(spark)
    members = state.filter(f"kind = {_DOC}").select("ids").mapInArrow(_documents, "doc_id long, sig long, n_shingles long")
    known = state.filter(f"kind <> {_DOC}").select("sig", "rep")
    classes = state.filter(f"kind = {_CLASS}").select("rep", "n", "cells", "shared", "sketch")

    links, component = _cell_join(classes, percent)
    labelled = known.join(component, known.rep == component.node, "left").select("sig", "rep", F.coalesce("component", "rep").alias("component"))
    out = members.join(labelled, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))
    return out, links


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links): how many other rows each row links to, copies of the same set among them.

    Links stay between classes; a class counts as many times as it has rows, so copies are never paired up.
    """
    size = members.filter("n_shingles > 0").groupBy("class_id").agg(F.count("*").alias("rows"))
    ends = links.select(F.col("a").alias("class_id"), F.col("b").alias("other")).union(links.select("b", "a"))
    far = ends.join(size.withColumnRenamed("class_id", "other"), "other").groupBy("class_id").agg(F.sum("rows").alias("far"))
    per = size.join(far, "class_id", "left").select("class_id", (F.coalesce("far", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    return members.join(per, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _cell_join(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """All links, read when they are needed, and the components."""
    placed = classes.select(F.explode("cells").alias("cell"), "rep")
    centre = placed.groupBy("cell").agg(F.min("rep").alias("p"), F.count("*").alias("m")).filter("m > 1")
    replicas = packed.checkpointed(placed.join(centre, "cell"))
    star = replicas.filter("rep <> p").select(F.col("p").alias("a"), F.col("rep").alias("b")).distinct()
    sized = classes.select("rep", "n", (F.col("n") - F.size("shared")).alias("o"), F.col("sketch").alias("k"))
    near = packed.checkpointed(_links(_plausible(star, sized, percent), classes, percent).select("a", "b", "i", "u", "linked"))
    first = near.filter("linked").select("a", "b")
    label = packed.checkpointed(connected_components(first))

    d = near.select(F.col("a").alias("p"), F.col("b").alias("rep"), (1 - F.col("i") / F.col("u")).alias("d"))
    # cells whose members are not yet one component: the pairs of different components inside the windows
    left = replicas.join(label, replicas.rep == label.node, "left").select("cell", "p", "rep", "m", F.coalesce("component", "rep").alias("c"))
    mixed = left.groupBy("cell").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("cell")
    apart = _tiled(left.filter("rep <> p").join(mixed, "cell"), d, sized, percent)
    second = packed.checkpointed(_links(apart, classes, percent).filter("linked").select("a", "b"))
    # links between components join these; the rest is settled
    side = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    across = second.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = packed.checkpointed(connected_components(across))
    known = label.unionByName(second.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti").withColumn("component", F.col("node")))
    component = known.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    every = _tiled(replicas.filter("rep <> p").withColumn("c", F.col("rep")), d, sized, percent)
    links = _links(every, classes, percent).filter("linked").select("a", "b").union(first).distinct()
    return links, component


def _tiled(members: DataFrame, d: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (cell, p, rep, m, c) of one cell and different c that may link, each once.

    A cell of more than TILE members is a space of its own: rings of width theta around its pivot are its regions, and by
    the triangle inequality a member's partners lie in its ring or in a neighbouring one, to which it is copied; members
    whose distance was not computed go to every ring. Rings are cut into tiles of about TILE, and two tiles meet under a key
    of their own, so no task has more than TILE ** 2 pairs of a cell to look at. Distances, sizes and sketches leave
    out what can't link before anything is written.
    """
    theta = 1 - percent / 100 + 1e-9
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    inside = members.join(d, ["p", "rep"], "left").join(sized, "rep").withColumn("tiles", tiles).withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    ring, small, every = F.floor(F.col("d") / theta).cast("int"), F.col("m") <= TILE, F.sequence(F.lit(0), F.lit(int(1 / theta) + 1))
    own = F.when(small, F.array(F.lit(0))).when(F.col("d").isNull(), every).otherwise(F.array(ring))
    window = F.when(small, F.array(F.lit(0))).when(F.col("d").isNull(), every).otherwise(F.sequence(F.greatest(ring - 1, F.lit(0)), ring + 1))
    fields = lambda x: [F.col("rep").alias(x), *[F.col(f).alias(f"{f}{x}") for f in ("c", "d", "n", "o", "k", "t")]]
    a = inside.select("cell", *fields("a"), F.explode(own).alias("ring"), "tiles").select("*", F.explode(F.sequence("ta", F.col("tiles") - 1)).alias("j")).withColumn("i", F.col("ta")).drop("tiles")
    b = inside.select("cell", *fields("b"), F.explode(window).alias("ring")).select("*", F.explode(F.sequence(F.lit(0), "tb")).alias("i")).withColumn("j", F.col("tb"))
    met = a.join(b, ["cell", "ring", "i", "j"]).filter("(ta < tb or a < b) and ca <> cb")
    met = met.filter(F.col("da").isNull() | F.col("db").isNull() | (F.abs(F.col("da") - F.col("db")) <= theta)).filter(_allowed(percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall in each of 64 * SKETCH_WORDS cells; a shingle more or less flips one cell."""
    odd = np.bincount((h & U64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _allowed(percent: int):
    """False only for pairs that cannot link: too different in size, or sketches too far apart."""
    na, nb = F.col("na"), F.col("nb")
    flips = sum(F.bit_count(F.col("ka")[j].bitwiseXOR(F.col("kb")[j])) for j in range(SKETCH_WORDS))
    flips = flips + F.col("oa") + F.col("ob")  # shingles that no other document has
    # |x ^ y| <= (|x| + |y|) (100 - p) / (100 + p) where J >= p / 100
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * flips <= (100 - percent) * (na + nb))


def _plausible(pairs: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    side = lambda x: sized.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("o").alias(f"o{x}"), F.col("k").alias(f"k{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_allowed(percent)).select("a", "b")
