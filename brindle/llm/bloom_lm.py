"""A bigram language model on log-frequency Bloom filters, dealt in slices, and corpus scoring with it.

Counting: each map task combines its own n-grams; buckets of hashes are summed in the reducers, so every training
document and every pair counts, once or often, whatever the corpus holds. Words keep exact counts by 64-bit hashes.

The filter: counts of pairs are quantised to LEVELS, which grow by a quarter. A pair of level j is in the filter once
for each of the levels 1 to j; a reader probes level after level until one is absent. With BITS_PER_ITEM bits and
PROBES probes about one absent pair in 300 is taken for one that occurred once; none falls below its level. Each bucket
has a slice of its own, as large as its own entries need, so the share of errors is the same at every size.

The model: P(w | v) = (c(v w) + MU P(w)) / (c(v) + MU) with P(w) = (c(w) + 1) / (N + V + 1). The log of a document is a
sum over its words and its pairs alone: log P(w) for each token, - log(1 + c(v) / MU) for each first word, and
log(1 + c(v w) / (MU P(w))) for each pair.

What is broadcast has a bound: words and pairs that make up more than one in FREQUENT tokens (at most FREQUENT of each,
whatever the corpus), with exact counts. The filter as a whole grows with the corpus, so it isn't broadcast: each slice
lies in its hash bucket, where the documents' rarer words and pairs come to probe it. A pair goes to the bucket of its
second word, whose exact count is there and bounds its own, or where that word is frequent to the bucket of its
own hash, so that no bucket is crowded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import packed, words

U64 = np.uint64
FLUSH = 1_000_000
FLUSH_DOCUMENTS = 50_000
FREQUENT = 100_000
BITS_PER_ITEM = 12
PROBES = 8
MU = 1000.0
END = U64(0x8D58AC26AFE12E47)
BEGIN = U64(0x5BD1E9955BD1E995)
_UNI, _PAIR, _SLICE, _STAT, _DOC, _ENTRY, _PART = range(7)
_C = U64(0x9FB21C651E98DF25)
#: a pair in its bucket is known by so many bits of its hash; of a million pairs there one in 4,000 shares them
PAIR_BITS = 32
_PAIR_BYTES = PAIR_BITS // 8
_LOW = U64((1 << PAIR_BITS) - 1)
#: fixed-point places of the sums that buckets send back: exact parts, and those that rest on quantised counts
EXACT, ROUGH = 2.0**32, 2.0**14


def _levels() -> np.ndarray:
    out = [1]
    while out[-1] < 2**60:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out, dtype=np.float64)


LEVELS = _levels()
#: the count that a level stands for, its least, so that no probability is raised; level 0 is absence
VALUE = np.concatenate([[0.0], LEVELS])


def level(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, count.astype(np.float64), "right")


def _salt(j: int) -> np.uint64:
    return U64(j * int(_C) % 2**64)


class LogFrequencyFilter:
    """Quantised counts of hashes in a bit array, read by repeated probes; none falls below its level."""

    def __init__(self, data: np.ndarray):
        self.data, self.size = data, 8 * len(data)

    @classmethod
    def of(cls, key: np.ndarray, count: np.ndarray) -> LogFrequencyFilter:
        high = level(count)
        f = cls(np.zeros(max(8, -(-int(high.sum()) * BITS_PER_ITEM // 8)), dtype=np.uint8))
        bit = np.zeros(f.size, dtype=bool)
        j = 1
        while len(key):
            for at in f.positions(key, j):
                bit[at] = True
            j += 1
            key, high = key[high >= j], high[high >= j]
        f.data = np.packbits(bit, bitorder="little")
        return f

    def positions(self, key: np.ndarray, j: int) -> Iterator[np.ndarray]:
        r = words.mix(key ^ _salt(j))
        for i in range(PROBES):
            yield self.probe(r, i)

    def probe(self, r: np.ndarray, i: int) -> np.ndarray:
        h = ((r & U64(0xFFFFFFFF)) + U64(i) * ((r >> U64(32)) | U64(1))) & U64(0xFFFFFFFF)
        return ((h * U64(self.size)) >> U64(32)).astype(np.int64)

    def counts(self, key: np.ndarray) -> np.ndarray:
        found = np.zeros(len(key), dtype=np.int64)
        live = np.arange(len(key))
        for j in range(1, len(LEVELS) + 1):
            r = words.mix(key[live] ^ _salt(j))
            for i in range(PROBES):
                at = self.probe(r, i)
                hit = (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                live, r = live[hit], r[hit]
            if not len(live):
                break
            found[live] = j
        return VALUE[found]


def tokens(t: words.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes (words, then one end), their document, and the hash of each token with the one before it."""
    w = words.split(t, lower=True)
    n = len(t)
    tok = np.empty(len(w.hash) + n, dtype=np.uint64)
    doc = np.repeat(np.arange(n), np.diff(w.lo) + 1)
    tok[np.arange(len(w.hash)) + w.doc] = w.hash
    tok[w.lo[1:] + np.arange(n)] = END
    before = np.empty(len(tok), dtype=np.uint64)
    before[1:] = tok[:-1]
    before[w.lo[:-1] + np.arange(n)] = BEGIN
    return tok, doc, words.mix(before * _C + tok)


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of wanted in sorted keys, 0 where there is none, and where there is one."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=values.dtype), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], 0), hit


def routed(pair: np.ndarray, word: np.ndarray, frequent: np.ndarray, bits: int) -> np.ndarray:
    """Pairs as their bucket, then PAIR_BITS of their hash; the bucket is the second word's unless that is frequent."""
    return (np.where(frequent, pair, word) >> U64(64 - bits)) << U64(PAIR_BITS) | (pair & _LOW)


def _flags(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("held_out").to_numpy(zero_copy_only=False)


def _count(kind: int, shift: int, width: int, keys):
    """Map side: distinct keys of the training tokens of a flush with their counts, by bucket (the bits above shift)."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed.batches(rows(incoming))

    def rows(incoming):
        held, size = [], 0
        for batch in incoming:
            out = _flags(batch)
            for t in words.texts(batch):
                tok, doc, pair = tokens(t)
                train = ~out[t.row : t.row + len(t)][doc]
                held.append(keys(tok[train], pair[train]))
                size += len(tok)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    def flush(held):
        x = np.sort(np.concatenate(held)) if held else np.zeros(0, dtype=np.uint64)
        if not len(x):
            return
        begins = np.flatnonzero(words.first_of_run(x))
        n = np.diff(np.append(begins, len(x))).astype(np.uint32)
        x = x[begins]
        for b, a, z in _buckets(x, shift):
            more = n[a:z] > 1
            yield b, kind, packed.pack(packed.planes(x[a:z][~more], width), packed.planes(x[a:z][more], width), _small(n[a:z][more]))

    return run


def _small(n: np.ndarray) -> np.ndarray:
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


def _buckets(x: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of sorted keys, whose bits above shift are their bucket."""
    bucket = (x >> U64(shift)).astype(np.int64)
    edge = np.append(np.flatnonzero(words.first_of_run(bucket)), len(x))
    for a, z in zip(edge[:-1], edge[1:]):
        yield int(bucket[a]), int(a), int(z)


def _summed(payloads: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for p in payloads:
        one, more, n = packed.unpack(p)
        keys += [packed.from_planes(one, width), packed.from_planes(more, width)]
        counts += [np.ones(len(one) // width, dtype=np.int64), n.astype(np.int64)]
    x, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    begins = np.flatnonzero(words.first_of_run(x))
    return x[begins], np.add.reduceat(n, begins) if len(begins) else n


def _word_counts(incoming):
    """Reduce side: exact counts of each bucket's words, and the totals."""

    def rows():
        total, distinct = 0, 0
        for bucket, kinds in packed.by_bucket(incoming):
            x, n = _summed(kinds[_UNI], 8)
            total, distinct = total + int(n.sum()), distinct + len(x)
            yield bucket, _UNI, packed.pack(packed.planes(x), _small(n))
        yield 0, _STAT, packed.pack(np.array([total, distinct]))

    yield from packed.batches(rows())


def _slices(least: int):
    """Reduce side: frequent pairs with exact counts, and a filter slice for all others of a bucket."""

    def run(incoming):
        yield from packed.batches(rows(incoming))

    def rows(incoming):
        for bucket, kinds in packed.by_bucket(incoming):
            x, n = _summed(kinds[_PAIR], _PAIR_BYTES)
            often = n >= least
            if often.any():
                yield bucket, _PAIR, packed.pack(x[often] | (U64(bucket) << U64(PAIR_BITS)), n[often])
            if not often.all():
                yield bucket, _SLICE, packed.pack(LogFrequencyFilter.of(x[~often], n[~often]).data)

    return run


class Model:
    """What is broadcast: totals, frequent words with exact counts, and frequent pairs once they are known."""

    def __init__(self, n: int, v: int, begin: int, least: int, frequent: tuple[np.ndarray, np.ndarray]):
        self.n, self.v, self.begin, self.least, self.frequent = n, v, begin, least, frequent
        self.pairs = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        #: frequent words' counts travel as one of 255 steps between the least count and all tokens
        self.step = np.log10(max(n, 2 * least) / least) / 255

    def gain(self, both: np.ndarray, word: np.ndarray) -> np.ndarray:
        """What the log10 of a pair has over that of its second word, from the counts of both."""
        return np.log10(1.0 + both * ((self.n + self.v + 1) / MU) / (word + 1.0))

    def code(self, word: np.ndarray) -> np.ndarray:
        return np.round(np.log10(np.maximum(word, self.least) / self.least) / self.step).clip(0, 255).astype(np.uint8)

    def decoded(self, code: np.ndarray) -> np.ndarray:
        return self.least * 10.0 ** (code * self.step)


def fallen(after: np.ndarray | float) -> np.ndarray:
    """What the log10 of any word loses after a first word, from that one's count."""
    return np.log10(1.0 + after / MU)


def _gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of packed rows on the driver, sorted; the caller bounds how many."""
    found = [packed.unpack(bytes(p)) for (p,) in rows.select("payload").collect()]
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    x, n = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(x)
    return x[order], n[order]


def _frequent(least: int):
    """Words of at least that count, which are FREQUENT at most as counts sum to all tokens."""

    def run(incoming):
        def rows():
            for bucket, kind, p in packed.rows_of(incoming):
                x, n = packed.unpack(p)
                x, n = packed.from_planes(x)[n >= least], n[n >= least].astype(np.int64)
                if len(x):
                    yield bucket, kind, packed.pack(x, n)

        yield from packed.batches(rows())

    return run


def train(rows: DataFrame) -> tuple[Model, DataFrame, int]:
    """The model of rows (text, held_out), its word counts and filter slices by bucket, and the number of bucket bits."""
    spark = rows.sparkSession
    bits, n = packed.bucket_bits(spark), packed.partitions(spark)
    counted = rows.mapInArrow(_count(_UNI, 64 - bits, 8, lambda tok, pair: tok), packed.SCHEMA)
    state = packed.checkpointed(packed.dealt(counted, n, bits).mapInArrow(_word_counts, packed.SCHEMA))
    total = np.zeros(2, dtype=np.int64)
    for (p,) in state.filter(f"kind = {_STAT}").select("payload").collect():  # one small row a partition
        total = total + packed.unpack(p)[0]
    least = int(total[0]) // FREQUENT + 1
    known = state.filter(f"kind = {_UNI}")
    frequent = _gathered(known.mapInArrow(_frequent(least), packed.SCHEMA))
    begin = rows.filter(~F.col("held_out")).count()
    model = Model(int(total[0]), int(total[1]), begin, least, frequent)
    held = spark.sparkContext.broadcast(model)

    def pairs(tok, pair):
        return routed(pair, tok, look_up(*held.value.frequent, tok)[1], bits)

    del counted
    packed.released(spark)
    counted = rows.mapInArrow(_count(_PAIR, PAIR_BITS, _PAIR_BYTES, pairs), packed.SCHEMA)
    slices = packed.checkpointed(packed.dealt(counted, n, bits).mapInArrow(_slices(least), packed.SCHEMA))
    model.pairs = _gathered(slices.filter(f"kind = {_PAIR}"))
    del counted
    packed.released(spark)
    return model, known.union(slices.filter(f"kind = {_SLICE}")), bits


def _distinct(key: np.ndarray, doc: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, how many documents have each, those documents, and how often each of them has it.

    Documents come in ascending order. last is any number known by a key; that of each distinct key comes last.
    """
    order = np.argsort(key, kind="stable")
    key, doc, last = key[order], doc[order], last[order]
    begins = np.flatnonzero(words.first_of_run(key, doc))
    often = np.diff(np.append(begins, len(key)))
    key, doc, last = key[begins], doc[begins], last[begins]
    begins = np.flatnonzero(words.first_of_run(key))
    return key[begins], np.diff(np.append(begins, len(key))), doc, often, last[begins]


class _Group:
    """The distinct keys of a flush with their documents, sorted by bucket; parts are what goes to one bucket."""

    def __init__(self, key: np.ndarray, doc: np.ndarray, last: np.ndarray, shift: int, width: int):
        self.key, self.in_docs, self.doc, self.often, self.last = _distinct(key, doc, last)
        self.at = np.concatenate([[0], np.cumsum(self.in_docs)])
        self.width = width
        self.part = {b: (a, z) for b, a, z in _buckets(self.key, shift)}

    def documents(self, bucket: int) -> np.ndarray:
        a, z = self.part.get(bucket, (0, 0))
        return self.doc[self.at[a] : self.at[z]]

    def packed(self, bucket: int, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """place: of each document among those that the bucket hears of."""
        a, z = self.part.get(bucket, (0, 0))
        of, often = slice(self.at[a], self.at[z]), self.often[self.at[a] : self.at[z]]
        more = np.flatnonzero(often > 1)
        local = place[self.doc[of]]
        return packed.planes(self.key[a:z], self.width), _small(self.in_docs[a:z]), packed.planes(local, 2), more.astype(np.uint32), _small(often[more]), self.last[a:z]


def _score(held, bits: int):
    """Scores documents by what is broadcast; rarer words and pairs go to the buckets that know their counts."""

    def run(incoming):
        yield from packed.batches(rows(incoming))

    def rows(incoming):
        model, task, flushes = held.value, TaskContext.get().partitionId(), 0
        docs, rare, near, far, size, count = [], [], [], [], 0, 0
        for batch in incoming:
            out = _flags(batch)
            valid = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for t in words.texts(batch):
                tok, doc, pair = tokens(t)
                n = len(t)
                known, hit = look_up(*model.frequent, tok)
                key = routed(pair, tok, hit, bits)
                both, met = look_up(*model.pairs, key)
                met &= hit
                # a pair that is frequent has a frequent second word, whose count is at hand
                delta = np.where(met, model.gain(both, known), 0.0) - np.where(hit & (tok != END), fallen(known), 0.0)
                base = np.bincount(doc[hit], weights=np.log10(known[hit] + 1.0), minlength=n)
                delta = np.bincount(doc, weights=delta, minlength=n) - fallen(model.begin)
                a = slice(t.row, t.row + n)
                docs.append((t.ids, valid[a], out[a], np.bincount(doc, minlength=n), np.bincount(doc[hit], minlength=n), base, delta))
                doc = doc + count
                rare.append((tok[~hit], doc[~hit]))
                some = ~met & ~hit
                near.append((key[some], doc[some], tok[some]))
                some = ~met & hit
                far.append((key[some], doc[some], model.code(known[some])))
                size, count = size + len(tok), count + n
                if size >= FLUSH or count >= FLUSH_DOCUMENTS:
                    yield from flush((task << 32) + flushes, docs, rare, near, far)
                    docs, rare, near, far, size, count, flushes = [], [], [], [], 0, 0, flushes + 1
        yield from flush((task << 32) + flushes, docs, rare, near, far)

    def flush(name, docs, rare, near, far):
        if not docs:
            return
        joined = lambda parts: [np.concatenate(c) for c in zip(*parts)]
        home = int(words.mix(np.array([name], dtype=np.uint64))[0] >> U64(64 - bits))
        yield home, _DOC, packed.pack(np.array([name]), *joined(docs))
        x, doc = joined(rare)
        rare = _Group(x, doc, np.zeros(len(x), dtype=np.uint8), 64 - bits, 8)
        x, doc, tok = joined(near)
        # the second word's place among the rare words of its bucket, which sorted distinct words give
        of = np.searchsorted(rare.key, tok) - np.array([a for a, _ in rare.part.values()], dtype=np.int64)[np.searchsorted(list(rare.part), (tok >> U64(64 - bits)).astype(np.int64))] if len(tok) else tok.astype(np.int64)
        near = _Group(x, doc, of, PAIR_BITS, _PAIR_BYTES)
        far = _Group(*joined(far), PAIR_BITS, _PAIR_BYTES)
        place = np.zeros(sum(len(d[0]) for d in docs), dtype=np.uint64)
        for b in sorted(rare.part.keys() | near.part.keys() | far.part.keys()):
            used = np.unique(np.concatenate([g.documents(b) for g in (rare, near, far)]))
            place[used] = np.arange(len(used))
            n = near.packed(b, place)
            yield b, _ENTRY, packed.pack(np.array([name]), packed.planes(used.astype(np.uint64), 2), *rare.packed(b, place)[:5], *n[:5], packed.planes(n[5].astype(np.uint64), 4), *far.packed(b, place))

    return run


def _fixed(x: np.ndarray, by: float) -> np.ndarray:
    """Numbers as whole multiples of 1 / by, small ones of either sign in few bytes that are not zero."""
    v = np.round(x * by).astype(np.int64)
    return packed.planes(((v << 1) ^ (v >> 63)).view(np.uint64))


def _floats(x: np.ndarray, by: float) -> np.ndarray:
    v = packed.from_planes(x)
    return ((v >> U64(1)).astype(np.int64) ^ -(v & U64(1)).astype(np.int64)) / by


def _probe(held, bits: int):
    """Reduce side: what the rarer words and pairs add to the scores of each document."""
    counts = lambda p: (lambda x, n: (packed.from_planes(x), n.astype(np.int64)))(*packed.unpack(p))

    def run(incoming):
        yield from packed.batches(rows(incoming))

    def spread(group, n, *values):
        """Sums of the values of distinct keys over the documents that have them."""
        _, in_docs, doc, more, many = group
        often = np.ones(len(doc) // 2)
        often[more] = many
        doc = packed.from_planes(doc, 2).astype(np.int64)
        return [np.bincount(doc, weights=np.repeat(v, in_docs) * often, minlength=n).astype(np.float64) for v in values]

    def rows(incoming):
        model = held.value
        for bucket, kinds in packed.by_bucket(incoming):
            for p in kinds.get(_DOC, ()):
                yield bucket, _DOC, p
            if _ENTRY not in kinds:
                continue
            x, n = counts(kinds[_UNI][0]) if _UNI in kinds else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
            seen = LogFrequencyFilter(packed.unpack(kinds[_SLICE][0])[0]) if _SLICE in kinds else LogFrequencyFilter(np.zeros(8, dtype=np.uint8))
            cells = [packed.unpack(p) for p in kinds.pop(_ENTRY)]
            found = {}
            for at in (7, 13):  # all pairs of the bucket are probed at once
                keys = [packed.from_planes(c[at], _PAIR_BYTES) for c in cells]
                found[at] = np.split(seen.counts(np.concatenate(keys)), np.cumsum([len(k) for k in keys])[:-1])
            for cols, both_near, both_far in zip(cells, found[7], found[13]):
                name, used, rare, near, of, far, code = cols[0], cols[1], cols[2:7], cols[7:12], cols[12], cols[13:18], cols[18]
                docs = len(used) // 2
                word = packed.from_planes(rare[0])
                c, _ = look_up(x, n, word)
                base, sure, delta = spread(rare, docs, np.log10(c + 1.0), c > 0, np.where(word == END, 0.0, -fallen(c)))
                word = c[packed.from_planes(of, 4).astype(np.int64)]
                delta += spread(near, docs, model.gain(np.minimum(both_near, word), word))[0]
                word = model.decoded(code)
                delta += spread(far, docs, model.gain(np.minimum(both_far, word), word))[0]
                home = int(words.mix(name.astype(np.uint64))[0] >> U64(64 - bits))
                yield home, _PART, packed.pack(name, used, _fixed(base, EXACT), _small(sure.astype(np.int64)), _fixed(delta, ROUGH))

    return run


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(n_train: int, distinct: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    each = np.log10(float(n_train + distinct + 1))

    def run(incoming):
        for _, kinds in packed.by_bucket(incoming):
            parts: dict[int, list] = {}
            for p in kinds.get(_PART, ()):
                name, *columns = packed.unpack(p)
                parts.setdefault(int(name[0]), []).append(columns)
            for p in kinds.get(_DOC, ()):
                name, ids, valid, held_out, n, sure, base, delta = packed.unpack(p)
                base, delta, sure = base - n * each, delta.copy(), sure.astype(np.int64)
                for used, b, s, d in parts.pop(int(name[0]), ()):
                    at = packed.from_planes(used, 2).astype(np.int64)
                    base[at] += _floats(b, EXACT)
                    sure[at] += s
                    delta[at] += _floats(d, ROUGH)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~valid), pa.array(held_out), pa.array(n.astype(np.int64)), pa.array(sure), pa.array(np.full(len(ids), n_train)), pa.array(base), pa.array(base + delta)], schema=schema)

    return run


def score_corpus(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of docs scored by a model of the rows whose crc32(key as text) mod 7 is not 2.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams with exact counts) and score
    (log10 probability by the pair model). A null or empty text is its end token alone. Rows
    with a null key train and are kept; repeated keys are rows of their own; extra columns are
    ignored; an empty table gives no rows. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    n = packed.partitions(spark)
    k = F.col(key).cast("long")
    rows = packed.small_batches(docs).select(k.alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.pmod(F.crc32(k.cast("string")), F.lit(7)) == 2, F.lit(False)).alias("held_out"))
    model, counts, bits = train(rows.select("doc_id", "text", "held_out"))
    held = spark.sparkContext.broadcast(model)
    scored = rows.mapInArrow(_score(held, bits), packed.SCHEMA)
    met = packed.dealt(scored.union(counts), n, bits).mapInArrow(_probe(held, bits), packed.SCHEMA)
    return packed.dealt(met, n, bits).mapInArrow(_finish(model.n, model.v), OUT)
