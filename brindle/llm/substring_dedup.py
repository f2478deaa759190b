"""Removal of word spans that repeat, exactly and over the whole corpus.

A window is WIDTH consecutive words of one document. Every word covered by a window whose word
sequence also starts earlier (in a smaller doc_id, or earlier in the same document) goes; windows
are judged on the input, so overlapping windows merge into maximal spans.

Two ways lead to the spans:

- ``remove_reference_spans`` holds suffix automata of a reference of proven size: shards of the
  reference are broadcast, documents are streamed through them for matching statistics (the
  longest reference substring that ends at each word), and maximal spans at least as long as the
  threshold are removed.
- ``self_dedup`` takes the corpus as its own reference. An automaton of N words has at least N
  states, so automata of all shards are larger than the corpus and cannot be broadcast, and
  streaming every document through every shard is quadratic. There, a window's fingerprint names
  the shard that knows its first place: fingerprints are dealt by hash, each shard answers the
  documents that are not the first, and the documents remove the answered windows. A map task
  combines its own repeats first, so a passage in every document sends one entry per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import packed, words

U64 = np.uint64
WIDTH = 20
FLUSH = 1_000_000
_ENTRY, _ANSWER = 0, 1


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n -= 1
    return n


def _reduced(h: np.ndarray, bits: int) -> np.ndarray:
    """What is left of a hash once it has been dealt: 48 bits and the bucket."""
    return ((h << U64(16)) >> U64(16)) | ((h >> U64(64 - bits)) << U64(48))


def _answer(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return words.mix(h ^ words.mix(doc.astype(np.int64).view(np.uint64) + U64(0x632BE59BD9B4E019)))


def _occurrences(bits: int, homes: int, width: int):
    """Map side: each distinct window once with the smallest document of this flush; the others are answered at once."""
    shift = U64(64 - bits)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed.batches(rows(incoming))

    def rows(incoming):
        held, size, count = [], 0, 0
        for batch in incoming:
            for t in words.texts(batch):
                w = words.split(t)
                first, h = words.windows(w, width)
                held.append((h, t.ids[w.doc[first]]))
                size, count = size + len(h), count + len(t)
                if size >= FLUSH or count >= 60_000:
                    yield from flush(held)
                    held, size, count = [], 0, 0
        yield from flush(held)

    def flush(held):
        h = np.concatenate([x[0] for x in held]) if held else np.zeros(0, dtype=np.uint64)
        if not len(h):
            return
        doc = np.concatenate([x[1] for x in held])
        table, short = np.unique(doc, return_inverse=True)
        order = np.argsort(h, kind="stable")
        h, short = h[order], short[order]
        new = words.first_of_run(h)
        begins = np.flatnonzero(new)
        least = np.minimum.reduceat(short, begins)
        run_of = np.cumsum(new) - 1
        late = short > least[run_of]
        yield from _answers(_reduced(h[late], bits), table[short[late]], homes)
        h, short = h[begins], least
        bucket = (h >> shift).astype(np.int64)
        for part in np.split(np.arange(len(h)), np.flatnonzero(np.diff(bucket)) + 1):
            a, z = part[0], part[-1] + 1
            used, at = np.unique(short[a:z], return_inverse=True)
            yield int(bucket[a]), _ENTRY, packed.pack(table[used], packed.planes((h[a:z] << U64(16)) | at.astype(np.uint64)))

    return run


def _answers(h: np.ndarray, doc: np.ndarray, homes: int):
    a = _answer(h, doc)
    for b, (x,) in packed.scattered(doc % homes, a):
        yield b, _ANSWER, packed.pack(np.unique(x))


def _first_places(bits: int, homes: int):
    """Reduce side: of each window, every document but the smallest is answered."""
    low = U64(0xFFFF)

    def run(incoming):
        yield from packed.batches(rows(incoming))

    def rows(incoming):
        found = []
        for bucket, kinds in packed.by_bucket(incoming):
            for p in kinds.get(_ANSWER, ()):
                yield bucket, _ANSWER, p
            entries = [(table, packed.from_planes(x)) for table, x in map(packed.unpack, kinds.get(_ENTRY, ()))]
            if not entries:
                continue
            x = np.concatenate([e[1] for e in entries])
            doc = np.concatenate([e[0][(e[1] & low).astype(np.int64)] for e in entries])
            h = x >> U64(16)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            new = words.first_of_run(h)
            begins = np.flatnonzero(new)
            least = np.minimum.reduceat(doc, begins)[np.cumsum(new) - 1]
            late = doc > least
            found.append((h[late] | (U64(bucket) << U64(48)), doc[late]))
        if found:
            yield from _answers(*(np.concatenate(c) for c in zip(*found)), homes)

    return run


def _repeats_inside(first: np.ndarray, h: np.ndarray, w: words.Words) -> np.ndarray:
    """Windows whose hash occurs earlier in the same document."""
    own = words.mix(h + words.mix(w.doc[first].astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    late = np.zeros(len(h), dtype=bool)
    late[order] = ~words.first_of_run(own[order])
    return late


def covered(first: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """True for each word inside one of the windows that begin at first."""
    step = np.zeros(n_words + 1, dtype=np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, first + width, -1)
    return np.cumsum(step[:-1]) > 0


def _removal(bits: int, width: int, with_text: bool, rest: pa.DataType | None):
    """Documents in their homes, answers first: marks, maximal spans, what is kept."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("text", pa.string()), ("rest", rest)] if with_text else []
    schema = pa.schema(fields)

    def run(incoming):
        answers: dict[int, list[np.ndarray]] = {}
        for batch in incoming:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(kind == 0):
                answers.setdefault(int(bucket[i]), []).append(packed.unpack(batch.column("payload")[i].as_py())[0])
            at = np.flatnonzero(kind == 1)
            if not len(at):
                continue
            part = batch.take(pa.array(at))
            here = set(bucket[at].tolist())
            known = [x for b in here for x in answers.get(b, ())]
            known = np.sort(np.concatenate(known)) if known else np.zeros(0, dtype=np.uint64)
            for t in words.texts(part):
                yield document_rows(t, part, known)
            for b in [b for b in answers if b < int(bucket[at].max())]:
                del answers[b]
        packed.trim()

    def document_rows(t, part, known):
        w = words.split(t)
        first, h = words.windows(w, width)
        late = _repeats_inside(first, h, w)
        valid = part.column("doc_id").slice(t.row, len(t)).is_valid().to_numpy(zero_copy_only=False)
        if len(known) and len(h):
            a = _answer(_reduced(h, bits), t.ids[w.doc[first]])
            spot = np.minimum(np.searchsorted(known, a), len(known) - 1)
            late |= (known[spot] == a) & valid[w.doc[first]]
        gone = covered(first[late], len(w.start), width)
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(w.lo[:-1], len(gone))) if len(t) else gone
        removed[np.diff(w.lo) == 0] = 0
        out, cut = joined(t.data, w, gone)
        view = memoryview(out)
        sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:])]
        ids = pa.array(t.ids, mask=~valid)
        columns = [ids, pa.array(np.diff(w.lo)), pa.array(removed), pa.array(sha, pa.string())]
        if with_text:
            text = part.column("text").slice(t.row, len(t))
            hit = np.flatnonzero(removed)
            if len(hit):
                values = text.to_pylist()
                for d in hit:
                    values[d] = remaining(t.data[t.at[d] : t.at[d + 1]], w.start[w.lo[d] : w.lo[d + 1]] - t.at[d], gone[w.lo[d] : w.lo[d + 1]])
                text = pa.array(values, pa.string())
            columns += [text.cast(pa.string()), part.column("rest").slice(t.row, len(t))]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def joined(data: np.ndarray, w: words.Words, gone: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words of each document joined by one space, one document after another, and where each begins."""
    n_docs = len(w.lo) - 1
    kept = np.flatnonzero(~gone)
    pick = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(pick, w.start[kept], 1)
    np.add.at(pick, w.end[kept], -1)
    pick = np.cumsum(pick, dtype=np.int8).astype(bool)
    doc = w.doc[kept]
    followed = np.zeros(len(kept), dtype=bool)
    followed[:-1] = doc[1:] == doc[:-1]
    data = np.append(data, np.uint8(32))
    gap = w.end[kept[followed]]
    data[gap] = 32
    pick[gap] = True
    lengths = np.bincount(doc, weights=(w.end - w.start)[kept] + followed, minlength=n_docs).astype(np.int64) if len(kept) else np.zeros(n_docs, dtype=np.int64)
    return data[pick].tobytes(), np.concatenate([[0], np.cumsum(lengths)])


def remaining(data: np.ndarray, start: np.ndarray, gone: np.ndarray) -> str:
    """The text without its removed words and the white space that follows each."""
    pick = np.zeros(len(data) + 1, dtype=np.int32)
    end = np.append(start[1:], len(data))
    np.add.at(pick, start[gone], 1)
    np.add.at(pick, end[gone], -1)
    return data[np.cumsum(pick[:-1]) == 0].tobytes().decode("utf-8", "replace")


def self_dedup(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, with_text, all columns of docs with text reduced.

    Columns of docs keep their names; a new one whose name is taken gets "_now" behind it, as often as it must.
    kept_sha256 is of the kept words joined by one space. The reduced text loses each removed word
    and the white space after it; a text that loses nothing stays as it is, null included. Null and
    empty texts have no words; texts of fewer than width words lose nothing. A row with a null doc_id
    is compared with itself only. Rows of one doc_id count as one document. An empty table gives none.
    """
    spark = docs.sparkSession
    bits, n = packed.bucket_bits(spark), packed.partitions(spark)
    homes = _prime(1 << bits)
    plain = packed.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = packed.dealt(plain.filter("doc_id is not null").mapInArrow(_occurrences(bits, homes, width), packed.SCHEMA), n, bits)
    # answers are few beside the windows, whose shuffle files can go before the texts write theirs
    answers = packed.checkpointed(found.mapInArrow(_first_places(bits, homes), packed.SCHEMA))
    del found
    packed.released(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] if with_text else []
    carried = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]) if rest else F.lit(None).cast("boolean")
    home = F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(homes)).cast("int"), F.lit(0))
    texts = docs.select(home.alias("bucket"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("payload"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried.alias("rest"))
    kind = texts.schema["rest"].dataType
    empty = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(kind).alias("rest")]
    both = answers.select("bucket", F.lit(0).alias("kind"), "payload", *empty).union(texts)
    both = packed.dealt(both, n, bits, "kind")
    from pyspark.sql.pandas.types import to_arrow_type

    run = _removal(bits, width, with_text, to_arrow_type(kind))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if not with_text:
        return both.mapInArrow(run, schema)
    out = both.mapInArrow(run, schema + f", text string, rest {kind.simpleString()}")
    back = [F.col("rest")[f"c{i}"].alias(c) for i, c in enumerate(rest)]
    new = [F.col(c).alias(_free(c, docs.columns)) for c in ("n_words", "n_removed", "kept_sha256")]
    return out.select("doc_id", *new, "text", *back)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_now"
    return name


class SuffixAutomaton:
    """Suffix automaton of word sequences; a separator that no document has keeps sequences apart."""

    def __init__(self, sequences: list[list[str]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for k, sequence in enumerate(sequences):
            for symbol in [*sequence, (k,)]:
                last = self._append(last, symbol)

    def _append(self, last: int, symbol) -> int:
        now = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = now
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            if self.length[q] == self.length[p] + 1:
                self.link[now] = q
            else:
                copy = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p >= 0 and self.next[p].get(symbol) == q:
                    self.next[p][symbol] = copy
                    p = self.link[p]
                self.link[q] = self.link[now] = copy
        return now

    def matching_statistics(self, sequence: list[str]) -> list[int]:
        """For each position, the length of the longest reference substring that ends there."""
        state = size = 0
        out = []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if symbol in self.next[state]:
                state, size = self.next[state][symbol], size + 1
            else:
                size = 0
            out.append(size)
        return out


REFERENCE_WORDS = 200_000
SHARD_WORDS = 20_000


def remove_reference_spans(docs: DataFrame, reference: DataFrame, width: int = WIDTH, text: str = "text", reference_text: str = "text") -> DataFrame:
    """docs without the word spans of at least width words that occur in the reference; adds n_removed.

    The reference is read to the driver only after its words are counted: above REFERENCE_WORDS this
    raises, and ``self_dedup`` over the union is the way to go. Shards of SHARD_WORDS words become
    one broadcast automaton each. Null texts stay null with 0 removed; other columns are kept, and where one is
    called n_removed, the new one is n_removed_now. An empty reference removes nothing.
    """
    spark = docs.sparkSession
    counted = reference.agg(F.coalesce(F.sum(F.size(F.split(F.col(reference_text), r"[\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    if counted > REFERENCE_WORDS:
        raise ValueError(f"the reference has {counted} words; automata of at most {REFERENCE_WORDS} are broadcast")
    shards, size = [[]], 0
    for (passage,) in reference.select(reference_text).filter(F.col(reference_text).isNotNull()).distinct().collect():
        shards[-1].append(split_words(passage))
        size += len(shards[-1][-1])
        if size >= SHARD_WORDS:
            shards, size = [*shards, []], 0
    held = spark.sparkContext.broadcast([SuffixAutomaton(s) for s in shards if s])

    @F.pandas_udf("struct<text string, n_removed long>")
    def stream(column):
        import pandas as pd

        out = []
        for value in column:
            if value is None:
                out.append((None, 0))
                continue
            sequence, gone = split_words(value), set()
            for automaton in held.value:
                for i, n in enumerate(automaton.matching_statistics(sequence)):
                    if n >= width:
                        gone.update(range(i + 1 - n, i + 1))
            out.append((value if not gone else " ".join(x for i, x in enumerate(sequence) if i not in gone), len(gone)))
        return pd.DataFrame(out, columns=["text", "n_removed"])

    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    s = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()]).withColumn("found", stream(F.col(names[text])))
    return s.select(*[(F.col("found.text") if c == text else F.col(x)).alias(c) for c, x in names.items()], F.col("found.n_removed").alias(_free("n_removed", docs.columns)))


def split_words(value: str) -> list[str]:
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", value)
