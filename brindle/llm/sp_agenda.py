"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda.

A text starts as single characters. Every adjacent pair whose concatenation is a piece waits in an
agenda ordered by score, then by place from the left; the best pair is merged, its new neighbours
enter the agenda, and entries whose symbols have been merged meanwhile are passed over. What is no
piece at the end is spelled in byte pieces. Merges never reach over a character that no longer
piece contains, nor into a space mark from the left where no piece has one after another character;
texts are cut there, and each distinct part is encoded once per worker.

Parts that a batch sees first are compared with the sentencepiece library at once, in that batch. Where the two differ,
the ids are the library's, which are what the encoding is defined by; ``differing`` counts such parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.packed import small_batches

CACHE_PARTS = 600_000
SHORT = 32
LONG_PART = 64
MARK = "▁"
NO_PIECE = float("-inf")
_HELD: dict = {}


class Agenda:
    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        kind = lambda i: self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)
        self.byte = {i: int(self.pieces[i][3:5], 16) for i in range(n) if self.library.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.control = {i for i in range(n) if self.library.is_control(i)}
        self.unknown = self.library.unk_id()
        self.id = {p: i for i, p in enumerate(self.pieces) if not kind(i) and i not in self.byte}
        self.plain = set(self.id.values())
        self.score = {p: self.library.get_score(i) for p, i in self.id.items()}
        longer = [p for p in self.id if len(p) > 1]
        self.line_cut = not any("\n" in p for p in longer)
        self.space_cut = not any(MARK in p.lstrip(MARK) for p in longer)
        self.cache: dict[str, tuple[str, str]] = {}
        self.differing = 0

    @classmethod
    def held(cls, model_file: str) -> Agenda:
        """One per worker process."""
        if model_file not in _HELD:
            _HELD[model_file] = cls(model_file)
        return _HELD[model_file]

    def merge(self, part: str) -> list[int]:
        """Ids of a part, in which spaces are already marks."""
        if len(part) <= SHORT:
            return self.spelled(self.merge_short(part))
        symbol = list(part)
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        score = self.score
        agenda = []
        for i in range(n - 1):
            pair = symbol[i] + symbol[i + 1]
            s = score.get(pair)
            if s is not None:
                agenda.append((-s, i, i + 1, pair))
        heapify(agenda)
        while agenda:
            _, i, j, pair = heappop(agenda)
            if symbol[i] is None or symbol[j] is None or after[i] != j or len(symbol[i]) + len(symbol[j]) != len(pair):
                continue
            symbol[i], symbol[j] = pair, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                joint = pair + symbol[k]
                s = score.get(joint)
                if s is not None:
                    heappush(agenda, (-s, i, k, joint))
            h = before[i]
            if h >= 0:
                joint = symbol[h] + pair
                s = score.get(joint)
                if s is not None:
                    heappush(agenda, (-s, h, i, joint))
        return self.spelled([s for s in symbol if s is not None])

    def merge_short(self, part: str) -> list[str]:
        """The same for a few characters: the agenda is the list of scores itself, of which the first highest is next."""
        symbol, score = list(part), self.score.get
        agenda = [score(a + b, NO_PIECE) for a, b in zip(symbol, symbol[1:])]
        while agenda:
            best = max(agenda)
            if best == NO_PIECE:
                break
            i = agenda.index(best)
            joint = symbol[i] = symbol[i] + symbol[i + 1]
            del symbol[i + 1], agenda[i]
            if i:
                agenda[i - 1] = score(symbol[i - 1] + joint, NO_PIECE)
            if i < len(agenda):
                agenda[i] = score(joint + symbol[i + 1], NO_PIECE)
        return symbol

    def spelled(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            i = self.id.get(s)
            if i is not None:
                out.append(i)
            elif self.of_byte:
                out += [self.of_byte[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids before the leading space is dropped; runs of byte pieces are UTF-8, bad bytes U+FFFD each."""
        if self.plain.issuperset(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte:
                run.append(self.byte[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.pieces[i].replace(MARK, " "))
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def parts(self, text: str) -> list[str]:
        """The text with its leading space, cut where no merge can reach."""
        text = " " + text.replace(MARK, " ")
        if not self.space_cut:
            return [text]
        lines = text.split("\n") if self.line_cut else [text]
        out = []
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            if not line:
                continue
            words = line.split(" ")
            if "" in words[1:]:
                spaces = 0
                if words[0]:
                    out.append(words[0])
                for w in words[1:]:
                    spaces += 1
                    if w:
                        out.append(" " * spaces + w)
                        spaces = 0
                if spaces:
                    out.append(" " * spaces)
                continue
            if words[0]:
                out.append(words[0])
            out += [" " + w for w in words[1:]]
        return out

    def learn(self, new: list[str]) -> dict[str, tuple[str, str]]:
        """Encodes parts, checks them against the library, and gives their ids as text and their decoded text."""
        out = {}
        ids = [self.merge(p.replace(" ", MARK)) for p in new]
        # the library puts a space before each text, so each part is asked after a line feed
        told = self.library.encode(["\n" + p for p in new], num_threads=1)
        lead = len(self.library.encode("\n"))
        for p, own, lib in zip(new, ids, told):
            lib = lib[lead:]
            if own != lib:
                self.differing += 1
                own = lib
            decoded = self.decode(own)
            out[p] = (",".join(map(str, own)), p if decoded == p else decoded)
        return out

    def batch(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of its ids, the ids joined by commas, and the text decoded from them."""
        cut = [self.parts(t) if t else [] for t in texts]
        cache = self.cache
        new = list({p for ps in cut for p in ps if p not in cache})
        if len(cache) + len(new) > CACHE_PARTS:
            cache.clear()
            new = list({p for ps in cut for p in ps})
        learned = self.learn(new)
        if len(new) <= CACHE_PARTS:
            cache.update((p, v) for p, v in learned.items() if len(p) <= LONG_PART)
        get = cache.get
        for ps in cut:
            got = [get(p) or learned[p] for p in ps]
            ids, text = ",".join([g[0] for g in got]), "".join([g[1] for g in got])
            yield ids.count(",") + bool(ids), ids, text[1:] if text[:1] == " " else text


def _utf8(run: bytearray) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def _encode(model_file: str, digests: bool):
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = Agenda.held(model_file)
        for batch in incoming:
            keys, column = batch.column("doc_id"), batch.column("text")
            for a, b in _slices(column):
                rows = list(agenda.batch(column.slice(a, b - a).to_pylist()))
                n = pa.array([r[0] for r in rows], pa.int64())
                if digests:
                    first = pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string())
                    second = pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string())
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    first = pa.array([list(map(int, r[1].split(","))) if r[1] else [] for r in rows], pa.list_(pa.int32()))
                    second = pa.array([r[2] for r in rows], pa.string())
                    names = ["doc_id", "n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), n, first, second], names=names)

    return run


def _slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about most bytes."""
    import numpy as np

    from brindle.llm.words import string_buffers

    at = string_buffers(column)[1]
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, b
        a = b


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of each row, or with digests the SHA-256 of both.

    ids hold neither begin nor end. A null or empty text has no ids and decodes to an empty text. Null and
    repeated keys are kept row by row; extra columns are ignored; an empty table gives no rows. Texts of
    any length are encoded whole. The model must be of the merge type without normalisation.
    """
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return rows.mapInArrow(_encode(model_file, digests), kind)
