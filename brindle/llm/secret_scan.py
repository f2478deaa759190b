"""Secrets in whole texts: fixed patterns, and character Markov models for what no pattern names.

Two second-order models of characters are trained from labelled strings: random strings (label 1) and
ordinary identifiers and words (label 0). A candidate is a run of token characters, less what fixed
patterns cover; a secret is any stretch of it where the log-likelihood ratio of the two models is high
enough, in all and per character, so words around a key don't hide it.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.packed import checkpointed, small_batches

KINDS = ("assign", "access", "hex", "markov")
# The patterns of the base kinds and the shortest match of each.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# A run of hex digits or of upper-case letters and digits is taken whole, so runs too short never hide a longer match.
_ACCESS_LONG = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")
SHORTEST = 16  # as the random strings that the model is trained on
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_SEPARATORS = "+/_=-"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_CODE = {c: i for i, c in enumerate(ALPHABET)}
_N = len(ALPHABET) + 1  # one more for the start and for any other character
SAMPLE_DOCUMENTS = 2000
SAMPLE_STRINGS = 20_000


class CharacterModel:
    """Second-order Markov chain; a context seen rarely leans on the shorter one."""

    def __init__(self, strings: list[str]):
        count = np.zeros((_N, _N, _N))
        for s in strings:
            a = b = _N - 1
            for c in s:
                k = _CODE.get(c, _N - 1)
                count[a, b, k] += 1
                a, b = b, k
        one = count.sum(axis=(0, 1)) + 0.5
        one /= one.sum()
        two = count.sum(axis=0) + 2 * one
        two /= two.sum(axis=1, keepdims=True)
        three = count + 2 * two[None]
        self.log = np.log(three / three.sum(axis=2, keepdims=True))

    def score(self, s: str) -> float:
        a = b = _N - 1
        total = 0.0
        for c in s:
            k = _CODE.get(c, _N - 1)
            total += self.log[a, b, k]
            a, b = b, k
        return total


class LikelihoodRatio:
    """Log-likelihood ratio of random strings to ordinary ones, with the thresholds that make a secret."""

    def __init__(self, labelled: list[tuple[str, int]], total: float = 12.0, per_character: float = 0.5):
        self.random = CharacterModel([s for s, y in labelled if y])
        self.ordinary = CharacterModel([s for s, y in labelled if not y])
        self.ratio = self.random.log - self.ordinary.log
        self.total, self.per_character = total, per_character

    def steps(self, s: str) -> list[float]:
        """The log-likelihood ratio of each character after those before it."""
        a = b = _N - 1
        out = []
        for c in s:
            k = _CODE.get(c, _N - 1)
            out.append(float(self.ratio[a, b, k]))
            a, b = b, k
        return out

    def value(self, s: str) -> float:
        return sum(self.steps(s))

    def segments(self, s: str) -> list[tuple[int, int]]:
        """Stretches of s that are secrets, found by a running sum of what each character has over the threshold.

        A stretch ends at its highest sum, once the sum is below zero or by the total below that. It is taken to the
        separators or ends of s around it where that is a secret too.
        """
        if len(s) < SHORTEST or len(set(s)) < 8:
            return []
        step = self.steps(s)
        sums = [0.0]
        for x in step:
            sums.append(sums[-1] + x)

        def good(a: int, b: int) -> bool:
            v = sums[b] - sums[a]
            return b - a >= SHORTEST and v >= self.total and v >= self.per_character * (b - a) and len(set(s[a:b])) >= 8 and any(c.isalpha() for c in s[a:b])

        out, at, free = [], 0, 0
        while at < len(s):
            total, most, end = 0.0, 0.0, at
            for i in range(at, len(s)):
                total += step[i] - self.per_character
                if total > most:
                    most, end = total, i + 1
                elif total < 0 or total < most - self.total:
                    break
            if end == at:
                at += 1
                continue
            a, b = at, end
            while a > free and s[a - 1] not in _SEPARATORS:
                a -= 1
            while b < len(s) and s[b] not in _SEPARATORS:
                b += 1
            for x, y in ((a, b), (at, b), (a, end), (at, end)):
                if good(x, y):
                    out.append((x, y))
                    free = end = y
                    break
            at = end
        return out

    def is_secret(self, s: str) -> bool:
        return bool(self.segments(s))


def random_strings(n: int, seed: int = 20240611) -> list[str]:
    """Labelled 1: uniform strings over the alphabets that keys are written in, 16 to 64 long."""
    r = random.Random(seed)
    sets = [ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "-_", ALPHABET[:26] + "234567", "0123456789abcdef", "0123456789ABCDEF"]
    return ["".join(r.choices(r.choice(sets), k=r.randint(16, 64))) for _ in range(n)]


def ordinary_strings(words: list[str], n: int, seed: int = 20240612) -> list[str]:
    """Labelled 0: words, and identifiers made of them in the usual ways (joined by case, -, _, / and numbers)."""
    r = random.Random(seed)
    words = [w for w in words if w.isalnum()] or ["word"]
    out = []
    for _ in range(n):
        k = [r.choice(words) for _ in range(r.randint(1, 5))]
        if r.random() < 0.3:
            k.insert(r.randrange(len(k) + 1), str(r.choice([r.randint(0, 99), r.randint(1900, 2100), r.randint(0, 10**6)])))
        style = r.randrange(6)
        out.append("".join(x.capitalize() for x in k) if style == 0 else "_".join(k).upper() if style == 1 else "_-/="[style - 2].join(k))
    return out


def train(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, strings: int = SAMPLE_STRINGS) -> LikelihoodRatio:
    """Fits both models to at most strings labelled strings each; words come from about documents texts.

    Both bounds are parameters. The texts are those whose keys hash into that share of all rows, read whole in the
    executors; only distinct words without long runs of hex digits reach the driver, and of these about
    strings, by their hash too.
    """
    share = documents / max(1, docs.count())
    some = docs.filter("text is not null").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40)))
    word = some.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,20}"), F.lit(0))).alias("word")).distinct()
    word = checkpointed(word.filter(~F.col("word").rlike(_HEX_LONG.pattern)))
    few = strings / max(1, word.count())
    words = sorted(r.word for r in word.filter(F.pmod(F.xxhash64("word", F.lit(1)), F.lit(1 << 40)) < int(min(1.0, few) * (1 << 40))).collect())
    labelled = [(s, 1) for s in random_strings(strings)] + [(s, 0) for s in ordinary_strings(words, strings)]
    return LikelihoodRatio(labelled)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            out.append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS_LONG.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX_LONG.finditer(text)]
    return out


def markov_spans(text: str, base: list[tuple[str, int, int]], ratio: LikelihoodRatio) -> list[tuple[str, int, int]]:
    out = []
    taken = sorted((a, b) for _, a, b in base)
    first = 0
    for m in CANDIDATE.finditer(text):
        while first < len(taken) and taken[first][1] <= m.start():
            first += 1
        at = m.start()
        for a, b in [*itertools.takewhile(lambda t: t[0] < m.end(), itertools.islice(taken, first, None)), (m.end(), m.end())]:
            out += [("markov", at + x, at + y) for x, y in ratio.segments(text[at:a])]
            at = max(at, b)
    return out


def _order(s: tuple[str, int, int]) -> tuple[int, int]:
    return s[1], KINDS.index(s[0])


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=_order))


def _scan(ratio: LikelihoodRatio):
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = markov_spans(text or "", base, ratio)
                n = [sum(k == s[0] for s in base) for k in KINDS[:3]]
                rows.append((*n, len(more), hashlib.sha256(written(base).encode()).hexdigest(), written(base + more)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=schema)

    return run


def scan(docs: DataFrame, ratio: LikelihoodRatio | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, counts n_assign, n_access, n_hex and n_markov, base_sha256 and spans ("kind:start:end,...") of each row.

    Offsets are code points, the end exclusive. A null text counts as empty. Null and repeated keys are
    kept row by row, extra columns ignored; an empty table gives no rows. Texts of any length are
    scanned whole. Without a ratio one is trained from docs.
    """
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ratio = ratio or train(rows)
    return rows.mapInArrow(_scan(ratio), "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(docs: DataFrame, ratio: LikelihoodRatio | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with each secret span replaced by "[secret]"; overlapping spans become one. Nulls stay null."""
    ratio = ratio or train(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))

    @F.pandas_udf("string")
    def hidden(column):
        def one(value):
            if value is None:
                return None
            base = base_spans(value)
            out, at = [], 0
            for _, a, b in sorted(base + markov_spans(value, base, ratio), key=_order):
                if b > at:
                    out += [value[at : max(a, at)], "[secret]" if a >= at else ""]
                    at = b
            return "".join(out) + value[at:]

        return column.map(one)

    return docs.withColumn(text, hidden(F.col(text)))
