"""Tokens, n-grams, windows and delimiter-safe hashes as Spark columns; keyed feature hashes through Arrow."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import policy as P


def semantic(value: Column) -> Column:
    return F.translate(F.lower(value), "- ", "__")


def event_token(phase: Column, category: Column, op: Column, target: Column) -> Column:
    return F.format_string("P:%s|C:%s|O:%s|T:%s", phase, category, op, F.translate(F.lower(target), " ", "_"))


def model_event_token(phase: Column, category: Column, op: Column, target: Column) -> Column:
    return F.format_string("P:%s|C:%s|O:%s|T:%s", phase, category, op, P.model_target_class(op, target))


def path_token(motif: Column, kind: Column, confidence: Column) -> Column:
    return F.format_string("PATH:%s|K:%s|Q:%s", semantic(motif), semantic(kind), semantic(confidence))


def ngrams(tokens: Column, least: int = 1, most: int = 3) -> Column:
    """All runs of least to most tokens between a begin and an end mark, joined by arrows, shorter runs first."""
    t = F.concat(F.array(F.lit("BOS")), tokens, F.array(F.lit("EOS")))
    sizes = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda n: n <= F.size(t))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), "→"))
    return F.flatten(F.transform(sizes, runs))


def windows(tokens: Column, width: int = 254, overlap: int = 32, most: int = 16) -> Column:
    """Overlapping runs of a sequence; an empty one has one empty run."""
    stride = max(1, width - min(overlap, max(0, width - 1)))
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil((F.size(tokens) - width) / stride).cast("int") + 1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(tokens, k * stride + 1, width))


def _framed(x: Column) -> Column:
    return F.concat(F.lpad(F.hex(F.octet_length(x).cast("long")), 16, "0"), F.hex(F.encode(x, "utf-8")))


def sequence_hash(tokens: Column) -> Column:
    """SHA-256 of tokens, each after its length, so that no delimiter can be forged."""
    return F.sha2(F.unhex(F.array_join(F.transform(tokens, _framed), "")), 256)


def multiset_hash(payloads: Column) -> Column:
    """SHA-256 of an array of binaries whatever their order: sorted (length, digest) entries, each after its length."""
    return entries_hash(F.transform(payloads, payload_entry))


def payload_entry(payload: Column) -> Column:
    """What a multiset hash keeps of a binary: its length and digest, so that whole payloads need not be gathered."""
    return F.concat(F.lpad(F.hex(F.octet_length(payload).cast("long")), 16, "0"), F.upper(F.sha2(payload, 256)))


def entries_hash(entries: Column) -> Column:
    framed = F.transform(F.array_sort(entries), lambda e: F.concat(F.lit("0000000000000028"), e))
    return F.sha2(F.unhex(F.array_join(framed, "")), 256)


def json_hash(tokens: Column) -> Column:
    """SHA-256 of a token list as compact JSON with all other than ASCII escaped."""
    import json

    @F.pandas_udf("string")
    def hashed(column):
        return column.map(lambda t: None if t is None else hashlib.sha256(json.dumps([str(x) for x in t], separators=(",", ":")).encode()).hexdigest())

    return hashed(tokens)


def first_occurrences(tokens: Column) -> Column:
    return F.array_distinct(tokens)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; two empty sets are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def bucket(features: Column, dimensions: int = 1 << 16, person: bytes = b"brindle1", grams: tuple[int, int] | None = None) -> Column:
    """array<struct<index, sign>>: an 8-byte BLAKE2b of each feature modulo dimensions; the top bit is the sign.

    person separates families of hashes; models bring their own. With grams the features are token lists, of which ngrams
    are taken here, as Spark does not pass what has a lambda to a Python function.
    """

    @F.pandas_udf("array<struct<index int, sign double>>")
    def hashed(column):
        known: dict = {}

        def one(f):
            if f not in known:
                v = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8, person=person).digest(), "little")
                known[f] = {"index": v % dimensions, "sign": -1.0 if v >> 63 else 1.0}
            return known[f]

        def runs(fs):
            t = ["BOS", *fs, "EOS"]
            return ["→".join(t[i : i + n]) for n in range(grams[0], grams[1] + 1) for i in range(len(t) - n + 1)]

        return column.map(lambda fs: None if fs is None else [one(f) for f in (runs(fs) if grams else fs)])

    return hashed(features)


def sparse_vector(features: Column) -> Column:
    """map<int, double> of hashed features, scaled to length one where it is not zero."""
    ids = F.array_sort(F.array_distinct(F.transform(features, lambda f: f["index"])))
    sums = F.transform(ids, lambda i: F.struct(i.alias("index"), F.aggregate(F.filter(features, lambda f: f["index"] == i), F.lit(0.0), lambda t, f: t + f["sign"]).alias("value")))
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda t, s: t + s["value"] * s["value"]))
    return F.map_from_entries(F.transform(sums, lambda s: F.struct(s["index"], F.when(norm > 0, s["value"] / norm).otherwise(s["value"]))))


PAD, BEGIN, END, MASK, FIRST = range(5)


def encode_ids(tokens: Column, length: int = 256, vocabulary: int = 4096, person: bytes = b"brindle2") -> Column:
    """struct<ids, mask>: begin, hashed tokens cut to fit, end, padding."""
    hashed = F.transform(bucket(F.slice(tokens, 1, length - 2), vocabulary - FIRST, person), lambda b: b["index"] + FIRST)
    ids = F.concat(F.array(F.lit(BEGIN)), hashed, F.array(F.lit(END)))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(PAD), length - F.size(ids)))
    return F.struct(pad(ids).alias("ids"), pad(F.transform(ids, lambda _: F.lit(1))).alias("mask"))
