"""Quality rules as a bitmask ledger.

``ledger`` measures every document once and stores each rule's failure as a bit beside the
measurements. Policies are sets of rules with a version; ``apply_policy`` and ``ablation`` read the bits
only, so a new policy or an ablation never touches a text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import words
from brindle.llm.packed import small_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_letter_words", "n_distinct_words", "n_exclaims")

#: name, SQL over the measurements that is true where a document fails; the place in this list is the bit. Only append.
RULES = (
    ("short", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_lines > 2 and 100 * n_dup_lines > 40 * n_lines"),
    ("capitals", "2 * n_upper_words > n_words"),
    ("exclamations", "2 * n_exclaims > n_words"),
    ("few_letters", "100 * n_letter_words < 40 * n_words"),
    ("short_words", "2 * word_chars < 5 * n_words"),
    ("long_words", "word_chars > 11 * n_words"),
    ("few_distinct_words", "100 * n_distinct_words < 12 * n_words"),
    # the share of distinct words falls as texts grow, about as the root of their length, so long ones are held to that
    ("few_words_for_length", "100 * n_distinct_words < 12 * n_words and n_distinct_words * n_distinct_words < 4 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: version -> the rules that reject; versions are never changed, only added.
POLICIES = {
    "base-1": ("short", "repeated_words"),
    "web-1": ("short", "repeated_words", "symbols", "repeated_lines", "capitals", "exclamations", "few_letters", "short_words", "long_words", "few_distinct_words"),
    "web-2": ("short", "repeated_words", "symbols", "repeated_lines", "capitals", "exclamations", "few_letters", "short_words", "long_words", "few_words_for_length"),
}
POLICY = "web-2"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[97:123] = True
_LETTER = _UPPER | _SMALL
_LETTER[128:] = True


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _per_range(flag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, dtype=np.int32)
    np.cumsum(flag, out=total[1:])
    return (total[end] - total[start]).astype(np.int64)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    new = words.first_of_run(doc[order], h[order])
    return np.bincount(doc[order][new], minlength=n)


def measure(t: words.Texts) -> list[np.ndarray]:
    """The measurements of each text, in the order of MEASURES."""
    w, n, data = words.split(t), len(t), t.data
    lo, hi = t.at[:-1], t.at[1:]
    n_words = np.diff(w.lo)
    lead = ((data & 0xC0) != 0x80) & ~words.SPACE[data]
    # lines: cut at 0x0A and at the ends of documents; only those with a word count
    cut = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([lo, cut + 1])) if len(data) else lo[:0]
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))[: len(start)]
    end = np.where(data[end - 1] == 10, end - 1, end) if len(end) else end
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[has_word], end[has_word]
    line_doc = np.searchsorted(t.at, start, "right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    n_distinct_lines = _distinct(line_doc, words.range_hash(data, start, end), n) if len(start) else n_lines
    # words in windows of five that occur twice or more
    first, h = words.windows(w, 5)
    doc = w.doc[first]
    order = np.lexsort((h, doc))
    new = words.first_of_run(doc[order], h[order])
    run = np.diff(np.append(np.flatnonzero(new), len(order)))
    again = first[order][np.repeat(run, run) > 1]
    step = np.zeros(len(w.start) + 1, dtype=np.int32)
    np.add.at(step, again, 1)
    np.add.at(step, again + 5, -1)
    repeated = np.bincount(w.doc[np.cumsum(step[:-1]) > 0], minlength=n)
    upper = (_per_range(_UPPER[data], w.start, w.end) > 0) & (_per_range(_SMALL[data], w.start, w.end) == 0)
    letter = _per_range(_LETTER[data], w.start, w.end) > 0
    return [
        n_words, _per_range(lead, lo, hi), _per_range(_SYMBOL[data], lo, hi), n_lines - n_distinct_lines, repeated, n_lines,
        np.bincount(w.doc[upper], minlength=n), np.bincount(w.doc[letter], minlength=n),
        _distinct(w.doc, w.hash, n) if len(w.doc) else n_words, _per_range(data == 33, lo, hi),
    ]


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns keep of docs, unchanged, beside the measurements of its texts."""
    from pyspark.sql.pandas.types import to_arrow_type

    carried = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    rows = small_batches(docs).select(F.col(text).cast("string").alias("text"), F.lit(0).cast("long").alias("doc_id"), carried.alias("rest"))
    kind = rows.schema["rest"].dataType
    schema = pa.schema([("rest", to_arrow_type(kind)), *[(m, pa.int64()) for m in MEASURES]])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for t in words.texts(batch):
                values = [pa.array(x.astype(np.int64)) for x in measure(t)]
                yield pa.RecordBatch.from_arrays([batch.column("rest").slice(t.row, len(t)), *values], schema=schema)

    out = rows.mapInArrow(run, f"rest {kind.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))
    return out.select(*[F.col("rest")[f"c{i}"].alias(c) for i, c in enumerate(keep)], *MEASURES)


def fail_bits() -> Column:
    """All rules over the measurements as one long."""
    return F.expr(" | ".join(f"if({test}, {BIT[name]}L, 0L)" for name, test in RULES))


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: the key, every measurement, and fail_bits.

    A null or empty text has no words and fails only the rules that no words fail. Null and repeated keys
    are kept as they are; columns of the same names as measurements do not clash, as only the key is
    carried. An empty table gives no rows. A text of any length is measured whole.
    """
    return measured(docs, [key], text).withColumn("fail_bits", fail_bits())


def verdict(policy: str = POLICY) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone (kept without it), and rows in all.

    Failure patterns are counted first (at most 2 ** rules rows), then their bits are aggregated.
    """
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum("n").alias("total"),
    )


def quality_filter(docs: DataFrame, policy: str = POLICY, text: str = "text") -> DataFrame:
    """The rows of docs that a policy keeps, with all their columns as they were."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}  # no clash with measurements
    rows = measured(docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()]), list(names.values()), names[text])
    return rows.withColumn("fail_bits", fail_bits()).filter(verdict(policy)).select(*[F.col(x).alias(c) for c, x in names.items()])
