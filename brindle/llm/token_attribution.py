"""Token counts attributed to fields or sections through character spans.

Each document is encoded once, whole. The byte lengths of its tokens are mapped to offsets: a token's span is the
characters that it holds a byte of, so several tokens of one character have its span each. Spans are joined by
interval with those of the document's sections, which are whole characters. A token that lies in one section counts
there. A token that crosses a boundary is allocated by an explicit rule:

- ``first``: to the section of its first character;
- ``last``: to the section of its last character;
- ``most``: to the section that holds most of its characters, the earlier one of equals;
- ``share``: to every section it touches, by its share of characters (counts become fractions).

Whatever the rule, the counts of a document's sections sum to the tokens of the whole document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.packed import small_batches
from brindle.llm.piece_cache import END_OF_TEXT, ByteLevel

RULES = ("first", "last", "most", "share")
SECTIONS = ("table", "list", "shout", "prose", "blank")
_LIST = re.compile(rb"[ \t]*(?:[-*\xe2]|[0-9]+[.)])")


def line_sections(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends (characters) and kinds (places in SECTIONS) of a text's sections: runs of lines of one kind, with their line feeds."""
    ends, kinds, at = [], [], 0
    for line in raw.split(b"\n"):
        at += len(line) + 1
        if b" | " in line:
            k = 0
        elif not line.strip():
            k = 4
        elif _LIST.match(line):
            k = 1
        elif line.isupper():
            k = 2
        else:
            k = 3
        if kinds and kinds[-1] == k:
            ends[-1] = at
        else:
            ends.append(at)
            kinds.append(k)
    ends[-1] = len(raw)
    if len(ends) > 1 and ends[-1] == ends[-2]:  # nothing after the last line feed
        ends.pop()
        kinds.pop()
    return character_of(raw)[np.array(ends, dtype=np.int64)], np.array(kinds)


def character_of(raw: bytes) -> np.ndarray:
    """How many characters begin before each byte place of a UTF-8 text, its end included."""
    begins = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    out = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(begins, out=out[1:])
    return out


def spans(token_bytes: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each token, from the tokens' byte lengths."""
    end = np.cumsum(token_bytes)
    before = character_of(raw)
    # a token that begins inside a character holds a part of that one
    return before[np.minimum(end - token_bytes + 1, len(raw))] - 1, before[end]


def allocate(begin: np.ndarray, token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section by a rule, and how many tokens cross a boundary; both cover the same characters."""
    n = len(section_ends)
    if not len(token_ends):
        return np.zeros(n), 0
    a = np.searchsorted(section_ends, begin, "right")
    z = np.searchsorted(section_ends, token_ends - 1, "right")
    crossing = np.flatnonzero(a != z)
    if rule == "share":
        out = np.bincount(a[a == z], minlength=n).astype(np.float64)
    else:
        to = z.copy() if rule == "last" else a.copy()
        if rule == "most":
            for i in crossing:
                cut = np.concatenate([[begin[i]], section_ends[a[i] : z[i]], [token_ends[i]]])
                to[i] = a[i] + int(np.argmax(np.diff(cut)))
        return np.bincount(to, minlength=n).astype(np.float64), len(crossing)
    for i in crossing:
        cut = np.concatenate([[begin[i]], section_ends[a[i] : z[i]], [token_ends[i]]])
        out[a[i] : z[i] + 1] += np.diff(cut) / (token_ends[i] - begin[i])
    return out, len(crossing)


def _sections(made_of: tuple, rule: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), *[(f"tokens_{s}", pa.float64()) for s in SECTIONS]])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteLevel.held(*made_of)
        for batch in incoming:
            rows = []
            for text in batch.column("text").to_pylist():
                if not text:
                    rows.append((0, 0, *[0.0] * len(SECTIONS)))
                    continue
                ids = np.frombuffer(tokens.ids(text), dtype="<u4")
                raw = text.encode()
                ends, kinds = line_sections(raw)
                counts, crossing = allocate(*spans(tokens.lengths[ids], raw), ends, rule)
                rows.append((len(ids), crossing, *np.bincount(kinds, weights=counts, minlength=len(SECTIONS)).tolist()))
            columns = list(zip(*rows)) if rows else [[]] * (2 + len(SECTIONS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=schema)

    return run


def section_tokens(docs: DataFrame, ranks_file: str, pattern: str, rule: str = "most", text: str = "text", key: str = "doc_id", special: tuple = END_OF_TEXT) -> DataFrame:
    """doc_id, n_tokens of the whole text, n_crossing, and tokens_<section> of each kind of section.

    Sections are runs of lines of one kind (SECTIONS); a line feed belongs to the line before it. A null or
    empty text has no tokens. Null and repeated keys are kept row by row; extra columns are ignored;
    an empty table gives no rows. Texts of any length are encoded whole, one at a time.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = "doc_id long, n_tokens long, n_crossing long, " + ", ".join(f"tokens_{s} double" for s in SECTIONS)
    return rows.mapInArrow(_sections((ranks_file, pattern, tuple(special)), rule), kind)


def field_tokens(rows: DataFrame, fields: list[str], ranks_file: str, pattern: str, rule: str = "most", between: str = "\n", special: tuple = END_OF_TEXT) -> DataFrame:
    """rows with tokens_<field> of each field and n_tokens, n_crossing of all fields joined and encoded once.

    Null fields count as empty and hold no tokens; each separator belongs to the field before it. Columns of rows
    that are named like a new one are replaced; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    gap = len(between)

    @F.pandas_udf("struct<n_tokens long, n_crossing long, parts array<double>>")
    def counted(*columns):
        import pandas as pd

        tokens = ByteLevel.held(ranks_file, pattern, tuple(special))
        out = []
        for values in zip(*columns):
            values = [v or "" for v in values]
            whole = between.join(values)
            ids = np.frombuffer(tokens.ids(whole), dtype="<u4")
            ends = np.cumsum([len(v) + gap for v in values])
            ends[-1] -= gap
            # an empty last field shares its end with the one before: it holds no character
            n, crossing = allocate(*spans(tokens.lengths[ids], whole.encode()), ends, rule)
            out.append((len(ids), crossing, n.tolist()))
        return pd.DataFrame(out, columns=["n_tokens", "n_crossing", "parts"])

    new = "counted"
    while new in rows.columns:
        new += "_"
    c = rows.withColumn(new, counted(*[F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]))
    made = {"n_tokens": F.col(new)["n_tokens"], "n_crossing": F.col(new)["n_crossing"], **{f"tokens_{f}": F.col(new)["parts"][i] for i, f in enumerate(fields)}}
    return c.select(*[F.col(f"`{x}`") for x in rows.columns if x not in made], *[v.alias(x) for x, v in made.items()])
