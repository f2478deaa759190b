"""Source texts to event rows through the syntax tree, in Arrow batches."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources import syntax
from brindle.sources.provenance import value_paths

EVENT = "event_index int, op string, category string, target string, path string, line int, column int, function string, phase string, detail string"
PATH = "motif string, event_indexes array<int>, through_summary boolean"
SPAN = "first int, last int"
ANALYSIS = f"target_id string, path string, sha256 string, bytes_read long, truncated boolean, parse_error string, event_limit_reached boolean, events array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>, exact array<struct<{PATH.replace(' ', ':').replace(',:', ',')}>>, guards array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>, functions array<string>, main_functions array<string>, anchors array<string>, anchor_lines array<int>"


def _structure(tree: ast.Module) -> dict:
    """Main guards, top-level functions, those that guards reach by direct calls, and code-transformation calls."""
    guards = [n for n in tree.body if isinstance(n, ast.If) and "__name__" in {x.id for x in ast.walk(n.test) if isinstance(x, ast.Name)} and "__main__" in {x.value for x in ast.walk(n.test) if isinstance(x, ast.Constant)}]
    own = {n.name: n for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)}
    called = lambda n: {c.func.id for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name) and c.func.id in own}
    reach, todo = set(), set().union(*map(called, guards)) if guards else set()
    while todo:
        f = todo.pop()
        reach.add(f)
        todo |= called(own[f]) - reach
    calls = {ast.unparse(c.func) for c in ast.walk(tree) if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute)}
    anchors = sorted(c for c in calls if c in ("ast.parse", "ast.unparse", "ast.walk", "ast.fix_missing_locations", "tokenize.untokenize", "tokenize.generate_tokens") or c.startswith("compiler."))
    return {"guards": [{"first": g.lineno, "last": g.end_lineno} for g in guards], "functions": sorted(own), "main_functions": sorted(reach), "anchors": anchors}


def analyse(source: str, path: str, most: int = 2000, flow: bool = True, depth: int = 3, expansions: int = 64) -> dict:
    """Events, exact paths and structure of one text; errors are data."""
    out = {"parse_error": None, "event_limit_reached": False, "events": [], "exact": [], "guards": [], "functions": [], "main_functions": [], "anchors": [], "anchor_lines": []}
    tree, out["parse_error"] = syntax.parse(source)
    if tree is None:
        return out
    try:
        reader = syntax.Reader(tree, path, most)
    except RecursionError as e:
        return out | {"parse_error": str(e)}
    out |= {"events": reader.events, "event_limit_reached": reader.limited} | _structure(tree)
    if flow:
        try:
            out["exact"] = value_paths(tree, reader, depth, expansions)
        except RecursionError as e:
            out["parse_error"] = f"provenance stopped: {e}"
    return out


def analysed(sources: DataFrame, max_bytes: int, analyse: Callable[[str, str], dict]) -> DataFrame:
    """One row per source row (target_id, path, content binary) with what analyse(text, path) finds; only max_bytes are read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ANALYSIS))

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in incoming:
            rows = []
            for target, path, content in zip(*(batch.column(c).to_pylist() for c in ("target_id", "path", "content"))):
                raw = (content or b"")[:max_bytes]
                head = {"target_id": target, "path": path, "sha256": hashlib.sha256(raw).hexdigest(), "bytes_read": len(raw), "truncated": len(content or b"") > max_bytes}
                rows.append(head | analyse(raw.decode("utf-8", "replace"), path or ""))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sources.select("target_id", "path", "content").mapInArrow(run, ANALYSIS)


def extract(sources: DataFrame, max_bytes: int = 1_000_000, max_events: int = 2000, flow: bool = True, depth: int = 3, expansions: int = 64) -> DataFrame:
    """One analysis row per source row by the syntax tree."""
    return analysed(sources, max_bytes, lambda text, path: analyse(text, path, max_events, flow, depth, expansions))


def events_of(analyses: DataFrame) -> DataFrame:
    return analyses.select("target_id", F.explode("events").alias("e")).select("target_id", "e.*")


def exact_of(analyses: DataFrame) -> DataFrame:
    return analyses.select("target_id", "path", F.explode("exact").alias("x")).select("target_id", "path", "x.*")


def limited_of(analyses: DataFrame) -> DataFrame:
    return analyses.filter("event_limit_reached").select("target_id", "path")


def normalised_hash(files: DataFrame) -> DataFrame:
    """(target_id, ast_hash): of a target's texts with identifiers and literals levelled, whatever their names and order."""
    from brindle.functions.tokens import entries_hash, payload_entry

    @F.pandas_udf("binary")
    def plain(column):
        return column.map(lambda b: syntax.normal_form(b or b""))

    n = files.select("target_id", plain("content").alias("c")).select("target_id", payload_entry(F.col("c")).alias("e"))
    return n.groupBy("target_id").agg(entries_hash(F.collect_list("e")).alias("ast_hash"))
