"""Behaviour paths from ordered event rows: proximity within a look-back window, and structural patterns.

Events have target_id, path, function, event_index, op, target, phase and detail. Exact paths, found by value provenance,
come in as rows (target_id, path, motif, event_indexes, evidence_kind, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import policy as P
from brindle.functions import vocabulary as V

LOOK_BACK = 12
FIELDS = ("target_id", "path", "motif", "score", "reason", "event_indexes", "evidence_kind", "confidence")


def _path(motif: Column, kind: str, confidence: str, indexes: Column, unproven: str = V.UNPROVEN) -> list[Column]:
    score, reason = F.lit(None).cast("double"), F.lit(None).cast("string")
    if kind == "structural":
        for m, (s, r) in V.STRUCTURES.items():
            score, reason = F.when(motif == m, s).otherwise(score), F.when(motif == m, r).otherwise(reason)
    else:
        for m, (exact, near, r) in V.FLOWS.items():
            score = F.when(motif == m, near if kind == "proximity" else exact).otherwise(score)
            text = r.replace(" flows into ", " appears near ") + f"; {unproven}" if kind == "proximity" else r + (V.SUMMARY_REASON if kind == "summary" else "")
            reason = F.when(motif == m, text).otherwise(reason)
    return [motif.alias("motif"), score.alias("score"), reason.alias("reason"), indexes.alias("event_indexes"), F.lit(kind).alias("evidence_kind"), F.lit(confidence).alias("confidence")]


def proximity_paths(events: DataFrame, exact: DataFrame | None = None, look_back: int = LOOK_BACK, unproven: str = V.UNPROVEN) -> DataFrame:
    """Sources or transforms among the look_back earlier events of a sink's function.

    A window frame collects them, so no band join is made. Network sinks take the last two sources of any kind and keep
    those that fit a pattern; execution sinks take the last receive and the last transform. Pairs that exact paths join
    already (any earlier index with the last one) are left out.
    """
    frame = Window.partitionBy("target_id", "path", "function").orderBy("event_index").rowsBetween(-look_back, -1)
    # only what a rule can use is carried in the frame
    seen = F.when(F.col("op").isin(*V.SOURCES, *V.TRANSFORMS), F.struct("event_index", "op", P.is_sensitive_env(F.col("target")).alias("secret")))
    near = F.filter(F.collect_list(F.coalesce(seen, F.struct(F.lit(None).cast("long").alias("event_index"), F.lit("").alias("op"), F.lit(False).alias("secret")))).over(frame), lambda x: x["op"] != "")
    rows = events.select("target_id", "path", "event_index", "op", near.alias("near")).filter(F.col("op").isin("NETWORK_SEND", *V.EXECUTIONS))
    sources = F.filter("near", lambda x: x["op"].isin(*V.SOURCES))
    last_two = F.slice(sources, F.greatest(F.size(sources) - 1, F.lit(1)), 2)
    motif = lambda x: (
        F.when(x["op"] == "BROWSER_COOKIE_READ", "browser_session_transfer").when((x["op"] == "SENSITIVE_FILE_READ") | (x["op"] == "ENV_READ") & x["secret"], "credential_or_file_exfil")
        .when(x["op"] == "SYSTEM_DISCOVERY", "fingerprinting_transfer").when(x["op"] == "FILE_READ", "file_to_network")
    )
    item = lambda m, x: F.struct(m.alias("motif"), x["event_index"].alias("source"))
    sent = F.transform(last_two, lambda x: item(motif(x), x))
    last = lambda ops, m: F.transform(F.slice(F.reverse(F.filter("near", lambda x: x["op"].isin(*ops))), 1, 1), lambda x: item(F.lit(m), x))
    found = F.when(F.col("op") == "NETWORK_SEND", sent).otherwise(F.concat(last(("NETWORK_RECEIVE",), "download_execute"), last(V.TRANSFORMS, "encoded_execution")))
    pairs = rows.select("target_id", "path", F.col("event_index").alias("sink"), F.explode(found).alias("f")).select("target_id", "path", "sink", "f.*").filter("motif is not null").distinct()
    if exact is not None:
        known = exact.filter(F.col("evidence_kind").isin("dataflow", "summary")).select("target_id", "path", "motif", F.element_at("event_indexes", -1).cast("long").alias("sink"), F.explode(F.slice(F.col("event_indexes").cast("array<long>"), 1, F.size("event_indexes") - 1)).alias("source"))
        pairs = pairs.join(known.distinct(), ["target_id", "path", "motif", "source", "sink"], "left_anti")
    return pairs.select("target_id", "path", *_path(F.col("motif"), "proximity", "low", F.array("source", "sink"), unproven))


def structural_paths(events: DataFrame) -> DataFrame:
    """Patterns that one event makes by itself."""
    op, install = F.col("op"), F.col("phase") == "install"
    motifs = F.array(
        F.when(op.isin("NETWORK_RECEIVE", "NETWORK_SEND") & install, "install_time_network_access"), F.when(op.isin(*V.EXECUTIONS) & install, "install_time_execution"), F.when(op == "PERSISTENCE_WRITE", "persistence_write"),
        F.when((op == "FILE_DELETE") & P.is_destructive_delete(F.col("target"), F.col("detail") == V.RECURSIVE_DELETE), "destructive_file_action"),
    )
    rows = events.select("target_id", "path", F.col("event_index").cast("long").alias("event_index"), F.explode(F.filter(motifs, lambda m: m.isNotNull())).alias("motif")).distinct()
    return rows.select("target_id", "path", *_path(F.col("motif"), "structural", "high", F.array("event_index")))


def exact_paths(found: DataFrame) -> DataFrame:
    """Paths from (target_id, path, motif, event_indexes, through_summary), one of each."""
    one = found.groupBy("target_id", "path", "motif", F.col("event_indexes").cast("array<long>").alias("event_indexes"), "through_summary").agg(F.count("*").alias("n"))
    side = lambda flag, kind, confidence: one.filter(F.col("through_summary") == flag).select("target_id", "path", *_path(F.col("motif"), kind, confidence, F.col("event_indexes")))
    return side(False, "dataflow", "high").unionByName(side(True, "summary", "medium"))


def behavior_paths(events: DataFrame, exact: DataFrame | None = None, look_back: int = LOOK_BACK, unproven: str = V.UNPROVEN) -> DataFrame:
    out = proximity_paths(events, exact, look_back, unproven).unionByName(structural_paths(events))
    return out if exact is None else exact.select(*FIELDS).unionByName(out)


def path_order() -> list[Column]:
    """The total order in which paths are listed."""
    return [F.desc("score"), F.asc("event_indexes"), F.asc("motif"), F.asc("evidence_kind")]
