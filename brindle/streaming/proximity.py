"""The look-back patterns over a stream of events, and session summaries.

State per function is its last twelve events; an event that comes later than the watermark allows is dropped and counted
by Spark's numRowsDroppedByWatermark. Within a batch events are taken in event order. Once a stream without late rows has
drained, its paths are those of the batch plan.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import vocabulary as V
from brindle.operators.patterns import LOOK_BACK

OUT = "target_id string, path string, motif string, source long, sink long, score double"
STATE = "events array<struct<event_index:long,op:string,secret:boolean>>"
_MARKERS = V.SENSITIVE_ENV


def pairs(near: list[tuple[int, str, bool]], index: int, op: str) -> list[tuple[str, int]]:
    """(motif, source index) of one event after its look-back."""
    if op == "NETWORK_SEND":
        out = []
        for i, o, secret in [n for n in near if n[1] in V.SOURCES][-2:]:
            motif = {"BROWSER_COOKIE_READ": "browser_session_transfer", "SENSITIVE_FILE_READ": "credential_or_file_exfil", "SYSTEM_DISCOVERY": "fingerprinting_transfer", "FILE_READ": "file_to_network"}.get(o)
            motif = "credential_or_file_exfil" if o == "ENV_READ" and secret else motif
            if motif:
                out.append((motif, i))
        return out
    if op in V.EXECUTIONS:
        last = lambda ops: [n[0] for n in near if n[1] in ops][-1:]
        return [("download_execute", i) for i in last(("NETWORK_RECEIVE",))] + [("encoded_execution", i) for i in last(V.TRANSFORMS)]
    return []


def _step(key, frames: Iterator, state):
    import pandas as pd

    held = [tuple(e) for e in (state.get[0] or [])] if state.exists else []
    rows = []
    pdf = pd.concat(list(frames)).sort_values("event_index")
    for index, op, target in zip(pdf["event_index"], pdf["op"], pdf["target"]):
        rows += [(key[0], key[1], motif, source, int(index), V.FLOWS[motif][1]) for motif, source in pairs(held, int(index), op)]
        secret = any(m in (target or "").lower().replace("\\", "/") for m in _MARKERS)
        held = [*held, (int(index), op, secret)][-LOOK_BACK:]
    state.update(([{"event_index": i, "op": o, "secret": s} for i, o, s in held],))
    yield pd.DataFrame(rows, columns=["target_id", "path", "motif", "source", "sink", "score"])


def proximity_stream(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Paths of a streaming frame of events with a ts column."""
    e = events.withWatermark("ts", lateness)
    return e.groupBy("target_id", "path", "function").applyInPandasWithState(_step, OUT, STATE, "append", "NoTimeout")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Counts per function and session, late rows aside; works on batches and streams."""
    e = events.withWatermark("ts", lateness) if events.isStreaming else events
    s = e.groupBy("target_id", "function", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("op").isin(*V.SOURCES)).alias("sources"), F.count_if(F.col("op").isin("NETWORK_SEND", *V.EXECUTIONS)).alias("sinks"))
    return s.select("target_id", "function", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events", "sources", "sinks")
