"""Canonical model token sequences: targets levelled, older spellings brought up to date, effects derived and sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import policy as P
from brindle.functions import tokens as T
from brindle.functions import vocabulary as V

EVENT = r"^P:([^|]+)\|C:([^|]+)\|O:([^|]+)\|T:(.*)$"
PATH = r"^PATH:([^|]+)\|K:([^|]+)\|Q:([^|]+)$"
PURPOSE = r"^PURPOSE:([^|]+)(?:\|Q:([^|]+))?$"
DIMENSIONS = ("ENTRY", "ORIGIN", "DESTINATION", "FLOW", "TRANSFORM")


def _part(t: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(t, pattern, k)


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x.replace("-", "_") if i else x) for kv in table.items() for i, x in enumerate(kv)])


def canonical_tokens(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, tokens): FILE, then events, paths and others at their first place, then derived effects and purposes, sorted."""
    t = F.col("t")
    rows = samples.select(key, F.posexplode_outer("tokens").alias("pos", "t")).filter("t is null or not (t = 'FILE' or t like 'FILE:%')")
    motif_old = F.when(t.startswith("MOTIF:"), T.semantic(F.expr("substring(t, 7)")))
    kind_old = F.when(motif_old.isin(*V.STRUCTURES), "structural").otherwise("dataflow")
    is_event, is_path, is_purpose = t.rlike(EVENT), t.rlike(PATH), t.rlike(PURPOSE)
    op = F.when(is_event, _part(t, EVENT, 3))
    motif = F.when(is_path, T.semantic(_part(t, PATH, 1))).otherwise(motif_old)
    kind = F.when(is_path, T.semantic(_part(t, PATH, 2))).when(motif_old.isNotNull(), kind_old)
    sure = F.when(is_path, T.semantic(_part(t, PATH, 3))).when(motif_old.isNotNull(), "high")
    dimension = F.when(t.rlike("^EFFECT:(?:" + "|".join(DIMENSIONS) + "):"), F.element_at(F.split(t, ":"), 2))
    value = T.semantic(F.regexp_replace(t, "^EFFECT:[A-Z]+:", ""))
    value = F.when((dimension == "ENTRY") & (value == "install_time"), "import_time_effects").otherwise(value)
    label = F.when(is_purpose, T.semantic(_part(t, PURPOSE, 1)))
    q = _part(t, PURPOSE, 2)
    label_q = F.when(q != "", T.semantic(q)).when(label == "local_code_transformer", "medium").otherwise("high")
    shown = (
        F.when(is_event, F.format_string("P:%s|C:%s|O:%s|T:%s", _part(t, EVENT, 1), _part(t, EVENT, 2), op, P.model_target_class(op, _part(t, EVENT, 4))))
        .when(motif.isNotNull(), F.format_string("PATH:%s|K:%s|Q:%s", motif, kind, sure)).when(dimension.isNotNull() | is_purpose, F.lit(None)).otherwise(t)
    )
    r = rows.select(key, "pos", op.alias("op"), F.when(is_event, _part(t, EVENT, 1)).alias("phase"), motif.alias("motif"), kind.alias("kind"), sure.alias("sure"), dimension.alias("dimension"), value.alias("value"), label.alias("label"), label_q.alias("label_q"), shown.alias("shown"))
    kept = r.filter("shown is not null").groupBy(key, "shown").agg(F.min("pos").alias("pos")).select(key, F.lit(0).alias("block"), F.format_string("%012d", "pos").alias("o"), F.col("shown").alias("token"))
    flow = F.when(F.col("kind") != "proximity", _map(V.FLOW_OF_MOTIF)[F.col("motif")])
    derived = F.filter(
        F.array(
            F.struct(F.col("dimension").alias("d"), F.col("value").alias("v")), F.struct(F.lit("ORIGIN").alias("d"), _map(V.ORIGINS)[F.col("op")].alias("v")), F.struct(F.lit("DESTINATION").alias("d"), _map(V.DESTINATIONS)[F.col("op")].alias("v")),
            F.struct(F.lit("TRANSFORM").alias("d"), _map(V.TRANSFORMATIONS)[F.col("op")].alias("v")), F.struct(F.lit("FLOW").alias("d"), flow.alias("v")),
        ), lambda x: x["d"].isNotNull() & x["v"].isNotNull(),
    )
    found = r.select(key, F.explode(derived).alias("x")).select(key, "x.d", "x.v").distinct()
    entry = r.groupBy(key).agg(F.max((F.col("dimension") == "ENTRY").cast("int")).alias("has"), F.max((F.col("phase") == "import").cast("int") * F.col("op").isin(*V.IMPORT_TIME).cast("int")).alias("early"))
    entry = entry.filter("coalesce(has, 0) = 0").select(key, F.lit("ENTRY").alias("d"), F.when(F.coalesce("early", F.lit(0)) == 1, "import_time_effects").otherwise("library_callable").alias("v"))
    order = F.create_map(*[F.lit(x) for kv in ((d, i + 1) for i, d in enumerate(DIMENSIONS)) for x in kv])
    effects = found.union(entry).select(key, order[F.col("d")].alias("block"), F.col("v").alias("o"), F.concat(F.lit("EFFECT:"), "d", F.lit(":"), "v").alias("token"))
    purpose_of = _map({m: p[0] for m, p in V.PURPOSE_OF_MOTIF.items()})
    purposes = r.filter("label is not null").select(key, "label", F.col("label_q").alias("q")).union(r.select(key, purpose_of[F.col("motif")].alias("label"), F.col("sure").alias("q")).filter("label is not null")).distinct()
    purposes = purposes.select(key, F.lit(9).alias("block"), F.concat_ws("|", "label", "q").alias("o"), F.format_string("PURPOSE:%s|Q:%s", "label", "q").alias("token"))
    every = kept.union(effects).union(purposes)
    one = every.groupBy(key).agg(F.concat(F.array(F.lit("FILE")), F.transform(F.array_sort(F.collect_list(F.struct("block", "o", "token"))), lambda x: x["token"])).alias("tokens"))
    return samples.select(key).distinct().join(one, key, "left")


def model_tokens(events: DataFrame, paths: DataFrame, effects: DataFrame, files: DataFrame) -> DataFrame:
    """(target_id, tokens): every event, path and effect token once, at its first file, each contributing file under a FILE mark.

    files has target_id, path and file_ord; effects has target_id, path, position and token.
    """
    e = events.select("target_id", "path", F.lit(0).alias("kind"), F.col("event_index").cast("long").alias("pos"), T.model_event_token(F.col("phase"), F.col("category"), F.col("op"), F.col("target")).alias("token"))
    from pyspark.sql import Window

    order = Window.partitionBy("target_id", "path").orderBy(F.desc("score"), "event_indexes", "motif", "evidence_kind")
    p = paths.select("target_id", "path", F.lit(1).alias("kind"), F.row_number().over(order).cast("long").alias("pos"), T.path_token(F.col("motif"), F.col("evidence_kind"), F.col("confidence")).alias("token"))
    f = effects.select("target_id", "path", F.lit(2).alias("kind"), F.col("position").cast("long").alias("pos"), "token")
    rows = e.unionByName(p).unionByName(f).join(files.select("target_id", "path", "file_ord"), ["target_id", "path"])
    first = rows.groupBy("target_id", "kind", "token").agg(F.min(F.struct("file_ord", "pos")).alias("at")).select("target_id", F.col("at.file_ord").alias("file_ord"), "kind", F.col("at.pos").alias("pos"), "token")
    marks = first.select("target_id", "file_ord").distinct().select("target_id", "file_ord", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit("FILE").alias("token"))
    return first.unionByName(marks).groupBy("target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "kind", "pos", "token"))), lambda x: x["token"]).alias("tokens"))
