"""Effect summaries per file: what comes in, what goes out, what is done between, and candidate purposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import vocabulary as V

FILE = ["target_id", "path"]


def _mapped(op: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[op]


def origin_sets(events: DataFrame) -> DataFrame:
    """data_origins, data_destinations and transformations of each file: sorted distinct names."""
    sets = lambda t: F.array_sort(F.collect_set(_mapped(F.col("op"), t)))
    return events.groupBy(*FILE).agg(sets(V.ORIGINS).alias("data_origins"), sets(V.DESTINATIONS).alias("data_destinations"), sets(V.TRANSFORMATIONS).alias("transformations"))


def flows(paths: DataFrame) -> DataFrame:
    """Distinct flows of a file's paths, proximity aside."""
    f = paths.filter("evidence_kind <> 'proximity'").withColumn("flow", _mapped(F.col("motif"), V.FLOW_OF_MOTIF))
    return f.groupBy(*FILE).agg(F.array_sort(F.collect_set("flow")).alias("flows"))


def local_pipelines(events: DataFrame) -> DataFrame:
    """Functions that read and write files."""
    g = events.filter("function <> '<module>'").groupBy(*FILE, "function").agg(F.max((F.col("op") == "FILE_READ").cast("int")).alias("r"), F.max((F.col("op") == "FILE_WRITE").cast("int")).alias("w"))
    return g.filter("r = 1 and w = 1").select(*FILE, "function")


def import_time_effects(events: DataFrame, guards: DataFrame | None = None) -> DataFrame:
    """Files with an effect at module level outside the given guards (target_id, path, first, last line)."""
    e = events.filter((F.col("function") == "<module>") & F.col("op").isin(*V.IMPORT_TIME))
    if guards is not None:
        g = guards.groupBy(*FILE).agg(F.collect_list(F.struct("first", "last")).alias("g"))
        e = e.join(g, FILE, "left").filter(~F.coalesce(F.exists("g", lambda x: F.col("line").between(x["first"], x["last"])), F.lit(False)))
    return e.select(*FILE).distinct()


def purpose_candidates(paths: DataFrame, events: DataFrame) -> DataFrame:
    """Per file and purpose the first path in path order: label, confidence, reason and the lines of its events."""
    label, reason = _mapped(F.col("motif"), {m: p[0] for m, p in V.PURPOSE_OF_MOTIF.items()}), _mapped(F.col("motif"), {m: p[1] for m, p in V.PURPOSE_OF_MOTIF.items()})
    order = Window.partitionBy(*FILE).orderBy(F.desc("score"), "event_indexes", "motif", "evidence_kind")
    p = paths.withColumn("position", F.row_number().over(order)).withColumn("label", label).withColumn("why", reason).filter("label is not null")
    first = p.groupBy(*FILE, "label").agg(F.min_by(F.struct("confidence", "why", "event_indexes", "position"), "position").alias("b")).select(*FILE, "label", "b.*")
    lines = first.select(*FILE, "label", F.explode("event_indexes").alias("event_index")).join(events.select(*FILE, F.col("event_index").cast("long").alias("event_index"), "line"), [*FILE, "event_index"])
    return first.join(lines.groupBy(*FILE, "label").agg(F.array_sort(F.collect_set("line")).alias("lines")), [*FILE, "label"], "left").select(*FILE, "position", "label", "confidence", F.col("why").alias("reason"), "lines")


def primary_purpose(candidates: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The first candidate of each file; files (target_id, path) without one are of unknown purpose."""
    p = candidates.groupBy(*FILE).agg(F.min_by("label", "position").alias("primary_purpose"))
    return p if files is None else files.select(*FILE).distinct().join(p, FILE, "left").withColumn("primary_purpose", F.coalesce("primary_purpose", F.lit("unknown")))


def effect_summary(analyses: DataFrame, events: DataFrame, paths: DataFrame, lexical: bool = False) -> DataFrame:
    """One row per file: entry points, origins, destinations, transformations, flows and purpose candidates.

    What only the text tells (main guards, functions, what guards reach, code-transforming calls) comes from analyses.
    Those of the lexical frontend are read more narrowly: a file that can be called is so only where nothing else enters
    it, and local pipelines count only where a guard calls them.
    """
    pipelines = local_pipelines(events).groupBy(*FILE).agg(F.collect_set("function").alias("pipelines"))
    early = import_time_effects(events, analyses.select(*FILE, F.explode("guards").alias("g")).select(*FILE, "g.first", "g.last")).withColumn("early", F.lit(True))
    ops = events.groupBy(*FILE).agg(F.collect_set("op").alias("ops"))
    found = purpose_candidates(paths, events).groupBy(*FILE).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "label", "confidence", "reason", "lines"))), lambda x: F.struct(x["label"].alias("label"), x["confidence"].alias("confidence"), x["reason"].alias("reason"), x["lines"].alias("lines"))).alias("candidates"))
    j = analyses.select(*FILE, "guards", "functions", "main_functions", "anchors", "anchor_lines")
    if lexical:
        io = events.filter(F.col("op").isin("FILE_READ", "FILE_WRITE")).groupBy(*FILE).agg(F.collect_set(F.struct("function", F.col("line").cast("int").alias("line"))).alias("io"))
        j = j.join(io, FILE, "left")
    for part in (origin_sets(events), flows(paths), pipelines, early, ops, found):
        j = j.join(part, FILE, "left")
    none = F.array().cast("array<string>")
    guarded, anchored = F.size("guards") > 0, F.size("anchors") >= 2
    mine = F.coalesce("pipelines", none)
    reached = F.size(F.array_intersect(mine, F.col("main_functions"))) > 0
    local = reached if lexical else reached | ~guarded & (F.size(mine) > 0)
    callable_ = ~guarded & (F.size("functions") > 0) & (F.col("early").isNull() if lexical else F.lit(True))
    entry = F.filter(F.array(F.when(guarded, "explicit-cli"), F.when(F.col("early"), "import-time-effects"), F.when(callable_, "library-callable")), lambda x: x.isNotNull())
    blocked = F.arrays_overlap(F.coalesce("ops", none), F.array(*map(F.lit, V.TRANSFORM_BLOCKERS)))
    transformer = local & anchored & ~blocked & F.col("candidates").isNull()
    lines, sure = F.array().cast("array<int>"), F.when(guarded & reached, "high").otherwise("medium")
    if lexical:
        touched = F.transform(F.filter(F.coalesce("io", F.array().cast("array<struct<function:string,line:int>>")), lambda x: F.array_contains(F.array_intersect(mine, F.col("main_functions")), x["function"])), lambda x: x["line"])
        lines, sure = F.slice(F.array_sort(F.array_union(touched, F.col("anchor_lines"))), 1, 12), F.lit("medium")
    own = F.struct(F.lit("local-code-transformer").alias("label"), sure.alias("confidence"), F.lit("a local file pipeline is combined with code transformations").alias("reason"), lines.alias("lines"))
    kind = found.schema["candidates"].dataType.simpleString()
    return j.select(
        *FILE, F.when(F.size(entry) > 0, entry).otherwise(F.array(F.lit("module-import"))).alias("entrypoints"), F.coalesce("data_origins", none).alias("data_origins"), F.coalesce("data_destinations", none).alias("data_destinations"),
        F.array_sort(F.array_union(F.coalesce("transformations", none), F.when(anchored, F.array(F.lit("code-generation"))).otherwise(none))).alias("transformations"),
        F.array_sort(F.array_union(F.coalesce("flows", none), F.when(local, F.array(F.lit("local-file-to-local-artifact"))).otherwise(none))).alias("flows"),
        F.when(transformer, F.array(own).cast(kind)).otherwise(F.coalesce("candidates", F.array().cast(kind))).alias("purpose_candidates"),
    )


def effect_tokens(summary: DataFrame) -> DataFrame:
    """(target_id, path, position, token) in the order entry, origin, destination, flow, transform, purpose."""
    level = lambda x: F.translate(F.lower(x), "- ", "__")
    part = lambda c, name: F.transform(c, lambda x: F.concat(F.lit(f"EFFECT:{name}:"), level(x)))
    every = F.concat(
        part("entrypoints", "ENTRY"), part("data_origins", "ORIGIN"), part("data_destinations", "DESTINATION"), part("flows", "FLOW"), part("transformations", "TRANSFORM"),
        F.transform("purpose_candidates", lambda p: F.format_string("PURPOSE:%s|Q:%s", level(p["label"]), level(p["confidence"]))),
    )
    return summary.select(*FILE, F.posexplode(every).alias("position", "token"))
