"""Behaviour, scoring, token and support operators over the stand-in views, with their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import policy as P
from brindle.functions import tokens as T
from brindle.functions import vocabulary as W
from brindle.operators import effects, models, patterns, scoring, support
from brindle.plans import views as V
from brindle.sources.generators import SCENARIOS, VARIANTS


def _paths(spark, d):
    e = V.behavior(spark, d)
    return e, patterns.behavior_paths(e)


def w1_proximity_paths(spark, d):
    p = patterns.proximity_paths(V.behavior(spark, d))
    return p.select("target_id", "path", "motif", "score", "reason", F.col("event_indexes")[0].alias("source"), F.col("event_indexes")[1].alias("sink"))


def w2_structural_paths(spark, d):
    p = patterns.structural_paths(V.behavior(spark, d))
    return p.select("target_id", "path", "motif", "score", F.col("event_indexes")[0].alias("event_index"))


def a2_evidence(spark, d):
    e, p = _paths(spark, d)
    return scoring.evidence(e, p).groupBy("target_id", "kind", "name").agg(F.count("*").alias("n"), F.max("score").alias("score"))


def a1_ranked_evidence(spark, d):
    e, p = _paths(spark, d)
    r = scoring.ranked_evidence(scoring.evidence(e, p))
    return r.select("target_id", "kind", "name", "score", "line", "op", "occurrences", F.col("rank").cast("long").alias("rank"))


def _score(name):
    def query(spark, d):
        e, p = _paths(spark, d)
        return scoring.rule_scores(scoring.evidence(e, p), (name,)).select("target_id", "score")

    return query


def a3_semantic_top8(spark, d):
    return _score("semantic-top8-v1")(spark, d)


def a4_legacy_top8(spark, d):
    return _score("legacy-top8")(spark, d)


def a5_context_max(spark, d):
    return _score("context-max-v1")(spark, d)


def a6_context_cover(spark, d):
    return _score("context-cover-v2")(spark, d)


def a7_context_causal(spark, d):
    return _score("context-causal-v6")(spark, d)


def m8_decisions(spark, d):
    e, p = _paths(spark, d)
    s = scoring.rule_scores(scoring.evidence(e, p), ("context-max-v1",))
    m = s.select("target_id", (F.col("score") / 100.0).alias("probability"), (F.pmod(F.substring("target_id", 2, 9).cast("int"), F.lit(2)) == 0).alias("supported"))
    return scoring.decide(s, m)


def a36_effect_sets(spark, d):
    e = V.behavior(spark, d)
    o = effects.origin_sets(e)
    return o.select("target_id", "path", *[F.array_join(c, ",").alias(c) for c in ("data_origins", "data_destinations", "transformations")])


def a37_read_decode_functions(spark, d):
    e = V.behavior(spark, d).withColumn("op", F.when(F.col("op") == "DECODE", "FILE_WRITE").otherwise(F.col("op")))
    return effects.local_pipelines(e)


def a38_purposes(spark, d):
    e, p = _paths(spark, d)
    return effects.purpose_candidates(p, e).select("target_id", "label", "confidence", F.array_join("lines", ",").alias("lines"))


def _conversations(spark, d):
    c = V.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("tokens"))


def f12_ngrams(spark, d):
    return _conversations(spark, d).select(F.explode(T.ngrams(F.col("tokens"))).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


def f16_windows(spark, d):
    w = _conversations(spark, d).select("conv_id", F.posexplode(T.windows(F.col("tokens"), 4, 1)).alias("k", "w"))
    return w.select("conv_id", F.col("k").cast("long").alias("k"), F.array_join("w", " ").alias("w"))


def f18_sequence_hashes(spark, d):
    return _conversations(spark, d).select("conv_id", T.sequence_hash(F.col("tokens")).alias("hash"))


def f14_sparse_vectors(spark, d):
    return models.vectors(_conversations(spark, d).withColumnRenamed("conv_id", "sample_id"), 1024).groupBy("sample_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("norm"))


def f15_token_ids(spark, d):
    e = _conversations(spark, d).select("conv_id", T.encode_ids(F.col("tokens"), 32, 512).alias("e"))
    return e.select("conv_id", F.array_join("e.ids", ",").alias("ids"), F.aggregate("e.mask", F.lit(0).cast("long"), lambda t, m: t + m).alias("used"))


def w10_first_tokens(spark, d):
    return _conversations(spark, d).select("conv_id", F.array_join(T.first_occurrences(F.col("tokens")), ",").alias("tokens"))


def _word_sets(spark, d, name, key):
    return V.table(spark, d, name).filter("text is not null").select(F.col(key).alias("sample_id"), F.array_distinct(F.split(F.lower("text"), " ", -1)).alias("tokens"))


def m7_support(spark, d):
    docs, items = _word_sets(spark, d, "documents", "doc_id"), _word_sets(spark, d, "benchmark", "item_id")
    known = items.select(F.explode("tokens").alias("token")).distinct()
    a = support.assess(docs, known, items.withColumnRenamed("sample_id", "group_id"), 0.2, 0.05)
    return a.select("sample_id", F.round("token_coverage", 6).alias("token_coverage"), F.round("nearest", 6).alias("nearest"), F.size("unknown_tokens").cast("long").alias("unknown"), "supported")


def m1_sparse_scores(spark, d):
    weights = spark.range(1024).select(F.col("id").cast("int").alias("index"), (F.sin("id")).alias("weight"))
    return models.predict(_conversations(spark, d).withColumnRenamed("conv_id", "sample_id"), weights, 0.1, 1024).select("sample_id", F.round("probability", 6).alias("probability"))


def m2_sparse_training(spark, d):
    e = _conversations(spark, d).select(F.lit("m").alias("system"), F.col("conv_id").alias("ord"), "tokens", F.pmod("conv_id", F.lit(2)).cast("int").alias("label"))
    return models.train(e, 2, dimensions=1024)


def m6_temperature(spark, d):
    p = V.predictions(spark, d)
    return models.fit_temperature(p.select("split", ((F.col("score") - 0.5) * 30.0).alias("logit"), "label"), ["split"]).select("split", F.round("temperature", 6).alias("temperature"), F.round("nll", 6).alias("nll"))


def _corpus(spark, d):
    """A file for every tenth order, made in the cluster."""
    from brindle.sources.generators import corpus

    return corpus(spark, V.table(spark, d, "orders").count() // 10)


def x1_scan_decisions(spark, d):
    from brindle.plans.scan import scan

    return scan(_corpus(spark, d))["decisions"].select("target_id", "rule_score", "model_used", "risk_score", "verdict")


def x2_events(spark, d):
    from brindle.sources import frontend

    return frontend.events_of(frontend.extract(_corpus(spark, d))).groupBy("op", "phase", "function").agg(F.count("*").alias("n"))


def x13_exact_paths(spark, d):
    from brindle.sources import frontend

    return frontend.exact_of(frontend.extract(_corpus(spark, d))).groupBy("motif", "through_summary").agg(F.count("*").alias("n"))


def a36_effect_summaries(spark, d):
    from brindle.plans.scan import scan

    p = scan(_corpus(spark, d))
    s = effects.effect_summary(p["analyses"], p["events"], p["paths"])
    return s.groupBy(*[F.array_join(c, ",").alias(c) for c in ("entrypoints", "data_origins", "data_destinations", "transformations", "flows")]).agg(F.count("*").alias("files"))


def s18_scan_reports(spark, d):
    from brindle.plans.scan import report, scan

    return report(scan(_corpus(spark, d)))


def a40_lexical_profile(spark, d):
    e, p = _paths(spark, d)
    return scoring.lexical_top8(scoring.evidence(e, p)).select("target_id", "score", "suppressed")


def f22_fingerprint(spark, d):
    from brindle.functions.fingerprint import fingerprint

    return fingerprint(V.predictions(spark, d), ["sample_id", "label", "score", "split", "group_id", "period"])


def f21_normalised_hashes(spark, d):
    from brindle.sources.frontend import normalised_hash

    return normalised_hash(_corpus(spark, d)).groupBy("ast_hash").agg(F.count("*").alias("targets"))


def m3_transformer(spark, d):
    from brindle.operators import transformer

    return transformer.predict(_conversations(spark, d).withColumnRenamed("conv_id", "sample_id"), transformer.random_weights(3, 512, 64, 32, 2, 64)).select("sample_id", F.round("probability", 4).alias("probability"))


def m7_pair_metrics(spark, d):
    p = V.predictions(spark, d)
    return support.pair_metrics(p.select(F.col("period").alias("pair_id"), F.pmod(F.col("group_id").cast("long"), F.lit(3)).alias("variant"), "label", "score")).select(*[F.round(c, 6).alias(c) for c in ("pair_order_accuracy", "pair_gap_mean", "pair_gap_min")], "pairs")


def m7_variant_drift(spark, d):
    return support.variant_drift(V.predictions(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("variant_drift_mean", "variant_drift_max")])


def a34_timings(spark, d):
    from brindle.operators.study import timings

    t = timings(V.predictions(spark, d), "latency_ms", ["split"])
    return t.select("split", "runs", *[F.round(c, 6).alias(c) for c in ("mean_ms", "median_ms", "p95_ms", "p99_ms", "per_second")])


def s24_training_rows(spark, d):
    from brindle.sources.generators import training_rows

    return training_rows(spark).select("sample_id", "group_id", "pair_id", "variant", "label", "split", F.array_join("tokens", " ").alias("tokens"))


def f8_canonical_tokens(spark, d):
    from brindle.functions.canonical import canonical_tokens

    e = V.behavior(spark, d)
    t = e.groupBy(F.col("function").alias("sample_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_index", T.event_token(F.col("phase"), F.lit("source"), F.col("op"), F.col("target")).alias("t")))), lambda x: x["t"]).alias("tokens"))
    return canonical_tokens(t).select("sample_id", F.array_join("tokens", " ").alias("tokens"))


def f9_model_tokens(spark, d):
    """Event, path and effect tokens of scanned targets, each once, under a mark for each file that adds one."""
    from brindle.functions.canonical import model_tokens
    from brindle.plans.scan import scan

    p = scan(_corpus(spark, d))
    effects_ = effects.effect_tokens(effects.effect_summary(p["analyses"], p["events"], p["paths"]))
    files = p["analyses"].select("target_id", "path", F.regexp_extract("path", "([0-9]+)", 1).cast("int").alias("file_ord"))
    return model_tokens(p["events"], p["paths"], effects_, files).select("target_id", F.array_join("tokens", " ").alias("tokens"))


def session_summaries(spark, d):
    from brindle.streaming.proximity import sessions

    e = V.behavior(spark, d)
    t = V.table(spark, d, "events")
    order = V.Window.partitionBy("user_id").orderBy("ts", "event_id")
    ts = t.select((F.col("user_id") * 100000 + F.row_number().over(order)).alias("event_index"), "ts")
    return sessions(e.join(ts, "event_index")).select("target_id", "function", "started", "events", "sources", "sinks")


WITH = f"WITH {V.SQL['behavior']}, "
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_NEAR = f"""near AS (SELECT *, list({{'i': event_index, 'op': op, 'secret': contains(lower(target), 'token')}}) OVER (PARTITION BY target_id, path, function ORDER BY event_index ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) l FROM behavior),
    src AS (SELECT target_id, path, event_index sink, unnest(list_filter(coalesce(l, []), lambda x: x.op IN {_IN(W.SOURCES)})[-2:]) x FROM near WHERE op = 'NETWORK_SEND'),
    prox AS (SELECT target_id, path, CASE WHEN x.op = 'BROWSER_COOKIE_READ' THEN 'browser_session_transfer' WHEN x.op = 'SENSITIVE_FILE_READ' OR (x.op = 'ENV_READ' AND x.secret) THEN 'credential_or_file_exfil' WHEN x.op = 'SYSTEM_DISCOVERY' THEN 'fingerprinting_transfer' WHEN x.op = 'FILE_READ' THEN 'file_to_network' END motif, x.i AS source, sink FROM src
      UNION ALL SELECT target_id, path, 'encoded_execution', list_filter(coalesce(l, []), lambda x: x.op IN {_IN(W.TRANSFORMS)})[-1].i, event_index FROM near WHERE op IN {_IN(W.EXECUTIONS)} AND len(list_filter(coalesce(l, []), lambda x: x.op IN {_IN(W.TRANSFORMS)})) > 0
      UNION ALL SELECT target_id, path, 'download_execute', list_filter(coalesce(l, []), lambda x: x.op = 'NETWORK_RECEIVE')[-1].i, event_index FROM near WHERE op IN {_IN(W.EXECUTIONS)} AND len(list_filter(coalesce(l, []), lambda x: x.op = 'NETWORK_RECEIVE')) > 0),
    proximity AS (SELECT DISTINCT target_id, path, motif, CASE motif {' '.join(f"WHEN '{m}' THEN {v[1]}::DOUBLE" for m, v in W.FLOWS.items())} END score, CASE motif {' '.join(f"WHEN '{m}' THEN '{v[2].replace(' flows into ', ' appears near ')}; exact value flow was not proven'" for m, v in W.FLOWS.items())} END reason, source::BIGINT AS source, sink::BIGINT sink FROM prox WHERE motif IS NOT NULL),
    structural AS (SELECT target_id, path, 'install_time_network_access' motif, 20::DOUBLE score, event_index::BIGINT event_index FROM behavior WHERE phase = 'install' AND op IN ('NETWORK_SEND', 'NETWORK_RECEIVE') UNION ALL SELECT target_id, path, 'install_time_execution', 30::DOUBLE, event_index FROM behavior WHERE phase = 'install' AND op IN {_IN(W.EXECUTIONS)})"""
_EVIDENCE = f"""{_NEAR}, ev AS (SELECT target_id, path, function, 'event' kind, op AS name, CASE op {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in W.WEIGHTS.items())} END score, line, op FROM behavior WHERE op IN {_IN(W.WEIGHTS)}
    UNION ALL SELECT p.target_id, p.path, b.function, 'proximity', motif, score, b.line, 'BEHAVIOR_PATH' FROM proximity p JOIN behavior b ON b.target_id = p.target_id AND b.event_index = p.source
    UNION ALL SELECT s.target_id, s.path, b.function, 'structural', motif, score, b.line, 'BEHAVIOR_PATH' FROM structural s JOIN behavior b ON b.target_id = s.target_id AND b.event_index = s.event_index)"""
_WEIGHT = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in W.WEIGHTS.items())
# events, what paths cover, and which events nothing of the kinds {kinds} covers
_COVER = """ee AS (SELECT target_id, path, function, op AS name, CASE op {weight} END score, event_index::BIGINT i FROM behavior WHERE op IN {ops}),
    pc AS (SELECT p.target_id, p.path, b.function, 'proximity' kind, motif AS name, p.score, unnest([p.source, p.sink]) i FROM proximity p JOIN behavior b ON b.target_id = p.target_id AND b.event_index = p.source
      UNION ALL SELECT s.target_id, s.path, b.function, 'structural', motif, s.score, s.event_index FROM structural s JOIN behavior b ON b.target_id = s.target_id AND b.event_index = s.event_index),
    cv AS (SELECT DISTINCT target_id, path, function, kind, name, i FROM pc WHERE kind IN {kinds}), st AS (SELECT cv.target_id, cv.path, cv.function, cv.kind, cv.name, max(ee.score) st FROM cv JOIN ee ON ee.target_id = cv.target_id AND ee.path = cv.path AND ee.function = cv.function AND ee.i = cv.i GROUP BY ALL),
    pg AS (SELECT target_id, path, function, kind, name, max(score) score FROM pc GROUP BY ALL), ps AS (SELECT pg.*, coalesce(st, 0) st FROM pg LEFT JOIN st USING (target_id, path, function, kind, name)),
    eg AS (SELECT target_id, path, function, name, max(score) score FROM (SELECT ee.*, EXISTS (SELECT 1 FROM cv WHERE cv.target_id = ee.target_id AND cv.path = ee.path AND cv.function = ee.function AND cv.i = ee.i) c FROM ee) GROUP BY ALL HAVING bool_or(NOT c))"""
_TOP4 = "r AS (SELECT *, row_number() OVER (PARTITION BY target_id, path, function ORDER BY score DESC) k FROM x), y AS (SELECT target_id, sum(score) s FROM r WHERE k <= 4 GROUP BY target_id, path, function) SELECT target_id, least(100.0::DOUBLE, max(s)) score FROM y GROUP BY 1"
_CONV = "c AS (SELECT conv_id, list(role ORDER BY turn) t FROM conversations GROUP BY 1)"
_SETS = "dw AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) t FROM documents WHERE text IS NOT NULL), pw AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) t FROM benchmark WHERE text IS NOT NULL), kn AS (SELECT DISTINCT unnest(t) w FROM pw), de AS (SELECT doc_id, unnest(t) w FROM dw)"

_GENERATED = "c AS (SELECT unnest(range(0, (SELECT count(*) // 10 FROM orders))) i)"
# Feature hashes of every run of up to three turns, by the library that defines them.
_ROLES = ("system", "user", "assistant", "tool")


def _person(text: str, size: int, person: bytes) -> tuple[int, float]:
    import hashlib

    v = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8, person=person).digest(), "little")
    return v % size, -1.0 if v >> 63 else 1.0


def _runs():
    import itertools

    words = ("BOS", *_ROLES, "EOS")
    return ["→".join(x) for n in (1, 2, 3) for x in itertools.product(words, repeat=n)]


_HASHED = f"""hs(g, index, sign) AS (VALUES {", ".join(f"('{g}', {i}, {s}::DOUBLE)" for g in _runs() for i, s in [_person(g, 1024, b"brindle1")])}),
    tt AS (SELECT conv_id, list_concat(['BOS'], t, ['EOS']) t FROM c), gr AS (SELECT conv_id, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], '→'))) g FROM tt, (VALUES (1), (2), (3)) v(n))"""

_A5 = "g AS (SELECT target_id, path, function, max(score) s FROM ev GROUP BY target_id, path, function, kind, name), r AS (SELECT *, row_number() OVER (PARTITION BY target_id, path, function ORDER BY s DESC) k FROM g), x AS (SELECT target_id, sum(s) s FROM r WHERE k <= 4 GROUP BY target_id, path, function), a5 AS (SELECT target_id, least(100.0::DOUBLE, max(s)) s FROM x GROUP BY 1)"

SQL = {
    "m8_decisions": WITH + _EVIDENCE + f", {_A5}, d AS (SELECT target_id, s rule_score, s / 100.0::DOUBLE probability, substr(target_id, 2)::INTEGER % 2 = 0 supported, substr(target_id, 2)::INTEGER % 2 = 0 AND s BETWEEN 20 AND 80 model_used FROM a5), e AS (SELECT *, CASE WHEN model_used THEN greatest(rule_score, 100.0::DOUBLE * (0.65::DOUBLE * (rule_score / 100.0::DOUBLE) + (1.0::DOUBLE - 0.65::DOUBLE) * probability)) ELSE rule_score END risk_score FROM d) SELECT *, CASE WHEN risk_score >= 75 THEN 'high-risk' WHEN risk_score >= 50 THEN 'suspicious' WHEN risk_score >= 25 THEN 'review' ELSE 'low-signal' END verdict FROM e",
    "a40_lexical_profile": WITH + _EVIDENCE + ", lx AS (SELECT ev.* FROM ev WHERE NOT (kind = 'event' AND op IN ('NETWORK_SEND', 'NETWORK_RECEIVE') AND EXISTS (SELECT 1 FROM behavior b WHERE b.target_id = ev.target_id AND b.phase = 'install' AND b.function = ev.function))), g AS (SELECT target_id, kind, name, max(score) s, count(*) n FROM lx GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY s DESC) k FROM g) SELECT target_id, least(100.0::DOUBLE, sum(CASE WHEN k <= 8 THEN s END)) score, (sum(n) - count(*))::BIGINT suppressed FROM r GROUP BY 1",
    "f18_sequence_hashes": f"WITH {_CONV}, e AS (SELECT conv_id, unnest(t) x, generate_subscripts(t, 1) i FROM c) SELECT conv_id, sha256(unhex(string_agg(printf('%016x', strlen(x)) || hex(x), '' ORDER BY i))) hash FROM e GROUP BY 1",
    "m7_pair_metrics": f"WITH {V.SQL['pred']}, p AS (SELECT period, group_id::BIGINT % 3 v, max(CASE WHEN label = 1 THEN score END) - max(CASE WHEN label = 0 THEN score END) gap FROM pred GROUP BY 1, 2) SELECT round(avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) pair_order_accuracy, round(avg(gap), 6) pair_gap_mean, round(min(gap), 6) pair_gap_min, count(*)::BIGINT pairs FROM p WHERE gap IS NOT NULL",
    "m7_variant_drift": f"WITH {V.SQL['pred']}, g AS (SELECT max(score) - min(score) d FROM pred GROUP BY group_id) SELECT round(avg(d), 6) variant_drift_mean, round(max(d), 6) variant_drift_max FROM g",
    "a34_timings": f"WITH {V.SQL['pred']} SELECT split, count(latency_ms)::BIGINT runs, round(avg(latency_ms), 6) mean_ms, round(quantile_cont(latency_ms, 0.5), 6) median_ms, round(quantile_disc(latency_ms, 0.95), 6) p95_ms, round(quantile_disc(latency_ms, 0.99), 6) p99_ms, round(1000.0 * count(latency_ms) / sum(latency_ms), 6) per_second FROM pred GROUP BY split",
    "session_summaries": WITH + "e AS (SELECT 't' || (user_id % 10) target_id, 'f' || user_id AS function, ts, event_type, sum(CASE WHEN g IS NULL OR ts >= g + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) g FROM events)) SELECT target_id, function, min(ts) started, count(*)::BIGINT events, count_if(event_type IN ('signup', 'view'))::BIGINT sources, count_if(event_type IN ('purchase', 'error'))::BIGINT sinks FROM e GROUP BY target_id, function, s",
    "w1_proximity_paths": WITH + _NEAR + " SELECT * FROM proximity",
    "w2_structural_paths": WITH + _NEAR + " SELECT * FROM structural",
    "a2_evidence": WITH + _EVIDENCE + " SELECT target_id, kind, name, count(*)::BIGINT n, max(score) score FROM ev GROUP BY ALL",
    "a1_ranked_evidence": WITH + _EVIDENCE + ", g AS (SELECT target_id, kind, name, max(score) score, min(line) line, min(op) op, min(path) path, count(*)::BIGINT occurrences FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, path, line, op, kind, name) rank FROM g) SELECT target_id, kind, name, score, line, op, occurrences, rank::BIGINT rank FROM r WHERE rank <= 12",
    "a3_semantic_top8": WITH + _EVIDENCE + ", g AS (SELECT target_id, max(score) s FROM ev GROUP BY target_id, kind, name), r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY s DESC) k FROM g) SELECT target_id, least(100.0::DOUBLE, sum(s)) score FROM r WHERE k <= 8 GROUP BY 1",
    "a4_legacy_top8": WITH + _EVIDENCE + ", r AS (SELECT target_id, score s, row_number() OVER (PARTITION BY target_id ORDER BY score DESC) k FROM ev) SELECT target_id, least(100.0::DOUBLE, sum(s)) score FROM r WHERE k <= 8 GROUP BY 1",
    "a5_context_max": WITH + _EVIDENCE + ", g AS (SELECT target_id, path, function, max(score) s FROM ev GROUP BY target_id, path, function, kind, name), r AS (SELECT *, row_number() OVER (PARTITION BY target_id, path, function ORDER BY s DESC) k FROM g), x AS (SELECT target_id, sum(s) s FROM r WHERE k <= 4 GROUP BY target_id, path, function) SELECT target_id, least(100.0::DOUBLE, max(s)) score FROM x GROUP BY 1",
    "a36_effect_sets": WITH[:-2] + " SELECT target_id, path, " + ", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), ','), '') {c}" for c in ("data_origins", "data_destinations", "transformations")) + " FROM (SELECT *, " + ", ".join(f"CASE op {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in t.items())} END {c}" for c, t in (("data_origins", W.ORIGINS), ("data_destinations", W.DESTINATIONS), ("transformations", W.TRANSFORMATIONS))) + " FROM behavior) GROUP BY 1, 2",
    "a37_read_decode_functions": WITH[:-2] + " SELECT target_id, path, function FROM behavior GROUP BY ALL HAVING bool_or(op = 'FILE_READ') AND bool_or(op = 'DECODE')",
    "f12_ngrams": f"WITH {_CONV}, t AS (SELECT list_concat(['BOS'], t, ['EOS']) t FROM c), g AS (SELECT unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], '→'))) ngram FROM t, (VALUES (1), (2), (3)) v(n)) SELECT ngram, count(*)::BIGINT n FROM g GROUP BY 1",
    "f16_windows": f"WITH {_CONV}, n AS (SELECT *, least(16, greatest(1, ceil((len(t) - 4) / 3.0)::BIGINT + 1)) n FROM c) SELECT conv_id, k::BIGINT k, array_to_string(t[k * 3 + 1:k * 3 + 4], ' ') w FROM (SELECT conv_id, t, unnest(range(0, n)) k FROM n)",
    "w10_first_tokens": f"WITH {_CONV}, e AS (SELECT conv_id, unnest(t) x, generate_subscripts(t, 1) i FROM c), f AS (SELECT conv_id, x, min(i) i FROM e GROUP BY 1, 2) SELECT conv_id, array_to_string(list(x ORDER BY i), ',') tokens FROM f GROUP BY 1",
    "m7_support": f"WITH {_SETS}, cov AS (SELECT doc_id, count(*) n, count(kn.w) k FROM de LEFT JOIN kn ON kn.w = de.w GROUP BY 1), j AS (SELECT doc_id, item_id, count(*) b FROM de JOIN (SELECT item_id, unnest(t) w FROM pw) p ON p.w = de.w GROUP BY 1, 2), m AS (SELECT j.doc_id, max(b::DOUBLE / (len(dw.t) + len(pw.t) - b)) x FROM j JOIN dw ON dw.doc_id = j.doc_id JOIN pw ON pw.item_id = j.item_id GROUP BY 1) SELECT cov.doc_id sample_id, round(k::DOUBLE / n, 6) token_coverage, round(coalesce(x, 0), 6) nearest, (n - k)::BIGINT unknown, k::DOUBLE / n >= 0.2 AND coalesce(x, 0) >= 0.05 supported FROM cov LEFT JOIN m ON m.doc_id = cov.doc_id",
    "a6_context_cover": WITH + _NEAR + ", " + _COVER.format(weight=_WEIGHT, ops=_IN(W.WEIGHTS), kinds="('structural')") + f", x AS (SELECT target_id, path, function, greatest(score, st) score FROM ps UNION ALL SELECT target_id, path, function, score FROM eg), {_TOP4}",
    "a7_context_causal": WITH + _NEAR + ", " + _COVER.format(weight=_WEIGHT, ops=_IN(W.WEIGHTS), kinds="('structural', 'proximity')") + f", x AS (SELECT target_id, path, function, CASE WHEN kind = 'proximity' THEN score + st ELSE greatest(score, st) END score FROM ps UNION ALL SELECT target_id, path, function, score FROM eg WHERE name NOT IN {_IN(W.CONTEXT_ONLY)} UNION ALL SELECT target_id, path, function, max(score) FROM eg WHERE name IN {_IN(W.CONTEXT_ONLY)} GROUP BY 1, 2, 3), {_TOP4}",
    "a38_purposes": WITH + _NEAR + f""", al AS (SELECT target_id, path, motif, score, [source, sink] x, 'proximity' k, 'low' confidence FROM proximity UNION ALL SELECT target_id, path, motif, score, [event_index], 'structural', 'high' FROM structural),
        lb AS (SELECT *, CASE motif {" ".join(f"WHEN '{m}' THEN '{p[0]}'" for m, p in W.PURPOSE_OF_MOTIF.items())} END AS label FROM al), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, path, label ORDER BY score DESC, x, motif, k) r FROM lb WHERE label IS NOT NULL) WHERE r = 1)
        SELECT f.target_id, label, confidence, array_to_string(list_sort(list(DISTINCT b.line)), ',') AS lines FROM f JOIN behavior b ON b.target_id = f.target_id AND b.path = f.path AND list_contains(f.x, b.event_index) GROUP BY f.target_id, f.path, label, confidence""",
    "x1_scan_decisions": f"WITH {_GENERATED} SELECT DISTINCT 'pkg' || (i // 20) target_id, 36.0::DOUBLE rule_score, false model_used, 36.0::DOUBLE risk_score, 'review' verdict FROM c",
    "x2_events": f"WITH {_GENERATED}, m AS (SELECT i FROM c WHERE i % 20 = 0) SELECT 'IMPORT' op, 'import' phase, '<module>' AS function, (SELECT count(*) FROM c)::BIGINT + 2 * (SELECT count(*) FROM m)::BIGINT n UNION ALL SELECT 'FILE_READ', 'runtime', 'load', count(*)::BIGINT FROM c WHERE i % 20 <> 0 UNION ALL SELECT unnest(['ENV_READ', 'ENCODE']), 'runtime', 'collect_' || i, 1::BIGINT FROM m UNION ALL SELECT 'NETWORK_SEND', 'runtime', 'push_' || i, 1::BIGINT FROM m",
    "x13_exact_paths": f"WITH {_GENERATED} SELECT 'credential_or_file_exfil' motif, true through_summary, count(*)::BIGINT n FROM c WHERE i % 20 = 0",
    "a36_effect_summaries": f"WITH {_GENERATED} SELECT 'library-callable' entrypoints, CASE WHEN i % 20 = 0 THEN 'environment' ELSE 'local-file' END data_origins, CASE WHEN i % 20 = 0 THEN 'network' ELSE '' END data_destinations, CASE WHEN i % 20 = 0 THEN 'encoding' ELSE '' END transformations, CASE WHEN i % 20 = 0 THEN 'sensitive-data-to-network' ELSE '' END flows, count(*)::BIGINT files FROM c GROUP BY ALL",
    "f14_sparse_vectors": f"WITH {_CONV}, {_HASHED}, s AS (SELECT conv_id, index, sum(sign) v FROM gr JOIN hs ON hs.g = gr.g GROUP BY 1, 2), q AS (SELECT conv_id, sqrt(sum(v * v)) z FROM s GROUP BY 1) SELECT s.conv_id sample_id, count(*)::BIGINT n, round(sum(CASE WHEN z > 0 THEN (v / z) * (v / z) ELSE v * v END), 6) norm FROM s JOIN q ON q.conv_id = s.conv_id GROUP BY 1",
    "m1_sparse_scores": f"WITH {_CONV}, {_HASHED}, s AS (SELECT conv_id, index, sum(sign) v FROM gr JOIN hs ON hs.g = gr.g GROUP BY 1, 2), q AS (SELECT conv_id, sqrt(sum(v * v)) z FROM s GROUP BY 1) SELECT s.conv_id sample_id, round(1 / (1 + exp(-(sum(CASE WHEN z > 0 THEN v / z ELSE v END * sin(index)) + 0.1::DOUBLE))), 6) probability FROM s JOIN q ON q.conv_id = s.conv_id GROUP BY 1",
    "f15_token_ids": f"""WITH {_CONV}, hv(w, id) AS (VALUES {", ".join(f"('{w}', {_person(w, 512 - T.FIRST, b'brindle2')[0] + T.FIRST})" for w in _ROLES)}), e AS (SELECT conv_id, unnest(t[1:30]) w, generate_subscripts(t[1:30], 1) i FROM c), s AS (SELECT conv_id, list(id ORDER BY i) x FROM e JOIN hv ON hv.w = e.w GROUP BY 1)
        SELECT conv_id, array_to_string(list_concat(list_concat([{T.BEGIN}], x), list_concat([{T.END}], list_transform(range(30 - len(x)), lambda i: {T.PAD}))), ',') ids, (len(x) + 2)::BIGINT used FROM s""",
    "f22_fingerprint": f"""WITH {V.SQL['pred']}, j AS (SELECT sha256('{{"group_id":"' || group_id || '","label":' || label || ',"period":"' || period || '","sample_id":"' || sample_id || '","score":' || score::VARCHAR || ',"split":"' || split || '"}}') d FROM pred), b AS (SELECT d[1:3] b, sha256(string_agg(d, ',' ORDER BY d)) h FROM j GROUP BY 1) SELECT sha256(string_agg(h, ',' ORDER BY b)) fingerprint FROM b""",
    "s24_training_rows": f"""WITH s(scenario, label, ops, o) AS (VALUES {", ".join(f"('{n}', {y}, [{', '.join(repr(x) for x in ops)}], {i})" for i, (n, y, ops) in enumerate(SCENARIOS))}), v(variant, b, a) AS (VALUES {", ".join(f"('{n}', [{', '.join(repr(x) for x in b)}]::VARCHAR[], [{', '.join(repr(x) for x in a)}]::VARCHAR[])" for n, b, a in VARIANTS)})
        SELECT scenario || '--' || variant sample_id, scenario group_id, 'pair' || (o // 2) pair_id, variant, label::INTEGER AS label, CASE WHEN o % 8 >= 6 THEN 'validation' ELSE 'train' END split, array_to_string(list_transform(list_concat(list_concat(b, ops), a), lambda x: 'P:runtime|C:context|O:' || x || '|T:generic'), ' ') tokens FROM s, v""",
    # the tokens of a target's moving file, then what its first plain file adds
    "f9_model_tokens": f"""WITH {_GENERATED} SELECT DISTINCT 'pkg' || (i // 20) target_id, 'FILE P:import|C:context|O:IMPORT|T:generic P:runtime|C:source|O:ENV_READ|T:sensitive P:runtime|C:transform|O:ENCODE|T:generic P:runtime|C:sink|O:NETWORK_SEND|T:network PATH:credential_or_file_exfil|K:summary|Q:medium EFFECT:ENTRY:library_callable EFFECT:ORIGIN:environment EFFECT:DESTINATION:network '
        || 'EFFECT:FLOW:sensitive_data_to_network EFFECT:TRANSFORM:encoding PURPOSE:sensitive_data_transfer|Q:medium FILE P:runtime|C:source|O:FILE_READ|T:file EFFECT:ORIGIN:local_file' tokens FROM c""",
    "m6_temperature": f"WITH {V.SQL['pred']}, z AS (SELECT split, exp(ln(20::DOUBLE) * k / 240) t, (score - 0.5) * 30.0 / exp(ln(20::DOUBLE) * k / 240) * CASE WHEN label = 1 THEN 1 ELSE -1 END z FROM pred, range(241) r(k)), g AS (SELECT split, t, avg(CASE WHEN z > 0 THEN ln(1 + exp(-z)) ELSE ln(1 + exp(z)) - z END) n FROM z GROUP BY 1, 2) SELECT split, round(min_by(t, n), 6) temperature, round(min(n), 6) nll FROM g GROUP BY 1",
}
