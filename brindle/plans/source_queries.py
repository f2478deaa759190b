"""Readers, archives, policies, hashes, lexical scans and study records over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile

from pyspark.sql import functions as F

from brindle.functions import policy as P
from brindle.functions import tokens as T
from brindle.functions import vocabulary as W
from brindle.operators import governance, models, patterns, records, scoring, study, support
from brindle.plans import behavior_queries as B
from brindle.plans import views as V
from brindle.sources import archives, checkpoints, frontend, lexical, readers, sinks
from brindle.sources.generators import corpus
from brindle.sources.storage import shared_folder


def _folder(spark):
    """A new folder in the one that all executors share."""
    return f"{shared_folder(spark)}/queries-{uuid.uuid4().hex}"


def _quoted(xs):
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def _documents(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


# files and folders

FOLDERS = ("pkg", "pkg/sub", "dist", "a/b", "tests", "pkg/.venv/x", "zz")


def _files(spark, d):
    """A file of every document: nine in ten are Python files, some below excluded folders."""
    k = F.col("doc_id")
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (k % len(FOLDERS) + 1).cast("int"))
    name = F.concat(F.lit("m"), k.cast("string"), F.when(k % 10 == 9, ".txt").when(k % 10 == 8, ".PY").otherwise(".py"))
    where = F.when(k % 13 == 0, name).otherwise(F.concat_ws("/", folder, name))
    return _documents(spark, d).select(F.concat(F.lit("/root/"), where).alias("path"), P.display_path(F.concat(F.lit("/root/"), where), "/root").alias("relative"), F.when(k % 29 != 3, F.length("text")).alias("length"))


def s1_planned_files(spark, d):
    """What a scan takes of a folder until its byte limit."""
    return readers.plan_files(_files(spark, d), 3000, 1000, 60_000).select("relative", F.coalesce(F.col("length").cast("long"), F.lit(-1).cast("long")).alias("length"), "state")


def s2_file_limit(spark, d):
    """The same with a limit of files, which ends the walk first."""
    return readers.plan_files(_files(spark, d), 3000, 25, 10**9).select("relative", F.coalesce(F.col("length").cast("long"), F.lit(-1).cast("long")).alias("length"), "state")


def s4_file_heads(spark, d):
    """Digest, size and truncation of files read under a byte limit."""
    docs = _documents(spark, d).select(F.lit("t").alias("target_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "utf-8").alias("content"))
    return frontend.analysed(docs, 2000, lambda text, path: {}).select("path", "sha256", "bytes_read", "truncated")


# archives


def _archives(spark, d):
    """Ten documents to an archive: stored zips and uncompressed gzips, some with an unsafe member or an unknown type."""
    docs = _documents(spark, d).select(F.floor(F.col("doc_id") / 10).cast("long").alias("a"), "doc_id", "text")

    def build(pdf):
        import gzip

        import pandas as pd

        k, out = int(pdf["a"].iloc[0]), io.BytesIO()
        files = [(f"src/d{i}.py" if i % 3 else f"src/d{i}.txt", t.encode()) for i, t in zip(pdf["doc_id"], pdf["text"])]
        files += [("../x.py", b"")] if k % 9 == 1 else []
        if k % 2 == 0:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                for name, raw in files:
                    z.writestr(name, raw)
            raw = out.getvalue()
        else:
            with tarfile.open(fileobj=out, mode="w") as t:
                for name, raw in files:
                    info = tarfile.TarInfo(name)
                    info.size = len(raw)
                    t.addfile(info, io.BytesIO(raw))
            raw = gzip.compress(out.getvalue(), 0)
        end = "rar" if k % 9 == 2 else "zip" if k % 2 == 0 else "tar.gz"
        return pd.DataFrame({"path": [f"/x/a{k}.{end}"], "content": [raw]})

    return docs.groupBy("a").applyInPandas(build, "path string, content binary")


LIMITS = archives.Limits(ratio=1e9)


def s5_archive_members(spark, d):
    e = archives.expand(_archives(spark, d), LIMITS)
    return e.select("target_id", F.coalesce("path", "error").alias("path"), F.sha2("content", 256).alias("sha256"), F.coalesce(F.length("content").cast("long"), F.lit(-1).cast("long")).alias("bytes"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


def s10_archive_fingerprints(spark, d):
    a = _archives(spark, d)
    f = archives.fingerprints(a, archives.expand(a, LIMITS))
    return f.select("target_id", "status", F.col("python_files").cast("long").alias("python_files"), F.col("python_bytes").cast("long").alias("python_bytes"), "source_set_hash")


def s9_member_names(spark, d):
    """Safe and unsafe member names by one predicate."""
    names = ("a.py", "a/b.py", "../a.py", "/a.py", "a/./b.py", "a//b.py", "C:a.py", "a\\b.py", "a/b/", "a\nb.py", "..a.py", "é/ß.py")
    n = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    return _documents(spark, d).select(n.alias("name")).groupBy("name").agg(F.count("*").alias("n")).select("name", "n", P.safe_member_name(F.col("name")).alias("safe"))


# rows under a contract


def _prediction_lines(spark, d):
    k = F.col("sample_id").cast("long") % 50
    p = V.predictions(spark, d).withColumn("k", k)
    p = p.withColumn("score", F.when(F.col("k") == 0, 1.5).otherwise(F.col("score"))).withColumn("split", F.when(F.col("k") == 1, "dev").otherwise(F.col("split")))
    p = p.withColumn("label", F.when(F.col("k") == 2, "maybe").otherwise(F.col("label").cast("string"))).withColumn("latency_ms", F.when(F.col("k") == 3, -1.0).otherwise(F.col("latency_ms")))
    p = p.withColumn("group_id", F.when(F.col("k") != 4, F.col("group_id"))).withColumn("more", F.when(F.col("k") == 5, "x")).withColumn("sample_id", F.when(F.col("k") == 6, "same").otherwise(F.col("sample_id")))
    return p.select(F.when(F.col("k") == 7, "[1]").otherwise(F.to_json(F.struct("sample_id", "label", "score", "split", "group_id", "period", "model_invoked", "latency_ms", "more"))).alias("value"))


def s11_prediction_problems(spark, d):
    return readers.prediction_problems(_prediction_lines(spark, d)).groupBy(F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count("*").alias("n"))


def s11_predictions(spark, d):
    """Predictions written as JSON lines and read back under the contract, however many there are."""
    path = _folder(spark)
    V.predictions(spark, d).select(F.to_json(F.struct("sample_id", "label", "score", "split", "group_id", "period", "model_invoked", "latency_ms")).alias("value")).write.text(path)
    p = readers.predictions(spark, path)
    return p.select("sample_id", "label", F.round("score", 9).alias("score"), "split", "group_id", "period", F.coalesce(F.col("model_invoked").cast("string"), F.lit("")).alias("model_invoked"), F.round("latency_ms", 6).alias("latency_ms"))


def s12_manifest_problems(spark, d):
    k = F.col("sample_id").cast("long") % 20
    m = V.manifest(spark, d).withColumn("k", k)
    fields = [
        "sample_id", F.coalesce("ecosystem", F.lit("none")).alias("ecosystem"), F.coalesce("package", F.lit("none")).alias("package"), "version", F.when(F.col("k") == 0, F.lit("0" * 63 + "G")).otherwise(F.coalesce("sha256", F.lit("0" * 64))).alias("sha256"),
        "group_id", F.lit("own").alias("provenance"), F.when(F.col("k") == 3, " ").otherwise("MIT").alias("license"), F.lit("text").alias("content_kind"), F.col("label").cast("string").alias("label"),
        F.when(F.col("k") == 1, "2024-13-01").otherwise(F.date_format("first_seen", "yyyy-MM-dd")).alias("first_seen"), F.when(F.col("k") == 4, "dev").otherwise(F.col("split")).alias("split"), "representation_hash", "family", "campaign", F.when(F.col("k") == 2, "x").alias("payload"),
    ]
    return readers.manifest_problems(m.select(F.to_json(F.struct(*fields)).alias("value"))).groupBy(F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count("*").alias("n"))


def _conversations(spark, d):
    c = V.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("tokens"))


def s13_training_rows(spark, d):
    """Rows with tokens, with a source text, and with the path of a file."""
    c, k = _conversations(spark, d), F.col("conv_id")
    name = F.concat(F.lit("c"), k.cast("string"))
    text = F.concat(F.lit("x = "), k.cast("string"))
    row = F.struct(
        F.when(k % 7 != 0, name).alias("sample_id"), F.when(k % 4 == 0, "validation").alias("split"), F.when(k % 2 == 0, "benign").otherwise("1").alias("label"), F.when((k % 3 == 0) & (k % 7 != 0), F.col("tokens")).alias("tokens"),
        F.when((k % 3 == 1) | (k % 7 == 0), text).alias("source"), F.when((k % 3 == 2) & (k % 7 != 0), F.concat(name, F.lit(".py"))).alias("path"),
    )
    files = c.select(F.concat(name, F.lit(".py")).alias("path"), F.encode(F.concat(F.lit("y = "), k.cast("string")), "utf-8").alias("content"))
    t = readers.training_rows(c.select(F.to_json(row).alias("value")), files)
    return t.select("sample_id", "group_id", "split", "role", "label", F.array_join("tokens", " ").alias("tokens"), "source", "source_path")


def s14_corpus_list(spark, d):
    path = _folder(spark)
    k = F.col("doc_id")
    _documents(spark, d).select(F.concat(F.lit("p"), k.cast("string")).alias("folder_name"), F.when(k % 3 == 0, "npm").otherwise("pypi").alias("ecosystem"), F.when(k % 2 == 0, "Malicious").otherwise("benign").alias("label_true")).write.option("header", True).csv(path)
    return readers.corpus_list(spark, path, "pypi")


def s15_study_rows(spark, d):
    path = _folder(spark)
    V.table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("rank"), F.col("n_name").alias("project"))).alias("value")).write.text(path)
    return readers.study_rows(spark, path, "rank long, project string")


def _plan(spark, d):
    k = F.col("p_partkey")
    return V.table(spark, d, "part").select(
        k.alias("rank"), F.concat(F.lit("p"), k.cast("string")).alias("project"), F.lit("1.0").alias("version"), F.sha2("p_name", 256).alias("sha256"), (k % 1000 + 1).alias("size"), F.concat(F.lit("p"), k.cast("string"), F.lit(".whl")).alias("storage_name"),
        F.concat(F.lit("p"), k.cast("string"), F.lit(".whl")).alias("filename"),
    )


def s17_verified_plan(spark, d):
    """A plan against what was fetched: missing, unexpected, resized and changed files."""
    p, k = _plan(spark, d), F.col("rank")
    o = p.filter(k % 11 != 0).select(F.when(k % 13 == 0, F.concat(F.lit("q"), "filename")).otherwise(F.col("filename")).alias("filename"), F.when(k % 7 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"), (F.col("size") + F.when(k % 5 == 0, 1).otherwise(0)).alias("size"))
    return governance.verify_plan(p, o)


def j13_plan_links(spark, d):
    """Selected artifacts against the plan they come from."""
    p, k = _plan(spark, d), F.col("rank")
    rows = p.filter(k % 2 == 0).withColumn("storage_name", F.when(k % 10 == 0, F.concat(F.lit("x"), "storage_name")).otherwise(F.col("storage_name"))).withColumn("size", F.when(k % 6 == 0, 0).otherwise(F.col("size"))).withColumn("version", F.when(k % 18 == 0, "2").otherwise(F.col("version")))
    return records.plan_problems(rows, p)


def p4_selected_artifacts(spark, d):
    """Per project the preferred of its files that may be fetched."""
    ps, k = V.table(spark, d, "lineitem"), F.col("l_linenumber")
    end = F.element_at(F.array(*map(F.lit, (".whl", ".tar.gz", ".zip", ".exe"))), ((k + F.col("l_partkey")) % 4 + 1).cast("int"))
    files = ps.select(
        F.col("l_orderkey").cast("string").alias("project"), F.lit("1").alias("version"), F.concat(F.lit("f"), k.cast("string"), end).alias("filename"), F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey"), 256).alias("sha256"), F.col("l_partkey").cast("long").alias("size"), (k == 2).alias("yanked"),
        F.concat(F.when(k == 3, "http").otherwise("https"), F.lit("://files.example.invalid/x")).alias("url"),
    )
    return governance.select_artifact(files, 1500).select("project", "filename", "sha256", "size")


def j12_remaining(spark, d):
    """What a journal has not done yet, and its candidates."""
    p, k = _plan(spark, d), F.col("rank")
    journal = p.filter(k % 3 != 0).select("rank", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt")).withColumn("status", F.when((k + F.col("attempt")) % 2 == 0, "candidate").otherwise("error"))
    left = readers.remaining(p, journal).select("rank", F.lit("left").alias("what"))
    return left.unionByName(readers.journal_candidates(journal).select("rank", F.lit("candidate").alias("what")))


def e7_storage_names(spark, d):
    p = V.table(spark, d, "part")
    return p.select("p_partkey", readers.storage_name(F.translate("p_name", " ", "_"), F.lit("1.0"), F.concat(F.lit("a/b/"), F.col("p_partkey").cast("string"), F.lit(".whl")), F.sha2("p_name", 256)).alias("name"))


def s19_changed_files(spark, d):
    """Checksums before and after: added, removed and changed files."""
    k = F.col("doc_id")
    f = _documents(spark, d).select("doc_id", k.cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    before, after = f.filter(k % 7 != 0), f.filter(k % 5 != 0).withColumn("sha256", F.when(k % 3 == 0, F.sha2("path", 256)).otherwise(F.col("sha256")))
    return sinks.changed(before, after)


def s20_saved_weights(spark, d):
    """A sparse model written and read again."""
    path = _folder(spark)
    sinks.save_weights(spark.range(500).select(F.col("id").cast("int").alias("index"), (F.col("id") / 8).alias("weight")), path, 512)
    return sinks.load_weights(spark, path, 512)


def s21_checkpoint_tensors(spark, d):
    """Tensors of a checkpoint that was written and loaded under its manifest."""
    from brindle.operators.transformer import random_weights

    path = _folder(spark)
    checkpoints.save(spark, path, random_weights(1, 32, 16, 8, 1, 16))
    t = checkpoints.tensors(checkpoints.load(spark, path)[0], spark)
    return t.select("name", F.array_join("shape", "x").alias("shape"), "offset", "bytes")


# policies and scalars

TARGETS = (
    "", "API_TOKEN", "HOME", "/home/u/.ssh/id_rsa", "C:\\Users\\x\\Startup\\a.exe", "/etc/cron.d/job", "x.PTH", "python -c 1", "/usr/bin/bash -x", "gcc", "make all", "pip install", "python3_11 a", "sys.executable -m x", "node", "*", "/", "/tmp/x", "a/build/",
    "cache", "x.pyc", "tmp.1", "/home/u/Documents/a", "wallet.dat", "/var/x", "a b", ".hidden", "plain", "tests/a.py", "src/test_a.py", "docs/x/a.py", "scripts/run.py", "pkg/setup.py", "examples", "cargo build", "ninja", "/x/Cookies/y", "startup",
)
OPS = ("NETWORK_SEND", "BROWSER_COOKIE_READ", "ENV_READ", "PROCESS_EXEC", "FILE_DELETE", "FILE_READ", "DYNAMIC_EXEC", "PERSISTENCE_WRITE")


def _targets(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (F.floor(F.col("o_orderkey") / by) % len(xs) + 1).cast("int"))
    return o.select(pick(TARGETS, 1).alias("t"), pick(OPS, len(TARGETS)).alias("op")).groupBy("t", "op").agg(F.count("*").alias("n"))


def f2_f6_target_classes(spark, d):
    t, op = F.col("t"), F.col("op")
    return _targets(spark, d).select(
        "t", "op", "n", P.is_sensitive_env(t).alias("env"), P.is_sensitive_path(t).alias("path"), P.is_persistence_path(t).alias("persistent"), P.process_target_class(t).alias("process"), P.delete_target_class(t).alias("deletion"),
        P.is_destructive_delete(t, F.lit(True)).alias("destructive"), P.model_target_class(op, t).alias("model"), P.is_auxiliary_path(t).alias("auxiliary"), P.is_orchestration_path(t).alias("orchestration"),
    )


CALLED = tuple(n for _, _, _, names in W.CALLS for n in names[:3]) + ("subprocess.other", "os.spawnv", "os.execve", "os.executable", "p.read_text", "p.write_bytes", "read_text", "print", "x.eval", "requests.get2")


def f1_call_classes(spark, d):
    """Call names by exact name, prefix and suffix."""
    o = V.table(spark, d, "orders")
    names = o.select(F.element_at(F.array(*map(F.lit, CALLED)), (F.col("o_orderkey") % len(CALLED) + 1).cast("int")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return P.classify_calls(names)


def f7_token_formats(spark, d):
    e = V.behavior(spark, d)
    return e.groupBy(T.event_token(F.col("phase"), F.lit("source"), F.col("op"), F.col("target")).alias("token"), T.model_event_token(F.col("phase"), F.lit("source"), F.col("op"), F.col("target")).alias("model"), T.path_token(F.lower("op"), F.lit("data-flow"), F.lit("very high")).alias("path")).agg(F.count("*").alias("n"))


SPELLINGS = (" Benign ", "0", "1", "POSITIVE", "suspicious", "clean", "negative", "Malicious")


def f24_labels(spark, d):
    s = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("doc_id") % len(SPELLINGS) + 1).cast("int"))
    return _documents(spark, d).select("doc_id", P.label(s).alias("label"))


def f19_f27_token_hashes(spark, d):
    c = _conversations(spark, d)
    return c.select("conv_id", T.json_hash(F.col("tokens")).alias("json"), F.round(T.jaccard(F.col("tokens"), F.array(F.lit("user"), F.lit("tool"))), 6).alias("overlap"))


def f20_multiset_hashes(spark, d):
    """Order-free content hashes of the documents of a source."""
    docs = V.table(spark, d, "documents").filter("text is not null").select((F.col("doc_id") % 50).alias("part"), F.encode("text", "utf-8").alias("c"))
    return docs.groupBy("part").agg(T.multiset_hash(F.collect_list("c")).alias("hash"))


def f22_canonical_fingerprint(spark, d):
    """The fingerprint of predictions as reports publish it."""
    from brindle.functions.fingerprint import canonical_fingerprint

    p = V.predictions(spark, d).select("sample_id", "label", F.round("score", 6).alias("score"), "split", "group_id", "period")
    return canonical_fingerprint(p, ["sample_id", "label", "score", "split", "group_id", "period"], "sample_id")


# patterns and scans


def w3_near_patterns(spark, d):
    """Near patterns as the lexical frontend words them."""
    p = patterns.proximity_paths(V.behavior(spark, d), unproven=W.LEXICAL_UNPROVEN)
    return p.groupBy("motif", "score", "reason", "evidence_kind", "confidence").agg(F.count("*").alias("n"))


def j6_known_pairs(spark, d):
    """Near patterns without the pairs that exact paths join already: here those that are two events apart."""
    e = V.behavior(spark, d)
    near = patterns.proximity_paths(e)
    apart = F.col("event_indexes")[1] - F.col("event_indexes")[0]
    exact = near.filter(apart == 2).withColumn("evidence_kind", F.lit("dataflow"))
    p = patterns.proximity_paths(e, exact)
    return p.select("target_id", "path", "motif", F.col("event_indexes")[0].alias("source"), F.col("event_indexes")[1].alias("sink"))


def p3_summary_cover(spark, d):
    """Scores by two strategies where summary paths cover the first read and the first transfer of a function."""
    e = V.behavior(spark, d)
    first = lambda op: F.min(F.when(F.col("op") == op, F.col("event_index")))
    s = e.groupBy("target_id", "path", "function").agg(first("FILE_READ").alias("a"), first("NETWORK_SEND").alias("b")).filter("a is not null and b is not null")
    s = s.select("target_id", "path", F.lit("file_to_network").alias("motif"), F.lit(14.0).alias("score"), F.lit("own").alias("reason"), F.array("a", "b").alias("event_indexes"), F.lit("summary").alias("evidence_kind"), F.lit("medium").alias("confidence"))
    return scoring.rule_scores(scoring.evidence(e, s), ("semantic-top8-v1", "legacy-top8")).select("target_id", "system", "score")


def _corpus(spark, d):
    return corpus(spark, V.table(spark, d, "orders").count() // 10)


def x23_lexical_operations(spark, d):
    e = lexical.events(_corpus(spark, d))
    return e.groupBy("op", "category", "phase", "detail").agg(F.count("*").alias("n"), F.count_distinct("function").alias("functions"), F.min("line").cast("long").alias("first_line"))


def g10_lexical_summaries(spark, d):
    from brindle.plans.scan import scan_lexically

    s = scan_lexically(_corpus(spark, d))["summaries"]
    return s.groupBy(*[F.array_join(c, ",").alias(c) for c in ("entrypoints", "data_origins", "data_destinations", "transformations", "flows")]).agg(F.count("*").alias("files"))


def b_lexical_decisions(spark, d):
    from brindle.plans.scan import scan_lexically

    return scan_lexically(_corpus(spark, d))["decisions"].select("target_id", "rule_score", "risk_score", "verdict")


def x2_operations(spark, d):
    e = frontend.events_of(frontend.extract(_corpus(spark, d)))
    return e.groupBy("op", "category", "phase").agg(F.count("*").alias("n"), F.count_distinct("function").alias("functions"))


def x24_archived_operations(spark, d):
    """Operations of the members of archives, ten files to each."""
    c = _corpus(spark, d).withColumn("a", F.floor(F.regexp_extract("path", "([0-9]+)", 1).cast("long") / 10))

    def build(pdf):
        import pandas as pd

        with zipfile.ZipFile(out := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
            for p, raw in zip(pdf["path"], pdf["content"]):
                z.writestr(p, raw)
        return pd.DataFrame({"path": [f"a{int(pdf['a'].iloc[0])}.whl"], "content": [out.getvalue()]})

    zips = c.groupBy("a").applyInPandas(build, "path string, content binary")
    e = frontend.events_of(frontend.extract(archives.expand(zips).filter("error is null")))
    return e.groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("target_id").alias("archives"))


def s18_rendered_reports(spark, d):
    from brindle.plans.scan import rendered, scan

    return rendered(scan(_corpus(spark, d)))


def s1_scan_warnings(spark, d):
    """Warnings of a scan in which every tenth text breaks off inside a string."""
    from brindle.plans.scan import scan, scan_warnings

    c = _corpus(spark, d)
    k = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    broken = c.withColumn("content", F.when(k % 10 == 3, F.encode(F.lit("x = 'abc"), "utf-8")).otherwise(F.col("content")))
    files = _files(spark, d).withColumn("target_id", F.lit("folder"))
    plan = readers.plan_files(files, 3000, 1000, 60_000).withColumn("target_id", F.lit("folder"))
    w = scan_warnings(scan(broken), plan)
    return w.groupBy("target_id", F.regexp_extract("warning", "^(parse error|oversized file skipped|cannot read|total byte limit reached)", 1).alias("kind")).agg(F.count("*").alias("n"))


# studies


def w7_hard_negatives(spark, d):
    return study.hard_negatives(V.predictions(spark, d), 10).select("group_id", F.round("score", 6).alias("score"))


def a31_holdout_report(spark, d):
    a, b = V.predictions(spark, d).filter("label = 0 and split = 'test'"), V.predictions(spark, d, 11)
    pairs = a.select("sample_id", "group_id", F.col("score").alias("b_score")).join(b.select("sample_id", F.col("score").alias("c_score")), "sample_id")
    r = study.holdout_report(pairs, 0.8, 0.83)
    return r.select("system", "threshold", "alert_groups", "groups", F.round("maximum_score", 6).alias("maximum_score"), F.coalesce("passed", F.lit(False)).alias("passed"), "baseline_only", "candidate_only", "both", "neither")


def a31_valid_points(spark, d):
    """Development points of each period, and which of them are valid and eligible."""
    p = study.development_point(V.predictions(spark, d), ["period"])
    p = study.valid_points(p, 0.99, 0.01)
    return p.select("period", F.round("threshold", 6).alias("threshold"), F.round("recall", 6).alias("recall"), "valid", "eligible")


def a35_overhead(spark, d):
    t = study.timings(V.predictions(spark, d), "latency_ms", ["split"])
    o = study.overhead(t, "split", "train", "test")
    return o.select(*[F.round(c, 6).alias(c) for c in o.columns])


def w9_scan_order(spark, d):
    return records.scan_order(V.manifest(spark, d).select("sample_id"), 7)


def g4_study_problems(spark, d):
    return records.study_problems(V.manifest(spark, d).filter("split is not null"))


def g4_isolated_rows(spark, d):
    """Rows of groups that lie in one split, which the guard lets pass."""
    m = V.manifest(spark, d).filter("split is not null").withColumn("group_id", F.concat_ws("-", "split", "sha256")).withColumn("representation_hash", F.concat_ws("-", "split", "sample_id")).filter("sha256 is not null")
    return governance.require_isolated(m).groupBy("split").agg(F.count("*").alias("n"))


def e6_study_record(spark, d):
    m = V.manifest(spark, d).filter("split is not null")
    k = F.col("sample_id").cast("long")
    audits = m.select(F.when(k % 9 == 0, "rejected").otherwise("ok").alias("status"), (k % 4).alias("python_files"), (k % 1000).alias("python_bytes"), (k % 2).alias("parse_errors"), F.lit(0.5).alias("baseline_score"), F.when(k % 8 == 0, 0.75).otherwise(0.5).alias("candidate_score"))
    outputs = m.select(F.lit("rows").alias("path"), F.sha2(F.lit("rows"), 256).alias("sha256")).limit(1)
    r = records.study_record(m, audits, "own", {"seed": 7}, "supported", outputs)
    s = lambda c, key: F.coalesce(F.col(c)[key], F.lit(0)).alias(key)
    keys = [f"{u}_{x}_{y}" for u in ("samples", "groups") for x in W.SPLITS for y in ("benign", "malicious")]
    return r.select("study", "claim_status", *[s("support", k) for k in keys], "grouping.samples", "grouping.groups", s("status_counts", "ok"), s("status_counts", "rejected"), "python_files", "python_bytes", "parse_errors", "score_changed", F.col("output_sha256")["rows"].alias("rows_sha256"))


def a39_support_profile(spark, d):
    c = _conversations(spark, d).select((F.col("conv_id") % 10).alias("group_id"), F.col("conv_id").alias("ord"), "tokens")
    known, first = support.profile(c)
    return first.select("group_id", F.array_join("tokens", ",").alias("tokens")).crossJoin(F.broadcast(known.agg(F.count("*").alias("known"))))


def m10_windowed_model(spark, d):
    """The largest share of user turns in any window of four, by a model that is a plain function."""
    c = _conversations(spark, d).withColumnRenamed("conv_id", "sample_id")
    share = lambda lists: [sum(t == "user" for t in x) / len(x) for x in lists]
    return models.predict_windows(c, share, 4, 1).select("sample_id", F.round("probability", 6).alias("probability"))


def e3_verified_rows(spark, d):
    """Rows whose digests are as expected, of splits that may be seen."""
    from brindle import api

    m = V.manifest(spark, d).filter("split in ('train', 'validation')")
    return api.sealed(api.verified(m, m.select("sample_id", "sha256"), ["sha256"])).groupBy("split").agg(F.count("*").alias("n"))


def e1_artifact_rows(spark, d):
    """Three hashes, counts and status of archives of generated files."""
    from brindle import api

    k = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    c = _corpus(spark, d).withColumn("a", F.floor(k / 10)).withColumn("name", F.concat(F.lit("a"), F.floor(k / 10).cast("string"), F.when(F.floor(k / 10) % 7 == 6, ".bin").otherwise(".zip")))
    a = api.artifact_rows(c.groupBy("a").applyInPandas(_zipped, "path string, content binary"))
    return a.select("target_id", "status", F.col("python_files").cast("long").alias("python_files"), F.coalesce(F.col("events").cast("long"), F.lit(0).cast("long")).alias("events"), F.coalesce(F.col("exact_paths").cast("long"), F.lit(0).cast("long")).alias("exact_paths"), F.col("ast_hash").isNotNull().alias("levelled"))


def _zipped(pdf):
    import pandas as pd

    with zipfile.ZipFile(out := io.BytesIO(), "w", zipfile.ZIP_STORED) as z:
        for p, raw in zip(pdf["path"], pdf["content"]):
            z.writestr(p, raw)
    return pd.DataFrame({"path": [pdf["name"].iloc[0]], "content": [out.getvalue()]})


def _labelled(spark, d):
    k = F.regexp_extract("target_id", "([0-9]+)", 1).cast("long")
    return _corpus(spark, d).select("target_id").distinct().select("target_id", (k % 2).cast("int").alias("label"), F.when(k % 3 == 0, "validation").otherwise("test").alias("split"), F.concat(F.lit("g"), k.cast("string")).alias("group_id"))


def e2_two_variants(spark, d):
    """Audit rows of a paired scan in its preregistered order."""
    from brindle import api

    a = api.two_variants(_corpus(spark, d), _labelled(spark, d), 7)[1]
    return a.select("sample_id", "rank", "candidate_first", "status", "python_files", "parse_errors", F.col("exact_paths").cast("long").alias("exact_paths"), "baseline_score", "candidate_score")


def e5_verified_lock(spark, d):
    """Digests that a study was locked with against those observed."""
    from brindle import api

    f = _documents(spark, d).select(F.col("doc_id"), F.concat(F.lit("input"), F.col("doc_id").cast("string")).alias("name"), F.sha2("text", 256).alias("sha256"))
    k = F.col("doc_id")
    return api.verify_lock(f.filter(k % 9 != 0), f.filter(k % 8 != 0).withColumn("sha256", F.when(k % 7 == 0, F.lit("x")).otherwise(F.col("sha256"))))


def e8_round_rows(spark, d):
    from brindle.sources.generators import round_rows

    return round_rows(spark).select("sample_id", "group_id", "pair_id", "variant", "label", "split", F.array_join("tokens", " ").alias("tokens"))


def e9_trained_model(spark, d):
    """A sparse model trained on generated rows, saved and judged: pairs in order and rows of the profile."""
    from brindle import api
    from brindle.sources.generators import training_rows

    t = api.train_and_export(training_rows(spark), _folder(spark), 4096)
    saved = t["prototypes"].agg(F.count("*").alias("prototypes")).crossJoin(F.broadcast(t["known"].agg(F.count("*").alias("known"))))
    return saved.crossJoin(F.broadcast(t["pairs"].select("pairs", (F.col("pair_order_accuracy") >= 0.5).alias("ordered"))))


def m5_trained_transformer(spark, d):
    """A small Transformer trained on generated rows until it knows them; what it was trained on and whether it did."""
    from brindle.operators.micro_training import train_micro
    from brindle.sources.generators import training_rows

    rows = training_rows(spark).withColumn("system", F.lit("m")).withColumn("split", F.when(F.col("variant") == "tail", "validation").otherwise("train"))
    t = train_micro(rows, vocabulary=128, length=16, d=16, layers=1, ffn=16, heads=2, epochs=150, rate=1e-2, patience=150)
    a = F.from_json("account", "examples long, pairs long, `groups` long, parameters long, training_accuracy double, best_epoch long, epochs_completed long")
    return t.select("system", a.alias("a")).select("system", "a.examples", "a.pairs", "a.groups", "a.parameters", (F.col("a.training_accuracy") > 0.9).alias("learned"), (F.col("a.best_epoch") <= F.col("a.epochs_completed")).alias("kept_best"))


def e10_primary_purposes(spark, d):
    from brindle.operators import effects

    e = V.behavior(spark, d)
    p = patterns.behavior_paths(e)
    return effects.primary_purpose(effects.purpose_candidates(p, e), e)


def m4_prediction_details(spark, d):
    """Windows and support of predictions; probabilities are those of random weights and left out."""
    from brindle.operators import transformer

    c = _conversations(spark, d).withColumnRenamed("conv_id", "sample_id")
    known, first = support.profile(c.filter("sample_id % 2 = 0").select((F.col("sample_id") % 10).alias("group_id"), F.col("sample_id").alias("ord"), "tokens"))
    p = transformer.predict_details(c, transformer.random_weights(3, 512, 8, 32, 1, 32), known, first, 1.0, 0.6, overlap=1)
    return p.select("sample_id", F.col("windows").cast("long").alias("windows"), F.round("token_coverage", 6).alias("token_coverage"), F.round("nearest", 6).alias("nearest"), "supported", F.col("probability").between(0, 1).alias("probable"))


def api_pilot_record(spark, d):
    """The account of a whole study on generated sources."""
    from brindle import api

    r = api.pilot(_corpus(spark, d), _labelled(spark, d), 7, 0.05, 50)["record"]
    return r.select("study", "claim_status", "grouping.samples", "grouping.groups", F.col("status_counts")["ok"].alias("ok"), "python_files", "parse_errors", "score_changed")


def api_scan_fail_on(spark, d):
    from brindle import api

    return api.scan(_corpus(spark, d), fail_on="review").select("target_id", "verdict", "failed")


# the same in SQL

WITH = f"WITH {V.SQL['pred']}, "
_MANIFEST = f"WITH {V.SQL['manifest']}, "
_BEHAVIOR = f"WITH {V.SQL['behavior']}, "
_CONV = "c AS (SELECT conv_id, list(role ORDER BY turn) t FROM conversations GROUP BY 1)"
_DOC = "doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_PICK = lambda xs, i: f"([{_quoted(xs)}])[(({i}) % {len(xs)} + 1)::INTEGER]"
_FILES = f"""{_DOC}, f AS (SELECT CASE WHEN doc_id % 13 = 0 THEN n ELSE {_PICK(FOLDERS, "doc_id")} || '/' || n END AS relative, CASE WHEN doc_id % 29 <> 3 THEN length(text) END AS length
      FROM (SELECT *, 'm' || doc_id || CASE doc_id % 10 WHEN 9 THEN '.txt' WHEN 8 THEN '.PY' ELSE '.py' END n FROM doc)),
    r AS (SELECT relative, length, list_transform(string_split(relative, '/'), lambda x, i: CASE WHEN i = len(string_split(relative, '/')) THEN '0' ELSE '1' END || x) k FROM f WHERE lower(relative) LIKE '%.py' AND NOT list_has_any(string_split(relative, '/')[:-2], [{_quoted(W.EXCLUDED_DIRECTORIES)}]))"""


def _planned(files: int, total: int) -> str:
    """A walk with state: sums and counts before each file decide whether it is still reached."""
    return f"""WITH {_FILES}, w AS (SELECT *, length IS NOT NULL AND length <= 3000 ok, coalesce(sum(CASE WHEN length <= 3000 THEN length END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 0) t, count(CASE WHEN length <= 3000 THEN 1 END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) - CASE WHEN length <= 3000 THEN 1 ELSE 0 END before FROM r),
    s AS (SELECT *, CASE WHEN before >= {files} THEN 'file limit reached' WHEN ok AND t > {total} THEN 'total byte limit reached' WHEN ok THEN 'taken' WHEN length IS NULL THEN 'unreadable' ELSE 'oversized' END state FROM w)
    SELECT relative, coalesce(length, -1)::BIGINT AS length, state FROM (SELECT *, count(CASE WHEN state LIKE '%reached' THEN 1 END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) ended FROM s) WHERE ended = 0 OR ended = 1 AND state LIKE '%reached'"""


_MEMBERS = f"""{_DOC}, a AS (SELECT *, (doc_id // 10) a FROM doc), m AS (SELECT 'a' || a || CASE WHEN a % 9 = 2 THEN '.rar' WHEN a % 2 = 0 THEN '.zip' ELSE '.tar.gz' END target_id, a, 'src/d' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.py' END AS path, text FROM a)"""
_S = "lower(replace(t, chr(92), '/'))"
_ANY = lambda xs, s=_S: f"len(list_filter([{_quoted(xs)}], lambda m: contains({s}, m))) > 0"
_PART = f"string_split(rtrim(trim({_S}), '/'), '/')[-1]"
_PROCESS = "CASE " + " ".join(f"WHEN name IN ({_quoted(n)}) OR split_part(name, '_', 1) IN ({_quoted(n)}) THEN '{k}'" for k, n in W.PROCESS_CLASSES) + " ELSE 'generic' END"
_DELETE = f"""CASE WHEN t = '' THEN 'generic' WHEN trim({_S}) IN ({_quoted(W.DELETE_BROAD)}) OR contains(t, '*') THEN 'broad' WHEN {_PART} IN ({_quoted(W.DELETE_TEMPORARY_NAMES)}) OR {_PART} LIKE '%.pyc' OR {_PART} LIKE '%.tmp' OR {_PART} LIKE 'cache.%' OR {_PART} LIKE 'tmp.%' OR {_ANY(W.DELETE_TEMPORARY_PARTS, f'trim({_S})')} THEN 'temporary'
    WHEN {_ANY(W.DELETE_USER_DATA, f"'/' || trim(trim({_S}), '/') || '/'")} THEN 'user_data' ELSE 'generic' END"""
_AUX = f"(list_has_any(string_split({_S}, '/')[:-2], [{_quoted(W.AUXILIARY_PARTS)}]) OR leaf = 'conftest.py' OR leaf LIKE 'test\\_%' ESCAPE '\\' OR leaf LIKE '%\\_test.py' ESCAPE '\\')"
_TARGET = f"""o AS (SELECT {_PICK(TARGETS, "o_orderkey")} t, {_PICK(OPS, f"o_orderkey // {len(TARGETS)}")} op FROM orders), g AS (SELECT t, op, count(*)::BIGINT n FROM o GROUP BY ALL),
    h AS (SELECT *, string_split({_S}, '/')[-1] leaf, string_split(trim(split_part(trim({_S}), ' ', 1), '"' || chr(39)), '/')[-1] name FROM g), b AS (SELECT *, {_PROCESS} process, {_DELETE} deletion FROM h)"""
_CALL = " UNION ALL ".join(f"SELECT '{n}' call_name, '{op}' op, '{c}' category, '{detail}' detail" for op, c, detail, names in W.CALLS for n in names)
_N = "n AS (SELECT count(*) // 10 n FROM orders), c AS (SELECT unnest(range(0, (SELECT n FROM n))) i)"

SQL = {
    "s1_planned_files": _planned(1000, 60_000),
    "s2_file_limit": _planned(25, 10**9),
    "s4_file_heads": f"WITH {_DOC} SELECT 'd' || doc_id AS path, sha256(encode(text)[1:2000]) sha256, least(2000, strlen(text))::BIGINT bytes_read, strlen(text) > 2000 truncated FROM doc",
    "s5_archive_members": f"""WITH {_MEMBERS} SELECT target_id, path, sha256(text) sha256, strlen(text)::BIGINT bytes, false truncated FROM m WHERE path LIKE '%.py' AND a % 9 NOT IN (1, 2)
        UNION ALL SELECT DISTINCT target_id, CASE a % 9 WHEN 2 THEN 'unknown archive type' ELSE 'unsafe member name ''../x.py''' END, NULL, -1::BIGINT, false FROM m WHERE a % 9 IN (1, 2)""",
    "s10_archive_fingerprints": f"""WITH {_MEMBERS}, p AS (SELECT target_id, a, printf('%016X', strlen(text)) || upper(sha256(text)) e, strlen(text) b FROM m WHERE path LIKE '%.py') SELECT target_id, CASE WHEN a % 9 IN (1, 2) THEN 'rejected' ELSE 'ok' END status,
        CASE WHEN a % 9 IN (1, 2) THEN 0 ELSE count(*) END::BIGINT python_files, CASE WHEN a % 9 IN (1, 2) THEN 0 ELSE sum(b) END::BIGINT python_bytes, CASE WHEN a % 9 NOT IN (1, 2) THEN sha256(unhex(string_agg('0000000000000028' || e, '' ORDER BY e))) END source_set_hash FROM p GROUP BY target_id, a""",
    "s9_member_names": f"WITH {_DOC}, v(i, name, safe) AS (VALUES (0, 'a.py', true), (1, 'a/b.py', true), (2, '../a.py', false), (3, '/a.py', false), (4, 'a/./b.py', false), (5, 'a//b.py', false), (6, 'C:a.py', false), (7, 'a' || chr(92) || 'b.py', false), (8, 'a/b/', true), (9, 'a' || chr(10) || 'b.py', false), (10, '..a.py', true), (11, 'é/ß.py', true)) SELECT name, count(*)::BIGINT n, safe FROM doc JOIN v ON doc_id % 12 = i GROUP BY name, safe",
    "s11_prediction_problems": "SELECT CASE o_orderkey % 50 WHEN 0 THEN 'score is not in [0, 1]' WHEN 1 THEN 'has an unknown split' WHEN 2 THEN 'has an unknown label' WHEN 3 THEN 'latency is negative' WHEN 4 THEN 'lacks group_id' WHEN 5 THEN 'has unknown fields' WHEN 6 THEN 'sample_id is not unique' WHEN 7 THEN 'is not a JSON object' ELSE '' END problem, count(*)::BIGINT n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "s11_predictions": WITH[:-2] + " SELECT sample_id, label::INTEGER AS label, round(score, 9) score, split, group_id, period, coalesce(model_invoked::VARCHAR, '') model_invoked, round(latency_ms, 6) latency_ms FROM pred",
    "s12_manifest_problems": _MANIFEST[:-2] + " SELECT CASE sample_id::BIGINT % 20 WHEN 0 THEN 'sha256 is not lower-case hex' WHEN 1 THEN 'first_seen is not a date' WHEN 2 THEN 'holds a payload field' WHEN 3 THEN 'license is blank or too long' WHEN 4 THEN 'has an unknown split' ELSE '' END problem, count(*)::BIGINT n FROM manifest GROUP BY 1",
    "s13_training_rows": f"""WITH {_CONV}, r AS (SELECT *, CASE WHEN conv_id % 3 = 1 OR conv_id % 7 = 0 THEN 'x = ' || conv_id WHEN conv_id % 3 = 2 THEN 'y = ' || conv_id END s, CASE WHEN conv_id % 7 <> 0 THEN 'c' || conv_id END id FROM c)
        SELECT coalesce(id, sha256(s)) sample_id, coalesce(id, sha256(s)) group_id, CASE WHEN conv_id % 4 = 0 THEN 'validation' ELSE 'train' END split, 'example' AS role, (conv_id % 2)::INTEGER AS label, CASE WHEN s IS NULL THEN array_to_string(t, ' ') END tokens, s AS source, CASE WHEN conv_id % 3 = 2 AND conv_id % 7 <> 0 THEN 'c' || conv_id || '.py' ELSE '<row>' END source_path FROM r""",
    "s14_corpus_list": f"WITH {_DOC} SELECT 'p' || doc_id folder_name, 'pypi' ecosystem, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS label FROM doc WHERE doc_id % 3 <> 0",
    "s15_study_rows": "SELECT n_nationkey::BIGINT AS rank, n_name project FROM nation",
    "s17_verified_plan": """WITH p AS (SELECT p_partkey k, 'p' || p_partkey || '.whl' f FROM part) SELECT f filename, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 'missing' WHEN k % 5 = 0 THEN 'size' ELSE 'sha256' END reason FROM p WHERE k % 11 = 0 OR k % 13 = 0 OR k % 5 = 0 OR k % 7 = 0
        UNION ALL SELECT 'q' || f, 'unexpected' FROM p WHERE k % 13 = 0 AND k % 11 <> 0""",
    "j13_plan_links": "SELECT CASE WHEN p_partkey % 10 = 0 THEN 'x' ELSE '' END || 'p' || p_partkey || '.whl' storage_name, CASE WHEN p_partkey % 10 = 0 THEN 'is not in the plan' WHEN p_partkey % 18 = 0 THEN 'differs in version, size' ELSE 'differs in size' END problem FROM part WHERE p_partkey % 2 = 0 AND (p_partkey % 10 = 0 OR p_partkey % 6 = 0)",
    "p4_selected_artifacts": """WITH f AS (SELECT l_orderkey::VARCHAR project, (l_linenumber + l_partkey) % 4 kind, 'f' || l_linenumber || (['.whl', '.tar.gz', '.zip', '.exe'])[((l_linenumber + l_partkey) % 4 + 1)::INTEGER] filename, sha256(l_orderkey || '|' || l_linenumber || '|' || l_partkey) sha256, l_partkey::BIGINT AS size FROM lineitem WHERE l_linenumber NOT IN (2, 3) AND l_partkey BETWEEN 1 AND 1500)
        SELECT project, filename, sha256, size FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY kind, filename, sha256) r FROM f WHERE kind < 3) WHERE r = 1""",
    "j12_remaining": "SELECT p_partkey::BIGINT AS rank, 'left' what FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey::BIGINT, 'candidate' FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0",
    "e7_storage_names": "SELECT p_partkey, regexp_replace(lower(replace(p_name, ' ', '_')), '[-_.]+', '-', 'g') || '-1.0-' || sha256(p_name)[1:12] || '-' || p_partkey || '.whl' AS name FROM part",
    "s19_changed_files": f"WITH {_DOC} SELECT doc_id::VARCHAR path, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM doc WHERE NOT (doc_id % 7 = 0 AND doc_id % 5 = 0) AND (doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0 AND sha256(text) <> sha256(doc_id::VARCHAR))",
    "s20_saved_weights": "SELECT i::INTEGER AS index, i / 8.0::DOUBLE weight FROM range(500) r(i)",
    "s21_checkpoint_tensors": """WITH v(name, shape, n) AS (VALUES ('classifier.bias', '2', 2), ('classifier.weight', '2x8', 16), ('encoder.layers.0.linear1.bias', '16', 16), ('encoder.layers.0.linear1.weight', '16x8', 128), ('encoder.layers.0.linear2.bias', '8', 8), ('encoder.layers.0.linear2.weight', '8x16', 128), ('encoder.layers.0.norm1.bias', '8', 8),
        ('encoder.layers.0.norm1.weight', '8', 8), ('encoder.layers.0.norm2.bias', '8', 8), ('encoder.layers.0.norm2.weight', '8', 8), ('encoder.layers.0.self_attn.in_proj_bias', '24', 24), ('encoder.layers.0.self_attn.in_proj_weight', '24x8', 192), ('encoder.layers.0.self_attn.out_proj.bias', '8', 8),
        ('encoder.layers.0.self_attn.out_proj.weight', '8x8', 64), ('norm.bias', '8', 8), ('norm.weight', '8', 8), ('position_embedding.weight', '16x8', 128), ('token_embedding.weight', '32x8', 256)) SELECT name, shape, coalesce(4 * sum(n) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", (4 * n)::BIGINT bytes FROM v""",
    "f2_f6_target_classes": f"""WITH {_TARGET} SELECT t, op, n, {_ANY(W.SENSITIVE_ENV)} env, {_ANY(W.SENSITIVE_PATH)} AS path, {_ANY(W.PERSISTENCE_PATH)} OR {_S} LIKE '%.pth' persistent, process, deletion, deletion <> 'temporary' destructive,
        CASE WHEN op = 'NETWORK_SEND' THEN 'network' WHEN op = 'BROWSER_COOKIE_READ' THEN 'browser_session' WHEN op = 'PERSISTENCE_WRITE' OR op = 'ENV_READ' AND {_ANY(W.SENSITIVE_ENV)} THEN 'sensitive' WHEN op = 'PROCESS_EXEC' THEN 'process_' || process WHEN op = 'FILE_DELETE' THEN 'delete_' || deletion WHEN op = 'FILE_READ' THEN 'file' WHEN contains({_S}, '/') OR {_S} LIKE '.%' THEN 'path' ELSE 'generic' END model,
        {_AUX} auxiliary, {_AUX} OR list_has_any(string_split({_S}, '/')[:-2], [{_quoted(W.ORCHESTRATION_PARTS)}]) OR leaf IN ({_quoted(W.ORCHESTRATION_FILES)}) orchestration FROM b""",
    "f1_call_classes": f"""WITH s AS ({_CALL}), g AS (SELECT {_PICK(CALLED, 'o_orderkey')} AS name, count(*)::BIGINT n FROM orders GROUP BY 1) SELECT name, n, coalesce(s.op, CASE WHEN name LIKE 'os.spawn%' OR name LIKE 'os.exec%' OR name LIKE 'subprocess.%' THEN 'PROCESS_EXEC' WHEN name LIKE '%.read\\_text' ESCAPE '\\' THEN 'FILE_READ' WHEN name LIKE '%.write\\_bytes' ESCAPE '\\' THEN 'FILE_WRITE' END) op,
        coalesce(s.category, CASE WHEN name LIKE 'os.spawn%' OR name LIKE 'os.exec%' OR name LIKE 'subprocess.%' OR name LIKE '%.write\\_bytes' ESCAPE '\\' THEN 'sink' WHEN name LIKE '%.read\\_text' ESCAPE '\\' THEN 'source' END) category,
        coalesce(s.detail, CASE WHEN name LIKE 'os.spawn%' OR name LIKE 'os.exec%' OR name LIKE 'subprocess.%' THEN 'process or shell execution' WHEN name LIKE '%.read\\_text' ESCAPE '\\' THEN 'file read' WHEN name LIKE '%.write\\_bytes' ESCAPE '\\' THEN 'file write' END) detail FROM g LEFT JOIN s ON s.call_name = g.name""",
    "f7_token_formats": _BEHAVIOR[:-2] + " SELECT 'P:' || phase || '|C:source|O:' || op || '|T:' || lower(target) AS token, 'P:' || phase || '|C:source|O:' || op || '|T:' || CASE op WHEN 'NETWORK_SEND' THEN 'network' WHEN 'FILE_READ' THEN 'file' WHEN 'ENV_READ' THEN CASE WHEN target = 'API_TOKEN' THEN 'sensitive' ELSE 'generic' END ELSE 'generic' END model, 'PATH:' || lower(op) || '|K:data_flow|Q:very_high' AS path, count(*)::BIGINT n FROM behavior GROUP BY 1, 2, 3",
    "f24_labels": f"WITH {_DOC} SELECT doc_id, ([0, 0, 1, 1, 1, 0, 0, 1])[(doc_id % 8 + 1)::INTEGER]::INTEGER AS label FROM doc",
    "f19_f27_token_hashes": f"WITH {_CONV} SELECT conv_id, sha256('[' || array_to_string(list_transform(t, lambda x: '\"' || x || '\"'), ',') || ']') json, round(len(list_intersect(t, ['user', 'tool']))::DOUBLE / len(list_distinct(list_concat(t, ['user', 'tool']))), 6) AS overlap FROM c",
    "f20_multiset_hashes": "WITH e AS (SELECT doc_id % 50 AS part, printf('%016X', strlen(text)) || upper(sha256(text)) e FROM documents WHERE text IS NOT NULL) SELECT part, sha256(unhex(string_agg('0000000000000028' || e, '' ORDER BY e))) hash FROM e GROUP BY part",
    "f22_canonical_fingerprint": WITH[:-2] + """ SELECT sha256('[' || string_agg('{"group_id":"' || group_id || '","label":' || label || ',"period":"' || period || '","sample_id":"' || sample_id || '","score":' || round(score, 6)::VARCHAR || ',"split":"' || split || '"}', ',' ORDER BY sample_id) || ']') fingerprint FROM pred""",
    "w9_scan_order": _MANIFEST[:-2] + " SELECT sample_id, sha256('7' || chr(0) || 'scan' || chr(0) || sample_id) AS rank, sha256('7' || chr(0) || 'order' || chr(0) || sample_id)[-1] IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') candidate_first FROM manifest",
    "w7_hard_negatives": WITH + "g AS (SELECT group_id, max(label) l, max(score) s FROM pred GROUP BY 1) SELECT group_id, round(s, 6) score FROM g WHERE l = 0 ORDER BY s DESC, group_id LIMIT 10",
    "a31_holdout_report": WITH + """g AS (SELECT group_id, max(score) b, max(score_b) c FROM pred WHERE label = 0 AND split = 'test' GROUP BY 1), s AS (SELECT count(*) n, count_if(b >= 0.8::DOUBLE) kb, count_if(c >= 0.83::DOUBLE) kc, count_if(b >= 0.8::DOUBLE AND c < 0.83::DOUBLE) ob, count_if(b < 0.8::DOUBLE AND c >= 0.83::DOUBLE) oc, count_if(b >= 0.8::DOUBLE AND c >= 0.83::DOUBLE) bo, max(b) mb, max(c) mc FROM g)
        SELECT 'baseline' AS system, 0.8::DOUBLE threshold, kb::BIGINT alert_groups, n::BIGINT AS "groups", round(mb, 6) maximum_score, false AS passed, ob::BIGINT baseline_only, oc::BIGINT candidate_only, bo::BIGINT AS both, (n - ob - oc - bo)::BIGINT neither FROM s
        UNION ALL SELECT 'candidate', 0.83::DOUBLE, kc::BIGINT, n::BIGINT, round(mc, 6), n >= 450 AND kc = 0 AND 1 - pow(0.025::DOUBLE, 1.0::DOUBLE / n) < 0.01, ob::BIGINT, oc::BIGINT, bo::BIGINT, (n - ob - oc - bo)::BIGINT FROM s""",
    "a31_valid_points": WITH + "g AS (SELECT period, group_id, max(label) l, max(score) s FROM pred GROUP BY 1, 2), t AS (SELECT period, nextafter(max(CASE WHEN l = 0 THEN s END), 'infinity'::DOUBLE) t FROM g GROUP BY 1), r AS (SELECT g.period, t, count_if(l = 1 AND s >= t)::DOUBLE / greatest(1, count_if(l = 1)) r FROM g JOIN t ON t.period = g.period GROUP BY g.period, t) SELECT period, round(t, 6) threshold, round(r, 6) recall, t <= 0.99::DOUBLE AS valid, t <= 0.99::DOUBLE AND r >= 0.01::DOUBLE eligible FROM r",
    "a35_overhead": WITH + "t AS (SELECT split, avg(latency_ms) a, quantile_cont(latency_ms, 0.5) m, quantile_disc(latency_ms, 0.95) p FROM pred GROUP BY 1) SELECT round(100.0 * (y.a / x.a - 1.0), 6) mean_ms_overhead_percent, round(100.0 * (y.m / x.m - 1.0), 6) median_ms_overhead_percent, round(100.0 * (y.p / x.p - 1.0), 6) p95_ms_overhead_percent FROM t x, t y WHERE x.split = 'train' AND y.split = 'test'",
    "g4_study_problems": _MANIFEST + "m AS (SELECT * FROM manifest WHERE split IS NOT NULL) SELECT 'sample_id is not unique' problem, sample_id AS value FROM m GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'split lacks a label', s || ' ' || y FROM (VALUES ('validation'), ('test')) a(s), (VALUES (0), (1)) b(y) WHERE NOT EXISTS (SELECT 1 FROM m WHERE split = s AND label = y) UNION ALL SELECT 'group crosses labels or splits', group_id FROM m GROUP BY group_id HAVING count(DISTINCT (label, split)) > 1",
    "g4_isolated_rows": _MANIFEST[:-2] + " SELECT split, count(*)::BIGINT n FROM manifest WHERE split IS NOT NULL AND sha256 IS NOT NULL GROUP BY split",
    "e6_study_record": _MANIFEST
    + "m AS (SELECT *, sample_id::BIGINT k FROM manifest WHERE split IS NOT NULL) SELECT 'own' study, 'supported' claim_status, "
    + ", ".join(f"{'count(*)' if u == 'samples' else 'count(DISTINCT group_id)'} FILTER (split = '{x}' AND label = {y})::BIGINT {u}_{x}_{'malicious' if y else 'benign'}" for u in ("samples", "groups") for x in W.SPLITS for y in (0, 1))
    + ", count(*)::BIGINT samples, count(DISTINCT group_id)::BIGINT AS \"groups\", count_if(k % 9 <> 0)::BIGINT ok, count_if(k % 9 = 0)::BIGINT rejected, sum(k % 4)::BIGINT python_files, sum(k % 1000)::BIGINT python_bytes, sum(k % 2)::BIGINT parse_errors, count_if(k % 8 = 0)::BIGINT score_changed, sha256('rows') rows_sha256 FROM m",
    "a39_support_profile": f"WITH {_CONV}, f AS (SELECT conv_id % 10 group_id, min_by(t, conv_id) t FROM c GROUP BY 1) SELECT group_id, array_to_string(list_sort(list_distinct(t)), ',') tokens, (SELECT count(DISTINCT role) FROM conversations)::BIGINT known FROM f",
    "m10_windowed_model": f"WITH {_CONV}, n AS (SELECT *, least(16, greatest(1, ceil((len(t) - 4) / 3.0)::BIGINT + 1)) n FROM c), w AS (SELECT conv_id, t[k * 3 + 1:k * 3 + 4] w FROM (SELECT conv_id, t, unnest(range(0, n)) k FROM n)) SELECT conv_id sample_id, round(max(len(list_filter(w, lambda x: x = 'user'))::DOUBLE / len(w)), 6) probability FROM w GROUP BY 1",
    "e3_verified_rows": _MANIFEST[:-2] + " SELECT split, count(*)::BIGINT n FROM manifest WHERE split IN ('train', 'validation') GROUP BY split",
    # what the two texts of the generated corpus hold: one file in twenty reads a token, encodes and sends it
    "x2_operations": f"WITH {_N}, s AS (SELECT count(*) n, count_if(i % 20 = 0) m FROM c) SELECT 'IMPORT' op, 'context' category, 'import' phase, (n + 2 * m)::BIGINT n, 1::BIGINT functions FROM s UNION ALL SELECT 'FILE_READ', 'source', 'runtime', (n - m)::BIGINT, 1::BIGINT FROM s UNION ALL SELECT 'ENV_READ', 'source', 'runtime', m::BIGINT, m::BIGINT FROM s UNION ALL SELECT 'ENCODE', 'transform', 'runtime', m::BIGINT, m::BIGINT FROM s UNION ALL SELECT 'NETWORK_SEND', 'sink', 'runtime', m::BIGINT, m::BIGINT FROM s",
    "x23_lexical_operations": f"WITH {_N}, s AS (SELECT count(*) n, count_if(i % 20 = 0) m FROM c) SELECT 'IMPORT' op, 'context' category, 'import' phase, 'module import' detail, (n + 2 * m)::BIGINT n, 1::BIGINT functions, 1::BIGINT first_line FROM s UNION ALL SELECT 'FILE_READ', 'source', 'runtime', 'file read', (n - m)::BIGINT, 1::BIGINT, 4::BIGINT FROM s UNION ALL SELECT 'ENV_READ', 'source', 'runtime', 'environment variable access', m::BIGINT, m::BIGINT, 4::BIGINT FROM s UNION ALL SELECT 'ENCODE', 'transform', 'runtime', 'data encoding or compression', m::BIGINT, m::BIGINT, 5::BIGINT FROM s UNION ALL SELECT 'NETWORK_SEND', 'sink', 'runtime', 'outbound data transfer', m::BIGINT, m::BIGINT, 8::BIGINT FROM s",
    "x24_archived_operations": f"WITH {_N}, s AS (SELECT count(*) n, count_if(i % 20 = 0) m, ceil(count(*) / 10.0)::BIGINT a FROM c) SELECT 'IMPORT' op, (n + 2 * m)::BIGINT n, a archives FROM s UNION ALL SELECT 'FILE_READ', (n - m)::BIGINT, a FROM s UNION ALL SELECT unnest(['ENV_READ', 'ENCODE', 'NETWORK_SEND']), m::BIGINT, m::BIGINT FROM s",
    "g10_lexical_summaries": f"WITH {_N} SELECT 'library-callable' entrypoints, CASE WHEN i % 20 = 0 THEN 'environment' ELSE 'local-file' END data_origins, CASE WHEN i % 20 = 0 THEN 'network' ELSE '' END data_destinations, CASE WHEN i % 20 = 0 THEN 'encoding' ELSE '' END transformations, '' flows, count(*)::BIGINT files FROM c GROUP BY ALL",
    "b_lexical_decisions": f"WITH {_N} SELECT DISTINCT 'pkg' || (i // 20) target_id, 26.0::DOUBLE rule_score, 26.0::DOUBLE risk_score, 'review' verdict FROM c",
    "e1_artifact_rows": f"WITH {_N}, a AS (SELECT i // 10 a, count(*) n, count_if(i % 20 = 0) m FROM c GROUP BY 1) SELECT 'a' || a || CASE WHEN a % 7 = 6 THEN '.bin' ELSE '.zip' END target_id, CASE WHEN a % 7 = 6 THEN 'rejected' ELSE 'ok' END status, CASE WHEN a % 7 = 6 THEN 0 ELSE n END::BIGINT python_files, CASE WHEN a % 7 = 6 THEN 0 ELSE 2 * (n - m) + 6 * m END::BIGINT events, CASE WHEN a % 7 = 6 THEN 0 ELSE m END::BIGINT exact_paths, a % 7 <> 6 levelled FROM a",
    "e2_two_variants": f"WITH {_N}, t AS (SELECT i // 20 t, count(*) n FROM c GROUP BY 1) SELECT 'pkg' || t sample_id, sha256('7' || chr(0) || 'scan' || chr(0) || 'pkg' || t) AS rank, sha256('7' || chr(0) || 'order' || chr(0) || 'pkg' || t)[-1] IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') candidate_first, 'ok' status, n::BIGINT python_files, 0::BIGINT parse_errors, 1::BIGINT exact_paths, 26.0::DOUBLE baseline_score, 36.0::DOUBLE candidate_score FROM t",
    "e5_verified_lock": f"WITH {_DOC} SELECT 'input' || doc_id AS name, CASE WHEN doc_id % 8 = 0 THEN 'is missing' WHEN doc_id % 9 = 0 THEN 'was not locked' ELSE 'has changed' END problem FROM doc WHERE NOT (doc_id % 8 = 0 AND doc_id % 9 = 0) AND (doc_id % 8 = 0 OR doc_id % 9 = 0 OR doc_id % 7 = 0)",
    "e8_round_rows": f"""WITH s(r, n, y, a, ta, b, tb) AS (VALUES ('delete', 'wipe-home', 1, 'SYSTEM_DISCOVERY', 'generic', 'FILE_DELETE', 'delete_user_data'), ('delete', 'wipe-cache', 0, 'SYSTEM_DISCOVERY', 'generic', 'FILE_DELETE', 'delete_temporary'), ('process', 'shell-fetched', 1, 'NETWORK_RECEIVE', 'network', 'PROCESS_EXEC', 'process_shell'),
        ('process', 'build-fetched', 0, 'NETWORK_RECEIVE', 'network', 'PROCESS_EXEC', 'process_build_tool'), ('effect', 'autostart', 1, 'FILE_READ', 'file', 'PERSISTENCE_WRITE', 'sensitive'), ('effect', 'copy', 0, 'FILE_READ', 'file', 'FILE_WRITE', 'file')), v(variant, x, z) AS (VALUES ('plain', [], []), ('imports', ['IMPORT', 'IMPORT'], []), ('tail', [], ['FILE_READ', 'IMPORT']))
        SELECT r || '-' || n || '--' || variant sample_id, r || '-' || n group_id, r pair_id, variant, y::INTEGER AS label, 'train' split, array_to_string(list_concat(list_concat(list_transform(x::VARCHAR[], lambda o: 'P:runtime|C:context|O:' || o || '|T:generic'), ['P:runtime|C:context|O:' || a || '|T:' || ta, 'P:runtime|C:context|O:' || b || '|T:' || tb]), list_transform(z::VARCHAR[], lambda o: 'P:runtime|C:context|O:' || o || '|T:generic')), ' ') tokens FROM s, v""",
    "e9_trained_model": "SELECT 6::BIGINT prototypes, 9::BIGINT known, 12::BIGINT pairs, true AS ordered",
    "m5_trained_transformer": "SELECT 'm' AS system, 16::BIGINT examples, 8::BIGINT pairs, 8::BIGINT AS \"groups\", (128 * 16 + 16 * 16 + 2 * 16 + 4 * 16 + 3 * 16 * 16 + 3 * 16 + 16 * 16 + 16 + 2 * (16 * 16 + 16) + 2 * 16 + 2)::BIGINT parameters, true learned, true kept_best",
    "e10_primary_purposes": B.WITH + B._NEAR + f""", al AS (SELECT target_id, path, motif, score, [source, sink] x, 'proximity' k FROM proximity UNION ALL SELECT target_id, path, motif, score, [event_index], 'structural' FROM structural), lb AS (SELECT *, CASE motif {" ".join(f"WHEN '{m}' THEN '{p[0]}'" for m, p in W.PURPOSE_OF_MOTIF.items())} END AS label FROM al),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, path ORDER BY score DESC, x, motif, k) r FROM lb WHERE label IS NOT NULL) WHERE r = 1) SELECT DISTINCT b.target_id, b.path, coalesce(f.label, 'unknown') primary_purpose FROM behavior b LEFT JOIN f ON f.target_id = b.target_id AND f.path = b.path""",
    "m4_prediction_details": f"""WITH {_CONV}, f AS (SELECT conv_id % 10 g, min_by(t, conv_id) t FROM c WHERE conv_id % 2 = 0 GROUP BY 1), k AS (SELECT list(DISTINCT w) w FROM (SELECT unnest(t) w FROM c WHERE conv_id % 2 = 0)),
        n AS (SELECT conv_id, max(len(list_intersect(c.t, f.t))::DOUBLE / len(list_distinct(list_concat(c.t, f.t)))) x FROM c, f GROUP BY 1), v AS (SELECT conv_id, t, len(list_intersect(list_distinct(t), w))::DOUBLE / len(list_distinct(t)) cover FROM c, k)
        SELECT v.conv_id sample_id, least(16, greatest(1, ceil((len(t) - 6) / 5.0)::BIGINT + 1))::BIGINT windows, round(cover, 6) token_coverage, round(x, 6) nearest, cover >= 1 AND x >= 0.6 supported, true probable FROM v JOIN n ON n.conv_id = v.conv_id""",
    "api_pilot_record": f"WITH {_N} SELECT 'pilot' study, 'underpowered-target-fpr' claim_status, count(DISTINCT i // 20)::BIGINT samples, count(DISTINCT i // 20)::BIGINT AS \"groups\", count(DISTINCT i // 20)::BIGINT ok, count(*)::BIGINT python_files, 0::BIGINT parse_errors, count(DISTINCT i // 20)::BIGINT score_changed FROM c",
    "api_scan_fail_on": f"WITH {_N} SELECT DISTINCT 'pkg' || (i // 20) target_id, 'review' verdict, true AS failed FROM c",
    "s18_rendered_reports": f"""WITH {_N}, t AS (SELECT DISTINCT i // 20 t FROM c), e(r, line) AS (VALUES (1, '[36.0] credential_or_file_exfil (summary) src/m#.py:4 x1'), (2, '[15.0] NETWORK_SEND (event) src/m#.py:8 x1'), (3, '[7.0] ENV_READ (event) src/m#.py:4 x1'), (4, '[4.0] ENCODE (event) src/m#.py:5 x1'))
        SELECT 'pkg' || t target_id, 'pkg' || t || ': review, risk 36.0' || chr(10) || string_agg('  ' || replace(line, '#', (20 * t)::VARCHAR), chr(10) ORDER BY r) AS text FROM t, e GROUP BY t""",
    "s1_scan_warnings": f"""WITH {_N}, planned AS ({_planned(1000, 60_000)}) SELECT 'pkg' || (i // 20) target_id, 'parse error' kind, count(*)::BIGINT n FROM c WHERE i % 10 = 3 GROUP BY 1
        UNION ALL SELECT 'folder', CASE state WHEN 'oversized' THEN 'oversized file skipped' WHEN 'unreadable' THEN 'cannot read' ELSE state END, count(*)::BIGINT FROM planned WHERE state <> 'taken' GROUP BY 2""",
    "w3_near_patterns": B.WITH + B._NEAR + " SELECT motif, score, replace(reason, 'exact value flow', 'browser value flow') reason, 'proximity' evidence_kind, 'low' confidence, count(*)::BIGINT n FROM proximity GROUP BY ALL",
    "j6_known_pairs": B.WITH + B._NEAR + " SELECT target_id, path, motif, source, sink FROM proximity WHERE sink - source <> 2",
    "p3_summary_cover": B.WITH + f"""s AS (SELECT target_id, path, function, min(CASE WHEN op = 'FILE_READ' THEN event_index END) a, min(CASE WHEN op = 'NETWORK_SEND' THEN event_index END) b FROM behavior GROUP BY 1, 2, 3), v AS (SELECT * FROM s WHERE a IS NOT NULL AND b IS NOT NULL),
        e AS (SELECT target_id, 'event' kind, op AS name, CASE op {B._WEIGHT} END score FROM behavior x WHERE op IN {B._IN(W.WEIGHTS)} AND NOT EXISTS (SELECT 1 FROM v WHERE v.target_id = x.target_id AND v.path = x.path AND x.event_index IN (v.a, v.b)) UNION ALL SELECT target_id, 'summary', 'file_to_network', 14::DOUBLE FROM v),
        g AS (SELECT target_id, max(score) s FROM e GROUP BY target_id, kind, name), r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY s DESC) k FROM g), l AS (SELECT target_id, score s, row_number() OVER (PARTITION BY target_id ORDER BY score DESC) k FROM e)
        SELECT target_id, 'semantic-top8-v1' AS system, least(100.0::DOUBLE, sum(s)) score FROM r WHERE k <= 8 GROUP BY 1 UNION ALL SELECT target_id, 'legacy-top8', least(100.0::DOUBLE, sum(s)) FROM l WHERE k <= 8 GROUP BY 1""",
}
