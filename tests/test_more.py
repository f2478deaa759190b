import json

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_transformer_forward(spark):
    from brindle.operators import transformer as X

    w = X.random_weights(1, 64, 16, 8, 2, 12)
    ids = np.array([[1, 9, 12, 2, 0, 0, 0, 0], [1, 9, 12, 2, 5, 5, 5, 5]])
    mask = np.array([[1, 1, 1, 1, 0, 0, 0, 0]] * 2, dtype=np.float32)
    z = X.logits(w, ids, mask, 2)
    assert np.allclose(z[0], z[1])  # masked positions change nothing
    assert not np.allclose(z[0], X.logits(w, np.array([[1, 12, 9, 2, 0, 0, 0, 0]]), mask[:1], 2)[0])  # order does
    e = spark.createDataFrame([("a", ["x"] * 40), ("b", []), ("c", ["x"])], "sample_id string, tokens array<string>")
    got = {r.sample_id: r.probability for r in X.predict(e, w, 2).collect()}
    assert set(got) == {"a", "b", "c"} and all(0 < p < 1 for p in got.values())


def test_effect_summary(spark):
    from brindle.operators import effects, patterns
    from brindle.sources import frontend

    files = [
        ("t", "conv.py", b"import ast\ndef run(p, q):\n    with open(p) as f:\n        tree = ast.parse(f.read())\n    ast.walk(tree)\n    with open(q, 'w') as g:\n        g.write(ast.unparse(tree))\nif __name__ == '__main__':\n    run('a', 'b')\n"),
        ("t", "send.py", b"import os, requests\nrequests.post('u', data=os.getenv('API_TOKEN'))\n"), ("t", "empty.py", b""),
    ]
    a = frontend.extract(spark.createDataFrame(files, "target_id string, path string, content binary"))
    e = frontend.events_of(a)
    p = patterns.behavior_paths(e, patterns.exact_paths(frontend.exact_of(a)))
    s = effects.effect_summary(a, e, p)
    got = {r.path: r for r in s.collect()}
    c = got["conv.py"]
    assert c.entrypoints == ["explicit-cli"] and c.flows == ["local-file-to-local-artifact"] and c.transformations == ["code-generation"] and [x.label for x in c.purpose_candidates] == ["local-code-transformer"] and c.purpose_candidates[0].confidence == "high"
    c = got["send.py"]
    assert c.entrypoints == ["import-time-effects"] and c.flows == ["sensitive-data-to-network"] and c.purpose_candidates[0].label == "sensitive-data-transfer"
    assert got["empty.py"].entrypoints == ["module-import"]
    tokens = [r.token for r in effects.effect_tokens(s).filter("path = 'send.py'").orderBy("position").collect()]
    assert tokens == ["EFFECT:ENTRY:import_time_effects", "EFFECT:ORIGIN:environment", "EFFECT:DESTINATION:network", "EFFECT:FLOW:sensitive_data_to_network", "PURPOSE:sensitive_data_transfer|Q:high"]


def test_canonical_tokens(spark):
    from brindle.functions.canonical import canonical_tokens

    rows = [("a", ["FILE", "P:import|C:sink|O:PROCESS_EXEC|T:bash", "P:import|C:sink|O:PROCESS_EXEC|T:sh", "MOTIF:download-execute", "EFFECT:ENTRY:install-time", "PURPOSE:local code transformer", "other", "other"]), ("b", [])]
    got = {r.sample_id: r.tokens for r in canonical_tokens(spark.createDataFrame(rows, "sample_id string, tokens array<string>")).collect()}
    assert got["a"] == [
        "FILE", "P:import|C:sink|O:PROCESS_EXEC|T:process_shell", "PATH:download_execute|K:dataflow|Q:high", "other", "EFFECT:ENTRY:import_time_effects", "EFFECT:DESTINATION:process", "EFFECT:FLOW:network_to_execution",
        "PURPOSE:local_code_transformer|Q:medium", "PURPOSE:remote_code_executor|Q:high",
    ]
    assert got["b"] == ["FILE", "EFFECT:ENTRY:library_callable"]


def test_fingerprint_ignores_order(spark):
    from brindle.functions.fingerprint import fingerprint

    d = spark.createDataFrame([(i, i / 7, f"x{i}") for i in range(50)], "a long, b double, c string")
    one = fingerprint(d, ["a", "b", "c"]).first()[0]
    assert one == fingerprint(d.orderBy(F.desc("a")).repartition(3), ["a", "b", "c"]).first()[0] != fingerprint(d.filter("a > 0"), ["a", "b", "c"]).first()[0]


def test_api(spark):
    from brindle import api

    files = [("bad", "m.py", b"import os, requests\nrequests.post('u', data=os.getenv('API_TOKEN'))\n"), ("good", "m.py", b"x = 1\n")]
    src = spark.createDataFrame(files, "target_id string, path string, content binary")
    assert {r.target_id: r.failed for r in api.scan(src, "suspicious").collect()} == {"bad": True, "good": False}
    assert api.extract(src).count() == 4
    labels = spark.createDataFrame([("bad", 1, "test", "g1"), ("good", 0, "test", "g2")], "target_id string, label int, split string, group_id string")
    rows, audits = api.two_variants(src, labels, 3)
    v = {(r.sample_id, r.system): r.score for r in rows.collect()}
    assert v[("bad", "flow_on")] > v[("bad", "flow_off")] and len(v) == 4
    a = {r.sample_id: r for r in audits.collect()}
    assert a["bad"].exact_paths == 1 and a["good"].baseline_score == 0.0 and {r.status for r in a.values()} == {"ok"}
    with pytest.raises(Exception, match="sealed"):
        api.sealed(spark.createDataFrame([("test",)], "split string")).collect()
    rows = spark.createDataFrame([("a", "h")], "sample_id string, sha string")
    assert api.verified(rows, rows, ["sha"]).count() == 1
    with pytest.raises(Exception, match="fingerprints differ"):
        api.verified(rows, rows.withColumn("sha", F.lit("z")), ["sha"]).collect()


def test_support_and_models(spark):
    from brindle.operators import models, support

    e = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "q"]), ("c", [])], "sample_id string, tokens array<string>")
    known, protos = support.profile(spark.createDataFrame([("g", 0, ["x", "y", "z"]), ("g", 1, ["w"])], "group_id string, ord int, tokens array<string>"))
    got = {r.sample_id: (round(r.token_coverage, 3), round(r.nearest, 3), r.unknown_tokens, r.supported) for r in support.assess(e, known, protos).collect()}
    assert got == {"a": (1.0, 0.667, [], True), "b": (0.5, 0.25, ["q"], False), "c": (0.0, 0.0, [], False)}
    rows = [("m", i, ["bad", "thing"] if i % 2 else ["good", "thing"], i % 2) for i in range(40)]
    t = spark.createDataFrame(rows, "system string, ord int, tokens array<string>, label int")
    w = models.train(t, 5, dimensions=512).drop("system")
    bias = w.filter("index = -1").first().weight
    p = {r.sample_id: r.probability for r in models.predict(spark.createDataFrame([("p", ["bad", "thing"]), ("n", ["good", "thing"])], "sample_id string, tokens array<string>"), w.filter("index >= 0"), bias, 512).collect()}
    assert p["p"] > 0.6 > 0.4 > p["n"]


def test_llm_is_optional(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['brindle.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    # and with the folders really gone
    shutil.copytree(root, tmp_path / "repo", ignore=lambda at, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")])
    without = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", without], cwd=tmp_path / "repo", check=True)


def test_training_rows_are_isolated_and_paired(spark):
    from brindle.operators import governance, support
    from brindle.sources.generators import SCENARIOS, VARIANTS, training_rows

    rows = training_rows(spark)
    assert rows.count() == len(SCENARIOS) * len(VARIANTS)
    assert governance.split_isolation(rows.withColumn("representation_hash", F.array_join("tokens", ","))).count() == 0
    p = support.pair_metrics(rows.withColumn("score", F.col("label") * 0.5 + 0.2)).first()
    assert p.pairs == len(SCENARIOS) // 2 * len(VARIANTS) and p.pair_order_accuracy == 1.0
