import json

import numpy as np
import pytest
from pyspark.sql import functions as F


def parts(r, n=6, length=7):
    ids = r.integers(4, 20, (n, length))
    mask = np.ones((n, length))
    mask[0, 4:] = 0
    return ids, mask, np.array([0, 1] * (n // 2))


@pytest.mark.parametrize("kind", ["classes", "words", "structure"])
def test_gradients_are_those_of_small_steps(kind):
    from brindle.operators import micro_training as M

    r = np.random.default_rng(1)
    net = M.Network(20, 7, 8, 2, 12, 2, 3)
    for w in net.w.values():
        w.v = w.v + 0.3 * r.standard_normal(w.v.shape)
    ids, mask, labels = parts(r)
    targets = np.where(r.random(ids.shape) < 0.4, ids, -1)

    def loss():
        tape = M.Tape()
        if kind == "words":
            return M.language_loss(net.words(tape, ids, mask), targets, 0.7), tape
        out = net.classes(tape, ids, mask)
        if kind == "classes":
            return M.class_loss(out, labels, 0.1, 2.0), tape
        return M.structured_loss(out, [(0, 1), (2, 3)], [[0, 2, 4], [1, 3]], 5.0, 0.4, 0.3), tape

    _, tape = loss()
    tape.back()
    for name, w in net.w.items():
        if w.g is None:
            continue
        g = w.g
        for at in [tuple(r.integers(0, s) for s in w.v.shape) for _ in range(4)]:
            was, h = w.v[at], 1e-5
            w.v[at] = was + h
            up = loss()[0]
            w.v[at] = was - h
            down = loss()[0]
            w.v[at] = was
            assert abs((up - down) / (2 * h) - g[at]) < 2e-5 + 1e-3 * abs(g[at]), (name, at)


def test_training_learns_stops_and_exports(spark):
    from brindle.operators import transformer
    from brindle.operators.micro_training import train_micro
    from brindle.sources import checkpoints
    from brindle.sources.generators import training_rows

    rows = training_rows(spark).withColumn("system", F.lit("m")).withColumn("split", F.when(F.col("variant") == "tail", "validation").otherwise("train"))
    got = train_micro(rows, vocabulary=128, length=16, d=16, layers=1, ffn=16, heads=2, epochs=150, rate=1e-2, patience=150).first()
    a = json.loads(got.account)
    assert a["training_accuracy"] == 1.0 and a["losses"][-1] < 0.7 * a["losses"][0] and 1 <= a["best_epoch"] <= a["epochs_completed"] and a["temperature"] >= 1
    assert a["pairs"] == 8 and a["groups"] == 8
    weights = checkpoints.imported(bytes(got.data), json.loads(got.manifest))
    p = transformer.predict(rows.filter("split = 'train'"), weights, heads=2).join(rows.select("sample_id", "label"), "sample_id").collect()
    assert all((x.probability > 0.5) == (x.label == 1) for x in p)
    short = json.loads(train_micro(rows, vocabulary=128, length=16, d=8, layers=1, ffn=8, heads=2, epochs=40, rate=0.2, patience=1, least_epochs=2).first().account)
    assert short["early_stopped"] and short["epochs_completed"] < 40
    with pytest.raises(Exception, match="both labels"):
        train_micro(rows.filter("label = 1"), vocabulary=64, length=16, d=8, layers=1, ffn=8, heads=2, epochs=1).collect()
