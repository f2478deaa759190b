import hashlib
import random
import re

import numpy as np


def test_base_spans_follow_the_patterns():
    from brindle.llm.secret_scan import base_spans, written

    r = random.Random(1)
    parts = ["token", "TOKEN", "api_key", "secret", ":", "=", " ", '"', "a", "AKIA", "A1B2", "0123456789abcdef", "ſecret", "é", "\n", "-", "passwd", "zz9"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        want = []
        pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        want += [("assign", m.start(), m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert written(base_spans(text)) == written(want), text


def test_models_tell_random_from_ordinary_strings_held_out():
    from brindle.llm.secret_scan import LikelihoodRatio, ordinary_strings, random_strings

    words = "the of and table window customer order price stream token value index reader writer compress thinking".split()
    model = LikelihoodRatio([(s, 1) for s in random_strings(4000)] + [(s, 0) for s in ordinary_strings(words, 4000)])
    fresh = [s for s in random_strings(1000, seed=5) if len(s) >= 20]
    plain = [s for s in ordinary_strings(words, 1000, seed=6) if len(s) >= 20]
    assert sum(map(model.is_secret, fresh)) > 0.9 * len(fresh)
    assert sum(map(model.is_secret, plain)) < 0.01 * len(plain)


def test_scan_and_redact(spark):
    from brindle.llm.secret_scan import redact, scan

    key = "q7Zp2LmX9vRt4KdW8sYb1NcH6jFg"
    rows = [(1, f"see {key} here"), (2, None), (3, ""), (4, 'token = "abcdef" x'), (4, "plain words only " * 3000), (None, "AKIA" + "A" * 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.spans) for r in scan(docs).collect()}
    assert (1, f"markov:4:{4 + len(key)}") in got and (2, "") in got and (3, "") in got and (4, "assign:0:15") in got and (None, "access:0:20") in got
    hidden = {r.text for r in redact(docs).collect()}
    assert "see [secret] here" in hidden and None in hidden
    empty = next(r for r in scan(docs).collect() if r.doc_id == 3)
    assert empty.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert scan(docs.filter("false")).count() == 0


def brute(rows, cosine):
    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            (a, u, p), (b, v, q) = rows[i], rows[j]
            if a is None or b is None or p is None or p != q or not ok(u) or not ok(v) or len(u) != len(v):
                continue
            x, y = np.array(u), np.array(v)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                s, t = find(i), find(j)
                root[s] = t
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return [(rows[i][0], links[i], least.get(find(i)) if rows[i][0] is not None else None) for i in range(n)]


def test_near_duplicates_equal_brute_force(spark):
    from brindle.llm import subspace_join as J

    r = np.random.default_rng(4)
    rows = []
    centres = r.standard_normal((12, 16))
    for i in range(160):
        c = centres[r.integers(12)]
        v = (c + r.choice([0, 0.05, 0.1, 0.2]) * r.standard_normal(16)).astype(np.float32).tolist()
        rows.append((int(i), v, int(r.integers(3))))
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [None] * 16, 1), (205, rows[0][1], None), (206, rows[0][1], rows[0][2]), (206, rows[0][1], rows[0][2]), (None, rows[0][1], rows[0][2]), (207, [1.0, 2.0], 1), (208, [1.0, 2.01], 1), (209, [float("inf")] * 16, 1), (210, [1e-30] * 16, 1), (211, [1e30] * 16, 1)]
    frame = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<float>, label int, rep string")
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], p) for k, v, p in rows]
    was = J.TILE, J.CROWD
    try:
        for J.TILE, J.CROWD, width in ((2048, 8192, 16), (7, 8192, 4), (7, 3, 4), (2048, 8192, 5)):
            got = sorted(((x.vec_id, x.n_links, x.component_id) for x in J.near_duplicates(frame, width=width).collect()), key=repr)
            assert got == sorted(brute(rows, 0.98), key=repr)
    finally:
        J.TILE, J.CROWD = was
    assert J.near_duplicates(frame.filter("false")).count() == 0


def test_keys_are_found_inside_runs_of_words():
    from brindle.llm.secret_scan import LikelihoodRatio, base_spans, markov_spans, ordinary_strings, random_strings

    words = "the of and table window customer order price stream token value index reader writer compress thinking".split()
    model = LikelihoodRatio([(s, 1) for s in random_strings(4000)] + [(s, 0) for s in ordinary_strings(words, 4000)])
    r = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    keys = ["".join(r.choices(letters + "0123456789", k=32)) for _ in range(200)]

    def found(before, key, after=""):
        text = before + key + after
        a, b = len(before), len(before) + len(key)
        return any(min(b, y) - max(a, x) > 0.8 * len(key) and y - x < 1.5 * len(key) for _, x, y in markov_spans(text, base_spans(text), model))

    path = "window/customer/order/price/stream/index/"
    assert sum(found(path, k, "/reader/table/value") for k in keys) > 180
    assert sum(found("price=", k[:16]) for k in keys) > 150
    assert sum(found("", "".join(r.choices(letters, k=32))) for _ in range(200)) > 180  # letters only
    assert sum(found("0123456789abcdef" * 2 + "/", k) for k in keys) > 180  # the rest of a run that a fixed pattern touches
    assert not markov_spans(path * 20 + "1999-2024-06-11-12-30-45-678", [], model)


def test_held_out_precision_and_recall_by_alphabet():
    from brindle.llm.secret_scan import ALPHABET, LikelihoodRatio, base_spans, markov_spans, ordinary_strings, random_strings

    words = "the of and table window customer order price stream token value index reader writer compress thinking".split()
    model = LikelihoodRatio([(s, 1) for s in random_strings(8000)] + [(s, 0) for s in ordinary_strings(words, 8000)])
    r = random.Random(31)
    alphabets = {"letters and digits": ALPHABET[:62], "letters": ALPHABET[:52], "base64": ALPHABET[:64], "base32": ALPHABET[:26] + "234567", "upper hex": "0123456789ABCDEF"}
    caught = lambda s: bool(markov_spans(s, base_spans(s), model) or base_spans(s))
    for name, letters in alphabets.items():
        for n, least in ((20, 0.6), (32, 0.85), (48, 0.9)):
            keys = ["".join(r.choices(letters, k=n)) for _ in range(150)]
            assert sum(map(caught, keys)) >= least * len(keys), (name, n, sum(map(caught, keys)))
    plain = [s for s in ordinary_strings(words, 3000, seed=77) if len(s) >= 16]
    assert sum(bool(markov_spans(s, base_spans(s), model)) for s in plain) <= 0.005 * len(plain)


def test_scan_of_extra_columns_and_training_without_text_on_the_driver(spark):
    from brindle.llm.secret_scan import scan, train

    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} other{chr(98 + i % 20)}", 1, "s") for i in range(50)], "doc_id long, text string, n_hex long, spans string")
    assert scan(docs).columns == ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"] and scan(docs).count() == 50
    assert train(docs.filter("false")).value("plain") is not None
