import math
import random
import re
import zlib
from collections import Counter

import numpy as np


def brute(rows):
    toks = {}
    for k, t, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        toks[k] = re.findall(r"[^\x20\x09-\x0D]+", low) + [None]
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in toks}
    c = Counter(w for k, ws in toks.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return {k: (held[k], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for k, ws in toks.items()}


def test_scores(spark):
    from brindle.llm import bloom_lm as B

    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(500)]
    sentences = [[r.choice(vocabulary) for _ in range(12)] for _ in range(40)]
    rows = [(i, " ".join(" ".join(r.choice(sentences)) for _ in range(r.randint(0, 12))), "x") for i in range(300)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "Zz zz ZZ neverseen", "x"), (1003, " ".join(vocabulary * 40), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    want = brute(rows)
    was = B.FREQUENT
    try:
        for B.FREQUENT in (100_000, 20):
            got = B.score_corpus(docs.repartition(5)).collect()
            assert len(got) == len(rows)
            for x in got:
                h, n, known, total, base = want[x.doc_id]
                assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (h, n, known, total)
                assert abs(x.base_score - base) < 1e-9 * max(1, abs(base))
    finally:
        B.FREQUENT = was
    held = [x for x in got if x.held_out and x.n_tokens > 5]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)  # pairs help on held-out text
    assert all(x.score < 0 for x in got)
    assert B.score_corpus(docs.filter("false")).count() == 0


def test_filter_never_falls_below_a_level():
    from brindle.llm import bloom_lm as B
    from brindle.llm import words

    r = np.random.default_rng(1)
    key = words.mix(np.arange(5000, dtype=np.uint64))
    count = (1 / r.random(5000)).astype(np.int64)
    got = B.LogFrequencyFilter.of(key, count).counts(key)
    assert (got >= B.VALUE[B.level(count)]).all()
    assert (got <= count).mean() > 0.98
    absent = B.LogFrequencyFilter.of(key, count).counts(words.mix(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64)))
    assert (absent > 0).mean() < 0.01
    assert (B.LogFrequencyFilter.of(key[:0], count[:0]).counts(key) == 0).all()


def pair_model(rows, mu):
    """Scores by counts of all pairs, quantised as the filter holds them."""
    from brindle.llm import bloom_lm as B

    toks = {k: (t or "").split() + [None] for k, t in rows}
    train = [k for k in toks if zlib.crc32(str(k).encode()) % 7 != 2]
    c = Counter(w for k in train for w in toks[k])
    both = Counter(p for k in train for p in zip(["<"] + toks[k], toks[k]))
    size = sum(c.values()) + len(c) + 1
    c["<"] = len(train)
    held = {p: B.VALUE[B.level(np.array([n]))][0] for p, n in both.items()}
    return {k: [sum(math.log10((held_.get((v, w), 0) + mu * (c[w] + 1) / size) / (c[v] + mu)) for v, w in zip(["<"] + ws, ws)) for held_ in (held, both)] for k, ws in toks.items()}


def corpus():
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    phrases = [[r.choice(vocabulary) for _ in range(8)] for _ in range(60)]
    rows = [(i, " ".join(" ".join(r.choice(phrases)) for _ in range(r.randint(0, 10)))) for i in range(200)]
    return rows + [(900, None), (901, "never seen"), (902, " ".join(vocabulary * 3)), (903, "rare pair " * 20_000)]


def test_scores_by_brute_force(spark, monkeypatch):
    from brindle.llm import bloom_lm as B

    rows = corpus()
    want = pair_model(rows, B.MU)
    monkeypatch.setattr(B, "BITS_PER_ITEM", 48)  # no false counts
    for frequent in (100_000, 50, 1):
        monkeypatch.setattr(B, "FREQUENT", frequent)
        got = {x.doc_id: x.score for x in B.score_corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        for k, (quantised, exact) in want.items():
            slack = 0.02 * len((rows_text := dict(rows)[k] or "").split()) + 1e-3  # frequent words' counts travel in steps
            assert min(quantised, exact) - slack <= got[k] <= max(quantised, exact) + slack, (k, rows_text[:40])


def test_no_score_above_zero_and_the_same_at_every_partitioning(spark, monkeypatch):
    from brindle.llm import bloom_lm as B

    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = [{x.doc_id: x for x in B.score_corpus(docs.repartition(n)).collect()} for n in (1, 7)]
    for k, x in got[0].items():
        assert x.score <= 0 and abs(x.score - got[1][k].score) < 0.01 and abs(x.base_score - got[1][k].base_score) < 1e-6
    monkeypatch.setattr(B, "FLUSH", 50)  # many flushes give the same
    many = {x.doc_id: x for x in B.score_corpus(docs.repartition(3)).collect()}
    assert all(abs(x.score - many[k].score) < 0.01 and x.n_known == many[k].n_known for k, x in got[0].items())


def test_null_and_repeated_keys_and_empty_table(spark):
    from brindle.llm import bloom_lm as B

    rows = [(None, "a b c", 1), (None, "a b c", 1), (5, "a b", 2), (5, "a b", 2), (6, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = B.score_corpus(docs).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_tokens) for x in got) == [(False, 5, 3), (False, 5, 3), (False, 6, 1), (True, 0, 4), (True, 0, 4)]
    assert len({x.score for x in got if x.doc_id == 5}) == 1
    assert B.score_corpus(docs.filter("false")).collect() == []
