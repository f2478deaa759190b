import hashlib
import re

import pytest

pytest.importorskip("public_tokenizers")
from test_text_operators import WORD, brute_measures, brute_removed, corpus, lowered  # noqa: E402


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    from brindle.llm import quality_ledger as L

    rows = [(a, None if b is None else b + (" mail x.1@mail2.example.com" if a % 6 == 0 and b else ""), "en", f"s{a % 3}", len(b or "")) for a, b, *_ in corpus(21, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(P.STAGES)
    ledger = {r.doc_id: r.fail_bits for r in L.ledger(docs).collect()}
    kept = stages["quality_rules"](spark, docs, "")
    want = {r[0]: r for r in rows if not ledger[r[0]]}
    assert kept.columns == docs.columns and {r.doc_id: tuple(r) for r in kept.collect()} == want
    assert all(brute_measures(r[1])[0] >= 10 for r in want.values())

    one = stages["near_duplicates"](spark, kept, "")
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, WORD.findall(lowered(r[1]))) for k, r in want.items())}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {k: r for k, r in want.items() if find(k) == k}
    assert {r.doc_id: tuple(r) for r in one.collect()} == want and one.columns == docs.columns

    cut = stages["repeated_passages"](spark, one, "").collect()
    removed = brute_removed(list(want.values()))
    assert {r.doc_id for r in cut} == set(want)
    for r in cut:
        assert hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() == removed[r.doc_id][2] and r.n_chars == len(r.text)

    cut = spark.createDataFrame(cut, docs.schema)
    clean = stages["private_data"](spark, cut, "")
    assert clean.columns == docs.columns
    before = {r.doc_id: r.text for r in cut.collect()}
    for r in clean.collect():
        assert "mail2.example.com" not in r.text and re.sub(r"\S+@\S+", "@", r.text) == re.sub(r"\S+@\S+", "@", before[r.doc_id])

    pieces = P.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(want)
    for k in want:
        mine = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == k)
        assert mine[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:])) and mine[-1][0] + mine[-1][1] == mine[0][2]


def test_stages_of_nulls_nothing_and_clashing_names(spark, tmp_path):
    import corpus_pipeline as P

    text = " ".join(f"plain{i} word{i * 7}" for i in range(30))
    more = " ".join(f"other{i} thing{i * 5}" for i in range(30)) + " mail a.b@mail.example.com"
    rows = [(1, text, "en", "s", 5, 7, "k", 1), (2, text, "en", "s", 5, 7, "k", 1), (2, more, "en", "s", 5, 7, "k", 1), (None, more + " x", "en", None, 5, 7, "k", 1), (4, None, None, "s", None, None, None, None), (5, "", "en", "s", 0, 0, "", 0)]
    names = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept_sha256 string, n_replaced int"
    docs = spark.createDataFrame(rows, names)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all((r.n_words, r.kept_sha256, r.n_replaced) in {(7, "k", 1), (None, None, None), (0, "", 0)} for r in got), name
        assert stage(spark, docs.filter("false"), "").count() == 0, name
    assert sorted(str(r.doc_id) for r in P.quality_rules(spark, docs, "").collect()) == ["1", "2", "2", "None"]
    assert sorted(str(r.doc_id) for r in P.near_duplicates(spark, docs.filter("doc_id <> 2 or text = '" + text + "'"), "").collect()) == ["1", "4", "5"]
    assert len(P.private_data(spark, docs, "").filter("text like '%mail.example.com%'").collect()) == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() > 0
    docs.filter("false").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
