import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, bits int"


def corpus(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß日") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    texts = []
    for i in range(n):
        t = " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 4, 5, 12, 60, 300])))
        if texts and r.random() < 0.4:
            t = r.choice(texts)
            if t and r.random() < 0.7:
                w = t.split(" ")
                for _ in range(r.randint(1, 3)):
                    w[r.randrange(len(w))] = r.choice(vocabulary)
                t = " ".join(w)
        if t and r.random() < 0.3:
            t += r.choice(["\n", " ", "\t\r\n", "\x0b"]) + passage + "\n" + r.choice(vocabulary).upper()
        texts.append(t)
    texts += [None, "", "  \n ", "one", "One", passage, passage + " " + passage, "x\n" * 30, " ".join(["long"] * 30_000), "A b   c"]
    rows = [(i * 3, t, "en", "s", len(t or ""), "z", i) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_jaccard_join_equals_brute_force(spark):
    from brindle.llm.jaccard_join import jaccard_join

    rows = corpus() + [(1, corpus()[5][1], None, None, None, None, None)]
    sets = {}
    for r in rows:
        w = WORD.findall(lowered(r[1]))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    members, links = jaccard_join(frame(spark, rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()}
    assert got == {k: (len(s), find(k)) for k, s in sets.items()}
    check_links(members, links, sets, rows)


def check_links(members, links, sets, rows):
    """Every link between different sets, and the number of links of each row."""
    from brindle.llm.jaccard_join import link_counts

    linked = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    own = {k: min(j for j in sets if sets[j] == s) if s else k for k, s in sets.items()}
    assert {(r.doc_id, r.class_id) for r in members.collect()} == set(own.items())
    reps = sorted(set(own.values()))
    assert sorted(tuple(r) for r in links.collect()) == [(a, b) for a in reps for b in reps if a < b and linked(a, b)]
    ids = [r[0] for r in rows]
    want = sorted((k, sum(linked(k, j) for j in ids) - bool(sets[k])) for k in ids)
    assert sorted((r.doc_id, r.n_links) for r in link_counts(members, links).collect()) == want


def test_jaccard_join_of_a_dense_cell(spark):
    from brindle.llm import jaccard_join as J

    r = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "", "", 0, "", 0))
    sets = {x[0]: {tuple(x[1].split()[k : k + 5]) for k in range(56)} for x in rows}
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
    was = J.HEAVY, J.TILE
    J.HEAVY, J.TILE = 8, 16  # as in larger flushes and cells
    try:
        members, links = J.jaccard_join(frame(spark, rows))
        assert {x.doc_id: x.component_id for x in members.collect()} == {k: find(k) for k in sets}
        check_links(members, links, sets, rows)
    finally:
        J.HEAVY, J.TILE = was


def test_components_of_chains_stars_and_loops(spark, monkeypatch):
    from brindle.llm import components as C

    r = random.Random(6)
    order = r.sample(range(3000), 3000)
    edges = [(a, b) for a, b in zip(order[:400], order[1:400])] + [(order[500], x) for x in order[501:900]] + [(order[900 + i], order[900 + i // 2]) for i in range(1, 500)]
    edges += [(7, 7), (None, 3), (3, None)] + r.choices(edges, k=50)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    frame_ = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for roots in (500_000, 40):
        monkeypatch.setattr(C, "ROOTS", roots)
        assert {x.node: x.component for x in C.connected_components(frame_).collect()} == {k: find(k) for k in list(root)}
    assert C.connected_components(frame_.filter("false")).count() == 0


def test_jaccard_join_of_nothing(spark):
    from brindle.llm.jaccard_join import jaccard_join

    out, links = jaccard_join(frame(spark, [(None, "a b", None, None, None, None, None)]))
    assert out.count() == 0 and links.count() == 0


def brute_removed(rows, width=20):
    seen, out = {}, {}
    words = {r[0]: WORD.findall(r[1] or "") for r in rows}
    for k, w in words.items():
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            seen[key] = min(seen.get(key, (k, i)), (k, i))
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] < (k, i):
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_self_dedup_equals_brute_force(spark):
    from brindle.llm.substring_dedup import self_dedup

    rows = corpus(5, 80)
    got = self_dedup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_removed(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.lang == "en" and (r.text == texts[r.doc_id] if not r.n_removed else hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() == r.kept_sha256)
    plain = self_dedup(frame(spark, rows + [(None, rows[-1][1], None, None, None, None, None)] * 2), with_text=False)
    assert plain.count() == len(rows) + 2
    assert self_dedup(frame(spark, rows).filter("false")).count() == 0


def test_reference_spans(spark):
    from brindle.llm.substring_dedup import SuffixAutomaton, remove_reference_spans

    a = SuffixAutomaton(["a b c d".split(), "c x".split()])
    assert a.matching_statistics("b c x a b c d d c".split()) == [1, 2, 2, 1, 2, 3, 4, 1, 1]
    docs = spark.createDataFrame([(1, "q a b c d r"), (2, None), (3, "a b")], "doc_id long, text string")
    reference = spark.createDataFrame([("a b c d",), (None,)], "text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in remove_reference_spans(docs, reference, 3).collect()}
    assert got == {1: ("q r", 4), 2: (None, 0), 3: ("a b", 0)}


def brute_measures(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(again))


def test_ledger_equals_brute_force(spark):
    from brindle.llm import quality_ledger as L

    rows = corpus(9, 50)
    got = L.ledger(frame(spark, rows))
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures({x[0]: x[1] for x in rows}[r.doc_id]), r
    bits = [r.fail_bits for r in got.collect()]
    for r in L.ablation(got).collect():
        b = L.BIT[r.rule]
        assert (r.failed, r.failed_alone, r.total) == (sum(x & b > 0 for x in bits), sum(x == b for x in bits), len(bits))
    kept = L.quality_filter(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(x & L.mask(L.POLICY) == 0 for x in bits)
    assert L.quality_filter(frame(spark, rows), "web-1").count() == sum(x & L.mask("web-1") == 0 for x in bits)  # versions stay


def test_long_texts_do_not_fail_by_length(spark):
    from brindle.llm import quality_ledger as L

    r = random.Random(3)
    vocabulary = [f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{i}" for i in range(6000)]
    long = " ".join(vocabulary[min(int(r.paretovariate(0.9)), 5999)] for _ in range(60_000))
    poor = " ".join(vocabulary[r.randrange(30)] for _ in range(3000))
    docs = spark.createDataFrame([(1, long), (2, poor)], "doc_id long, text string")
    bits = {x.doc_id: x.fail_bits for x in L.ledger(docs).collect()}
    assert bits[1] & L.BIT["few_distinct_words"] and not bits[1] & L.BIT["few_words_for_length"] and bits[2] & L.BIT["few_words_for_length"]


def test_packing_is_a_partition_of_all_ids(spark):
    from tokenizers import Tokenizer

    from brindle.llm.packing import pack_documents

    rows = corpus(11, 70) + [(None, "no key", None, None, None, None, None)]
    special = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y\n<|endoftext|> ", "<|endoftext", " <|endoftext|>\n\n z"]
    rows += [(10_000 + i, t, None, None, None, None, None) for i, t in enumerate(special)]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows}
    got = pack_documents(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    at, places = Counter(), {}
    for p in sorted(got, key=lambda p: (p.doc_id is None, p.doc_id or 0, p.start)):
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        at[p.doc_id] += p.length
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert at == {k: len(v) for k, v in ids.items()}
    for parts in places.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048 and end & (end - 1) == 0  # full, or a power of two: no padding


def test_agenda_equals_the_library(spark):
    import sentencepiece

    from brindle.llm.sp_agenda import Agenda, encode_decode

    model = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    r = random.Random(2)
    odd = ["".join(r.choice(["a", "th", " ", "  ", "\n", "é", "▁", "日", "\t", "<s>", "\x00", "😀", " ", "1"]) for _ in range(r.randint(0, 12))) for _ in range(300)]
    rows = corpus(13, 30) + [(10_000 + i, t, "", "", 0, "", 0) for i, t in enumerate(odd)]
    want = {x[0]: (lib.encode(x[1] or ""), lib.decode(lib.encode(x[1] or ""))) for x in rows}
    got = {x.doc_id: (x.ids, x.decoded) for x in encode_decode(frame(spark, rows), model).collect()}
    for k in want:
        assert got[k] == want[k], (k, got[k], want[k])
    # the agenda by itself, without the library's word
    agenda = Agenda(model)
    for text in [x[1] or "" for x in rows]:
        assert not text or [i for p in agenda.parts(text) for i in agenda.merge(p.replace(" ", "▁"))] == lib.encode(text)
    list(agenda.batch([x[1] for x in rows]))
    assert agenda.differing == 0


def test_the_library_decides_where_the_agenda_errs(monkeypatch):
    from brindle.llm.sp_agenda import Agenda

    agenda = Agenda(public_tokenizers.path("piece_bpe_32k.model"))
    right = [x[:2] for x in agenda.batch(["some words here"])]
    agenda.cache.clear()
    monkeypatch.setattr(agenda, "merge", lambda part: [0])
    assert [x[:2] for x in agenda.batch(["some words here"])] == right and agenda.differing > 0


def test_packing_of_nothing_and_of_repeated_keys(spark):
    from brindle.llm.packing import pack_documents

    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(1, "one two", 5), (1, "one two", 6), (None, None, 7), (2, "", 8)], "doc_id long, text string, length long").coalesce(1)
    assert pack_documents(docs.filter("false"), *files).count() == 0
    got = pack_documents(docs, *files).collect()
    assert sum(p.length for p in got) == 2 * 3 + 2 and [p.doc_id for p in got].count(1) >= 2 and {p.doc_tokens for p in got} == {3, 1}


def test_packing_places_best_fit():
    """Against a plain reading of the rule: least room left, the window opened first of equals."""
    from brindle.llm.packing import Packer

    r = random.Random(2)
    for _ in range(50):
        lengths = [r.randint(1, 40) for _ in range(60)]
        packer, done = Packer(16, 3), []
        for i, n in enumerate(lengths):
            done += list(packer.take(i, b"abcd" * n))
        windows, full = [], []
        for i, n in enumerate(lengths):
            at = 0
            while at < n:
                room = [w for w in windows if sum(p[2] for p in w) + n - at <= 16]
                if room:
                    w = min(room, key=lambda w: 16 - sum(p[2] for p in w))
                elif len(windows) < 3:
                    w = []
                    windows.append(w)
                else:
                    w = min(windows, key=lambda w: 16 - sum(p[2] for p in w))
                used = sum(p[2] for p in w)
                m = min(n - at, 16 - used)
                w.append((i, at, m, used))
                at += m
                if used + m == 16:
                    windows = [x for x in windows if x is not w]
                    full.append(w)
        assert [[p[:4] for p in w.pieces] for w in done] == full


def test_agenda_without_rows_or_keys(spark):
    from brindle.llm.sp_agenda import encode_decode

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2), (3, None, 3)], "doc_id long, text string, n_tokens long")
    got = encode_decode(docs, model).collect()
    assert sorted((x.doc_id is None, x.n_tokens > 0, x.decoded) for x in got) == [(False, False, ""), (True, True, "a b"), (True, True, "a b")]
    assert encode_decode(docs.filter("false"), model).count() == 0


def test_ledger_of_nothing_and_of_clashing_names(spark):
    from brindle.llm import quality_ledger as L

    docs = spark.createDataFrame([(None, "a b c " * 9, 3), (1, None, 4), (1, None, 4)], "doc_id long, text string, n_words long")
    got = sorted((x.doc_id is None, x.n_words) for x in L.ledger(docs).collect())
    assert got == [(False, 0), (False, 0), (True, 27)] and L.ledger(docs.filter("false")).count() == 0
    assert L.quality_filter(docs).columns == docs.columns


def test_jaccard_join_of_repeated_keys(spark):
    from brindle.llm.jaccard_join import jaccard_join

    docs = spark.createDataFrame([(4, "a b c d e f g", "x"), (4, "a b c d e f g", "y"), (9, "A b c d e f g", "z"), (None, "a b c d e f g", "z")], "doc_id long, text string, component_id string")
    assert sorted(tuple(x) for x in jaccard_join(docs)[0].collect()) == [(4, 3, 4, 4), (4, 3, 4, 4), (9, 3, 4, 4)]


def test_spans_beside_columns_of_the_same_names(spark):
    from brindle.llm.substring_dedup import remove_reference_spans, self_dedup

    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text, 4, "a"), (2, "x " + text, 5, "b"), (2, None, 6, None)], "doc_id long, text string, n_removed long, found string")
    out = self_dedup(docs)
    assert sorted((r.doc_id, r.n_removed, r.n_removed_now) for r in out.collect()) == [(1, 4, 0), (2, 5, 25), (2, 6, 0)]
    out = remove_reference_spans(docs, docs.filter("doc_id = 1"))
    assert out.columns == [*docs.columns, "n_removed_now"] and sorted((r.n_removed, r.n_removed_now) for r in out.collect()) == [(4, 25), (5, 25), (6, 0)]
    assert remove_reference_spans(docs, docs.filter("false")).filter("n_removed_now > 0").count() == 0
