import random
import re

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def replaced(spark, texts, **more):
    from brindle.llm.surrogates import replace_private

    rows = [(i, t, "x", "k") for i, t in enumerate(texts)]
    out = replace_private(spark.createDataFrame(rows, "doc_id long, text string, n_chars string, key string"), **{"secret": "k1"} | more)
    assert out.columns == ["doc_id", "text", "n_chars", "key", "n_replaced"]
    return {r.doc_id: (r.text, r.n_replaced) for r in out.collect()}


def test_formats_coreference_and_distinctness(spark):
    texts = [
        "mail Ann.54@mail3.example.com, or ANN.54@MAIL3.EXAMPLE.COM; card 4785380592391139$$$ and 4785-3805-9239-1139.",
        "+1 (743) 555-3824 or +1-743-555-3824, host 227.5.221.1. and 10.2.3.4\nssn 123-45-6789",
        "Mrs. Maria Silva met Mr. Peter Silva and Frau Müller; г-н? Г-н Иванов. Mr. Silva",
        None, "", "no entity at all 12 345 1.2.3", "a@b.c", "4111 1111 1111 1111 x", "text " * 20_000 + "z.1@mail9.example.com",
        "227.5.221.1", "227.5.221.1",
    ]
    got = replaced(spark, texts)
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[5] == (texts[5], 0)
    mail = re.fullmatch(r"mail ([a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.example), or ([A-Z]{3}\.\d\d@[A-Z]{4}\d\.[A-Z]{7}\.EXAMPLE); card (\d{16})\$\$\$ and (\d{4}-\d{4}-\d{4}-\d{4})\.", got[0][0])
    assert mail and mail[1].upper() == mail[2] and mail[3] == mail[4].replace("-", "") and mail[3] != "4785380592391139" and got[0][1] == 4
    assert luhn(mail[3]) == luhn("4785380592391139")
    card = got[7][0][:19]
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", card) and luhn(card.replace(" ", "")) and card != texts[7][:19]
    phone = re.fullmatch(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1-(\d{3})-(\d{3})-(\d{4}), host (\S+)\. and (10\.\d+\.\d+\.\d+)\nssn (\d{3}-\d\d-\d{4})", got[1][0])
    assert phone and phone.group(1, 2, 3) == phone.group(4, 5, 6) and phone[7] != "227.5.221.1" and phone[8] != "10.2.3.4"
    assert got[9][0] == got[10][0] == phone[7]
    name = re.fullmatch(r"Mrs\. (\w+ina) (\w+) met Mr\. (\w+ton) (\w+) and Frau (\w+); г-н\? Г-н (\w+ов)\. Mr\. (\w+)", got[2][0])
    assert name and name[2] == name[4] == name[7] != "Silva" and len({name[1], name[3], name[2], name[5]}) == 4
    assert "z.1@mail9" not in got[8][0] and got[8][0].startswith("text " * 20_000)
    other = replaced(spark, texts, secret="another")
    assert other[0][0] != got[0][0]


def test_collisions_are_resolved(spark):
    # one letter at one letter: 676 forms, so candidates collide all the time
    import itertools
    import string

    texts = [f"{a}@{b}.cc" for a, b in itertools.product(string.ascii_lowercase, repeat=2)]
    got = replaced(spark, texts)
    out = [got[i][0] for i in range(len(texts))]
    assert len(set(out)) == len(texts) and not set(out) & set(texts)


def test_nothing(spark):
    from brindle.llm.surrogates import replace_private

    assert replace_private(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0
    with pytest.raises(ValueError):
        replace_private(spark.createDataFrame([], "doc_id long, text string"), "")
    clash = spark.createDataFrame([(None, "a@b.cc", 1, 2), (None, None, 1, 2), (3, "a@b.cc", 1, 2), (3, "a@b.cc", 1, 2)], "doc_id long, text string, n_replaced int, n_replaced_now int")
    got = replace_private(clash, "k")
    assert got.columns[-1] == "n_replaced_now_now" and sorted(x[-1] for x in got.collect()) == [0, 1, 1, 1] and {(x[2], x[3]) for x in got.collect()} == {(1, 2)}


def test_known_names_are_replaced_wherever_they_stand(spark):
    texts = [
        "Mr. John Smith called. Smith said that John Smith would pay. SMITH paid; Smith's cheque, John's word. Smithson did not.",
        "Dr. Anna Weber and Prof. Dr. Weber met Ms J. R. Keller. Weber left, Keller stayed.",
        "Smith and Weber are no names here without a title.",
    ]
    got = replaced(spark, texts)
    one = got[0][0]
    assert not re.search(r"Smith(?!son)|SMITH|John", one) and "Smithson did not." in one
    m = re.fullmatch(r"Mr\. (\w+ton) (\w+) called\. (\w+) said that (\w+) (\w+) would pay\. (\w+) paid; (\w+)'s cheque, (\w+)'s word\. Smithson did not\.", one)
    assert m and m[2] == m[3] == m[5] == m[7] and m[1] == m[4] == m[8] and m[6] == m[2].upper() and got[0][1] == 7
    m = re.fullmatch(r"Dr\. (\w+en) (\w+) and Prof\. Dr\. (\w+) met Ms (\w+)\. (\w+) left, (\w+) stayed\.", got[1][0])
    assert m and m[2] == m[3] == m[5] and m[4] == m[6] and "Weber" not in got[1][0]
    assert got[2] == (texts[2], 0)


def test_phones_and_check_digits(spark):
    def valid(iban):
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1

    texts = ["call 555 123 4567 or 0171 2345678", "pay GB82WEST12345698765432 now", "pay GB83WEST12345698765432 now", "rows 123 456 7890 1 and 1 555 123 4567"]
    got = replaced(spark, texts)
    assert re.fullmatch(r"call \d{3} \d{3} \d{4} or \d{4} \d{7}", got[0][0]) and got[0][1] == 2 and "555 123 4567" not in got[0][0]
    a, b = (got[i][0].split()[1] for i in (1, 2))
    assert valid("GB82WEST12345698765432") and valid(a) and a[:2] == "GB" and a != "GB82WEST12345698765432" and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", a)
    assert not valid("GB83WEST12345698765432") and b != "GB83WEST12345698765432"
    assert got[3] == (texts[3], 0)  # parts of longer rows of numbers


def test_detection_and_surrogates_by_brute_force(spark):
    import regex

    from brindle.llm import surrogates as S

    r = random.Random(12)
    parts = ["a.b@c.example", "10.1.2.3", "999.1.1.1", "Mr. Ada Lovelace", "Frau Noll", "Noll", "Ada", "123-45-6789", "+49 171 2345678", "555-123-4567", "4111 1111 1111 1111", "DE89370400440532013000", "word", "Mr", "12", ".", ",", "\n", "Dr. Prof. X", "é", "(555) 123-4567"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(150)]
    got = replaced(spark, texts)
    pattern = regex.compile(S.PATTERN)
    bare = regex.compile(S.BARE)
    keys, cut = set(), {}

    def key(raw):
        kind = next((k for k, p in S.KINDS if regex.fullmatch(p, raw)), "email" if "@" in raw else "card")
        if kind != "name":
            return kind, f"{kind}{S.MARK}" + (raw.lower() if kind == "email" else re.sub("[^0-9]", "", raw) if kind in S.DIGITS else raw), None
        words = regex.sub(f"^{S.TITLES}{S.INITIALS}", "", raw).split(" ")
        gender = "f" if regex.match(rf"(?:{S.TITLES})?(?:{S.FEMALE})\.? ", raw) else "m" if regex.match(rf"(?:{S.TITLES})?(?:{S.MALE})\.? ", raw) else "n"
        return kind, f"family{S.MARK}{words[-1]}", f"given_{gender}{S.MARK}{words[0]}" if len(words) > 1 else None

    for i, t in enumerate(texts):
        cut[i] = [key(m.group()) + (m.group(),) for m in pattern.finditer(t)], pattern.split(t)
        keys |= {k for e in cut[i][0] for k in e[1:3] if k}
    table = {x.k: x.s for x in S.surrogate_table(spark.createDataFrame([(k,) for k in keys], "k string"), "k1").collect()}
    assert len(set(table.values())) == len(keys)

    def written(kind, a, b, raw):
        if kind in S.DIGITS:
            digits = iter(table[a])
            return "".join(next(digits) if c.isascii() and c.isdigit() else c for c in raw)
        if kind == "name":
            return regex.match(S.TITLES, raw).group() + " ".join([table[k] for k in (b, a) if k])
        return table[a].upper() if raw.upper() == raw and raw.lower() != raw else table[a]

    for i, t in enumerate(texts):
        found, gaps = cut[i]
        names = {k.split(S.MARK)[1]: table[k] for e in reversed(found) for k in (e[2], e[1]) if k and e[0] == "name"}
        n = len(found) + sum(w in names for g in gaps for w in bare.findall(g))
        gaps = [bare.sub(lambda m: names.get(m.group(), m.group()), g) for g in gaps] if names else gaps
        want = gaps[0] + "".join(written(*e) + g for e, g in zip(found, gaps[1:]))
        assert got[i] == (want, n), t


def test_surrogates_of_a_dense_form_need_rounds(spark):
    from brindle.llm import surrogates as S

    keys = [f"ip{S.MARK}192.168.{i}.{j}" for i in range(120) for j in range(1, 255)]  # about half of all that are free
    got = S.surrogate_table(spark.createDataFrame([(k,) for k in keys], "k string"), "key").collect()
    out = [x.s for x in got]
    assert len(out) == len(set(out)) == len(keys) and not any(x.startswith("[") for x in out)
    assert not {f"ip{S.MARK}{x}" for x in out} & set(keys)


def brute_sections(text, tokens, rule):
    kinds = ("table", "list", "shout", "prose", "blank")
    of = []
    for line in text.encode().split(b"\n"):
        k = 0 if b" | " in line else 4 if not line.strip() else 1 if re.match(rb"[ \t]*([-*\xe2]|\d+[.)])", line) else 2 if line.isupper() else 3
        of += [k] * (len(line) + 1)
    raw = text.encode()
    of = of[: len(raw)]
    char = np.cumsum([b & 0xC0 != 0x80 for b in raw])
    runs, r = [], 0
    for i, k in enumerate(of):
        r += i > 0 and of[i - 1] != k
        runs.append(r)
    out, at, crossing = np.zeros(5), 0, 0
    for n in tokens:
        # one byte for each character that the token holds a byte of
        each = [i for i in range(at, at + n) if i == at or char[i] != char[i - 1]]
        ks, rs = [of[i] for i in each], [runs[i] for i in each]
        crossing += len(set(rs)) > 1
        if rule == "first":
            out[ks[0]] += 1
        elif rule == "last":
            out[ks[-1]] += 1
        elif rule == "share":
            for k in ks:
                out[k] += 1 / len(ks)
        else:
            best = max(sorted(set(rs)), key=lambda r: (rs.count(r), -r))
            out[ks[rs.index(best)]] += 1
        at += n
    return out, crossing


@pytest.mark.parametrize("rule", ["first", "last", "most", "share"])
def test_section_tokens(spark, rule):
    from brindle.llm.piece_cache import ByteLevel
    from brindle.llm.token_attribution import section_tokens

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    r = random.Random(4)
    lines = ["plain words here", "A | b | c", "- item", "LOUD WORDS", "", "  ", "été 日本", "1. one", "\t", "x"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(1, 8))) + r.choice(["", "\n", "\n\n\n"]) for _ in range(60)] + [None, "", "\n", "word " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = ByteLevel(ranks, pattern)
    for x in section_tokens(docs, ranks, pattern, rule).collect():
        t = texts[x.doc_id] or ""
        sizes = [int(b.lengths[i]) for i in np.frombuffer(b.ids(t), "<u4")]
        want, crossing = brute_sections(t, sizes, rule)
        got = [x[f"tokens_{k}"] for k in ("table", "list", "shout", "prose", "blank")]
        assert x.n_tokens == len(sizes) and x.n_crossing == crossing and np.allclose(got, want) and abs(sum(got) - x.n_tokens) < 1e-6, t


def test_field_tokens(spark):
    from brindle.llm.token_attribution import field_tokens

    rows = spark.createDataFrame([("user", "hello there", None), (None, None, None), ("a", "", "tail words")], "role string, body string, note string")
    for x in field_tokens(rows, ["role", "body", "note"], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "share").collect():
        assert abs(x.tokens_role + x.tokens_body + x.tokens_note - x.n_tokens) < 1e-9


def test_sections_of_special_tokens_null_keys_and_nothing(spark):
    from tokenizers import Tokenizer

    from brindle.llm.token_attribution import field_tokens, section_tokens

    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = ["a <|endoftext|> b\n- x<|endoftext|>", "A | b\n\nplain", "<|endoftext|>"]
    docs = spark.createDataFrame([(None, t, 1) for t in texts] + [(7, texts[0], 1)] * 2, "doc_id long, text string, n_tokens long")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(len(t.encode(x, add_special_tokens=False).ids) for x in [*texts, texts[0], texts[0]])
    assert sorted(x.n_tokens for x in section_tokens(docs, *files).collect()) == want
    assert section_tokens(docs.filter("false"), *files).count() == 0
    clash = field_tokens(docs.withColumnRenamed("doc_id", "counted"), ["text"], *files)
    assert sorted(x.n_tokens for x in clash.collect()) == want and clash.columns == ["counted", "text", "n_tokens", "n_crossing", "tokens_text"]
