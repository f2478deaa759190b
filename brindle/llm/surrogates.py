"""Keyed surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern per kind. Each entity is reduced to a canonical form (a phone number or
card number to its digits, an email to lower case, a name to given and family name), and a keyed hash
of kind and form makes its surrogate: one per entity wherever and however it is written
(coreference), of the same kind, length, script, letter classes and separators; names keep their
titles, and given names end as names of the title's gender do; card numbers and IBANs that pass their check
digit rule still pass it.

A name is found by its title. Once found, its given and family name are replaced wherever else they stand in the
same text: alone, together, in capitals or as a possessive. Initials between title and name go.

Collision checks run over all distinct entities: of ATTEMPTS candidate surrogates each, those that
are themselves an entity of the corpus go, each surrogate goes to one entity, and each entity takes
the first it was given. Entities that got none try again among what is still free, four times as often in each
round, up to MOST_ATTEMPTS: where one form in a hundred is free, one entity in a million is left then. So distinct
entities stay distinct and none becomes another real one. What is left has a form with hardly a free one, and
becomes a placeholder with its own digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.packed import checkpointed

ATTEMPTS = 6
MOST_ATTEMPTS = 1536
# Titles, by gender, and the patterns of the kinds in order of precedence.
MALE = "Mr|Mister|Herr|Monsieur|Señor|Signor|Г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Signora|Г-жа"
NEUTRAL = "Dr|Doctor|Prof|Professor|Professeur|Docteur"
TITLES = rf"(?:(?:{FEMALE}|{MALE}|{NEUTRAL})\.?\x20)+"
INITIALS = r"(?:\p{Lu}\.\x20)*"
PART = r"\p{Lu}[\p{L}'’-]+"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLES}{INITIALS}{PART}(?:\x20{PART})?(?![\p{{L}}])"
#: what can be a part of a name that stands alone
BARE = rf"(?<![\p{{L}}\p{{N}}]){PART}(?![\p{{L}}])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9])(?!\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}[A-Z0-9]{0,18}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = "|".join((
    r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    r"(?<![0-9+])(?<![0-9][ .-])(?:[0-9]{3}\x20[0-9]{3}\x20[0-9]{4}|0[0-9]{2,4}[ /-][0-9]{6,8})(?![0-9])(?![ .-][0-9])",
))
CARD = r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])"
KINDS = (("email", EMAIL), ("ip", IP), ("ssn", SSN), ("phone", PHONE), ("card", CARD), ("iban", IBAN), ("name", NAME))
PATTERN = "|".join(p for _, p in KINDS)
#: whatever a pattern matches holds one of these; texts without them skip the pattern
HINT = "[0-9@]|" + TITLES
DIGITS = ("ssn", "phone", "card")
MARK = "\x01"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def entities(text: str = "text") -> Column:
    """array<struct<raw, kind, a, b>> of the entities in a text; a and b are keys ("kind\\x01form"), b of given names."""
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    return F.transform(found, _entity)


def _entity(raw: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        kind = F.when(raw.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    # a look-behind or look-ahead sees less here, so what no whole pattern matches is named by its shape
    kind = F.coalesce(kind, F.when(raw.contains("@"), "email").otherwise("card"))
    digits = F.regexp_replace(raw, "[^0-9]", "")
    words = F.split(_bare(raw), " ")
    gender = F.when(raw.rlike(rf"^(?:{TITLES})?(?:{FEMALE})\.? "), "f").when(raw.rlike(rf"^(?:{TITLES})?(?:{MALE})\.? "), "m").otherwise("n")
    given = F.when(F.size(words) > 1, F.concat(F.lit("given_"), gender, F.lit(MARK), F.element_at(words, 1)))
    form = (
        F.when(kind == "email", F.lower(raw)).when(kind.isin(*DIGITS), digits).when(kind == "name", F.element_at(words, -1)).otherwise(raw)
    )
    key = F.concat(F.when(kind == "name", "family").otherwise(kind), F.lit(MARK), form)
    return F.struct(raw.alias("raw"), kind.alias("kind"), key.alias("a"), F.when(kind == "name", given).alias("b"))


def _bare(raw: Column) -> Column:
    """A name without titles and initials."""
    return F.regexp_replace(raw, f"^{TITLES}{INITIALS}", "")


def _surrogates(keys: DataFrame, secret: str, first: int, attempts: int) -> DataFrame:
    """(k, attempt, s) for each key and attempt."""
    e = keys.select("k", F.explode(F.sequence(F.lit(first), F.lit(first + attempts - 1))).alias("attempt"))
    e = e.selectExpr("k", "attempt", f"split(k, {_q(MARK)}, 2)[0] AS kind", f"split(k, {_q(MARK)}, 2)[1] AS form", f"sha2(concat_ws('|', {_q(secret)}, attempt, k), 512) AS h")
    byte = lambda i: f"cast(conv(substr(h, 2 * (({i}) % 64) + 1, 2), 16, 10) AS int)"
    char = "substr(form, i, 1)"
    classes = f"CASE WHEN {char} RLIKE '[0-9]' THEN cast({byte('i')} % 10 AS string) WHEN {char} RLIKE '[a-z]' THEN chr(97 + {byte('i')} % 26) WHEN {char} RLIKE '[A-Z]' THEN chr(65 + {byte('i')} % 26) ELSE {char} END"
    mapped = lambda keep="false": f"array_join(transform(sequence(1, length(form)), i -> CASE WHEN {keep} THEN {char} ELSE {classes} END), '')"
    # luhn(x): the sum of the check digit rule of the digits x
    digit = lambda x: f"coalesce(try_cast(substr({x}, i, 1) AS int), 0)"
    luhn = lambda x: f"aggregate(sequence(1, length({x})), 0, (t, i) -> cast(t + CASE WHEN (length({x}) - i) % 2 = 0 THEN {digit(x)} ELSE (2 * {digit(x)}) DIV 10 + (2 * {digit(x)}) % 10 END AS int))"
    # mod97(x): the remainder by which IBANs are checked, letters counting from 10
    mod97 = lambda x: f"aggregate(sequence(1, length({x})), 0, (t, i) -> cast(CASE WHEN substr({x}, i, 1) RLIKE '[0-9]' THEN (10 * t + {digit(x)}) % 97 ELSE (100 * t + ascii(substr({x}, i, 1)) - 55) % 97 END AS int))"
    turned = lambda x: f"concat(substr({x}, 5), substr({x}, 1, 4))"
    e = e.withColumn("m", F.expr(
        f"CASE kind WHEN 'email' THEN concat(substring_index({mapped()}, '.', size(split(form, '[.]')) - 1), '.example')"
        f" WHEN 'ip' THEN CASE WHEN form LIKE '10.%' THEN concat_ws('.', 10, {byte('1')}, {byte('2')}, 1 + {byte('3')} % 254) WHEN form LIKE '192.168.%' THEN concat_ws('.', 192, 168, {byte('2')}, 1 + {byte('3')} % 254)"
        f" ELSE concat_ws('.', 11 + {byte('0')} % 110, {byte('1')}, {byte('2')}, 1 + {byte('3')} % 254) END"
        f" WHEN 'iban' THEN {mapped('i <= 2')} WHEN 'phone' THEN {mapped('i = 1 AND length(form) > 10')} WHEN 'card' THEN {mapped('i = 1')} ELSE {mapped()} END"
    ))
    lower = lambda i: f"concat(substr('bdfghjklmnprstvz', 1 + {byte(i)} % 16, 1), substr('aeiou', 1 + {byte(i + ' + 32')} % 5, 1))"
    cyrillic = lambda i: f"concat(substr('бвгдзклмнпрстфхш', 1 + {byte(i)} % 16, 1), substr('аеиоу', 1 + {byte(i + ' + 32')} % 5, 1))"
    name = lambda f, male, female, neutral, family: f"initcap(concat({f('0')}, {f('1')}, {f('2')}, {f('3')}, CASE kind WHEN 'given_m' THEN {_q(male)} WHEN 'given_f' THEN {_q(female)} WHEN 'given_n' THEN {_q(neutral)} ELSE {_q(family)} END))"
    body = "substr(m, 1, length(m) - 1)"
    unchecked = "concat(substr(m, 1, 2), '00', substr(m, 5))"
    return e.selectExpr("k", "attempt", f"""
        CASE WHEN kind IN ('given_m', 'given_f', 'given_n', 'family') THEN
            CASE WHEN form RLIKE '^\\\\p{{IsCyrillic}}' THEN {name(cyrillic, 'он', 'ия', 'ен', 'ов')} ELSE {name(lower, 'ton', 'ina', 'en', 'er')} END
        WHEN kind = 'card' AND {luhn('form')} % 10 = 0 THEN concat({body}, cast((10 - {luhn(f"concat({body}, '0')")} % 10) % 10 AS string))
        WHEN kind = 'iban' AND {mod97(turned('form'))} = 1 THEN concat(substr(m, 1, 2), lpad(cast(98 - {mod97(turned(unchecked))} AS string), 2, '0'), substr(m, 5))
        ELSE m END AS s""")  # fmt: skip


def surrogate_table(keys: DataFrame, secret: str) -> DataFrame:
    """(k, s): one distinct surrogate for each distinct entity key."""
    keys = checkpointed(keys.select("k").distinct())
    kind = F.substring_index("k", MARK, 1)
    done, left, first, attempts = None, keys, 0, ATTEMPTS
    while True:
        tried = _surrogates(left, secret, first, attempts).withColumn("real", F.concat(kind, F.lit(MARK), F.col("s")))
        free = tried.join(keys.select(F.col("k").alias("real")), "real", "left_anti")
        if done is not None:
            free = free.join(done.select("real"), "real", "left_anti")
        owned = free.groupBy("real").agg(F.min(F.struct("attempt", "k")).alias("o"), F.min("s").alias("s")).select("o.k", "o.attempt", "s", "real")
        mine = checkpointed(owned.groupBy("k").agg(F.min_by(F.struct("s", "real"), "attempt").alias("o")).select("k", "o.s", "o.real"))
        done = mine if done is None else done.union(mine)
        left = checkpointed(left.join(mine, "k", "left_anti"))
        first, attempts = first + attempts, 4 * attempts
        if first + attempts > MOST_ATTEMPTS or left.isEmpty():
            break
    placeholder = F.concat(F.lit("["), F.upper(kind), F.lit("-"), F.substring(F.sha2(F.concat(F.lit(secret), F.lit("!"), F.col("k")), 256), 1, 16), F.lit("]"))
    return done.select("k", "s").union(left.select("k", placeholder.alias("s")))


def _written(e: Column, m: Column) -> Column:
    """The surrogate of an entity, in the format of its raw form."""
    raw, s = e["raw"], m[e["a"]]
    chars = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.substr(raw, i, F.lit(1)))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    filled = F.aggregate(
        chars, start,
        lambda t, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(t["out"], F.substr(s, t["at"], F.lit(1))).alias("out"), (t["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(t["out"], c).alias("out"), t["at"].alias("at"))),
        lambda t: t["out"],
    )
    title = F.regexp_extract(raw, f"^{TITLES}", 0)
    name = F.concat(title, F.when(e["b"].isNull(), s).otherwise(F.concat_ws(" ", m[e["b"]], s)))
    plain = F.when((F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(s)).otherwise(s)
    return (
        F.when(s.startswith("["), s).when(e["kind"].isin(*DIGITS), filled).when(e["kind"] == "name", name).otherwise(plain)
    )


def _mentions(gap: Column, m: Column) -> Column:
    """struct<out, n>: text between entities with the parts of known names replaced, and how many were."""
    kinds = ("family", "given_m", "given_f", "given_n")
    known = lambda part: F.coalesce(*[m[F.concat(F.lit(k + MARK), part)] for k in kinds])

    def one(word: Column) -> Column:
        end = F.regexp_extract(word, "['’]s$", 0)
        part = F.regexp_replace(word, "['’]s$", "")
        loud = F.when((F.upper(part) == part) & (F.length(part) > 1), F.upper(known(F.initcap(F.lower(part)))))
        return F.concat(F.coalesce(known(part), loud), end)

    found = F.transform(F.regexp_extract_all(gap, F.lit(BARE), F.lit(0)), lambda w: F.struct(w.alias("w"), one(w).alias("s")))
    between = F.split(gap, BARE, -1)
    filled = F.zip_with(found, F.slice(between, 2, F.size(between)), lambda f, b: F.concat(F.coalesce(f["s"], f["w"]), b))
    return F.struct(F.concat(F.element_at(between, 1), F.array_join(filled, "")).alias("out"), F.size(F.filter(found, lambda f: f["s"].isNotNull())).alias("n"))


def replace_private(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """docs with every detected entity replaced; adds n_replaced; all other columns and rows stay.

    secret is the key of the surrogates: who has it can tell which surrogate an entity gets, so it has no default.
    Texts without an entity come back as they are, null and empty ones included. Repeated rows get the
    same surrogates. An empty table gives no rows. Names of other columns do not matter: where one is called
    n_replaced, the new one is n_replaced_now, or the next such name that is free. Only texts with an
    entity are shuffled, by their digest; a text that fills a third of all rows is a skewed join, which
    adaptive execution splits.
    """
    if not secret:
        raise ValueError("surrogates need a key")
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    t = names[text]
    rows = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()])
    has = F.coalesce(F.col(t).rlike(HINT) & F.col(t).rlike(PATTERN), F.lit(False))
    clean = rows.filter(~has).withColumn("n_replaced", F.lit(0).cast("long"))
    dirty = rows.filter(has).withColumn("key", F.sha2(F.col(t), 256))
    found = dirty.select("key", F.explode(entities(t)).alias("e"))
    used = found.select("key", F.explode(F.filter(F.array("e.a", "e.b"), lambda x: x.isNotNull())).alias("k")).distinct()
    used = checkpointed(used)
    table = surrogate_table(used, secret)
    maps = used.join(table, "k").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias("m"))
    gaps, m = F.split(F.col(t), PATTERN, -1), F.col("m")
    named = F.exists(F.map_keys(m), lambda k: k.startswith("family" + MARK))
    plain = F.transform(gaps, lambda g: F.struct(g.alias("out"), F.lit(0).alias("n")))
    joined = dirty.join(maps, "key").withColumn("e", entities(t))
    joined = joined.withColumn("gaps", F.when(named, F.transform(gaps, lambda g: _mentions(g, m))).otherwise(plain))
    new, rest = F.transform(F.col("e"), lambda e: _written(e, m)), F.transform("gaps", lambda g: g["out"])
    text_out = F.concat(F.element_at(rest, 1), F.array_join(F.zip_with(new, F.slice(rest, 2, F.size(rest)), lambda a, b: F.concat(a, b)), ""))
    # a text has one gap more than entities
    count = F.size("e").cast("long") + F.aggregate("gaps", F.lit(0).cast("long"), lambda n, g: n + g["n"])
    replaced = joined.select(*[text_out.alias(x) if x == t else F.col(x) for x in names.values()], count.alias("n_replaced"))
    new_name = "n_replaced"
    while new_name in docs.columns:
        new_name += "_now"
    return clean.unionByName(replaced).select(*[F.col(x).alias(c) for c, x in names.items()], F.col("n_replaced").alias(new_name))
