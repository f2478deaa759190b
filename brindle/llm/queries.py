"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SURROGATE_KEY = "key of the synthetic tables"  # who has data to hide passes one of their own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.surrogates import replace_private

    return replace_private(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from brindle.llm.token_attribution import section_tokens

    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.substring_dedup import self_dedup

    return self_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm import quality_ledger as L

    rows = L.ledger(table(spark, sf_dir, "documents"))
    failed = rows.withColumn("base_failed", ~L.verdict("base-1"))
    kept = ~F.col("base_failed") & L.verdict()
    return failed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "fail_bits")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.bloom_lm import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from brindle.llm.sp_agenda import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.subspace_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from brindle.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COMPONENT = "und AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach(s, t) AS (SELECT a, a FROM und UNION SELECT reach.s, und.b FROM reach JOIN und ON und.a = reach.t), comp AS (SELECT s, min(t) c FROM reach GROUP BY s)"


def _op1() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) g FROM w),
    n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1), p AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)), {_COMPONENT}
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, coalesce(c, w.doc_id)::BIGINT component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.s = w.doc_id"""


def _op5() -> str:
    return f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} ws FROM documents),
    win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) i FROM w)),
    late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) r FROM win) WHERE r > 1),
    e AS (SELECT doc_id, unnest(ws) x, generate_subscripts(ws, 1) j FROM w), m AS (SELECT e.doc_id, x, j, max(late.i) OVER (PARTITION BY e.doc_id ORDER BY j) i FROM e LEFT JOIN late ON late.doc_id = e.doc_id AND late.i = e.j),
    k AS (SELECT doc_id, count(*) n, count_if(i IS NOT NULL AND j - i < 20) gone, string_agg(x, ' ' ORDER BY j) FILTER (i IS NULL OR j - i >= 20) t FROM m GROUP BY 1)
    SELECT w.doc_id, coalesce(n, 0)::BIGINT n_words, coalesce(gone, 0)::BIGINT n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""


def _op6() -> str:
    from brindle.llm import quality_ledger as L

    bits = " + ".join(f"CASE WHEN {test} THEN {L.BIT[name]} ELSE 0 END" for name, test in L.RULES)
    return f"""WITH w AS (SELECT doc_id, coalesce(text, '') t, {_WORDS.format("coalesce(text, '')")} ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls FROM documents),
    win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) c FROM (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) i FROM w))),
    rep AS (SELECT doc_id, count(DISTINCT j) n FROM (SELECT doc_id, unnest(range(i, i + 5)) j FROM win WHERE c > 1) GROUP BY 1),
    m AS (SELECT w.doc_id, len(ws)::BIGINT n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, coalesce(rep.n, 0)::BIGINT n_repeat_words,
      len(ls)::BIGINT n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT n_upper_words, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]')))::BIGINT n_letter_words, len(list_distinct(ws))::BIGINT n_distinct_words, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT n_exclaims
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id), b AS (SELECT *, ({bits})::BIGINT fail_bits FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {L.mask("base-1")} <> 0 base_failed, fail_bits & {L.mask("base-1") | L.mask(L.POLICY)} = 0 kept, fail_bits FROM b"""


def _op9() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] e, embedding IS NOT NULL AND len(embedding) > 0 AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ok FROM embeddings),
    l AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98), {_COMPONENT}
    SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id)::BIGINT n_links, coalesce(c, vec_id)::BIGINT component_id, vec_id = coalesce(c, vec_id) kept FROM v LEFT JOIN comp ON s = vec_id"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against brute force."""
    return {"op1_ngram_jaccard_join": _op1(), "op5_substring_dedup": _op5(), "op6_quality_rules": _op6(), "op9_embedding_near_dedup": _op9()}
