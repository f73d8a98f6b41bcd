"""The operators' registered queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm import (
    collocations,
    context_mixing,
    decontaminate,
    digest_index,
    ngram_join,
    packing,
    sentence_spans,
    sharding,
    suffix_dedup,
    token_counts,
    toxicity,
    warc,
    whitening,
)
from lakelens.llm.words import read

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"))


def op3_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substrings_digest(read(spark, sf_dir, "documents"))


def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(read(spark, sf_dir, "documents"))


def op6_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.deduplicated(read(spark, sf_dir, "documents"))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.spans_digest(read(spark, sf_dir, "documents"))


def op8_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severities(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(read(spark, sf_dir, "documents"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(packing.pack(read(spark, sf_dir, "documents"), tokenizer_path()))


def op11_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


def op12_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an error where an exact deviation is beyond a long
    return whitening.whitened(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_stratified_interleave, op3_prefix_doubling, op4_template_leaks, op5_ngram_jaccard, op6_digest_index,
    op7_sentence_spans, op8_ordinal_toxicity, op9_context_mixing, op10_harmonic_packing, op11_warc_dictionary,
    op12_spectrum_whitening, op13_toivonen_phrases)}

ORACLE = {
    "op6_digest_index": """
        WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                   'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_warc_dictionary": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             d AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS top,
                          CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(
                   list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INT) * (16 >> j))) AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM d""",
    "op13_toivonen_phrases": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
             f AS MATERIALIZED (SELECT lang, k, p, count(*) AS c FROM (
                       SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS p
                       FROM words, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(w) >= k) GROUP BY lang, k, p),
             n AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang),
             c AS MATERIALIZED (SELECT *, string_split(p, ' ') AS w FROM f WHERE k > 1 AND c >= 30),
             parts AS MATERIALIZED (SELECT lang, p, c FROM f WHERE c >= 30),
             asked AS MATERIALIZED (SELECT lang, p, c AS a, CAST(i AS INT) AS i, array_to_string(w[1:i], ' ') AS first,
                                           array_to_string(w[i + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
             half AS MATERIALIZED (SELECT q.*, x.c AS l FROM asked q JOIN parts x ON x.lang = q.lang AND x.p = q.first),
             cuts AS (SELECT q.lang, q.p, a, i, l, y.c AS r, (2000000::HUGEINT * a) // (l + y.c) AS score
                      FROM half q JOIN parts y ON y.lang = q.lang AND y.p = q.rest),
             best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, i) = 1),
             inner_phrases AS (SELECT lang, c, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2),
                                      lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS p FROM c WHERE k > 2),
             covered AS (SELECT lang, p, max(c) AS c FROM inner_phrases GROUP BY lang, p)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.p) AS rank, b.p AS phrase,
               CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM best b JOIN n USING (lang) LEFT JOIN covered v ON v.lang = b.lang AND v.p = b.p
        WHERE v.c IS NULL OR 100 * v.c < 80 * a
        QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.p) <= 2000""",
}
