"""One query per operator, with production parameters over its whole table, and the SQL twin where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyclock.llm import byte_bpe, conversation_trie, decontamination, line_dedup, line_quality, mixing, simhash, surrogates, token_counts, token_files, toxicity, warc, whitening


#: The key of the surrogates in the registered query; whoever keeps data private passes a secret one.
PII_KEY = "published with the query, for tests only"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op2_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_check(table(spark, sf_dir, "documents"), vocabulary())


def op4_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.assessed(table(spark, sf_dir, "documents")).drop("cleaned_text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replaced(docs, PII_KEY)


def op10_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trips(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_chunks,
        op2_cube_mixing,
        op3_token_files,
        op4_line_winnowing,
        op5_line_quality,
        op6_token_counts,
        op7_toxicity,
        op8_simhash_groups,
        op9_surrogates,
        op10_latent_leaks,
        op11_block_whitening,
        op12_byte_bpe,
        op13_conversation_trie,
    )
}
_END, _NOTICE = (x.replace("'", "''") for x in (line_quality._CLOSING, line_quality._BOILERPLATE))
_LINE_QUALITY_SQL = rf"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, [x for x in regexp_split_to_array(t, '[\x20\x09-\x0D]+') if x <> ''] AS ws, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM r),
g AS (SELECT rid, i, ws[i:i+4] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
v AS (SELECT rid, count(DISTINCT i + k) AS n FROM c, range(0, 5) o(k) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, x, length(regexp_replace(x, '[^\x20\x09-\x0D]', '', 'g')) AS blanks FROM (SELECT rid, unnest(ls) AS x FROM w)),
f AS (SELECT rid, sum(length(x) - blanks) AS lost FROM l
WHERE NOT (regexp_matches(rtrim(x, ' '), '{_END}') AND 2 * length(regexp_replace(x, '[^!?#*$%&|<>]', '', 'g')) <= blanks + 1
AND length(regexp_replace(x, '[^|>»·]', '', 'g')) < 3 AND NOT regexp_matches(lower(x), '{_NOTICE}')) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in ws]), 0) AS BIGINT) AS word_chars,
CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars FROM w LEFT JOIN v USING (rid) LEFT JOIN f USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND lost_chars <= 0.5 * word_chars AS kept FROM b"""

# the CRC-32 of an id, bit by bit; then every prefix by the digests of its turns
_TRIE_SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, md5(length(role) || ':' || role || text) AS g, CAST(len(regexp_extract_all(text, '[^ 	-]+')) AS BIGINT) AS w,
row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
h AS (SELECT c, xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten([[CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] for x in string_split(CAST(c AS VARCHAR), '')]),
lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, pos, g, w FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.pos <= h.h UNION ALL SELECT h.c, pos, g, w FROM h JOIN o ON o.c = h.c AND o.pos > h.h),
p AS (SELECT c, w, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, string_agg(g, '') OVER (PARTITION BY c ORDER BY pos) AS k FROM r),
m AS (SELECT c, 0 AS d, '' AS k, 0 AS w FROM h UNION ALL SELECT c, d, md5(k), w FROM p),
m2 AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) = d AS last FROM m),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n, any_value(w) AS w, any_value(up) AS up, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '') AS ends FROM m2 GROUP BY d, k),
f AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
u AS (SELECT a.d, a.k, sum((n.n - 1) * n.w) AS saved, count(*) FILTER (WHERE f.n_children IS NULL) AS leaves
FROM n LEFT JOIN f ON f.d = n.d AND f.k = n.k JOIN m a ON a.c = n.conv_id AND a.d <= n.d GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(f.n_children, 0) AS n_children, u.leaves AS n_leaves,
CAST(u.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN u ON u.d = n.d AND u.k = n.k LEFT JOIN f ON f.d = n.d AND f.k = n.k LEFT JOIN n q ON q.d = n.d - 1 AND q.k = n.up"""

ORACLE: dict[str, str] = {
    "op13_conversation_trie": _TRIE_SQL,
    "op5_line_quality": _LINE_QUALITY_SQL,
    "op1_warc_chunks": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100""",
}
