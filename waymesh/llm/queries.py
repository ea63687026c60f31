"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymesh.llm import conversations, decontaminate, exact_dedup, language_id, line_dedup, packing, pii, resample, secrets, simhash, suffix_index, token_files, warc
from waymesh.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(read(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_repeats(read(spark, sf_dir, "documents")).drop("kept_bytes")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.diagnose(conversations.damage(read(spark, sf_dir, "conversations")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.importance(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), words_apart=True)


QUERIES: dict[str, Query] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_warc_dictionary": op4_warc_dictionary,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_secret_ownership": op7_secret_ownership,
    "op8_simhash": op8_simhash,
    "op9_suffix_array": op9_suffix_array,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_token_files": op13_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc_dictionary": r"""
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
            CASE WHEN g.first_id IS NULL OR g.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN g.first_id <> p.page_id THEN g.first_id END AS refers_to
        FROM p LEFT JOIN g USING (payload_digest)""",
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)""",
    "op7_secret_ownership": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
        p(kind, rank, pattern, grp) AS (VALUES
            ('assign', 0, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1),
            ('access', 1, 'AKIA[A-Z0-9]{16,}', 0), ('hex', 2, '[0-9a-f]{24,}', 0)),
        m AS (
            SELECT r, doc_id, source, kind, rank, string_split_regex(text, pattern) AS gaps, regexp_extract_all(text, pattern, 0) AS found,
                CASE WHEN grp = 1 THEN regexp_extract_all(text, pattern, 1) ELSE regexp_extract_all(text, pattern, 0) END AS vals
            FROM d, p WHERE regexp_matches(text, pattern)),
        e AS (SELECT r, doc_id, source, kind, rank, unnest(range(1, len(found) + 1)) AS i, gaps, found, vals FROM m),
        f AS (SELECT r, doc_id, source, kind, rank, i, len(gaps[i]) AS gap, len(found[i]) AS n, vals[i] AS v FROM e),
        g AS (SELECT r, doc_id, source, kind, rank, v, n, CAST(sum(gap + n) OVER (PARTITION BY r, rank ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM f),
        s AS (SELECT r, doc_id, source, kind, rank, v, stop - n AS start, stop FROM g WHERE rank > 0 OR len(v) >= 6),
        spread AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT coalesce('=' || doc_id, '')) AS repositories FROM s GROUP BY v),
        chars AS (SELECT v, unnest(string_split(v, '')) AS c FROM spread),
        freq AS (SELECT v, c, count(*) / len(v) AS share FROM chars GROUP BY v, c),
        bits AS (SELECT v, -sum(share * log2(share)) AS h FROM freq GROUP BY v),
        verdict AS (
            SELECT v, owners, repositories, CASE WHEN owners >= 3 OR repositories >= 10 THEN 'copied'
                WHEN owners = 1 AND len(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND h >= 2.8
                    AND NOT regexp_matches(lower(v), 'example|sample|dummy|changeme|placeholder|password|secret|your|test|qwerty|abcdef|12345')
                    AND NOT EXISTS (SELECT 1 FROM range(1, len(v) - 2) t(k) WHERE lower(v[k:k + 3]) = repeat(lower(v[k:k]), 4)) THEN 'live' END AS verdict
            FROM spread JOIN bits USING (v)),
        added AS (SELECT DISTINCT r, verdict AS kind, CASE verdict WHEN 'copied' THEN 3 ELSE 4 END AS rank, start, stop FROM s JOIN verdict USING (v) WHERE verdict IS NOT NULL),
        base AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS joined FROM s GROUP BY r),
        spans AS (SELECT r, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans, count(*) FILTER (rank = 3) AS n_copied, count(*) FILTER (rank = 4) AS n_live FROM (SELECT r, kind, rank, start, stop FROM s UNION ALL SELECT r, kind, rank, start, stop FROM added) GROUP BY r),
        places AS (SELECT r, string_agg(start || ':' || stop || ':' || owners || ':' || repositories, ',' ORDER BY start, stop, owners, repositories) AS spread FROM (SELECT DISTINCT r, start, stop, owners, repositories FROM s JOIN verdict USING (v)) GROUP BY r)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(joined, '')) AS base_sha256, coalesce(spans, '') AS spans,
            coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live, coalesce(spread, '') AS spread
        FROM d LEFT JOIN base USING (r) LEFT JOIN spans USING (r) LEFT JOIN places USING (r)""",
    "op10_decontamination": r"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        bw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0),
        windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
        sizes AS (SELECT DISTINCT n FROM windows),
        grams AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
        hits AS (SELECT g.doc_id, g.n, g.i, item_id FROM grams g JOIN windows USING (n, gram)),
        hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op11_conversation_repair": conversations.SQL,
    "op12_importance_resampling": resample.SQL,
}
