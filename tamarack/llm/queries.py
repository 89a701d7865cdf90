"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm import bpe, chat, decontam, exact_dedup, maxent_lm, minmax, quality, suffix_dedup, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op7_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_decontamination, op3_quality, op4_exact_dedup, op5_maxent_lm, op6_suffix_array, op7_minmax, op8_url_filter, op9_chat, op10_toxicity)}

ORACLES: dict[str, str] = {
    "op6_suffix_array": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2446) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199, 1024)) AS p FROM d WHERE len(h) >= 400)),
        w AS (SELECT doc_id, p + k AS k, substr(s, 2 * k + 1, 400) AS x FROM (SELECT doc_id, p, s, unnest(range(0, least(1024, len(s) // 2 - 199))) AS k FROM c)),
        g AS (SELECT doc_id, k FROM w SEMI JOIN (SELECT x FROM w GROUP BY x HAVING count(*) > 1) r USING (x)),
        m AS (SELECT doc_id, k, CAST(k > lag(k, 1, -1000) OVER (PARTITION BY doc_id ORDER BY k) + 200 AS INTEGER) AS new FROM g),
        i AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM m),
        spans AS (SELECT doc_id, min(k) AS a, max(k) + 200 AS b FROM i GROUP BY doc_id, n),
        e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM spans),
        k AS (SELECT e.doc_id, sum(b - a) AS gone, count(*) AS n, max(b) AS z, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
        SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op7_minmax": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[k : k + 4], ' ') FOR k IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) m ON m.a = d.doc_id""",
    "op8_url_filter": url_filter.rules_sql(),
    "op9_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, role = 'assistant' AS reply,
                     '<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10) AS formatted FROM t),
        x AS (SELECT *, string_agg(formatted, '') OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS example,
                     max(CASE WHEN reply THEN k ELSE 0 END) OVER (PARTITION BY conv_id) AS last FROM e)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (reply), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (reply), '')) AS loss_sha256,
               CAST(sum(CASE WHEN reply THEN length(example) WHEN k > last THEN length(formatted) ELSE 0 END) AS BIGINT) AS formatted_chars,
               count(*) FILTER (reply) AS n_examples, sha256(coalesce(string_agg(sha256(example), '' ORDER BY k) FILTER (reply), '')) AS examples_sha256
        FROM x GROUP BY conv_id""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op2_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        win AS (SELECT DISTINCT item_id, w[k : k + least(10, len(w)) - 1] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT len(x) AS n FROM win),
        place AS (SELECT doc_id, k, n, w[k : k + n - 1] AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, k, n, item_id FROM place JOIN win USING (x)),
        found AS (SELECT h.doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) h GROUP BY 1),
        named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN found USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
