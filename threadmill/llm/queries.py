"""Queries of the operators on texts (p2, p6, p7, p8, p9, p10) and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..corpus_queries import sql_id
from ..operators.references import standing
from ..session import cut_lineage, table
from . import bpe, conversations, packing, pii, secrets, splitting


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "segments"), table(spark, d, "records"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.message_pieces(table(spark, d, "records"))


def p2_segment_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.segment_pieces(table(spark, d, "segments"), table(spark, d, "records"))


def _standing(spark: SparkSession, d: str) -> DataFrame:
    return standing(table(spark, d, "records"), table(spark, d, "removed_records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.check_sessions(_standing(spark, d)).filter("reason is not null").select("session_id")


def p6_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(_standing(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find(table(spark, d, "blocks"))


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks")
    return secrets.redact(blocks, cut_lineage(secrets.confirmed(secrets.candidates(blocks))))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p8_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.corpus_counts(bpe.encode_corpus(table(spark, d, "documents")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_corpus(table(spark, d, "documents"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack_corpus(table(spark, d, "documents")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents")).select("doc_id", "pii_kind").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return pii.redact(docs, cut_lineage(pii.find(docs)))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_segment_pieces, p6_found, p6_conversations, p7_found, p7_redacted, p8_ids, p8_token_counts, p9_containers, p9_fill, p10_found, p10_redacted)}

_TEXT = """CASE content_kind WHEN 'string' THEN json_extract_string(message, '$.content') WHEN 'array' THEN array_to_string(list_transform(
    list_filter(from_json(json_extract(message, '$.content'), '[{"type":"VARCHAR","text":"VARCHAR"}]'), lambda b: b.type = 'text' AND b.text IS NOT NULL), lambda b: b.text), chr(10)) END"""

_P6 = f"""gone AS (SELECT DISTINCT {sql_id('session_id')} AS s, {sql_id('uuid')} AS u FROM removed_records),
        r AS (SELECT {sql_id('session_id')} AS s, {sql_id('uuid')} AS u, {sql_id('parent_uuid')} AS up, {sql_id('leaf_uuid')} AS leaf, line_no, ingested_at, rec_type, {_TEXT} AS txt,
                CASE WHEN NOT regexp_matches(coalesce({_TEXT}, ''), '\\S') THEN '-'
                     WHEN rec_type = 'assistant' THEN 'R'
                     WHEN rec_type = 'user' AND NOT coalesce(is_meta, false) AND NOT coalesce(is_compact_summary, false) AND NOT coalesce(has_source_tool, false) THEN 'T'
                     ELSE '-' END AS sym
              FROM records),
        live AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.s = r.s AND g.u = r.u)),
        n AS (SELECT s, u, max_by(coalesce(up, ''), (line_no, ingested_at)) AS up, max_by(sym, (line_no, ingested_at)) AS sym, max_by(txt, (line_no, ingested_at)) AS txt, max(line_no) AS line_no FROM live WHERE u IS NOT NULL GROUP BY ALL),
        lp AS (SELECT s, arg_max(coalesce(leaf, ''), line_no) AS leaf FROM live WHERE rec_type = 'last-prompt' GROUP BY s),
        leafs AS (SELECT n.s, coalesce(max(CASE WHEN n.u = lp.leaf THEN n.u END), max_by(n.u, n.line_no)) AS leaf FROM n LEFT JOIN lp ON n.s = lp.s GROUP BY n.s),
        thread AS (
          SELECT n.s, n.u, n.up, n.sym, n.txt, 0 AS d FROM n JOIN leafs ON n.s = leafs.s AND n.u = leafs.leaf
          UNION ALL
          SELECT n.s, n.u, n.up, n.sym, n.txt, t.d + 1 FROM thread t JOIN n ON n.s = t.s AND n.u = t.up WHERE t.d < 20000),
        whole AS (SELECT s, replace(string_agg(sym, '' ORDER BY d DESC), '-', '') AS word, max_by(up, d) AS last_up FROM thread GROUP BY s),
        dropped AS (SELECT DISTINCT r.s AS session_id FROM live r LEFT JOIN whole w ON r.s = w.s
          WHERE w.s IS NULL OR w.last_up <> '' OR NOT regexp_matches(w.word, '^R*(TR+)+$'))"""

SQL = {
    "p2_found": f"""
        SELECT DISTINCT 'message' AS item_kind, {sql_id('session_id')} AS session_id, line_no AS item_no FROM records
        WHERE rec_type IN ('user', 'assistant') AND length({_TEXT}) > 3000
        UNION ALL
        SELECT 'segment', session_id, seg FROM (
          SELECT DISTINCT {sql_id('session_id')} AS session_id, seg, unnest(activity) AS line_no FROM segments) a
        JOIN (SELECT {sql_id('session_id')} AS session_id, line_no, max_by(coalesce(length(message), 0), ingested_at) AS size FROM records GROUP BY ALL) r
        USING (session_id, line_no) GROUP BY session_id, seg HAVING sum(size) > 12000""",
    "p6_found": f"""WITH RECURSIVE {_P6} SELECT session_id FROM dropped""",
    "p6_conversations": f"""WITH RECURSIVE {_P6}, ends AS (SELECT s, max(d) AS top FROM thread GROUP BY s)
        SELECT t.s AS session_id, CAST(top - d AS BIGINT) AS seq, CASE sym WHEN 'T' THEN 'user' ELSE 'assistant' END AS role, txt AS text
        FROM thread t JOIN ends USING (s) WHERE sym <> '-' AND t.s NOT IN (SELECT session_id FROM dropped)""",
}
