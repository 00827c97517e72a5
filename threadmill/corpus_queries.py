"""Queries of the general training-data operators (p1, p3, p4, p5) and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.columns import norm_id
from .operators import drift, hierarchy, nested, references
from .session import cut_lineage, table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.find_orphans(table(spark, d, "records"), table(spark, d, "blocks"), table(spark, d, "removed_records"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_kind", "session_id", "line_no", "ref_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(_orphans(spark, d), "day")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.array_objects(nested.occurrences(table(spark, d, "raw_lines")))


def p3_store(spark: SparkSession, d: str) -> DataFrame:
    return nested.store(table(spark, d, "raw_lines"))


def p3_children(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_rows(nested.occurrences(table(spark, d, "raw_lines")))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Containers and their holders by path, without identities."""
    return nested.child_rows(nested.occurrences(table(spark, d, "raw_lines"))).select("source", "line_no", "obj_path", "kind", "parent_path", "key", "ordinal")


def p3_scalars(spark: SparkSession, d: str) -> DataFrame:
    return nested.scalars(table(spark, d, "raw_lines"))


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    return nested.values(table(spark, d, "raw_lines"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return references.standing(table(spark, d, "records").select("session_id", "uuid", "parent_uuid", "line_no"), table(spark, d, "removed_records"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(hierarchy.tree_nodes(_records(spark, d)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).filter("status = 'cycle'").select(F.col("tree").alias("session_id"), F.col("id").alias("uuid"))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(_records(spark, d))
    return h.select("session_id", "uuid", "parent_uuid", "root", "depth", "status", "n_descendants", "first")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of every record that has one, root first: depth and path_uuid of each step, the record's own included."""
    p = hierarchy.every_path(_resolved(spark, d))
    return p.select(F.col("tree").alias("session_id"), F.col("target").alias("uuid"), "depth", F.col("id").alias("path_uuid"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every record, in and below cycles too."""
    x = hierarchy.descendants(_resolved(spark, d))
    return x.select(F.col("tree").alias("session_id"), F.col("id").alias("uuid"), F.col("descendant").alias("descendant_uuid"))


def p4_leaf_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of every node that a leafUuid names, root first."""
    records = references.standing(table(spark, d, "records").select("session_id", "uuid", "parent_uuid", "line_no", "leaf_uuid"), table(spark, d, "removed_records"))
    leaves = records.select(norm_id("session_id").alias("tree"), norm_id("leaf_uuid").alias("id")).filter("id is not null")
    p = hierarchy.paths(cut_lineage(hierarchy.resolve(hierarchy.tree_nodes(records))), leaves)
    return p.select(F.col("tree").alias("session_id"), F.col("target").alias("leaf_uuid"), "depth", F.col("id").alias("uuid"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.find_changes(table(spark, d, "raw_lines"))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every line, typed, by its newest name at every depth."""
    return drift.unify(table(spark, d, "raw_lines"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_store, p3_children, p3_links, p3_scalars, p3_values, p4_found, p4_hierarchy, p4_paths, p4_descendants, p4_leaf_paths, p5_found, p5_unified)}

_BLANK = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160) || chr(12288)"


def sql_id(c: str) -> str:
    return f"nullif(lower(trim({c}, {_BLANK})), '')"


_P1 = f"""
gone AS (SELECT DISTINCT {sql_id('session_id')} AS session_id, {sql_id('uuid')} AS uuid FROM removed_records),
r AS (SELECT {sql_id('session_id')} AS session_id, line_no, min(ingested_at) AS ts, max_by({sql_id('uuid')}, ingested_at) AS uuid,
             max_by({sql_id('parent_uuid')}, ingested_at) AS parent, max_by(provenance, ingested_at) AS provenance
      FROM records GROUP BY ALL),
live AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.session_id = r.session_id AND g.uuid = r.uuid)),
b AS (SELECT DISTINCT l.session_id, l.line_no, l.ts, {sql_id('b.tool_use_id')} AS use, {sql_id('b.tool_id')} AS call
      FROM blocks b JOIN live l ON {sql_id('b.session_id')} = l.session_id AND b.line_no = l.line_no),
refs AS (
  SELECT 'parent' AS ref_kind, 'uuid' AS domain, session_id AS target, session_id, line_no, ts, parent AS ref_id FROM live
  UNION ALL
  SELECT 'covered', 'uuid', coalesce({sql_id("(provenance).source_session_id")}, ''), session_id, line_no, ts, {sql_id('u')}
  FROM (SELECT *, unnest((provenance).covered_uuids) AS u FROM live)
  UNION ALL
  SELECT 'tool', 'tool', session_id, session_id, line_no, ts, use FROM b),
there AS (
  SELECT 'uuid' AS domain, session_id AS target, uuid AS id, min(ts) AS first_at FROM live WHERE uuid IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'tool', session_id, call, min(ts) FROM b WHERE call IS NOT NULL GROUP BY ALL),
orphans AS (
  SELECT DISTINCT ref_kind, session_id, line_no, ref_id, ts
  FROM refs LEFT JOIN there ON refs.domain = there.domain AND refs.target = there.target AND refs.ref_id = there.id
  WHERE ref_id IS NOT NULL AND (there.id IS NULL OR there.first_at > refs.ts))
"""

_TREE = """tree AS (SELECT source, line_no, t.type, CASE WHEN t.fullkey = '$' THEN '' ELSE replace(substr(t.fullkey, CASE WHEN t.fullkey[2] = '.' THEN 3 ELSE 2 END), '"', '') END AS obj_path,
          CASE WHEN t.fullkey <> '$' THEN CASE WHEN t.path = '$' THEN '' ELSE replace(substr(t.path, 3), '"', '') END END AS parent_path,
          regexp_matches(t.fullkey, '\\[\\d+\\]$') AS in_array, t.key, t.value
        FROM (SELECT source, line_no, CASE WHEN json_valid(raw_json) THEN raw_json::JSON END AS j FROM raw_lines) r, json_tree(r.j) t WHERE json_type(r.j) = 'OBJECT')"""

_P4 = f"""gone AS (SELECT DISTINCT {sql_id('session_id')} AS session_id, {sql_id('uuid')} AS uuid FROM removed_records),
        n AS (SELECT session_id, uuid, arg_max(coalesce(up, ''), line_no) AS up, max(line_no) AS line_no FROM (
              SELECT {sql_id('session_id')} AS session_id, {sql_id('uuid')} AS uuid, {sql_id('parent_uuid')} AS up, line_no FROM records) x
              WHERE uuid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.session_id = x.session_id AND g.uuid = x.uuid) GROUP BY session_id, uuid)"""
_DOWN = """down AS (SELECT session_id, uuid, up, uuid AS root, 0::BIGINT AS depth, CASE WHEN up = '' THEN 'root' ELSE 'missing' END AS status, [line_no] AS way
                 FROM n WHERE up = '' OR NOT EXISTS (SELECT 1 FROM n p WHERE p.session_id = n.session_id AND p.uuid = n.up)
               UNION ALL SELECT n.session_id, n.uuid, n.up, d.root, d.depth + 1, d.status, list_append(d.way, n.line_no) FROM n JOIN down d ON n.session_id = d.session_id AND n.up = d.uuid)"""

SQL = {
    "p1_found": f"WITH {_P1} SELECT ref_kind, session_id, line_no, ref_id FROM orphans",
    "p1_report": f"""WITH {_P1} SELECT CASE WHEN ref_kind = 'tool' THEN 'blocks' ELSE 'records' END AS table_name, ref_kind,
        strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, count(*) AS n_orphans FROM orphans GROUP BY ALL""",
    "p3_found": f"WITH {_TREE} SELECT DISTINCT source, line_no, obj_path FROM tree WHERE type = 'OBJECT' AND in_array",
    "p3_links": f"""WITH {_TREE} SELECT DISTINCT source, line_no, obj_path, lower(type) AS kind, parent_path, CASE WHEN NOT in_array THEN key END AS key, CASE WHEN in_array THEN CAST(key AS INTEGER) END AS ordinal
        FROM tree WHERE type IN ('OBJECT', 'ARRAY')""",
    "p3_values": f"""WITH {_TREE} SELECT DISTINCT source, line_no, parent_path AS obj_path, CASE WHEN NOT in_array THEN key END AS key, CASE WHEN in_array THEN CAST(key AS INTEGER) END AS ordinal,
          CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type, CASE WHEN type <> 'NULL' THEN value->>'$' END AS value
        FROM tree WHERE type NOT IN ('OBJECT', 'ARRAY')""",
    "p4_found": f"""WITH RECURSIVE {_P4},
        good AS (SELECT session_id, uuid FROM n WHERE up = '' OR NOT EXISTS (SELECT 1 FROM n p WHERE p.session_id = n.session_id AND p.uuid = n.up)
                 UNION SELECT n.session_id, n.uuid FROM n JOIN good g ON n.session_id = g.session_id AND n.up = g.uuid)
        SELECT session_id, uuid FROM n WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.session_id = n.session_id AND g.uuid = n.uuid)""",
    "p4_hierarchy": f"""WITH RECURSIVE {_P4}, {_DOWN},
        above AS (SELECT session_id, uuid, up FROM down UNION ALL
                  SELECT a.session_id, a.uuid, d.up FROM above a JOIN down d ON a.session_id = d.session_id AND a.up = d.uuid),
        size AS (SELECT session_id, up AS uuid, count(*) AS n FROM above GROUP BY ALL)
        SELECT n.session_id, n.uuid, nullif(n.up, '') AS parent_uuid, d.root, d.depth, coalesce(d.status, 'cycle') AS status,
          CASE WHEN d.uuid IS NOT NULL THEN coalesce(s.n, 0) END AS n_descendants, d.first
        FROM n LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY session_id, root ORDER BY way) - 1 AS first FROM down) d ON n.session_id = d.session_id AND n.uuid = d.uuid
        LEFT JOIN size s ON s.session_id = n.session_id AND s.uuid = n.uuid""",
    "p4_leaf_paths": f"""WITH RECURSIVE {_P4}, {_DOWN},
        leaf AS (SELECT DISTINCT session_id, {sql_id('leaf_uuid')} AS leaf_uuid FROM (SELECT {sql_id('session_id')} AS session_id, {sql_id('uuid')} AS uuid, leaf_uuid FROM records) x
                 WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.session_id = x.session_id AND g.uuid = x.uuid)),
        path AS (SELECT d.session_id, l.leaf_uuid, d.depth, d.uuid, d.up FROM down d JOIN leaf l ON d.session_id = l.session_id AND d.uuid = l.leaf_uuid
                 UNION ALL SELECT d.session_id, p.leaf_uuid, d.depth, d.uuid, d.up FROM path p JOIN down d ON p.session_id = d.session_id AND p.up = d.uuid)
        SELECT session_id, leaf_uuid, depth, uuid FROM path""",
}
