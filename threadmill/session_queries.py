"""Queries of the transcript operators over records, blocks, segments, documents, events and orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .corpus_queries import sql_id
from .functions.columns_text import truncate, truncate_head_tail
from .operators import provenance as prov, sessions as op
from .functions import jsonops
from .operators import compact, continuation, summarizing
from .plans import transcript as tr
from .session import cut_lineage, table
from .sources import transcripts

TARGET = 1500


def _r(f):
    return lambda s, d: f(table(s, d, "records"))


def _b(f):
    return lambda s, d: f(table(s, d, "blocks"))


def _br(f):
    return lambda s, d: f(table(s, d, "blocks"), table(s, d, "records"))


def head_records(spark: SparkSession, d: str) -> DataFrame:
    return tr.segmented(table(spark, d, "records")).filter("seg < 0").select("session_id", "line_no", "rec_type")


def genuine_user_turns(spark: SparkSession, d: str) -> DataFrame:
    r = tr.records_once(table(spark, d, "records"), tr.first_text().alias("t"))
    return r.filter("is_genuine").select("session_id", "line_no", F.coalesce(F.char_length("t"), F.lit(0)).cast("bigint").alias("n_chars"))


def unknown_types(spark: SparkSession, d: str) -> DataFrame:
    """Types outside the closed vocabularies, in records, blocks and archived raw lines."""
    raw = transcripts.records(table(spark, d, "raw_lines")).groupBy(F.col("rec_type").alias("type")).agg(F.count("*").alias("n"))
    seen = (
        op.record_types(table(spark, d, "records")).filter(~F.col("type").isin(*tr.RECORD_TYPES)).withColumn("of", F.lit("record"))
        .unionByName(op.block_types(table(spark, d, "blocks")).filter(~F.col("type").isin(*tr.BLOCK_TYPES)).withColumn("of", F.lit("block")))
        .unionByName(raw.filter(~F.col("type").isin(*tr.RECORD_TYPES)).withColumn("of", F.lit("raw")))
    )
    return seen.select("of", "type", "n")


def off_path_count(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "records")
    lines = lambda x: x.filter("uuid is not null").groupBy("session_id").agg(F.count("*").alias("n"))
    a = lines(tr.active_path(records)).withColumnRenamed("n", "n_active")
    return lines(tr.records_once(records)).join(a, "session_id", "left").select("session_id", (F.col("n") - F.coalesce("n_active", F.lit(0))).alias("n_off_path"))


def _budget(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    units, fixed = op.plan_units(table(spark, d, "blocks"), table(spark, d, "records"))
    units = cut_lineage(units)
    return op.plan_budget(units, TARGET, fixed=fixed), units, fixed


def budget_plan(spark: SparkSession, d: str) -> DataFrame:
    return _budget(spark, d)[0]


def budget_totals(spark: SparkSession, d: str) -> DataFrame:
    return op.budget_totals(*_budget(spark, d), TARGET)


def work_list(spark: SparkSession, d: str) -> DataFrame:
    return op.work_list(*_budget(spark, d)[:2])


def truncate_head(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", truncate("text", 80).alias("shown"))


def truncate_head_tail_q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", truncate_head_tail("text", 100, 0.6).alias("shown"))


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    """Units with the origin of their summary: explicit ones (of synthetic records that name the unit) go before those
    that an earlier pass cached under the unit's content hash (here: of segments 0 to 2)."""
    records = table(spark, d, "records")
    h = cut_lineage(op.content_hash_parts(records).filter("seg >= 0"))
    cache = h.filter("seg <= 2").select("content_hash").distinct().withColumn("cached", F.lit(True))
    explicit = prov.copies(records).filter("is_synthetic and source is not null").select(F.col("source").alias("session_id"), F.split("part", "[.]")[0].cast("long").alias("seg")).distinct().withColumn("explicit", F.lit(True))
    return h.join(cache, "content_hash", "left").join(explicit, ["session_id", "seg"], "left").select("session_id", "seg", F.when(F.col("explicit"), "explicit").when(F.col("cached"), "cached").alias("origin"))


def cached_summary_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _summaries(spark, d)


def cache_report(spark: SparkSession, d: str) -> DataFrame:
    return _summaries(spark, d).groupBy("session_id").agg(
        F.count_if(F.col("origin") == "explicit").alias("n_explicit"), F.count_if(F.col("origin") == "cached").alias("n_cached"), F.count_if(F.col("origin").isNull()).alias("n_missing")
    )


def uuid_prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the first eight characters of each session's least uuid find in it, and whether they are ground copies."""
    c = prov.copies(table(spark, d, "records"))
    sel = c.groupBy("session_id").agg(F.min(F.substring("uuid", 1, 8)).alias("selector"))
    return c.withColumn("selector", F.substring("uuid", 1, 8)).join(sel, ["session_id", "selector"]).select("session_id", "selector", "line_no", "uuid", "is_ground")


def lineage_latest(spark: SparkSession, d: str) -> DataFrame:
    return prov.lineage_latest(cut_lineage(prov.session_lineage(table(spark, d, "records"))))


def superseded(spark: SparkSession, d: str) -> DataFrame:
    return op.superseded(cut_lineage(prov.session_lineage(table(spark, d, "records"))))


def _c(f):
    return lambda s, d: f(cut_lineage(prov.copies(table(s, d, "records"))))


def selectors(c: DataFrame) -> DataFrame:
    """For every session with synthetic records: its part keys, two ordinals, and prefixes of what its first one covers."""
    s = c.filter("is_synthetic")
    return (
        s.select("session_id", F.col("part").alias("selector")).filter("selector is not null")
        .union(s.select("session_id", F.explode(F.array(F.lit("1"), F.lit("900"), F.lit("no such"))))).union(s.select("session_id", F.explode(F.transform("covered", lambda u: F.substring(u, 1, 12))))).distinct()
    )


def epoch_digests(spark: SparkSession, d: str) -> DataFrame:
    """The digest of the raw activity behind each synthetic record all of whose sources can be read."""
    lines = prov.epoch_lines(table(spark, d, "records"), table(spark, d, "blocks"))
    g = lines.groupBy("session_id", "line_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("way", "line"))), lambda x: x["line"]), "\n").alias("t"), F.count("*").alias("n_lines"))
    return g.select("session_id", "line_no", "n_lines", truncate(F.concat(F.lit(prov.EPOCH_HEAD + "\n"), "t"), prov.DIGEST).alias("digest"))


def segment_index(spark: SparkSession, d: str) -> DataFrame:
    return op.segment_index(table(spark, d, "blocks"), table(spark, d, "records"))


def worksheet(spark: SparkSession, d: str) -> DataFrame:
    """What a summarizer is given of each segment, as one JSON text: its turn, flags, index, tokens and digest."""
    blocks, records = table(spark, d, "blocks"), table(spark, d, "records")
    doc = (
        op.unit_digest(blocks, records).join(op.pinned_segments(records), ["session_id", "seg"]).join(op.segment_summary(records).select("session_id", "seg", "tokens"), ["session_id", "seg"])
        .join(op.segment_index(blocks, records), ["session_id", "seg"], "left")
    )
    return doc.select("session_id", "seg", F.to_json(F.struct(F.col("seg").alias("index"), "needs_summary", "kept_verbatim", F.col("tokens").alias("approx_tokens"), "files", "tool_counts", "error_count", "digest")).alias("doc"))


def unit_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of all units that need one, batched and routed, by the default summarizer."""
    blocks, records = table(spark, d, "blocks"), table(spark, d, "records")
    need = op.pinned_segments(records).filter("needs_summary").select("session_id", "seg")
    units = op.unit_digest(blocks, records).join(need, ["session_id", "seg"]).join(op.salience(blocks, records), ["session_id", "seg"])
    return summarizing.summarize_units(cut_lineage(units), escalate_with="large")


def active_goals_raw(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.active_goals(table(spark, d, "raw_lines"))


def scan_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by size, largest first."""
    return op.session_scan(table(spark, d, "records")).select("session_id", "tokens", "n_records").orderBy(F.desc("tokens"), "session_id")


def rehydrate_dump(spark: SparkSession, d: str) -> DataFrame:
    """The raw lines behind every synthetic record."""
    records = table(spark, d, "records")
    return transcripts.dump(prov.expand(prov.copies(records)), _lines(spark, d))


def verify_twins(spark: SparkSession, d: str) -> DataFrame:
    """Whether masked twins have the genuine turns of their sources, in order and word for word."""
    lines = cut_lineage(_lines(spark, d))
    return compact.verify_turns(cut_lineage(compact.assemble(lines, "mask")), lines)


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    """The envelope of every archived line that is a JSON object."""
    return transcripts.records(table(spark, d, "raw_lines")).select(
        "source", "line_no", "session_id", "rec_type", "uuid", "parent_uuid", "content_kind", "is_meta", "is_compact_summary", "has_source_tool", "is_synthetic", "is_masked", "leaf_uuid", "last_prompt"
    )


def raw_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The content blocks of archived user and assistant lines."""
    return transcripts.blocks(table(spark, d, "raw_lines")).select("source", "line_no", "pos", "block_type", "text", "tool_id", "tool_name", "tool_use_id", "is_error")


def masked_lines(spark: SparkSession, d: str) -> DataFrame:
    """What masking makes of every record: its status, and its estimated length before and after."""
    def masked(record: dict) -> tuple:
        kind, out = jsonops.mask_record(record)
        return kind, jsonops.est_len(record), 0 if out is None else jsonops.est_len(out)

    return jsonops.apply_records(_lines(spark, d), masked, "source string, line_no long, status string, est_len long, masked_len long")


def est_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of every archived session: canonical bytes with images at their weight, a quarter, floored once."""
    return compact.est_tokens(table(spark, d, "raw_lines"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """The records table as lines of transcript files."""
    return transcripts.render(table(spark, d, "records"))


def _compacted(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        lines = cut_lineage(_lines(spark, d))
        summaries = cut_lineage(compact.summarize(continuation.digests_of(lines))) if mode != "mask" else None
        plan = None
        if mode == "budget":
            units, fixed = op.plan_units(table(spark, d, "blocks"), table(spark, d, "records"), summaries=summaries)
            plan = cut_lineage(op.plan_budget(cut_lineage(units), TARGET, fixed=fixed))
        return compact.verify_output(cut_lineage(compact.assemble(lines, mode, summaries=summaries, plan=plan, preamble=True)))

    return run


def summary_batches(spark: SparkSession, d: str) -> DataFrame:
    return op.batches(op.segment_summary(table(spark, d, "records")).filter("seg >= 0"), "tokens", 4, 2000)


def summary_waves(spark: SparkSession, d: str) -> DataFrame:
    """Batches run in waves of three: session_id, batch, wave, n_units."""
    return summary_batches(spark, d).groupBy("session_id", "batch").agg(F.count("*").alias("n_units")).select("session_id", "batch", F.floor(F.col("batch") / 3).alias("wave"), "n_units")


def split_parts(spark: SparkSession, d: str) -> DataFrame:
    return op.split_parts(table(spark, d, "records"), table(spark, d, "blocks"))


def verify_checks(spark: SparkSession, d: str) -> DataFrame:
    return op.verify(table(spark, d, "records"), table(spark, d, "blocks"))


def active_goal(spark: SparkSession, d: str) -> DataFrame:
    return op.active_goal(table(spark, d, "events"))


QUERIES = {
    "segment_summary": _r(op.segment_summary),
    "head_records": head_records,
    "genuine_user_turns": genuine_user_turns,
    "record_type_histogram": _r(op.record_types),
    "block_type_histogram": _b(op.block_types),
    "unknown_types": unknown_types,
    "active_path": _r(tr.active_path),
    "off_path_count": off_path_count,
    "tool_result_names": _br(lambda b, r: op.tool_result_names(b, r).select("session_id", "seg", "line_no", "pos", "tool_use_id", "tool")),
    "dangling_tool_use": _b(op.dangling_tool_use),
    "orphan_tool_result": _b(op.orphan_tool_result),
    "graded_results": _br(op.graded_results),
    "duplicate_results": _br(lambda b, r: op.graded_results(b, r).filter("status = 'duplicate'").select("session_id", "seg", "line_no", "pos")),
    "derived_files": _br(op.derived_files),
    "derived_tool_counts": _br(op.derived_tool_counts),
    "derived_commands": _br(op.derived_commands),
    "derived_errors": _br(op.derived_errors),
    "chain_check": _r(op.chain_check),
    "rechain": _r(op.rechain),
    "keep_tail": _r(op.keep_tail),
    "pinned_segments": _r(op.pinned_segments),
    "suffix_file_overlap": _br(op.file_overlap),
    "salience": _br(lambda b, r: op.salience(b, r).select("session_id", "seg", "is_error", F.round(F.col("salience").cast("double"), 4).alias("salience"))),
    "mask_cost": _br(op.mask_costs),
    "budget_plan": budget_plan,
    "budget_totals": budget_totals,
    "truncate_head": truncate_head,
    "truncate_head_tail": truncate_head_tail_q,
    "render_activity": _br(op.render_activity),
    "unit_digest": _br(op.unit_digest),
    "content_hash": _r(op.content_hash_parts),
    "cached_summary_lookup": cached_summary_lookup,
    "lineage_latest": lineage_latest,
    "superseded": superseded,
    "uuid_prefix_lookup": uuid_prefix_lookup,
    "rehydrate_expand": _r(op.rehydrate),
    "verify_checks": verify_checks,
    "verify_fidelity": _r(op.verify_fidelity),
    "split_parts": split_parts,
    "summary_waves": summary_waves,
    "work_list": work_list,
    "cache_report": cache_report,
    "segment_index": segment_index,
    "synth_sources": _c(prov.synth_sources),
    "provenance_files": _c(prov.provenance_files),
    "ground_truth": _c(prov.ground_truth),
    "nth_synthetic": _c(lambda c: prov.nth_synthetic(c)),
    "rehydrate_full": _c(prov.expand),
    "rehydrate_select": _c(lambda c: prov.rehydrate_select(c, selectors(c))),
    "epoch_digests": epoch_digests,
    "worksheet": worksheet,
    "unit_summaries": unit_summaries,
    "active_goals_raw": active_goals_raw,
    "scan_ranked": scan_ranked,
    "rehydrate_dump": rehydrate_dump,
    "verify_twins": verify_twins,
    "raw_records": raw_records,
    "raw_blocks": raw_blocks,
    "masked_lines": masked_lines,
    "est_tokens": est_tokens,
    "compact_mask": _compacted("mask"),
    "compact_summarize": _compacted("summarize"),
    "compact_budget": _compacted("budget"),
    "summary_batches": summary_batches,
    "active_goal": active_goal,
    "session_scan": _r(op.session_scan),
}

_NB = lambda c: f"regexp_matches(coalesce({c}, ''), '\\S')"
_BLOCKS = """from_json(json_extract(message, '$.content'), '[{"type":"VARCHAR","text":"VARCHAR"}]')"""
_FIRST = f"""CASE content_kind WHEN 'string' THEN json_extract_string(message, '$.content')
    WHEN 'array' THEN list_filter({_BLOCKS}, lambda b: b.type = 'text' AND b.text IS NOT NULL)[1].text END"""
_USER = f"""CASE content_kind WHEN 'string' THEN json_extract_string(message, '$.content')
    WHEN 'array' THEN array_to_string(list_transform(list_filter({_BLOCKS}, lambda b: b.type = 'text' AND b.text IS NOT NULL), lambda b: b.text), chr(10)) END"""
_OWN = "rec_type = 'user' AND NOT coalesce(is_meta, false) AND NOT coalesce(is_compact_summary, false) AND NOT coalesce(has_source_tool, false)"
_R = f"""
r AS (SELECT session_id, line_no, rec_type, uuid, parent_uuid, leaf_uuid, n_bytes, t, ut, own, sys, is_preamble, is_compact_summary, is_synthetic, is_masked, is_ledger, provenance, h,
        own AND CASE content_kind WHEN 'string' THEN true WHEN 'array' THEN NOT has_result ELSE false END
        AND NOT coalesce(starts_with(t, '{tr.TEAMMATE}'), false) AND NOT coalesce(starts_with(t, '{tr.NOTIFICATION}'), false) AS is_genuine
      FROM (SELECT {sql_id('session_id')} AS session_id, line_no, coalesce(rec_type, '') AS rec_type, {sql_id('uuid')} AS uuid, {sql_id('parent_uuid')} AS parent_uuid,
              {sql_id('leaf_uuid')} AS leaf_uuid, CAST(coalesce(strlen(message), 0) AS BIGINT) AS n_bytes, {_FIRST} AS t, {_USER} AS ut, json_extract_string(message, '$.content') AS sys, coalesce(is_preamble, false) AS is_preamble, content_kind, provenance, ({_OWN}) AS own,
              coalesce(len(list_filter({_BLOCKS}, lambda b: b.type = 'tool_result')) > 0, false) AS has_result,
              sha256(coalesce(rec_type, '') || chr(31) || coalesce(message, '')) AS h,
              coalesce(is_compact_summary, false) AS is_compact_summary, coalesce(is_synthetic, false) AS is_synthetic, coalesce(is_masked, false) AS is_masked,
              coalesce(is_ledger, false) AS is_ledger
            FROM (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY {sql_id('session_id')}, line_no ORDER BY ingested_at DESC) = 1))),
g AS (SELECT *, CAST(sum(CASE WHEN is_genuine THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no) - 1 AS BIGINT) AS seg FROM r)"""
_B = f"""
b AS (SELECT DISTINCT {sql_id('session_id')} AS session_id, line_no, CAST(pos AS BIGINT) AS pos, block_type, text, {sql_id('tool_id')} AS tool_id, tool_name, tool_input,
        {sql_id('tool_use_id')} AS tool_use_id, coalesce(is_error, false) AS is_error, result_text, coalesce(image_len, 0) AS image_len FROM blocks),
bs AS (SELECT b.*, g.seg, g.rec_type, g.is_genuine, g.is_compact_summary, g.own, g.t FROM b JOIN g ON b.session_id = g.session_id AND b.line_no = g.line_no)"""
_RES = f"""{_R}, {_B},
uses AS (SELECT session_id, seg, tool_id, arg_max(coalesce(tool_name, ''), line_no * 100000 + pos) AS tool FROM bs WHERE block_type = 'tool_use' AND tool_id IS NOT NULL GROUP BY ALL),
res AS (SELECT bs.session_id, bs.seg, bs.line_no, bs.pos, bs.tool_use_id, coalesce(u.tool, '') AS tool, is_error, coalesce(result_text, '') AS result
        FROM bs LEFT JOIN uses u ON bs.session_id = u.session_id AND bs.seg = u.seg AND bs.tool_use_id = u.tool_id WHERE block_type = 'tool_result')"""


def _cut(c: str, n: int, ratio: float) -> str:
    h = f"CAST(floor(CAST({n} AS FLOAT) * CAST({ratio} AS FLOAT)) AS INTEGER)"
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE left({c}, {h}) || chr(10) || '…[' || CAST(length({c}) - {n} AS VARCHAR) || ' chars elided]…' || chr(10) || right({c}, {n} - {h}) END"


def _head(c: str, n: int | str) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE left({c}, {n}) || '…[+' || CAST(length({c}) - {n} AS VARCHAR) || ' chars]' END"


_GRADED = f"""{_RES},
graded AS (SELECT session_id, seg, line_no, pos, tool, result,
    CASE WHEN is_error THEN 'error' WHEN NOT {_NB('result')} THEN 'empty'
         WHEN row_number() OVER (PARTITION BY session_id, seg, tool, result, NOT is_error AND {_NB('result')} ORDER BY line_no, pos) > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM res),
shown AS (SELECT session_id, seg, line_no, pos, tool, status, CAST(length(result) AS BIGINT) AS chars,
    CASE status WHEN 'error' THEN {_cut('result', 4000, 0.5)} WHEN 'empty' THEN '[empty result]' WHEN 'duplicate' THEN '[identical to an earlier result in this segment]'
         ELSE {_cut('result', 1500, 0.6)} END AS shown FROM graded)"""
_FILES = f"""{_R}, {_B},
roles AS (SELECT session_id, seg, path, role, min(line_no * 100000 + pos) AS first FROM (
    SELECT session_id, seg, line_no, pos, coalesce(json_extract_string(tool_input, '$.file_path'), json_extract_string(tool_input, '$.notebook_path')) AS path,
      CASE WHEN tool_name = 'Read' THEN 'read' WHEN tool_name IN ('Edit', 'NotebookEdit') THEN 'edited' WHEN tool_name = 'Write' THEN 'written' END AS role
    FROM bs WHERE block_type = 'tool_use') WHERE path IS NOT NULL AND role IS NOT NULL GROUP BY ALL),
files AS (SELECT session_id, seg, path, string_agg(role, ',' ORDER BY first) AS roles FROM roles GROUP BY ALL)"""
_OVERLAP = f"""{_FILES},
lasts AS (SELECT session_id, path, max(seg) AS last_seg FROM files WHERE seg >= 0 GROUP BY ALL),
overlap AS (SELECT f.session_id, f.seg, count(*) AS n_files, CAST(count(*) FILTER (WHERE l.last_seg > f.seg) AS BIGINT) AS n_later
    FROM files f JOIN lasts l ON f.session_id = l.session_id AND f.path = l.path WHERE f.seg >= 0 GROUP BY ALL)"""
_MARKERS = "'no', 'actually', 'wait', 'instead', 'revert', 'don''t', 'dont', 'stop', 'undo', 'wrong'"
_SEGS = f"""
segs AS (SELECT session_id, seg, bool_or(is_compact_summary) AS has_summary, bool_or(is_ledger) AS has_ledger, bool_or(is_synthetic) AS has_synthetic,
    bool_or(NOT is_genuine AND uuid IS NOT NULL) AS has_activity, sum(CASE WHEN is_genuine THEN n_bytes ELSE 0 END) AS turn_bytes, sum(CASE WHEN is_genuine THEN 0 ELSE n_bytes END) AS activity_bytes,
    bool_or(is_genuine AND coalesce(lower(regexp_extract(ut, '^\\s*([\\p{{L}}\\p{{N}}'']*)', 1)) IN ({_MARKERS}), false)) AS corrects,
    row_number() OVER (PARTITION BY session_id ORDER BY seg DESC) AS from_end FROM g WHERE seg >= 0 GROUP BY session_id, seg)"""
_SAL = f"""{_OVERLAP}, {_SEGS},
err AS (SELECT session_id, seg, count(*) FILTER (WHERE block_type = 'tool_result' AND is_error) AS error_count FROM bs GROUP BY ALL),
sal AS (SELECT s.session_id, s.seg, coalesce(e.error_count, 0) > 0 AS is_error, has_summary OR has_ledger OR has_synthetic OR from_end <= 1 AS kept,
    least(CAST(0.1 AS FLOAT) + CASE WHEN coalesce(e.error_count, 0) > 0 THEN CAST(0.4 AS FLOAT) ELSE CAST(0 AS FLOAT) END
      + CAST(0.3 AS FLOAT) * coalesce(CAST(n_later AS FLOAT) / CAST(greatest(n_files, 1) AS FLOAT), CAST(0 AS FLOAT))
      + CASE WHEN coalesce(lead(corrects) OVER (PARTITION BY s.session_id ORDER BY s.seg), false) THEN CAST(0.3 AS FLOAT) ELSE CAST(0 AS FLOAT) END, CAST(1 AS FLOAT)) AS salience
  FROM segs s LEFT JOIN err e ON s.session_id = e.session_id AND s.seg = e.seg LEFT JOIN overlap o ON s.session_id = o.session_id AND s.seg = o.seg)"""
_SZ = lambda c: f"coalesce(strlen({c}), 0)"
_WHOLE = f"({_SZ('text')} + {_SZ('tool_input')} + {_SZ('result_text')} + least(image_len, {tr.IMAGE_CHARS}))"
_MASK = f"""
costs AS (SELECT session_id, seg, CAST(floor(sum({_WHOLE}) / 4) AS BIGINT) AS verbatim_tokens, CAST(floor(sum(coalesce(
    CASE WHEN block_type = 'thinking' AND NOT {_NB('text')} THEN 0
         WHEN block_type = 'tool_result' THEN CASE WHEN is_error THEN least({_SZ('result_text')}, {tr.ERROR_KEPT}) WHEN length(result_text) <= {tr.RESULT_KEPT} THEN {_SZ('result_text')} ELSE 60 END
         WHEN block_type = 'tool_use' THEN least({_SZ('tool_input')}, {tr.INPUT_KEPT}) ELSE {_WHOLE} END, 0)) / 4) AS BIGINT) AS masked_tokens
  FROM bs GROUP BY session_id, seg)"""
_PLAN = f"""{_SAL}, {_MASK},
units AS (SELECT s.session_id, s.seg, s.salience, s.is_error, coalesce(verbatim_tokens, 0) AS cost_v, least(coalesce(masked_tokens, 0), coalesce(verbatim_tokens, 0)) AS cost_m,
    least(400, least(coalesce(masked_tokens, 0), coalesce(verbatim_tokens, 0))) AS cost_s FROM sal s LEFT JOIN costs c ON s.session_id = c.session_id AND s.seg = c.seg WHERE NOT kept),
sv AS (SELECT *, cost_v - cost_m AS m1, CASE WHEN cost_v - cost_m > 0 THEN cost_v - cost_m WHEN NOT is_error THEN cost_v - cost_s ELSE 0 END AS s1,
    CASE WHEN cost_v - cost_m > 0 AND NOT is_error THEN cost_m - cost_s ELSE 0 END AS s2 FROM units),
steps AS (SELECT session_id, seg, 1 AS step, s1 AS saving, CAST(s1 AS FLOAT) * (CAST(1 AS FLOAT) - salience) AS eff, CASE WHEN m1 > 0 THEN 1 ELSE 2 END AS t FROM sv
    UNION ALL SELECT session_id, seg, 2, s2, least(CAST(s2 AS FLOAT) * (CAST(1 AS FLOAT) - salience), CAST(s1 AS FLOAT) * (CAST(1 AS FLOAT) - salience)), 2 FROM sv),
saved AS (SELECT *, coalesce(sum(saving) OVER (PARTITION BY session_id ORDER BY eff DESC, seg, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved FROM steps WHERE saving > 0),
fixed AS (SELECT session_id, CAST(sum(floor(turn_bytes / 4) + CASE WHEN has_summary OR has_ledger OR has_synthetic OR from_end <= 1 THEN floor(activity_bytes / 4) ELSE 0 END) AS BIGINT) AS fixed FROM segs GROUP BY ALL),
total AS (SELECT session_id, sum(cost_v) + max(fixed) AS total FROM units JOIN fixed USING (session_id) GROUP BY ALL),
best AS (SELECT s.session_id, s.seg, max(t) AS t FROM saved s JOIN total USING (session_id) WHERE total - saved > {TARGET} GROUP BY ALL),
plan AS (SELECT u.session_id, u.seg, CAST(coalesce(t, 0) AS INTEGER) AS treatment, CAST(CASE coalesce(t, 0) WHEN 0 THEN cost_v WHEN 1 THEN cost_m ELSE cost_s END AS BIGINT) AS cost
    FROM units u LEFT JOIN best b ON u.session_id = b.session_id AND u.seg = b.seg)"""
_NODES = """
n AS (SELECT session_id, uuid, arg_max(coalesce(parent_uuid, ''), line_no) AS up, max(line_no) AS line_no FROM r WHERE uuid IS NOT NULL GROUP BY ALL),
lp AS (SELECT session_id, arg_max(coalesce(leaf_uuid, ''), line_no) AS leaf FROM r WHERE rec_type = 'last-prompt' GROUP BY ALL),
leafs AS (SELECT n.session_id, coalesce(max(CASE WHEN n.uuid = lp.leaf THEN n.uuid END), max_by(n.uuid, n.line_no)) AS leaf FROM n LEFT JOIN lp ON n.session_id = lp.session_id GROUP BY n.session_id),
path AS (SELECT n.session_id, n.uuid, n.up, n.line_no FROM n JOIN leafs l ON n.session_id = l.session_id AND n.uuid = l.leaf
    UNION SELECT n.session_id, n.uuid, n.up, n.line_no FROM path p JOIN n ON n.session_id = p.session_id AND n.uuid = p.up),
active AS (SELECT session_id, line_no, uuid FROM path UNION ALL SELECT session_id, line_no, uuid FROM r WHERE uuid IS NULL)"""
_PAIR = f"""{_B.split(',' + chr(10) + 'bs AS')[0]},
pairs AS (SELECT session_id, id, min(use_at) AS first_use, max(result_at) AS last_result FROM (
    SELECT session_id, CASE WHEN block_type = 'tool_use' THEN tool_id ELSE tool_use_id END AS id,
      CASE WHEN block_type = 'tool_use' THEN line_no * 100000 + pos END AS use_at, CASE WHEN block_type = 'tool_result' THEN line_no * 100000 + pos END AS result_at
    FROM b WHERE block_type IN ('tool_use', 'tool_result')) WHERE id IS NOT NULL GROUP BY session_id, id),
dangling AS (SELECT session_id, id FROM pairs WHERE first_use IS NOT NULL AND (last_result IS NULL OR last_result <= first_use)),
orphaned AS (SELECT session_id, id FROM pairs WHERE last_result IS NOT NULL AND (first_use IS NULL OR first_use >= last_result))"""
_CHAIN = "chain AS (SELECT session_id, line_no, uuid, parent_uuid, lag(uuid) OVER (PARTITION BY session_id ORDER BY line_no) AS before FROM r WHERE uuid IS NOT NULL)"
_PROV = f"""
c AS (SELECT session_id, line_no, uuid, is_synthetic, NOT is_synthetic AND NOT is_masked AS is_ground, {sql_id("(provenance).source_session_id")} AS source, trim((provenance).part) AS part, (provenance).covered_uuids AS covered FROM r WHERE uuid IS NOT NULL),
hop AS (SELECT DISTINCT session_id, source FROM c WHERE source <> session_id AND source IN (SELECT session_id FROM c)),
far AS (SELECT session_id, source, 1 AS distance FROM hop UNION SELECT f.session_id, h.source, distance + 1 FROM far f JOIN hop h ON h.session_id = f.source WHERE distance < 10 AND h.source <> f.session_id),
files AS (SELECT session_id, source, min(distance) AS distance FROM far GROUP BY ALL),
truth AS (SELECT d.session_id, d.uuid, c.session_id AS from_session, c.line_no AS from_line, c.is_ground FROM (SELECT DISTINCT session_id, uuid FROM c WHERE NOT is_ground) d
  JOIN (SELECT session_id, source, distance FROM files UNION ALL SELECT DISTINCT session_id, session_id, 0 FROM c) f ON d.session_id = f.session_id JOIN c ON c.session_id = f.source AND c.uuid = d.uuid
  QUALIFY row_number() OVER (PARTITION BY d.session_id, d.uuid ORDER BY c.is_ground DESC, distance, c.session_id, c.line_no) = 1)"""
_LINEAGE = f"""{_PROV.split(',' + chr(10) + 'hop AS')[0]},
m AS (SELECT {sql_id('session_id')} AS child, max(ingested_at) AS mtime, min(ingested_at) AS ts FROM records GROUP BY 1),
p AS (SELECT session_id AS child, min_by(source, (line_no, source)) AS parent FROM c WHERE source IS NOT NULL GROUP BY 1),
l AS (SELECT m.child, p.parent, m.ts, m.mtime, q.mtime AS p_mtime FROM m LEFT JOIN p ON m.child = p.child LEFT JOIN m q ON q.child = p.parent)"""
_ORIGIN = f"""{_PROV.split(',' + chr(10) + 'hop AS')[0]},
origin AS (SELECT session_id, seg, CASE WHEN EXISTS (SELECT 1 FROM c WHERE is_synthetic AND c.source = hashes.session_id AND split_part(c.part, '.', 1) = CAST(seg AS VARCHAR)) THEN 'explicit'
    WHEN content_hash IN (SELECT content_hash FROM hashes WHERE seg BETWEEN 0 AND 2) THEN 'cached' END AS origin FROM hashes WHERE seg >= 0)"""
_BATCH = """
u AS (SELECT session_id, seg, CAST(floor(sum(n_bytes) / 4) AS BIGINT) AS size, row_number() OVER (PARTITION BY session_id ORDER BY seg) AS k FROM g WHERE seg >= 0 GROUP BY session_id, seg),
fold AS (SELECT session_id, seg, k, 1 AS n, size AS total, 0::BIGINT AS batch FROM u WHERE k = 1
  UNION ALL SELECT u.session_id, u.seg, u.k, CASE WHEN f.n = 4 OR f.total + u.size > 2000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n = 4 OR f.total + u.size > 2000 THEN u.size ELSE f.total + u.size END,
    f.batch + CASE WHEN f.n = 4 OR f.total + u.size > 2000 THEN 1 ELSE 0 END FROM fold f JOIN u ON u.session_id = f.session_id AND u.k = f.k + 1)"""


def _close(held: str, pending: str, x: str) -> str:
    """What a part holds after a row, the calls then open, and whether it closes (1)."""
    now = f"({held} + {x}.n_bytes // 4)"
    open_ = f"list_filter(list_distinct(list_concat({pending}, {x}.opened)), lambda i: NOT list_contains({x}.closed, i))"
    return f"{now} AS held, {open_} AS pending, CASE WHEN {x}.whole // 4 > 2000 AND len({open_}) = 0 AND {now} >= CASE WHEN {x}.ends THEN 200 ELSE 1000 END THEN 1 ELSE 0 END AS shut"


_DELIVERED = f"own AND (coalesce(starts_with(t, '{tr.TEAMMATE}'), false) OR coalesce(starts_with(t, '{tr.NOTIFICATION}'), false))"
_RENDER = f"""{_GRADED},
items AS (SELECT session_id, seg, line_no, pos, CASE WHEN block_type = 'text' THEN 'assistant_text' ELSE block_type END AS kind, CASE WHEN block_type = 'tool_use' THEN coalesce(tool_name, '') ELSE '' END AS tool,
    '' AS status, 0::BIGINT AS chars, CASE WHEN block_type = 'tool_use' THEN coalesce(tool_input, 'null') ELSE coalesce(text, '') END AS shown
    FROM bs WHERE NOT is_genuine AND rec_type = 'assistant' AND block_type IN ('text', 'thinking', 'tool_use')
  UNION ALL SELECT s.session_id, s.seg, s.line_no, s.pos, 'tool_result', s.tool, s.status, s.chars, s.shown FROM shown s JOIN g ON s.session_id = g.session_id AND s.line_no = g.line_no
    WHERE g.rec_type = 'user' AND NOT g.is_compact_summary AND NOT g.is_genuine AND NOT ({_DELIVERED})
  UNION ALL SELECT session_id, seg, line_no, 0, CASE WHEN rec_type = 'system' THEN 'system' WHEN is_compact_summary THEN 'compact_summary' ELSE 'delivered_message' END, '',
    CASE WHEN rec_type = 'user' AND NOT is_compact_summary THEN CASE WHEN starts_with(t, '{tr.NOTIFICATION}') THEN 'task_notification' ELSE 'teammate_message' END ELSE '' END,
    CASE WHEN rec_type = 'user' AND NOT is_compact_summary THEN length(t) ELSE 0 END,
    CASE WHEN rec_type = 'system' THEN {_head("coalesce(sys, '')", 400)} WHEN is_compact_summary THEN {_head("coalesce(ut, '')", 4000)} ELSE {_cut('t', 8000, 0.7)} END
    FROM g WHERE NOT is_genuine AND (rec_type = 'system' OR rec_type = 'user' AND (is_compact_summary OR {_DELIVERED})))"""
_js = lambda j, k: f"CASE WHEN json_type({j}->'$.{k}') = 'VARCHAR' THEN {j}->>'$.{k}' END"
_true = lambda k: f"coalesce(json_type(j->'$.{k}') = 'BOOLEAN' AND (j->>'$.{k}') = 'true', false)"
_RAW = f"""raw_r AS (SELECT source, line_no, {_js('j', 'sessionId')} AS session_id, coalesce({_js('j', 'type')}, '') AS rec_type, {_js('j', 'uuid')} AS uuid, {_js('j', 'parentUuid')} AS parent_uuid,
    CASE json_type(j->'$.message.content') WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' ELSE CASE WHEN json_type(j->'$.message.content') IS NULL THEN 'missing' ELSE 'other' END END AS content_kind,
    {_true('isMeta')} AS is_meta, {_true('isCompactSummary')} AS is_compact_summary, json_exists(j, '$.sourceToolAssistantUUID') AS has_source_tool, {_true('recompactSynthetic')} AS is_synthetic,
    {_true('recompactMasked')} AS is_masked, {_js('j', 'leafUuid')} AS leaf_uuid, {_js('j', 'lastPrompt')} AS last_prompt, j
  FROM (SELECT source, line_no, CASE WHEN json_valid(raw_json) THEN raw_json::JSON END AS j FROM raw_lines) WHERE json_type(j) = 'OBJECT')"""
_HASH = """h AS (SELECT *, CAST(sum(CASE WHEN is_genuine THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no) - 1 AS BIGINT) AS seg FROM r
  WHERE NOT is_preamble AND EXISTS (SELECT 1 FROM active a WHERE a.session_id = r.session_id AND a.line_no = r.line_no)),
hashes AS (SELECT session_id, seg, CAST(sum(CAST(('0x' || substr(md5(CAST(line_no AS VARCHAR) || ':' || h), 1, 12)) AS UBIGINT)) AS VARCHAR) AS content_hash FROM h GROUP BY ALL)"""

SQL = {
    "segment_summary": f"WITH {_R} SELECT session_id, seg, count(*) AS n_records, CAST(floor(sum(n_bytes) / 4) AS BIGINT) AS tokens FROM g GROUP BY ALL",
    "head_records": f"WITH {_R} SELECT session_id, line_no, rec_type FROM g WHERE seg < 0",
    "genuine_user_turns": f"WITH {_R} SELECT session_id, line_no, CAST(coalesce(length(t), 0) AS BIGINT) AS n_chars FROM r WHERE is_genuine",
    "record_type_histogram": f"WITH {_R} SELECT rec_type AS type, count(*) AS n FROM r GROUP BY ALL",
    "block_type_histogram": f"WITH {_R}, {_B} SELECT block_type AS type, count(*) AS n FROM b WHERE block_type IS NOT NULL GROUP BY ALL",
    "unknown_types": f"""WITH {_R}, {_B}, {_RAW} SELECT 'record' AS "of", rec_type AS type, count(*) AS n FROM r WHERE rec_type NOT IN {tr.RECORD_TYPES} GROUP BY ALL
        UNION ALL SELECT 'block', block_type, count(*) FROM b WHERE block_type NOT IN {tr.BLOCK_TYPES} GROUP BY ALL
        UNION ALL SELECT 'raw', rec_type, count(*) FROM raw_r WHERE rec_type NOT IN {tr.RECORD_TYPES} GROUP BY ALL""",
    "raw_records": f"WITH {_RAW} SELECT * EXCLUDE (j) FROM raw_r",
    "raw_blocks": f"""WITH {_RAW}, c AS (SELECT source, line_no, j->'$.message.content' AS body FROM raw_r WHERE rec_type IN ('user', 'assistant') AND json_type(j->'$.message') = 'OBJECT'),
        x AS (SELECT source, line_no, 0 AS pos, json_object('type', 'text', 'text', body) AS k FROM c WHERE json_type(body) = 'VARCHAR'
              UNION ALL SELECT source, line_no, CAST(unnest(range(len(l))) AS INTEGER), unnest(l) FROM (SELECT source, line_no, CAST(body AS JSON[]) AS l FROM c WHERE json_type(body) = 'ARRAY'))
        SELECT source, line_no, pos, {_js('k', 'type')} AS block_type, CASE WHEN {_js('k', 'type')} = 'thinking' THEN {_js('k', 'thinking')} ELSE {_js('k', 'text')} END AS text, {_js('k', 'id')} AS tool_id, {_js('k', 'name')} AS tool_name,
          {_js('k', 'tool_use_id')} AS tool_use_id, CASE WHEN json_type(k->'$.is_error') = 'BOOLEAN' THEN CAST(k->>'$.is_error' AS BOOLEAN) END AS is_error FROM x WHERE json_type(k) = 'OBJECT'""",
    "active_path": f"WITH RECURSIVE {_R}, {_NODES} SELECT * FROM active",
    "off_path_count": f"""WITH RECURSIVE {_R}, {_NODES}, a AS (SELECT session_id, count(*) AS n FROM active WHERE uuid IS NOT NULL GROUP BY ALL)
        SELECT x.session_id, x.n - coalesce(a.n, 0) AS n_off_path FROM (SELECT session_id, count(*) AS n FROM r WHERE uuid IS NOT NULL GROUP BY ALL) x LEFT JOIN a USING (session_id)""",
    "tool_result_names": f"WITH {_RES} SELECT session_id, seg, line_no, pos, tool_use_id, tool FROM res",
    "dangling_tool_use": f"WITH {_PAIR} SELECT * FROM dangling",
    "orphan_tool_result": f"WITH {_PAIR} SELECT * FROM orphaned",
    "graded_results": f"WITH {_GRADED} SELECT * FROM shown",
    "duplicate_results": f"WITH {_GRADED} SELECT session_id, seg, line_no, pos FROM shown WHERE status = 'duplicate'",
    "derived_files": f"WITH {_FILES} SELECT * FROM files",
    "derived_tool_counts": f"WITH {_R}, {_B} SELECT session_id, seg, coalesce(tool_name, '') AS tool, count(*) AS n FROM bs WHERE block_type = 'tool_use' GROUP BY ALL",
    "derived_commands": f"""WITH {_R}, {_B}, c AS (SELECT session_id, seg, line_no, pos, json_extract_string(tool_input, '$.command') AS c FROM bs WHERE block_type = 'tool_use' AND tool_name = 'Bash')
        SELECT session_id, seg, line_no, pos, {_head('c', 200)} AS command FROM c WHERE c IS NOT NULL""",
    "derived_errors": f"WITH {_R}, {_B} SELECT session_id, seg, count(*) FILTER (WHERE block_type = 'tool_result' AND is_error) AS error_count FROM bs GROUP BY ALL",
    "chain_check": f"WITH {_R}, {_CHAIN} SELECT session_id, line_no, uuid, parent_uuid, before AS expected_parent FROM chain WHERE parent_uuid IS DISTINCT FROM before",
    "rechain": f"WITH {_R}, {_CHAIN} SELECT session_id, line_no, uuid, before AS new_parent FROM chain",
    "keep_tail": f"WITH {_R}, {_SEGS} SELECT session_id, seg FROM segs WHERE from_end <= 1",
    "pinned_segments": f"""WITH {_R}, {_SEGS}, k AS (SELECT *, has_summary OR has_ledger OR has_synthetic OR from_end <= 1 AS kept FROM segs)
        SELECT session_id, seg, kept AS kept_verbatim, NOT kept AND has_activity AS needs_summary FROM k""",
    "suffix_file_overlap": f"WITH {_OVERLAP} SELECT * FROM overlap",
    "salience": f"WITH {_SAL} SELECT session_id, seg, is_error, round(CAST(salience AS DOUBLE), 4) AS salience FROM sal",
    "mask_cost": f"WITH {_R}, {_B}, {_MASK} SELECT * FROM costs",
    "budget_plan": f"WITH {_PLAN} SELECT * FROM plan",
    "budget_totals": f"""WITH {_PLAN}, p AS (SELECT p.*, u.is_error FROM plan p JOIN units u USING (session_id, seg))
        SELECT f.session_id, count(p.seg) AS n_units, count(*) FILTER (WHERE treatment = 0) AS n_verbatim, count(*) FILTER (WHERE treatment = 1) AS n_masked, count(*) FILTER (WHERE treatment = 2) AS n_summarized,
        count(*) FILTER (WHERE treatment = 2) AS n_to_write, count(*) FILTER (WHERE treatment = 2 AND is_error) AS n_errors_summarized, max(fixed) AS fixed,
        CAST(max(fixed) + coalesce(sum(cost), 0) AS BIGINT) AS tokens, max(fixed) + coalesce(sum(cost), 0) > {TARGET} AS is_over FROM fixed f LEFT JOIN p ON f.session_id = p.session_id GROUP BY f.session_id""",
    "work_list": f"WITH {_PLAN} SELECT session_id, seg FROM plan WHERE treatment = 2",
    "truncate_head": f"SELECT doc_id, {_head('text', 80)} AS shown FROM documents",
    "truncate_head_tail": f"SELECT doc_id, {_cut('text', 100, 0.6)} AS shown FROM documents",
    "render_activity": f"WITH {_RENDER} SELECT * FROM items",
    "unit_digest": f"""WITH {_RENDER},
        lines AS (SELECT session_id, seg, line_no, pos, CASE kind WHEN 'assistant_text' THEN 'ASSISTANT: ' || {_head('shown', 900)} WHEN 'tool_use' THEN 'TOOL ' || tool || ' ' || {_head('shown', 150)}
            WHEN 'tool_result' THEN 'RESULT[' || status || ',' || chars || ']: ' || {_head('shown', 250)} WHEN 'delivered_message' THEN 'AGENT-REPORT(' || status || '): ' || {_head('shown', 700)}
            WHEN 'compact_summary' THEN 'COMPACT-SUMMARY: ' || {_head('shown', 400)} WHEN 'system' THEN 'SYSTEM: ' || {_head('shown', 200)} END AS line FROM items WHERE kind <> 'thinking' AND seg >= 0
          UNION ALL SELECT session_id, seg, line_no, 0, 'USER ASKED: ' || {_head("coalesce(ut, '')", 600)} FROM g WHERE is_genuine),
        d AS (SELECT session_id, seg, string_agg(line, chr(10) ORDER BY line_no, pos) AS t FROM lines GROUP BY ALL)
        SELECT session_id, seg, {_head('t', 8000)} AS digest FROM d""",
    "content_hash": f"WITH RECURSIVE {_R}, {_NODES}, {_HASH} SELECT * FROM hashes",
    "cached_summary_lookup": f"WITH RECURSIVE {_R}, {_NODES}, {_HASH}, {_ORIGIN} SELECT * FROM origin",
    "cache_report": f"""WITH RECURSIVE {_R}, {_NODES}, {_HASH}, {_ORIGIN} SELECT session_id, count(*) FILTER (WHERE origin = 'explicit') AS n_explicit, count(*) FILTER (WHERE origin = 'cached') AS n_cached,
        count(*) FILTER (WHERE origin IS NULL) AS n_missing FROM origin GROUP BY ALL""",
    "lineage_latest": f"""WITH RECURSIVE {_R}, {_LINEAGE}, nxt AS (SELECT parent, max_by(child, (ts, child)) AS child FROM l WHERE parent IS NOT NULL AND (p_mtime IS NULL OR mtime >= p_mtime) GROUP BY parent),
        w AS (SELECT child AS start, child AS cur, 0 AS hop FROM l UNION ALL SELECT w.start, n.child, hop + 1 FROM w JOIN nxt n ON n.parent = w.cur WHERE hop < 1000)
        SELECT start, arg_max(cur, hop) AS latest FROM w GROUP BY start""",
    "superseded": f"WITH {_R}, {_LINEAGE} SELECT child, child IN (SELECT parent FROM l WHERE parent IS NOT NULL) AS is_superseded FROM l",
    "uuid_prefix_lookup": f"""WITH {_R}, s AS (SELECT session_id, min(substr(uuid, 1, 8)) AS selector FROM r WHERE uuid IS NOT NULL GROUP BY ALL)
        SELECT r.session_id, selector, line_no, uuid, NOT is_synthetic AND NOT is_masked AS is_ground FROM r JOIN s ON r.session_id = s.session_id AND starts_with(r.uuid, s.selector)""",
    "verify_twins": f"""WITH RECURSIVE {_R}, {_NODES} SELECT r.session_id, true AS ok, count(*) AS n_turns, 0::BIGINT AS n_trailing FROM r
        JOIN active a ON r.session_id = a.session_id AND r.line_no = a.line_no WHERE r.is_genuine AND r.uuid IS NOT NULL GROUP BY r.session_id""",
    "scan_ranked": f"WITH {_R} SELECT session_id, CAST(floor(sum(n_bytes) / 4) AS BIGINT) AS tokens, count(*) AS n_records FROM r GROUP BY ALL ORDER BY tokens DESC, session_id",
    "active_goals_raw": f"""WITH {_RAW}, g AS (SELECT source, line_no, CASE WHEN json_type(j->'$.attachment.met') = 'BOOLEAN' THEN (j->>'$.attachment.met') = 'true' ELSE true END AS met
        FROM raw_r WHERE j->>'$.attachment.type' = 'goal_status') SELECT s.source, coalesce(NOT max_by(met, g.line_no), false) AS is_active FROM (SELECT DISTINCT source FROM raw_r) s LEFT JOIN g ON s.source = g.source GROUP BY s.source""",
    "synth_sources": f"WITH {_R}, {_PROV} SELECT session_id, source, min(line_no) AS first_line FROM c WHERE source IS NOT NULL GROUP BY ALL",
    "provenance_files": f"WITH RECURSIVE {_R}, {_PROV} SELECT * FROM files",
    "nth_synthetic": f"WITH {_R}, {_PROV} SELECT session_id, line_no, uuid, part, row_number() OVER (PARTITION BY session_id ORDER BY line_no) - 1 AS nth FROM c WHERE is_synthetic",
    "ground_truth": f"WITH RECURSIVE {_R}, {_PROV} SELECT session_id, uuid, from_session, from_line, is_ground FROM truth",
    "rehydrate_full": f"""WITH RECURSIVE {_R}, {_PROV}, first AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY session_id, uuid ORDER BY line_no) = 1),
        syn AS (SELECT *, source IN (SELECT session_id FROM c) AS there FROM c WHERE is_synthetic),
        e AS (SELECT DISTINCT session_id, line_no, source, {sql_id('unnest(covered)')} AS uuid FROM syn WHERE there),
        walk AS (SELECT session_id, line_no, source, uuid, 1 AS level FROM e
          UNION SELECT w.session_id, w.line_no, e.source, e.uuid, level + 1 FROM walk w JOIN first f ON f.session_id = w.source AND f.uuid = w.uuid AND f.is_synthetic JOIN e ON e.session_id = f.session_id AND e.line_no = f.line_no WHERE level < 10),
        met AS (SELECT w.session_id, w.line_no, w.source AS from_session, f.line_no AS from_line, w.uuid, level, f.is_ground FROM walk w JOIN first f ON f.session_id = w.source AND f.uuid = w.uuid
          LEFT JOIN syn s ON s.session_id = f.session_id AND s.line_no = f.line_no WHERE NOT f.is_synthetic OR level = 10 OR NOT coalesce(s.there, false)
          UNION ALL SELECT session_id, line_no, session_id, line_no, uuid, 0, false FROM syn WHERE NOT coalesce(there, false)),
        swapped AS (SELECT m.session_id, m.line_no, m.uuid, level, coalesce(NOT m.is_ground AND t.is_ground AND level > 0, false) AS swaps, m.from_session AS a, t.from_session AS b, m.from_line AS al, t.from_line AS bl, m.is_ground
          FROM met m LEFT JOIN truth t ON m.from_session = t.session_id AND m.uuid = t.uuid)
        SELECT session_id, line_no, CASE WHEN swaps THEN b ELSE a END AS from_session, CASE WHEN swaps THEN bl ELSE al END AS from_line, uuid, min(level) AS level, bool_or(is_ground OR swaps) AS is_ground FROM swapped GROUP BY ALL""",
    "summary_batches": f"WITH RECURSIVE {_R}, {_BATCH} SELECT session_id, seg, batch FROM fold",
    "summary_waves": f"WITH RECURSIVE {_R}, {_BATCH} SELECT session_id, batch, batch // 3 AS wave, count(*) AS n_units FROM fold GROUP BY ALL",
    "split_parts": f"""WITH RECURSIVE {_R}, {_B},
        act AS (SELECT session_id, seg, line_no, n_bytes, row_number() OVER (PARTITION BY session_id, seg ORDER BY line_no) AS k, sum(n_bytes) OVER (PARTITION BY session_id, seg) AS whole FROM g WHERE seg >= 0 AND NOT is_genuine),
        names AS (SELECT session_id, tool_id, arg_max(tool_name, line_no * 100000 + pos) AS called FROM b WHERE block_type = 'tool_use' GROUP BY ALL),
        ids AS (SELECT b.session_id, b.line_no, list(DISTINCT b.tool_id) FILTER (WHERE block_type = 'tool_use' AND b.tool_id IS NOT NULL) AS opened, list(DISTINCT b.tool_use_id) FILTER (WHERE block_type = 'tool_result' AND b.tool_use_id IS NOT NULL) AS closed,
            bool_or(block_type = 'tool_result' AND coalesce(called, '') IN ('Task', 'Agent', 'Workflow', 'Skill')) AS ends
          FROM b LEFT JOIN names n ON b.session_id = n.session_id AND b.tool_use_id = n.tool_id WHERE block_type IN ('tool_use', 'tool_result') GROUP BY ALL),
        x AS (SELECT act.*, coalesce(opened, []) AS opened, coalesce(closed, []) AS closed, coalesce(ends, false) AS ends FROM act LEFT JOIN ids USING (session_id, line_no)),
        fold AS (SELECT session_id, seg, line_no, k, 0::BIGINT AS part, {_close('0', '[]::VARCHAR[]', 'x')} FROM x WHERE k = 1
          UNION ALL SELECT x.session_id, x.seg, x.line_no, x.k, f.part + f.shut, {_close('CASE WHEN f.shut = 1 THEN 0 ELSE f.held END', 'f.pending', 'x')} FROM fold f JOIN x ON x.session_id = f.session_id AND x.seg = f.seg AND x.k = f.k + 1)
        SELECT session_id, seg, line_no, part FROM fold""",
    "segment_index": f"""WITH {_FILES}, calls AS (SELECT session_id, seg, coalesce(tool_name, '') AS tool, count(*) AS n FROM bs WHERE block_type = 'tool_use' GROUP BY ALL),
        f AS (SELECT session_id, seg, string_agg(path || '=' || roles, ';' ORDER BY path) AS files FROM files GROUP BY ALL), c AS (SELECT session_id, seg, string_agg(tool || '=' || n, ';' ORDER BY tool) AS tool_counts FROM calls GROUP BY ALL),
        k AS (SELECT session_id, seg, count(*) FILTER (WHERE block_type = 'tool_result' AND is_error) AS error_count, count(json_extract_string(tool_input, '$.command')) FILTER (WHERE block_type = 'tool_use' AND tool_name = 'Bash') AS n_commands FROM bs GROUP BY ALL)
        SELECT k.session_id, k.seg, coalesce(files, '') AS files, coalesce(tool_counts, '') AS tool_counts, n_commands, error_count FROM k LEFT JOIN f USING (session_id, seg) LEFT JOIN c USING (session_id, seg)""",
    "rehydrate_expand": f"""WITH {_R}, c AS (SELECT DISTINCT {sql_id('session_id')} AS session_id, line_no, {sql_id('(provenance).source_session_id')} AS source, {sql_id('u')} AS uuid
          FROM (SELECT *, unnest((provenance).covered_uuids) AS u FROM records)),
        raw AS (SELECT session_id, uuid, min(line_no) AS source_line FROM r WHERE uuid IS NOT NULL AND NOT is_synthetic AND NOT is_masked GROUP BY ALL)
        SELECT c.session_id, c.line_no, c.source, raw.source_line, c.uuid FROM c JOIN raw ON c.source = raw.session_id AND c.uuid = raw.uuid""",
    "verify_checks": f"""WITH {_R}, {_CHAIN}, {_PAIR}, s AS (SELECT DISTINCT session_id FROM r), k AS (SELECT DISTINCT session_id, uuid FROM r WHERE uuid IS NOT NULL),
        bad AS (SELECT session_id, 'linear chain' AS c FROM chain WHERE parent_uuid IS DISTINCT FROM before
          UNION SELECT session_id, 'parents exist' FROM r WHERE parent_uuid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.session_id = r.session_id AND k.uuid = r.parent_uuid)
          UNION SELECT session_id, 'uuids unique' FROM r WHERE uuid IS NOT NULL GROUP BY session_id, uuid HAVING count(*) > 1
          UNION SELECT session_id, 'leaf exists' FROM r WHERE rec_type = 'last-prompt' AND leaf_uuid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.session_id = r.session_id AND k.uuid = r.leaf_uuid)
          UNION SELECT session_id, 'calls answered' FROM dangling UNION SELECT session_id, 'results called' FROM orphaned)
        SELECT s.session_id, n AS check_name, NOT EXISTS (SELECT 1 FROM bad WHERE bad.session_id = s.session_id AND bad.c = n) AS ok
        FROM s CROSS JOIN (SELECT unnest(['linear chain', 'parents exist', 'uuids unique', 'leaf exists', 'calls answered', 'results called']) AS n)""",
    "verify_fidelity": f"""WITH RECURSIVE {_R}, {_NODES}, d AS (SELECT r.session_id, r.line_no, a.line_no IS NOT NULL AS known FROM r
          LEFT JOIN active a ON r.session_id = a.session_id AND r.line_no = a.line_no WHERE r.is_genuine AND r.uuid IS NOT NULL),
        m AS (SELECT session_id, max(line_no) FILTER (WHERE known) AS last_known FROM d GROUP BY ALL)
        SELECT d.session_id, count(*) FILTER (WHERE coalesce(line_no < last_known, false)) AS n_holes, count(*) FILTER (WHERE NOT coalesce(line_no < last_known, false)) AS n_trailing
        FROM d JOIN m ON d.session_id = m.session_id WHERE NOT known GROUP BY ALL""",
    "active_goal": """SELECT user_id, coalesce(NOT arg_max(event_type = 'signup', (ts, event_id)) FILTER (WHERE event_type IN ('signup', 'error')), false) AS is_active FROM events GROUP BY user_id""",
    "session_scan": f"""WITH {_R} SELECT session_id, count(*) AS n_records, count(uuid) AS n_uuids, count(*) FILTER (WHERE is_genuine) AS n_turns, CAST(floor(sum(n_bytes) / 4) AS BIGINT) AS tokens,
        bool_or(is_synthetic) AS has_synthetic, bool_or(is_masked) AS has_masked, count(*) FILTER (WHERE is_compact_summary) AS n_summaries FROM r GROUP BY ALL""",
}
