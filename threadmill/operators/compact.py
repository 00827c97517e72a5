"""Compaction of transcripts, end to end: unit summaries, assembly of a shorter twin, and its verification.

Works on raw lines (source, line_no, raw_json). The relational part (active path, segments, treatments) comes from the
shared front end; records are rewritten in Arrow batches; each session's output order is a column.
"""

from __future__ import annotations

import json
import uuid as uuidlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import jsonops
from ..functions.columns import message_text, norm_id
from ..functions.jsonwalk import clean, parse_object
from ..plans import blocked, transcript as tr
from ..session import cut_lineage
from ..sources import transcripts

MODES = ("mask", "summarize", "budget")
#: Units and bytes of one call of a summarizer (fixed values).
BATCH_UNITS, BATCH_BYTES = 10, 120_000


def stable_id(*parts: object) -> str:
    """A reproducible id in the form of a UUID."""
    return str(uuidlib.uuid5(uuidlib.NAMESPACE_URL, "\x1f".join(map(str, parts))))


def extractive_summary(digest: str, limit: int = 400) -> str:
    """The default summarizer: the first lines of a unit's digest, whole where they fit."""
    out, size = [], 0
    for line in digest.split("\n"):
        if out and size + len(line) > limit:
            break
        out.append(line[:limit])
        size += len(line) + 1
    return "\n".join(out)


def summarize(digests: DataFrame, summarizer: Callable[[str], str] = extractive_summary) -> DataFrame:
    """session_id, seg, summary of digests (session_id, seg, digest), by any function of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([clean(summarizer(t or "")) for t in b.column(2).to_pylist()], pa.string())], ["session_id", "seg", "summary"])

    return digests.select("session_id", "seg", "digest").mapInArrow(run, "session_id string, seg long, summary string")


#: How a summary ends that names its selector, and how a ledger begins (fixed values).
FOOTER, LEDGER = "[recompact summary {key} — rehydratable]", "Standing constraints, corrections, and decisions for this session (recompact ledger; supersedes any earlier ledger):\n"
PREAMBLE = (
    "This session is a compacted copy of session {source}. Assistant texts that end in a line with a summary's key stand for turns that were summarised; markers in brackets "
    "stand for payloads that were taken out and name the start of the uuid of their record. The originals are kept: look a key or the start of a uuid up before working anything out again."
)


def _said(kind: str, session: str, key: str, text: str, stamp: str | None, **more: object) -> dict:
    """A record that the assembly writes itself."""
    return {
        "parentUuid": None, "isSidechain": False, "userType": "external", "type": "assistant", "uuid": stable_id(kind, session, key), "timestamp": stamp, "sessionId": session, **more,
        "message": {"id": "msg_" + stable_id("message", kind, session, key).replace("-", ""), "role": "assistant", "type": "message", "stop_reason": "end_turn", "content": [{"type": "text", "text": text}]},
    }


def with_footer(record: dict) -> dict:
    """A synthetic record whose text names its key; one that does already stays as it is."""
    key = record["recompactProvenance"].get("part") if isinstance(record.get("recompactProvenance"), dict) else None
    body = record["message"].get("content") if isinstance(record.get("message"), dict) else None
    first = body[0] if isinstance(body, list) and body and isinstance(body[0], dict) else {}
    if record.get("recompactSynthetic") is not True or not isinstance(key, str) or not isinstance(first.get("text"), str) or "[recompact summary " in first["text"]:
        return record
    return {**record, "message": {**record["message"], "content": [{**first, "text": f"{first['text']}\n{FOOTER.format(key=key)}"}, *body[1:]]}}


ROWS = "session_id string, out_pos long, raw_json string"


def _rows(made: list[tuple]) -> Iterator[pa.RecordBatch]:
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int64(), pa.string()))], ["session_id", "out_pos", "raw_json"])


def assemble(
    lines: DataFrame, mode: str = "mask", keep: int = 1, summaries: DataFrame | None = None, new_id: Callable[[str], str] | None = None, plan: DataFrame | None = None,
    ledger: DataFrame | None = None, preamble: bool = False,
) -> DataFrame:
    """The shorter twin of each session: session_id (of the source), out_pos, raw_json.

    Off-path branches, rows without uuid and earlier preambles are left out; the last keep segments and pinned ones stay
    as they are; others are masked, or (summarize) their activity is one synthetic record with provenance, or (budget)
    get what plan (session_id, seg, treatment) says. ledger (session_id, text) puts one record before the kept tail and
    drops earlier ledgers; preamble puts one at the end. Summaries without a footer get one. Calls without a result are
    taken out, records chained anew, and a last-prompt row points to the new leaf.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "mask" and summaries is not None:
        raise ValueError("masking takes no summaries")
    if mode != "mask" and summaries is None:
        raise ValueError("summarizing takes summaries")
    if (mode == "budget") != (plan is not None):
        raise ValueError("a budget takes a plan, other modes none")
    from .sessions import pinned_segments

    rec = transcripts.records(lines).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    rec = cut_lineage(rec.withColumn("session_id", F.coalesce(norm_id("session_id"), F.col("source"))))
    at = rec.select("source", "line_no", "session_id")
    rec = rec.drop("source")
    active = tr.active_path(rec).filter("uuid is not null").select("session_id", "line_no")
    old_ledger = F.col("is_ledger") & F.lit(ledger is not None)
    seg = tr.segmented(rec).filter(~F.col("is_preamble") & ~old_ledger).join(active, ["session_id", "line_no"]).select("session_id", "line_no", "seg", "is_genuine", "uuid")
    kept = pinned_segments(rec, keep)
    rows = seg.join(kept, ["session_id", "seg"], "left").withColumn("keep", F.coalesce("kept_verbatim", F.lit(True)) | F.col("is_genuine"))
    if plan is None:  # what has no agent activity needs no treatment
        rows = rows.withColumn("treatment", F.lit(1 if mode == "mask" else 2))
    else:
        rows = rows.join(plan.select("session_id", "seg", "treatment"), ["session_id", "seg"], "left").withColumn("treatment", F.coalesce("treatment", F.lit(0)))
    raw = lines.join(at, ["source", "line_no"]).select("session_id", "line_no", "raw_json")
    rows = cut_lineage(rows.join(raw, ["session_id", "line_no"]))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, n, keep_, genuine, verbatim, treatment, text in zip(*(c.to_pylist() for c in b.columns)):
                record = parse_object(text)
                if genuine and not verbatim:
                    record = jsonops.elide_images(record) or record
                elif not keep_ and treatment == 2:
                    continue
                elif not keep_ and treatment == 1:
                    record = jsonops.mask_record(record)[1]
                if record is not None:
                    out.append((s, n * 10, clean(json.dumps(with_footer(record), ensure_ascii=False))))
            yield from _rows(out)

    out = rows.select("session_id", "line_no", "keep", "is_genuine", F.coalesce("kept_verbatim", F.lit(True)).alias("v"), "treatment", "raw_json").mapInArrow(rewrite, ROWS)
    stamp = F.get_json_object("raw_json", "$.timestamp")
    if mode != "mask":
        units = rows.filter("not keep and treatment = 2").groupBy("session_id", "seg").agg(F.max("line_no").alias("last"))
        units = units.join(rows.groupBy("session_id", "seg").agg(
            F.transform(F.sort_array(F.collect_set(F.struct("line_no", "uuid"))), lambda x: x["uuid"]).alias("covered"), F.max(F.when(F.col("is_genuine"), stamp)).alias("stamp")
        ), ["session_id", "seg"])
        units = units.join(summaries, ["session_id", "seg"]).select("session_id", "seg", "last", "covered", "summary", "stamp")

        def synthetic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = []
                for s, g, last, covered, text, when in zip(*(c.to_pylist() for c in b.columns)):
                    more = {"recompactSynthetic": True, "recompactProvenance": {"source": s, "sourceSessionId": s, "part": str(g), "coveredUuids": covered}}
                    made.append((s, last * 10 + 1, clean(json.dumps(_said("summary", s, str(g), f"{text}\n{FOOTER.format(key=g)}", when, **more), ensure_ascii=False))))
                yield from _rows(made)

        out = out.unionByName(units.mapInArrow(synthetic, ROWS))
    if ledger is not None or preamble:
        tail = seg.join(_tail(rec, keep), ["session_id", "seg"]).groupBy("session_id").agg(F.min("line_no").alias("tail"))
        ends = rows.groupBy("session_id").agg(F.max("line_no").alias("last"), F.max(F.struct("line_no", stamp.alias("t")))["t"].alias("stamp")).join(tail, "session_id", "left")
        texts = (ledger if ledger is not None else ends.select("session_id", F.lit(None).cast("string").alias("text")).limit(0)).select("session_id", F.col("text").alias("ledger"))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = []
                for s, last, when, first, text in zip(*(c.to_pylist() for c in b.columns)):
                    if text is not None:
                        made.append((s, (first if first is not None else last + 1) * 10 - 5, json.dumps(_said("ledger", s, "", LEDGER + text, when, recompactLedger=True), ensure_ascii=False)))
                    if preamble:
                        made.append((s, last * 10 + 8, json.dumps(_said("preamble", s, "", PREAMBLE.format(source=s), when, recompactPreamble=True), ensure_ascii=False)))
                yield from _rows(made)

        out = out.unionByName(ends.join(texts, "session_id", "left").select("session_id", "last", "stamp", "tail", "ledger").mapInArrow(own, ROWS))
    return _finish(cut_lineage(_without_dangling(cut_lineage(out))), new_id, _last_prompts(rec))


def _tail(rec: DataFrame, keep: int) -> DataFrame:
    from .sessions import keep_tail

    return keep_tail(rec, keep)


def _last_prompts(rec: DataFrame) -> DataFrame:
    """session_id, prompt: what the last last-prompt row says, else the text of the last genuine turn."""
    said = rec.filter("rec_type = 'last-prompt'").groupBy("session_id").agg(F.max_by("last_prompt", "line_no").alias("a"))
    turns = tr.records_once(rec, F.when(tr.is_genuine(tr._marker(rec)), message_text("message", "content_kind")).alias("t")).filter("is_genuine").groupBy("session_id").agg(F.max_by("t", "line_no").alias("b"))
    return said.join(turns, "session_id", "full").select("session_id", F.coalesce("a", "b", F.lit("")).alias("prompt"))


def _without_dangling(out: DataFrame) -> DataFrame:
    """Rows without calls that nothing answers, and without rows that this empties."""
    as_lines = out.select(F.col("session_id").alias("source"), F.col("out_pos").alias("line_no"), "raw_json")
    b = transcripts.blocks(as_lines)
    answered = b.filter("block_type = 'tool_result'").select("source", F.col("tool_use_id").alias("tool_id")).distinct()
    bad = b.filter("block_type = 'tool_use' and tool_id is not null").join(answered, ["source", "tool_id"], "left_anti").groupBy("source", "line_no").agg(F.collect_set("tool_id").alias("bad"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for s, n, text, ids in zip(*(c.to_pylist() for c in x.columns)):
                if ids or '"content": []' in text:
                    record = json.loads(text)
                    body = record["message"]["content"] if isinstance(record.get("message"), dict) else None
                    if isinstance(body, list):
                        body = [y for y in body if not (isinstance(y, dict) and y.get("type") == "tool_use" and y.get("id") in (ids or ()))]
                        if not body:
                            continue
                        record["message"]["content"] = body
                        text = json.dumps(record, ensure_ascii=False)
                rows.append((s, n, text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["session_id", "out_pos", "raw_json"])

    return as_lines.join(bad, ["source", "line_no"], "left").select("source", "line_no", "raw_json", "bad").mapInArrow(drop, "session_id string, out_pos long, raw_json string")


def _finish(out: DataFrame, new_id: Callable[[str], str] | None, prompts: DataFrame) -> DataFrame:
    """Chains the rows of each session anew and adds the pointer to the last."""
    name = new_id or (lambda s: stable_id("twin", s))
    d = out.withColumn("uuid", F.get_json_object("raw_json", "$.uuid"))  # rows without one have been left out
    chained = blocked.previous(d, ["session_id"], "out_pos", F.col("uuid"), "before", width=blocked.WIDTH * 10)
    leaf = d.groupBy("session_id").agg(F.max(F.struct("out_pos", "uuid")).alias("x")).select("session_id", "x.*").join(prompts, "session_id", "left")

    def envelope(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [clean(json.dumps(jsonops.rewrite_envelope(json.loads(t), name(s), p), ensure_ascii=False)) for s, t, p in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["session_id", "out_pos", "raw_json"])

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [json.dumps({"type": "last-prompt", "leafUuid": u, "sessionId": name(s), "lastPrompt": t or ""}, ensure_ascii=False) for s, u, t in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p + 5 for p in b.column(1).to_pylist()], pa.int64()), pa.array(texts, pa.string())], ["session_id", "out_pos", "raw_json"])

    schema = "session_id string, out_pos long, raw_json string"
    return chained.select("session_id", "out_pos", "raw_json", "before").mapInArrow(envelope, schema).unionByName(leaf.select("session_id", "out_pos", "uuid", "prompt").mapInArrow(tail, schema))


def verify_output(out: DataFrame) -> DataFrame:
    """Checks of assembled sessions up to the assembly boundary (their first last-prompt row; a session that went on has
    rows behind it): session_id, check_name, ok."""
    from .sessions import verify

    as_lines = out.select(F.col("session_id").alias("source"), F.col("out_pos").alias("line_no"), "raw_json")
    rec = cut_lineage(transcripts.records(as_lines))
    bound = rec.groupBy("source").agg(F.min(F.when(F.col("rec_type") == "last-prompt", F.col("line_no"))).alias("bound"))
    inside = lambda d: d.join(bound, "source").filter("bound is null or line_no <= bound").drop("bound")
    rec = inside(rec)
    single = rec.groupBy(F.col("source").alias("session_id")).agg(F.lit("single session id").alias("check_name"), (F.countDistinct("session_id") == 1).alias("ok"))
    own = rec.withColumn("session_id", F.col("source")).withColumn("ingested_at", F.lit(None).cast("timestamp")).drop("source")
    return verify(own, inside(transcripts.blocks(as_lines)).withColumnRenamed("source", "session_id")).unionByName(single)


def fidelity_text(record: dict) -> str:
    """A turn's text without the markers of elided images."""
    body = record["message"].get("content") if isinstance(record.get("message"), dict) else None
    if isinstance(body, str):
        return body
    texts = (b["text"] for b in body if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str)) if isinstance(body, list) else ()
    return "\n".join(t for t in texts if not t.startswith("[recompact: image elided"))


def verify_turns(out: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether the genuine turns of a twin are those of its source's active path, in order and word for word:
    session_id, ok, n_turns, n_trailing (turns that the source got since, which is growth and no fault)."""
    def turns(d: DataFrame, path: bool) -> DataFrame:
        rec = transcripts.records(d).withColumn("ingested_at", F.lit(None).cast("timestamp"))
        rec = cut_lineage(rec.withColumn("session_id", F.coalesce(norm_id("session_id"), F.col("source")) if path else F.col("source")))
        g = tr.records_once(rec).filter("is_genuine and uuid is not null").select("session_id", "line_no", "uuid")
        g = g.join(tr.active_path(rec).select("session_id", "line_no"), ["session_id", "line_no"], "left_semi") if path else g
        text = jsonops.apply_records(d, lambda r: (clean(fidelity_text(r)),), "source string, line_no long, text string")
        text = text.join(rec.select("source", "line_no", "session_id"), ["source", "line_no"]).drop("source")
        return blocked.running_sum(g.join(text, ["session_id", "line_no"]), ["session_id"], "line_no", F.lit(1), "nth").select("session_id", "nth", "uuid", "text")

    a = turns(lines, True).withColumnsRenamed({"uuid": "a_uuid", "text": "a_text"})
    b = turns(out.select(F.col("session_id").alias("source"), F.col("out_pos").alias("line_no"), "raw_json"), False)
    d = a.join(b, ["session_id", "nth"], "full")
    return d.groupBy("session_id").agg(
        F.bool_and(F.col("uuid").isNull() | (F.col("a_uuid").eqNullSafe(F.col("uuid")) & F.col("a_text").eqNullSafe(F.col("text")))).alias("ok"), F.count("uuid").alias("n_turns"), F.count_if(F.col("uuid").isNull()).alias("n_trailing")
    )


def est_tokens(lines: DataFrame, by: str = "source") -> DataFrame:
    """Estimated tokens per session of raw lines: bytes with images at their weight, a quarter, floored once."""
    n = jsonops.apply_records(lines, lambda r: (jsonops.est_len(r),), f"{by} string, line_no long, est_len long", (by, "line_no"))
    return n.groupBy(by).agg(F.floor(F.sum("est_len") / 4).cast("bigint").alias("tokens"))
