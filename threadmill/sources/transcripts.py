"""Sources and sinks of transcripts: line-delimited JSON files, sidecar maps, and create-new outputs.

`scan_lines` gives each line with its number in the file, whatever the file's size.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.columns import norm_id
from ..functions.columns_text import munge_path
from ..functions.fragments import _schema
from ..functions.jsonwalk import clean, parse_object
from ..functions import jsonops
from ..session import cut_lineage

LINES = "source string, line_no long, raw_json string"
ENVELOPE = (
    "source string, line_no long, session_id string, rec_type string, uuid string, parent_uuid string, content_kind string, is_meta boolean, is_compact_summary boolean, has_source_tool boolean, "
    "is_synthetic boolean, is_masked boolean, is_ledger boolean, is_preamble boolean, leaf_uuid string, last_prompt string, record_ts string, message string, est_len long, images_elided boolean, "
    "provenance struct<source:string,source_session_id:string,part:string,covered_uuids:array<string>>, delivered_marker string"
)


def scan_lines(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """source, line_no (from 0), raw_json of every line that isn't blank in a folder's *.jsonl files.

    Large files are read in splits: lines are counted within each, and the splits before add their counts, so numbers
    are exact and no task holds a file. strict raises on the first bad line, naming its place; else bad lines are left out.
    """
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.jsonl").text(folder)
    d = text.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    splits = d.groupBy("source", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("source", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    lines = d.join(splits, ["source", "block"]).select(
        "source", (F.col("id") + F.col("shift")).alias("line_no"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("raw_json")
    ).filter("raw_json <> ''")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, n, text in zip(*(c.to_pylist() for c in b.columns)):
                ok = parse_object(text) is not None
                if strict and not ok:
                    raise ValueError(f"{s}: line {n + 1} is not a JSON object")
                keep.append(ok)
            yield b.filter(pa.array(keep))

    return lines.mapInArrow(check, LINES)


def session_files(spark: SparkSession, folder: str) -> DataFrame:
    """source, session_id (the file's stem), modified_at of a folder's transcripts."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder)
    return f.select(F.col("path").alias("source"), F.regexp_extract("path", r"([^/]*)\.jsonl$", 1).alias("session_id"), F.col("modificationTime").alias("modified_at"))


def newest_session(spark: SparkSession, folder: str) -> str | None:
    """The session whose file was written last; of several the first by name."""
    r = session_files(spark, folder).orderBy(F.desc("modified_at"), "session_id").first()
    return r.session_id if r else None


def active_goals(lines: DataFrame) -> DataFrame:
    """source, is_active: whether the last goal status of a session says that its goal is not met; without one it is not active."""
    def goal(record: dict) -> tuple:
        a = record.get("attachment")
        if not isinstance(a, dict) or a.get("type") != "goal_status":
            return (None,)
        return (a["met"] if isinstance(a.get("met"), bool) else True,)

    g = jsonops.apply_records(lines, goal, "source string, line_no long, met boolean")
    return g.groupBy("source").agg(F.coalesce(~F.max_by("met", F.when(F.col("met").isNotNull(), F.col("line_no"))), F.lit(False)).alias("is_active"))


def first_value(lines: DataFrame, key: str) -> DataFrame:
    """source, value: the first value of a top-level key that isn't null, as text."""
    v = jsonops.apply_records(lines, lambda r: (None if r.get(key) is None else clean(r[key] if isinstance(r[key], str) else jsonops.canonical(r[key])),), "source string, line_no long, value string")
    return v.groupBy("source").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("line_no"))).alias("value"))


def part_of(key: str) -> int:
    """The part of a unit's key ('3.1': 1; '3': 0)."""
    tail = key.partition(".")[2]
    return int(tail) if tail.isdigit() else 0


def project_folder(root: str, cwd: str) -> str:
    return os.path.join(root, munge_path(cwd))


def resolve_session(arg: str, folder: str) -> tuple[str, str]:
    """(folder, session id) of a path or an id."""
    if arg.endswith(".jsonl") or os.sep in arg:
        return os.path.dirname(os.path.abspath(arg)), os.path.basename(arg).removesuffix(".jsonl")
    return folder, arg


def _text(v: object) -> str | None:
    return clean(v) if isinstance(v, str) else None


def envelope(record: dict) -> tuple:
    """The promoted fields of a record: strings only where they are strings, flags only where they are true."""
    message = record.get("message") if isinstance(record.get("message"), dict) else {}
    body = message.get("content")
    kind = "missing" if "content" not in message else "string" if isinstance(body, str) else "array" if isinstance(body, list) else "other"
    p = record.get("recompactProvenance")
    provenance = None
    if isinstance(p, dict):
        covered = [_text(u.get("uuid") if isinstance(u, dict) else u) for u in p.get("coveredUuids") or [] if u is not None]
        provenance = {"source": _text(p.get("source")), "source_session_id": _text(p.get("sourceSessionId")), "part": _text(p.get("part")), "covered_uuids": covered}
    flag = lambda k: record.get(k) is True
    return (
        _text(record.get("sessionId")), _text(record.get("type")) or "", _text(record.get("uuid")), _text(record.get("parentUuid")), kind, flag("isMeta"), flag("isCompactSummary"),
        "sourceToolAssistantUUID" in record, flag("recompactSynthetic"), flag("recompactMasked"), flag("recompactLedger"), flag("recompactPreamble"), _text(record.get("leafUuid")),
        _text(record.get("lastPrompt")), _text(record.get("timestamp")), clean(jsonops.canonical(said)) if (said := _said(record)) is not None else None, jsonops.est_len(record),
        "recompactImagesElided" in record, provenance, _text(record.get("recompactDelivered")),
    )


def _said(record: dict) -> object:
    """The message of a record; a system record's content stands in an object of its own."""
    if record.get("type") == "system" and "message" not in record and isinstance(record.get("content"), str):
        return {"content": record["content"]}
    return record.get("message")


def render(records: DataFrame) -> DataFrame:
    """Rows of a records table as lines of transcript files: source (the session), line_no, raw_json. The latest delivery counts."""
    flags = {"is_meta": "isMeta", "is_compact_summary": "isCompactSummary", "is_synthetic": "recompactSynthetic", "is_masked": "recompactMasked", "is_ledger": "recompactLedger", "is_preamble": "recompactPreamble"}
    texts = {"rec_type": "type", "uuid": "uuid", "parent_uuid": "parentUuid", "leaf_uuid": "leafUuid", "last_prompt": "lastPrompt", "record_ts": "timestamp", "writer_version": "version"}
    names = [*texts, *flags, "has_source_tool", "message", "provenance"]
    d = records.select(norm_id("session_id").alias("source"), F.col("line_no").cast("long").alias("line_no"), F.struct("ingested_at", *names).alias("x"))
    d = d.groupBy("source", "line_no").agg(F.max("x").alias("x")).select("source", "line_no", *(F.col(f"x.{n}").alias(n) for n in names))
    ids = ("uuid", "parent_uuid", "leaf_uuid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, line, *values in zip(*(c.to_pylist() for c in b.columns)):
                v = dict(zip(names, values))
                record = {k: v[c].strip().lower() if c in ids else v[c] for c, k in texts.items() if v[c] is not None}
                record |= {k: True for c, k in flags.items() if v[c]} | ({"sourceToolAssistantUUID": True} if v["has_source_tool"] else {}) | {"sessionId": source}
                if v["message"] is not None:
                    held = json.loads(v["message"])
                    record |= {"content": held.get("content")} if v["rec_type"] == "system" else {"message": held}
                if v["provenance"] is not None:
                    p = v["provenance"]
                    record["recompactProvenance"] = {"source": p["source"], "sourceSessionId": p["source_session_id"], "part": p["part"], "coveredUuids": p["covered_uuids"]}
                rows.append(clean(json.dumps(record, ensure_ascii=False)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.string())], ["source", "line_no", "raw_json"])

    return d.mapInArrow(run, LINES)


def records(lines: DataFrame) -> DataFrame:
    """The envelope of each line; raw lines stay as they are in their table."""
    return jsonops.apply_records(lines, envelope, ENVELOPE)


def blocks(lines: DataFrame) -> DataFrame:
    """The content blocks of user and assistant records; a string content is one text block."""
    schema = "source string, line_no long, pos int, block_type string, text string, tool_id string, tool_name string, tool_input string, tool_use_id string, is_error boolean, result_text string, image_len long"
    out = _schema(lines, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                record = parse_object(raw)
                if record is None or record.get("type") not in ("user", "assistant") or not isinstance(record.get("message"), dict):
                    continue
                body = record["message"].get("content")
                for i, x in enumerate([{"type": "text", "text": body}] if isinstance(body, str) else body if isinstance(body, list) else []):
                    if not isinstance(x, dict):
                        continue
                    kind, data = _text(x.get("type")), jsonops._image_data(x)
                    rows.append((
                        s, n, i, kind, _text(x.get("thinking") if kind == "thinking" else x.get("text")), _text(x.get("id")), _text(x.get("name")),
                        clean(json.dumps(x["input"], ensure_ascii=False)) if "input" in x else None, _text(x.get("tool_use_id")), x["is_error"] if isinstance(x.get("is_error"), bool) else None,
                        clean(jsonops._result_text(x)) if kind == "tool_result" else None, len(data) if data is not None else None,
                    ))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return lines.select("source", "line_no", "raw_json").mapInArrow(run, schema)


def read_map(path: str) -> dict:
    """A sidecar map (lineage, cached summaries); missing or corrupt files count as empty."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
    except (OSError, ValueError):
        return {}
    return held if isinstance(held, dict) else {}


class SideTable:
    """A small keyed table beside the transcripts (lineage, cached summaries) in a folder on any file system.

    Each change writes a whole new version and then its mark, so readers see the version before or after; of equal keys
    the row with the greatest `at` counts. Two writers at once are told apart by the mark, which is created, never replaced.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str) -> None:
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *p: path("/".join((self.folder, *p)))
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        marks = self._path("marks")
        return max((int(f.getPath().getName()) for f in self.fs.listStatus(marks)), default=-1) if self.fs.exists(marks) else -1

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v < 0 else self.spark.read.schema(self.schema).parquet(str(self._path(f"v{v}")))

    def _write(self, d: DataFrame, was: int) -> None:
        place = f"v{was + 1}"
        cut_lineage(d).write.mode("errorifexists").parquet(str(self._path(place)))
        self.fs.create(self._path("marks", str(was + 1)), False).close()

    def upsert(self, rows: DataFrame) -> None:
        was = self.version()
        both = self.read().unionByName(rows.select(*[c.split()[0] for c in self.schema.split(", ")]))
        others = [c for c in both.columns if c not in (self.key, "at")]
        last = both.groupBy(self.key).agg(F.max(F.struct("at", *others)).alias("x")).select(self.key, "x.*")
        self._write(last.select(both.columns), was)

    def remove(self, keys: DataFrame) -> None:
        self._write(self.read().join(keys.select(self.key), self.key, "left_anti"), self.version())


def lineage_table(spark: SparkSession, folder: str) -> SideTable:
    return SideTable(spark, folder, "child string, parent string, output string, at long", "child")


def summary_cache(spark: SparkSession, folder: str) -> SideTable:
    return SideTable(spark, folder, "content_hash string, summary string, at long", "content_hash")


def write_twins(rows: DataFrame, folder: str, name: Callable[[str], str], verify: Callable[[DataFrame], DataFrame] | None = None) -> list[str]:
    """Writes raw lines (session_id, out_pos, raw_json) as folder/<name(session_id)>.jsonl, one file per session.

    Files are written to a staging folder, checked (verify gives rows with ok), and only then moved into place; nothing
    is left behind if a check fails. A file that is there already is refused. Returns the names.
    """
    import uuid

    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    stage = f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    try:
        if verify is not None and (bad := verify(rows).filter("not ok").limit(5).collect()):
            raise ValueError(f"not written: {[tuple(r) for r in bad]}")
        d = rows.select(F.col("session_id"), "out_pos", F.col("raw_json").alias("value")).repartition("session_id").sortWithinPartitions("session_id", "out_pos")
        d.select("session_id", "value").write.option("maxRecordsPerFile", 0).partitionBy("session_id").text(stage)
        moves = []
        for folder_ in fs.listStatus(path(stage)):
            if folder_.isDirectory():
                from urllib.parse import unquote

                session = unquote(folder_.getPath().getName().partition("=")[2])
                part = next(f.getPath() for f in fs.listStatus(folder_.getPath()) if f.getPath().getName().startswith("part-"))
                moves.append((part, path(f"{folder.rstrip('/')}/{name(session)}.jsonl")))
        taken = [str(to) for _, to in moves if fs.exists(to)]
        if taken:
            raise FileExistsError(f"refusing to overwrite {taken[:5]}")
        for part, to in moves:
            fs.rename(part, to)
        return sorted(to.getName() for _, to in moves)
    finally:
        fs.delete(path(stage), True)


def dump(expanded: DataFrame, lines: DataFrame) -> DataFrame:
    """The raw lines behind expanded records (from_session, from_line), in order: session_id, line_no, from_session, from_line, raw_json."""
    raw = lines.select(F.col("source").alias("from_session"), F.col("line_no").alias("from_line"), "raw_json")
    return expanded.join(raw, ["from_session", "from_line"]).select("session_id", "line_no", "from_session", "from_line", "raw_json")
