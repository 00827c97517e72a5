"""The front end that every transcript query shares: records once each, classified, and segmented by genuine turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import TEXT_BLOCKS, flag, norm_id
from ..operators import hierarchy
from ..session import cut_lineage
from . import blocked

#: How delivered messages begin, and the closed vocabularies of types (fixed values).
TEAMMATE = "Another Claude session sent a message:\n<teammate-message "
NOTIFICATION = "<task-notification>"
RECORD_TYPES = (
    "user", "assistant", "system", "summary", "last-prompt", "attachment", "mode", "permission-mode", "bridge-session", "ai-title",
    "file-history-snapshot", "file-history-delta", "pr-link", "queue-operation", "custom-title", "agent-name", "relocated", "worktree-state",
)
BLOCK_TYPES = ("text", "thinking", "redacted_thinking", "tool_use", "tool_result", "image", "document", "fallback", "server_tool_use", "web_search_tool_result")
#: Images weigh at most so many characters; results and inputs are masked beyond these sizes (fixed values).
IMAGE_CHARS, RESULT_KEPT, ERROR_KEPT, INPUT_KEPT = 6400, 500, 2000, 2000


def _body() -> tuple[Column, Column]:
    body = F.get_json_object("message", "$.content")
    return body, F.from_json(body, TEXT_BLOCKS)


def first_text() -> Column:
    """String content, else the first text block that has a text."""
    body, blocks = _body()
    texts = F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull())
    return F.when(F.col("content_kind") == "string", body).when(F.col("content_kind") == "array", F.try_element_at(texts, F.lit(1))["text"])


def _marker(df: DataFrame) -> Column:
    """What an earlier masking noted of a delivered record, where the table has it."""
    return F.col("delivered_marker") if "delivered_marker" in df.columns else F.lit(None).cast("string")


def delivered_kind(marker: Column | None = None) -> Column:
    """'teammate_message' or 'task_notification' for a user record that another agent or the harness delivered, else null.

    A marker, which masking leaves where it cuts the sentinel, says so first.
    """
    text = first_text()
    user = (F.col("rec_type") == "user") & ~flag("is_meta") & ~flag("is_compact_summary")
    marked = F.lit(None).cast("string") if marker is None else F.when(marker == "task_notification", marker).when(marker.isNotNull(), "teammate_message")
    own = user & ~flag("has_source_tool")
    return F.when(user & marked.isNotNull(), marked).when(own & text.startswith(TEAMMATE), "teammate_message").when(own & text.startswith(NOTIFICATION), "task_notification")


def is_genuine(marker: Column | None = None) -> Column:
    """A turn typed by the user: string content, or an array without tool results; nothing delivered."""
    _, blocks = _body()
    content = F.when(F.col("content_kind") == "string", True).when(
        F.col("content_kind") == "array", ~F.exists(F.coalesce(blocks, F.array().cast(TEXT_BLOCKS)), lambda b: F.coalesce(b["type"] == "tool_result", F.lit(False)))
    ).otherwise(False)
    own = (F.col("rec_type") == "user") & ~flag("is_meta") & ~flag("is_compact_summary") & ~flag("has_source_tool")
    return F.coalesce(own & content & delivered_kind(marker).isNull(), F.lit(False))


def records_once(records: DataFrame, *extra: Column) -> DataFrame:
    """One row per (session_id, line_no), of the latest delivery, with sizes in place of messages."""
    d = records.select(
        norm_id("session_id").alias("session_id"), F.col("line_no").cast("long").alias("line_no"),
        F.struct(
            "ingested_at", F.coalesce("rec_type", F.lit("")).alias("rec_type"), norm_id("uuid").alias("uuid"), norm_id("parent_uuid").alias("parent_uuid"),
            F.coalesce(F.octet_length("message"), F.lit(0)).cast("long").alias("n_bytes"), is_genuine(_marker(records)).alias("is_genuine"),
            flag("is_compact_summary").alias("is_compact_summary"), flag("is_synthetic").alias("is_synthetic"), flag("is_masked").alias("is_masked"),
            flag("is_ledger").alias("is_ledger"), flag("is_preamble").alias("is_preamble"), norm_id("leaf_uuid").alias("leaf_uuid"), *extra,
        ).alias("x"),
    )
    return d.groupBy("session_id", "line_no").agg(F.max("x").alias("x")).select("session_id", "line_no", "x.*").drop("ingested_at")


def segmented(records: DataFrame, *extra: Column) -> DataFrame:
    """records_once with seg: the number of genuine turns up to the row, less one; the head has -1. What has seg stays."""
    if "seg" in records.columns:
        return records
    r = blocked.running_sum(records_once(records, *extra), ["session_id"], "line_no", F.col("is_genuine").cast("int"), "seg")
    return r.withColumn("seg", F.col("seg") - 1)


def unit_view(records: DataFrame, *extra: Column) -> DataFrame:
    """segmented records as units see them: on the active path, without preambles. Every hash is taken of this view."""
    active = active_path(records).select("session_id", "line_no")
    r = records_once(records, *extra).join(active, ["session_id", "line_no"], "left_semi").filter("not is_preamble")
    r = blocked.running_sum(r, ["session_id"], "line_no", F.col("is_genuine").cast("int"), "seg")
    return r.withColumn("seg", F.col("seg") - 1)


def blocks_once(blocks: DataFrame) -> DataFrame:
    """Distinct content blocks with comparable ids."""
    return blocks.select(
        norm_id("session_id").alias("session_id"), F.col("line_no").cast("long").alias("line_no"), F.col("pos").cast("long").alias("pos"), "block_type", "text",
        norm_id("tool_id").alias("tool_id"), "tool_name", "tool_input", norm_id("tool_use_id").alias("tool_use_id"), flag("is_error").alias("is_error"), "result_text",
        F.coalesce("image_len", F.lit(0)).cast("long").alias("image_len"),
    ).dropDuplicates(["session_id", "line_no", "pos"])


def with_segments(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """blocks_once with the segment of their record."""
    return blocks_once(blocks).join(segmented(records).select("session_id", "line_no", "seg", "is_genuine"), ["session_id", "line_no"])


def leaf_of(r: DataFrame) -> DataFrame:
    """session_id, leaf: what the last last-prompt row names, if it is there, else the last row with a uuid."""
    last = r.filter("rec_type = 'last-prompt'").groupBy("session_id").agg(F.max_by("leaf_uuid", "line_no").alias("uuid"))
    named = r.filter("uuid is not null").select("session_id", "uuid").distinct().join(last, ["session_id", "uuid"]).select("session_id", F.col("uuid").alias("named"))
    latest = r.filter("uuid is not null").groupBy("session_id").agg(F.max_by("uuid", "line_no").alias("latest"))
    return latest.join(named, "session_id", "left").select("session_id", F.coalesce("named", "latest").alias("leaf"))


def active_path(records: DataFrame) -> DataFrame:
    """Rows (session_id, line_no, uuid) on the way from each session's leaf to its root, and all rows without uuid.

    The last of several rows of one uuid counts; a cycle is walked once; a session without leaf is active as a whole
    (it has rows without uuid only).
    """
    r = cut_lineage(records_once(records))
    nodes = r.filter("uuid is not null").groupBy(F.col("session_id").alias("tree"), F.col("uuid").alias("id")).agg(F.max(F.struct("line_no", "parent_uuid")).alias("x"))
    nodes = cut_lineage(nodes.select("tree", "id", F.col("x.parent_uuid").alias("up"), F.col("x.line_no").alias("pos")))
    found = hierarchy.reach(nodes, leaf_of(r).select(F.col("session_id").alias("tree"), F.col("leaf").alias("id")))
    on_path = found.join(nodes, ["tree", "id"]).select(F.col("tree").alias("session_id"), F.col("pos").alias("line_no"), F.col("id").alias("uuid"))
    return on_path.unionByName(r.filter("uuid is null").select("session_id", "line_no", "uuid"))
