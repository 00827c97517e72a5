"""Relational operators over transcripts: pairing, grading, indexes, chains, plans, lineage and verification.

Each takes the tables of TESTDATA.md (records, blocks) and returns a DataFrame. Order within a session is line_no and
pos. Where a group can be as large as a session, the blocked operators of plans.blocked replace plain windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import flag, message_text, norm_id
from ..functions.columns_text import corrects, is_blank, truncate, truncate_head_tail
from ..plans import blocked, transcript as tr
from ..session import cut_lineage

LONG = "bigint"


def segment_summary(records: DataFrame) -> DataFrame:
    """Records and estimated tokens (bytes / 4, floored once) per segment; seg -1 is the head."""
    return tr.segmented(records).groupBy("session_id", "seg").agg(F.count("*").alias("n_records"), F.floor(F.sum("n_bytes") / 4).cast(LONG).alias("tokens"))


def record_types(records: DataFrame) -> DataFrame:
    """Records per type; deliveries of one record count once, a missing type is ''."""
    return tr.records_once(records).groupBy(F.col("rec_type").alias("type")).agg(F.count("*").alias("n"))


def block_types(blocks: DataFrame) -> DataFrame:
    """Blocks per type; equal rows count once, blocks without a type not at all."""
    return tr.blocks_once(blocks).filter("block_type is not null").groupBy(F.col("block_type").alias("type")).agg(F.count("*").alias("n"))


def tool_result_names(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """Results with the name of their call in the same segment; the last call of an id wins; '' where there is none."""
    b = tr.with_segments(blocks, records)
    uses = b.filter("block_type = 'tool_use' and tool_id is not null").groupBy("session_id", "seg", F.col("tool_id").alias("tool_use_id")).agg(
        F.max(F.struct("line_no", "pos", F.coalesce("tool_name", F.lit("")).alias("called"))).alias("x")
    ).select("session_id", "seg", "tool_use_id", "x.called")
    return b.filter("block_type = 'tool_result'").join(uses, ["session_id", "seg", "tool_use_id"], "left").select(
        "session_id", "seg", "line_no", "pos", "tool_use_id", F.coalesce("called", F.lit("")).alias("tool"), "is_error", F.coalesce("result_text", F.lit("")).alias("result")
    )


def _pairs(blocks: DataFrame) -> DataFrame:
    b = tr.blocks_once(blocks)
    place = F.struct("line_no", "pos")
    return b.filter("coalesce(tool_id, tool_use_id) is not null and block_type in ('tool_use', 'tool_result')").groupBy(
        "session_id", F.when(F.col("block_type") == "tool_use", F.col("tool_id")).otherwise(F.col("tool_use_id")).alias("id")
    ).agg(
        F.min(F.when(F.col("block_type") == "tool_use", place)).alias("first_use"), F.max(F.when(F.col("block_type") == "tool_use", place)).alias("last_use"),
        F.min(F.when(F.col("block_type") == "tool_result", place)).alias("first_result"), F.max(F.when(F.col("block_type") == "tool_result", place)).alias("last_result"),
    ).filter("id is not null")


def dangling_tool_use(blocks: DataFrame) -> DataFrame:
    """Calls without any later result: session_id, id."""
    return _pairs(blocks).filter("first_use is not null and (last_result is null or last_result <= first_use)").select("session_id", "id")


def orphan_tool_result(blocks: DataFrame) -> DataFrame:
    """Results without an earlier call: session_id, id."""
    return _pairs(blocks).filter("first_result is not null and (first_use is null or first_use >= last_result)").select("session_id", "id")


def graded_results(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """Each result's status (error, empty, duplicate, ok) and what is shown of it.

    A duplicate repeats the tool and text of an earlier result of its segment that is no error and not empty.
    """
    r = tool_result_names(blocks, records)
    plain = ~F.col("is_error") & ~is_blank("result")
    key = F.when(plain, F.struct("tool", "result"))
    first = r.filter(plain).groupBy("session_id", "seg", F.xxhash64("tool", "result").alias("h"), "tool", F.md5("result").alias("m")).agg(F.min(F.struct("line_no", "pos")).alias("first"))
    r = r.withColumn("h", F.xxhash64("tool", "result")).withColumn("m", F.md5("result")).join(first, ["session_id", "seg", "h", "tool", "m"], "left")
    status = F.when(F.col("is_error"), "error").when(is_blank("result"), "empty").when(key.isNotNull() & (F.col("first") < F.struct("line_no", "pos")), "duplicate").otherwise("ok")
    shown = (
        F.when(status == "error", truncate_head_tail("result", 4000, 0.5)).when(status == "empty", "[empty result]")
        .when(status == "duplicate", "[identical to an earlier result in this segment]").otherwise(truncate_head_tail("result", 1500, 0.6))
    )
    return r.select("session_id", "seg", "line_no", "pos", "tool", status.alias("status"), F.char_length("result").cast(LONG).alias("chars"), shown.alias("shown"))


def derived_files(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """What each segment did to each file: roles in order of first appearance."""
    path = F.coalesce(F.get_json_object("tool_input", "$.file_path"), F.get_json_object("tool_input", "$.notebook_path"))
    role = F.when(F.col("tool_name") == "Read", "read").when(F.col("tool_name").isin("Edit", "NotebookEdit"), "edited").when(F.col("tool_name") == "Write", "written")
    d = tr.with_segments(blocks, records).filter("block_type = 'tool_use'").select("session_id", "seg", "line_no", "pos", path.alias("path"), role.alias("role"))
    d = d.filter("path is not null and role is not null").groupBy("session_id", "seg", "path", "role").agg(F.min(F.struct("line_no", "pos")).alias("at"))
    return d.groupBy("session_id", "seg", "path").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "role"))), lambda x: x["role"]), ",").alias("roles")
    )


def derived_tool_counts(blocks: DataFrame, records: DataFrame) -> DataFrame:
    return tr.with_segments(blocks, records).filter("block_type = 'tool_use'").groupBy("session_id", "seg", F.coalesce("tool_name", F.lit("")).alias("tool")).agg(F.count("*").alias("n"))


def derived_commands(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """Commands that were run, cut to 200 characters."""
    d = tr.with_segments(blocks, records).filter("block_type = 'tool_use' and tool_name = 'Bash'").select(
        "session_id", "seg", "line_no", "pos", F.get_json_object("tool_input", "$.command").alias("c")
    )
    return d.filter("c is not null").select("session_id", "seg", "line_no", "pos", truncate("c", 200).alias("command"))


def derived_errors(blocks: DataFrame, records: DataFrame) -> DataFrame:
    return tr.with_segments(blocks, records).groupBy("session_id", "seg").agg(F.count_if((F.col("block_type") == "tool_result") & F.col("is_error")).alias("error_count"))


def segment_index(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """The index of each segment in one row, keys in order: files (path=roles;...), tool_counts (tool=n;...), n_commands, error_count."""
    b = cut_lineage(tr.with_segments(blocks, records).select("session_id", "seg", "block_type", "tool_name", "tool_input", "is_error"))
    key = ["session_id", "seg"]
    command = F.get_json_object("tool_input", "$.command").isNotNull() & (F.col("tool_name") == "Bash") & (F.col("block_type") == "tool_use")
    k = b.groupBy(*key).agg(F.count_if((F.col("block_type") == "tool_result") & F.col("is_error")).alias("error_count"), F.count_if(command).alias("n_commands"))
    calls = b.filter("block_type = 'tool_use'").groupBy(*key, F.coalesce("tool_name", F.lit("")).alias("tool")).agg(F.count("*").alias("n"))
    counts = calls.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tool", "n"))), lambda x: F.concat(x["tool"], F.lit("="), x["n"].cast("string"))), ";").alias("tool_counts"))
    files = derived_files(blocks, records).groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "roles"))), lambda x: F.concat(x["path"], F.lit("="), x["roles"])), ";").alias("files"))
    return k.join(files, key, "left").join(counts, key, "left").select(*key, F.coalesce("files", F.lit("")).alias("files"), F.coalesce("tool_counts", F.lit("")).alias("tool_counts"), "n_commands", "error_count")


def chain_check(records: DataFrame) -> DataFrame:
    """Rows whose parent isn't the row with a uuid before (the first has none)."""
    r = tr.records_once(records).filter("uuid is not null")
    r = blocked.previous(r, ["session_id"], "line_no", F.col("uuid"), "before")
    return r.filter(~F.col("parent_uuid").eqNullSafe(F.col("before"))).select("session_id", "line_no", "uuid", "parent_uuid", F.col("before").alias("expected_parent"))


def rechain(records: DataFrame) -> DataFrame:
    """Rows with a uuid, chained one after the other."""
    r = tr.records_once(records).filter("uuid is not null")
    return blocked.previous(r, ["session_id"], "line_no", F.col("uuid"), "new_parent").select("session_id", "line_no", "uuid", "new_parent")


def _with_corrections(records: DataFrame) -> DataFrame:
    return records if "corrects" in records.columns else tr.segmented(records, F.when(tr.is_genuine(tr._marker(records)), corrects(message_text("message", "content_kind"))).alias("corrects"))


def segments_of(records: DataFrame) -> DataFrame:
    """One row per segment from 0: flags, sizes, whether an agent acted in it, and its place from the end."""
    r = _with_corrections(records).filter("seg >= 0")
    s = r.groupBy("session_id", "seg").agg(
        F.bool_or("is_compact_summary").alias("has_summary"), F.bool_or("is_ledger").alias("has_ledger"), F.bool_or("is_synthetic").alias("has_synthetic"),
        F.bool_or(~F.col("is_genuine") & F.col("uuid").isNotNull()).alias("has_activity"), F.bool_or(F.coalesce("corrects", F.lit(False))).alias("corrects"),
        F.sum(F.when(F.col("is_genuine"), F.col("n_bytes")).otherwise(0)).alias("turn_bytes"), F.sum(F.when(~F.col("is_genuine"), F.col("n_bytes")).otherwise(0)).alias("activity_bytes"),
    )
    return blocked.rank_from_end(s, ["session_id"], "seg", "from_end")


def pinned_segments(records: DataFrame, keep: int = 1, epochs: bool = False) -> DataFrame:
    """Which segments stay verbatim, and which need a summary."""
    return _pinned(segments_of(records), keep, epochs)


def _pinned(s: DataFrame, keep: int = 1, epochs: bool = False) -> DataFrame:
    pinned = F.col("has_summary") | F.col("has_ledger") | (F.lit(not epochs) & F.col("has_synthetic"))
    kept = pinned | (F.col("from_end") <= keep)
    return s.select("session_id", "seg", kept.alias("kept_verbatim"), (~kept & F.col("has_activity")).alias("needs_summary"))


def keep_tail(records: DataFrame, keep: int = 1) -> DataFrame:
    return segments_of(records).filter(F.col("from_end") <= keep).select("session_id", "seg")


def file_overlap(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """Per segment: its files, and how many of them a later segment touches again.

    A file is touched later if its last segment is later, so no suffix sets are carried along.
    """
    f = derived_files(blocks, records).filter("seg >= 0").select("session_id", "seg", "path")
    last = f.groupBy("session_id", "path").agg(F.max("seg").alias("last_seg"))
    return f.join(last, ["session_id", "path"]).groupBy("session_id", "seg").agg(F.count("*").alias("n_files"), F.count_if(F.col("last_seg") > F.col("seg")).alias("n_later"))


def salience(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """0.1, plus 0.4 if a result failed, 0.3 for the share of files touched again, 0.3 if the next turn corrects; at most 1."""
    records = cut_lineage(_with_corrections(records)) if "corrects" not in records.columns else records
    s = cut_lineage(segments_of(records))
    err = derived_errors(blocks, records)
    over = file_overlap(blocks, records)
    nxt = blocked.rank_from_end(s.select("session_id", "seg", "corrects"), ["session_id"], "seg", "k").select("session_id", (F.col("k") + 1).alias("from_end"), F.col("corrects").alias("next_corrects"))
    f = lambda x: F.lit(x).cast("float")
    value = (
        f(0.1) + F.when(F.coalesce("error_count", F.lit(0)) > 0, f(0.4)).otherwise(f(0.0))
        + f(0.3) * F.coalesce(F.col("n_later").cast("float") / F.greatest(F.col("n_files"), F.lit(1)).cast("float"), f(0.0)).cast("float")
        + F.when(F.coalesce("next_corrects", F.lit(False)), f(0.3)).otherwise(f(0.0))
    )
    return (
        s.join(err, ["session_id", "seg"], "left").join(over, ["session_id", "seg"], "left").join(nxt, ["session_id", "from_end"], "left")
        .select("session_id", "seg", (F.coalesce("error_count", F.lit(0)) > 0).alias("is_error"), F.least(value.cast("float"), f(1.0)).alias("salience"))
    )


def mask_costs(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """Per segment: bytes of block contents as they are and as masked (results, inputs and images beyond their sizes)."""
    b = tr.with_segments(blocks, records)
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast(LONG)
    whole = size("text") + size("tool_input") + size("result_text") + F.least("image_len", F.lit(tr.IMAGE_CHARS))
    result = F.when(F.col("is_error"), F.least(size("result_text"), F.lit(tr.ERROR_KEPT))).when(F.char_length("result_text") <= tr.RESULT_KEPT, size("result_text")).otherwise(F.lit(60))
    masked = (
        F.when((F.col("block_type") == "thinking") & is_blank("text"), 0).when(F.col("block_type") == "tool_result", result)
        .when(F.col("block_type") == "tool_use", F.least(size("tool_input"), F.lit(tr.INPUT_KEPT))).otherwise(whole)
    )
    return b.groupBy("session_id", "seg").agg(F.floor(F.sum(whole) / 4).cast(LONG).alias("verbatim_tokens"), F.floor(F.sum(F.coalesce(masked, F.lit(0))) / 4).cast(LONG).alias("masked_tokens"))


def plan_units(blocks: DataFrame, records: DataFrame, keep: int = 1, summaries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments that may be demoted, with the costs of their treatments (verbatim, masked, summarised), and each session's
    fixed cost: its genuine turns, and the activity of segments kept whole.

    summaries: session_id, seg, summary; a known summary costs a quarter of its bytes and 60, an unknown one 400.
    """
    records = cut_lineage(_with_corrections(records))  # read by each of the parts below
    s = cut_lineage(segments_of(records))
    p = _pinned(s, keep)
    fixed = s.join(p, ["session_id", "seg"]).groupBy("session_id").agg(
        F.sum(F.floor(F.col("turn_bytes") / 4) + F.when(F.col("kept_verbatim"), F.floor(F.col("activity_bytes") / 4)).otherwise(0)).cast(LONG).alias("fixed")
    )
    c = mask_costs(blocks, records)
    mask = F.least("masked_tokens", "verbatim_tokens")
    u = p.filter("not kept_verbatim").join(c, ["session_id", "seg"], "left").join(salience(blocks, records), ["session_id", "seg"]).na.fill(0, ["verbatim_tokens", "masked_tokens"])
    known = F.lit(None).cast(LONG)
    if summaries is not None:
        u = u.join(summaries.select("session_id", "seg", (F.floor(F.octet_length("summary") / 4) + 60).cast(LONG).alias("known")), ["session_id", "seg"], "left")
        known = F.col("known")
    u = u.select(
        "session_id", "seg", "salience", "is_error", F.col("verbatim_tokens").alias("cost_v"), mask.alias("cost_m"),
        F.least(F.coalesce(known, F.lit(400).cast(LONG)), mask).alias("cost_s"), known.isNotNull().alias("has_summary"),
    )
    return u, fixed


def plan_budget(units: DataFrame, target: int, allow_summarize: bool = True, summarize_errors: bool = False, fixed: DataFrame | None = None) -> DataFrame:
    """The treatment of each unit (0 verbatim, 1 masked, 2 summarised) so that a session's total, with what is fixed, falls to target.

    The greedy plan (largest saving times (1 - salience) first, lowest unit on ties) in closed form: a unit has at most
    two steps, the second counts no earlier than the first, so a running sum over the ordered steps says which apply.
    A session's steps are parted by their score (eighths of its logarithm), and sums of whole parts carry over, so that no
    task holds a session.
    """
    f = lambda c: F.col(c).cast("float")
    rest = F.lit(1.0).cast("float") - f("salience")
    may_sum = F.lit(allow_summarize) & (~F.col("is_error") | F.lit(summarize_errors))
    u = units.withColumn("m1", F.col("cost_v") - F.col("cost_m")).withColumn("s1", F.when(F.col("m1") > 0, F.col("m1")).otherwise(F.when(may_sum, F.col("cost_v") - F.col("cost_s")).otherwise(0)))
    u = u.withColumn("s2", F.when((F.col("m1") > 0) & may_sum, F.col("cost_m") - F.col("cost_s")).otherwise(0))
    u = u.withColumn("e1", (f("s1") * rest).cast("float")).withColumn("e2", F.least((f("s2") * rest).cast("float"), F.col("e1")))
    steps = u.select("session_id", "seg", F.explode(F.array(
        F.struct(F.lit(1).alias("step"), F.col("s1").alias("saving"), F.col("e1").alias("eff"), F.when(F.col("m1") > 0, 1).otherwise(2).alias("to")),
        F.struct(F.lit(2).alias("step"), F.col("s2").alias("saving"), F.col("e2").alias("eff"), F.lit(2).alias("to")),
    )).alias("x")).select("session_id", "seg", "x.*").filter("saving > 0")
    steps = steps.withColumn("part", F.when(F.col("eff") > 0, F.floor(F.log2(F.col("eff").cast("double")) * 8)).otherwise(-10_000))
    order = Window.partitionBy("session_id", "part").orderBy(F.desc("eff"), "seg", "step").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("session_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = steps.groupBy("session_id", "part").agg(F.sum("saving").alias("s")).select("session_id", "part", F.coalesce(F.sum("s").over(across), F.lit(0)).alias("before"))
    totals = units.groupBy("session_id").agg(F.sum("cost_v").alias("total"))
    if fixed is not None:
        totals = totals.join(fixed, "session_id", "left").select("session_id", (F.col("total") + F.coalesce("fixed", F.lit(0))).alias("total"))
    applied = steps.withColumn("inside", F.coalesce(F.sum("saving").over(order), F.lit(0))).join(parts, ["session_id", "part"]).join(totals, "session_id").filter(F.col("total") - F.col("before") - F.col("inside") > target)
    best = applied.groupBy("session_id", "seg").agg(F.max("to").alias("t"))
    t = F.coalesce("t", F.lit(0))
    cost = F.when(t == 0, F.col("cost_v")).when(t == 1, F.col("cost_m")).otherwise(F.col("cost_s"))
    return units.join(best, ["session_id", "seg"], "left").select("session_id", "seg", t.cast("int").alias("treatment"), cost.alias("cost"))


def budget_totals(plan: DataFrame, units: DataFrame, fixed: DataFrame, target: int) -> DataFrame:
    """Per session: units by treatment, what is fixed, the planned total, whether it misses the target (then floors hold),
    summaries still to be written, and error units summarised."""
    d = plan.join(units.select("session_id", "seg", "is_error", "has_summary"), ["session_id", "seg"])
    is_sum = F.col("treatment") == 2
    d = d.groupBy("session_id").agg(
        F.count("*").alias("n_units"), F.count_if(F.col("treatment") == 0).alias("n_verbatim"), F.count_if(F.col("treatment") == 1).alias("n_masked"),
        F.count_if(is_sum).alias("n_summarized"), F.count_if(is_sum & ~F.col("has_summary")).alias("n_to_write"), F.count_if(is_sum & F.col("is_error")).alias("n_errors_summarized"), F.sum("cost").alias("cost"),
    )
    total = (F.coalesce("cost", F.lit(0)) + F.col("fixed")).cast(LONG)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return fixed.join(d, "session_id", "left").select(
        "session_id", *map(zero, ("n_units", "n_verbatim", "n_masked", "n_summarized", "n_to_write", "n_errors_summarized")), "fixed", total.alias("tokens"), (total > target).alias("is_over")
    )


def work_list(plan: DataFrame, units: DataFrame) -> DataFrame:
    """Units that are to be summarised and have no summary yet: session_id, seg."""
    return plan.filter("treatment = 2").join(units.filter("not has_summary"), ["session_id", "seg"], "left_semi").select("session_id", "seg")


def render_activity(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """Items of activity: session_id, seg, line_no, pos, kind, tool, status, chars, shown.

    Kinds: assistant_text, thinking, tool_use (shown: its input), tool_result (graded), compact_summary, delivered_message
    (status: its kind) and system. tool, status and chars are '' and 0 where a kind has none.
    """
    marker = tr._marker(records)
    kind = F.when(F.col("rec_type") == "system", "system").when(F.col("rec_type") != "user", None).when(flag("is_compact_summary"), "compact_summary").when(tr.delivered_kind(marker).isNotNull(), "delivered_message")
    text = F.when(F.col("rec_type") == "system", F.get_json_object("message", "$.content")).when(flag("is_compact_summary"), message_text("message", "content_kind")).otherwise(tr.first_text())
    r = tr.segmented(records, kind.alias("own_kind"), F.when(kind.isNotNull(), F.coalesce(text, F.lit(""))).alias("own_text"), tr.delivered_kind(marker).alias("delivered")).filter("not is_genuine")
    r = cut_lineage(r.select("session_id", "line_no", "seg", "rec_type", "own_kind", "own_text", "delivered"))
    none = (F.lit("").alias("tool"), F.lit("").alias("status"), F.lit(0).cast(LONG).alias("chars"))
    own = r.filter("own_kind is not null").select(
        "session_id", "seg", "line_no", F.lit(0).cast(LONG).alias("pos"), F.col("own_kind").alias("kind"), F.lit("").alias("tool"), F.coalesce("delivered", F.lit("")).alias("status"),
        F.when(F.col("own_kind") == "delivered_message", F.char_length("own_text")).otherwise(0).cast(LONG).alias("chars"),
        F.when(F.col("own_kind") == "delivered_message", truncate_head_tail("own_text", 8000, 0.7)).when(F.col("own_kind") == "system", truncate("own_text", 400)).otherwise(truncate("own_text", 4000)).alias("shown"),
    )
    b = tr.blocks_once(blocks).join(r.filter("own_kind is null").select("session_id", "line_no", "seg", "rec_type"), ["session_id", "line_no"])
    said = b.filter("rec_type = 'assistant' and block_type in ('text', 'thinking', 'tool_use')").select(
        "session_id", "seg", "line_no", "pos", F.when(F.col("block_type") == "text", "assistant_text").otherwise(F.col("block_type")).alias("kind"),
        F.when(F.col("block_type") == "tool_use", F.coalesce("tool_name", F.lit(""))).otherwise("").alias("tool"), *none[1:],
        F.when(F.col("block_type") == "tool_use", F.coalesce("tool_input", F.lit("null"))).otherwise(F.coalesce("text", F.lit(""))).alias("shown"),
    )
    user = r.filter("rec_type = 'user' and own_kind is null").select("session_id", "line_no")
    results = graded_results(blocks, records).join(user, ["session_id", "line_no"], "left_semi").select("session_id", "seg", "line_no", "pos", F.lit("tool_result").alias("kind"), "tool", "status", "chars", "shown")
    return said.unionByName(results).unionByName(own)


def unit_digest(blocks: DataFrame, records: DataFrame, cap: int = 8000) -> DataFrame:
    """One text per segment: what the user asked and a line per item (thoughts left out), lines and the whole cut to their caps.

    Lines beyond the cap can't show, but their length does, so each segment gathers only the lines that begin within
    the cap, and counts the characters of all.
    """
    k = F.col("kind")
    line = (
        F.when(k == "assistant_text", F.concat(F.lit("ASSISTANT: "), truncate("shown", 900))).when(k == "tool_use", F.concat(F.lit("TOOL "), "tool", F.lit(" "), truncate("shown", 150)))
        .when(k == "tool_result", F.concat(F.lit("RESULT["), "status", F.lit(","), F.col("chars").cast("string"), F.lit("]: "), truncate("shown", 250)))
        .when(k == "delivered_message", F.concat(F.lit("AGENT-REPORT("), "status", F.lit("): "), truncate("shown", 700)))
        .when(k == "compact_summary", F.concat(F.lit("COMPACT-SUMMARY: "), truncate("shown", 400))).when(k == "system", F.concat(F.lit("SYSTEM: "), truncate("shown", 200)))
    )
    items = render_activity(blocks, records).filter("kind <> 'thinking' and seg >= 0").select("session_id", "seg", (F.col("line_no") * 100_000 + F.col("pos")).alias("at"), line.alias("line"))
    asked = tr.segmented(records, F.when(tr.is_genuine(tr._marker(records)), F.coalesce(message_text("message", "content_kind"), F.lit(""))).alias("asked")).filter("is_genuine")
    d = items.unionByName(asked.select("session_id", "seg", (F.col("line_no") * 100_000).alias("at"), F.concat(F.lit("USER ASKED: "), truncate("asked", 600)).alias("line")))
    d = blocked.running_sum(d, ["session_id", "seg"], "at", F.char_length("line") + 1, "ends", width=blocked.WIDTH * 100_000)
    return d.groupBy("session_id", "seg").agg(
        F.sort_array(F.collect_list(F.when(F.col("ends") - F.char_length("line") <= cap + 1, F.struct("at", "line")))).alias("lines"), (F.sum(F.char_length("line") + 1) - 1).alias("n_chars")
    ).select("session_id", "seg", "n_chars", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("t")).select(
        "session_id", "seg", F.when(F.col("n_chars") <= cap, F.col("t")).otherwise(F.concat(F.left("t", F.lit(cap)), F.lit("…[+"), (F.col("n_chars") - cap).cast("string"), F.lit(" chars]"))).alias("digest")
    )


def superseded(l: DataFrame) -> DataFrame:
    """Sessions, and whether another goes on from them."""
    parents = l.filter("parent is not null").select(F.col("parent").alias("child"), F.lit(True).alias("is_superseded")).distinct()
    return l.select("child").join(parents, "child", "left").select("child", F.coalesce("is_superseded", F.lit(False)).alias("is_superseded"))


def rehydrate(records: DataFrame) -> DataFrame:
    """The raw records behind each synthetic one: (synthetic) session_id, line_no, and source line and uuid."""
    r = records.select(norm_id("session_id").alias("session_id"), F.col("line_no").cast(LONG).alias("line_no"), norm_id("provenance.source_session_id").alias("source"), F.explode("provenance.covered_uuids").alias("u")).select(
        "session_id", "line_no", "source", norm_id("u").alias("uuid")
    ).distinct()
    raw = tr.records_once(records).filter("uuid is not null and not is_synthetic and not is_masked").select(F.col("session_id").alias("source"), "uuid", F.col("line_no").alias("source_line"))
    return r.join(raw.groupBy("source", "uuid").agg(F.min("source_line").alias("source_line")), ["source", "uuid"]).select("session_id", "line_no", "source", "source_line", "uuid")


def verify(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Structural checks per session: session_id, check_name, ok."""
    r = tr.records_once(records)
    sessions = r.select("session_id").distinct()
    broken = lambda d, name: d.groupBy("session_id").agg(F.lit(False).alias("ok")).join(sessions, "session_id", "right").select("session_id", F.lit(name).alias("check_name"), F.coalesce("ok", F.lit(True)).alias("ok"))
    known = r.filter("uuid is not null").select("session_id", "uuid").distinct()
    lost = r.filter("parent_uuid is not null").join(known.select("session_id", F.col("uuid").alias("parent_uuid")), ["session_id", "parent_uuid"], "left_anti")
    twice = r.filter("uuid is not null").groupBy("session_id", "uuid").count().filter("count > 1")
    leaves = r.filter("rec_type = 'last-prompt' and leaf_uuid is not null").join(known.select("session_id", F.col("uuid").alias("leaf_uuid")), ["session_id", "leaf_uuid"], "left_anti")
    out = broken(chain_check(records), "linear chain")
    for d, name in ((lost, "parents exist"), (twice, "uuids unique"), (leaves, "leaf exists"), (dangling_tool_use(blocks), "calls answered"), (orphan_tool_result(blocks), "results called")):
        out = out.unionByName(broken(d, name))
    return out


def verify_fidelity(records: DataFrame) -> DataFrame:
    """Genuine turns off the active path before one on it (holes) and after all on it (growth), per session."""
    r = tr.records_once(records).filter("is_genuine and uuid is not null")
    known = tr.active_path(records).select("session_id", "line_no", F.lit(True).alias("known"))
    d = r.join(known, ["session_id", "line_no"], "left")
    last = d.groupBy("session_id").agg(F.max(F.when(F.col("known"), F.col("line_no"))).alias("last_known"))
    d = d.join(last, "session_id").filter("known is null")
    hole = F.coalesce(F.col("line_no") < F.col("last_known"), F.lit(False))
    return d.groupBy("session_id").agg(F.count_if(hole).alias("n_holes"), F.count_if(~hole).alias("n_trailing"))


def session_scan(records: DataFrame) -> DataFrame:
    """Rollup of every session."""
    return tr.records_once(records).groupBy("session_id").agg(
        F.count("*").alias("n_records"), F.count("uuid").alias("n_uuids"), F.count_if("is_genuine").alias("n_turns"), F.floor(F.sum("n_bytes") / 4).cast(LONG).alias("tokens"),
        F.bool_or("is_synthetic").alias("has_synthetic"), F.bool_or("is_masked").alias("has_masked"), F.count_if("is_compact_summary").alias("n_summaries"),
    )


def content_hash_parts(records: DataFrame) -> DataFrame:
    """Per segment a stable hash of its records in order: of each record type and message, then of these in order.

    Of the view that units have (active path, no preambles). Hashes of records are combined as a sum of hashes of (place, hash), so that no task gathers a segment.
    """
    r = tr.unit_view(records, F.sha2(F.concat(F.coalesce("rec_type", F.lit("")), F.lit("\x1f"), F.coalesce("message", F.lit(""))), 256).alias("h"))
    return r.groupBy("session_id", "seg").agg(F.sum(F.conv(F.substring(F.md5(F.concat(F.col("line_no").cast("string"), F.lit(":"), F.col("h"))), 1, 12), 16, 10).cast("decimal(20,0)")).alias("s")).select(
        "session_id", "seg", F.col("s").cast("string").alias("content_hash")
    )


def uuid_lookup(records: DataFrame, prefix: str) -> DataFrame:
    """Rows whose uuid is prefix or begins with it, ground copies first: session_id, line_no, uuid, is_ground."""
    r = tr.records_once(records).filter("uuid is not null")
    match = (F.col("uuid") == prefix) | (F.col("uuid").startswith(prefix) if len(prefix) >= 8 else F.lit(False))
    return r.filter(match).select("session_id", "line_no", "uuid", (~F.col("is_synthetic") & ~F.col("is_masked")).alias("is_ground"))


def batches(units: DataFrame, size: str, max_units: int = 10, max_size: int = 120_000, width: int = 10_000) -> DataFrame:
    """Contiguous batches of a session's units (at most max_units and max_size, one larger unit alone): a resetting fold.

    session_id, seg, batch, numbered over the whole session. The fold's state (units and size of the open batch) is
    carried over blocks of width segments: the open batch takes some of a block's first units, and what follows depends
    on the place of the first new batch alone.
    """
    from ..functions.fragments import carried_fold

    def taken(sizes: list, n: int, total: int) -> tuple[int, int, int]:
        """How many of sizes the open batch takes, and what it then holds."""
        i = 0
        while i < len(sizes) and not (n and (n == max_units or total + sizes[i] > max_size)):
            n, total, i = n + 1, total + sizes[i], i + 1
        return i, n, total

    def move(g: dict) -> dict:
        sizes = g["size"]
        ends: list = [None] * len(sizes)  # of a batch that begins at i: units and size of the last batch, batches from there
        for i in range(len(sizes) - 1, -1, -1):
            k, n, total = taken(sizes[i : i + max_units + 1], 0, 0)
            ends[i] = [n, total, 1] if i + k == len(sizes) else [*ends[i + k][:2], ends[i + k][2] + 1]
        return {"sizes": sizes[: max_units + 1], "ends": ends[: max_units + 1]}

    def after(move: dict, state: list) -> list:
        n, total, b = state
        i, n, total = taken(move["sizes"], n, total)
        return [n, total, b] if i == len(move["sizes"]) else [*move["ends"][i][:2], b + move["ends"][i][2]]

    def fold(g: dict, state: list) -> dict:
        out, (n, total, b) = [], state
        for s in g["size"]:
            if n and (n == max_units or total + s > max_size):
                n, total, b = 0, 0, b + 1
            n, total = n + 1, total + s
            out.append(b)
        return {"session_id": g["session_id"], "seg": g["seg"], "batch": out}

    d = units.select("session_id", "seg", F.col(size).alias("size"))
    return carried_fold(d, "session_id string", "seg", width, [0, 0, 0], move, after, fold, "session_id string, seg long, batch long")


def split_parts(records: DataFrame, blocks: DataFrame, threshold: int = 2000, width: int = 65_536) -> DataFrame:
    """Parts of large segments: session_id, seg, line_no, part.

    A part closes after a row when no call is pending and either a delegation has just ended and the part holds a tenth
    of the threshold, or it holds half of it. A segment at or below the threshold is one part. Sizes of segments and pending
    calls come from aggregates and running sums; what the open part holds is carried over blocks of width lines.
    """
    from ..functions.fragments import carried_fold

    r = tr.segmented(records).filter("seg >= 0 and not is_genuine")
    b = tr.blocks_once(blocks).filter("block_type in ('tool_use', 'tool_result')")
    uses = b.filter("block_type = 'tool_use'").groupBy("session_id", "tool_id").agg(F.max_by("tool_name", F.struct("line_no", "pos")).alias("called"))
    b = b.join(uses.select("session_id", F.col("tool_id").alias("tool_use_id"), "called"), ["session_id", "tool_use_id"], "left")
    per = b.groupBy("session_id", "line_no").agg(
        F.collect_set(F.when(F.col("block_type") == "tool_use", F.col("tool_id"))).alias("opened"), F.collect_set(F.when(F.col("block_type") == "tool_result", F.col("tool_use_id"))).alias("closed"),
        F.bool_or(F.coalesce((F.col("block_type") == "tool_result") & F.col("called").isin("Task", "Agent", "Workflow", "Skill"), F.lit(False))).alias("ends_delegation"),
    )
    whole = r.groupBy("session_id", "seg").agg(F.floor(F.sum("n_bytes") / 4).alias("seg_tokens"))
    r = cut_lineage(r.join(per, ["session_id", "line_no"], "left").select("session_id", "seg", "line_no", "n_bytes", "opened", "closed", "ends_delegation"))
    # a call is open after a row that opens it and doesn't close it, until a row closes it
    none = F.array().cast("array<string>")
    opened, closed = F.coalesce("opened", none), F.coalesce("closed", none)
    calls = r.select("session_id", "seg", "line_no", F.explode(F.array_union(opened, closed)).alias("id"), closed.alias("closed"))
    calls = blocked.previous(calls.select("session_id", "seg", "line_no", "id", (~F.array_contains("closed", F.col("id"))).cast("int").alias("is_open")), ["session_id", "seg", "id"], "line_no", F.col("is_open"), "was_open")
    delta = calls.groupBy("session_id", "seg", "line_no").agg(F.sum(F.col("is_open") - F.coalesce("was_open", F.lit(0))).alias("delta"))
    r = r.join(delta, ["session_id", "seg", "line_no"], "left")
    r = blocked.running_sum(r, ["session_id", "seg"], "line_no", F.coalesce("delta", F.lit(0)), "pending").join(whole, ["session_id", "seg"])
    # what a part has to hold so that it closes after the row; null where it can't
    least = F.when(F.coalesce("ends_delegation", F.lit(False)), threshold // 10).otherwise(threshold // 2)
    may = (F.lit(threshold) > 0) & (F.col("seg_tokens") > threshold) & (F.col("pending") == 0)
    d = r.select("session_id", "seg", "line_no", F.floor(F.col("n_bytes") / 4).alias("tokens"), F.when(may, least).alias("least"))

    def closes(g: dict, i: int, held: int) -> tuple[int | None, int]:
        """The first row from i on after which a part that holds held closes (None: none), and what it holds at the end."""
        for k in range(i, len(g["tokens"])):
            held += g["tokens"][k]
            if g["least"][k] is not None and held >= g["least"][k]:
                return k, 0
        return None, held

    def move(g: dict) -> dict:
        n, after = len(g["tokens"]), {}  # after[i]: what the last part holds if one begins at row i, and the parts closed from there

        def ends(i: int) -> list:
            way = []
            while i not in after:
                k, held = closes(g, i, 0)
                if k is None:
                    after[i] = [held, 0]
                else:
                    way.append(i)
                    i = k + 1
            for x in reversed(way):
                after[x] = [after[i][0], after[i][1] + 1]
                i = x
            return after[i]

        steps, total, lowest = [], 0, None  # the less a part holds at first, the later it closes
        for k in range(n):
            total += g["tokens"][k]
            if g["least"][k] is not None and (lowest is None or g["least"][k] - total < lowest):
                lowest = g["least"][k] - total
                steps.append([lowest, *ends(k + 1)])
                if lowest <= 0:
                    break
        return {"steps": steps, "total": sum(g["tokens"])}

    def after_block(move: dict, state: list) -> list:
        held, part = state
        for need, left, closed in move["steps"]:
            if held >= need:
                return [left, part + 1 + closed]
        return [held + move["total"], part]

    def fold(g: dict, state: list) -> dict:
        parts, (held, part) = [], state
        for t, least in zip(g["tokens"], g["least"]):
            parts.append(part)
            held += t
            if least is not None and held >= least:
                part, held = part + 1, 0
        return {"session_id": g["session_id"], "seg": g["seg"], "line_no": g["line_no"], "part": parts}

    return carried_fold(d, "session_id string, seg long", "line_no", width, [0, 0], move, after_block, fold, "session_id string, seg long, line_no long, part long")


def active_goal(events: DataFrame) -> DataFrame:
    """Per user: whether the last goal event (error: unmet, signup: met) leaves a goal active."""
    met = F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "error", False)
    g = events.filter(met.isNotNull()).groupBy("user_id").agg(F.max_by(met, F.struct("ts", "event_id")).alias("met"))
    return events.select("user_id").distinct().join(g, "user_id", "left").select("user_id", F.coalesce(~F.col("met"), F.lit(False)).alias("is_active"))


def condition_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    return df.agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))
