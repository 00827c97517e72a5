"""References to records that do not exist, kept as signed counts per key.

A line is a record with its tool blocks. Its contributions to keys (domain, session_id, ref_id) are reference counts
(its parent, its covered uuids, the calls its results answer) and existence counts (its own uuid, its calls), each at
the line's first arrival. Arrivals add contributions, removals take the same ones back: every change is a delta with a
sign, and a state is the sum of deltas per key and arrival (`count_state`). Sums can be taken back, so the first arrival
of what still exists, and of what still refers, can be read from the state at any time (`key_state`). A key with
references but without existence is an orphan; one that exists only after its first reference is late.

In batch the deltas of all lines are summed. `streaming.growing.OrphanCounts` keeps lines, removals and counts and
turns each change (a new record, a later delivery, blocks, a removal) into deltas of the lines it touches, old
contributions out and new ones in, so any order of arrivals gives the counts that the batch gives.

Defined results: null or blank ids are no references and no targets; a row delivered twice is one record that arrived
at its first ingested_at (a record without one counts as in time) and has the contents of its latest delivery; a removal
counts for every line of that uuid, whenever it arrives; equal blocks count once; blocks without a record don't count;
empty tables give empty results; extra columns are ignored. A hot key is pre-aggregated on the map side, and the join
of references with the (few) orphan keys is left to AQE, which splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import norm_id

KEY = ["domain", "session_id", "ref_id"]
LINE = ["session_id", "line_no"]


def removals(removed: DataFrame) -> DataFrame:
    """session_id, uuid of what was taken out."""
    return removed.select(norm_id("session_id").alias("session_id"), norm_id("uuid").alias("uuid")).filter("session_id is not null and uuid is not null").distinct()


def standing(records: DataFrame, removed: DataFrame) -> DataFrame:
    """Records without those taken out."""
    gone = removals(removed).select(F.col("session_id").alias("g_session"), F.col("uuid").alias("g_uuid"))
    return records.join(gone, (norm_id("session_id") == F.col("g_session")) & (norm_id("uuid") == F.col("g_uuid")), "left_anti")


def record_lines(records: DataFrame) -> DataFrame:
    """One row per line: first arrival (at), latest delivery (x: its time and what it says)."""
    x = F.struct(
        F.col("ingested_at").cast("timestamp").alias("delivered_at"), norm_id("uuid").alias("uuid"), norm_id("parent_uuid").alias("parent"),
        norm_id("provenance.source_session_id").alias("covered_session"), F.col("provenance.covered_uuids").alias("covered"),
    )
    d = records.select(norm_id("session_id").alias("session_id"), F.col("line_no").cast("long").alias("line_no"), x.alias("x"))
    return merge_lines(d.select(*LINE, F.col("x.delivered_at").alias("at"), "x"))


def merge_lines(d: DataFrame) -> DataFrame:
    return d.groupBy(*LINE).agg(F.min("at").alias("at"), F.max("x").alias("x"))


def tool_lines(blocks: DataFrame) -> DataFrame:
    """One row per line with tool blocks: the calls it makes and those it answers."""
    d = blocks.select(
        norm_id("session_id").alias("session_id"), F.col("line_no").cast("long").alias("line_no"), norm_id("tool_use_id").alias("use"), norm_id("tool_id").alias("call")
    ).filter("use is not null or call is not null")
    return d.groupBy(*LINE).agg(F.collect_set("use").alias("uses"), F.collect_set("call").alias("calls"))


def merge_tools(d: DataFrame) -> DataFrame:
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return d.groupBy(*LINE).agg(union("uses"), union("calls"))


def full_lines(records: DataFrame, tools: DataFrame, gone: DataFrame) -> DataFrame:
    """Lines with their tool blocks, and whether they were taken out (is_gone)."""
    d = records.select(*LINE, "at", "x.uuid", "x.parent", "x.covered_session", "x.covered").join(tools, LINE, "left")
    return d.join(gone.withColumn("is_gone", F.lit(True)), ["session_id", "uuid"], "left").withColumn("is_gone", F.coalesce("is_gone", F.lit(False)))


def contributions(lines: DataFrame) -> DataFrame:
    """What each line adds to keys: ref_kind ('self' for existence), domain, target_session, ref_id, refs, exists, at."""
    def row(kind: str, domain: str, session: Column, ref: Column, is_ref: int) -> Column:
        return F.struct(
            F.lit(kind).alias("ref_kind"), F.lit(domain).alias("domain"), session.alias("target_session"), ref.alias("ref_id"), F.lit(is_ref).cast("long").alias("refs"), F.lit(1 - is_ref).cast("long").alias("exists")
        )

    each = lambda c, f: F.transform(F.coalesce(c, F.array().cast("array<string>")), f)
    own = F.col("session_id")
    covered_in = F.coalesce("covered_session", F.lit(""))
    rows = F.concat(
        F.array(row("parent", "uuid", own, F.col("parent"), 1), row("self", "uuid", own, F.col("uuid"), 0)),
        each("uses", lambda u: row("tool", "tool", own, u, 1)), each("calls", lambda u: row("self", "tool", own, u, 0)),
        F.transform(F.array_distinct(each("covered", lambda u: norm_id(u))), lambda u: row("covered", "uuid", covered_in, u, 1)),
    )
    return lines.select(*LINE, "at", "is_gone", F.explode(rows).alias("d")).filter("d.ref_id is not null").select("session_id", "line_no", "at", "is_gone", "d.*")


def deltas(contributed: DataFrame) -> DataFrame:
    """Signed deltas: each contribution as it arrived, and the opposite one of what was taken out."""
    signs = F.when(F.col("is_gone"), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    return contributed.select("domain", "target_session", "ref_id", "at", "refs", "exists", F.explode(signs).alias("sign")).select(
        "domain", F.col("target_session").alias("session_id"), "ref_id", "at", (F.col("refs") * F.col("sign")).alias("refs"), (F.col("exists") * F.col("sign")).alias("exists")
    )


def count_state(d: DataFrame) -> DataFrame:
    """The sums of deltas (or of states) per key and arrival; what cancels out is gone."""
    return d.groupBy(*KEY, "at").agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists")).filter("refs <> 0 or exists <> 0")


def fold(state: DataFrame, change: DataFrame) -> DataFrame:
    """A state with further deltas (or a state of them) folded in."""
    return count_state(state.unionByName(change))


def key_state(state: DataFrame) -> DataFrame:
    """Per key: counts, and the first arrival of what exists and of what refers to it."""
    return state.groupBy(*KEY).agg(
        F.sum("refs").alias("refs"), F.sum("exists").alias("exists"),
        F.min(F.when(F.col("exists") > 0, F.col("at"))).alias("first_exists"), F.min(F.when(F.col("refs") > 0, F.col("at"))).alias("first_ref"),
    )


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist, or did not yet exist when first referred to."""
    return key_state(state).filter("refs > 0 and (exists <= 0 or first_exists > first_ref)")


def orphan_references(contributed: DataFrame, state: DataFrame) -> DataFrame:
    """The standing references whose key is an orphan, or came later than the reference."""
    keys = orphan_keys(state).select("domain", F.col("session_id").alias("target_session"), "ref_id", (F.col("exists") > 0).alias("is_there"), "first_exists")
    return (
        contributed.filter("not is_gone and refs > 0").join(keys, ["domain", "target_session", "ref_id"])
        .filter("not is_there or first_exists > at").select("ref_kind", "session_id", "line_no", "ref_id", "at").distinct()
    )


def find_orphans(records: DataFrame, blocks: DataFrame, removed: DataFrame) -> DataFrame:
    """Orphan references of records and tool blocks: ref_kind, session_id, line_no (of the referrer), ref_id, at."""
    c = contributions(full_lines(record_lines(records), tool_lines(blocks), removals(removed)))
    return orphan_references(c, count_state(deltas(c)))


def report(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Orphan references counted per table and period of arrival."""
    table = F.when(F.col("ref_kind") == "tool", "blocks").otherwise("records")
    return orphans.groupBy(table.alias("table_name"), "ref_kind", F.date_format(F.date_trunc(period, "at"), "yyyy-MM-dd").alias("period")).agg(
        F.count("*").alias("n_orphans")
    )
