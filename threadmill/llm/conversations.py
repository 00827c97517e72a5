"""Conversations from message rows: the thread of each session in order, validated by a finite-state automaton.

The thread runs from the session's leaf along parents; the nodes on it and their distance from the root come from the
hierarchy operator, which works on bounded fragments. The thread is then partitioned by session and a block of
sequence numbers, sorted within by sequence, and each block is reduced to what it does to each state of the automaton.
Blocks compose, so the end state of a session is the composition of its blocks in order: a session that holds a third
of all rows is validated by many tasks.

Defined results: rows of a uuid on several lines count as the highest line; duplicate deliveries are one record;
sessions without leaf, whose thread doesn't end at a root, without turns, or with a turn that no reply follows, are
dropped, and `check_sessions` says why; null flags are false; a blank text is as good as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import flag, message_text, norm_id
from ..functions.fragments import map_fragments
from ..operators import hierarchy
from ..session import cut_lineage

#: Sequence numbers in a block of a thread.
BLOCK = 4096
#: States and symbols of the automaton. TURN in WAITING, or the end in START or WAITING, is an error; BROKEN stays.
START, WAITING, ANSWERED, BROKEN = range(4)
TURN, REPLY, OTHER = "T", "R", "-"
NEXT = {
    TURN: (WAITING, BROKEN, WAITING, BROKEN),
    REPLY: (START, ANSWERED, ANSWERED, BROKEN),
    OTHER: (START, WAITING, ANSWERED, BROKEN),
}


def symbol() -> Column:
    """What a record is to the automaton."""
    said = F.coalesce(message_text("message", "content_kind"), F.lit("")).rlike(r"(?U)\S")
    turn = (F.col("rec_type") == "user") & ~flag("is_meta") & ~flag("is_compact_summary") & ~flag("has_source_tool")
    return F.when(turn & said, TURN).when((F.col("rec_type") == "assistant") & said, REPLY).otherwise(OTHER)


def nodes(records: DataFrame) -> DataFrame:
    """tree, id, up, pos, symbol: one row per uuid of a session, of its highest line."""
    d = records.select(
        norm_id("session_id").alias("tree"), norm_id("uuid").alias("id"),
        F.struct(F.col("line_no").cast("long").alias("pos"), "ingested_at", norm_id("parent_uuid").alias("up"), symbol().alias("symbol")).alias("x"),
    ).filter("id is not null")
    return d.groupBy("tree", "id").agg(F.max("x").alias("x")).select("tree", "id", "x.up", "x.pos", "x.symbol")


def leaves(records: DataFrame, n: DataFrame) -> DataFrame:
    """tree, leaf: what the last last-prompt row names, if it is a record, else the last record with a uuid."""
    last = records.filter("rec_type = 'last-prompt'").groupBy(norm_id("session_id").alias("tree")).agg(
        F.max(F.struct("line_no", "ingested_at", norm_id("leaf_uuid").alias("id"))).alias("x")
    ).select("tree", F.col("x.id").alias("id")).filter("id is not null")
    named = n.select("tree", "id").join(last, ["tree", "id"]).select("tree", F.col("id").alias("named"))
    latest = n.groupBy("tree").agg(F.max_by("id", "pos").alias("latest"))
    return latest.join(named, "tree", "left").select("tree", F.coalesce("named", "latest").alias("id"))


def threads(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of each thread (tree, id, seq, symbol), and each session's leaf with the state of its tree."""
    n = cut_lineage(nodes(records))
    leaf = leaves(records, n)
    marked = n.join(leaf.withColumn("is_leaf", F.lit(1)), ["tree", "id"], "left").select("tree", "id", "up", "pos", F.coalesce("is_leaf", F.lit(0)).alias("is_leaf"))
    h = cut_lineage(hierarchy.resolve(marked, weight=F.col("is_leaf")).select("tree", "id", "depth", "status", "total"))
    ends = leaf.join(h.select("tree", "id", "status", "depth"), ["tree", "id"])
    on_path = h.filter("total > 0").select("tree", "id", F.col("depth").alias("seq"))
    return on_path.join(n.select("tree", "id", "symbol", "pos"), ["tree", "id"]), ends


def reduce_block(group: dict) -> dict:
    """What a block of a thread, in order, makes of each state."""
    states = [START, WAITING, ANSWERED, BROKEN]
    turns = 0
    for s in group["symbol"]:
        step = NEXT[s]
        states = [step[x] for x in states]
        turns += s == TURN
    return {"tree": [group["tree"][0]], "blk": [group["blk"][0]], "after": [states], "turns": [turns], "n": [len(group["symbol"])]}


def check_sessions(records: DataFrame, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """session_id, reason (null: kept), n_records and n_turns of the thread, for every session with a record."""
    thread, ends = found or threads(records)
    blocks = map_fragments(
        thread.select("tree", "seq", "symbol").withColumn("blk", F.floor(F.col("seq") / BLOCK).cast("long")), ["tree", "blk"], ["seq"],
        reduce_block, "tree string, blk long, after array<int>, turns long, n long",
    )
    composed = blocks.groupBy("tree").agg(
        F.sort_array(F.collect_list(F.struct("blk", "after"))).alias("blocks"), F.sum("turns").alias("n_turns"), F.sum("n").alias("n_records")
    ).select("tree", "n_turns", "n_records", F.aggregate("blocks", F.lit(START), lambda s, b: F.element_at(b["after"], s + 1)).alias("state"))
    all_ = records.select(norm_id("session_id").alias("tree")).distinct().filter("tree is not null")
    reason = (
        F.when(F.col("status").isNull(), "no leaf").when(F.col("status") != "root", F.concat(F.lit("broken: "), F.col("status")))
        .when(F.coalesce("n_turns", F.lit(0)) == 0, "no turn").when(F.col("state") != ANSWERED, "turn without reply")
    )
    return all_.join(ends, "tree", "left").join(composed, "tree", "left").select(
        F.col("tree").alias("session_id"), reason.alias("reason"), F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_turns", F.lit(0)).alias("n_turns")
    )


def rebuild(records: DataFrame) -> DataFrame:
    """Messages of the kept conversations in order: session_id, seq, role, text (turns and replies only)."""
    found = threads(records)
    thread, kept = found[0], check_sessions(records, found).filter("reason is null").select(F.col("session_id").alias("tree"))
    said = thread.filter(F.col("symbol").isin(TURN, REPLY)).join(kept, "tree", "left_semi")
    texts = records.select(
        norm_id("session_id").alias("tree"), norm_id("uuid").alias("id"), F.col("line_no").cast("long").alias("pos"), "ingested_at", message_text("message", "content_kind").alias("text")
    ).groupBy("tree", "id", "pos").agg(F.max(F.struct("ingested_at", "text"))["text"].alias("text"))  # the latest delivery
    return said.join(texts, ["tree", "id", "pos"]).groupBy(F.col("tree").alias("session_id"), "seq").agg(
        F.first(F.when(F.col("symbol") == TURN, "user").otherwise("assistant")).alias("role"), F.first("text").alias("text")
    )
