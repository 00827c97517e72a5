"""What synthetic records stand for: sources, generations, ground truth, selectors, digests, and lineage of sessions.

A synthetic record names its source session and the uuids it covers there. Expansion follows covered records that are
synthetic themselves for DEPTH generations; a masked copy gives way to the nearest ground copy of its uuid; a synthetic
record whose source is gone, or that lies deeper than DEPTH, stands for itself.

Defined results: ids compare trimmed and in lower case; deliveries of one record count once, the latest; a covered uuid
that the source doesn't hold has no row; of several records of one uuid in a session the first in the file counts;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import norm_id
from ..functions.columns_text import truncate, truncate_head_tail
from ..plans import transcript as tr
from ..session import cut_lineage

#: Generations that an expansion and an epoch follow, hops of lineage, characters of a digest (fixed values).
DEPTH, EPOCH_DEPTH, HOPS, DIGEST = 10, 8, 1000, 8000
EPOCH_HEAD = "EARLIER, ALREADY-SUMMARIZED WORK — below is the RAW activity it covered. Write ONE consolidated recap of the whole span."


def copies(records: DataFrame) -> DataFrame:
    """session_id, line_no, uuid, is_synthetic, is_ground of every record with a uuid, and where it points (source, part, covered)."""
    r = tr.records_once(
        records, norm_id("provenance.source_session_id").alias("source"), F.trim("provenance.part").alias("part"),
        F.array_distinct(F.transform(F.coalesce("provenance.covered_uuids", F.array().cast("array<string>")), lambda u: norm_id(u))).alias("covered"),
    )
    return r.filter("uuid is not null").select("session_id", "line_no", "uuid", "is_synthetic", (~F.col("is_synthetic") & ~F.col("is_masked")).alias("is_ground"), "is_ledger", "source", "part", "covered")


def synth_sources(c: DataFrame) -> DataFrame:
    """The sources of each session's synthetic records in order of first appearance: session_id, source, first_line."""
    return c.filter("source is not null").groupBy("session_id", "source").agg(F.min("line_no").alias("first_line"))


def provenance_files(c: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The sessions that each session goes back to, nearest first: session_id, source, distance. Sources that are gone don't count."""
    there = c.select(F.col("session_id").alias("source")).distinct()
    hop = cut_lineage(synth_sources(c).filter("session_id <> source").join(there, "source", "left_semi").select(F.col("session_id").alias("a"), F.col("source").alias("b")))
    out = hop.select(F.col("a").alias("session_id"), F.col("b").alias("source"), F.lit(1).alias("distance"))
    cur = out
    for d in range(2, depth + 1):
        cur = cut_lineage(
            cur.join(hop.select(F.col("a").alias("source"), "b"), "source").select("session_id", F.col("b").alias("source"), F.lit(d).alias("distance")).filter("session_id <> source").distinct()
            .join(out.select("session_id", "source"), ["session_id", "source"], "left_anti")
        )
        if not cur.limit(1).count():
            break
        out = out.unionByName(cur)
    return out


def ground_truth(c: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The best copy of every record that is a degraded one: session_id, uuid, from_session, from_line, is_ground.

    The first ground copy in the session itself or in the sessions it goes back to, nearest first, else the first copy.
    """
    files = provenance_files(c) if files is None else files
    degraded = c.filter("not is_ground").select("session_id", "uuid").distinct()
    reach = files.select("session_id", F.col("source").alias("from_session"), "distance")
    own = degraded.select("session_id", F.col("session_id").alias("from_session"), F.lit(0).alias("distance"), "uuid")
    far = degraded.join(reach, "session_id").select("session_id", "from_session", "distance", "uuid")
    at = c.select(F.col("session_id").alias("from_session"), "uuid", F.col("line_no").alias("from_line"), "is_ground")
    met = own.unionByName(far).join(at, ["from_session", "uuid"])
    best = F.struct((~F.col("is_ground")).cast("int"), "distance", "from_session", "from_line")
    return met.groupBy("session_id", "uuid").agg(F.min_by(F.struct("from_session", "from_line", "is_ground"), best).alias("x")).select("session_id", "uuid", "x.*")


def expand(c: DataFrame, depth: int = DEPTH) -> DataFrame:
    """What every synthetic record stands for: session_id, line_no, from_session, from_line, uuid, level, is_ground.

    level counts the generations; a row with level 0 is the record itself, whose source is gone.
    """
    c = cut_lineage(c)
    there = c.select(F.col("session_id").alias("source")).distinct().withColumn("there", F.lit(True))
    synth = cut_lineage(c.filter("is_synthetic and source is not null").select("session_id", "line_no", "uuid", "source", "covered").join(there, "source", "left"))
    bare = c.filter("is_synthetic and source is null").select("session_id", "line_no", "uuid")
    edges = cut_lineage(synth.filter("there").select("session_id", "line_no", "source", F.explode("covered").alias("uuid")).filter("uuid is not null"))
    first = c.groupBy("session_id", "uuid").agg(F.min_by(F.struct("line_no", "is_synthetic", "is_ground"), "line_no").alias("x")).select(F.col("session_id").alias("source"), "uuid", "x.line_no", "x.is_synthetic", "x.is_ground")
    first = cut_lineage(first.withColumnsRenamed({"line_no": "from_line"}))
    alone = synth.filter("there is null").select("session_id", "line_no", "uuid").unionByName(bare)
    out = alone.select("session_id", "line_no", F.col("session_id").alias("from_session"), F.col("line_no").alias("from_line"), "uuid", F.lit(0).alias("level"), F.lit(False).alias("is_ground"))
    dead = alone.select(F.col("session_id").alias("source"), F.col("line_no").alias("from_line"), F.lit(True).alias("is_dead"))
    front = edges.withColumn("level", F.lit(1))
    for level in range(1, depth + 1):
        met = cut_lineage(front.join(first, ["source", "uuid"]).join(dead, ["source", "from_line"], "left"))
        ends = ~F.col("is_synthetic") | F.coalesce("is_dead", F.lit(False)) | F.lit(level == depth)
        out = out.unionByName(met.filter(ends).select("session_id", "line_no", F.col("source").alias("from_session"), "from_line", "uuid", "level", "is_ground"))
        onward = met.filter(~ends).select("session_id", "line_no", F.col("source").alias("in_session"), F.col("from_line").alias("in_line"))
        front = onward.join(edges.select(F.col("session_id").alias("in_session"), F.col("line_no").alias("in_line"), "source", "uuid"), ["in_session", "in_line"]).select(
            "session_id", "line_no", "source", "uuid", F.lit(level + 1).alias("level")
        ).distinct()
        if not met.filter(~ends).limit(1).count():
            break
    # copies that were reduced give way to ground ones
    best = ground_truth(c).select(F.col("session_id").alias("from_session"), "uuid", F.col("from_session").alias("b_session"), F.col("from_line").alias("b_line"), F.col("is_ground").alias("b_ground"))
    swap = out.join(best, ["from_session", "uuid"], "left").withColumn("swaps", F.coalesce(~F.col("is_ground") & F.col("b_ground") & (F.col("level") > 0), F.lit(False)))
    return swap.select(
        "session_id", "line_no", F.when(F.col("swaps"), F.col("b_session")).otherwise(F.col("from_session")).alias("from_session"),
        F.when(F.col("swaps"), F.col("b_line")).otherwise(F.col("from_line")).alias("from_line"), "uuid", "level", (F.col("is_ground") | F.col("swaps")).alias("is_ground"),
    ).groupBy("session_id", "line_no", "from_session", "from_line", "uuid").agg(F.min("level").alias("level"), F.bool_or("is_ground").alias("is_ground"))


def nth_synthetic(c: DataFrame) -> DataFrame:
    """Synthetic records with their ordinal in the session, from 0: session_id, line_no, uuid, part, nth."""
    from ..plans import blocked

    s = blocked.running_sum(c.filter("is_synthetic"), ["session_id"], "line_no", F.lit(1), "nth")
    return s.select("session_id", "line_no", "uuid", "part", (F.col("nth") - 1).alias("nth"))


def rehydrate_select(c: DataFrame, selectors: DataFrame) -> DataFrame:
    """What selectors (session_id, selector) choose: session_id, selector, how, from_session, from_line, uuid.

    In this order: the first synthetic record of that part key; its ordinal, for numbers of fewer than eight digits (one
    out of range is an error); a uuid, or eight and more of its first digits, in the session or those it goes back to. how
    is 'part', 'ordinal', 'uuid', or an error: 'no ordinal', 'lost' (the source is gone), 'unknown'.
    """
    s = cut_lineage(selectors.select(norm_id("session_id").alias("session_id"), F.trim("selector").alias("selector")).distinct())
    synth, whole = cut_lineage(nth_synthetic(c)), cut_lineage(expand(c))
    by_part = s.join(synth.select("session_id", F.col("part").alias("selector"), "line_no"), ["session_id", "selector"]).groupBy("session_id", "selector").agg(F.min("line_no").alias("at")).withColumn("how", F.lit("part"))
    is_number = F.col("selector").rlike("^[0-9]{1,7}$")
    numbers = s.filter(is_number).join(by_part, ["session_id", "selector"], "left_anti").withColumn("nth", F.col("selector").cast("long"))
    by_nth = numbers.join(synth.select("session_id", "nth", F.col("line_no").alias("at")), ["session_id", "nth"], "left").select("session_id", "selector", "at", F.when(F.col("at").isNull(), "no ordinal").otherwise("ordinal").alias("how"))
    chosen = by_part.select("session_id", "selector", "at", "how").unionByName(by_nth)
    got = chosen.filter("at is not null").join(whole.select("session_id", F.col("line_no").alias("at"), "from_session", "from_line", "uuid", "is_ground", "level"), ["session_id", "at"], "left")
    alone = got.groupBy("session_id", "selector").agg((F.coalesce(F.count_if("is_ground"), F.lit(0)) == 0).alias("is_lost"))
    got = got.join(alone, ["session_id", "selector"]).select("session_id", "selector", F.when(F.col("is_lost"), "lost").otherwise(F.col("how")).alias("how"), "from_session", "from_line", "uuid")
    none = chosen.filter("at is null").select("session_id", "selector", "how", *(F.lit(None).cast(t).alias(n) for n, t in (("from_session", "string"), ("from_line", "long"), ("uuid", "string"))))
    ids = s.join(chosen.select("session_id", "selector"), ["session_id", "selector"], "left_anti").withColumn("low", F.lower("selector"))
    files = provenance_files(c).select("session_id", F.col("source").alias("from_session"), "distance")
    reach = files.unionByName(c.select("session_id", F.col("session_id").alias("from_session"), F.lit(0).alias("distance")).distinct())
    eight = c.select(F.col("session_id").alias("from_session"), F.col("line_no").alias("from_line"), "uuid", "is_ground", F.substring("uuid", 1, 8).alias("head"))
    met = ids.filter(F.col("low").rlike("^[0-9a-f-]{8,}$")).join(reach, "session_id").withColumn("head", F.substring("low", 1, 8)).join(eight, ["from_session", "head"]).filter("startswith(uuid, low)")
    best = F.struct((~F.col("is_ground")).cast("int"), "distance", "from_session", "from_line")
    found = met.groupBy("session_id", "selector").agg(F.min_by(F.struct("from_session", "from_line", "uuid"), best).alias("x")).select("session_id", "selector", F.lit("uuid").alias("how"), "x.*")
    unknown = ids.join(found, ["session_id", "selector"], "left_anti").select("session_id", "selector", F.lit("unknown").alias("how"), *(F.lit(None).cast(t).alias(n) for n, t in (("from_session", "string"), ("from_line", "long"), ("uuid", "string"))))
    return got.unionByName(none).unionByName(found).unionByName(unknown)


def epoch_lines(records: DataFrame, blocks: DataFrame, depth: int = EPOCH_DEPTH) -> DataFrame:
    """The lines of the raw records behind each synthetic one: session_id, line_no, way (order), line.

    Only of synthetic records all of whose hops lead to raw records: one unresolvable hop fails the whole.
    """
    from .sessions import render_activity

    c = cut_lineage(copies(records))
    first = cut_lineage(c.select(F.col("session_id").alias("source"), "uuid", F.col("line_no").alias("at"), "is_synthetic", "is_ledger"))
    synth = cut_lineage(c.filter("is_synthetic").select("session_id", "line_no", "source", "covered"))
    edges = cut_lineage(synth.select("session_id", "line_no", "source", F.explode("covered").alias("uuid")).filter("source is not null and uuid is not null").join(first, ["source", "uuid"]))
    empty = synth.join(edges.select("session_id", "line_no").distinct(), ["session_id", "line_no"], "left_anti").select("session_id", "line_no")
    front = edges.select("session_id", "line_no", F.array("at").alias("way"), "source", "at", "is_synthetic", "is_ledger")
    raw, failed = None, empty
    for level in range(1, depth + 1):
        front = cut_lineage(front)
        here = front.filter("not is_synthetic and not is_ledger").select("session_id", "line_no", "way", "source", "at")
        raw = here if raw is None else raw.unionByName(here)
        more = front.filter("is_synthetic")
        lost = more.join(empty.select(F.col("session_id").alias("source"), F.col("line_no").alias("at")), ["source", "at"], "left_semi")
        failed = failed.unionByName(lost.select("session_id", "line_no"))
        if level == depth:
            failed = failed.unionByName(more.select("session_id", "line_no"))
            break
        if not more.limit(1).count():
            break
        front = more.select("session_id", "line_no", "way", F.col("source").alias("s"), F.col("at").alias("a")).join(
            edges.select(F.col("session_id").alias("s"), F.col("line_no").alias("a"), "source", "at", "is_synthetic", "is_ledger"), ["s", "a"]
        ).select("session_id", "line_no", F.concat("way", F.array("at")).alias("way"), "source", "at", "is_synthetic", "is_ledger")
    cut = lambda c, n: truncate(c, n)
    items = render_activity(blocks, records).filter(F.col("kind").isin("assistant_text", "tool_use", "tool_result", "delivered_message")).select(
        F.col("session_id").alias("source"), F.col("line_no").alias("at"), "pos",
        F.when(F.col("kind") == "assistant_text", F.concat(F.lit("ASSISTANT: "), cut("shown", 400))).when(F.col("kind") == "tool_use", F.concat(F.lit("TOOL "), "tool", F.lit(" "), cut("shown", 100)))
        .when(F.col("kind") == "tool_result", F.concat(F.lit("RESULT["), "status", F.lit(","), F.col("chars").cast("string"), F.lit("]: "), cut("shown", 120))).otherwise(F.concat(F.lit("AGENT-REPORT: "), cut("shown", 300))).alias("line"),
    )
    good = raw.join(failed.distinct(), ["session_id", "line_no"], "left_anti")
    return good.join(items, ["source", "at"]).select("session_id", "line_no", F.concat("way", F.array(F.col("pos"))).alias("way"), "line")


def session_lineage(records: DataFrame) -> DataFrame:
    """child, parent, at, mtime, p_mtime of every session: the parent is the first source it names, at its first line, and
    mtime its latest arrival."""
    c = copies(records)
    m = records.groupBy(norm_id("session_id").alias("child")).agg(F.max("ingested_at").alias("mtime"), F.min("ingested_at").alias("at")).filter("child is not null")
    p = synth_sources(c).groupBy("session_id").agg(F.min_by("source", F.struct("first_line", "source")).alias("parent")).withColumnRenamed("session_id", "child")
    d = m.join(p, "child", "left")
    return d.join(m.select(F.col("child").alias("parent"), F.col("mtime").alias("p_mtime")), "parent", "left").select("child", "parent", "at", "mtime", "p_mtime")


def lineage_latest(l: DataFrame, hops: int = HOPS) -> DataFrame:
    """Where at most so many hops to the newest fresh child lead from each session: start, latest.

    A child is fresh if it isn't older than its parent, or the parent's time is not known; of equally new ones the last
    by id counts. Steps are composed by squares (log2 of the hops in joins), so a loop ends after exactly so many.
    """
    nxt = l.filter("parent is not null and (p_mtime is null or mtime >= p_mtime)").groupBy("parent").agg(F.max(F.struct("at", "child")).alias("x")).select(F.col("parent").alias("a"), F.col("x.child").alias("b"))
    nodes = l.select(F.col("child").alias("a")).union(l.filter("parent is not null").select("parent")).distinct()
    power = cut_lineage(nodes.join(nxt, "a", "left").select("a", F.coalesce("b", "a").alias("b")))
    cur, left = l.select(F.col("child").alias("start"), F.col("child").alias("latest")), hops
    while left:
        if left & 1:
            cur = cut_lineage(cur.join(power.select(F.col("a").alias("latest"), "b"), "latest").select("start", F.col("b").alias("latest")))
        left >>= 1
        if left:
            squared = cut_lineage(power.join(power.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", "b", "c"))
            if not squared.filter("b <> c").limit(1).count():  # every chain has ended
                return cut_lineage(cur.join(power.select(F.col("a").alias("latest"), "b"), "latest").select("start", F.col("b").alias("latest")))
            power = squared.select("a", F.col("c").alias("b"))
    return cur
