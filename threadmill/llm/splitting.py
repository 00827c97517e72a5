"""Oversized items cut into pieces at natural boundaries, by balanced targets.

For an item of n characters, a limit and an overlap, the least number of pieces is computed, equal-length targets are
placed, and each target snaps to the strongest boundary near it (of equal strength to the nearest). If a piece exceeds
the limit, one more piece is tried; a target that must not move any more stays where it is, so this ends.

Texts are cut between characters (code points), never inside a combining sequence where that can be avoided. Segments
are cut between records: before what is said rather than before a record that answers a call. A segment of any size is
cut as a whole without being gathered: records get their place by blocked running sums, each target takes the best
boundary near it by an aggregate, and runs of records with a piece over the limit get more targets in a further round.

Defined results: items at or below the limit stay whole and are no found items; null texts and null messages count 0;
a record above the limit stands alone; duplicate rows are one item; line numbers that are repeated, unordered or not in
records count once or not at all; a segment with an empty activity has no pieces.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import message_text, norm_id
from ..plans import blocked
from ..session import cut_lineage

MESSAGE_LIMIT, MESSAGE_OVERLAP, SEGMENT_LIMIT = 3000, 200, 12_000

#: Boundaries, strongest first; a cut falls at the end of the match.
BOUNDARIES = [re.compile(p) for p in (r"\n[ \t]*\n+", r"\n", r"[.!?]+[\"'”’)\]]*\s+|[。！？]+[」』）]*", r"[,;:]\s+|[、，；：]", r"\s+")]


def pieces_needed(n: int, limit: int, overlap: int) -> int:
    """The least number of pieces of at most limit, neighbours sharing overlap, that cover n."""
    return 1 if n <= limit else -(-(n - overlap) // (limit - overlap))


def split_text(text: str, limit: int = MESSAGE_LIMIT, overlap: int = MESSAGE_OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of text."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    cuts_at: list[list[int]] | None = None
    k = pieces_needed(n, limit, overlap)
    while True:
        size = (n + (k - 1) * overlap) / k  # equal pieces, with their overlaps
        reach = max(0, min(int(limit - size) + limit // 20, int((size - overlap) / 2) - 1))
        if cuts_at is None:
            cuts_at = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
        ends, start, fits = [], 0, True
        for j in range(1, k):
            target = round(j * (size - overlap) + overlap)
            # a cut has to leave this piece within the limit, and the rest reachable by the pieces that remain
            low, high = max(start + overlap + 1, target - reach, n - (k - j) * (limit - overlap)), min(start + limit, target + reach)
            if low > high:
                fits = False
                break
            end = _snap(text, cuts_at, min(max(target, low), high), low, high)
            ends.append(end)
            start = end - overlap
        if fits and n - start <= limit:
            break
        k += 1
    starts = [0, *(e - overlap for e in ends)]
    return list(zip(starts, [*ends, n]))


def _snap(text: str, cuts_at: list[list[int]], target: int, low: int, high: int) -> int:
    for cuts in cuts_at:
        i = bisect_left(cuts, target)
        near = [c for c in cuts[max(0, i - 1) : i + 1] if low <= c <= high]
        if near:
            return min(near, key=lambda c: (abs(c - target), c))
    for c in range(target, max(low, target - 64) - 1, -1):
        if not unicodedata.combining(text[c]) and text[c] not in "‍️" and text[c - 1] != "‍":
            return c
    return target


def message_pieces(records: DataFrame, limit: int = MESSAGE_LIMIT, overlap: int = MESSAGE_OVERLAP) -> DataFrame:
    """Pieces of user and assistant messages over the limit: session_id, line_no, piece, start, n_chars, piece_text, text_chars."""
    big = (
        records.filter(F.col("rec_type").isin("user", "assistant") & (F.char_length("message") > limit))  # JSON is never shorter than its text
        .select(norm_id("session_id").alias("session_id"), "line_no", "ingested_at", message_text("message", "content_kind").alias("text"))
        .filter(F.char_length("text") > limit)
        .groupBy("session_id", "line_no").agg(F.max(F.struct("ingested_at", "text"))["text"].alias("text"))
    )
    schema = "session_id string, line_no long, piece int, start int, n_chars int, piece_text string, text_chars int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s, line, text in zip(*(c.to_pylist() for c in b.columns)):
                for k, (a, e) in enumerate(split_text(text, limit, overlap)):
                    rows.append((s, line, k, a, e - a, text[a:e], len(text)))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32())
                names = ("session_id", "line_no", "piece", "start", "n_chars", "piece_text", "text_chars")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return big.select("session_id", F.col("line_no").cast("long").alias("line_no"), "text").mapInArrow(run, schema)


def segment_records(segments: DataFrame, records: DataFrame) -> DataFrame:
    """session_id, seg, line_no, size, answers: the records of each segment's activity with the length of their message,
    and whether they answer a call."""
    lines = segments.select(norm_id("session_id").alias("session_id"), "seg", F.explode("activity").alias("line_no")).filter("line_no is not null").distinct()
    has_result = (F.col("content_kind") == "array") & F.coalesce(F.get_json_object("message", "$.content[*].type").contains('tool_result'), F.lit(False))
    sizes = records.select(
        norm_id("session_id").alias("session_id"), "line_no", "ingested_at", F.coalesce(F.char_length("message"), F.lit(0)).cast("long").alias("size"), F.coalesce(has_result, F.lit(False)).alias("answers")
    )
    once = sizes.groupBy("session_id", "line_no").agg(F.max(F.struct("ingested_at", "size", "answers")).alias("x")).select("session_id", "line_no", "x.size", "x.answers")
    return lines.join(once, ["session_id", "line_no"])


def segment_cuts(rows: DataFrame, limit: int = SEGMENT_LIMIT, width: int = blocked.WIDTH) -> DataFrame:
    """rows (session_id, seg, line_no, size, answers) with starts: whether a piece starts at the record.

    A record over the limit stands alone, and parts the records into runs. A run of total size T takes k - 1 targets at
    T / k, 2 T / k and so on, k being the least number of pieces; each target snaps to the boundary of most strength
    (no answer follows) within a quarter of a piece, else to the nearest. A run with a piece over the limit takes one
    target more in the next round, then two more, then four, until every piece fits (at the latest when targets are so
    dense that each record is a piece).
    """
    key = ["session_id", "seg"]
    d = blocked.running_sum(rows, key, "line_no", (F.col("size") > limit).cast("int"), "run", width)
    d = d.withColumn("alone", F.col("size") > limit)
    d = blocked.running_sum(d, key, "line_no", F.when(~F.col("alone"), F.col("size")).otherwise(0), "ends", width)
    d = cut_lineage(d)
    run = [*key, "run"]
    inner = d.filter("not alone").select(*run, "line_no", "size", "answers", "ends")
    runs = inner.groupBy(*run).agg(F.sum("size").alias("total"), F.min(F.col("ends") - F.col("size")).alias("base"))
    todo = runs.filter(F.col("total") > limit).withColumn("k", F.ceil(F.col("total") / limit))
    found, more = None, 1
    while True:
        # a cut lies before a record; the first of a run is none
        here = inner.join(todo, run).withColumn("at", F.col("ends") - F.col("size") - F.col("base")).withColumn("piece", F.col("total") / F.col("k"))
        target = F.least(F.greatest(F.round(F.col("at") / F.col("piece")), F.lit(1)), F.col("k") - 1).cast("long")
        off = F.abs(F.col("at") - target * F.col("piece"))
        rank = F.struct(F.when((off <= F.col("piece") / 4) & ~F.col("answers"), 0).when(off <= F.col("piece") / 4, 1).otherwise(2), off, "line_no")
        cuts = here.filter("at > 0").groupBy(*run, "k", "total", "base", target.alias("target")).agg(F.min_by("line_no", rank).alias("line_no"), F.min_by("at", rank).alias("at"))
        edges = cuts.select(*run, "k", "total", "base", "line_no", "at").unionByName(todo.select(*run, "k", "total", "base", F.lit(None).cast("long").alias("line_no"), F.col("total").alias("at")))
        edges = blocked.previous(edges.withColumn("place", F.floor(F.col("at") * F.col("k") / F.col("total"))), run, "at", F.col("at"), "before", width * limit)
        edges = cut_lineage(edges.withColumn("held", F.col("at") - F.coalesce("before", F.lit(0))))
        bad = edges.filter(F.col("held") > limit).select(*run).distinct()
        good = edges.filter("line_no is not null").join(bad, run, "left_anti").select(*key, "line_no")
        found = good if found is None else found.unionByName(good)
        if not bad.limit(1).count():
            break
        todo = cut_lineage(todo.join(bad, run, "left_semi").withColumn("k", F.col("k") + more))
        more *= 2
    first = d.groupBy(*run, "alone").agg(F.min("line_no").alias("line_no")).select(*key, "line_no")  # of a segment, after a lone record, and lone ones
    starts = found.unionByName(first).distinct().withColumn("starts", F.lit(True))
    return d.join(starts, [*key, "line_no"], "left").select(*key, "line_no", "size", "alone", F.coalesce("starts", F.lit(False)).alias("starts"))


def segment_pieces(segments: DataFrame, records: DataFrame, limit: int = SEGMENT_LIMIT, width: int = blocked.WIDTH) -> DataFrame:
    """Pieces of segments over the limit: session_id, seg, piece, first_line, last_line, n_records, n_chars, segment_chars.

    A piece starts with the last record of the piece before if both fit.
    """
    key = ["session_id", "seg"]
    rows = segment_records(segments, records)
    big = rows.groupBy(*key).agg(F.sum("size").alias("segment_chars")).filter(F.col("segment_chars") > limit)
    d = segment_cuts(rows.join(big, key), limit, width)
    d = blocked.running_sum(d, key, "line_no", F.col("starts").cast("int"), "piece", width)
    p = d.groupBy(*key, (F.col("piece") - 1).alias("piece")).agg(
        F.min("line_no").alias("first"), F.max("line_no").alias("last_line"), F.count("*").alias("n"), F.sum("size").alias("own"), F.max_by("size", "line_no").alias("last_size"),
    )
    p = blocked.previous(p, key, "piece", F.struct("last_line", "last_size"), "p", width)
    shares = F.coalesce((F.col("p.last_size") <= limit) & (F.col("p.last_size") + F.col("own") <= limit), F.lit(False))
    return p.join(big, key).select(
        *key, "piece", F.when(shares, F.col("p.last_line")).otherwise(F.col("first")).alias("first_line"), "last_line", (F.col("n") + shares.cast("int")).alias("n_records"),
        (F.col("own") + F.when(shares, F.col("p.last_size")).otherwise(0)).alias("n_chars"), "segment_chars",
    )


def oversized(segments: DataFrame, records: DataFrame) -> DataFrame:
    """The items that were cut: item_kind, session_id, item_no."""
    m = message_pieces(records).filter("piece = 0").select(F.lit("message").alias("item_kind"), "session_id", F.col("line_no").alias("item_no"))
    s = segment_pieces(segments, records).filter("piece = 0").select(F.lit("segment").alias("item_kind"), "session_id", F.col("seg").alias("item_no"))
    return m.unionByName(s)
