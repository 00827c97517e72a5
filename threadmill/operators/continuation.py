"""Continuing a compacted session: threshold, plan, summarize, assemble, verify, with retry and a guard against churn."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import norm_id
from ..session import cut_lineage
from . import compact

#: Attempts, and the share of its size (per cent) an output has to stay below.
ATTEMPTS, CHURN = 3, 95


@dataclass
class Outcome:
    status: str  # 'below threshold', 'compacted', 'no gain', 'failed'
    before: int
    after: int
    output: DataFrame | None = None
    problems: tuple = ()


def extract_json_object(text: str) -> dict | None:
    """The object between the first { and the last } of a summarizer's answer."""
    a, b = text.find("{"), text.rfind("}")
    if a < 0 or b < a:
        return None
    try:
        held = json.loads(text[a : b + 1])
    except ValueError:
        return None
    return held if isinstance(held, dict) else None


def lookup_summary(summaries: dict, key: str) -> str | None:
    """A unit's summary by its key, or by the key as models like to write it (#3, UNIT 3); texts only."""
    found = summaries.get(key)
    if not isinstance(found, str):
        plain = lambda k: k.strip().lstrip("#").strip().removeprefix("UNIT").removeprefix("unit").strip().lstrip("#").strip()
        found = next((v for k, v in summaries.items() if plain(k) == key and isinstance(v, str)), None)
    return found


def continue_session(
    read: Callable[[], DataFrame], threshold: int = 60_000, mode: str = "summarize", keep: int = 1,
    digest: Callable[[DataFrame], DataFrame] | None = None, summarizer: Callable[[str], str] = compact.extractive_summary,
) -> Outcome:
    """Compacts what read() gives (raw lines of one session) if it exceeds threshold tokens.

    The source may grow meanwhile, so each attempt reads it anew. A summarizer's failure ends the attempts; a failed
    verification starts the next. An output of 95 % of its source or more is dropped.
    """
    problems: list = []
    before = 0
    for _ in range(ATTEMPTS):
        lines = read()
        before = compact.est_tokens(lines).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        if before <= threshold:
            return Outcome("below threshold", before, before)
        summaries = compact.summarize((digest or digests_of)(lines), summarizer) if mode == "summarize" else None
        out = cut_lineage(compact.assemble(lines, mode, keep, summaries))
        problems = [tuple(r) for r in compact.verify_output(out).filter("not ok").select("session_id", "check_name").collect()]
        if problems:
            continue
        after = compact.est_tokens(out.select(F.col("session_id").alias("source"), F.col("out_pos").alias("line_no"), "raw_json")).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        return Outcome("no gain", before, after) if after * 100 >= before * CHURN else Outcome("compacted", before, after, out)
    return Outcome("failed", before, before, problems=tuple(problems))


def digests_of(lines: DataFrame) -> DataFrame:
    """session_id, seg, digest of raw lines."""
    from ..sources import transcripts
    from .sessions import unit_digest

    rec = transcripts.records(lines).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    ids = rec.select("source", F.coalesce(norm_id("session_id"), F.col("source")).alias("session_id")).groupBy("source").agg(F.max("session_id").alias("session_id"))
    blocks = transcripts.blocks(lines).join(ids, "source").drop("source")
    return unit_digest(blocks, cut_lineage(rec.drop("session_id").join(ids, "source").drop("source")))
