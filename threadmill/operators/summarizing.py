"""Summaries of units in batches: routed by salience, prompted together, in two rounds.

A summarizer is a function of (prompt, model) that answers with a JSON object of unit key -> summary; it runs in the
executors, one call per batch. Units of a session are batched in order, so that neighbours share their context: at most
ten units and 120,000 bytes, one larger unit alone. Units that no answer of the first round has are asked for again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.jsonwalk import clean
from ..session import cut_lineage
from .compact import BATCH_BYTES, BATCH_UNITS, extractive_summary
from .continuation import extract_json_object, lookup_summary
from .sessions import batches

#: Salience from which units go to the stronger model, rounds, calls at once (fixed values).
ESCALATE, ROUNDS, WAVE = 0.4, 2, 3
RUBRIC = (
    "For each unit below write the summary that replaces it, in the first person and past tense, as the assistant's own recap. Keep decisions and their reasons, file paths, commands, "
    "identifiers, numbers and exact error messages; leave out what later steps made void. Answer with one JSON object and nothing else."
)


def prompt_of(keys: list[str], digests: list[str]) -> str:
    body = "".join(f"\n### UNIT {k}\n{d}\n" for k, d in zip(keys, digests))
    return f"{RUBRIC}\nThe JSON keys must be exactly {json.dumps(keys)} — the bare identifiers, nothing else.\n{body}"


def extractive(prompt: str, model: str) -> str:
    """The default summarizer: the first lines of each unit of a prompt."""
    units = [x.partition("\n") for x in prompt.split("\n### UNIT ")[1:]]
    return json.dumps({k: extractive_summary(d.strip("\n")) for k, _, d in units})


def jobs(units: DataFrame, model: str, escalate_with: str | None = None, escalate_above: float = ESCALATE) -> DataFrame:
    """session_id, model, batch, wave, keys, digests of units (session_id, seg, salience, digest): one row per call."""
    hot = F.lit(escalate_with is not None) & (F.col("salience") >= escalate_above)
    u = cut_lineage(units.select("session_id", "seg", "digest", F.when(hot, escalate_with).otherwise(model).alias("model")))
    group = F.concat_ws("\x1f", "session_id", "model")
    sized = u.select(group.alias("session_id"), "seg", (F.octet_length("digest") + F.octet_length(F.col("seg").cast("string")) + 12).cast("long").alias("size"))
    b = batches(sized, "size", BATCH_UNITS, BATCH_BYTES).withColumnRenamed("session_id", "g")
    d = u.withColumn("g", group).join(b, ["g", "seg"])
    ordered = F.sort_array(F.collect_list(F.struct("seg", "digest")))
    return d.groupBy("session_id", "model", "batch").agg(ordered.alias("x")).select(
        "session_id", "model", "batch", F.floor(F.col("batch") / WAVE).alias("wave"), F.transform("x", lambda x: x["seg"].cast("string")).alias("keys"), F.transform("x", lambda x: x["digest"]).alias("digests")
    )


def summarize_units(
    units: DataFrame, summarizer: Callable[[str, str], str] = extractive, model: str = "small", escalate_with: str | None = None, escalate_above: float = ESCALATE,
) -> DataFrame:
    """session_id, seg, summary of units; raises if any has none after the last round."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out = []
            for s, model_, keys, digests in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    held = extract_json_object(summarizer(prompt_of(keys, digests), model_)) or {}
                except Exception:  # a call that fails leaves its units to the next round
                    held = {}
                out += [(s, int(k), clean(t)) for k in keys if (t := lookup_summary(held, k)) and t.strip()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], ["session_id", "seg", "summary"])

    left, done = units, None
    for _ in range(ROUNDS):
        got = cut_lineage(jobs(left, model, escalate_with, escalate_above).select("session_id", "model", "keys", "digests").mapInArrow(run, "session_id string, seg long, summary string"))
        done = got if done is None else done.unionByName(got)
        left = cut_lineage(left.join(got.select("session_id", "seg"), ["session_id", "seg"], "left_anti"))
        if not left.limit(1).count():
            return done
    raise ValueError(f"no summary after {ROUNDS} rounds: {[tuple(r) for r in left.select('session_id', 'seg').limit(5).collect()]}")
