"""Streaming over bounded groups of a sorted partition, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import cut_lineage


def map_fragments(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: str, rows_out: int = 20_000, spread: bool = True) -> DataFrame:
    """Shuffles df on keys, sorts each partition by keys and order, and gives fn the columns of each group as lists.

    fn(dict of lists) returns a dict of lists in schema's columns. A task holds one group and a batch of results at a
    time, so keys have to bound the group (for example a session and a block of line numbers).
    """
    out = _schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        held: dict[str, list] = {}
        held_key = None
        ready: dict[str, list] = {f: [] for f in out.names}

        def flush(force: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ready
            if ready[out.names[0]] and (force or len(ready[out.names[0]]) >= rows_out):
                yield pa.RecordBatch.from_arrays([pa.array(ready[f.name], f.type) for f in out], schema=out)
                ready = {f: [] for f in out.names}

        def done() -> None:
            for k, v in fn(held).items():
                ready[k].extend(v)

        for batch in batches:
            names = batch.schema.names
            cols = {n: batch.column(n).to_pylist() for n in names}
            key_rows = list(zip(*(cols[k] for k in keys)))
            start = 0
            for i in range(len(key_rows)):
                if key_rows[i] != held_key:
                    if i > start:
                        for n in names:
                            held[n].extend(cols[n][start:i])
                    if held_key is not None:
                        done()
                        yield from flush(False)
                    held, held_key, start = {n: [] for n in names}, key_rows[i], i
            if key_rows:
                for n in names:
                    held[n].extend(cols[n][start:])
        if held_key is not None:
            done()
        yield from flush(True)

    if spread:
        df = df.repartition(*keys)
    return df.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def carried_fold(df: DataFrame, keys: str, pos: str, width: int, start: list[int], move: Callable, after: Callable, fold: Callable, schema: str) -> DataFrame:
    """A sequential fold over groups of any size, in blocks of width positions: no task holds more than a block's rows.

    keys is the schema of the group's columns. move(columns of a block) is what the block does to any state, as JSON;
    after(move, state) is the state behind it. These are composed over the group's blocks, one row each, and
    fold(columns of a block, state before it) then returns a dict of lists in schema's columns.
    """
    names = [c.split()[0] for c in keys.split(",")]
    d = cut_lineage(df.withColumn("_blk", F.floor(F.col(pos) / width)))
    own = [*names, "_blk"]

    def moved(g: dict) -> dict:
        return {k: g[k][:1] for k in own} | {"_move": [json.dumps(move(g))]}

    def composed(g: dict) -> dict:
        states, state = [], start
        for m in g["_move"]:
            states.append(json.dumps(state))
            state = after(json.loads(m), state)
        return {k: g[k] for k in own} | {"_state": states}

    moves = map_fragments(d, own, [pos], moved, f"{keys}, _blk long, _move string")
    states = map_fragments(moves, names, ["_blk"], composed, f"{keys}, _blk long, _state string")
    return map_fragments(d.join(states, own), own, [pos], lambda g: fold(g, json.loads(g["_state"][0])), schema)


def _schema(df: DataFrame, schema: str) -> pa.Schema:
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    return to_arrow_schema(parsed)
