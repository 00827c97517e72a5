"""Deeply nested records as flat related tables, with Merkle identities of subtrees.

Each container (object or array) of a record gets an identity: the hash of its canonical form, in which keys are sorted
and inner containers stand by their identities, so identity is computed bottom-up and equal subtrees share it.
`occurrences` is the bridge: one row per occurrence of a container with its path, its parent's path and identity, and
its key or ordinal in the parent. `store` keeps each distinct container once, `scalars` its values, so that bridge and
scalars are flat tables that hold all of a record (`values` joins them). Both combine equal containers in each task
before they are shuffled. `rebuild` puts records together again.

Defined results: null, blank, cut-off and non-object lines give no rows; nulls inside records stay in the canonical
form; of equal keys in an object the last counts; JSON inside strings is not opened; nesting of any depth is walked
without recursion; duplicate input rows give the same rows once (`array_objects` is distinct).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.fragments import _schema
from ..functions.jsonwalk import clean, parse_object, scalar, type_name

BRIDGE = "source string, line_no long, obj_path string, parent_path string, key string, ordinal int, kind string, in_array boolean, node_id string, parent_id string, depth int, object_path string, object_id string"
NODES = BRIDGE + ", content string"
#: Distinct containers that a task remembers at most to combine equal ones.
REMEMBERED = 200_000


def flatten(record: dict) -> list[dict]:
    """All containers of a record, outermost first, as rows of NODES without source and line_no."""
    values, rows = [record], [{"obj_path": "", "parent": -1, "key": None, "ordinal": None, "kind": "object", "in_array": False, "depth": 0}]
    i = 0
    inner: list[dict] = []  # of each container: key or ordinal -> index of the inner container
    while i < len(values):
        v, row, found = values[i], rows[i], {}
        is_object = isinstance(v, dict)
        for k, x in v.items() if is_object else enumerate(v):
            if isinstance(x, (dict, list)):
                path = (f"{row['obj_path']}.{k}" if row["obj_path"] else k) if is_object else f"{row['obj_path']}[{k}]"
                found[k] = len(values)
                values.append(x)
                rows.append({
                    "obj_path": path, "parent": i, "key": k if is_object else None, "ordinal": None if is_object else k,
                    "kind": "object" if isinstance(x, dict) else "array", "in_array": not is_object, "depth": row["depth"] + 1,
                })
        inner.append(found)
        i += 1
    for i in range(len(values) - 1, -1, -1):
        v, found, row = values[i], inner[i], rows[i]
        if isinstance(v, dict):
            body = "{" + ",".join(f"{scalar(k)}:" + (f"#{rows[found[k]]['node_id']}" if k in found else scalar(v[k])) for k in sorted(v)) + "}"
        else:
            body = "[" + ",".join(f"#{rows[found[k]]['node_id']}" if k in found else scalar(x) for k, x in enumerate(v)) + "]"
        body = clean(body)
        row["scalars"] = [(k if isinstance(v, dict) else None, None if isinstance(v, dict) else k, x) for k, x in (v.items() if isinstance(v, dict) else enumerate(v)) if k not in found]
        row["content"], row["node_id"] = body, blake2b(body.encode(), digest_size=16).hexdigest()
    for row in rows:
        p = row.pop("parent")
        row["parent_path"], row["parent_id"], row["object_path"], row["object_id"] = (None,) * 4 if p < 0 else (
            rows[p]["obj_path"], rows[p]["node_id"], *((rows[p]["obj_path"], rows[p]["node_id"]) if rows[p]["kind"] == "object" else (rows[p]["object_path"], rows[p]["object_id"])))
    return rows


def _walk(lines: DataFrame, schema: str) -> DataFrame:
    out = _schema(lines, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list] = {n: [] for n in out.names}
        inner = [n for n in out.names if n not in ("source", "line_no")]
        has_line = "source" in out.names

        def flush() -> pa.RecordBatch:
            nonlocal cols
            full, cols = cols, {n: [] for n in out.names}
            return pa.RecordBatch.from_arrays([pa.array(full[f.name], f.type) for f in out], schema=out)

        for b in batches:
            for source, line_no, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                record = parse_object(text)
                if record is None:
                    continue
                for row in flatten(record):
                    if has_line:
                        cols["source"].append(source)
                        cols["line_no"].append(line_no)
                    for n in inner:
                        x = row[n]
                        cols[n].append(clean(x) if n in ("obj_path", "parent_path", "object_path", "key") and x else x)
                if len(cols["node_id"]) >= 20_000:
                    yield flush()
        if cols["node_id"]:
            yield flush()

    return lines.select("source", "line_no", "raw_json").mapInArrow(run, schema)


def occurrences(lines: DataFrame) -> DataFrame:
    """The bridge rows of all containers of lines (source, line_no, raw_json); the record itself has path ''."""
    return _walk(lines, BRIDGE)


def _distinct(lines: DataFrame, schema: str, row_of: Callable[[dict, int, bool], list[tuple]]) -> DataFrame:
    """Rows of containers, equal ones combined in each task: row_of(container, its occurrences, whether it is new here)."""
    out = _schema(lines, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            nonlocal rows
            full, rows = rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*full), out)], schema=out)

        def rest() -> Iterator[pa.RecordBatch]:
            for n, k in counts.items():
                if k:
                    rows.extend(row_of({"node_id": n}, k, False))
            counts.clear()
            if rows:
                yield batch()

        for b in batches:
            for text in b.column(0).to_pylist():
                record = parse_object(text)
                for row in flatten(record) if record is not None else ():
                    if row["node_id"] in counts:
                        counts[row["node_id"]] += 1
                    else:
                        counts[row["node_id"]] = 0
                        rows.extend(row_of(row, 1, True))
                if len(rows) >= 20_000:
                    yield batch()
                if len(counts) > REMEMBERED:
                    yield from rest()
        yield from rest()

    return lines.select("raw_json").mapInArrow(run, schema)


def store(lines: DataFrame) -> DataFrame:
    """Each distinct container once: node_id, kind, content (canonical, inner containers as #node_id), n_occurrences."""
    one = _distinct(lines, "node_id string, kind string, content string, n long", lambda r, n, new: [(r["node_id"], r.get("kind"), r.get("content"), n)])
    return one.groupBy("node_id").agg(F.max("kind").alias("kind"), F.max("content").alias("content"), F.sum("n").alias("n_occurrences"))


def scalars(lines: DataFrame) -> DataFrame:
    """The values in each distinct container that are no containers: node_id, key or ordinal, type, value (text; null for null)."""

    def rows(r: dict, n: int, new: bool) -> list[tuple]:
        return [(r["node_id"], None if k is None else clean(k), i, type_name(v), None if v is None else clean(v if isinstance(v, str) else scalar(v))) for k, i, v in r["scalars"]] if new else []

    return _distinct(lines, "node_id string, key string, ordinal int, type string, value string", rows).distinct()


def values(lines: DataFrame) -> DataFrame:
    """Every value of every record, from bridge and scalars: source, line_no, obj_path (of its container), key, ordinal, type, value."""
    at = occurrences(lines).select("source", "line_no", "obj_path", "node_id")
    return at.join(scalars(lines), "node_id").select("source", "line_no", "obj_path", "key", "ordinal", "type", "value")


def array_objects(bridge: DataFrame) -> DataFrame:
    """Objects that are elements of arrays, at any depth: source, line_no, obj_path."""
    return bridge.filter("kind = 'object' and in_array").select("source", "line_no", "obj_path").distinct()


def child_rows(bridge: DataFrame) -> DataFrame:
    """Every container of the records (records, arrays and objects) with its key or ordinal in the container that holds it
    (parent_path, parent_id; null for records), and the nearest object above it (object_path, object_id)."""
    return bridge.select("source", "line_no", "obj_path", "kind", "parent_path", "key", "ordinal", "node_id", "parent_id", "object_path", "object_id").distinct()


def rebuild(node_id: str, contents: dict[str, str]) -> str:
    """The canonical JSON of a stored container (for tests and single lookups)."""
    import re

    # strings are passed over: what looks like a reference in them is none
    part = re.compile(r'"(?:[^"\\]|\\.)*"|#([0-9a-f]{32})')
    text = "#" + node_id
    while True:
        new = part.sub(lambda m: contents[m[1]] if m[1] else m[0], text)
        if new == text:
            return text
        text = new
