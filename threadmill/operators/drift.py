"""Schemas that drift between writer versions: the changes of each version, and one consistent table.

One pass over the lines profiles them: each line's signature (its set of fields and types), and per explicit version
sparse counts of value shapes and values of each field. Versions are then carried over to lines without one, blockwise,
so a long file doesn't become one task. What reaches the driver is the schema: fields, types and profiles per version,
bounded by MAX_FIELDS. There each pair of neighbouring versions is matched by similarity flooding: pairs of fields
start with the likeness of their names and values, pass scores to the pairs of their parents, children and types until
the scores converge, and consistent one-to-one correspondences below the same parent are renames.

Defined results: lines that are no JSON objects don't count; null values don't make a field; nothing below a key
`input` or `toolUseResult` is a field; a file without any version is left out; no lines give no changes.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, StringType, StructField, StructType

from ..functions.fragments import _schema
from ..functions.jsonwalk import clean, parse_object, scalar, type_name
from ..session import cut_lineage

#: Keys below which nothing is a field (fixed values).
OPAQUE = ("input", "toolUseResult")
#: Lines of a block when versions are carried over; rows of profile that the driver takes at most.
BLOCK, MAX_FIELDS = 8192, 500_000
CHANGES = "writer_version string, change_kind string, field string, new_field string"
PROFILE = "kind string, source string, line_no long, version string, sig string, path string, type string, dim int, n long"

_SHAPE = {c: "a" for c in range(97, 123)} | {c: "A" for c in range(65, 91)} | {c: "9" for c in range(48, 58)}
_RUN = re.compile(r"(.)\1+")


def fields(record: dict) -> dict[str, tuple[set, list]]:
    """path -> (types, scalar values) of a record's fields."""
    out: dict[str, tuple[set, list]] = {}
    stack: list[tuple[str, object, bool]] = [("", record, True)]
    while stack:
        path, v, is_open = stack.pop()
        if path:
            if v is None:
                continue
            types, values = out.setdefault(path, (set(), []))
            types.add(type_name(v))
            if not isinstance(v, (dict, list)):
                values.append(v)
                continue
        if not is_open:
            continue
        if isinstance(v, dict):
            for k, x in v.items():
                stack.append((f"{path}.{k}" if path else k, x, k not in OPAQUE))
        else:
            for x in v:
                stack.append((f"{path}[]", x, True))
    return out


def _dims(v: object) -> tuple[int, ...]:
    """Where a value counts in a field's profile: shapes in 0..63, values in 64..127, magnitudes from 128."""
    if isinstance(v, bool):
        return (64 + v,)
    if isinstance(v, (int, float)):
        return (128 + min(40, int(abs(v)).bit_length()),)
    size = 200 + min(30, len(v).bit_length())
    if len(v) > 200:
        return (size,)
    shape = _RUN.sub(r"\1", v.translate(_SHAPE))
    return (zlib.crc32(shape.encode("utf-8", "replace")) % 64, 64 + zlib.crc32(v.encode("utf-8", "replace")) % 64, size)


def version_text(v: object) -> str | None:
    if v is None:
        return None
    return clean(v) if isinstance(v, str) else scalar(v)


def _profile(lines: DataFrame) -> DataFrame:
    out = _schema(lines, PROFILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: set[str] = set()
        counts: dict[tuple, int] = defaultdict(int)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(out.names)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

        def features() -> pa.RecordBatch:
            rows = [("feat", None, None, v, None, p, None, d, n) for (v, p, d), n in counts.items()]
            counts.clear()
            return batch(rows)

        for b in batches:
            rows: list[tuple] = []
            for source, line_no, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                record = parse_object(text)
                if record is None:
                    continue
                found = fields(record)
                own = sorted((clean(p), t) for p, (types, _) in found.items() for t in types)
                sig = blake2b(json.dumps(own).encode(), digest_size=12).hexdigest()
                if sig not in sigs:
                    sigs.add(sig)
                    rows.extend(("sig", None, None, None, sig, p, t, None, None) for p, t in own)
                version = version_text(record.get("version"))
                rows.append(("line", source, line_no, version, sig, None, None, None, None))
                if version is not None:
                    for p, (_, values) in found.items():
                        for v in values:
                            for d in _dims(v):
                                counts[version, clean(p), d] += 1
            if rows:
                yield batch(rows)
            if len(counts) > 200_000:
                yield features()
        if counts:
            yield features()

    return lines.select("source", "line_no", "raw_json").mapInArrow(run, PROFILE)


def fill_versions(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """lines (source, line_no, version, ...) with the version of the nearest line before in the file, else after."""
    d = lines.withColumn("line_no", F.coalesce("line_no", F.lit(-1))).withColumn("blk", F.floor(F.col("line_no") / block))
    inside = Window.partitionBy("source", "blk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    has = F.col("version").isNotNull()
    ends = d.groupBy("source", "blk").agg(F.max_by("version", F.when(has, F.col("line_no"))).alias("last_v"), F.min_by("version", F.when(has, F.col("line_no"))).alias("first_v"))
    across = Window.partitionBy("source").orderBy("blk")
    ends = ends.select(
        "source", "blk", "first_v", F.last("last_v", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("before_v"),
        F.first("first_v", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("after_v"),
    )
    d = d.withColumn("in_v", F.last("version", True).over(inside)).join(ends, ["source", "blk"])
    return d.withColumn("writer_version", F.coalesce("in_v", "before_v", "first_v", "after_v")).drop("blk", "in_v", "first_v", "before_v", "after_v")


def version_key(v: str) -> tuple:
    """Order of versions: numbers as numbers."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"[.\-+_]", v))


def schemas(lines: DataFrame) -> tuple[dict[str, dict[str, frozenset]], dict[tuple[str, str], dict[int, int]]]:
    """types[version][path] and profile[version, path] of lines, taken to the driver (bounded by MAX_FIELDS)."""
    p = cut_lineage(_profile(lines))
    per_sig = fill_versions(p.filter("kind = 'line'").select("source", "line_no", "version", "sig")).filter("writer_version is not null").groupBy("writer_version", "sig").count()
    sigs = p.filter("kind = 'sig'").select("sig", "path", "type").distinct()
    held = per_sig.join(sigs, "sig").groupBy("writer_version", "path").agg(F.array_sort(F.collect_set("type")).alias("types"))
    feats = p.filter("kind = 'feat'").groupBy("version", "path", "dim").agg(F.sum("n").alias("n"))
    rows, frows = held.limit(MAX_FIELDS + 1).collect(), feats.limit(MAX_FIELDS * 4 + 1).collect()
    if len(rows) > MAX_FIELDS or len(frows) > 4 * MAX_FIELDS:
        raise ValueError("more fields than a schema has: keys of open maps belong to OPAQUE")
    types: dict[str, dict[str, frozenset]] = defaultdict(dict)
    for r in rows:
        types[r.writer_version][r.path] = frozenset(r.types)
    profile: dict[tuple[str, str], dict[int, int]] = defaultdict(dict)
    for r in frows:
        profile[r.version, r.path][r.dim] = r.n
    return types, profile


def parent_of(path: str) -> str:
    return path[:-2] if path.endswith("[]") else path.rpartition(".")[0]


def name_of(path: str) -> str:
    return "[]" if path.endswith("[]") else path.rpartition(".")[2]


def name_likeness(a: str, b: str) -> float:
    x, y = (re.sub(r"[^a-z0-9]", "", s.lower()) for s in (a, b))
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    inside = min(len(x), len(y)) / max(len(x), len(y)) if x in y or y in x else 0.0
    return max(SequenceMatcher(None, x, y).ratio(), 0.5 + inside / 2 if inside and min(len(x), len(y)) > 3 else 0.0)


def value_likeness(p: dict[int, int], q: dict[int, int]) -> float:
    """Cosines of the parts of two profiles, averaged over the parts that either has."""
    found = []
    for lo, hi in ((0, 64), (64, 128), (128, 200), (200, 300)):
        a, b = ({d: n for d, n in x.items() if lo <= d < hi} for x in (p, q))
        if a or b:
            na, nb = (sum(n * n for n in x.values()) ** 0.5 for x in (a, b))
            found.append(sum(n * b.get(d, 0) for d, n in a.items()) / (na * nb) if na and nb else 0.0)
    return sum(found) / len(found) if found else 0.0


def flood(a: dict[str, frozenset], b: dict[str, frozenset], start: dict[tuple[str, str], float], rounds: int = 100, eps: float = 1e-4) -> dict[tuple, float]:
    """Similarity flooding over pairs of fields: scores go to the pairs of parents, children and types until they converge."""
    near: dict[tuple, dict[tuple, float]] = defaultdict(dict)
    for (x, y) in start:
        up = (parent_of(x), parent_of(y))
        if x and y and up in start:
            near[up][x, y] = near[x, y][up] = 1.0
        for t in a.get(x, frozenset()) & b.get(y, frozenset()):
            near[("type", t), ("type", t)][x, y] = near[x, y][("type", t), ("type", t)] = 1.0
    first = dict(start) | {k: 0.5 for k in near if k not in start}
    score = dict(first)
    for _ in range(rounds):
        new = {k: first[k] + score[k] for k in first}
        for k, out in near.items():
            share = (first[k] + score[k]) / len(out)
            for other in out:
                new[other] += share
        top = max(new.values(), default=1.0)
        new = {k: v / top for k, v in new.items()}
        moved = max((abs(new[k] - score[k]) for k in new), default=0.0)
        score = new
        if moved < eps:
            break
    return score


def depth_of(path: str) -> int:
    return path.count(".") + path.count("[]")


def correspondences(a: dict[str, frozenset], b: dict[str, frozenset], likeness, least: float = 0.5) -> dict[str, str]:
    """Fields of a that fields of b continue under another name, below the same parent.

    The flooded score decides, likeness is only its seed: a pair counts if its score lies at `least` or more on the way
    from what it gets where no pair has a likeness (by place and type alone) to what it gets where the likeliest pair of
    each field is sure, each against the score of the records themselves. Parents go before children; of rivals the one
    further on wins.
    """
    start = {("", ""): 1.0} | {(p, p): 1.0 for p in a if p in b}
    gone, new = defaultdict(list), defaultdict(list)
    for own, other, by in ((a, b, gone), (b, a, new)):
        for p in own:
            if p not in other:
                by[parent_of(p)].append(p)
    likeliest: dict[tuple, tuple] = {}  # (side, field, parent of the other) -> pair
    todo = sorted({(p, p) for p in gone if p in new})
    while todo:
        up = todo.pop()
        own = {(x, y): likeness(x, y) for x in gone[up[0]] for y in new[up[1]] if a[x] & b[y] and (name_of(x) == "[]") == (name_of(y) == "[]")}
        start |= own
        for k in sorted(own, key=lambda k: (-own[k], k)):
            if (0, k[0], up[1]) not in likeliest and (1, k[1], up[0]) not in likeliest:
                likeliest[0, k[0], up[1]] = likeliest[1, k[1], up[0]] = k
        todo.extend(k for k in own if k[0] in gone and k[1] in new)
    pairs = [k for k in start if k[0] != k[1]]
    if not pairs:
        return {}
    runs = [flood(a, b, x) for x in (start, start | dict.fromkeys(pairs, 0.0), start | dict.fromkeys(likeliest.values(), 1.0))]
    score, none, sure = ({k: run[k] / run["", ""] for k in pairs} for run in runs)
    share = {}
    for x, y in pairs:
        best = likeliest.get((0, x, parent_of(y))) or likeliest[1, y, parent_of(x)]
        way = sure[best] - none[best]
        share[x, y] = (score[x, y] - none[x, y]) / way if way > 0 else 0.0
    out: dict[str, str] = {}
    taken: set[str] = set()
    for x, y in sorted(pairs, key=lambda k: (depth_of(k[0]), -share[k], -start[k], k)):
        if share[x, y] >= least and x not in out and y not in taken and out.get(parent_of(x), parent_of(x)) == parent_of(y):
            out[x] = y
            taken.add(y)
    return out


def changes_between(version: str, a: dict[str, frozenset], b: dict[str, frozenset], likeness) -> list[tuple[str, str, str, str]]:
    """Changes of b's schema against a's, without what lies below a changed path."""
    renamed = correspondences(a, b, likeness)
    kinds: dict[str, tuple] = {}
    for x, y in renamed.items():
        kinds[x] = (version, "renamed", x, y)
    back = set(renamed.values())
    for x in a:
        if x not in b and x not in renamed:
            kinds[x] = (version, "removed", x, "")
        elif x in b and a[x] != b[x]:
            kinds[x] = (version, "retyped", x, "")
    for y in b:
        if y not in a and y not in back:
            kinds[y] = (version, "added", y, "")

    def below(p: str) -> bool:
        while p := parent_of(p):
            if p in kinds or p in back:
                return True
        return False

    return [r for p, r in kinds.items() if not below(p)]


def drift(types: dict[str, dict[str, frozenset]], profile: dict[tuple[str, str], dict[int, int]]) -> list[tuple[str, str, str, str]]:
    versions, out = sorted(types, key=version_key), []
    for v, w in zip(versions, versions[1:]):

        def likeness(x: str, y: str) -> float:
            names = name_likeness(name_of(x), name_of(y))
            if types[v][x] == {"boolean"}:
                return 0.7 * names + 0.3 * value_likeness(profile.get((v, x), {}), profile.get((w, y), {}))
            if types[v][x] & {"object", "array"}:
                kids = [{p[len(r) :] for p in types[u] if p.startswith((r + ".", r + "["))} for u, r in ((v, x), (w, y))]
                return 0.4 * names + 0.6 * (len(kids[0] & kids[1]) / len(kids[0] | kids[1]) if kids[0] | kids[1] else 0.0)
            return 0.4 * names + 0.6 * value_likeness(profile.get((v, x), {}), profile.get((w, y), {}))

        out += changes_between(w, types[v], types[w], likeness)
    return out


def find_changes(lines: DataFrame) -> DataFrame:
    """The changes of each version against the one before: writer_version, change_kind, field, new_field."""
    return lines.sparkSession.createDataFrame(sorted(set(drift(*schemas(lines)))), CHANGES)


def newest_paths(types: dict[str, dict[str, frozenset]], changes: list[tuple[str, str, str, str]]) -> dict[str, dict[str, str]]:
    """Per version: its renamed fields and what they are called in the newest version, parents' names followed too."""
    versions = sorted(types, key=version_key)
    renamed: dict[str, dict[str, str]] = defaultdict(dict)
    for w, kind, x, y in changes:
        if kind == "renamed":
            renamed[w][x] = y
    out: dict[str, dict[str, str]] = {}
    for i, v in enumerate(versions):
        own = {}
        for start in types[v]:
            p = start
            for w in versions[i + 1 :]:
                head, rest = p, ""
                while head:  # the longest renamed path at or above p
                    if head in renamed[w]:
                        p = renamed[w][head] + rest
                        break
                    up = parent_of(head)
                    rest = head[len(up) :] + rest
                    head = up
            if p != start:
                own[start] = p
        out[v] = own
    return out


def newest_types(types: dict[str, dict[str, frozenset]], to: dict[str, dict[str, str]]) -> dict[str, frozenset]:
    """The types of every field, by its newest name, in the newest version that has it."""
    out: dict[str, frozenset] = {}
    for v in sorted(types, key=version_key):
        out |= {to[v].get(p, p): t for p, t in types[v].items()}
    return out


def table_schema(newest: dict[str, frozenset]) -> StructType:
    """The columns of the one table: a field of one type has that type, one of several holds JSON text; names that differ
    in case only, or clash with the table's own columns, get a number."""
    kids: dict[str, list[str]] = defaultdict(list)
    for p in newest:
        kids[parent_of(p)].append(p)
    plain = {frozenset({"string"}): StringType(), frozenset({"number"}): DoubleType(), frozenset({"boolean"}): BooleanType()}

    def kind_of(p: str):
        if newest[p] == {"object"} and name_of(p) not in OPAQUE and kids[p]:
            return struct_of(p, set())
        if newest[p] == {"array"} and kids[p] == [p + "[]"]:
            return ArrayType(kind_of(p + "[]"))
        return plain.get(newest[p], StringType())

    def struct_of(p: str, taken: set) -> StructType:
        out = []
        for k in sorted(kids[p]):
            name, n = name_of(k), 2
            while name.lower() in taken:
                name, n = f"{name_of(k)}_{n}", n + 1
            taken.add(name.lower())
            out.append(StructField(name, kind_of(k), True, {"path": k}))
        return StructType(out)

    return struct_of("", {"source", "line_no", "cast_failed"})


def _cast(v: object, kind: DataType) -> tuple[object, bool]:
    """A scalar in a column's type, and whether the cast failed (then null)."""
    if v is None:
        return None, False
    if isinstance(kind, BooleanType):
        return (v, False) if isinstance(v, bool) else (str(v).lower() == "true", False) if str(v).lower() in ("true", "false") else (None, True)
    if isinstance(kind, DoubleType):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            try:
                return float(v), False
            except OverflowError:
                return None, True
        if isinstance(v, str):
            try:
                return float(v), False
            except ValueError:
                from datetime import datetime, timezone

                try:
                    t = datetime.fromisoformat(v.replace("Z", "+00:00"))
                    return float(round((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1000)), False
                except ValueError:
                    pass
        return None, True
    return clean(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)), False


def unify(lines: DataFrame) -> DataFrame:
    """All lines in one table: source, line_no, a typed column for every field by its newest name at every depth, and
    cast_failed (field -> JSON array of the values that fit its newest type in no way, or have no column; null there).

    A scalar where the newest type is an array counts as its one element; an object or array where it is a scalar fails.
    Lines without a version are renamed as the version that they belong to; a file without any is not renamed.
    """
    types, profile = schemas(lines)
    changes = drift(types, profile)
    to = newest_paths(types, changes)
    schema = table_schema(newest_types(types, to))
    full = StructType([StructField("source", StringType()), StructField("line_no", LongType()), *schema.fields, StructField("cast_failed", MapType(StringType(), StringType()))])
    out = to_arrow_schema(full)
    plain = StructType([StructField(f.name, f.dataType) for f in full])

    def shaped(v: object, path: str, kind: DataType, moved: dict[str, str], own: str, failed: dict) -> object:
        """v, which stands at own in its record and at path in the table, in a column's type."""
        if v is None:
            return None
        if isinstance(kind, StructType):
            if not isinstance(v, dict):
                failed.setdefault(path, []).append(v)
                return None
            return fill(v, path, kind, moved, own, failed)
        if isinstance(kind, ArrayType):
            rows = v if isinstance(v, list) else [v]
            return [shaped(x, path + "[]", kind.elementType, moved, own + "[]" if isinstance(v, list) else own, failed) for x in rows]
        if not isinstance(kind, StringType) and isinstance(v, (dict, list)):
            failed.setdefault(path, []).append(v)
            return None
        value, bad = _cast(v, kind)
        if bad:
            failed.setdefault(path, []).append(v)
        return value

    def fill(v: dict, path: str, kind: StructType, moved: dict[str, str], own: str, failed: dict) -> dict:
        by = {f.metadata["path"]: f for f in kind.fields}
        row = dict.fromkeys((f.name for f in kind.fields))
        for k, x in v.items():
            k = clean(k)
            at = f"{own}.{k}" if own else k
            to_path = moved.get(at) or (f"{path}.{k}" if path else k)
            f = by.get(to_path)
            if f is None:
                failed.setdefault(to_path, []).append(x)
            elif x is not None:
                row[f.name] = shaped(x, to_path, f.dataType, moved, at, failed)
        return row

    p = _profile(lines).filter("kind = 'line'").select("source", "line_no", "version")
    given = fill_versions(p).filter("version is null").select(F.col("source").alias("s"), F.col("line_no").alias("n"), "writer_version")
    d = lines.join(given, F.col("source").eqNullSafe(F.col("s")) & (F.coalesce("line_no", F.lit(-1)) == F.col("n")), "left").select("source", F.col("line_no").cast("long").alias("line_no"), "raw_json", "writer_version")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for source, line_no, text, given_version in zip(*(c.to_pylist() for c in b.columns)):
                record = parse_object(text)
                if record is None:
                    continue
                failed: dict[str, list] = {}
                own = version_text(record.get("version")) or given_version
                rows.append({"source": source, "line_no": line_no, **fill(record, "", schema, to.get(own, {}), "", failed), "cast_failed": [(k, clean(json.dumps(v, ensure_ascii=False))) for k, v in sorted(failed.items())]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return d.mapInArrow(run, plain)
