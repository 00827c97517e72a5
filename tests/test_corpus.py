"""The general training-data operators against brute force, round trips and edge cases."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from threadmill.functions.jsonwalk import _parse_deep, parse_object
from threadmill import corpus_queries
from threadmill.operators import drift, hierarchy, nested, references
from threadmill.session import cut_lineage


# --- orphan references

def test_orphans_missing_removed_and_late(make):
    rec = lambda line, uuid, parent, at, **k: dict(session_id="S1", line_no=line, uuid=uuid, parent_uuid=parent, ingested_at=at, **k)
    records = make.records([
        rec(0, "A", None, 10), rec(1, "b", " a ", 11), rec(2, "c", "nope", 12), rec(3, "d", "LATE", 5), rec(4, "late", " ", 9), rec(5, "e", "gone", 20), rec(6, "gone", "a", 20),
        rec(7, "f", "a", 30, provenance=("x", "s1", "0", ["B", "zz", None, ""])), rec(7, "f", "a", 40, provenance=("x", "s1", "0", ["B", "zz", None, ""])),
        rec(8, "h", "a", 31, provenance=("x", None, "0", ["b"])),
    ])
    blocks = make.blocks([
        dict(session_id="s1", line_no=1, pos=0, tool_id="T1"), dict(session_id="s1", line_no=2, pos=0, tool_use_id="t1 "), dict(session_id="s1", line_no=2, pos=1, tool_use_id="t9"),
        dict(session_id="s1", line_no=6, pos=0, tool_use_id="t8"), dict(session_id="s1", line_no=0, pos=0, tool_use_id="t1"), dict(session_id="s1", line_no=2, pos=1, tool_use_id="t9"),
    ])
    removed = make.removed([dict(session_id="s1", uuid="GONE", removed_at=50), dict(session_id="s1", uuid=None, removed_at=None)])
    got = references.find_orphans(records, blocks, removed)
    rows = [(r.ref_kind, r.line_no, r.ref_id) for r in got.collect()]
    assert sorted(rows) == sorted([
        ("parent", 2, "nope"), ("parent", 3, "late"), ("parent", 5, "gone"), ("covered", 7, "zz"), ("covered", 8, "b"), ("tool", 2, "t9"), ("tool", 0, "t1"),
    ])
    assert {(r.table_name, r.ref_kind): r.n_orphans for r in references.report(got).collect()} == {("records", "parent"): 3, ("records", "covered"): 2, ("blocks", "tool"): 2}


def test_orphans_fold_and_empty(make):
    records = make.records([dict(session_id="s", line_no=i, uuid=f"u{i}", parent_uuid=f"u{i - 1}" if i else None, ingested_at=i) for i in range(20)] + [dict(session_id="s", line_no=30, uuid="x", parent_uuid="u99", ingested_at=30)])
    removed = make.removed([dict(session_id="S", uuid="U7 ", removed_at=9)])
    lines = references.full_lines(references.record_lines(records), references.tool_lines(make.blocks([])), references.removals(removed))
    d = references.deltas(references.contributions(lines))
    assert {r.sign for r in d.groupBy("session_id").agg(F.min("exists").alias("sign")).collect()} == {-1}
    whole = references.count_state(d)
    parts = references.fold(references.count_state(d.filter("exists > 0 or refs > 0")), references.count_state(d.filter("exists < 0 or refs < 0")))
    key = lambda s: sorted((r.ref_id, str(r.at), r.refs, r.exists) for r in s.collect())
    assert key(whole) == key(parts)
    assert sorted(r.ref_id for r in references.orphan_keys(parts).collect()) == ["u7", "u99"]
    empty = references.find_orphans(make.records([]), make.blocks([]), make.removed([]))
    assert empty.count() == 0


def test_extra_columns_do_not_clash(make):
    records = make.records([dict(session_id="s", line_no=0, uuid="a", parent_uuid="b", ingested_at=1)])
    for c in ("ref_id", "at", "domain", "gone_at", "tree", "pos", "frag"):
        records = records.withColumn(c, F.lit("clash"))
    assert references.find_orphans(records, make.blocks([]).withColumn("at", F.lit(1)), make.removed([])).count() == 1
    assert hierarchy.resolve(hierarchy.tree_nodes(records)).count() == 1


# --- hierarchies

def brute(rows):
    up, out, total = {(t, i): u for t, i, u, _ in rows}, {}, collections.Counter()
    for t, i in up:
        d, x, seen, st = 0, i, set(), None
        while st is None:
            if x in seen:
                st = "cycle"
                break
            seen.add(x)
            u = up[t, x]
            if u is None:
                st = "root"
            elif (t, u) not in up:
                st = "missing"
            else:
                x, d = u, d + 1
        out[t, i] = (None, None, st) if st == "cycle" else (x, d, st)
    for t, i in up:
        if out[t, i][2] != "cycle":
            x = i
            while True:
                total[t, x] += 1
                x = up[t, x]
                if x is None or (t, x) not in up:
                    break
    return out, total


def forest(mode, seed):
    rng, rows = random.Random(seed), []
    for t, n in enumerate((5, 150, 40, 1, 260)):
        for i in range(n):
            r = rng.random()
            u = None if r < 0.02 else f"x{i}" if r < 0.03 else f"n{i - 1}" if mode == "chain" and i else f"n{max(0, i - rng.randint(1, 3))}" if mode == "near" and rng.random() > 0.01 else f"n{rng.randrange(n)}"
            rows.append((f"t{t}", f"n{i}", None if mode == "chain" and not i else u, i))
    return rows


@pytest.mark.parametrize("mode,block,small", [("near", 16, 8), ("random", 16, 8), ("chain", 8, 4), ("near", 4096, 65536)])
def test_hierarchy_against_brute_force(spark, mode, block, small):
    rows = forest(mode, 3)
    df = spark.createDataFrame(rows, "tree string, id string, up string, pos long")
    want, total = brute(rows)
    got = hierarchy.resolve(df, weight=F.lit(1), paths=True, block=block, small=small).collect()
    assert {(r.tree, r.id): (r.root, r.depth, r.status) for r in got} == want
    assert all(r.total == total[r.tree, r.id] for r in got if r.status != "cycle")
    by = {(r.tree, r.id): r for r in got}
    up = {(t, i): u for t, i, u, _ in rows}
    for r in got:
        if r.status != "cycle":
            path, x = [], r.id
            while x is not None and (r.tree, x) in by:
                node = by[r.tree, x]
                assert len(node.tail) <= hierarchy.ANCHOR
                path, x = node.tail + path, node.anchor
            assert len(path) == r.depth + 1 and path[-1] == r.id and all(up[r.tree, b] == a for a, b in zip(path, path[1:]))


def test_hierarchy_paths_of_stated_nodes(make):
    records = make.records([dict(session_id="s", line_no=i, uuid=f"u{i}", parent_uuid=f"u{i - 1}" if i else " ", ingested_at=1) for i in range(50)] + [dict(session_id="s", line_no=3, uuid="U3", parent_uuid="u0", ingested_at=0)])
    h = hierarchy.resolve(hierarchy.tree_nodes(records))
    p = hierarchy.paths(h, h.filter("id in ('u49', 'u3')").select("tree", "id"), block=8, small=2).collect()
    for t, n in (("u49", 50), ("u3", 4)):
        assert [r.id for r in sorted((r for r in p if r.target == t), key=lambda r: r.depth)] == [f"u{i}" for i in range(n)]
    assert hierarchy.hierarchy(records).filter("uuid = 'u10'").first().n_descendants == 39


@pytest.mark.parametrize("mode,block,small", [("near", 16, 4), ("random", 16, 4), ("chain", 8, 2)])
def test_preorder_and_full_paths_against_brute_force(spark, mode, block, small):
    rows = forest(mode, 7)
    df = spark.createDataFrame([(t, i, u, p) for t, i, u, p in rows], "session_id string, uuid string, parent_uuid string, line_no long")
    want, _ = brute(rows)
    up = {(t, i): u for t, i, u, _ in rows}
    kids, first = collections.defaultdict(list), {}
    for t, i, u, p in rows:
        if want[t, i][2] != "cycle" and want[t, i][0] != i:
            kids[t, u].append((p, i))
    for t, i, u, p in rows:
        if want[t, i][0] == i:
            stack, n = [i], 0
            while stack:
                x = stack.pop()
                first[t, x], n = n, n + 1
                stack.extend(c for _, c in sorted(kids[t, x], reverse=True))
    got = hierarchy.hierarchy(df, block=block, small=small).collect()
    assert {(r.session_id, r.uuid): r.first for r in got if r.status != "cycle"} == first
    assert all(r.first is None for r in got if r.status == "cycle")
    rng = random.Random(1)
    targets = [(t, i) for t, i, _, _ in rng.sample(rows, 40)] + [("t0", "nowhere")]
    h = hierarchy.resolve(hierarchy.tree_nodes(df), block=block, small=small)
    found = collections.defaultdict(dict)
    for r in hierarchy.paths(h, spark.createDataFrame(targets, "tree string, id string"), block=block, small=small).collect():
        assert r.depth not in found[r.tree, r.target]
        found[r.tree, r.target][r.depth] = r.id
    for t, i in targets:
        path, x = [], i
        while want.get((t, i), (0, 0, "cycle"))[2] != "cycle" and x is not None and (t, x) in up:
            path.append(x)
            x = up[t, x]
        assert [v for _, v in sorted(found[t, i].items())] == path[::-1]


@pytest.mark.parametrize("mode,piece,block,small", [("near", 8, 32, 64), ("random", 8, 32, 64), ("chain", 512, 4096, 65536)])
def test_every_path_and_all_descendants_against_brute_force(spark, mode, piece, block, small):
    rows = forest(mode, 11) + [("loop", i, u, p) for p, (i, u) in enumerate([("a", "c"), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "d"), ("self", "self")] + [(f"f{k}", f"f{k - 1}" if k else "e") for k in range(20)])]
    up = {(t, i): u for t, i, u, _ in rows}
    steps, below = set(), set()
    for t, i in up:
        way, x = [], i
        while x is not None and (t, x) in up and x not in way:
            way.append(x)
            x = up[t, x]
        below |= {(t, x, i) for x in way if x != i}
        if x not in way:
            steps |= {(t, i, d, x) for d, x in enumerate(reversed(way))}
    h = cut_lineage(hierarchy.resolve(spark.createDataFrame(rows, "tree string, id string, up string, pos long"), block=block, small=small))
    got = [tuple(r) for r in hierarchy.every_path(h, piece, block, small).select("tree", "target", "depth", "id").collect()]
    assert len(got) == len(steps) and set(got) == steps
    got = [tuple(r) for r in hierarchy.descendants(h, piece, block, small).select("tree", "id", "descendant").collect()]
    assert len(got) == len(below) and set(got) == below


def test_queries_give_whole_paths_and_all_descendants(spark, sf):
    nodes = {(r.session_id, r.uuid): r for r in corpus_queries.p4_hierarchy(spark, sf).collect()}
    ways, below = collections.defaultdict(dict), collections.Counter()
    for r in corpus_queries.p4_paths(spark, sf).collect():
        assert r.depth not in ways[r.session_id, r.uuid]
        ways[r.session_id, r.uuid][r.depth] = r.path_uuid
    assert ways.keys() == {k for k, r in nodes.items() if r.status != "cycle"}
    for (s, u), way in ways.items():
        path = [x for _, x in sorted(way.items())]
        assert len(path) == nodes[s, u].depth + 1 and path[0] == nodes[s, u].root and path[-1] == u
        assert all(nodes[s, b].parent_uuid == a for a, b in zip(path, path[1:]))
    assert max(map(len, ways.values())) > 3 * hierarchy.ANCHOR
    pairs = {(r.session_id, r.uuid, r.descendant_uuid) for r in corpus_queries.p4_descendants(spark, sf).collect()}
    for s, u, _ in pairs:
        below[s, u] += 1
    assert all(below[k] == r.n_descendants for k, r in nodes.items() if r.status != "cycle")
    assert all(r.parent_uuid == u or (r.session_id, r.parent_uuid, u) in pairs or (r.session_id, u, r.parent_uuid) in pairs for (s, u), r in nodes.items() if r.status == "cycle")


# --- nested records

def scalars_and_paths(v, path=""):
    for k, x in v.items() if isinstance(v, dict) else enumerate(v):
        q = (f"{path}.{k}" if path else k) if isinstance(v, dict) else f"{path}[{k}]"
        if isinstance(x, dict) and isinstance(v, list):
            yield q
        if isinstance(x, (dict, list)):
            yield from scalars_and_paths(x, q)


def test_nested_round_trip_and_paths(spark, sf):
    lines = spark.read.parquet(f"{sf}/raw_lines.parquet")
    contents = {r.node_id: r.content for r in nested.store(lines).collect()}
    roots = {(r.source, r.line_no): r.node_id for r in nested.occurrences(lines).filter("obj_path = ''").collect()}
    want, n = set(), 0
    for r in lines.collect():
        record = parse_object(r.raw_json)
        if record is None:
            assert (r.source, r.line_no) not in roots
            continue
        n += 1
        assert json.loads(nested.rebuild(roots[r.source, r.line_no], contents)) == record
        want |= {(r.source, r.line_no, p) for p in scalars_and_paths(record)}
    assert n and {tuple(r) for r in nested.array_objects(nested.occurrences(lines)).collect()} == want


def test_nested_edges(spark):
    deep = '{"a":' + "[" * 5000 + '{"x":1}' + "]" * 5000 + "}"
    rows = [("f", 0, None), ("f", 1, ""), ("f", 2, "[1]"), ("f", 3, '{"a":[{"b":'), ("f", 4, '{"a":[{"b":1},{"b":1}],"c":{"d":[[{"e":[{}]}]]}}'), ("f", 5, '{"a":NaN}'), ("f", 6, deep), ("f", 7, '{"k\\ud800":[{"v":"\\ud800"}]}'), ("f", 4, '{"a":[{"b":1},{"b":1}],"c":{"d":[[{"e":[{}]}]]}}')]
    lines = spark.createDataFrame(rows, "source string, line_no long, raw_json string").withColumn("node_id", F.lit(1))
    got = sorted((r.line_no, r.obj_path) for r in nested.array_objects(nested.occurrences(lines)).collect() if r.line_no != 6)
    assert got == [(4, "a[0]"), (4, "a[1]"), (4, "c.d[0][0]"), (4, "c.d[0][0].e[0]"), (7, "k�[0]")]
    assert nested.array_objects(nested.occurrences(lines)).filter("line_no = 6").count() == 1
    same = nested.occurrences(lines).filter("line_no = 4 and obj_path in ('a[0]', 'a[1]')").select("node_id").distinct().count()
    assert same == 1


def test_children_are_the_whole_bridge(spark):
    lines = spark.createDataFrame([("f", 1, '{"m":{"c":[1,[{"x":{}}]]}}'), ("f", 2, '{"a":1}'), ("f", 3, "no")], "source string, line_no long, raw_json string")
    rows = nested.child_rows(nested.occurrences(lines)).collect()
    by = {(r.line_no, r.obj_path): r for r in rows}
    assert len(rows) == len(by) and set(by) == {(1, ""), (1, "m"), (1, "m.c"), (1, "m.c[1]"), (1, "m.c[1][0]"), (1, "m.c[1][0].x"), (2, "")}
    for r in rows:
        assert r.obj_path == "" or by[r.line_no, r.parent_path].node_id == r.parent_id and by[r.line_no, r.object_path].node_id == r.object_id
    deep = by[1, "m.c[1][0]"]
    assert (deep.ordinal, deep.key, deep.parent_path, deep.object_path, by[1, "m.c"].key, by[1, ""].object_id) == (0, None, "m.c[1]", "m", "c", None)


def test_deep_parser_agrees():
    for text in ('{"a":[1,2.5,-3e2,true,null,"x\\n\\u00e9"],"b":{},"c":[],"d":{"e":[[],{}]}}', ' { "a" : 1 } ', '{"a":1,"a":2}'):
        assert _parse_deep(text.strip()) == json.loads(text)
    for text in ('{"a":}', '{"a":1', "{'a':1}", '{"a":1}x', '{"a":01}'):
        with pytest.raises(ValueError):
            _parse_deep(text)


# --- drift

def test_drift_changes(spark):
    def line(v, i, **k):
        return json.dumps({"version": v, "uuid": f"u{i}", **k})

    rows = []
    for i in range(30):
        rows.append(("a", i, line("1.9", i, cwd=f"/srv/p{i % 3}", kind="user" if i % 2 else "assistant", n=i, old=True, ts=f"2026-01-{i % 28 + 1:02d}", items=[{"v": "s"}], input={"z": 1})))
        rows.append(("b", i, line("1.10", i, workdir=f"/srv/p{i % 3}", type="user" if i % 2 else "assistant", n=str(i), ts=f"2026-01-{i % 28 + 1:02d}", items=[{"v": {"deep": 1}}], chain=[{"a": 1}], input={"y": 1})))
    rows += [("b", 31, '{"extra": 1}'), ("b", 32, "not json"), ("c", 0, '{"unversioned": 1}'), ("b", -1, '{"extra": null, "first": 1}')]
    lines = spark.createDataFrame(rows, "source string, line_no long, raw_json string")
    got = {tuple(r) for r in drift.find_changes(lines).collect()}
    v = "1.10"
    assert got == {
        (v, "renamed", "cwd", "workdir"), (v, "renamed", "kind", "type"), (v, "retyped", "n", ""), (v, "removed", "old", ""), (v, "retyped", "items[].v", ""),
        (v, "added", "chain", ""), (v, "added", "extra", ""), (v, "added", "first", ""),
    }
    u = {(r.source, r.line_no): r for r in drift.unify(lines).collect()}
    assert u["a", 4].workdir == "/srv/p1" and u["a", 4].n == "4" and u["a", 4].type == "assistant" and u["a", 4].old is True
    assert json.loads(u["a", 4].cast_failed["items[].v"]) == ["s"] and u["b", 4]["items"][0].v.deep == 1.0 and u["b", 4].cast_failed == {}
    assert json.loads(u["c", 0].cast_failed["unversioned"]) == [1] and u["b", -1].extra is None and len(u) == 63
    assert drift.find_changes(lines.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3, 30])
def test_renames_are_decided_by_flooding(n):
    """A container without likeness is found by its children; what is a plain swap of unlike fields is not a rename."""
    def side(name, kids):
        return {"id": frozenset({"string"}), name: frozenset({"object"}), **{f"{name}.{k}": frozenset({"string"}) for k in kids}}

    words = [f"{'abcdefghij'[i % 10] * 3}{'klm'[i // 10] * 3}" for i in range(n)]
    a, b = side("meta", [f"{w}_name" for w in words]), side("zq", [f"{w}Name" for w in words])
    like = lambda x, y: drift.name_likeness(drift.name_of(x), drift.name_of(y)) if "." in x else 0.0
    assert drift.correspondences(a, b, like) == {"meta": "zq"} | {f"meta.{w}_name": f"zq.{w}Name" for w in words}
    assert drift.correspondences(side("meta", words), side("zq", [f"{i}" for i in range(n)]), lambda x, y: 0.0) == {}
    assert drift.correspondences({"id": frozenset({"string"}), "u": frozenset({"string"})}, {"id": frozenset({"string"}), "v": frozenset({"string"})}, lambda x, y: 0.1) == {}


def test_unified_nested_renames_and_clashing_names(spark):
    old = [json.dumps({"version": "1.0", "m": {"usage": {"in_tokens": i, "out": i}, "items": [{"is_error": i % 2 == 0, "t": f"x{i}"}]}, "Source": f"s{i}", "a": "A", "A": 1}) for i in range(20)]
    new = [json.dumps({"version": "2.0", "m": {"usage": {"input_tokens": str(i), "out": i}, "items": [{"isError": i % 2 == 0, "t": f"x{i}"}]}, "Source": f"s{i}", "a": "A", "A": 1}) for i in range(20)]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(old + new)] + [("f", 99, '{"m": {"usage": {"input_tokens": 3}}}')], "source string, line_no long, raw_json string")
    u = drift.unify(lines)
    assert len({c.lower() for c in u.columns}) == len(u.columns) and "Source_2" in u.columns
    rows = {r.line_no: r for r in u.collect()}
    assert {c for c in rows[3].m["items"][0].asDict()} == {"isError", "t"} and rows[3].m["items"][0].isError is False and rows[4].m["items"][0].isError is True
    assert rows[99].m.usage.input_tokens == 3 or rows[99].m.usage.input_tokens == "3"
    assert drift.unify(lines.limit(0)).count() == 0


def test_unified_query_drops_no_value(spark, sf):
    """Every value that isn't null is in a column or among what failed."""
    def count(v):
        return sum(map(count, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else v is not None

    def inside(v):
        return 0 if v is None else sum(map(inside, v)) if isinstance(v, (tuple, list)) else 1

    opaque = lambda v: {k: 1 if k in drift.OPAQUE and x is not None else opaque(x) for k, x in v.items()} if isinstance(v, dict) else [opaque(x) for x in v] if isinstance(v, list) else v
    want = {(r.source, r.line_no): parse_object(r.raw_json) for r in spark.read.parquet(f"{sf}/raw_lines.parquet").collect()}
    for r in corpus_queries.p5_unified(spark, sf).collect():
        record = want[r.source, r.line_no]
        cells = [v for k, v in r.asDict().items() if k not in ("source", "line_no", "cast_failed")]
        texts = sum(count(opaque(json.loads(v))) - 1 for v in cells if isinstance(v, str) and v[:1] in "[{" and isinstance(record.get("content"), (dict, list)))
        lost = sum(count(json.loads(v)) for v in r.cast_failed.values())
        assert sum(map(inside, cells)) + lost + texts >= count(opaque(record)) - sum(1 for v in record.values() if v in ({}, []))


def test_versions_carry_over_blocks(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.choice(["1", "2", None, None, None])) for s in "ab" for i in range(60)] + [("c", i, None) for i in range(3)] + [("d", 5, "9"), ("d", 1, None)]
    got = {(r.source, r.line_no): r.writer_version for r in drift.fill_versions(spark.createDataFrame(rows, "source string, line_no long, version string"), block=7).collect()}
    for s in "abcd":
        own = sorted((i, v) for t, i, v in rows if t == s)
        for i, _ in own:
            before = [v for j, v in own if j <= i and v]
            after = [v for j, v in own if j > i and v]
            assert got[s, i] == (before[-1] if before else after[0] if after else None)


def test_store_combines_equal_containers_and_values_are_whole(spark, monkeypatch):
    monkeypatch.setattr(nested, "REMEMBERED", 3)
    fake = "#" + "0" * 32
    records = [{"a": [{"x": 1, "t": f",{fake},"}, {"x": 1, "t": f",{fake},"}, [None, True]], "b": {"x": 1.5, "c": {}}}, {"b": {"x": 1.5, "c": {}}, "a": []}]
    lines = spark.createDataFrame([("f", i, json.dumps(r)) for i, r in enumerate(records)] + [("f", 5, "broken"), ("f", 6, None)], "source string, line_no long, raw_json string")
    store = {r.node_id: r for r in nested.store(lines).collect()}
    bridge = nested.occurrences(lines).collect()
    assert {k: v.n_occurrences for k, v in store.items()} == collections.Counter(r.node_id for r in bridge)
    roots = {r.line_no: r.node_id for r in bridge if r.obj_path == ""}
    for i, r in enumerate(records):
        assert json.loads(nested.rebuild(roots[i], {k: v.content for k, v in store.items()})) == r
    got = {(r.line_no, r.obj_path, r.key, r.ordinal, r.type, r.value) for r in nested.values(lines).collect()}
    assert (0, "a[2]", None, 0, "null", None) in got and (1, "b", "x", None, "number", "1.5") in got and (0, "a[1]", "t", None, "string", f",{fake},") in got and len(got) == 8
