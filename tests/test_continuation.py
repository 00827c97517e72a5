"""Continuing sessions, and the way back through generations."""

import json

from threadmill.operators import continuation, provenance
from threadmill.sources import transcripts

from test_sessions import transcript


def test_small_functions():
    assert continuation.extract_json_object('Sure: {"a": {"b": 1}} done') == {"a": {"b": 1}}
    assert continuation.extract_json_object("none") is None and continuation.extract_json_object("} {") is None
    assert continuation.lookup_summary({"UNIT 3": "x", "4": 5}, "3") == "x" and continuation.lookup_summary({"4": 5}, "4") is None


def test_continue(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text("\n".join(json.dumps(r) for r in transcript()))
    read = lambda: transcripts.scan_lines(spark, str(tmp_path))
    assert continuation.continue_session(read, 10**6).status == "below threshold"
    done = continuation.continue_session(read, 1000)
    assert done.status == "compacted" and done.after * 2 < done.before


def generations(make):
    row = lambda s, n, u, p=None, **k: dict(session_id=s, line_no=n, uuid=u, is_synthetic=p is not None, provenance=p, ingested_at=n, **k)
    return make.records([
        row("g0", 0, "r1aaaaaa-1"), row("g0", 1, "r2"), row("g1", 0, "s1", ("f", "g0", "0", ["R1aaaaaa-1", "r2", "lost"])), row("g1", 1, "r2", is_masked=True), row("g1", 2, "m1"), row("g2", 0, "s2", ("f", "g1", "0", ["s1", "m1", "r2"])),
        row("g2", 1, "s3", ("f", "nowhere", "1.1", ["q"])), row("g2", 2, "s4", ("f", "g1", "0", ["s1"])), row("c1", 0, "x", ("f", "c2", "0", ["y"])), row("c2", 0, "y", ("f", "c1", "0", ["x"])),
    ])


def test_generations(make):
    c = provenance.copies(generations(make))
    got = {(r.session_id, r.line_no, r.from_session, r.from_line, r.uuid, r.is_ground) for r in provenance.expand(c).collect()}
    assert {x for x in got if x[0] in ("g1", "g2")} == {
        ("g1", 0, "g0", 0, "r1aaaaaa-1", True), ("g1", 0, "g0", 1, "r2", True), ("g2", 0, "g0", 0, "r1aaaaaa-1", True), ("g2", 0, "g0", 1, "r2", True), ("g2", 0, "g1", 2, "m1", True),
        ("g2", 1, "g2", 1, "s3", False), ("g2", 2, "g0", 0, "r1aaaaaa-1", True), ("g2", 2, "g0", 1, "r2", True),
    }  # the masked copy of r2 gives way to the raw one, a summary whose source is gone stands for itself
    files = {(r.session_id, r.source): r.distance for r in provenance.provenance_files(c).collect()}
    assert files == {("g2", "g1"): 1, ("g2", "g0"): 2, ("g1", "g0"): 1, ("c1", "c2"): 1, ("c2", "c1"): 1}
    truth = {(r.session_id, r.uuid): (r.from_session, r.is_ground) for r in provenance.ground_truth(c).collect()}
    assert truth["g1", "r2"] == ("g0", True) and truth["g2", "s2"] == ("g2", False)


def test_rehydrate_selectors(spark, make):
    c = provenance.copies(generations(make))
    sel = ["0", "1.1", "2", "1", "7", "r1aaaaaa", "r1aaaaaaX", "12345678", "zz"]
    got = {}
    for r in provenance.rehydrate_select(c, spark.createDataFrame([("G2", x) for x in sel], "session_id string, selector string")).collect():
        got.setdefault(r.selector, []).append((r.how, r.from_session, r.uuid))
    assert sorted(got["0"]) == [("part", "g0", "r1aaaaaa-1"), ("part", "g0", "r2"), ("part", "g1", "m1")]
    assert got["1.1"] == [("lost", "g2", "s3")] and got["1"] == [("lost", "g2", "s3")]
    assert sorted(got["2"]) == [("ordinal", "g0", "r1aaaaaa-1"), ("ordinal", "g0", "r2")] and got["7"] == [("no ordinal", None, None)]
    assert got["r1aaaaaa"] == [("unknown", None, None)]  # no digits of a uuid
    assert got["12345678"] == got["zz"] == [("unknown", None, None)]


def test_lineage_of_a_thousand_hops(spark):
    row = lambda c, p, at, m, pm: (c, p, at, m, pm)
    chain = [row("n0000", None, 0, 0, None)] + [row(f"n{i:04d}", f"n{i - 1:04d}", i, i, i - 1) for i in range(1, 1500)]
    rows = chain + [row("a", "b", 1, 5, 5), row("b", "a", 2, 5, 5), row("old", "n0000", 9, -1, 0), row("k", "gone", 1, 1, None)]
    got = {r.start: r.latest for r in provenance.lineage_latest(spark.createDataFrame(rows, "child string, parent string, at long, mtime long, p_mtime long")).collect()}
    assert got["n0000"] == "n1000" and got["n0700"] == "n1499" and got["old"] == "old" and got["a"] == "a" and got["k"] == "k" and len(got) == len(rows)


def test_epochs(make):
    m = lambda *b: json.dumps({"content": list(b)})
    row = lambda s, n, u, p=None, **k: dict(session_id=s, line_no=n, uuid=u, is_synthetic=p is not None, provenance=p, ingested_at=n, rec_type=k.pop("rec_type", "assistant"), content_kind="array", **k)
    records = make.records([
        row("g0", 0, "a", message=m({"type": "text", "text": "hello"})), row("g0", 1, "b", rec_type="user", message=m({"type": "tool_result"})), row("g1", 0, "s1", ("f", "g0", "0", ["a", "b"]), message=m()),
        row("g2", 0, "s2", ("f", "g1", "0", ["s1"]), message=m()), row("g2", 1, "s3", ("f", "g1", "0", ["nothing"]), message=m()), row("g3", 0, "s4", ("f", "g2", "0", ["s2", "s3"]), message=m()),
    ])
    blocks = make.blocks([dict(session_id="g0", line_no=0, pos=0, block_type="text", text="hello"), dict(session_id="g0", line_no=1, pos=0, block_type="tool_result", tool_use_id="t", result_text="x" * 200)])
    got = {}
    for r in provenance.epoch_lines(records, blocks).orderBy("way").collect():
        got.setdefault((r.session_id, r.line_no), []).append(r.line)
    assert set(got) == {("g1", 0), ("g2", 0)}  # what rests on a hop that leads nowhere has none
    assert got["g2", 0] == ["ASSISTANT: hello", "RESULT[ok,200]: " + "x" * 120 + "…[+80 chars]"]
