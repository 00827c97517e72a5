"""Streams over files: kept orphan counts equal the batch result under any order of changes, repeated batches change nothing."""

import random

import pytest

from threadmill.operators import references, sessions
from threadmill.streaming import growing


def test_orphan_counts_from_a_stream(spark, make, tmp_path):
    rows = [dict(session_id="s", line_no=i, uuid=f"u{i}", parent_uuid=f"u{i - 1}" if i else None, ingested_at=i) for i in range(30)]
    rows.append(dict(session_id="s", line_no=40, uuid="x", parent_uuid="nowhere", ingested_at=40))
    records = make.records(rows)
    src = str(tmp_path / "in")
    records.repartition(3).write.parquet(src)
    state = growing.OrphanCounts(spark, str(tmp_path / "state"))
    fold = growing.keep_orphan_counts(state)
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.writeStream.foreachBatch(fold).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.ref_id for r in references.orphan_keys(state.counts()).collect()] == ["nowhere"]
    fold(records, 0)
    assert state.counts().agg({"refs": "sum"}).first()[0] == 30


@pytest.mark.parametrize("seed", [1, 2])
def test_orphan_counts_in_any_order_equal_the_batch(spark, make, tmp_path, seed):
    """Records, later deliveries of them, blocks and removals in any order; parts merged on the way."""
    rng = random.Random(seed)
    records, blocks, removed = [], [], []
    for i in range(24):
        r = dict(session_id=rng.choice(["s", "S "]), line_no=i, uuid=f"u{rng.randrange(16)}", parent_uuid=rng.choice([None, f"u{rng.randrange(20)}"]), ingested_at=rng.randrange(50), provenance=("x", "s", "0", [f"U{rng.randrange(20)}"]) if rng.random() < 0.3 else None)
        records += [r] + [{**r, "ingested_at": rng.randrange(90), "parent_uuid": "u3"}] * (rng.random() < 0.4)
        blocks += [dict(session_id="s", line_no=i, pos=0, **{rng.choice(["tool_id", "tool_use_id"]): f"t{rng.randrange(6)}"})] * rng.choice([0, 1, 2])
    removed = [dict(session_id="s", uuid=f"u{i}", removed_at=60) for i in rng.sample(range(16), 4)]
    changes = [("records", r) for r in records] + [("blocks", b) for b in blocks] + [("removed", g) for g in removed]
    rng.shuffle(changes)
    state = growing.OrphanCounts(spark, str(tmp_path / "state"))
    state.log.buckets = 4
    makers = {"records": make.records, "blocks": make.blocks, "removed": make.removed}
    n = 4
    for k in range(n):
        part = changes[k::n]
        state.apply(k, **{w: m([c for x, c in part if x == w]) for w, m in makers.items()})
        if k == 1:
            state.merge()
    state.apply(n, records=make.records(records[:5]))  # delivered once more
    lines = references.full_lines(references.record_lines(make.records(records)), references.tool_lines(make.blocks(blocks)), references.removals(make.removed(removed)))
    want = references.count_state(references.deltas(references.contributions(lines)))
    key = lambda s: sorted((r.domain, r.session_id, r.ref_id, str(r.at), r.refs, r.exists) for r in s.collect())
    assert key(state.counts()) == key(want)
    keys = lambda s: sorted((r.domain, r.ref_id, str(r.first_exists), str(r.first_ref)) for r in references.orphan_keys(s).collect())
    assert keys(state.counts()) == keys(want) != []


def test_changed_sessions_are_rolled_up(spark, make, tmp_path):
    records = make.records([dict(session_id=s, line_no=i, uuid=f"{s}{i}", rec_type="user", content_kind="string", message='{"content":"x"}', ingested_at=i) for s in "ab" for i in range(3)])
    run = growing.rollup_changed(str(tmp_path / "out"), sessions.session_scan, lambda: records)
    run(records.filter("session_id = 'a' and line_no = 2"), 7)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.session_id, r.n_records, r.batch) for r in got] == [("a", 3, 7)]
