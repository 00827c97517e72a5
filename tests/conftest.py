import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from threadmill.session import build_session

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


RECORDS = (
    "session_id string, source string, line_no long, rec_type string, uuid string, parent_uuid string, content_kind string, is_meta boolean, is_compact_summary boolean, "
    "has_source_tool boolean, is_synthetic boolean, is_masked boolean, is_ledger boolean, is_preamble boolean, leaf_uuid string, last_prompt string, record_ts string, writer_version string, "
    "message string, provenance struct<source:string,source_session_id:string,part:string,covered_uuids:array<string>>, ingested_at timestamp_ntz"
)
BLOCKS = (
    "session_id string, line_no long, pos int, block_type string, text string, tool_id string, tool_name string, tool_input string, tool_use_id string, is_error boolean, result_text string, image_len long"
)
REMOVED = "session_id string, uuid string, removed_at timestamp_ntz"


@pytest.fixture(scope="session")
def make(spark):
    """make.records([...dicts]), make.blocks, make.removed: small tables with nulls where a row says nothing."""
    import datetime as dt

    from pyspark.sql.types import _parse_datatype_string

    def build(schema):
        kind = _parse_datatype_string(schema)
        names = kind.fieldNames()

        def go(rows):
            t0 = dt.datetime(2026, 1, 1)
            out = []
            for r in rows:
                r = dict(r)
                for k in ("ingested_at", "removed_at"):
                    if isinstance(r.get(k), int):
                        r[k] = t0 + dt.timedelta(seconds=r[k])
                out.append(tuple(r.get(n) for n in names))
            return spark.createDataFrame(out, kind)

        return go

    class Make:
        records, blocks, removed = map(staticmethod, (build(RECORDS), build(BLOCKS), build(REMOVED)))

    return Make
