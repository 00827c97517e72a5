"""Record-level JSON operators: canonical bytes, estimated length, masking, image elision, hashing, re-chaining.

They work on one record at a time and run in Arrow batches (`apply_records`). Canonical JSON has sorted keys, no spaces
and UTF-8 text; of equal keys the last counts. Unknown fields are kept.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .jsonwalk import clean, parse_object

#: An image weighs at most so many characters; sizes beyond which masking cuts, and what it keeps (fixed values).
IMAGE, RESULT, ERROR, INPUT, INPUT_CUT, TEAMMATE_CUT, UI_COPY = 6400, 500, 2000, 2000, 500, 4000, 2000
#: What stands for a notification, and how delivered messages begin (fixed values).
NOTIFICATION_ELIDED = "[recompact: task notification elided]"
TEAMMATE, NOTIFICATION = "Another Claude session sent a message:\n<teammate-message ", "<task-notification>"
KEPT, MASKED, DROPPED = "kept", "masked", "dropped"


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def n_bytes(value: object) -> int:
    return len(clean(canonical(value)).encode())


def _image_data(v: object) -> str | None:
    if isinstance(v, dict) and v.get("type") == "image" and isinstance(v.get("source"), dict) and isinstance(v["source"].get("data"), str):
        return v["source"]["data"]
    return None


def image_excess(value: object) -> int:
    """Characters by which the images anywhere in a value exceed their weight."""
    total, stack = 0, [value]
    while stack:
        v = stack.pop()
        data = _image_data(v)
        if data is not None:
            total += max(0, len(data.encode()) - IMAGE)
        elif isinstance(v, dict):
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)
    return total


def est_len(record: dict) -> int:
    """Canonical length in bytes, with each image at its weight."""
    return max(0, n_bytes(record) - image_excess(record))


def fnv1a64(data: bytes, state: int = 0xCBF29CE484222325) -> int:
    for b in data:
        state = ((state ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return state


def content_hash(records: list[dict]) -> str:
    """Order-sensitive hash of types and message contents of a unit's records, as 16 hexadecimal digits."""
    state = 0xCBF29CE484222325
    for r in records:
        body = r.get("message", {}).get("content") if isinstance(r.get("message"), dict) else None
        state = fnv1a64(f"{r.get('type') or ''}\x1f{clean(canonical(body))}\x1e".encode(), state)
    return f"{state:016x}"


def head_tail(s: str, n: int, ratio: float) -> str:
    import numpy as np

    if len(s) <= n:
        return s
    head = int(np.float32(n) * np.float32(ratio))
    return f"{s[:head]}\n…[{len(s) - n} chars elided]…\n{s[len(s) - (n - head):]}"


def _result_text(block: dict) -> str:
    body = block.get("content")
    if isinstance(body, str):
        return body
    return "\n".join(x["text"] for x in body if isinstance(x, dict) and isinstance(x.get("text"), str)) if isinstance(body, list) else ""


def selector(record: dict) -> str:
    """What a marker names a record by: the first eight bytes of its uuid, or all of it where these part a character."""
    uid = record.get("uuid") if isinstance(record.get("uuid"), str) else ""
    head = clean(uid).encode()[:8]
    try:
        return head.decode() if len(clean(uid).encode()) >= 8 else uid
    except UnicodeDecodeError:
        return uid


def _marker(data: str, uid: str) -> dict:
    return {"type": "text", "text": f"[recompact: image elided (~{len(clean(data).encode()) // 1024} KB); rehydrate {uid} to recover it]"}


def _big_image(b: object) -> str | None:
    data = _image_data(b)
    return data if data is not None and len(data.encode()) > IMAGE else None


def _mask_block(b: object, uid: str) -> tuple[object, bool] | None:
    """The masked block and whether it changed; None to drop it."""
    if not isinstance(b, dict):
        return b, False
    kind = b.get("type")
    if kind == "thinking" and not (b["thinking"] if isinstance(b.get("thinking"), str) else "").strip():
        return None
    if kind == "tool_result":
        text, is_error = _result_text(b), b.get("is_error") is True
        body, had_image = b.get("content"), False
        if isinstance(body, list):
            parts = []
            for x in body:
                data = _big_image(x)
                had_image |= data is not None
                parts.append(_marker(data, uid) if data is not None else x)
            if had_image:
                b = {**b, "content": parts}
                text = _result_text(b)
        limit = ERROR if is_error else RESULT
        if len(text) <= limit:
            return b, had_image
        new = head_tail(text, ERROR, 0.5) if is_error else f"[recompact: elided {len(text)}-char result; rehydrate {uid} to recover it]"
        return {**b, "content": new}, True
    if kind == "tool_use" and isinstance(b.get("input"), dict):
        cut = {k: head_tail(v, INPUT_CUT, 0.5) for k, v in b["input"].items() if isinstance(v, str) and len(v) > INPUT}
        return ({**b, "input": b["input"] | cut}, True) if cut else (b, False)
    data = _big_image(b)
    return (_marker(data, uid), True) if data is not None else (b, False)


def delivered_kind(record: dict) -> str | None:
    """'teammate_message' or 'task_notification' for a user record that was delivered; an earlier masking's marker says so first."""
    if record.get("type") != "user" or record.get("isMeta") is True or record.get("isCompactSummary") is True:
        return None
    marker = record.get("recompactDelivered")
    if isinstance(marker, str):
        return marker if marker == "task_notification" else "teammate_message"
    text = first_text(record)
    if "sourceToolAssistantUUID" in record or text is None:
        return None
    return "teammate_message" if text.startswith(TEAMMATE) else "task_notification" if text.startswith(NOTIFICATION) else None


def first_text(record: dict) -> str | None:
    """String content, else the text of the first text block that has one."""
    body = record["message"].get("content") if isinstance(record.get("message"), dict) else None
    if isinstance(body, str):
        return body
    return next((b["text"] for b in body if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str)), None) if isinstance(body, list) else None


def mask_record(record: dict) -> tuple[str, dict | None]:
    """(kept, masked or dropped; the record): large results, inputs and images cut, empty thoughts dropped, delivered texts cut."""
    uid = selector(record)
    message = record.get("message") if isinstance(record.get("message"), dict) else None
    out, changed = dict(record), False
    body = message.get("content") if message else None
    if isinstance(body, list):
        parts = []
        for b in body:
            done = _mask_block(b, uid)
            if done is None:
                changed = True
                continue
            parts.append(done[0])
            changed |= done[1]
        if not parts:
            return DROPPED, None
        out["message"] = {**message, "content": parts}
    if message and (kind := delivered_kind(record)):
        text = first_text(record) or ""
        new = NOTIFICATION_ELIDED if kind == "task_notification" else head_tail(text, TEAMMATE_CUT, 0.6) if len(text) > TEAMMATE_CUT else None
        if new is not None:
            out["message"], out["recompactDelivered"], changed = {**message, "content": new}, kind, True
    ui = record.get("toolUseResult")
    if "toolUseResult" in record and n_bytes(ui) > UI_COPY:
        out["toolUseResult"], changed = {"recompactElided": True, "chars": n_bytes(ui)}, True
    if not changed:
        return KEPT, record
    return MASKED, out | {"recompactMasked": True}


def elide_images(record: dict) -> dict | None:
    """The record with large images replaced by markers, and their number; None if it has none."""
    message = record.get("message") if isinstance(record.get("message"), dict) else {}
    body = message.get("content")
    if not isinstance(body, list):
        return None
    parts = [_marker(d, selector(record)) if (d := _big_image(b)) is not None else b for b in body]
    n = sum(_big_image(b) is not None for b in body)
    return {**record, "message": {**message, "content": parts}, "recompactImagesElided": n} if n else None


def rewrite_envelope(record: dict, session_id: str, parent: str | None) -> dict:
    """A record of the output: its session id, its parent, and no usage figures."""
    out = {k: v for k, v in record.items()}
    if "sessionId" in out:
        out["sessionId"] = session_id
    if isinstance(out.get("message"), dict):
        out["message"] = {k: v for k, v in out["message"].items() if k != "usage"}
    if out.get("uuid"):
        out["parentUuid"] = parent
    return out


def apply_records(df: DataFrame, fn: Callable[[dict], tuple], schema: str, keys: tuple[str, ...] = ("source", "line_no"), raw: str = "raw_json") -> DataFrame:
    """fn over the records of df in Arrow batches: keys and the values fn returns, as schema names them."""
    from .fragments import _schema

    out = _schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for *k, text in zip(*(c.to_pylist() for c in b.columns)):
                record = parse_object(text)
                if record is not None and (done := fn(record)) is not None:
                    rows.append((*k, *done))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return df.select(*keys, raw).mapInArrow(run, schema)
