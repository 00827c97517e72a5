"""Column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters taken off the ends of ids (fixed values).
BLANKS = " \t\r\n\f\x0b 　"
TEXT_BLOCKS = "array<struct<type:string,text:string>>"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_id(c: Column | str) -> Column:
    """An id trimmed and in lower case; blank becomes null."""
    x = F.lower(F.btrim(as_col(c), F.lit(BLANKS)))
    return F.when(x != "", x)


def flag(c: Column | str) -> Column:
    """A boolean whose null means false."""
    return F.coalesce(as_col(c), F.lit(False))


def message_text(message: Column | str, kind: Column | str) -> Column:
    """The text of a message: its string content, else its text blocks joined by newlines; null where there is none."""
    body = F.get_json_object(as_col(message), "$.content")
    parts = F.filter(F.from_json(body, TEXT_BLOCKS), lambda b: (b["type"] == "text") & b["text"].isNotNull())
    return (
        F.when(as_col(kind) == "string", body)
        .when(as_col(kind) == "array", F.array_join(F.transform(parts, lambda b: b["text"]), "\n"))
    )
