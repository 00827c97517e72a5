"""Scalar functions of the transcript queries as column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import as_col

#: First words by which a turn corrects what went before (fixed values).
CORRECTIONS = ("no", "actually", "wait", "instead", "revert", "don't", "dont", "stop", "undo", "wrong")


def truncate(c: Column | str, n: int) -> Column:
    """The first n characters, with a note of how many were left out."""
    c = as_col(c)
    return F.when(F.char_length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("…[+"), (F.char_length(c) - n).cast("string"), F.lit(" chars]")))


def truncate_head_tail(c: Column | str, n: int, ratio: float) -> Column:
    """n characters from both ends, a ratio of them (in single precision) from the front, and how many were left out."""
    c = as_col(c)
    head = F.floor(F.lit(n).cast("float") * F.lit(ratio).cast("float")).cast("int")
    return F.when(F.char_length(c) <= n, c).otherwise(
        F.concat(F.left(c, head), F.lit("\n…["), (F.char_length(c) - n).cast("string"), F.lit(" chars elided]…\n"), F.right(c, F.lit(n) - head))
    )


def corrects(text: Column | str) -> Column:
    """Whether a turn's first word says that it corrects."""
    return F.coalesce(F.lower(F.regexp_extract(as_col(text), r"(?U)^\s*([\p{L}\p{N}']*)", 1)).isin(*CORRECTIONS), F.lit(False))


def is_blank(c: Column | str) -> Column:
    return ~F.coalesce(as_col(c), F.lit("")).rlike(r"(?U)\S")


def id_matches(c: Column | str, selector: str) -> Column:
    """Equal to the selector, or beginning with it if it has eight characters or more."""
    c = as_col(c)
    return (c == selector) | (c.startswith(selector) if len(selector) >= 8 else F.lit(False))


def munge_path(path: str) -> str:
    """A project folder's name: every character but ASCII letters and digits becomes a hyphen."""
    return "".join(ch if ch.isascii() and ch.isalnum() else "-" for ch in path)
