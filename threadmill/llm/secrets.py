"""Credentials embedded in code and configuration: found corpus-wide, placed by line, redacted.

1. `candidates`: every text is read once; literals in a credential's place (assigned to a credential's name, in an
   Authorization header, in a URL's login, as an argument, in a remark, a private key with its first lines) are taken
   with what their place and form say.
2. `confirmed`: the literals are indexed over the corpus with the number of their owners (sessions). Values that many
   owners share are placeholders; rare values of a credential's structure are confirmed. A login that stands
   percent-encoded in a URL or in base64 in a header also confirms its plain password.
3. `spans`: every text is read again for the confirmed literals, so a credential is found wherever it stands, in one way
   for any number of literals. Two bitmaps of bounded size (literals' first characters, whole literals) are broadcast; a
   place of a text whose characters are in both for some literal's length goes on, and is joined with the literals
   themselves, so bitmaps decide nothing. With more literals than bitmaps are made for, more places go on, none less.

Defined results: null and empty texts have no rows; equal blocks give the same rows once; several credentials on a line
give one row; a literal that spans lines counts where it begins; texts are read whole; a JSON input that is no object
has no strings; a literal of more than KEYED characters is known by its first KEYED ones.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import norm_id
from ..functions.fragments import map_fragments
from ..functions.jsonwalk import clean
from ..session import cut_lineage

#: A literal with more owners than this is a placeholder; characters by which a literal is known, least and most.
MAX_OWNERS, LEAST, KEYED = 5, 6, 1024
#: Bits of a bitmap at most (as a power of two: 16 MB each), bits per literal, characters of a text looked at together.
BITS, PER_LITERAL, CHUNK = 27, 32, 400_000

#: Parts of names that hold credentials, parts that say a name doesn't, values that stand in for one (fixed values).
NAME = r"pass(?:word|wd|phrase|code)?|passwd|pwd|pw|secret|token|tok|creds?|credentials?|auth(?:orization|_token)?|api[-_. ]?key|key|x-access|login"
NOT_NAME = re.compile(r"(?i)public|pub_?key|(?:file|path|dir|field|name|ref|url|uri|ttl|count|length|len|size|mode|policy|type|hash|digest|sha\d*|checksum|fingerprint|expir\w*|id|ids|header|prompt|label|regex|pattern|limit|index|version|scope)$")
STAND_IN = re.compile(
    r"(?i)^(?:[x*.•#_-]+|<.*>?|\{\{.*|\$.*|%\(.*|%[A-Z_]+%?|\[.*|your[-_ ]?.*|.*(?:change[-_]?me|replace[-_]?me|redacted|example|placeholder|dummy|sample|insert[-_]|todo|fixme|masked|hidden|not[-_]?set).*"
    r"|none|null|nil|undefined|true|false|empty|test|secret|password|token|admin|root|default|required|n/?a)$"
)
_REFERENCE = re.compile(r"^(?:[A-Za-z_]+\d*|[A-Z0-9_]+)(?:\.[A-Za-z_]+\d*)+$|^(?:process\.env|os\.environ|env|vault|secrets?|config|settings|self|this|req)[.\[(:]|^(?:/?[a-z_.-]+/)+[a-z_.-]*$")
_CALL = re.compile(r"^[A-Za-z_$][\w.$]*\([^()]*\)$")

_HOT = re.compile(r"(?i)pass|pwd|pw\b|secret|tok|key|auth|cred|login|bearer|access|://[^\s/@]*:|-u ?\S+:|--user|-p'")
_VALUE = r"""(?P<q>\\?["'`])(?P<v>(?:(?!(?P=q)).)+)(?P=q)|(?P<b>[^\s"'`,;)}\]<>]+)"""
_ASSIGN = re.compile(
    rf"""(?ix)(?P<name>[\w.$-]*?(?:{NAME})) \\?["'`]? \s* (?:\]|\))? \s* (?:\|\|=|\?\?=|:=|=>|=|:|,\s*(?=["'`])) \s* (?:\(\s*)? (?:{_VALUE})"""
)
_ARGUMENT = re.compile(rf"""(?ix)(?<![\w-])--(?P<name>[\w-]*?(?:{NAME}))[ =](?:{_VALUE})""")
_SCHEME = re.compile(r"(?i)\b(?:bearer|token|basic)\s+(?P<v>[A-Za-z0-9+/=_.~:-]{8,})")
_BASIC = re.compile(r"(?i)\bbasic\s+(?P<v>[A-Za-z0-9+/=_-]{8,})")
_URL = re.compile(r"""[a-zA-Z][a-zA-Z0-9+.-]*://(?P<user>[^\s/:@"'`]*):(?P<v>[^\s/"'`]+)@(?=[\w\[-])""")
_USER = re.compile(r"""(?:^|\s)(?:-u|--user)[ =]?["']?(?P<user>[^\s:"'$]+):(?P<v>[^\s"']+)""")
_MYSQL = re.compile(r"""\s-p(?P<q>['"])(?P<v>[^'"]+)(?P=q)""")
_STDIN = re.compile(r"""(?:echo|printf)\s+(?:-n\s+)?(?P<q>["'])(?P<v>[^"']+)(?P=q)\s*\|.*(?:stdin|login)""")
_SAID = re.compile(r"""(?i)\b(?:pass(?:word|wd|phrase)?|passwd|pwd|pw|secret|token|api key)\b(?:\s+for\s+\S+)?(?:\s+(?:is|was|to))?\s*[:=]?\s+(?P<v>[^\s"'`]+)""")
_LOGIN = re.compile(r"""(?i)\b(?:login|logins|credentials?|account)\b\s*:?\s+\S+\s*/\s*(?P<v>[^\s"'`]+)""")
_GAP = r"(?:\\+[rn]|[\s\"'+,])*"
#: A private key up to the end of its first line of body.
_PEM = re.compile(rf"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----{_GAP}(?:[A-Za-z][A-Za-z-]*: [^\n\\]*{_GAP})*[A-Za-z0-9+/=]{{16,}}")
#: A literal that the next line goes on with.
_OPEN, _MORE = re.compile(r"\s*[+\\.]?\s*"), re.compile(r"""\s*[+.]?\s*["'`](?P<v>[^"'`]+)["'`]""")
#: Random-looking tokens that carry their issuer's prefix, wherever they stand.
_SHAPES = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")


def texts_of(tool_input: str | None, result_text: str | None) -> Iterator[tuple[str, str]]:
    """(place, text) of a block."""
    if result_text:
        yield "content", result_text
    if tool_input:
        try:
            held = json.loads(tool_input)
        except (ValueError, RecursionError):
            return
        if isinstance(held, dict):
            for k, v in held.items():
                if isinstance(v, str) and v:
                    yield f"input.{k}", clean(v)


def is_structured(v: str, loose: bool, quoted: bool = False) -> bool:
    """Whether a value has a credential's form: long and mixed enough, no stand-in, no name or reference.

    loose: the place alone already says that it is a credential (a URL's login, a password argument). quoted: a
    parenthesis in it calls nothing, unless all of it reads as a call.
    """
    if len(v) < (6 if loose else 8) or STAND_IN.match(v):
        return False
    digits = sum(c.isdigit() for c in v)
    if digits == len(v):
        return False
    odd = any(not c.isalnum() and c not in "-_./:\\" for c in v)
    if not digits and not odd:  # words: only long ones of mixed case are no names
        return len(v) >= 16 and any(c.islower() for c in v) and any(c.isupper() for c in v) and not re.search(r"[-_./: ]", v) and not re.fullmatch(r"[A-Z]?[a-z]+(?:[A-Z][a-z]+)*", v)
    return loose or v.startswith("eyJ") or not (_REFERENCE.search(v) or (_CALL.match(v) if quoted else "(" in v))


def _basic(v: str) -> str | None:
    """The password of user:password in base64."""
    try:
        user, sep, word = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8").partition(":")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    return word if sep and user.isprintable() and word.isprintable() else None


def candidates_in(text: str) -> Iterator[tuple[str, str]]:
    """(literal, plain) of a text: a value in a credential's place, and the password that it encodes ('' if none)."""
    if not _HOT.search(text):
        return
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            yield m[0], ""
    lines = text.split("\n")
    for at, line in enumerate(lines):
        if not _HOT.search(line):
            continue
        for m in _URL.finditer(line):
            v = m["v"]
            if is_structured(v, True) and not v.startswith(("$", "{", "<")):
                plain = unquote(v)
                yield v, plain if plain != v else ""
        for pattern in (_ASSIGN, _ARGUMENT):
            for m in pattern.finditer(line):
                v = m["v"] or m["b"]
                if NOT_NAME.search(m["name"]) or "://" in v:
                    continue
                quoted = m["v"] is not None
                if quoted and " " in v and not all(re.search(r"\d", x) and re.search(r"[A-Za-z]", x) for x in v.split(" ")):
                    continue  # a sentence, or a header that _SCHEME reads
                if quoted and len(v) >= 6 and _OPEN.fullmatch(line, m.end()) and at + 1 < len(lines) and (more := _MORE.match(lines[at + 1])):
                    if is_structured(v + more["v"], False):  # a literal in parts counts by its first
                        yield v, ""
                    continue
                if is_structured(v, False, quoted) and (quoted or not v.startswith(("/", "~", "./")) or not re.fullmatch(r"[~./\w-]+", v) or len(v) > 24):
                    yield v, _basic(v) or ""
        if re.search(r"(?i)auth|header|bearer", line):
            for m in _SCHEME.finditer(line):
                v = m["v"].rstrip(".")
                if is_structured(v, False):
                    yield v, (_basic(v) if _BASIC.search(line) else None) or ""
        for pattern in (_USER, _MYSQL, _STDIN, _LOGIN):
            for m in pattern.finditer(line):
                if is_structured(m["v"], pattern is not _LOGIN) and not m["v"].startswith("$"):
                    yield m["v"], ""
        for m in _SAID.finditer(line):
            v = m["v"].rstrip(",.;:)!?")
            if is_structured(v, False):
                yield v, ""
        for m in _SHAPES.finditer(line):
            yield m[0], ""


TEXTS = "session_id string, line_no long, pos long, tool_input string, result_text string"


def _blocks(blocks: DataFrame) -> DataFrame:
    return blocks.select(norm_id("session_id").alias("session_id"), F.col("line_no").cast("long").alias("line_no"), F.col("pos").cast("long").alias("pos"), "tool_input", "result_text").filter(
        "tool_input is not null or result_text is not null"
    )


def candidates(blocks: DataFrame) -> DataFrame:
    """literal, session_id, plain: candidates of every block, each once per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for s, ti, rt in zip(*(b.column(i).to_pylist() for i in range(3))):
                for _, text in texts_of(ti, rt):
                    found.update((literal, s, plain) for literal, plain in candidates_in(text))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], ["literal", "session_id", "plain"])

    return _blocks(blocks).select("session_id", "tool_input", "result_text").mapInArrow(run, "literal string, session_id string, plain string")


def confirmed(found: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """literal, n_owners: the literals of few owners, with the passwords they encode."""
    both = found.select("session_id", F.explode(F.array("literal", "plain")).alias("literal")).filter("literal <> ''")
    return both.distinct().groupBy("literal").agg(F.count("*").alias("n_owners")).filter((F.col("n_owners") <= max_owners) & (F.char_length("literal") >= LEAST))


class Hashes:
    """Hashes of substrings of a text in constant time each: sums of characters times powers, without carry."""

    BASE = 0x9E3779B97F4A7C15 | 1
    _powers: np.ndarray = np.ones(1, np.uint64)
    _backs: np.ndarray = np.ones(1, np.uint64)

    def __init__(self, text: str) -> None:
        self.chars = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        n = len(self.chars)
        if len(Hashes._powers) <= n:
            size = max(2 * n, CHUNK + 4 * KEYED)
            back = pow(self.BASE, -1, 1 << 64)
            for name, by in (("_powers", self.BASE), ("_backs", back)):
                row = np.full(size + 1, by, np.uint64)
                row[0] = 1
                setattr(Hashes, name, np.cumprod(row, dtype=np.uint64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.chars.astype(np.uint64) + np.uint64(1)) * Hashes._powers[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        h = (self.sums[starts + sizes] - self.sums[starts]) * Hashes._backs[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(27)


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The four places of a hash in a bitmap of 2 ** bits."""
    step = h * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
    return [((h * np.uint64(0x94D049BB133111EB) + np.uint64(k) * step) >> np.uint64(64 - bits)).astype(np.int64) for k in range(4)]


class Bitmaps:
    """Bitmaps of the literals' first LEAST characters and of whole literals, and the lengths that literals have."""

    def __init__(self, heads: bytes, wholes: bytes, bits: int, sizes: list[int]) -> None:
        self.heads, self.wholes, self.bits, self.sizes = np.frombuffer(heads, np.uint8), np.frombuffer(wholes, np.uint8), bits, sizes

    def has(self, which: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), np.uint8)
        for at in probes(h, self.bits):
            out &= which[at >> 3] >> (at & 7).astype(np.uint8)
        return out.astype(bool)


def _in_bitmap(literals: DataFrame, bits: int) -> tuple[bytes, bytes]:
    """The bits that literals (column key) set, put together in chunks of a bounded size."""
    chunk = min(bits, 20)

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            sizes = np.array([len(k) for k in keys], np.int64)
            h, starts = Hashes("".join(keys)), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            for which, hashes in enumerate((h.of(starts, LEAST), h.of(starts, sizes))):
                at = np.unique(np.concatenate(probes(hashes, bits)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), which), pa.int32()), pa.array(at >> chunk, pa.int32()), pa.array(at & ((1 << chunk) - 1), pa.int32())], ["which", "chunk", "at"])

    def together(g: dict) -> dict:
        row = np.zeros((1 << chunk) // 8 or 1, np.uint8)
        at = np.array(g["at"], np.int64)
        np.bitwise_or.at(row, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return {"which": g["which"][:1], "chunk": g["chunk"][:1], "held": [row.tobytes()]}

    d = literals.select("key").mapInArrow(bits_of, "which int, chunk int, at int").distinct()
    maps = [bytearray((1 << bits) // 8 or 1) for _ in range(2)]
    for r in map_fragments(d, ["which", "chunk"], ["at"], together, "which int, chunk int, held binary").collect():
        maps[r.which][r.chunk << chunk >> 3 : (r.chunk + 1) << chunk >> 3] = r.held
    return bytes(maps[0]), bytes(maps[1])


def bitmaps_of(literals: DataFrame, most: int = BITS) -> Bitmaps:
    """What texts are looked through with; its size is bounded (two bitmaps of 2 ** most bits, at most KEYED lengths)."""
    n = literals.count()
    bits = min(most, max(10, (PER_LITERAL * n).bit_length()))
    sizes = sorted(r[0] for r in literals.select(F.char_length("key")).distinct().collect())
    return Bitmaps(*_in_bitmap(literals, bits), bits, sizes)


def _is_word(chars: np.ndarray) -> np.ndarray:
    low = chars | 32
    return ((low >= 97) & (low <= 122)) | ((chars >= 48) & (chars <= 57))


def places_in(texts: list[str], maps: Bitmaps) -> Iterator[tuple[int, int, int, int]]:
    """(text, row, start, stop) of what may be literals: neither end parts a word, and both bitmaps have it."""
    pieces: list[tuple[int, int, int, int]] = []  # text, where the piece begins in it, how many starts are its own, its rows before
    held, size = [], 0
    for i, text in enumerate(texts):
        row, at = 1, 0
        while at == 0 or at < len(text):
            own = min(CHUNK, len(text) - at)
            first = max(0, at - 1)
            part = text[first : at + own + KEYED + 1]
            pieces.append((i, first, at - first + own, row))
            held.append(part)
            size += len(part) + 1
            if at + own < len(text):
                row += text.count("\n", first, at - first + own + first - 1)
            at += max(own, 1)
            if size > CHUNK:
                yield from _look(held, pieces, maps)
                pieces, held, size = [], [], 0
    if held:
        yield from _look(held, pieces, maps)


def _look(held: list[str], pieces: list[tuple[int, int, int, int]], maps: Bitmaps) -> Iterator[tuple[int, int, int, int]]:
    whole = "\n".join(held) + "\n"
    h = Hashes(whole)
    ends = np.cumsum([len(x) + 1 for x in held])
    begins = ends - [len(x) + 1 for x in held]
    word = _is_word(h.chars)
    inside = np.empty(len(word) + 1, bool)  # whether a cut here parts a word
    inside[0] = inside[-1] = False
    inside[1:-1] = word[:-1] & word[1:]
    starts = np.flatnonzero(~inside[: max(0, len(word) - LEAST)])
    starts = starts[maps.has(maps.heads, h.of(starts, LEAST))]
    if not len(starts):
        return
    piece = np.searchsorted(ends, starts, "right")
    offset = starts - begins[piece]
    first, own = (np.array([p[k] for p in pieces], np.int64)[piece] for k in (1, 2))
    mine = (offset < own) & ((offset > 0) | (first == 0))  # the character before a later piece belongs to the one before
    starts, piece = starts[mine], piece[mine]
    breaks = np.flatnonzero(h.chars == 10)
    for size in maps.sizes:
        fits = starts + size < ends[piece]
        at, of = starts[fits], piece[fits]
        if size < KEYED:
            open_ = ~inside[at + size]
            at, of = at[open_], of[open_]
        if len(at):
            good = maps.has(maps.wholes, h.of(at, size))
            for a, k in zip(at[good].tolist(), of[good].tolist()):
                i, first_, _, row = pieces[k]
                start = first_ + a - int(begins[k])
                yield i, row + int(np.searchsorted(breaks, a) - np.searchsorted(breaks, begins[k])), start, start + size


SPANS = "session_id string, line_no long, pos long, block long, place string, row_no long, start int, stop int, key string"
_maps: dict[int, Bitmaps] = {}


def _shared(maps: Bitmaps, spark) -> object:
    return spark.sparkContext.broadcast((maps.heads.tobytes(), maps.wholes.tobytes(), maps.bits, maps.sizes))


def _maps_of(held) -> Bitmaps:
    if held.id not in _maps:
        _maps.clear()
        _maps[held.id] = Bitmaps(*held.value)
    return _maps[held.id]


class _Held:
    def __init__(self, spark, maps: Bitmaps) -> None:
        import uuid

        self.broadcast, self.id = _shared(maps, spark), uuid.uuid4().int

    @property
    def value(self):
        return self.broadcast.value


def spans(blocks: DataFrame, literals: DataFrame, most: int = BITS) -> DataFrame:
    """Where the literals stand: SPANS (block tells blocks of one place with different contents apart)."""
    known = literals.select(F.substring("literal", 1, KEYED).alias("key")).distinct()
    known = cut_lineage(known)
    held = _Held(blocks.sparkSession, bitmaps_of(known, most))
    texts = _blocks(blocks).select("*", F.xxhash64("tool_input", "result_text").alias("block"))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    names = [c.split(" ")[0] for c in SPANS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = _maps_of(held)
        for b in batches:
            of, where = [], []
            for s, n, p, ti, rt, block in zip(*(c.to_pylist() for c in b.columns)):
                for place, text in texts_of(ti, rt):
                    of.append(text)
                    where.append((s, n, p, block, place))
            rows = [(*where[i], row, start, stop, of[i][start:stop]) for i, row, start, stop in places_in(of, maps)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return texts.mapInArrow(run, SPANS).join(known, "key", "left_semi").select(*names)


def find(blocks: DataFrame, max_owners: int = MAX_OWNERS, most: int = BITS) -> DataFrame:
    """The lines on which credentials begin: session_id, line_no, pos, place, row_no."""
    literals = cut_lineage(confirmed(candidates(blocks), max_owners))
    return spans(blocks, literals, most).select("session_id", "line_no", "pos", "place", "row_no").distinct()


_BEGIN, _END = re.compile(rf"-----BEGIN [A-Z0-9 ]+-----{_GAP}"), re.compile(rf"{_GAP}-----END")


def redact_text(text: str, found: list[tuple[int, int]], mark: str = "REDACTED") -> str:
    """text with the found places replaced: literals by a mark that fits any quotes, keys by a body of the mark."""
    out, at = [], 0
    for s, e in sorted(found):
        if s < at:
            if e > at:  # the rest of one that overlaps
                at = e
            continue
        if head := _BEGIN.match(text, s):
            end = _END.search(text, e)
            s, e = head.end(), end.start() if end else e
        elif e - s >= KEYED:  # known by its first characters: all of it
            e = re.compile(r"[^\s\"'`]*").match(text, e).end()
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def redact(blocks: DataFrame, literals: DataFrame, most: int = BITS) -> DataFrame:
    """Blocks that hold credentials, with redacted tool_input and result_text."""
    found = spans(blocks, literals, most).groupBy("session_id", "line_no", "pos", "block").agg(F.collect_set(F.struct("place", "start", "stop")).alias("found"))
    texts = _blocks(blocks).select("*", F.xxhash64("tool_input", "result_text").alias("block")).join(found, ["session_id", "line_no", "pos", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s, n, p, ti, rt, own in zip(*(c.to_pylist() for c in b.columns)):
                by: dict[str, list] = {}
                for x in own:
                    by.setdefault(x["place"], []).append((x["start"], x["stop"]))
                if "content" in by:
                    rt = redact_text(rt, by.pop("content"))
                if by:
                    held = json.loads(ti)
                    for place, at in by.items():
                        k = place[len("input.") :]
                        held[k] = redact_text(held[k], at)
                    ti = json.dumps(held, ensure_ascii=False)
                rows.append((s, n, p, ti, rt))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["session_id", "line_no", "pos", "tool_input", "result_text"])

    return texts.select("session_id", "line_no", "pos", "tool_input", "result_text", "found").mapInArrow(run, TEXTS).distinct()
