"""Encoding with a public byte-level BPE vocabulary in linear time, and the encoding of a whole corpus.

A text is cut by the vocabulary's pattern; each piece is mapped byte by byte to Latin-1, so that an Aho-Corasick
automaton over strings finds, at every byte, the longest token that starts there. The encoder walks from longest
matches and backtracks: a token may follow another only if the merges would leave that pair as it is, which
`compatible` decides (memoised) by undoing merges on both sides of the seam. A bit per byte position marks ends that
are known to be dead, so each position is given up at most once and the walk stays linear. The result is exactly that
of applying the merges in order. Pieces are memoised too, since words repeat.

Defined results: null and empty texts give empty lists; strings that look like special tokens are ordinary text;
a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: How the public vocabulary splits texts before merges (fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Place of the vocabularies, a parameter of the queries; entries that a worker keeps of its memory of pieces.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
MEMORY = 400_000

_workers: dict[int, "Encoder"] = {}


class Encoder:
    """ranks: the lines of a rank file (base64 token, rank)."""

    def __init__(self, ranks: bytes) -> None:
        import ahocorasick
        import regex

        pairs = sorted((int(r), base64.b64decode(t).decode("latin-1")) for t, r in (line.split() for line in ranks.splitlines() if line.strip()))
        if [r for r, _ in pairs] != list(range(len(pairs))):
            raise ValueError("ranks must be gapless from 0")
        self.tokens = [t for _, t in pairs]
        self.id_of = {t: i for i, t in enumerate(self.tokens)}
        self.sizes = [len(t) for t in self.tokens]
        self._pieces: dict[str, list[int]] = {}
        self._fits: dict[int, bool] = {}
        self.n = len(self.tokens)
        self._split()
        self.shorter = [self._prefix(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.id_of.items():  # reversed: a match that ends at a byte of the reversed piece starts there in the piece
            self.automaton.add_word(t[::-1], i)
        self.automaton.make_automaton()
        self.find = regex.compile(PATTERN).findall

    def _split(self) -> None:
        """The two tokens that the merge of each token joins; a token that no merge makes stands for itself."""
        n, id_of, tokens = self.n, self.id_of, self.tokens
        self.left, self.right, self.merge = list(range(n)), list(range(n)), {}
        for i, t in enumerate(tokens):
            if len(t) == 1:
                continue
            parts = [id_of[c] for c in t]
            while len(parts) > 2:
                best, where = i, -1
                for k in range(len(parts) - 1):
                    m = self.merge.get(parts[k] * n + parts[k + 1], i)
                    if m < best:
                        best, where = m, k
                if where < 0:
                    break
                parts[where : where + 2] = [best]
            if len(parts) == 2:
                self.left[i], self.right[i] = parts
                self.merge[parts[0] * n + parts[1]] = i

    def _prefix(self, t: str) -> int:
        """The longest token that is a proper prefix of t, or -1."""
        for k in range(len(t) - 1, 0, -1):
            if (i := self.id_of.get(t[:k])) is not None:
                return i
        return -1

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave token b after token a as they are."""
        key = a * self.n + b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 4 * MEMORY:
                self._fits.clear()
            known = self._fits[key] = self._seam(a, b)
        return known

    def _seam(self, a: int, b: int) -> bool:
        left, right, merge, n = self.left, self.right, self.merge, self.n
        # Merges happen in order of rank. Undo, latest first, the merges that made the tokens at the seam; if the parts
        # at the seam would merge with each other before the merge undone last, the pair doesn't stand.
        bound = n
        while True:
            joined = merge.get(a * n + b)
            if joined is not None and joined < bound:
                return False
            if a > b and right[a] != a:
                bound, a = a, right[a]
            elif left[b] != b:
                bound, b = b + 1, left[b]
            elif right[a] != a:
                bound, a = a, right[a]
            else:
                return True

    def _longest(self, piece: str) -> list[int]:
        """For each byte of piece the longest token that starts there."""
        size, sizes = len(piece), self.sizes
        out, best = [-1] * size, [0] * size
        for end, i in self.automaton.iter(piece[::-1]):
            at = size - 1 - end
            if sizes[i] > best[at]:
                out[at], best[at] = i, sizes[i]
        return out

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as bytes in Latin-1."""
        whole = self.id_of.get(piece)
        if whole is not None and (len(piece) == 1 or self.left[whole] != whole):
            return [whole]
        longest, sizes, shorter = self._longest(piece), self.sizes, self.shorter
        alive = (1 << (len(piece) + 1)) - 1 if len(piece) < 4096 else None
        dead = bytearray(len(piece) + 1) if alive is None else None
        out: list[int] = []
        at, token = 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = at + sizes[token]
                open_ = not dead[end] if dead is not None else alive >> end & 1
                if open_ and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < len(piece) else -1
                    break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                if dead is not None:
                    dead[at] = 1
                else:
                    alive &= ~(1 << at)
                if last < 0:
                    raise ValueError("a vocabulary without all bytes")
                out.pop()
                at -= sizes[last]
                token = last
                break
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces, out = self._pieces, []
        for p in self.find(text):
            ids = pieces.get(p)
            if ids is None:
                ids = self.encode_piece(p.encode().decode("latin-1"))
                if len(p) < 64:
                    if len(pieces) > MEMORY:
                        pieces.clear()
                    pieces[p] = ids
            out += ids
        return out


def read_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def worker_encoder(ranks) -> Encoder:
    """The encoder of this worker for broadcast ranks (a vocabulary file: its size does not grow with the data)."""
    data = ranks.value
    key = hash(data)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Encoder(data)
    return _workers[key]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, ids: one narrow pass, no shuffle."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or worker_encoder(ranks)
            texts = b.column(1).to_pylist()
            size, start = 0, 0
            for i, t in enumerate(texts):  # long texts make batches of their own
                size += len(t or "")
                if size > 4_000_000 or i == len(texts) - 1:
                    ids = pa.array([enc.encode(x) for x in texts[start : i + 1]], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, i + 1 - start), ids], ["doc_id", "ids"])
                    start, size = i + 1, 0

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, ids array<int>")


def corpus_counts(encoded: DataFrame) -> DataFrame:
    """How often each token occurs in an encoded corpus, and in how many documents."""
    return encoded.select("doc_id", F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))

