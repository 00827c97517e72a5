"""Filling containers of fixed capacity with texts, by bounded-space online best-fit.

Each task packs its stream of items into a fixed number of open bins. A bitset has a bit for each amount of free space
that some open bin has; the lowest set bit at or above an item's size is the best fit. If no open bin fits, a new one
opens, and when that is one too many the fullest closes first. Sizes are counted in the same pass that encodes the
texts, so texts are never shuffled. The bins still open at the end of the tasks are packed once more, as whole items,
in fewer tasks; so only a bounded number of bins per second-round task stays less full.

Defined results: null and empty texts go nowhere; a text larger than the capacity is split into pieces, all but the
last of full capacity, each of which is an item; equal texts are items of their own; a text never spans containers
otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .bpe import TOKENIZERS, read_ranks, worker_encoder

CAPACITY, OPEN_BINS = 512, 64
#: Bins left open that one task of the second round packs.
SECOND_ROUND = 50_000
ITEMS = "doc_id long, piece int, n_tokens int, bin string, is_open boolean"


class OpenBins:
    """The open bins of one stream. put() gives the bin of an item and the bin that closed, if one did."""

    def __init__(self, capacity: int, limit: int, name: str) -> None:
        self.capacity, self.limit, self.name = capacity, limit, name
        self.free: dict[int, list[str]] = {}  # free space -> open bins
        self.bits, self.count, self.made = 0, 0, 0

    def _take(self, space: int) -> str:
        bins = self.free[space]
        b = bins.pop()
        if not bins:
            del self.free[space]
            self.bits &= ~(1 << space)
        self.count -= 1
        return b

    def put(self, size: int) -> tuple[str, str | None]:
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b, left = self._take(space), space - size
        else:
            b, left = f"{self.name}-{self.made}", self.capacity - size
            self.made += 1
        if left == 0:
            return b, b
        self.free.setdefault(left, []).append(b)
        self.bits |= 1 << left
        self.count += 1
        if self.count > self.limit:
            return b, self._take((self.bits & -self.bits).bit_length() - 1)
        return b, None

    def still_open(self) -> set[str]:
        return {b for bins in self.free.values() for b in bins}


def pieces_of(n_tokens: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(piece, size) of a text: one piece unless it exceeds the capacity."""
    full, rest = divmod(n_tokens, capacity)
    for k in range(full):
        yield k, capacity
    if rest:
        yield full, rest


def pack_corpus(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, piece, n_tokens, container: the container of each text, or of each piece of one over the capacity."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(name, folder))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins, f"a{TaskContext.get().partitionId()}")
        held: dict[str, list[tuple]] = {}  # rows of open bins
        ready: list[tuple] = []
        enc = None

        def out() -> pa.RecordBatch:
            cols = list(zip(*ready))
            ready.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_())],
                ["doc_id", "piece", "n_tokens", "bin", "is_open"],
            )

        for b in batches:
            enc = enc or worker_encoder(ranks)
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for piece, size in pieces_of(len(enc.encode(text)), capacity):
                    own, closed = bins.put(size)
                    held.setdefault(own, []).append((doc, piece, size))
                    if closed is not None:
                        ready.extend((*r, closed, False) for r in held.pop(closed))
                if len(ready) >= 20_000:
                    yield out()
        for name_, rows in held.items():
            ready.extend((*r, name_, True) for r in rows)
        if ready:
            yield out()

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).filter("text <> ''")
    packed = cut_lineage(d.mapInArrow(first, ITEMS))  # read by both parts below
    rest = packed.filter("is_open").groupBy("bin").agg(F.sum("n_tokens").alias("size"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins * 16, f"b{TaskContext.get().partitionId()}")
        for b in batches:
            items = b.column(0).to_pylist()
            homes = [bins.put(s)[0] for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(homes, pa.string())], ["bin", "home"])

    tasks = max(1, packed.rdd.getNumPartitions() * open_bins // SECOND_ROUND)
    # largest first within a task: items are few and known by now
    homes = rest.repartition(tasks, "bin").sortWithinPartitions(F.desc("size"), "bin").select("bin", F.col("size").cast("long").alias("size")).mapInArrow(second, "bin string, home string")
    whole = packed.filter("not is_open").select("doc_id", "piece", "n_tokens", F.col("bin").alias("container"))
    moved = packed.filter("is_open").join(homes, "bin").select("doc_id", "piece", "n_tokens", F.col("home").alias("container"))
    return whole.unionByName(moved)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, and the share of their space that is filled, per number of items in a container."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_items"))
    return per.agg(
        F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("most_used"),
        (F.sum("used") / (F.count("*") * capacity)).alias("filled"),
    )
