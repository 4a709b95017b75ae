"""Packing documents into fixed windows by minimum bin slack.

Documents become token ids plus an end id. Whole windows are cut off a document first; what
remains of it, shorter than a window, goes to a pool. For each window to fill, the largest
remaining length is taken and a subset-sum table over the multiset of the other lengths, kept
as one big integer per distinct length (bit s: sum s can be reached), gives the subset that
comes closest to the capacity; the counts of each length are read by walking back through the
table. The same pattern fills as many windows as its counts allow. Where no subset fits
exactly, the head of one remaining piece is cut off to fill the gap.

Distribution. Packing needs no order and no key, so each task packs the rows it reads: nothing
is shuffled and no group can be hot. At most one window per task is not full. A task's pool is
bounded; sequence ids carry the task's number.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, tokens

WINDOW = 1024
#: Pieces that a task gathers before it fills windows.
POOL = 4096

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def best_subset(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is nearest to ``target`` from below."""
    full = (1 << (target + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= target), reverse=True):
        steps.append((length, reach))
        left, part = min(counts[length], target // length), 1
        while left:
            take = min(part, left)
            reach |= (reach << (length * take)) & full
            left -= take
            part *= 2
        if reach >> target & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


class Packer:
    """Fills windows from a pool of pieces; a piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, window: int, width: int, first_sequence: int):
        self.window, self.width, self.sequence = window, width, first_sequence
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        """Take a document; returns the rows of its whole windows."""
        total, rows, size = len(ids) // self.width, [], self.window * self.width
        whole = len(ids) // size
        for i in range(whole):
            rows.append((doc_id, i * self.window, self.window, total, self.sequence, 0, ids[i * size : (i + 1) * size]))
            self.sequence += 1
        rest = ids[whole * size :]
        if rest:
            self.put((doc_id, whole * self.window, total, rest))
        return rows

    def put(self, piece: tuple) -> None:
        self.pool[len(piece[3]) // self.width].append(piece)
        self.held += 1

    def take(self, length: int) -> tuple:
        found = self.pool[length]
        piece = found.pop()
        if not found:
            del self.pool[length]
        self.held -= 1
        return piece

    def fill(self, leave: int) -> Iterator[tuple]:
        """Rows of filled windows. Stops, with ``leave`` or fewer pieces held, before a gap."""
        while self.held:
            counts = {n: len(p) for n, p in self.pool.items()}
            longest = max(counts)
            counts[longest] -= 1
            chosen = best_subset(counts, self.window - longest)
            chosen[longest] = chosen.get(longest, 0) + 1
            gap = self.window - sum(n * c for n, c in chosen.items())
            if gap and self.held <= leave:
                return
            times = min(len(self.pool[n]) // c for n, c in chosen.items()) if not gap else 1
            for _ in range(times):
                at = 0
                for n, c in sorted(chosen.items(), reverse=True):
                    for _ in range(c):
                        doc_id, start, total, ids = self.take(n)
                        yield (doc_id, start, n, total, self.sequence, at, ids)
                        at += n
                if gap and self.held:
                    # Every piece left is longer than the gap, else it would have been chosen.
                    doc_id, start, total, ids = self.take(max(self.pool))
                    cut = gap * self.width
                    yield (doc_id, start, gap, total, self.sequence, at, ids[:cut])
                    self.put((doc_id, start + gap, total, ids[cut:]))
                self.sequence += 1


def _pack_task(vocabulary: str, end_id: int, window: int, pool: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary, 4).encode
        end = end_id.to_bytes(4, "little")
        packer = Packer(window, 4, TaskContext.get().partitionId() << 36)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

        rows: list[tuple] = []
        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                rows += packer.add(doc_id.as_py(), encode(text.as_py() or "") + end)
                if packer.held >= pool:
                    rows += packer.fill(pool // 2)
                if len(rows) >= 2000:
                    yield out(rows)
                    rows = []
        rows += packer.fill(0)
        if rows:
            yield out(rows)

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, window: int = WINDOW, pool: int = POOL) -> DataFrame:
    """The pieces of all documents in their windows, with the ids themselves.

    One row per piece: doc_id, start (ids of its document before it), length, doc_tokens (with
    the end id), sequence_id, offset in the sequence, and ids (little-endian unsigned 32 bit).
    Null texts count as empty: such a document is its end id alone. Null and repeated ids of
    documents are kept as they are; other columns, whatever their names, are not read; an empty
    table gives no rows. Ids are those of the library's plain call with add_special_tokens=False.
    """
    base.ship_package(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_pack_task(vocabulary, end_id, window, pool), PIECES)


def sequences(pieces: DataFrame, pad_id: int = 0, window: int = WINDOW) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, and ids padded to the window.

    A sequence whose length is a power of two is left as long as it is. A sequence has at most
    ``window`` pieces, so what is gathered per key is bounded.
    """
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))")
    even = F.expr("bit_count(n_tokens) = 1")
    pad = F.lit(pad_id.to_bytes(4, "little"))
    whole = F.when(even, ids).otherwise(F.rpad(ids, window * 4, pad))
    return parts.select("sequence_id", "n_tokens", whole.alias("ids"))
