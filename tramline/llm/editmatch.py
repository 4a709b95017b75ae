"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by k = floor(error_rate * m) edits.
Cut into k + 1 pieces, at least one piece of it must occur unchanged, so an automaton over
all pieces finds every candidate place; Myers' bit-parallel distance then decides.

Distribution. Documents never move: each is scanned whole where it is read. Items are sent to
the tasks in blocks of bounded size; a larger benchmark takes more passes, not larger blocks.
Items and texts are compared lower-cased, with runs of white space as one space.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

ERROR_RATE = 0.08
#: Characters of items that one pass sends to the tasks.
BLOCK_CHARS = 4_000_000

MATCH = "uid long, doc_id long, item_id long, distance int, start int, end int"


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, error_rate: float) -> tuple[int, list[tuple[int, str]]]:
    """The error budget k of an item and its k + 1 pieces with their offsets."""
    m = len(item)
    k = min(int(m * error_rate), m - 1)
    cuts = [i * m // (k + 1) for i in range(k + 2)]
    return k, [(cuts[i], item[cuts[i] : cuts[i + 1]]) for i in range(k + 1)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and its first end."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
    return best, end


class Matcher:
    """All items of a block, ready to be looked for in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.ids = [i for i, _ in items]
        self.texts = [normalize(t) for _, t in items]
        self.budget: list[int] = []
        self.peq = [masks(t) for t in self.texts]
        self.back = [masks(t[::-1]) for t in self.texts]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, text in enumerate(self.texts):
            if not text:
                self.budget.append(0)
                continue
            k, parts = pieces(text, error_rate)
            self.budget.append(k)
            for at, part in parts:
                found[part].append((n, at))
        self.machine = ahocorasick.Automaton()
        for part, where in found.items():
            self.machine.add_word(part, (len(part), where))
        self.any = bool(found)
        if self.any:
            self.machine.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, distance, start, end) of the best place of each item within its budget."""
        if not self.any or not text:
            return []
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (length, where) in self.machine.iter(text):
            for n, at in where:
                low = last + 1 - length - at
                k = self.budget[n]
                spans[n].append((low - k, low + len(self.texts[n]) + k))
        out = []
        for n, places in spans.items():
            item, k = self.texts[n], self.budget[n]
            m = len(item)
            at = text.find(item)
            if at >= 0:
                out.append((n, 0, at, at + m))
                continue
            places.sort()
            merged = [list(places[0])]
            for low, high in places[1:]:
                if low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            best, where = k + 1, (0, 0)
            for low, high in merged:
                low = max(low, 0)
                distance, end = myers(self.peq[n], m, text[low:high])
                if distance < best:
                    head = text[max(low, low + end - m - distance) : low + end]
                    _, length = myers(self.back[n], m, head[::-1])
                    best, where = distance, (low + end - length, low + end)
            if best <= k:
                out.append((n, best, *where))
        return out


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(items: Broadcast, error_rate: float) -> Matcher:
    """The matcher of this worker process for a block of items, kept between tasks."""
    key = (items.value, error_rate)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(list(items.value), error_rate)
    return _MATCHERS[key]


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[tuple]:
    """The items in blocks whose size is bounded, whatever their number."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("length(trim(text)) > 0")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // block_chars)
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield tuple(sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is None, r)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that it holds: uid, doc_id, item_id, distance, start, end.

    start and end count characters of the normalised text, for the place of least distance
    (the first such place). Null and empty texts hold nothing; null and blank items are held
    by nothing; equal items and repeated rows each get rows of their own. uid is the place of the
    row; columns other than doc_id and text are not read.
    """
    base.ship_package(docs.sparkSession)
    narrow = base.with_uid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    out = docs.sparkSession.createDataFrame([], MATCH)
    for items in item_blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], items=docs.sparkSession.sparkContext.broadcast(items)) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(items, error_rate)
            for b in batches:
                rows = []
                for uid, doc_id, text in zip(b.column("_uid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                    for n, distance, start, end in matcher.search(normalize(text.as_py())):
                        rows.append((uid, doc_id, matcher.ids[n], distance, start, end))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["uid", "doc_id", "item_id", "distance", "start", "end"])

        out = out.unionByName(narrow.mapInArrow(run, MATCH))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay and no row moves.

    Null and empty texts hold nothing and stay, null and blank items are held by nothing, repeated
    rows are each judged, and an empty table of either kind changes nothing. Only the column text
    is read, whatever others are called.
    """
    base.ship_package(docs.sparkSession)
    for items in item_blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], items=docs.sparkSession.sparkContext.broadcast(items)) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(items, error_rate)
            for b in batches:
                clean = [not matcher.search(normalize(t.as_py())) for t in b.column("text")]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
