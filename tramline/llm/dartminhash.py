"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

A document is the weighted set of its five-word shingles; a shingle's weight is how often it
occurs. Two documents are linked if the weighted Jaccard similarity of their sets, the sum of
lesser weights over the sum of greater ones, is high enough.

Darts are thrown by a hash of the shingle: they arrive in order of rank, at a rate equal to the
shingle's weight, each at a random coordinate of the signature; weights are cut into dyadic
regions, so that a heavier shingle keeps the darts of a lighter one and adds its own. All darts
up to a rank that is inversely proportional to the total weight are thrown, about k ln k of them
whatever the size of the document, and each coordinate keeps its earliest dart. Two documents
agree on a coordinate with the probability of their weighted similarity.

Documents with equal weighted sets are one class from the start. The others meet in bands of
coordinates. In a band, rows are sorted by its hash and then by the coordinates that follow it;
a run of equal hashes that is longer than a block is cut further by those coordinates, so that
no group, however large, is gathered in one place, and alike documents stay side by side. A
block yields a tree of its most alike pairs. Pairs are verified by the exact similarity of
their weighted sets (a shingle that occurs three times is three elements), and links make classes
by connected components.

Those pairs are only a cheap start. A second pass takes every bucket, whole, that still holds
rows of different classes, and verifies all pairs of such rows whose sizes allow a link, where
they meet: a bucket is dealt in blocks of bounded size, each pair of blocks a unit of its own,
with the weighted sets themselves. A unit tells links, one for each two classes at most, so what
it tells is no more than its rows, and no pair is ever written. Rows of one class aren't
compared, so a large group of near copies costs nothing there; a large group whose pairs are
just under the similarity costs the comparison of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, graph

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
#: Coordinates after a band by which its rows are sorted and compared, a byte of each.
DEEP = 32
#: Documents of a block.
BLOCK = 96
#: Share of agreeing bytes, of ``DEEP``, under which the first pass leaves a pair to the second.
HOPELESS = 0.45
#: Documents, and elements of their sets, of a block of the second pass.
WIDE, WIDE_ELEMENTS = 1000, 400_000
#: Darts that are thrown at once, but for one of each element.
TURNS = 16_384
#: Darts that one batch of documents may take.
BATCH_DARTS = 400_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, the number of the text of each, and their counts.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than a
    shingle has one shingle of them all; a text without words has none.
    """
    split = [t.lower().split() for t in texts]
    lens = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = list(chain.from_iterable(split))
    names = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(names.__getitem__, flat), dtype=np.int64, count=len(flat))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), dtype=np.uint64, count=len(names))[ids]
    owner = np.repeat(np.arange(len(split)), lens)
    ends = np.cumsum(lens)
    left = np.repeat(ends, lens) - np.arange(len(ids))
    first = np.zeros(len(ids), dtype=bool)
    first[(ends - lens)[lens > 0]] = True
    at = np.flatnonzero((left >= words) | (first & (left < words)))
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(words):
        there = left[at] > i
        nxt = np.where(there, hashes[np.minimum(at + i, len(ids) - 1)] if len(ids) else 0, np.uint64(i + 1))
        h = mix(h * _GOLD + nxt)
    doc = owner[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    counts = np.diff(np.append(start, len(h)))
    return h[start], doc[start], counts


def dart_signatures(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures (n_docs, k) of weighted sets given as elements, sorted by ``doc``; 0 for an empty set."""
    total = np.bincount(doc, weight, n_docs)
    out = np.zeros((n_docs, k), dtype=np.uint64)
    todo = np.flatnonzero(total > 0)
    reach = k * (np.log(k) + 1.5)
    while len(todo):
        local = np.full(n_docs, -1, dtype=np.int64)
        local[todo] = np.arange(len(todo))
        mine = local[doc] >= 0
        best, dart = _throw(h[mine], local[doc[mine]], weight[mine], (reach / total)[todo], len(todo), k)
        full = np.isfinite(best).all(axis=1)
        out[todo[full]] = dart[full]
        todo, reach = todo[~full], reach * 2
    return out


def _throw(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, limit: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.full(n_docs * k, np.inf)
    dart = np.zeros(n_docs * k, dtype=np.uint64)
    low, width, region = 0.0, 1.0, 0
    heaviest = weight.max()
    while low < heaviest:
        live = np.flatnonzero(weight > low)
        key, rank, turn = mix(h[live] + _GOLD * np.uint64(region + 1)), np.zeros(len(live)), 0
        home, most, own = doc[live] * k, limit[doc[live]], weight[live]
        while len(key):
            # Few elements that throw many darts each throw several at a time.
            turns = np.arange(turn + 1, turn + 1 + max(1, min(64, TURNS // len(key))), dtype=np.uint64)
            turn += len(turns)
            x = mix(key[:, None] + _GOLD * turns)
            ranks = np.log1p((x >> np.uint64(11)).astype(np.float64) * -(2.0**-53)) / -width
            ranks[:, 0] += rank
            np.cumsum(ranks, axis=1, out=ranks)
            near = ranks <= most[:, None]
            at, on = near.nonzero()[0], near[:, -1]
            name, r = x[near], ranks[near]
            y = mix(name ^ _M2)
            slot = home[at] + (((y & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
            if region or own.min(initial=1.0) < 1.0:
                inside = low + width * (y >> np.uint64(32)).astype(np.float64) * 2.0**-32 < own[at]
                slot, r, name = slot[inside], r[inside], name[inside]
            np.minimum.at(best, slot, r)
            won = best[slot] == r
            dart[slot[won]] = name[won]
            key, rank, home, most, own = key[on], ranks[on, -1], home[on], most[on], own[on]
        low, width, region = low + width, max(1.0, low + width), region + 1
    return best.reshape(n_docs, k), dart.reshape(n_docs, k)


_SETS = "uid long, doc_id long, n int, key1 long, key2 long, bands array<long>, bytes binary"
_ELEMENTS = "uid long, n int, shingles array<long>"
#: Characters of the texts whose elements are made at once.
BATCH_CHARS = 8_000_000


def elements(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A weighted set as a plain one: an element for each time that a shingle occurs."""
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    h = np.repeat(h, counts)
    return np.where(nth > 0, mix(h + nth.astype(np.uint64) * _GOLD), h)


def _set_task(bands: int, rows: int, words: int):
    k = bands * rows
    per_batch = max(1, int(BATCH_DARTS / (k * (np.log(k) + 1.5))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for at in range(0, whole.num_rows, per_batch):
                    part = whole.slice(at, per_batch)
                    texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                    h, doc, counts = shingles(texts, words)
                    sig = dart_signatures(h, doc, counts.astype(np.float64), len(texts), k)
                    n = np.bincount(doc, counts, len(texts)).astype(np.int64)
                    ends = np.cumsum(n)
                    starts = ends - n
                    all_of = elements(h, counts)
                    # Two independent sums over the elements tell equal sets.
                    keys = []
                    for c in (_M1, _M2):
                        sums = np.append(np.uint64(0), np.cumsum(mix(all_of * c + np.uint64(1)), dtype=np.uint64))
                        keys.append(mix(sums[ends] - sums[starts] + n.astype(np.uint64)).view(np.int64))
                    by_band = np.zeros((len(texts), bands), dtype=np.uint64)
                    for j in range(rows):
                        by_band = mix(by_band * _GOLD + sig.reshape(len(texts), bands, rows)[:, :, j])
                    by_band = mix(by_band + np.arange(bands, dtype=np.uint64) * _M1).view(np.int64)
                    flat = pa.ListArray.from_arrays(pa.array((np.arange(len(texts) + 1) * bands).astype(np.int32)), pa.array(by_band.ravel()))
                    raw = (sig & np.uint64(255)).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("_uid"), part.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(keys[0]), pa.array(keys[1]), flat, pa.array([r.tobytes() for r in raw], pa.binary())],
                        names=["uid", "doc_id", "n", "key1", "key2", "bands", "bytes"],
                    )

    return run


def _element_task(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(uids: list[int], texts: list[bytes]) -> pa.RecordBatch:
            h, doc, counts = shingles(texts, words)
            n = np.bincount(doc, counts, len(texts)).astype(np.int32)
            with np.errstate(over="ignore"):
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(elements(h, counts).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(n), lists], names=["uid", "n", "shingles"])

        for b in batches:
            uids, texts, size = [], [], 0
            for uid, text in zip(b.column("_uid").to_pylist(), b.column("text").cast(pa.binary())):
                uids.append(uid)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size > BATCH_CHARS:
                    yield made(uids, texts)
                    uids, texts, size = [], [], 0
            if uids:
                yield made(uids, texts)

    return run


def tree(codes: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of a block: a tree (or several) of the pairs that agree on most bytes. What they miss is the second pass's."""
    m = len(codes)
    if m == 2:
        low, high = sorted((int(sizes[0]), int(sizes[1])))
        return [(0, 1)] if low >= similarity * high and (codes[0] == codes[1]).mean() >= HOPELESS else []
    alike = (codes[:, None, :] == codes[None, :, :]).mean(axis=2)
    ratio = np.minimum(sizes[:, None], sizes[None, :]) / np.maximum(sizes[:, None], sizes[None, :])
    alike[(ratio < similarity) | (alike < HOPELESS)] = -1
    np.fill_diagonal(alike, -1)
    # Prim's algorithm, begun anew where nothing else can be reached.
    out, best, via = [], np.full(m, -2.0), np.zeros(m, dtype=np.int64)
    for _ in range(m):
        i = int(best.argmax())
        if best[i] == -np.inf:
            break
        if best[i] > 0:
            out.append((int(via[i]), i))
        best[i] = -np.inf
        closer = (alike[i] > best) & np.isfinite(best)
        best[closer], via[closer] = alike[i][closer], i
    return out


def _pair_task(block: int, similarity: float, deep: int):
    """Sorted rows of bands to pairs of documents (a, b), and the rows (a, bh) of buckets that may
    hold more than one: runs of two rows or more, and what touches the ends of the partition."""

    def pairs_of(uids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        todo = [(0, len(uids), 0)]
        while todo:
            low, high, depth = todo.pop()
            if high - low < 2:
                continue
            if high - low <= block or depth == deep:
                for at in range(low, high, block):
                    top = min(high, at + block)
                    for a, b in tree(codes[at:top], sizes[at:top], similarity):
                        yield uids[at + a], uids[at + b]
                    if top < high:
                        yield uids[top - 1], uids[top]
                continue
            column = codes[low:high, depth]
            cuts = [low, *(low + 1 + np.flatnonzero(column[1:] != column[:-1])), high]
            for a, b in zip(cuts, cuts[1:]):
                todo.append((int(a), int(b), depth + 1))
                if b < high and sizes[[b - 1, b]].min() >= similarity * sizes[[b - 1, b]].max() and (codes[b - 1] == codes[b]).mean() >= HOPELESS:
                    yield uids[b - 1], uids[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs():
            held: list[pa.RecordBatch] = []
            for b in batches:
                hashes = b.column("bh").to_numpy()
                if not len(hashes):
                    continue
                cuts = np.flatnonzero(hashes[1:] != hashes[:-1]) + 1
                if held and held[-1].column("bh")[0].as_py() != hashes[0]:
                    yield held
                    held = []
                # Whole runs of this batch go on together; the last may continue.
                last = int(cuts[-1]) if len(cuts) else 0
                if last and not held:
                    yield [b.slice(0, last)]
                elif last:
                    first = int(cuts[0])
                    yield [*held, b.slice(0, first)]
                    held = []
                    if last > first:
                        yield [b.slice(first, last - first)]
                held.append(b.slice(last))
            if held:
                yield held

        seen: set[tuple[int, int]] = set()
        edge, final = True, None
        for held in runs():
            t = pa.Table.from_batches(held)
            hashes, uids, sizes = (t.column(c).to_numpy() for c in ("bh", "uid", "n"))
            cuts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1], True])
            lens = np.diff(cuts)
            long = np.flatnonzero(lens > 1)
            shared = np.repeat(lens > 1, lens)
            shared[0] |= edge
            edge, final = False, None if shared[-1] else (uids[-1:], hashes[-1:])
            if shared.any():
                yield _found(uids[shared], bh=hashes[shared])
            if not len(long):
                continue
            raw = t.column("codes").combine_chunks()
            for i in long:
                low, high = cuts[i], cuts[i + 1]
                codes = np.frombuffer(b"".join(raw.slice(low, high - low).to_pylist()), dtype=np.uint8).reshape(high - low, deep)
                for a, b in pairs_of(uids[low:high], sizes[low:high], codes):
                    seen.add((int(min(a, b)), int(max(a, b))))
            if len(seen) > 200_000:
                yield _pairs(seen)
                seen.clear()
        if final:
            yield _found(final[0], bh=final[1])
        if seen:
            yield _pairs(seen)

    return run


def _found(a: np.ndarray, b: np.ndarray | None = None, bh: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if c is None else pa.array(c) for c in (a, b, bh)], names=["a", "b", "bh"])


def _pairs(seen: set[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(sorted(seen), dtype=np.int64)
    return _found(both[:, 0], both[:, 1])


def _sets_of(wanted: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(uid, n, shingles) of the rows in ``wanted`` (_uid). Sets are made anew: most texts need none."""
    return base.materialize(texts.join(wanted.distinct().hint("merge"), "_uid", "left_semi").mapInArrow(_element_task(words), _ELEMENTS), "insets")


def _links(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Those of ``pairs`` whose weighted sets have the similarity, exactly."""
    in_pairs = _sets_of(pairs.select(F.col("a").alias("_uid")).unionByName(pairs.select(F.col("b").alias("_uid"))), texts, words)
    left = in_pairs.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = in_pairs.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = pairs.join(left, "a").join(right, "b").withColumn("both", both).filter(F.col("both") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")
    links = base.materialize(links, "near")
    base.discard(in_pairs)
    return links


def unit_links(uid: np.ndarray, cls: np.ndarray, side: np.ndarray, n: np.ndarray, elements: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of a unit between rows of different classes, one at most for each two.

    ``elements`` holds the sets one after the other, ``n`` of each row. Rows of two sides meet
    those of the other side only.
    """
    ends = np.cumsum(n)
    names, ids = np.unique(elements, return_inverse=True)
    order = np.argsort(n, kind="stable")  # by size, so that the sizes that fit are a run
    sizes = n[order]
    tops = np.searchsorted(sizes, sizes / similarity, "right")
    ids = np.concatenate([ids[ends[i] - n[i] : ends[i]] for i in order])
    ends, uid, side, one = np.cumsum(sizes), uid[order], side[order], side.min() == side.max()
    cls = np.unique(cls, return_inverse=True)[1][order]
    mine, out = np.zeros(len(names), dtype=bool), []
    for at in range(len(uid) - 1):
        near = np.arange(at + 1, tops[at])
        near = near[(cls[near] != cls[at]) & (one | (side[near] != side[at]))]
        if not len(near):
            continue
        own = ids[ends[at] - sizes[at] : ends[at]]
        mine[own] = True
        lens = sizes[near]
        starts = np.cumsum(lens) - lens
        place = np.arange(lens.sum()) + np.repeat(ends[near] - lens - starts, lens)
        both = np.add.reduceat(mine[ids[place]].astype(np.int64), starts)
        mine[own] = False
        for other in near[both >= similarity * (sizes[at] + lens - both)]:
            if cls[other] != cls[at]:
                out.append((int(min(uid[at], uid[other])), int(max(uid[at], uid[other]))))
                cls[cls == cls[other]] = cls[at]
    return out


def _unit_task(similarity: float):
    """Rows sorted by their unit (bh, i, j) to links between them."""

    def links_of(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        t = pa.Table.from_batches(rows)
        sets = t.column("shingles").combine_chunks()
        return unit_links(*(t.column(c).to_numpy() for c in ("uid", "class", "side", "n")), sets.flatten().to_numpy(), similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def units():
            held: list[pa.RecordBatch] = []
            key = None
            for b in batches:
                keys = np.stack([b.column(c).to_numpy() for c in ("bh", "i", "j")], 1)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
                for low, high in zip(cuts, cuts[1:]):
                    if high > low:
                        if held and tuple(keys[low]) != key:
                            yield held
                            held = []
                        key = tuple(keys[low])
                        held.append(b.slice(low, high - low))
            if held:
                yield held

        seen: set[tuple[int, int]] = set()
        for rows in units():
            if sum(r.num_rows for r in rows) > 1:
                seen.update(links_of(rows))
            if len(seen) > 200_000:
                yield _pairs(seen).drop_columns(["bh"])
                seen.clear()
        if seen:
            yield _pairs(seen).drop_columns(["bh"])

    return run


def _rest(rows: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Links (a, b) between rows (bh, uid, n, class) of one bucket and different classes: one at
    least for each two classes of it that have any.

    The rows of the largest class of a bucket meet only the rows of the others. Both are dealt in
    blocks by a hash of the row; a unit is one or two blocks of others, or one of each.
    """
    each = rows.groupBy("bh", "class").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    top = F.max(F.struct("m", "class", "n"))
    mixed = each.groupBy("bh").agg(top.alias("top"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.count("*").alias("k")).filter("k > 1")
    blocks = lambda m, n: F.greatest(F.ceil(m / WIDE), F.ceil(n / WIDE_ELEMENTS)).cast("int")
    others, most = blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")), blocks(F.col("top.m"), F.col("top.n"))
    mixed = mixed.select("bh", F.col("top.class").alias("most"), others.alias("b_others"), most.alias("b_most"))
    mixed = base.materialize(rows.join(mixed.hint("merge"), "bh"), "mixed")
    sets = _sets_of(mixed.select(F.col("uid").alias("_uid")), texts, words)
    is_most = F.col("class") == F.col("most")
    block = F.pmod(F.xxhash64("uid"), F.when(is_most, F.col("b_most")).otherwise(F.col("b_others"))).cast("int")
    to = lambda n: F.sequence(F.lit(0), n - 1)
    # Units: (i, j) with i <= j for two blocks of others; (-1 - a, j) for block a of the largest class.
    ofs = F.transform(to(F.col("b_others")), lambda j: F.when(is_most, F.struct((-1 - F.col("block")).alias("i"), j.alias("j"))).otherwise(F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j"))))
    more = F.transform(to(F.col("b_most")), lambda a: F.struct((-1 - a).alias("i"), F.col("block").alias("j")))
    units = mixed.withColumn("block", block).withColumn("unit", F.explode(F.when(is_most, ofs).otherwise(F.concat(ofs, more))))
    side = F.when(F.col("unit.i") < 0, is_most).otherwise(F.col("block") == F.col("unit.j")).cast("int").alias("side")
    units = units.select("bh", F.col("unit.i").alias("i"), F.col("unit.j").alias("j"), side, "uid", "class")
    dealt = units.join(sets.hint("merge"), "uid").repartition("bh", "i", "j").sortWithinPartitions("bh", "i", "j")
    links = base.materialize(dealt.mapInArrow(_unit_task(similarity), "a long, b long").distinct(), "rest")
    base.discard(mixed, sets)
    return links


def _joined(roots: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root) where ``more`` links are added, and the table that it reads beside ``roots``.

    Only the classes that these links touch are joined anew; the links that made them aren't read again.
    """
    for c in ("a", "b"):
        of = roots.select(F.col("node").alias(c), "root")
        more = more.join(of.hint("merge"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    top = graph.components(more.select("a", "b"))
    over = top.select(F.col("node").alias("root"), F.col("root").alias("least"))
    old = roots.join(over.hint("merge"), "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    return old.unionByName(top.join(roots.select("node").hint("merge"), "node", "left_anti")), top


def near_duplicates(docs: DataFrame, uid: str | None = None, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: uid, doc_id, class_id, class_uid, class_size, representative.

    Documents of a class are linked by pairs whose shingles, weighted by how often they occur,
    have at least ``similarity`` (weighted Jaccard). class_uid is the row of the class that stays,
    the first of it, and class_id its doc_id. Rows are read more than once: ``uid``, if given, must
    be the same each time. Texts without words, null ones among them, are one
    class; a text of fewer words than a shingle is one shingle. Repeated rows and null or repeated
    ids keep a row each; they are told apart by the long column ``uid``, by default their place.
    An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    base.ship_package(docs.sparkSession)
    narrow = docs.select(*([F.col(uid).alias("_uid")] if uid else []), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    narrow = narrow if uid else base.with_uid(narrow)
    texts = narrow.select("_uid", "text")
    sets = base.materialize(narrow.mapInArrow(_set_task(bands, rows, words), _SETS), "sets")

    # Equal sets are one node: the first row that has the set.
    nodes = base.materialize(sets.groupBy("key1", "key2").agg(F.min("uid").alias("node")), "nodes")
    # Both lists of rows below grow with the documents: never broadcast, whatever their size today.
    firsts = sets.filter("n > 0").join(nodes.select(F.col("node").alias("uid")).hint("merge"), "uid", "left_semi")
    k = bands * rows
    code = F.substring(F.concat("bytes", "bytes"), F.col("band") * rows + rows + 1, F.lit(DEEP)) if k >= DEEP else F.col("bytes")
    banded = firsts.select("uid", "n", "bytes", F.posexplode("bands").alias("band", "bh")).select("bh", "uid", "n", code.alias("codes"))
    dealt = banded.repartitionByRange("bh", "codes", "uid").sortWithinPartitions("bh", "codes", "uid")
    found = base.materialize(dealt.mapInArrow(_pair_task(block, similarity, min(DEEP, k)), "a long, b long, bh long"), "found")
    pairs = base.materialize(found.filter("bh is null").select("a", "b").distinct(), "pairs")
    links = _links(pairs, texts, similarity, words)
    roots = graph.components(links)

    # What the first pairs left apart and yet shares a bucket.
    classes = firsts.select("uid", "n").join(roots.select(F.col("node").alias("uid"), "root").hint("merge"), "uid", "left").select("uid", "n", F.coalesce("root", "uid").alias("class"))
    met = found.filter("bh is not null").select("bh", F.col("a").alias("uid")).join(classes.hint("merge"), "uid")
    more = _rest(met, texts, similarity, words)
    first = more_of = roots
    if not more.isEmpty():
        roots, more_of = _joined(first, more)

    named = nodes.join(roots, "node", "left").select("key1", "key2", F.coalesce("root", "node").alias("class_uid"))
    named = base.materialize(named, "classes")
    members = sets.select("uid", "doc_id", "key1", "key2").join(named, ["key1", "key2"]).select("uid", "doc_id", "class_uid")
    members = base.materialize(members, "members")
    heads = base.materialize(members.groupBy("class_uid").agg(F.count("*").alias("class_size"), F.min(F.struct("uid", "doc_id")).alias("head")), "heads")
    base.discard(sets, nodes, found, pairs, links, more, first, more_of, named, *([] if uid else [narrow]))
    out = members.join(heads, "class_uid")
    return out.select("uid", "doc_id", F.col("head.doc_id").alias("class_id"), F.col("head.uid").alias("class_uid"), "class_size", (F.col("uid") == F.col("head.uid")).alias("representative"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, and all its columns.

    Of a class the first row stays. Nulls, empty texts, repeated rows and clashing names are
    handled as in ``near_duplicates``: all texts without words are one class.
    """
    uid = base.free_name(docs.columns)
    tagged = base.with_uid(docs, uid)
    gone = near_duplicates(tagged, uid, **how).filter(~F.col("representative")).select(F.col("uid").alias(uid))
    return tagged.join(gone, uid, "left_anti").drop(uid)
