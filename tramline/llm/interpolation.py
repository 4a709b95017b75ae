"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates of all orders and of
the uniform distribution, with weights that depend on how often the longest context was seen,
in buckets of powers of two. The weights are learned by expectation-maximisation on a held-out
tenth of the training documents, with the counts of that tenth deleted from all estimates;
scores then use the counts of all training documents.

Distribution. Documents become blocks of tokens (a written table). Each block asks for the
counts of its own distinct n-grams: sorted arrays of 64-bit keys, one per bucket of the key
space, so what is shuffled is made of packed arrays and a frequent n-gram counts once per
block. A bucket adds up what all blocks sent and answers each in the order it asked. Blocks
then meet their answers and score their documents. What expectation-maximisation needs is a
table of log-probability bins, whose size is fixed by its grid while its counts cover every
held-out token; that table alone comes to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

ORDER = 2
FOLDS = 10
#: Of the folds of documents: the one that is never learned from, and the one that weights are learned on.
TEST_FOLD, WEIGHT_FOLD = 0, 9
BLOCK_TOKENS = 400_000
#: Keys that a bucket should hold.
BUCKET_KEYS = 1_500_000
BINS_PER_DECADE = 16
ITERATIONS = 60
ADD = 0.1

TRAIN, WEIGHT, TEST = 0, 1, 2
#: Fixed values that stand for the end of a document and for the place before its first token.
END, START = np.uint64(0x656E64), np.uint64(0x7374617274)
_G, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        return h ^ (h >> np.uint64(31))


def pack(a: np.ndarray) -> bytes:
    """Integers with their bytes put plane by plane, so that equal high bytes lie together."""
    width = a.dtype.itemsize
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T
    top = width
    while top > 1 and not planes[top - 1].any():
        top -= 1
    return bytes([top]) + planes[:top].tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    width, top = np.dtype(dtype).itemsize, data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(top, -1)
    out = np.zeros((planes.shape[1], width), dtype=np.uint8)
    out[:, :top] = planes.T
    return out.reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


_BLOCKS = "block long, cls int, n_docs long, n_tokens long, ids array<long>, lens binary, words binary, stream binary"


class _Block:
    def __init__(self):
        self.names: dict[bytes, int] = {}
        self.ids: list = []
        self.lens: list[int] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        names = self.names
        part = np.fromiter([names.setdefault(w, len(names)) for w in words], dtype=np.int64, count=len(words))
        self.ids.append(doc_id)
        self.lens.append(len(words) + 1)
        self.parts += [part, np.array([-1])]
        self.size += len(words) + 1

    def row(self, block: int, cls: int) -> pa.RecordBatch:
        hashes = np.append(np.fromiter(map(xxhash.xxh64_intdigest, self.names), dtype=np.uint64, count=len(self.names)), END)
        words, place = np.unique(hashes, return_inverse=True)
        stream = place[np.concatenate(self.parts)].astype(np.uint32)
        return pa.RecordBatch.from_pydict(
            {"block": [block], "cls": pa.array([cls], pa.int32()), "n_docs": [len(self.ids)], "n_tokens": [self.size], "ids": pa.array([self.ids], pa.list_(pa.int64())), "lens": pa.array([pack(np.array(self.lens, np.uint32))], pa.binary()), "words": pa.array([pack_sorted(words)], pa.binary()), "stream": pa.array([pack(stream)], pa.binary())}
        )


def _block_task(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: dict[int, _Block] = {}
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary())):
                fold = fold_of(doc_id)
                cls = TEST if fold == TEST_FOLD else WEIGHT if fold == WEIGHT_FOLD else TRAIN
                block = held.setdefault(cls, _Block())
                block.add(doc_id, (text.as_py() or b"").lower().split())
                if block.size >= size:
                    yield block.row(number, cls)
                    number += 1
                    del held[cls]
        for cls, block in sorted(held.items()):
            yield block.row(number, cls)
            number += 1

    return run


def grams(words: np.ndarray, stream: np.ndarray, lens: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, for n from 1 to ``order``."""
    tokens = words[stream]
    first = np.zeros(len(stream), dtype=np.int64)
    starts = np.cumsum(lens) - lens
    first[starts] = 1
    place = np.arange(len(stream)) - np.repeat(starts, lens)
    out = [tokens]
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            key = np.full(len(stream), n, dtype=np.uint64)
            for back in range(n - 1, -1, -1):
                prev = np.where(place >= back, tokens[np.maximum(np.arange(len(stream)) - back, 0)], START)
                key = _mix(key * _G + prev)
            out.append(key)
    return out


def _unique(block: dict, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Lengths of documents, then by order: distinct keys, place of each token's key, counts."""
    lens = unpack(block["lens"], np.uint32).astype(np.int64)
    words, stream = unpack_sorted(block["words"]), unpack(block["stream"], np.uint32)
    keys, places, counts = [words], [stream.astype(np.int64)], [np.bincount(stream, minlength=len(words))]
    for key in grams(words, stream, lens, order)[1:]:
        u, inverse, c = np.unique(key, return_inverse=True, return_counts=True)
        keys.append(u)
        places.append(inverse)
        counts.append(c)
    return lens, keys, places, counts


_ASK = "bucket int, kind int, block long, cls int, keys binary, counts binary"


def _ask_task(order: int, bits: int):
    """Rows of one block, kind and bucket that holds a key of the block: never more than it has distinct keys,
    however fine the buckets, so that rows and work grow with the tokens and not with blocks times buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                block = b.slice(row, 1).to_pylist()[0]
                _, keys, _, counts = _unique(block, order)
                out = []
                for kind, (k, c) in enumerate(zip(keys, counts)):
                    buckets, starts = np.unique(k >> np.uint64(64 - bits) if bits else np.zeros(len(k), np.uint64), return_index=True)
                    ends = [*starts[1:].tolist(), len(k)]
                    c = c.astype(np.uint32)
                    out += [(i, kind, block["block"], block["cls"], pack_sorted(k[a:z]), pack(c[a:z])) for i, a, z in zip(buckets.tolist(), starts.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "kind", "block", "cls", "keys", "counts"])

    return run


_ANSWER = "block long, cls int, bucket int, kind int, counts binary, without binary, known long"
_ANSWER_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
#: The block number of the row that tells how many keys of a bucket were seen in training.
NOBODY = -1


def _answer(asked: pa.Table) -> pa.Table:
    rows = asked.to_pylist()
    parts = [unpack_sorted(r["keys"]) for r in rows]
    cuts = np.cumsum([0, *map(len, parts)])
    keys, place = np.unique(np.concatenate(parts), return_inverse=True)
    total, held = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for r, a, z in zip(rows, cuts, cuts[1:]):
        if r["cls"] != TEST:  # the keys of one row are distinct
            c = unpack(r["counts"], np.uint32)
            total[place[a:z]] += c
            if r["cls"] == WEIGHT:
                held[place[a:z]] += c
    out = [(NOBODY, TRAIN, rows[0]["bucket"], rows[0]["kind"], None, None, int((total > 0).sum()))]
    for r, a, z in zip(rows, cuts, cuts[1:]):
        t = total[place[a:z]]
        less = pack((t - held[place[a:z]]).astype(np.uint64)) if r["cls"] == WEIGHT else None
        out.append((r["block"], r["cls"], r["bucket"], r["kind"], pack(t.astype(np.uint64)), less, None))
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), _ANSWER_TYPES)], names=[x.split()[0] for x in _ANSWER.split(", ")])


def _gathered(answers: pa.Table, order: int, column: str) -> list[np.ndarray]:
    """By order: the counts of a block's distinct keys, in their order."""
    found: list[list[tuple[int, bytes]]] = [[] for _ in range(order)]
    for kind, bucket, data in zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column(column).to_pylist()):
        found[kind].append((bucket, data))
    return [np.concatenate([unpack(d, np.uint64) for _, d in sorted(f)]).astype(np.int64) for f in found]


def _token_counts(block: dict, counts: list[np.ndarray], places: list[np.ndarray], lens: np.ndarray, documents: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each token, by order: the count of its n-gram and of that n-gram's context."""
    own = [c[p] for c, p in zip(counts, places)]
    starts = np.cumsum(lens) - lens
    contexts = []
    for n in range(1, len(own)):
        context = np.empty_like(own[n])
        context[1:] = own[n - 1][:-1]
        context[starts] = documents
        contexts.append(context)
    return own, contexts


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 plus the whole part of its count's binary logarithm."""
    return np.where(context > 0, np.frexp(np.maximum(context, 1).astype(np.float64))[1], 0)


def estimates(own: list[np.ndarray], contexts: list[np.ndarray], tokens: int, words: int) -> np.ndarray:
    """Rows: uniform, then maximum-likelihood estimates from order 1 up; columns: tokens."""
    rows = [np.full(len(own[0]), 1 / (words + 1)), own[0] / max(tokens, 1)]
    rows += [np.divide(o, c, out=np.zeros(len(o)), where=c > 0) for o, c in zip(own[1:], contexts)]
    return np.array(rows)


def _bin_task(order: int, tokens: int, words: int, documents: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bins: dict[tuple, int] = {}
        for block in left.to_pylist():
            lens, _, places, _ = _unique(block, order)
            own, contexts = _token_counts(block, _gathered(right, order, "without"), places, lens, documents)
            p = estimates(own, contexts, tokens, words)
            with np.errstate(divide="ignore"):
                grid = np.where(p[1:] > 0, np.round(np.log10(p[1:] / p[0]) * BINS_PER_DECADE), -10_000).astype(np.int64)
            rows = np.vstack([bucket_of(contexts[-1] if contexts else own[0]), grid]).T
            kinds, n = np.unique(rows, axis=0, return_counts=True)
            for k, c in zip(map(tuple, kinds.tolist()), n.tolist()):
                bins[k] = bins.get(k, 0) + c
        return pa.table({"bin": pa.array([list(k) for k in bins], pa.list_(pa.int64())), "n": pa.array(list(bins.values()), pa.int64())})

    return run


def learn_weights(bins: list[tuple[list[int], int]], order: int, iterations: int = ITERATIONS) -> dict[int, list[float]]:
    """Mixture weights by context bucket; -1 has those of all tokens, for buckets without any."""
    out: dict[int, list[float]] = {}
    flat = [1 / (order + 1)] * (order + 1)
    for bucket in [-1, *sorted({b[0] for b, _ in bins})]:
        mine = [(b[1:], n) for b, n in bins if bucket in (-1, b[0])]
        if not mine:
            out[bucket] = flat
            continue
        ratio = np.array([[1.0, *(0.0 if x <= -10_000 else 10 ** (x / BINS_PER_DECADE) for x in b)] for b, _ in mine])
        n = np.array([c for _, c in mine], dtype=np.float64)
        w = np.array(flat)
        for _ in range(iterations):
            part = ratio * w
            part /= part.sum(axis=1, keepdims=True)
            w = n @ part / n.sum()
        w = (w * n.sum() + 0.01) / (w * n.sum() + 0.01).sum()  # no weight is nought: every token has a probability
        out[bucket] = w.tolist()
    return out


def _score_task(order: int, tokens: int, words: int, documents: int, weights: dict[int, list[float]]):
    table = np.array([weights.get(b, weights[-1]) for b in range(66)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "n_known", "base_score", "score")}
        for block in left.to_pylist():
            lens, _, places, _ = _unique(block, order)
            own, contexts = _token_counts(block, _gathered(right, order, "counts"), places, lens, documents)
            p = estimates(own, contexts, tokens, words)
            w = table[bucket_of(contexts[-1] if contexts else own[0])]
            starts = np.cumsum(lens) - lens
            plain = np.log10((own[0] + ADD) / (tokens + ADD * (words + 1)))
            out["doc_id"] += block["ids"]
            out["n_tokens"] += lens.tolist()
            out["n_known"] += np.add.reduceat((own[0] > 0).astype(np.int64), starts).tolist()
            out["base_score"] += np.add.reduceat(plain, starts).tolist()
            out["score"] += np.add.reduceat(np.log10((w.T * p).sum(axis=0)), starts).tolist()
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), **{k: pa.array(out[k], t) for k, t in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))}})

    return run


def score(docs: DataFrame, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are runs without ASCII white space, A-Z lower-cased, and one end. Documents whose
    fold (crc32 of the id as text, modulo 10) is 0 are held out. ``score`` is the log10
    probability of the text under the mixture; ``base_score`` that of add-0.1 unigrams. Null
    texts count as empty (the end alone), null ids as the empty text for the fold; repeated rows
    each count and are each scored. Only doc_id and text are read. Tokens are told apart by a
    64-bit hash.
    """
    spark = docs.sparkSession
    base.ship_package(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = base.materialize(narrow.mapInArrow(_block_task(block_tokens), _BLOCKS), "tokens")
    sums = {r["cls"]: r for r in blocks.groupBy("cls").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t")).collect()}
    of = lambda cls, k: sums[cls][k] if cls in sums else 0
    all_tokens, n_train, d_train = sum(r["t"] for r in sums.values()), of(TRAIN, "t") + of(WEIGHT, "t"), of(TRAIN, "d") + of(WEIGHT, "d")

    bits = max(0, int(np.ceil(np.log2(max(1, all_tokens / bucket_keys)))))
    asked = blocks.mapInArrow(_ask_task(order, bits), _ASK)
    answers = base.materialize(asked.groupBy("bucket", "kind").applyInArrow(_answer, _ANSWER), "counts")
    vocabulary = answers.filter((F.col("block") == NOBODY) & (F.col("kind") == 0)).agg(F.sum("known")).first()[0] or 0

    weight_blocks, weight_answers = (t.filter(F.col("cls") == WEIGHT) for t in (blocks, answers.filter(F.col("block") != NOBODY)))
    bins = weight_blocks.groupBy("block").cogroup(weight_answers.groupBy("block")).applyInArrow(_bin_task(order, of(TRAIN, "t"), vocabulary, of(TRAIN, "d")), "bin array<long>, n long")
    grid = bins.groupBy("bin").agg(F.sum("n").alias("n")).collect()  # as many rows as the grid has bins, at most
    weights = learn_weights([(r["bin"], r["n"]) for r in grid], order)

    scored = blocks.groupBy("block").cogroup(answers.filter(F.col("block") != NOBODY).groupBy("block")).applyInArrow(_score_task(order, n_train, vocabulary, d_train, weights), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (base.id_fold(F.col("doc_id"), FOLDS) == TEST_FOLD).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
