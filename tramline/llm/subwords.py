"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its words, of its pairs of neighbouring words
and of its character n-grams, those across the space between two words among them; vectors
live in a hashed table. A softmax layer over the average gives the score. Both are trained
together by stochastic gradient descent in numpy, on a bounded, documented number of labelled
rows.

At scoring time the output is linear in the average, so each bucket of the table needs one
number (its vector times the difference of the two output rows). That table, a megabyte
whatever the input, is broadcast; documents are scored where they are read, over their whole
text. Words are runs without white space, as Python splits them; case counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Labelled rows that training uses at most: those with the smallest hash of their id.
SAMPLE_ROWS = 4000
BITS = 18
DIM = 8
#: Lengths of character n-grams.
ORDERS = (3,)
EPOCHS = 6
RATE = 1.0
BATCH = 32
#: Words, and their characters, that a task keeps the features of before it begins anew.
CACHE_WORDS, CACHE_CHARS = 300_000, 20_000_000

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * _MUL


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(h * _MUL) >> np.uint64(64 - bits)).astype(np.int32)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))


def word_features(words: list[str], bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, each with its character n-grams, and the number of the word of each bucket."""
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    data = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(data))
    found, owners = [_bucket(word_hashes(words), bits)], [np.arange(len(words))]
    with np.errstate(over="ignore"):
        for n in orders:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, dtype=np.uint64)
            for i in range(n):
                h = h * np.uint64(1000003) + data[at + i]
            found.append(_bucket(h, bits))
            owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners)


#: Characters on either side of a space in the n-grams that cross it.
SIDES = (1, 2)


def word_parts(words: list[str]) -> np.ndarray:
    """For each word: its hash, then the codes of its last and of its first characters for each of ``SIDES``."""
    code = lambda texts: np.fromiter(map(hash_of, texts), dtype=np.uint64, count=len(words))
    return np.stack([word_hashes(words), *(code(w[-n:] for w in words) for n in SIDES), *(code(w[:n] for w in words) for n in SIDES)])


@lru_cache(1 << 16)
def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def pair_buckets(parts: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of each word with the next one, and of the n-grams across the space between, from
    the parts (columns) of the words in their order."""
    k = len(SIDES)
    with np.errstate(over="ignore"):
        found = [_mix(parts[0, :-1]) + parts[0, 1:]]
        found += [_mix(parts[1 + i, :-1] + np.uint64(i + 1)) + parts[1 + k + i, 1:] for i in range(k)]
        return _bucket(np.concatenate(found), bits)


def document_features(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document its distinct buckets and their shares, which add up to 1."""
    names: dict[str, int] = {}
    ids = [np.array([names.setdefault(w, len(names)) for w in t.split()], dtype=np.int64) for t in texts]
    feats, owner = word_features(list(names), bits)
    feats, n = feats[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(names))
    starts, parts, out = np.cumsum(n) - n, word_parts(list(names)), []
    for mine in ids:
        words, times = np.unique(mine, return_counts=True)
        k = n[words]
        within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        pairs = pair_buckets(parts[:, mine], bits)
        buckets, place = np.unique(np.append(feats[np.repeat(starts[words], k) + within], pairs), return_inverse=True)
        weight = np.bincount(place, np.append(np.repeat(times, k), np.ones(len(pairs))))
        out.append((buckets, (weight / max(weight.sum(), 1)).astype(np.float32)))
    return out


@dataclass
class Model:
    """One number per bucket and the bias of class 1 over class 0."""

    table: np.ndarray
    bias: float
    bits: int


#: How much further than the rest a step moves the vectors of features (the average of many
#: vectors is small, and so are its gradients), the output layer and the bias.
VECTOR_GAIN, OUT_GAIN, BIAS_GAIN = np.float32(200.0), np.float32(4.0), np.float32(0.2)


def gradients(vec: np.ndarray, out: np.ndarray, bias: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the mean cross entropy of some documents (features and shares each): of each
    document's average, of ``out`` and of ``bias``. A feature's vector gets its share of the first."""
    hidden = np.array([share @ vec[feats] for feats, share in docs])
    z = hidden @ out + bias
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= np.float32(len(y))
    return p @ out.T, hidden.T @ p, p.sum(axis=0)


def step(vec: np.ndarray, out: np.ndarray, bias: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, lr: np.float32) -> None:
    """One step of gradient descent, in place."""
    by_hidden, by_out, by_bias = gradients(vec, out, bias, docs, y)
    out -= lr * OUT_GAIN * by_out
    bias -= lr * BIAS_GAIN * by_bias
    for (feats, share), g in zip(docs, lr * VECTOR_GAIN * by_hidden):
        vec[feats] -= share[:, None] * g  # the features of a document are distinct


def train(texts: list[str], labels: list[int], *, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Fit by minibatch gradient descent; the same rows give the same model.

    Without rows, or with rows of one class only, the model scores by the smoothed share of class 1.
    """
    y = np.asarray(labels, dtype=np.int64)
    ones = int(y.sum())
    if ones in (0, len(y)):
        return Model(np.zeros(1 << bits, np.float32), float(np.log((ones + 1) / (len(y) - ones + 1))), bits)
    rng = np.random.default_rng(seed)
    docs = document_features(texts, bits)
    # Buckets in use, renumbered, keep the table small while training.
    used = np.unique(np.concatenate([d[0] for d in docs]))
    docs = [(np.searchsorted(used, feats), share) for feats, share in docs]
    vec = ((rng.random((len(used), dim)) - 0.5) / dim).astype(np.float32)
    out = ((rng.random((dim, 2)) - 0.5) * 2).astype(np.float32)
    bias = np.log(np.array([len(y) - ones, ones]) / len(y)).astype(np.float32)
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            lr = np.float32(rate * max(0.05, 1 - done / steps))
            done += len(rows)
            step(vec, out, bias, [docs[r] for r in rows], y[rows], lr)
    table = np.zeros(1 << bits, np.float32)
    table[used] = vec @ (out[:, 1] - out[:, 0])
    return Model(table, float(bias[1] - bias[0]), bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, fold: int = 5) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts outside the held-out fold, chosen by the hash of the id.

    Labels of one id count as their rounded mean; null labels and ids are left out. Where an
    id has several texts, the first of them in the order of their bytes counts, null as empty.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).filter("doc_id is not null and q is not null")
    known = known.filter(base.id_fold(F.col("doc_id"), fold) != 0)
    known = known.groupBy("doc_id").agg(F.round(F.avg("q")).cast("int").alias("label"))
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows).select("doc_id", "label")
    # At most ``rows`` narrow rows: their size is proven, so they may be sent to all tasks.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["label"]) for r in sorted(got, key=lambda r: r["doc_id"])]


class Scorer:
    """Scores texts; keeps the sums of words it has met, up to a bound."""

    def __init__(self, model: Model, cache_words: int = CACHE_WORDS, cache_chars: int = CACHE_CHARS):
        self.model, self.cache_words, self.cache_chars = model, cache_words, cache_chars
        self.reset()

    def reset(self) -> None:
        self.names: dict[str, int] = {}
        self.chars = 0
        self.sums, self.counts, self.parts = np.zeros(0), np.zeros(0), np.zeros((1 + 2 * len(SIDES), 0), np.uint64)

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.names) > self.cache_words or self.chars > self.cache_chars:
            self.reset()
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        new = sorted(set().union(*split).difference(self.names))
        if new:
            feats, owner = word_features(new, self.model.bits)
            self.names.update(zip(new, range(len(self.names), len(self.names) + len(new))))
            self.chars += sum(map(len, new))
            self.sums = np.append(self.sums, np.bincount(owner, self.model.table[feats], len(new)))
            self.counts = np.append(self.counts, np.bincount(owner, minlength=len(new)))
            self.parts = np.append(self.parts, word_parts(new), axis=1)
        total, out = np.zeros(len(split)), np.zeros(len(split))
        get = self.names.__getitem__
        for i, words in enumerate(split):
            if n[i]:
                ids = np.fromiter(map(get, words), dtype=np.int64, count=n[i])
                pairs = pair_buckets(self.parts[:, ids], self.model.bits)
                total[i] = self.counts[ids].sum() + len(pairs)
                out[i] = self.sums[ids].sum() + self.model.table[pairs].sum(dtype=np.float64)
        z = np.clip(np.divide(out, total, out=np.zeros(len(split)), where=total > 0) + self.model.bias, -60, 60)
        return 1 / (1 + np.exp(-z))


#: Characters of the texts that are scored at once.
BATCH_CHARS = 4_000_000


def _parts(whole: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch, each of at most 512 rows and, but for a longer text, a bounded size."""
    texts, start, size = [], 0, 0
    for i, text in enumerate(whole.column("text")):
        text = text.as_py() or ""
        if texts and (len(texts) == 512 or size + len(text) > BATCH_CHARS):
            yield whole.slice(start, len(texts)), texts
            texts, start, size = [], i, 0
        texts.append(text)
        size += len(text)
    if texts:
        yield whole.slice(start, len(texts)), texts


def _score_task(shared: Broadcast, threshold: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for part, texts in _parts(whole):
                scores = scorer.scores(texts)
                if threshold is None:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])
                else:
                    yield part.filter(pa.array(scores >= threshold))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: class 1 likelier) of every row; nothing but the text counts.

    Null texts count as empty; an empty text gets the score of the bias alone. Repeated rows
    each get a row.
    """
    base.ship_package(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_score_task(docs.sparkSession.sparkContext.broadcast(model), None), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns.

    Null texts count as empty, and are judged by the bias alone; repeated rows are each judged;
    an empty table stays empty. Only the column text is read, whatever others are called.
    """
    base.ship_package(docs.sparkSession)
    return docs.mapInArrow(_score_task(docs.sparkSession.sparkContext.broadcast(model), threshold), docs.schema)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, fold: int = 5) -> Model:
    sample = labelled_sample(docs, labels, rows, fold)
    return train([t for t, _ in sample], [y for _, y in sample])
