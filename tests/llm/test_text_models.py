import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tramline.llm import editmatch, interpolation, subwords

from .conftest import ODD, corpus


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert editmatch.myers(editmatch.masks(item), len(item), text)[0] == edit_distance_in(item, text)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    docs = dict(corpus(60, seed=7, low=30, high=60))
    items = [(i, " ".join(rng.choice(docs[i]).join(["", ""]) or "x" for _ in range(3)) + docs[i][20:160].upper()) for i in range(20)]
    for i in range(20, 40):
        item = list(items[i % 20][1].lower())
        for _ in range(i - 20):
            item[rng.randrange(len(item))] = rng.choice("abxyz ")
        docs[i] = docs[i][:50] + " " + "".join(item) + " " + docs[i][50:]
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame([*items, (98, None), (99, "  ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in editmatch.find_leaks(d, b, block_chars=600).collect()}
    want = {}
    for i, text in docs.items():
        for j, item in items:
            item = editmatch.normalize(item)
            distance = edit_distance_in(item, editmatch.normalize(text))
            if distance <= int(len(item) * editmatch.ERROR_RATE):
                want[i, j] = distance
    assert got == want and len(want) > 10
    clean = {r.doc_id for r in editmatch.decontaminate(d, b).collect()}
    assert clean == set(docs) - {i for i, _ in want}


def test_leaks_of_odd_rows(spark, odd, empty):
    b = spark.createDataFrame([(1, "Quick  brown fox jumps over"), (1, "Quick  brown fox jumps over"), (None, "no id at all")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0, r.distance) for r in editmatch.find_leaks(odd, b).collect())
    assert got == [(0, 0, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0), (2, 1, 0)]
    kept = editmatch.decontaminate(odd, b)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3
    none = spark.createDataFrame([], "item_id long, text string")
    assert editmatch.find_leaks(odd, none).collect() == [] and editmatch.decontaminate(odd, none).count() == len(ODD)
    assert editmatch.find_leaks(empty, b).collect() == []


def quality_rows(n):
    rng = random.Random(9)
    rows = []
    for i, t in corpus(n, seed=11, low=20, high=80):
        good = rng.random() < 0.7
        words = t.split()
        rows.append((i, t if good else " ".join(w + rng.choice(["%%%", "###", "&&&"]) for w in words), int(good)))
    return rows


def test_quality_on_held_out_rows(spark, odd, empty):
    rows = quality_rows(700)
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = subwords.fit(d, labels)
    scores = {r.doc_id: r.score for r in subwords.score(d, model).collect()}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scores[i] >= 0.3) == q for i, q in held) / len(held) > 0.97
    assert {r.doc_id for r in subwords.keep_good(d, model).collect()} == {i for i, s in scores.items() if s >= 0.3}
    out = subwords.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (3, 4, 5)}) == 1
    assert subwords.score(empty, model).collect() == []


def test_quality_ignores_held_out_labels(spark):
    rows = quality_rows(120)
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in rows]
    a = subwords.fit(d, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    b = subwords.fit(d, spark.createDataFrame(flip, "doc_id long, quality int"))
    assert np.array_equal(a.table, b.table) and a.bias == b.bias


def test_quality_of_one_class_or_no_rows():
    assert subwords.Scorer(subwords.train([], [])).scores(["a b"])[0] == pytest.approx(0.5)
    assert subwords.Scorer(subwords.train(["a"], [1])).scores(["a b", ""]).min() > 0.5


def plain_features(text, bits=subwords.BITS):
    """Shares of a document's buckets, feature by feature."""
    one = lambda h: int(subwords._bucket(np.array([h], np.uint64), bits)[0])
    words, found = text.split(), Counter()
    for w in words:
        found[one(subwords.hash_of(w))] += 1
        marked = f"<{w}>"
        for n in subwords.ORDERS:
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = (h * 1000003 + ord(c) + 1) % 2**64
                found[one(h)] += 1
    mixed = lambda h: int(subwords._mix(np.array([h % 2**64], np.uint64))[0])
    for a, b in zip(words, words[1:]):
        found[one((mixed(subwords.hash_of(a)) + subwords.hash_of(b)) % 2**64)] += 1
        for i, n in enumerate(subwords.SIDES):
            found[one((mixed(subwords.hash_of(a[-n:]) + i + 1) + subwords.hash_of(b[:n])) % 2**64)] += 1
    return {f: c / sum(found.values()) for f, c in found.items()}


ODD_TEXTS = ["a bb  a\tccc", "", "日本語 テキスト 日本語", "The The the", "x" * 3000, "é\u00a0è \U0001f600"]


def test_features_and_scores_equal_brute_force():
    docs = subwords.document_features(ODD_TEXTS, subwords.BITS)
    for text, (feats, share) in zip(ODD_TEXTS, docs):
        want = plain_features(text)
        assert dict(zip(feats.tolist(), share)) == pytest.approx(want, rel=1e-5)
    model = subwords.train(ODD_TEXTS, [1, 0, 1, 0, 1, 0])
    want = [1 / (1 + math.exp(-(model.bias + sum(model.table[f] * v for f, v in plain_features(t).items())))) for t in ODD_TEXTS]
    assert subwords.Scorer(model, cache_words=2).scores(ODD_TEXTS) == pytest.approx(want, rel=1e-4)
    one = subwords.Scorer(model, cache_chars=1)
    assert [one.scores([t])[0] for t in ODD_TEXTS] == pytest.approx(want, rel=1e-4)


def test_a_step_follows_the_gradient_of_the_loss():
    rng = np.random.default_rng(1)
    vec, out, bias = rng.normal(size=(7, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    docs = [(np.array([0, 2, 5]), np.array([0.5, 0.25, 0.25])), (np.array([1, 2]), np.array([0.9, 0.1])), (np.array([], int), np.array([]))]
    y = np.array([1, 0, 1])

    def loss(vec, out, bias):
        total = 0.0
        for (feats, share), label in zip(docs, y):
            z = sum((s * vec[f] for f, s in zip(feats, share)), np.zeros(3)) @ out + bias
            total += math.log(np.exp(z).sum()) - z[label]
        return total / len(y)

    by_hidden, by_out, by_bias = subwords.gradients(vec, out, bias, docs, y)
    by_vec = np.zeros_like(vec)
    for (feats, share), g in zip(docs, by_hidden):
        by_vec[feats] += share[:, None] * g
    for i, (array, grad) in enumerate(((vec, by_vec), (out, by_out), (bias, by_bias))):
        for at in np.ndindex(array.shape):
            around = []
            for d in (1e-5, -1e-5):
                moved = [vec.copy(), out.copy(), bias.copy()]
                moved[i][at] += d
                around.append(loss(*moved))
            assert grad[at] == pytest.approx((around[0] - around[1]) / 2e-5, abs=1e-6)
    after = [vec.copy(), out.copy(), bias.copy()]
    subwords.step(*after, docs, y, np.float32(0.01))
    assert loss(*after) < loss(vec, out, bias)


def test_quality_with_repeated_ids_and_empty_tables(spark, empty):
    rows = quality_rows(150)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    twice = [(i, t) for i, t, _ in rows] + [(i, f"{t} again") for i, t, _ in rows[:50]] + [(1, None)]
    found = [subwords.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels) for n, rows in ((1, twice), (5, twice[::-1]))]
    assert np.array_equal(found[0].table, found[1].table)
    none = subwords.fit(empty, labels)
    assert none.bias == 0 and not none.table.any() and not subwords.fit(empty, labels.limit(0)).table.any()
    assert subwords.keep_good(empty, none).collect() == []


def brute_lm(docs, order):
    end, start = b"\0end", b"\0start"
    toks = [[*(t or "").encode().lower().split(), end] for _, t in docs]
    fold = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 for i, _ in docs]

    def counts(keep):
        c = [Counter() for _ in range(order)]
        n_docs = 0
        for t, f in zip(toks, fold):
            if not keep(f):
                continue
            n_docs += 1
            for j in range(len(t)):
                for n in range(1, order + 1):
                    c[n - 1][tuple(t[j - b] if j - b >= 0 else start for b in range(n - 1, -1, -1))] += 1
        return c, n_docs

    def parts(t, c, n_docs, total, v):
        for j in range(len(t)):
            p, context = [1 / (v + 1)], 0
            for n in range(1, order + 1):
                gram = tuple(t[j - b] if j - b >= 0 else start for b in range(n - 1, -1, -1))
                if n == 1:
                    p.append(c[0][gram] / max(total, 1))
                    context = c[0][gram]
                else:
                    prefix = gram[:-1]
                    context = n_docs if j == 0 else c[n - 2][prefix]
                    p.append(c[n - 1][gram] / context if context else 0.0)
            yield p, (context.bit_length() if context else 0)

    full, n_full = counts(lambda f: f != 0)
    deleted, n_del = counts(lambda f: f not in (0, 9))
    total, total_del, v = sum(full[0].values()), sum(deleted[0].values()), len(full[0])
    data = [x for t, f in zip(toks, fold) if f == 9 for x in parts(t, deleted, n_del, total_del, v)]
    weights = {}
    for bucket in [-1, *{b for _, b in data}]:
        rows = np.array([p for p, b in data if bucket in (-1, b)])
        w = np.full(order + 1, 1 / (order + 1))
        for _ in range(interpolation.ITERATIONS):
            q = rows * w
            w = (q / q.sum(axis=1, keepdims=True)).mean(axis=0)
        w = (w * len(rows) + 0.01) / (w * len(rows) + 0.01).sum()
        weights[bucket] = w
    base = [sum(math.log10((full[0][(w,)] + 0.1) / (total + 0.1 * (v + 1))) for w in t) for t in toks]
    score = [sum(math.log10(np.dot(weights.get(b, weights[-1]), p)) for p, b in parts(t, full, n_full, total, v)) for t in toks]
    return base, score, total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_interpolation_equals_brute_force(spark, order):
    docs = corpus(150, seed=13, low=5, high=40)
    base, score, total = brute_lm(docs, order)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = sorted(interpolation.score(df, order=order, block_tokens=300, bucket_keys=500).collect())
    assert {r.train_tokens for r in rows} == {total}
    assert np.allclose([r.base_score for r in rows], base, atol=1e-9)
    assert np.allclose([r.score for r in rows], score, rtol=0.01)  # bins of log probability
    assert [r.held_out for r in rows] == [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]


def test_interpolation_of_odd_rows(odd, empty):
    rows = interpolation.score(odd).collect()
    assert len(rows) == len(ODD) and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert interpolation.score(empty).collect() == []


def test_packed_integers():
    for a in (np.zeros(0, np.uint64), np.array([1, 300, 2**40], np.uint64), np.array([7], np.uint64)):
        assert interpolation.unpack(interpolation.pack(a), np.uint64).tolist() == a.tolist()
        assert interpolation.unpack_sorted(interpolation.pack_sorted(a)).tolist() == a.tolist()


@pytest.mark.parametrize("bits", [0, 8, 12, 16, 24])
def test_rows_asked_stay_within_the_keys_of_a_block(bits):
    """However fine the buckets: one row per bucket that holds a key, all keys and counts in them."""
    block = interpolation._Block()
    for i in range(40):
        block.add(i, [b"w%d" % (j * j % 997) for j in range(i * 10)])
    batch = block.row(3, interpolation.TRAIN)
    _, keys, _, counts = interpolation._unique(batch.to_pylist()[0], 2)
    rows = [r for b in interpolation._ask_task(2, bits)(iter([batch])) for r in b.to_pylist()]
    assert len(rows) <= min(2 << bits, sum(map(len, keys)))
    for kind in (0, 1):
        mine = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["bucket"])
        parts = [interpolation.unpack_sorted(r["keys"]) for r in mine]
        assert np.array_equal(np.concatenate(parts), keys[kind])
        assert np.array_equal(np.concatenate([interpolation.unpack(r["counts"], np.uint32) for r in mine]), counts[kind])
        assert all(int(k) >> (64 - bits) == r["bucket"] for r, p in zip(mine, parts) for k in p)
