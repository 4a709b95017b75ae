import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import base, blocknames, dartminhash, graph

from .conftest import ODD, corpus


def normal(t):
    return (t or "").encode().translate(None, b" \t\n\x0b\x0c\r")


@pytest.mark.parametrize("block", [3, 64, 4096])
@pytest.mark.parametrize("scope", [40, 1 << 20])
def test_block_naming_equals_grouping_by_text(spark, block, scope):
    docs = [(i, t if i % 3 else f" {t}\n") for i, t in corpus(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    groups = defaultdict(list)
    for i, t in docs:
        groups[normal(t)].append((-len(t), i))
    rows = blocknames.exact_duplicates(df, block_bytes=block, scope_bytes=scope).collect()
    assert len(rows) == len(docs)
    for r in rows:
        group = groups[normal(dict(docs)[r.doc_id])]
        assert (r.keep_id, r.group_size) == (min(group)[1], len(group))
        assert r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(normal(dict(docs)[r.doc_id])).hexdigest()


def test_block_naming_of_odd_rows(odd, empty):
    rows = blocknames.exact_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    for same in by.values():
        assert sum(r.kept for r in same) == 1 and {r.group_size for r in same} == {len(same)} and len({r.keep_id for r in same}) == 1
    blank = by[hashlib.sha256(b"").hexdigest()]
    assert {r.doc_id for r in blank} == {3, 4, 5} and blank[0].keep_id == 5
    assert by[hashlib.sha256(b"one").hexdigest()][0].keep_id == 9  # a null id comes last
    assert blocknames.exact_duplicates(empty).collect() == []
    kept = blocknames.drop_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(by)


def test_tables_that_are_read_once_are_not_written(spark, monkeypatch):
    written, write = [], base.materialize
    monkeypatch.setattr(base, "materialize", lambda df, name: written.append(name) or write(df, name))
    docs = spark.createDataFrame([*corpus(60), (60, "x" * 700), (61, "x" * 700)], "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in blocknames.exact_duplicates(docs, block_bytes=256).collect()}
    assert (rows[60].group_size, rows[61].keep_id, rows[61].kept) == (2, 60, False)
    assert written == ["blocks", "level0", "level1", "level2", "identities", "texts"]


def test_row_numbers_are_steady(spark, odd, tmp_path):
    """A scan of files is numbered as it is; rows that may be dealt anew are written first."""
    spark.range(1000).repartition(7).write.parquet(f"{tmp_path}/t")
    scan = spark.read.parquet(f"{tmp_path}/t")
    assert base.with_uid(scan).inputFiles() and set(base.with_uid(scan.filter("id > 3")).inputFiles()) <= set(scan.inputFiles())
    for dealt in (scan.repartition(3, F.rand()), scan.withColumn("x", F.rand()), odd):
        tagged = base.with_uid(dealt)
        assert tagged.inputFiles() and not set(tagged.inputFiles()) & set(scan.inputFiles())
        assert sorted(map(str, tagged.collect())) == sorted(map(str, tagged.collect()))
    assert spark.conf.get(base.SPLITS)
    assert base.free_name(odd.columns) == "___uid"


def test_kept_rows_keep_clashing_columns(odd):
    for kept in (blocknames.drop_duplicates(odd), dartminhash.keep_one(odd)):
        assert kept.schema == odd.schema and {(r["_uid"], r["__uid"], r["h"]) for r in kept.collect()} == {("u", None, 7)}


def sets_of(t):
    """Shingles with how often they occur."""
    w = (t or "").encode().lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    """Weighted Jaccard: lesser weights over greater ones."""
    return (a & b).total() / (a | b).total()


def brute_classes(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [sets_of(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_classes_equal_brute_force(spark):
    docs = corpus(300, seed=4, low=20, high=90)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = dartminhash.near_duplicates(df).collect()
    want = brute_classes([t for _, t in docs])
    mine = {r.doc_id: r.class_uid for r in rows}
    pairs = {(want[i], mine[i]) for i in range(len(docs))}
    assert len(pairs) == len(set(want)) == len(set(mine.values()))
    for r in rows:
        assert r.class_size == list(mine.values()).count(r.class_uid)
    assert sum(r.representative for r in rows) == len(set(want))


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(2)
    first = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    docs = []
    for i in range(400):
        words = list(first)
        words[rng.randrange(300)] = f"x{i}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = dartminhash.near_duplicates(df, block=16).collect()
    assert {r.class_size for r in rows} == {400}


def test_weights_decide_links(spark):
    """Texts with one set of shingles and other counts, and texts of repeated lines."""
    rng = random.Random(6)
    docs = []
    for i in range(60):
        lines = [" ".join(f"l{i}x{j}w{k}" for k in range(12)) for j in range(6)]
        for copy in range(6):
            times = [rng.choice([1, 1, 2, 3, 5, 9]) if copy % 2 else 2 for _ in lines]
            docs.append(" ".join(x for x, n in zip(lines, times) for x in [x] * n))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    rows = dartminhash.near_duplicates(df).collect()
    want = brute_classes(docs)
    mine = {r.doc_id: r.class_uid for r in rows}
    assert len({(want[i], mine[i]) for i in mine}) == len(set(want)) == len(set(mine.values()))
    sets = [frozenset(sets_of(t)) for t in docs]
    assert any(sets[i] == sets[j] and want[i] != want[j] for i in range(len(docs)) for j in range(i))


@pytest.mark.parametrize("wide", [7, 1000])
def test_second_pass_compares_all_blocks(spark, monkeypatch, wide):
    """Rows of many classes in one bucket, one class with half of all rows: all links between classes are told."""
    monkeypatch.setattr(dartminhash, "WIDE", wide)
    rng = random.Random(2)
    texts: list[str] = []
    for i in range(90):
        words = rng.choice(texts).split() if i % 3 and texts else [f"t{i}w{j}" for j in range(100)]
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        texts.append(" ".join(words))
    cls = [i if i % 2 else -1 for i in range(90)]
    sets = [sets_of(t) for t in texts]
    rows = spark.createDataFrame([(7, i, sets[i].total(), cls[i]) for i in range(90)], "bh long, uid long, n int, class long").repartition(3)
    got = {(r.a, r.b) for r in dartminhash._rest(rows, spark.createDataFrame(list(enumerate(texts)), "_uid long, text string"), 0.8, 5).collect()}
    want = {(i, j) for j in range(90) for i in range(j) if cls[i] != cls[j] and similarity(sets[i], sets[j]) >= 0.8}
    assert got <= want and len(want) > 15

    def joined(pairs):
        root = {c: c for c in cls}

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        for a, b in pairs:
            root[find(cls[a])] = find(cls[b])
        return {frozenset(c for c in root if find(c) == r) for r in map(find, root)}

    assert joined(got) == joined(want)


def test_scratch_tables_go(spark, odd):
    import os

    folder = base.scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = dartminhash.near_duplicates(odd)
    assert out.count() == len(ODD)
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"members", "heads"}


def just_under(groups, size, seed):
    """Groups whose texts share 200 shingles of 226 (0.794); of each, the first two share two more (0.808)."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        core = [f"g{g}c{rng.randrange(10**6)}" for _ in range(204)]
        for i in range(size):
            own = [f"g{g}i{i}t{rng.randrange(10**6)}" for _ in range(26)]
            if i < 2:
                own[:2] = [f"g{g}p", f"g{g}q"]
            texts.append(" ".join(core + own))
    return texts


@pytest.mark.parametrize("partitions", [1, 64])
def test_links_among_pairs_just_under_the_similarity(spark, partitions):
    """Every link is found however many pairs of its bucket look more alike, or lie across a border."""
    groups, size = 12, 90
    texts = just_under(groups, size, 5)
    sets = [sets_of(t) for t in texts[:3]]
    assert [similarity(a, b) >= 0.8 for a, b in ((sets[0], sets[1]), (sets[0], sets[2]))] == [True, False]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = dartminhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    of = {r.doc_id: r.class_id for r in rows}
    assert {i for i in of if of[i] != i} == {g * size + 1 for g in range(groups)}
    assert all(of[g * size + 1] == g * size for g in range(groups))


def test_a_bucket_over_several_ranges_is_one(spark):
    """All texts share their only band; ranges of a few rows each cut it."""
    docs = [(i, " ".join([f"w{j}" for j in range(100)] + [f"x{i}"])) for i in range(20)]
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = dartminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), bands=1, rows=1).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.class_size for r in rows} == {20}


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = dartminhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    want = brute_classes([r[1] for r in ODD])
    assert len({r.class_uid for r in rows}) == len(set(want))
    blank = {r.class_uid for r in rows if r.doc_id in (3, 4, 5)}
    assert len(blank) == 1
    assert dartminhash.near_duplicates(empty).collect() == []
    kept = dartminhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(want))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 80, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for scale in (0.3, 1.0, 7.0):
            w = rng.random(80) * scale
            v = w * rng.random(80)
            s = dartminhash.dart_signatures(np.r_[h, h], np.repeat([0, 1], 80), np.r_[w, v], 2, 3000)
            assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04


def test_links_of_the_second_pass_join_classes_alone(spark):
    """Not the links of the first pass again: what the search for components is given is no more than the new links."""
    rng = random.Random(4)
    first = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    more = [(rng.randrange(90), rng.randrange(90)) for _ in range(25)]
    frame = lambda rows: spark.createDataFrame([(min(r), max(r)) for r in rows if r[0] != r[1]], "a long, b long")
    want = {r.node: r.root for r in graph.components(frame(first + more)).collect()}
    given, components = [], graph.components
    graph.components = lambda links: given.append(links.count()) or components(links)
    try:
        got = dartminhash._joined(components(frame(first)), frame(more))[0].collect()
    finally:
        graph.components = components
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert given == [frame(more).count()]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100}
