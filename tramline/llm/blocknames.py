"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed size. Equal blocks get one integer name, by sorting
them; then adjacent pairs of names are named in the same way, again and again, until each
text has a single name. Names stand for content itself, not for a digest of it, so two texts
share an identity exactly when they are equal.

Distribution. Each task first names its own blocks and texts (a dictionary of bounded size),
so what is shuffled has one row per block and task: a group of copies, however large, sends
at most one row per task to any key. Names then come back over keys that belong to one task.
Blocks are shuffled once; all later steps move integers. Every level is a written table; names,
which follow from the sorted rows alone, are read once, by the job that makes their level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: The characters that do not count: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 4096
#: Bytes of distinct blocks that a task's dictionary may hold before it begins another.
SCOPE_BYTES = 48 << 20

_SPLIT = "kind byte, scope long, rep int, lids array<int>, lid int, block binary, uid long, doc_id long, n_chars long, sha string"
_SPLIT_ARROW = pa.schema([("kind", pa.int8()), ("scope", pa.int64()), ("rep", pa.int32()), ("lids", pa.list_(pa.int32())), ("lid", pa.int32()), ("block", pa.binary()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.string())])


def _split_task(block_bytes: int, scope_bytes: int):
    """Documents to rows of three kinds: 0 a document, 1 a text new to its scope, 2 a block new to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = TaskContext.get().partitionId() << 24
        blocks: dict[bytes, int] = {}
        texts: dict[tuple, int] = {}
        held = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                n_chars = pc.fill_null(pc.utf8_length(part.column("text")), 0).to_pylist()
                raw = part.column("text").cast(pa.binary()).to_pylist()
                rows = []
                for uid, doc_id, text, n in zip(part.column("_uid").to_pylist(), part.column("doc_id").to_pylist(), raw, n_chars):
                    norm = (text or b"").translate(None, BLANKS)
                    if held > scope_bytes:
                        scope, held = scope + 1, 0
                        blocks.clear()
                        texts.clear()
                    lids = []
                    for i in range(0, len(norm), block_bytes):
                        block = norm[i : i + block_bytes]
                        lid = blocks.get(block)
                        if lid is None:
                            lid = blocks[block] = len(blocks)
                            held += len(block) + 100
                            rows.append((2, scope, None, None, lid, block, None, None, None, None))
                        lids.append(lid)
                    key = tuple(lids)
                    rep = texts.get(key)
                    if rep is None:
                        rep = texts[key] = len(texts)
                        held += 100 + 8 * len(lids)
                        rows.append((1, scope, rep, lids, None, None, None, None, None, None))
                    rows.append((0, scope, rep, None, None, None, uid, doc_id, n, hashlib.sha256(norm).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SPLIT_ARROW.types)], schema=_SPLIT_ARROW)

    return run


def _name_task(keys: list[str], keep: list[str]):
    """Sorted rows to names: a new integer wherever the key differs from the row before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_name = TaskContext.get().partitionId() << 40
        last, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, dtype=bool)
            first = tuple(b.column(k)[0].as_py() for k in keys)
            new[0] = last is None or first != last
            for k in keys:
                c = b.column(k)
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            names = base_name + n + np.cumsum(new)
            n += int(new.sum())
            last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(names, pa.int64())], names=[*keep, "name"])

    return run


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, scope_bytes: int = SCOPE_BYTES) -> DataFrame:
    """One row per document: uid, doc_id, n_chars, sha, and its identity (n_blocks, name).

    ``docs`` has ``_uid``, ``doc_id`` and ``text``; other columns are not read. Null texts
    count as empty; texts without a counted character have n_blocks 0 and name 0. Two rows
    have equal (n_blocks, name) exactly when their texts are equal without blanks.
    """
    base.ship_package(docs.sparkSession)
    narrow = docs.select("_uid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = base.materialize(narrow.mapInArrow(_split_task(block_bytes, scope_bytes), _SPLIT), "blocks")

    # Level 0: the blocks, one row per block and scope, sorted by content.
    blocks = cut.filter("kind = 2").select("scope", "lid", "block")
    named = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_name_task(["block"], ["scope", "lid"]), "scope long, lid int, name long")
    reps = cut.filter("kind = 1").select("scope", "rep", F.size("lids").alias("n_blocks"), "lids")
    flat = reps.select("scope", "rep", "n_blocks", F.posexplode("lids").alias("pos", "lid")).join(named.hint("merge"), ["scope", "lid"])
    level = base.materialize(_gather(flat), "level0")

    # Above: pairs of adjacent names, until one name is left.
    done = [reps.filter("n_blocks = 0").select("scope", "rep", "n_blocks", F.lit(0).cast("long").alias("name"))]
    for depth in range(1, 64):
        done.append(level.filter(F.size("names") == 1).select("scope", "rep", "n_blocks", F.col("names")[0].alias("name")))
        rest = level.filter(F.size("names") > 1)
        if rest.isEmpty():
            break
        half = F.expr("transform(sequence(0, cast((size(names) - 1) div 2 as int)), i -> struct(i as pos, names[2 * i] as a, coalesce(get(names, 2 * i + 1), -1L) as b))")
        pairs = rest.select("scope", "rep", "n_blocks", F.inline(half))
        once = pairs.select("a", "b").distinct()
        names = once.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_name_task(["a", "b"], ["a", "b"]), "a long, b long, name long")
        level = base.materialize(_gather(pairs.join(names.hint("merge"), ["a", "b"])), f"level{depth}")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return cut.filter("kind = 0").select("scope", "rep", "uid", "doc_id", "n_chars", "sha").join(whole, ["scope", "rep"])


def _gather(rows: DataFrame) -> DataFrame:
    """The names of one text of one scope, in order; their number is bounded by that text."""
    return rows.groupBy("scope", "rep", "n_blocks").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("at")).select("scope", "rep", "n_blocks", F.col("at.name").alias("names"))


def exact_duplicates(docs: DataFrame, uid: str | None = None, **how) -> DataFrame:
    """One row per row of ``docs``: uid, doc_id, keep_id, keep_uid, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the
    smallest doc_id (nulls last), then the first row. Repeated rows are told apart by the long
    column ``uid``; by default their place serves. Other columns, whatever their names, are not read.
    """
    place = F.col(uid) if uid else F.monotonically_increasing_id()
    ids = base.materialize(identities(docs.select(place.alias("_uid"), "doc_id", "text"), **how), "identities")
    order = F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), "doc_id", "uid")
    local = ids.groupBy("scope", "rep", "n_blocks", "name").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    local = base.materialize(local, "texts")
    groups = local.groupBy("n_blocks", "name").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    # One row per text and task meets its group; documents meet it over keys of one task.
    per_rep = local.select("scope", "rep", "n_blocks", "name").join(groups, ["n_blocks", "name"]).select("scope", "rep", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size")
    out = ids.select("scope", "rep", "uid", "doc_id", "sha").join(per_rep, ["scope", "rep"])
    return out.select("uid", "doc_id", "keep_id", "keep_uid", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows whose text is a copy of one that stays; all its columns.

    Nulls, empty texts, ties and repeated rows are handled as in ``exact_duplicates``; an empty
    table stays empty, and columns may have any names.
    """
    uid = base.free_name(docs.columns)
    tagged = base.with_uid(docs, uid)
    gone = exact_duplicates(tagged, uid, **how).filter(~F.col("kept")).select(F.col("uid").alias(uid))
    return tagged.join(gone, uid, "left_anti").drop(uid)
