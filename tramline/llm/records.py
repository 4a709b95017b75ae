"""Token ids in length-delimited binary record files, with a separate offset index.

A record is: payload length (8 bytes), masked checksum of those 8 bytes (4), payload, masked
checksum of the payload (4); all little-endian. The checksum is CRC-32 as zlib computes it,
rotated right by 15 bits plus a constant, so that a checksum of data that holds checksums
stays meaningful. A payload is: flags (1; bit 0: the id is null), bytes per token id (1),
doc_id (8), then the ids. Beside each data file lies an index: one entry per record with
doc_id, offset, length of the record and its number of ids, for reads in any order.

Files hold documents in ascending doc_id order, over all files; a manifest lists the files with
their numbers of documents and ids, one line per file, so that no reader has to scan others.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, tokens

#: Fixed values of the masking rule.
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
BODY = struct.Struct("<BBq")
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u8")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return HEAD.pack(len(payload), masked(size)) + payload + TAIL.pack(masked(payload))


def read_frame(f) -> bytes | None:
    """The next payload of a stream; None at its end; an error if anything doesn't match."""
    head = f.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("record header is cut off")
    size, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("record length doesn't match its checksum")
    payload, tail = f.read(size), f.read(TAIL.size)
    if len(payload) < size or len(tail) < TAIL.size:
        raise ValueError("record is cut off")
    if TAIL.unpack(tail)[0] != masked(payload):
        raise ValueError("record payload doesn't match its checksum")
    return payload


def serialize(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return BODY.pack(doc_id is None, width, doc_id or 0) + ids


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, width, doc_id = BODY.unpack_from(payload)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=BODY.size)
    return (None if null else doc_id), ids


def _write_task(path: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        encode, width = encoder.encode, encoder.width
        end = end_id.to_bytes(width, "little")
        shard = TaskContext.get().partitionId()
        name, index, at, n_tokens = f"shard-{shard:06d}", [], 0, 0
        with base.open_output(f"{path}/{name}.rec") as f:
            for b in batches:
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    ids = encode(text.as_py() or "") + end
                    record = frame(serialize(doc_id, ids, width))
                    f.write(record)
                    index.append((doc_id or 0, doc_id is None, at, len(record), len(ids) // width))
                    at += len(record)
                    n_tokens += len(ids) // width
        with base.open_output(f"{path}/{name}.idx") as f:
            f.write(np.array(index, dtype=INDEX).tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(index)], "tokens": [n_tokens], "bytes": [at]}, schema=_SHARD)

    return run


_SHARD = pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> list[dict]:
    """Encode all documents and write them in ascending doc_id order; returns the manifest.

    Null texts count as empty (their end id alone); null ids come first; rows with equal ids
    follow each other in the order of a hash of their text, and rows with equal texts too in that
    of a hash of their place, so that many equal rows are still dealt over files. Ids take 2
    bytes where the vocabulary allows, else 4. Other columns are not read; an empty table makes
    a manifest without files.
    """
    spark = docs.sparkSession
    base.ship_package(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_h", F.xxhash64("text"))
    # Equal rows make equal records: it doesn't matter which of them a number goes to.
    narrow = base.with_uid(narrow)
    ordered = narrow.repartitionByRange("doc_id", "_h", "_uid").sortWithinPartitions("doc_id", "_h", "_uid")
    written = ordered.select("doc_id", "text").mapInArrow(_write_task(path, vocabulary, end_id), "shard int, docs long, tokens long, bytes long")
    before = spark.conf.get(base.CLEANUP, "false")
    spark.conf.set(base.CLEANUP, "true")
    try:
        rows = written.collect()  # one small row per file
    finally:
        spark.conf.set(base.CLEANUP, before)
    start, manifest = 0, []
    for r in sorted(rows, key=lambda r: r["shard"]):
        manifest.append({"file": f"shard-{r['shard']:06d}", "docs": r["docs"], "tokens": r["tokens"], "bytes": r["bytes"], "start": start})
        start += r["tokens"]
    with base.open_output(f"{path}/manifest.json") as f:
        f.write("\n".join(json.dumps(m) for m in manifest).encode())
    return manifest


def manifest_of(path: str) -> list[dict]:
    with base.open_input(f"{path}/manifest.json") as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def index_of(path: str, file: str) -> np.ndarray:
    with base.open_input(f"{path}/{file}.idx") as f:
        return np.frombuffer(f.read(), dtype=INDEX)


def read_at(path: str, file: str, numbers: Sequence[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records with these numbers within a file, in the order asked for, through the index."""
    index, out = index_of(path, file), []
    with base.open_input(f"{path}/{file}.rec") as f:
        for i in numbers:
            f.seek(int(index["offset"][i]))
            out.append(parse(read_frame(f)))
    return out


def _read_task(path: str, columns: tuple[str, ...]):
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_crc32": pa.int64()}
    make = {
        "doc_id": lambda doc_id, start, ids: doc_id,
        "start": lambda doc_id, start, ids: start,
        "n_tokens": lambda doc_id, start, ids: len(ids),
        "ids": lambda doc_id, start, ids: ids.astype(np.int32),
        "ids_crc32": lambda doc_id, start, ids: zlib.crc32(ids.astype("<u4").tobytes()),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                index = index_of(path, file)
                with base.open_input(f"{path}/{file}.rec") as f:
                    done = 0
                    while True:
                        rows: dict[str, list] = {c: [] for c in columns}
                        while len(rows[columns[0]]) < 1000 and (payload := read_frame(f)) is not None:
                            doc_id, ids = parse(payload)
                            if len(ids) != index["n_tokens"][done]:
                                raise ValueError("index and data don't match")
                            for c in columns:
                                rows[c].append(make[c](doc_id, start, ids))
                            start += len(ids)
                            done += 1
                        if not rows[columns[0]]:
                            break
                        yield pa.RecordBatch.from_arrays([pa.array(rows[c], kinds[c]) for c in columns], names=list(columns))
                    if done != len(index):
                        raise ValueError("data ends before its index")

    return run


TYPES = {"doc_id": "long", "start": "long", "n_tokens": "long", "ids": "array<int>", "ids_crc32": "long"}


def read_records(spark: SparkSession, path: str, columns: Sequence[str] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """All records of a folder, checked: doc_id, start (ids of all records before), n_tokens, ids.

    ``ids_crc32`` may be asked for in place of, or beside, the ids. Files are read from their
    start to their end, one at a time, so memory holds a few records.
    """
    base.ship_package(spark)
    manifest = manifest_of(path)
    schema = ", ".join(f"{c} {TYPES[c]}" for c in columns)
    files = spark.createDataFrame([(m["file"], m["start"]) for m in manifest if m["docs"]], "file string, start long")
    n = max(1, len(manifest))
    return files.repartition(n).mapInArrow(_read_task(path, tuple(columns)), schema)
