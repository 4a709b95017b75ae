"""WARC archives: written with one gzip member per record, read sequentially.

Writing. Pages with equal payloads become one response (the largest page_id) and revisits
that refer to it. Groups are found by digest and size with partial aggregates; only groups of
two and more are sent back to the pages. The few thousand largest at most go to every task, so
that a payload that a third of all pages share moves nothing; the rest meet their pages in a
join. Pages are written where they end up, one file per task.

Reading. A file is read from its start to its end: compressed bytes in small chunks, through
one incremental decompressor per member, with the block framed by its content length. Block
and payload digests are recomputed while reading. Memory holds one record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

CHUNK = 1 << 16
#: Share of all copies from which a group of equal payloads is hot.
HOT_SHARE = 1 / 4096
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_value(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def encode_record(kind: str, record_id: str, url: str | None, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP header and leaves out the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass")) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class WarcError(ValueError):
    """An archive that isn't as its own framing or digests say."""


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes
    payload_bytes: int
    digest: str

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]


class WarcReader:
    """Iterates over the records of a stream of gzip members."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk = stream, chunk
        self.rest = b""

    def _more(self) -> bytes:
        """Decompressed bytes of the current member; empty at its end."""
        while not self.member.eof:
            data = self.member.unconsumed_tail or self.rest or self.stream.read(self.chunk)
            self.rest = b""
            if not data:
                raise WarcError("file ends within a member")
            try:
                out = self.member.decompress(data, self.chunk)
            except zlib.error as e:
                raise WarcError(f"member is damaged: {e}") from e
            if out:
                return out
        return b""

    def _until(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            more = self._more()
            if not more:
                raise WarcError("member ends within a header")
            self.held += more
        out, self.held = bytes(self.held[:at]), self.held[at + len(mark) :]
        return out

    def _exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            more = self._more()
            if not more:
                raise WarcError("member ends within its block")
            self.held += more
        out, self.held = bytes(self.held[:n]), self.held[n:]
        return out

    def __iter__(self) -> Iterator[Record]:
        while True:
            self.rest = self.rest or self.stream.read(self.chunk)
            if not self.rest:
                return
            self.member, self.held = zlib.decompressobj(31), bytearray()
            head = self._until(b"\r\n\r\n").decode("utf-8", "surrogatepass").split("\r\n")
            if not head[0].startswith("WARC/"):
                raise WarcError("record doesn't begin with its version")
            headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in head[1:])}
            block = self._exactly(int(headers["content-length"]))
            if self._exactly(4) != b"\r\n\r\n":
                raise WarcError("block isn't followed by two line ends")
            if self.held or self._more():
                raise WarcError("member goes on after its record")
            self.rest = self.member.unused_data
            yield self._checked(headers, block)

    @staticmethod
    def _checked(headers: dict[str, str], block: bytes) -> Record:
        if headers["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
            raise WarcError("block doesn't match its digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = {k.lower(): v for k, _, v in (line.partition(b": ") for line in http.split(b"\r\n")[1:])}
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        size = int(fields[b"content-length"])
        if headers["warc-type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
            raise WarcError("payload doesn't match its digest")
        return Record(headers, payload, size, digest)


def _record_id(page_id: int | None, uid: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{uid}"


def _page_of(record_id: str) -> int | None:
    text = record_id.strip("<>").split(":")[2]
    return int(text) if text else None


def _write_task(path: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        n = size = 0
        with base.open_output(f"{path}/{name}") as f:
            for b in batches:
                payloads = b.column("html").cast(pa.binary())
                for page_id, uid, url, payload, first_id, first_uid in zip(b.column("page_id").to_pylist(), b.column("_uid").to_pylist(), b.column("url").to_pylist(), payloads, b.column("first_id").to_pylist(), b.column("first_uid").to_pylist()):
                    again = first_uid is not None and first_uid != uid
                    data = encode_record("revisit" if again else "response", _record_id(page_id, uid), url, date, payload.as_py(), _record_id(first_id, first_uid) if again else None)
                    f.write(data)
                    n += 1
                    size += len(data)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", hot_share: float = HOT_SHARE) -> list[dict]:
    """Write a record per row of ``pages`` and return the list of files.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the largest
    page_id (nulls are smallest; of repeated rows the last) is the response; rows with smaller
    payloads are all responses. Null html is an empty payload; a null url leaves its header out;
    an empty table writes no records. Other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    base.ship_package(spark)
    rows = base.with_uid(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")))
    rows = rows.withColumn("_digest", F.sha1(F.col("html").cast("binary"))).withColumn("_bytes", F.octet_length("html"))
    shared = rows.filter(F.col("_bytes") >= min_bytes).groupBy("_digest", "_bytes").agg(F.max(F.struct("page_id", "_uid")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # A written table: its size is known when the join is planned, and both joins below read it.
    shared = base.materialize(shared.select("_digest", "_bytes", "n", F.col("first.page_id").alias("first_id"), F.col("first._uid").alias("first_uid")), "payloads")
    many = hot_share * (shared.agg(F.sum("n")).first()[0] or 0)
    # Groups of more than a share of all copies are at most 1 / share: few enough for each task.
    hot = shared.filter(F.col("n") > many).select("_digest", "_bytes", F.col("first_id").alias("hot_id"), F.col("first_uid").alias("hot_uid"))
    cold = shared.filter(F.col("n") <= many).drop("n").withColumnRenamed("_digest", "_key")
    rows = rows.join(F.broadcast(hot), ["_digest", "_bytes"], "left")
    # Rows of hot groups have their answer; a key of their own spreads them over the second join.
    rows = rows.withColumn("_key", F.when(F.col("hot_uid").isNull(), F.col("_digest")).otherwise(F.col("_uid").cast("string")))
    joined = rows.join(cold, ["_key", "_bytes"], "left").select("page_id", "_uid", "url", "html", F.coalesce("hot_id", "first_id").alias("first_id"), F.coalesce("hot_uid", "first_uid").alias("first_uid"))
    before = spark.conf.get(base.CLEANUP, "false")
    spark.conf.set(base.CLEANUP, "true")
    try:
        files = joined.mapInArrow(_write_task(path, date), "file string, records long, bytes long").collect()  # one small row per file
    finally:
        spark.conf.set(base.CLEANUP, before)
    base.discard(shared)
    return [r.asDict() for r in files]


COLUMNS = {
    "page_id": ("long", pa.int64(), lambda r: _page_of(r.headers["warc-record-id"])),
    "url": ("string", pa.string(), lambda r: r.headers.get("warc-target-uri")),
    "payload": ("binary", pa.binary(), lambda r: r.payload if r.kind == "response" else None),
    "payload_bytes": ("long", pa.int64(), lambda r: r.payload_bytes),
    "payload_digest": ("string", pa.string(), lambda r: r.digest),
    "record_type": ("string", pa.string(), lambda r: r.kind),
    "refers_to": ("long", pa.int64(), lambda r: _page_of(r.headers["warc-refers-to"]) if "warc-refers-to" in r.headers else None),
}


def read_warc(spark: SparkSession, path: str, files: Sequence[str], columns: Sequence[str] = tuple(COLUMNS)) -> DataFrame:
    """One row per record of the files, each checked; a damaged archive raises ``WarcError``."""
    base.ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                with base.open_input(f"{path}/{name}") as f:
                    rows: list[tuple] = []
                    for record in WarcReader(f):
                        rows.append(tuple(COLUMNS[c][2](record) for c in columns))
                        if len(rows) == 256:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, COLUMNS[c][1]) for c, v in zip(columns, zip(*rows))], names=list(columns))

    names = spark.createDataFrame([(f,) for f in files], "file string")
    return names.repartition(max(1, len(files))).mapInArrow(run, ", ".join(f"{c} {COLUMNS[c][0]}" for c in columns))
