"""URL filter on a memory-mapped array of sorted digests.

Rules are "host/path" with an action. The array file holds the 64-bit xxhash of every rule and
of every rule's host, sorted, with the strings themselves behind them. Tasks map the file into
memory, so workers on a machine share its pages and only what is probed is read. A batch of
URLs is probed by one vectorised binary search per step, and each hit is confirmed by comparing
the stored string, so a collision of digests never decides.

Step one looks up every suffix of each distinct host (at its dots); step two looks up, for
hosts that rules name, the path cut to each length that rules of that host have. The longest
rule that fits wins (of equally long ones, the one with the longer host). A URL that no rule fits is not in the array and is allowed.
"""

from __future__ import annotations

import io
import os
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

MAGIC = b"tramdig1"
_UPPER = {i: i + 32 for i in range(65, 91)}


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for stop in "?#":
        cut = rest.find(stop)
        if cut >= 0:
            rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_UPPER), path


def split_rule(rule: str) -> tuple[str, str]:
    slash = rule.find("/")
    return (rule, "") if slash < 0 else (rule[:slash], rule[slash:])


class DigestArray:
    """Strings with a value each, found by their digest; built once, then only mapped."""

    HEAD = struct.Struct("<8sQQ")

    def __init__(self, buffer: np.ndarray):
        magic, n, size = self.HEAD.unpack(buffer[: self.HEAD.size].tobytes())
        if magic != MAGIC:
            raise ValueError("not a digest array")
        at = self.HEAD.size
        self.keys = buffer[at : at + 8 * n].view("<u8")
        self.ends = buffer[at + 8 * n : at + 16 * n].view("<u8")
        self.values = buffer[at + 16 * n : at + 20 * n].view("<i4")
        self.blob = buffer[at + 20 * n : at + 20 * n + size]

    @classmethod
    def build(cls, entries: Iterable[tuple[str, int]]) -> bytes:
        """The bytes of an array; of equal strings the last entry counts."""
        rows = sorted((digest(s), s, v) for s, v in dict(entries).items())
        texts = [s.encode("utf-8", "surrogatepass") for _, s, _ in rows]
        out = io.BytesIO()
        out.write(cls.HEAD.pack(MAGIC, len(rows), sum(map(len, texts))))
        out.write(np.array([k for k, _, _ in rows], dtype="<u8").tobytes())
        out.write(np.cumsum([len(t) for t in texts], dtype="<u8").tobytes() if texts else b"")
        out.write(np.array([v for _, _, v in rows], dtype="<i4").tobytes())
        out.write(b"".join(texts))
        return out.getvalue()

    def text(self, i: int) -> str:
        low = int(self.ends[i - 1]) if i else 0
        return self.blob[low : int(self.ends[i])].tobytes().decode("utf-8", "surrogatepass")

    def probe(self, texts: list[str]) -> np.ndarray:
        """The value of each string, -1 where it isn't in the array."""
        out = np.full(len(texts), -1, dtype=np.int64)
        if not len(self.keys) or not texts:
            return out
        wanted = np.fromiter(map(digest, texts), dtype=np.uint64, count=len(texts))
        at = np.searchsorted(self.keys, wanted)
        inside = at < len(self.keys)
        hit = np.flatnonzero(inside & (self.keys[np.where(inside, at, 0)] == wanted))
        for row in hit:
            i = int(at[row])
            while i < len(self.keys) and self.keys[i] == wanted[row]:
                if self.text(i) == texts[row]:
                    out[row] = self.values[i]
                    break
                i += 1
        return out


class RuleFilter:
    """Rules in two digest arrays: hosts with the path lengths of their rules, and whole rules."""

    SIZES = struct.Struct("<QQQ")

    def __init__(self, path: str):
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        a, b, c = self.SIZES.unpack(whole[: self.SIZES.size].tobytes())
        at = self.SIZES.size
        self.hosts = DigestArray(np.array(whole[at : at + a]) if a < 1 << 20 else _aligned(whole, at, a))
        self.rules = DigestArray(np.array(whole[at + a : at + a + b]) if b < 1 << 20 else _aligned(whole, at + a, b))
        self.lengths = [tuple(map(int, x.split(b","))) for x in whole[at + a + b : at + a + b + c].tobytes().split(b"\n") if x]

    @classmethod
    def build(cls, rules: Iterable[tuple[str, str]]) -> bytes:
        """The bytes of a filter from (rule, "allow" or "block") pairs."""
        by_host: dict[str, set[int]] = defaultdict(set)
        entries = []
        for rule, action in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"unknown action {action!r}")
            host, path = split_rule(rule)
            by_host[host].add(len(path))
            entries.append((rule, int(action == "block")))
        kinds = sorted({tuple(sorted(v)) for v in by_host.values()})
        number = {k: i for i, k in enumerate(kinds)}
        a = DigestArray.build((h, number[tuple(sorted(v))]) for h, v in by_host.items())
        b = DigestArray.build(entries)
        c = b"\n".join(",".join(map(str, k)).encode() for k in kinds)
        a += bytes(-len(a) % 8)
        b += bytes(-len(b) % 8)
        return cls.SIZES.pack(len(a), len(b), len(c)) + a + b + c

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str | None, str]]:
        """For each (host, path): the longest rule that fits, or None, and the verdict."""
        hosts = sorted({h for h, _ in urls})
        suffixes, owner = [], []
        for h in hosts:
            at = 0
            while True:
                suffixes.append(h[at:])
                owner.append(h)
                dot = h.find(".", at)
                if dot < 0:
                    break
                at = dot + 1
        named: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for suffix, h, value in zip(suffixes, owner, self.hosts.probe(suffixes)):
            if value >= 0:
                named[h].append((suffix, int(value)))
        rows, tried = [], []
        for i, (h, path) in enumerate(urls):
            for suffix, kind in named.get(h, ()):
                for n in self.lengths[kind]:
                    if n <= len(path):
                        rows.append(i)
                        tried.append(suffix + path[:n])
        out: list[tuple[str | None, str]] = [(None, "allow")] * len(urls)
        for i, rule, value in zip(rows, tried, self.rules.probe(tried)):
            if value >= 0 and (out[i][0] is None or len(rule) > len(out[i][0])):
                out[i] = (rule, "block" if value else "allow")
        return out


def _aligned(whole: np.ndarray, at: int, size: int) -> np.ndarray:
    return whole[at : at + size]


@lru_cache(maxsize=2)
def _opened(path: str) -> RuleFilter:
    return RuleFilter(path)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A null URL, or one without ``://``, has an empty host and path. Repeated rows and null ids
    are kept as they are; only page_id and url are read.
    """
    spark = pages.sparkSession
    base.ship_package(spark)
    path = base.scratch_path(spark, "rules")
    with base.open_output(path) as f:
        f.write(RuleFilter.build(rules))
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _opened(SparkFiles.get(name)).judge
        for b in batches:
            urls = [split_url(u) for u in b.column("url").to_pylist()]
            found = judge(urls)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), *(pa.array(c, pa.string()) for c in ([h for h, _ in urls], [p for _, p in urls], [r for r, _ in found], [v for _, v in found]))],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return narrow.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
