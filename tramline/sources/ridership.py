"""Raw ridership: download, validation, the frozen Parquet copy and its sidecar."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DownloadError, PanelError
from ..functions.text import series_id
from ..operators import contract

#: Counts stay text until they are validated; line and station labels always do.
SCHEMA = "fecha string, anio int, mes string, linea string, estacion string, afluencia string"
SLACK_BYTES = 1 << 20
CHUNK = 1 << 20


@dataclass(frozen=True)
class IngestResult:
    resource_id: str
    url: str
    last_modified: str
    sha256: str
    size: int
    report: dict


def save_stream(chunks: Iterable[bytes], dest: str, announced: int | None = None) -> tuple[str, int]:
    """Write a download; returns its digest and size.

    Raises if it begins like a web page, or if its size is off what was announced by more than
    a mebibyte; the file appears only once it has passed.
    """
    digest, size, part = hashlib.sha256(), 0, f"{dest}.part"
    os.makedirs(os.path.dirname(dest) or ".", exist_ok=True)
    try:
        with open(part, "wb") as f:
            for chunk in chunks:
                if not size and chunk[:16].lstrip().lower().startswith((b"<!doctype", b"<html")):
                    raise DownloadError("the server sent a web page, not a file")
                digest.update(chunk)
                size += len(chunk)
                f.write(chunk)
        if announced and abs(size - announced) > SLACK_BYTES:
            raise DownloadError(f"{size} bytes came, {announced} were announced")
        os.replace(part, dest)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return digest.hexdigest(), size


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 and whether the file begins like a web page, for many files at once."""
    files = spark.read.format("binaryFile").load(path)
    head = F.lower(F.ltrim(F.decode(F.substring("content", 1, 16), "ISO-8859-1")))
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), (head.startswith("<!doctype") | head.startswith("<html")).alias("is_web_page"))


def read_ridership_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("header", True).option("encoding", "UTF-8").option("enforceSchema", False).csv(path)


def stream_of(url: str) -> Iterator[bytes]:
    from urllib.request import urlopen

    with urlopen(url, timeout=120) as reply:
        while chunk := reply.read(CHUNK):
            yield chunk


def ingest(spark: SparkSession, resource, folder: str, force: bool = False, min_rows: int = contract.MIN_ROWS, stream=stream_of) -> tuple[IngestResult, bool]:
    """Download, validate and freeze a resource; (result, False) if it was there already.

    It is skipped while its date of change is the one in the sidecar and the files exist.
    """
    root = Path(folder)
    sidecar, frozen = root / "ingest.json", root / "ridership.parquet"
    if sidecar.exists() and frozen.exists() and not force:
        old = IngestResult(**json.loads(sidecar.read_text()))
        if old.last_modified == resource["last_modified"]:
            return old, False
    digest, size = save_stream(stream(resource["url"]), str(root / "ridership.csv"), resource["size"])
    raw = read_ridership_csv(spark, str(root / "ridership.csv"))
    report = contract.validate(raw, min_rows)
    raw.withColumn("afluencia", F.col("afluencia").cast("long")).write.mode("overwrite").option("compression", "snappy").parquet(str(frozen))
    result = IngestResult(resource["id"], resource["url"], resource["last_modified"], digest, size, report.as_dict())
    sidecar.write_text(json.dumps(asdict(result), ensure_ascii=False, indent=1))
    return result, True


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    """The modelling panel with its series ids."""
    try:
        panel = spark.read.parquet(path)
    except Exception as e:  # Spark has one error type for a path that isn't there
        if "PATH_NOT_FOUND" in str(e):
            raise PanelError(f"no panel at {path}: build it first") from e
        raise
    return panel.withColumn("series_id", series_id(F.col("line_id"), F.col("station_id")))
