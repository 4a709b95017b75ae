"""What the operators of this subpackage share: scratch tables, shipping of code, files."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset and all runs on one machine, as in tests, is a
    folder of that machine chosen and set; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tramline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's scratch tables; it goes when the driver ends."""
    root = f"{shared_dir(spark)}/tramline/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(remove, root)
    return root


_ROOTS: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(path: str) -> None:
    """Delete a folder of the shared folder; one that isn't there, or can't be reached now, is left."""
    scheme, name = _split(path)
    if not scheme:
        shutil.rmtree(name, ignore_errors=True)
        return
    from pyarrow import fs

    with contextlib.suppress(OSError):
        store, inner = fs.FileSystem.from_uri(path)
        store.delete_dir(inner)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        if path := getattr(df, "_tramline_path", None):
            remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a frame that reads it.

    This cuts the lineage at a table that survives lost executors; the shuffle files of the
    job that wrote it are removed as soon as it ends.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tramline_path = path
    return out


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, so that workers import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tramline_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tramline-code-"), "tramline_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tramline", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._tramline_shipped = True


#: Plan nodes over which each row keeps its partition and place from job to job.
STEADY = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}
SPLITS = "spark.sql.files.minPartitionNum"


def _steady(df: DataFrame) -> bool:
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() not in STEADY or not plan.deterministic():
            return False
        below = plan.children()
        todo += [below.apply(i) for i in range(below.size())]
    return True


def free_name(taken: list[str], name: str = "_uid") -> str:
    """``name``, or the first longer one that no column has."""
    low = {c.lower() for c in taken}
    while name in low:
        name = "_" + name
    return name


def with_uid(docs: DataFrame, name: str = "_uid") -> DataFrame:
    """Add a long that tells rows apart even where ids repeat or are null.

    A row has the same number in every job that reads the result. Files are split by the number
    of cores, which changes as executors come and go, so that number is pinned for the session;
    what isn't a plain scan of files, and may be dealt anew each time, is written first.
    """
    spark = docs.sparkSession
    written = not _steady(docs)
    if written:
        docs = materialize(docs, "rows")
    if spark.conf.get(SPLITS, None) is None:
        spark.conf.set(SPLITS, str(spark.sparkContext.defaultParallelism))
    out = docs.withColumn(name, F.monotonically_increasing_id())
    out._tramline_path = getattr(docs, "_tramline_path", None) if written else None
    return out


def id_fold(col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _split(path: str) -> tuple[str, str]:
    parts = urlsplit(path)
    return ("", unquote(parts.path) if parts.scheme else path) if parts.scheme in ("", "file") else (parts.scheme, path)


@contextlib.contextmanager
def open_output(path: str) -> Iterator[io.BufferedIOBase]:
    """Write a file of the shared folder so that it appears whole or not at all.

    A task that is tried again, or runs twice, replaces the file by equal bytes.
    """
    scheme, name = _split(path)
    part = f".{uuid.uuid4().hex}.part"
    if not scheme:
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(name + part, "wb") as f:
            yield f
        os.replace(name + part, name)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner + part) as f:
        yield f
    store.move(inner + part, inner)


def open_input(path: str):
    """A readable stream of a file in the shared folder."""
    scheme, name = _split(path)
    if not scheme:
        return open(name, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)
