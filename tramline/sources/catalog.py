"""The open-data catalogue: packages as JSON, resources as rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CatalogError
from ..functions.text import normalize_key

Fetch = Callable[[str], bytes]

PACKAGE = "success boolean, result struct<resources: array<struct<id: string, name: string, url: string, format: string, size: bigint, last_modified: string, created: string>>>"


def fetch(url: str) -> bytes:
    with urlopen(url, timeout=60) as reply:
        return reply.read()


def fetch_package(dataset_id: str, base_url: str, fetcher: Fetch = fetch) -> str:
    """The package document, as text; raises unless the catalogue reports success."""
    body = fetcher(f"{base_url}/api/3/action/package_show?{urlencode({'id': dataset_id})}").decode()
    if not json.loads(body).get("success"):
        raise CatalogError(f"the catalogue has no package {dataset_id!r}")
    return body


def list_resources(spark: SparkSession, package: str) -> DataFrame:
    """id, name, url, format (upper case), size, last_modified (else created)."""
    docs = spark.createDataFrame([(package,)], "body string")
    rows = docs.select(F.inline(F.from_json("body", PACKAGE).getField("result").getField("resources")))
    return rows.select("id", "name", "url", F.upper("format").alias("format"), "size", F.coalesce("last_modified", "created").alias("last_modified"))


def resolve_resource(resources: DataFrame, name: str):
    """The one resource whose normalised name is that of ``name``; else an error listing what there is."""
    wanted = normalize_key(F.lit(name))
    found = resources.filter(normalize_key(F.col("name")) == wanted).limit(1).collect()
    if not found:
        there = sorted(r["name"] or "" for r in resources.select("name").collect())
        raise CatalogError(f"no resource {name!r}; the package has {there}")
    return found[0]
