"""Canonical identities of raw rows: lines, stations, registry, duplicates, joins with references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import NetworkShape
from ..errors import CanonicalizationError, GeometryError
from ..functions import text

#: The bounding box that coordinates must lie in.
LATITUDES, LONGITUDES = (19.0, 19.8), (-99.4, -98.8)


def canonicalize(raw: DataFrame, check: bool = True) -> DataFrame:
    """Raw rows with date, line_id, station_id, station_name and ridership; raw labels stay.

    With ``check``, labels that aren't lines or stations raise, naming a few of them.
    """
    out = raw.withColumns(
        {
            "date": F.to_date("fecha", "yyyy-MM-dd"),
            "line_id": text.parse_line_id(F.col("linea")),
            "station_id": text.slugify_station(F.col("estacion")),
            "station_name": text.display_name(F.col("estacion")),
            "ridership": F.col("afluencia").cast("long"),
        }
    )
    if check:
        bad = out.filter((F.col("line_id") == "") | (F.col("station_id") == "")).select("linea", "estacion").distinct().limit(5).collect()
        if bad:
            raise CanonicalizationError(f"labels that can't be parsed, e.g. {[tuple(r) for r in bad]}")
    return out


def station_registry(rows: DataFrame, raw_label: str = "estacion") -> DataFrame:
    """One row per line and station: name (mode, ties to the smallest), span, days, raw labels."""
    by = rows.groupBy("line_id", "station_id").agg(
        F.expr("mode(station_name, true)").alias("station_name"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_distinct("date").alias("n_days"),
        F.count_distinct(raw_label).alias("n_raw_labels"),
    )
    return by.orderBy(text.line_sort_rank(F.col("line_id")), "line_id", "station_id")


def network_shape(rows: DataFrame) -> DataFrame:
    """One row: numbers of lines, of stations and of pairs of both."""
    return rows.agg(F.count_distinct("line_id").alias("n_lines"), F.count_distinct("station_id").alias("n_stations"), F.count_distinct(F.struct("line_id", "station_id")).alias("n_pairs"))


def assert_network(rows: DataFrame, expected: NetworkShape) -> None:
    r = network_shape(rows).first()
    wrong = [f"{k}: expected {getattr(expected, k)}, found {r[k]}" for k in ("n_lines", "n_stations", "n_pairs") if r[k] != getattr(expected, k)]
    if wrong:
        raise CanonicalizationError("; ".join(wrong))


def mark_duplicates(rows: DataFrame, keys: tuple[str, ...] = ("date", "line_id", "station_id")) -> DataFrame:
    """``is_duplicate`` on every copy of a key that occurs more than once."""
    return rows.withColumn("is_duplicate", F.count("*").over(Window.partitionBy(*keys)) > 1)


def duplicate_report(marked: DataFrame) -> DataFrame:
    """One row: rows, dates, stations and span of the duplicated keys."""
    return marked.filter("is_duplicate").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("date").alias("n_dates"),
        F.concat_ws("|", F.array_sort(F.collect_set("station_id"))).alias("stations"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def apply_aliases(geometry: DataFrame, aliases: DataFrame) -> DataFrame:
    """Station ids replaced where their line has an alias for them; others stay.

    Aliases are a hand-kept list of a few rows per source; Catalyst decides by its size.
    """
    renames = aliases.select("line_id", F.col("alias_station_id").alias("station_id"), "canonical_station_id")
    joined = geometry.join(renames, ["line_id", "station_id"], "left")
    return joined.withColumn("station_id", F.coalesce("canonical_station_id", "station_id")).drop("canonical_station_id").select(geometry.columns)


def match_sides(registry: DataFrame, geometry: DataFrame, keys: tuple[str, ...] = ("line_id", "station_id")) -> DataFrame:
    """Full outer join with where each row comes from: both, left_only or right_only."""
    keys = list(keys)
    both = registry.withColumn("_l", F.lit(True)).join(geometry.withColumn("_r", F.lit(True)), keys, "full_outer")
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return both.withColumn("side", side).drop("_l", "_r")


def reconcile(registry: DataFrame, geometry: DataFrame) -> DataFrame:
    """Registry with coordinates; raises if either side has a station that the other lacks."""
    merged = match_sides(registry, geometry)
    r = merged.agg(
        F.array_sort(F.collect_set(F.when(F.col("side") == "left_only", F.col("station_id")))).alias("missing"),
        F.array_sort(F.collect_set(F.when(F.col("side") == "right_only", F.col("station_id")))).alias("extra"),
        F.count_if((F.col("side") == "both") & ~F.coalesce(F.col("latitude").between(*LATITUDES) & F.col("longitude").between(*LONGITUDES), F.lit(False))).alias("outside"),
    ).first()
    if r["missing"] or r["extra"]:
        raise GeometryError(f"stations without coordinates: {r['missing']}; coordinates without a station: {r['extra']}")
    if r["outside"]:
        raise GeometryError(f"{r['outside']} stations lie outside the valley")
    return merged.drop("side")
