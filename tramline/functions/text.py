"""Label repair and comparison keys, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_map() -> tuple[str, str]:
    """Letters that decompose to one base letter and marks, and those base letters."""
    source, target = [], []
    for point in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
        if plain != chr(point) and len(plain) == 1:
            source.append(chr(point))
            target.append(plain)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_map()


def fix_mojibake(c: Column) -> Column:
    """Undo one decoding of UTF-8 as Latin-1, where that loses nothing; else the text as it is.

    The encoding is guarded by a nested condition, for it raises on characters beyond Latin-1.
    """
    encoded = F.encode(c, "ISO-8859-1").cast("string")
    return F.when(c.rlike(r"^[\x{0}-\x{FF}]*$"), F.when(F.is_valid_utf8(encoded), encoded).otherwise(c)).otherwise(c)


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}", "")


def trim_space(c: Column) -> Column:
    """Trim white space of every kind, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_key(c: Column) -> Column:
    """Repaired, unaccented, trimmed, lower-case, without blanks about slashes, single-spaced."""
    c = F.lower(trim_space(strip_accents(fix_mojibake(c))))
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s*/\s*", "/"), r"(?U)\s+", " ")


def parse_line_id(c: Column) -> Column:
    """"Línea 01" or "linea a" to "01" or "A"; empty where the label isn't a line."""
    return F.upper(F.regexp_extract(normalize_key(c), r"^linea\s+(\d{1,2}|[ab])$", 1))


def slugify_station(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize_key(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def display_name(c: Column) -> Column:
    return trim_space(fix_mojibake(c))


def parse_line_code(c: Column) -> Column:
    """"01" to "1"; a code of zeros alone stays."""
    code = F.upper(trim_space(c))
    bare = F.regexp_replace(code, "^0+", "")
    return F.when(bare == "", code).otherwise(bare)


def line_sort_rank(line_id: Column) -> Column:
    """Numbered lines in order, then lettered ones."""
    return F.when(line_id.rlike("^[A-Za-z]$"), 100 + F.ascii(F.upper(line_id))).otherwise(line_id.try_cast("int"))


def series_id(line_id: Column, station_id: Column) -> Column:
    return F.concat_ws(":", line_id, station_id)


def split_series_id(c: Column) -> tuple[Column, Column]:
    """Line and station; only the first colon divides."""
    parts = F.split(c, ":", 2)
    return parts[0], F.get(parts, F.lit(1))
