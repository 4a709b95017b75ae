"""Calendar features of a date, as column expressions: no table to join, nothing to broadcast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURES = ["day_of_week", "day_of_month", "month", "year", "week_of_year", "is_weekend", "is_holiday", "holiday_name", "is_payday", "is_day_after_payday", "is_holy_week", "is_year_end_break", "effective_day_of_week"]


def easter(d: Column) -> Column:
    """Easter Sunday of the date's year, by the Gregorian computus in integers."""
    y = F.year(d)
    quotient = lambda x, n: F.floor(x / F.lit(n)).cast("int")
    century = quotient(y, 100)
    leap = quotient(century, 4)
    correction = quotient(century - quotient(century + 8, 25) + 1, 3)
    epact = (y % 19 * 19 + century - leap - correction + 15) % 30
    rest = y % 100
    weekday = (32 + century % 4 * 2 + quotient(rest, 4) * 2 - epact - rest % 4) % 7
    shift = quotient(y % 19 + epact * 11 + weekday * 22, 451)
    days = epact + weekday - shift * 7 + 114
    return F.make_date(y, quotient(days, 31), days % 31 + 1)


def nth_monday(d: Column, month: int, n: int) -> Column:
    first = F.make_date(F.year(d), F.lit(month), F.lit(1))
    return F.date_add(first, (7 - F.weekday(first)) % 7 + 7 * (n - 1))


def holiday_name(d: Column) -> Column:
    """Public holidays of Mexico by rule; empty on other days.

    The fixed days of February, March and November became Mondays in 2006 (March in 2007);
    the handover of the presidency comes every six years, on 1 October from 2024.
    """
    year, month, day = F.year(d), F.month(d), F.dayofmonth(d)
    on = lambda m, n: (month == m) & (day == n)
    handover = year % 6 == 2
    rules = [
        (on(1, 1), "Año Nuevo"),
        (F.when(year >= 2006, d == nth_monday(d, 2, 1)).otherwise(on(2, 5)), "Día de la Constitución"),
        (F.when(year >= 2007, d == nth_monday(d, 3, 3)).otherwise(on(3, 21)), "Natalicio de Benito Juárez"),
        (on(5, 1), "Día del Trabajo"),
        (on(9, 16), "Día de la Independencia"),
        (F.when(year >= 2006, d == nth_monday(d, 11, 3)).otherwise(on(11, 20)), "Día de la Revolución"),
        (handover & F.when(year >= 2024, on(10, 1)).otherwise(on(12, 1)), "Transmisión del Poder Ejecutivo Federal"),
        (on(12, 25), "Navidad"),
    ]
    out = F.lit("")
    for when, name in reversed(rules):
        out = F.when(when, name).otherwise(out)
    return out


def is_payday(d: Column) -> Column:
    return (F.dayofmonth(d) == 15) | (d == F.last_day(d))


def is_holy_week(d: Column) -> Column:
    return d.between(F.date_sub(easter(d), 7), easter(d))


def is_year_end_break(d: Column) -> Column:
    return ((F.month(d) == 12) & (F.dayofmonth(d) >= 24)) | ((F.month(d) == 1) & (F.dayofmonth(d) == 1))


def calendar_columns(d: Column, positional_payday: Column | None = None) -> dict[str, Column]:
    """All features of ``d``, Monday being day 0.

    The day after a payday is that of the calendar, in training and serving alike;
    ``positional_payday`` may give a column to take its place.
    """
    holiday = holiday_name(d)
    off = (holiday != "") | is_year_end_break(d)
    return {
        "day_of_week": F.weekday(d),
        "day_of_month": F.dayofmonth(d),
        "month": F.month(d),
        "year": F.year(d),
        "week_of_year": F.weekofyear(d),
        "is_weekend": F.weekday(d) >= 5,
        "is_holiday": holiday != "",
        "holiday_name": holiday,
        "is_payday": is_payday(d),
        "is_day_after_payday": is_payday(F.date_sub(d, 1)) if positional_payday is None else positional_payday,
        "is_holy_week": is_holy_week(d),
        "is_year_end_break": is_year_end_break(d),
        "effective_day_of_week": F.when(off, 6).otherwise(F.weekday(d)).cast("byte"),
    }


def with_calendar(df, date: str = "date"):
    return df.withColumns(calendar_columns(F.col(date)))
