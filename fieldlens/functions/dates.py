"""Seasons, periods and windows in time as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Season windows (name, first, last) as month-day, both included.
SEASONS = (("spring", "04-15", "05-31"), ("early_summer", "06-01", "06-30"), ("summer", "07-01", "07-15"), ("autumn", "08-01", "10-15"))


def season(ts: Column, windows: tuple[tuple[str, str, str], ...] = SEASONS, outside: str | None = None) -> Column:
    """The window that holds the date; ``outside`` (or null) between windows. A window whose end lies before its start wraps the year."""
    md = F.date_format(ts, "MM-dd")
    out = F.when(ts.isNull(), None)
    for name, first, last in windows:
        out = out.when(md.between(first, last) if first <= last else (md >= first) | (md <= last), name)
    return out.otherwise(outside) if outside else out


def calendar_season(ts: Column) -> Column:
    """Meteorological season of the month."""
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isin(9, 10, 11), "autumn")


def period_of_year(year: Column, event_year: Column) -> Column:
    """PRE for the year before the event, EVENT for its own, POST for the one after, else null."""
    d = year - event_year
    return F.when(d == -1, "PRE").when(d == 0, "EVENT").when(d == 1, "POST")


def target_day(year: Column, first: str, last: str) -> Column:
    """The middle day of the year between two month-day bounds, halves to the even day."""
    day = lambda md: F.dayofyear(F.make_date(year.cast("int"), F.lit(int(md[:2])), F.lit(int(md[3:]))))
    return F.bround((day(first) + day(last)) / 2.0, 0).cast("int")


def month_bounds(year: Column, month: Column) -> Column:
    """struct(first, last) day of a month."""
    first = F.make_date(year.cast("int"), month.cast("int"), F.lit(1))
    return F.struct(first.alias("first"), F.last_day(first).alias("last"))


def spacing_ok(day: Column, chosen: Column, days: int) -> Column:
    """True if every chosen date is at least so many days away; nulls pass."""
    return F.coalesce(F.forall(chosen, lambda d: F.coalesce(F.abs(F.datediff(day, d)) >= days, F.lit(True))), F.lit(True))


def parse_scene_time(metadata: Column, scene_id: Column) -> Column:
    """A scene's time: item.datetime of its JSON, else datetime, else the first 20yymmddThhmmss of its id."""
    stamp = lambda path: F.try_to_timestamp(F.regexp_replace(F.substring(F.get_json_object(metadata, path), 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    from_id = F.try_to_timestamp(F.regexp_extract(scene_id, r"(20\d{6}T\d{6})", 1), F.lit("yyyyMMdd'T'HHmmss"))
    return F.coalesce(stamp("$.item.datetime"), stamp("$.datetime"), from_id)
