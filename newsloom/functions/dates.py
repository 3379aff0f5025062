"""Date functions. The session's time zone is UTC; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()
#: Hours that the named zones of feed dates are behind UTC.
ZONES = {"gmt": 0, "utc": 0, "ut": 0, "z": 0, "est": 5, "edt": 4, "cst": 6, "cdt": 5, "mst": 7, "mdt": 6, "pst": 8, "pdt": 7}
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
RFC822 = r"(?i)^\s*(?:[a-z]{3,9},?\s+)?(\d{1,2})\s+([a-z]{3})[a-z]*\.?\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([a-z]{1,3}|[+-]\d{2}:?\d{2})?\s*$"


def _month(name: Column) -> Column:
    """The number of a month by its three first letters."""
    return F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.left(name, F.lit(3)))).cast("int")


def _made(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Null where a part is out of range, so days never roll over."""
    return F.try_make_timestamp(year.cast("int"), month, day.cast("int"), hour.cast("int"), minute.cast("int"), second.cast("int"))


def feed_date(text: Column) -> Column:
    """Strict forms first, then dates as pages render them; null if none holds."""
    g = lambda n: F.regexp_extract(text, RFC822, n)
    zone = F.lower(g(7))
    offset = F.lit(0)
    for name, hours in ZONES.items():
        offset = F.when(zone == name, F.lit(hours * 60)).otherwise(offset)
    signed = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.substring(signed, 1, 2).try_cast("int") * 60 + F.substring(signed, 3, 2).try_cast("int")
    offset = F.when(zone.startswith("+"), -minutes).when(zone.startswith("-"), minutes).otherwise(offset)
    second = F.coalesce(F.nullif(g(6), F.lit("")), F.lit("0"))
    rfc = F.when(text.rlike(RFC822), _made(g(3), _month(g(2)), g(1), g(4), g(5), second) + F.make_interval(mins=offset))
    # as some pages render it: weekday (it may be missing), month, day, year, and after a hyphen hours and minutes
    parts = F.split(text, ",")
    weekday = (F.size(parts) == 3) & ~F.trim(F.get(parts, F.lit(0))).rlike("[^A-Za-z]")
    day = F.concat_ws(",", F.when(weekday, F.slice(parts, 2, 2)).otherwise(parts))
    spaced = F.regexp_replace(F.regexp_replace(F.trim(day), " *([,-]) *", "$1"), " +", " ")
    rendered = F.try_to_timestamp(spaced, F.lit("MMMM d,yyyy-H:mm"))
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in FORMATS], rfc, rendered)


def relative_label(at: Column, now: Column) -> Column:
    """Time ago, halves rounded up."""
    rounded = lambda x: F.floor(x + 0.5).cast("long")
    seconds = now.cast("double") - at.cast("double")
    minutes, hours, days = rounded(seconds / 60), rounded(seconds / 3600), rounded(seconds / 86400)
    label = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(at.isNull(), F.lit("")).when(minutes < 1, F.lit("just now")).when(
        minutes < 60, label(minutes, "m ago")
    ).when(hours < 24, label(hours, "h ago")).when(days < 7, label(days, "d ago")).otherwise(F.date_format(at, "MMM d"))


def season_of(at: Column, start_month: Column) -> Column:
    """The season under way: from its first month on that of the year, before that the year's before."""
    return F.year(at) - (F.month(at) < start_month).cast("int")


def period_key(at: Column) -> Column:
    """Refresh periods begin at 5, 11 and 17 h; before 5 h the night before goes on."""
    hour = F.hour(at)
    part = F.when((hour >= 5) & (hour < 11), F.lit("morning")).when((hour >= 11) & (hour < 17), F.lit("midday")).otherwise(F.lit("evening"))
    return F.concat_ws(":", F.date_format(at - F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd"), part)


def kickoff_label(at: Column, now: Column) -> Column:
    return F.when(F.to_date(at) == F.to_date(now), F.date_format(at, "HH:mm")).otherwise(F.date_format(at, "EEE HH:mm"))


def window_spec(text: str, most_hours: int = 72) -> int:
    """Seconds of a window such as 90m, 6h or 2d, at most three days."""
    unit = {"m": 60, "h": 3600, "d": 86400}[text[-1]]
    return min(int(text[:-1]) * unit, most_hours * 3600)
