"""Clock and calendar expressions.

Instants are ``TIMESTAMP_NTZ`` in UTC, so no result depends on the session
time zone. ``as_of`` is always passed in; nothing reads the wall clock.
"""

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def game_length() -> Column:
    """Fixed value: a game counts as over 3.5 hours after its start."""
    return F.make_dt_interval(F.lit(0), F.lit(3), F.lit(30))


def instant(as_of) -> Column:
    """A parameter time as a UTC instant."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(as_of).cast("timestamp_ntz")


def parse_instant(text: Column) -> Column:
    """ISO text as a UTC instant; unreadable text is NULL."""
    zoned = F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone())
    has_zone = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(has_zone, zoned.cast("timestamp_ntz")).otherwise(
        text.try_cast("timestamp_ntz")
    )


def in_zone(ts: Column, tz: str = EASTERN) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def local_date(ts: Column, tz: str = "UTC") -> Column:
    return F.to_date(in_zone(ts, tz))


def eastern_date(ts: Column) -> Column:
    return local_date(ts, EASTERN)


def clock(ts: Column, tz: str = EASTERN) -> Column:
    """``7:05 PM``. Spelled out, because newer Java runtimes print another space."""
    local = in_zone(ts, tz)
    hour = F.hour(local)
    return F.concat(
        ((hour + 11) % 12 + 1).cast("string"), F.lit(":"),
        F.lpad(F.minute(local).cast("string"), 2, "0"),
        F.when(hour < 12, " AM").otherwise(" PM"),
    )


def format_time(ts: Column, fallback: Column, tz: str = "UTC") -> Column:
    return F.coalesce(clock(ts, tz), fallback, F.lit("--"))


def same_local_day(a: Column, b: Column, tz: str = "UTC") -> Column:
    return local_date(a, tz) == local_date(b, tz)


def display_date(day: Column) -> Column:
    """``June 15``."""
    return F.date_format(day, "MMMM d")


def default_season(sport: Column, day: Column) -> Column:
    """Baseball follows the calendar year; other seasons turn on 22 October."""
    turned = (F.month(day) > 10) | ((F.month(day) == 10) & (F.dayofmonth(day) >= 22))
    return F.when((sport == "MLB") | turned, F.year(day)).otherwise(F.year(day) - 1)


def season_label(sport: Column, season: Column) -> Column:
    short = F.lpad(F.pmod(season + 1, F.lit(100)).cast("string"), 2, "0")
    year = season.cast("string")
    return F.when(sport == "NBA", F.concat(year, F.lit("-"), short)).otherwise(year)


def default_season_of(sport: str, day: date) -> int:
    """The same rule for a report parameter."""
    if sport == "MLB" or (day.month, day.day) >= (10, 22):
        return day.year
    return day.year - 1
