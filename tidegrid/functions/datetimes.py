"""Date and time expressions on timestamp_ntz and on text of the form yyyyMMddHHmmss (which sorts by time)."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_FORMAT = "yyyyMMddHHmmss"
_PYTHON_FORMAT = "%Y%m%d%H%M%S"


def parse_text(c: Column) -> Column:
    """Text to timestamp_ntz; null where it isn't a time."""
    return F.try_to_timestamp(c, F.lit(TEXT_FORMAT)).cast("timestamp_ntz")


def as_text(c: Column) -> Column:
    return F.date_format(c, TEXT_FORMAT)


def move_minutes(text: Column, n: int) -> Column:
    """The text time n minutes later (earlier if negative); n = 0 leaves it as it is, unparsed."""
    return text if n == 0 else as_text(parse_text(text) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n), F.lit(0)))


def after_minutes(text: Column, n: int) -> Column:
    return move_minutes(text, n)


def before_minutes(text: Column, n: int) -> Column:
    return move_minutes(text, -n)


def before_days(text: Column, n: int) -> Column:
    return as_text(parse_text(text) - F.make_dt_interval(F.lit(n), F.lit(0), F.lit(0), F.lit(0)))


def _times(until: str, minutes: int, days: int) -> list[tuple[datetime, datetime]]:
    end = datetime.strptime(until, _PYTHON_FORMAT)
    return [(end - timedelta(days=i, minutes=minutes), end - timedelta(days=i)) for i in range(days)]


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def text_time_filter(c: Column, until: str, minutes: int, days: int) -> Column:
    """True at `until` on each of the last `days` days, or in the closed ranges of so many minutes before it.

    Only comparisons of the column with literals, so a scan can take them."""
    text = [(a.strftime(_PYTHON_FORMAT), b.strftime(_PYTHON_FORMAT)) for a, b in _times(until, minutes, days)]
    return _any([c == b if minutes == 0 else c.between(a, b) for a, b in text])


def time_filter(c: Column, until: str, minutes: int, days: int, date: Column | None = None) -> Column:
    """The same on timestamps. date: a date partition column, for which the days are listed too, since no optimizer
    derives them from the times."""
    spans = _times(until, minutes, days)
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    out = _any([c == at(b) if minutes == 0 else c.between(at(a), at(b)) for a, b in spans])
    if date is not None:
        out = date.isin(sorted({d.date() for span in spans for d in span})) & out
    return out


def in_steps(c: Column, until: str, step_minutes: int, days: int) -> Column:
    """True in the step that starts at `until`, on each of the last `days` days: ranges that a scan can take, where a filter
    on the step's start (a computed value) reaches none."""
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return _any([(c >= at(b)) & (c < at(b + timedelta(minutes=step_minutes))) for _, b in _times(until, 0, days)])


def snap(c: Column, step_minutes: int) -> Column:
    """The start of the step that holds the time; steps count from midnight."""
    into = (F.hour(c) * 60 + F.minute(c)) % F.lit(step_minutes)
    return c - F.make_dt_interval(F.lit(0), F.lit(0), into, F.extract(F.lit("SECOND"), c))


def in_hours(c: Column, start_hour: int, end_hour: int) -> Column:
    return (F.hour(c) >= start_hour) & (F.hour(c) < end_hour)


def last_days(date: Column, end_date: Column, n: int) -> Column:
    """The n days that end with end_date."""
    return (date > F.date_sub(end_date, n)) & (date <= end_date)


def wall_seconds(c: Column) -> Column:
    """Whole seconds from 1970 on the clock that the timestamp_ntz shows, whatever the session's zone."""
    return F.unix_date(F.to_date(c)).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
