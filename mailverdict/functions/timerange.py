"""Time ranges: parameter parsing, defaults, presets, and daily bucket geometry.

Ranges are query parameters, so they are resolved on the driver and enter plans as literals. `now`
is always given by the caller. The `*_column` forms do the same on data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
DEFAULT_DAYS = 30

_INSTANT = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:[.,][0-9]+)?"
    r"(?:Z|([+-])([0-9]{2}):([0-9]{2}))$"
)
_DAY_ONLY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


@dataclass(frozen=True)
class TimeRange:
    """Two epoch seconds. Filters take both ends in, the chart widens the end to whole days."""

    start: int
    end: int

    @property
    def days(self) -> int:
        """Number of daily buckets, counted from `start`; the quotient is cut toward zero."""
        span = self.end - self.start
        whole = abs(span) // DAY
        return (whole if span >= 0 else -whole) + 1

    @property
    def bucket_end(self) -> int:
        return self.start + self.days * DAY

    @property
    def start_text(self) -> str:
        return epoch_text(self.start)

    @property
    def end_text(self) -> str:
        return epoch_text(self.end)


def epoch_text(seconds: int) -> str:
    return (date(1970, 1, 1) + timedelta(days=seconds // DAY)).isoformat()


def to_epoch(moment: datetime) -> int:
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=UTC)
    return (moment - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(seconds=1)


def parse_date_input(value: str, is_end: bool) -> int | None:
    """Epoch seconds of an RFC 3339 instant or a plain day; a plain end day means its last second."""
    try:
        if re.fullmatch(_DAY_ONLY, value):
            day = to_epoch(datetime.combine(date.fromisoformat(value), datetime.min.time()))
            return day + DAY - 1 if is_end else day
        found = re.fullmatch(_INSTANT, value)
        if not found:
            return None
        day, hour, minute, second, sign, off_hour, off_minute = found.groups()
        zone = UTC
        if sign:
            offset = timedelta(hours=int(off_hour), minutes=int(off_minute))
            zone = timezone(offset if sign == "+" else -offset)
        moment = datetime.combine(date.fromisoformat(day), datetime.min.time(), zone)
        return to_epoch(moment.replace(hour=int(hour), minute=int(minute), second=int(second)))
    except ValueError:
        return None


def last_days(now: datetime, days: int = DEFAULT_DAYS) -> TimeRange:
    """The last `days` days up to `now`, to the second."""
    end = to_epoch(now)
    return TimeRange(end - days * DAY, end)


def resolve_range(start: str | None, end: str | None, now: datetime) -> TimeRange:
    """Missing or unreadable ends fall back to midnight 30 days ago and to `now`.

    The end never passes `now`. A start after the end is allowed and matches nothing.
    """
    now_s = to_epoch(now)
    first = parse_date_input(start, False) if start else None
    last = parse_date_input(end, True) if end else None
    if first is None:
        first = now_s - now_s % DAY - DEFAULT_DAYS * DAY
    return TimeRange(first, now_s if last is None else min(last, now_s))


def chart_range(start: int, end: int, now: datetime) -> TimeRange:
    """A zero at either side selects the last 30 days."""
    return last_days(now) if start == 0 or end == 0 else TimeRange(start, end)


def presets(today: date) -> dict[str, tuple[date, date]]:
    """The four named ranges of the date picker. Their names are fixed values."""
    month = today.replace(day=1)
    last_of_previous = month - timedelta(days=1)
    return {
        "Last 7 days": (today - timedelta(days=7), today),
        "Last 30 days": (today - timedelta(days=30), today),
        "This month": (month, today),
        "Last month": (last_of_previous.replace(day=1), last_of_previous),
    }


def is_valid_range(start: date | None, end: date | None) -> bool:
    return start is not None and end is not None and start <= end


# ---- column forms -------------------------------------------------------------------------------


def epoch_day(seconds: Column) -> Column:
    """UTC calendar day of epoch seconds, whatever the session zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / DAY).cast("int"))


def epoch_month(seconds: Column) -> Column:
    """First day of the UTC month of epoch seconds."""
    return F.trunc(epoch_day(seconds), "MM")


def epoch_date_text(seconds: Column) -> Column:
    return epoch_day(seconds).cast("string")


def date_input_column(value: Column, is_end: bool) -> Column:
    """Column form of `parse_date_input`; NULL where the text cannot be read."""

    def part(i: int) -> Column:
        return F.regexp_extract(value, _INSTANT, i)

    def number(i: int) -> Column:
        return part(i).try_cast("bigint")

    def day_seconds(text: Column) -> Column:
        day = text.try_cast("date")
        return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY

    shift = F.when(part(5) == "", F.lit(0)).otherwise(
        F.concat(part(5), F.lit("1")).try_cast("bigint") * (number(6) * 3600 + number(7) * 60)
    )
    instant = F.when(
        (number(2) < 24) & (number(3) < 60) & (number(4) < 60),
        day_seconds(part(1)) + number(2) * 3600 + number(3) * 60 + number(4) - shift,
    )
    return F.when(
        value.rlike(_DAY_ONLY), day_seconds(value) + F.lit(DAY - 1 if is_end else 0)
    ).when(value.rlike(_INSTANT), instant)


def range_columns(start: Column, end: Column, now: Column) -> tuple[Column, Column]:
    """Column form of `resolve_range`, with `now` in epoch seconds."""
    midnight = now - F.pmod(now, F.lit(DAY))
    first = F.coalesce(date_input_column(start, False), midnight - DEFAULT_DAYS * DAY)
    last = F.least(F.coalesce(date_input_column(end, True), now), now)
    return first, last


def preset_columns(today: Column) -> dict[str, tuple[Column, Column]]:
    """Column form of `presets`."""
    month = F.trunc(today, "MM")
    last_of_previous = F.date_sub(month, 1)
    return {
        "last_7": (F.date_sub(today, 7), today),
        "last_30": (F.date_sub(today, 30), today),
        "this_month": (month, today),
        "last_month": (F.trunc(last_of_previous, "MM"), last_of_previous),
    }


def valid_range_column(start: Column, end: Column) -> Column:
    return F.coalesce(start <= end, F.lit(False))
