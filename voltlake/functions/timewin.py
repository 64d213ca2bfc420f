"""Clock and window functions: Column -> Column, no Python on the executors.

Minutes of the day run from 0 to 1440; 24:00 is a valid end. ``now`` is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440


def _minutes(text: Column, pattern: str) -> Column:
    h = F.regexp_extract(text, pattern, 1).try_cast("int")
    m = F.regexp_extract(text, pattern, 2).try_cast("int")
    return F.when((m <= 59) & ((h <= 23) | ((h == 24) & (m == 0))), h * 60 + m)


def hhmm_strict(text: Column) -> Column:
    """Minutes of ``HH:MM`` with two-digit hours; null if malformed."""
    return _minutes(text, r"^(\d{2}):(\d{2})$")


def hhmm_lenient(text: Column) -> Column:
    """Minutes of ``H:MM`` or ``HH:MM``; null if malformed."""
    return _minutes(text, r"^(\d{1,2}):(\d{2})$")


def format_minutes(minutes: Column) -> Column:
    """``HH:MM``; 1440 is 24:00."""
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def wrap_minutes(minutes: Column) -> Column:
    """``HH:MM`` on the clock face: 1440 wraps to 00:00 and negatives count back."""
    m = F.pmod(minutes, F.lit(DAY))
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def twelve_hour(minutes: Column) -> Column:
    """``h:MM AM/PM``; an end at 1440 is 12:00 AM."""
    m = F.pmod(minutes, F.lit(DAY))
    h = F.floor(m / 60).cast("int")
    return F.format_string("%d:%02d %s", F.when(h % 12 == 0, 12).otherwise(h % 12), (m % 60).cast("int"), F.when(h < 12, "AM").otherwise("PM"))


def duration_text(minutes: Column) -> Column:
    """``2 h 5 min``, ``2 h`` or ``5 min``."""
    h, m = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    return F.when(h == 0, F.format_string("%d min", m)).when(m == 0, F.format_string("%d h", h)).otherwise(F.format_string("%d h %d min", h, m))


def weekday_index(date: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(date) - 1


def local_minutes(ts: Column, zone: str = "Asia/Dhaka") -> Column:
    """Minutes of the local day of a UTC instant."""
    t = F.from_utc_timestamp(ts, zone)
    return F.hour(t) * 60 + F.minute(t)


def freshness(age_hours: Column, stale_after: float = 36.0) -> Column:
    """unknown, fresh, stale (over ``stale_after`` hours) or very-stale (over four times that)."""
    return F.when(age_hours.isNull() | F.isnan(age_hours), "unknown").when(age_hours > 4 * stale_after, "very-stale").when(age_hours > stale_after, "stale").otherwise("fresh")


def hour_token(token: Column) -> tuple[Column, Column]:
    """(start, end) hours of an ``HH-HH`` token; an end of 0 is 24; null if it is no such token."""
    s = F.regexp_extract(token, r"^(\d{1,2})-(\d{1,2})$", 1).try_cast("int")
    e = F.regexp_extract(token, r"^(\d{1,2})-(\d{1,2})$", 2).try_cast("int")
    return s, F.when(e == 0, 24).otherwise(e)


#: Weekday words, Sunday first (fixed values).
WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]


def weekday_of_word(word: Column) -> Column:
    """Index of an English weekday word in any case; null otherwise."""
    at = F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), F.lower(F.trim(word)))
    return F.when(at > 0, (at - 1).cast("int"))


def merge_windows(windows: Column) -> Column:
    """Windows of one row (array of struct(start_min, end_min)) merged where they touch or overlap; malformed and
    empty ones are dropped. No shuffle: a fold within the row."""
    fine = F.array_sort(F.filter(windows, lambda w: w["start_min"].isNotNull() & w["end_min"].isNotNull() & (w["end_min"] > w["start_min"])))

    def add(acc, w):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start_min"].alias("start_min"), F.greatest(last["end_min"], w["end_min"]).alias("end_min"))))
        return F.when((F.size(acc) > 0) & (w["start_min"] <= F.try_element_at(acc, F.lit(-1))["end_min"]), joined).otherwise(F.concat(acc, F.array(w)))

    return F.aggregate(fine, F.slice(fine, 1, 0), lambda acc, w: F.when(F.size(acc) == 0, F.array(w)).otherwise(add(acc, w)))
