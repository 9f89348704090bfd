"""Date and time functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ddmmmyy(x: Col) -> Column:
    """``05 jan 24``."""
    return F.lower(F.date_format(_c(x), "dd MMM yy"))


def parse_timestamp(x: Col) -> Column:
    """An ISO timestamp in UTC; digits of a second beyond the sixth are cut; null if it does not read."""
    text = F.regexp_replace(F.regexp_replace(_c(x), "Z$", ""), r"(\.\d{6})\d+$", "$1")
    return text.try_cast("timestamp_ntz")


def resolve_date(x: Col, default: str = "1900-01-01") -> Column:
    """``Mon 5 Jan 24``, ``5 Jan 2024`` and the like; the weekday is not checked; two-digit years from 69 on are of the last century."""
    t = F.regexp_replace(F.trim(_c(x)), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    p = [F.regexp_extract(t, r"(?i)^(\d{1,2})\s+([a-z]{3})\s+(\d{2}|\d{4})$", k) for k in (1, 2, 3)]
    month = F.map_from_arrays(F.array(*[F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")]), F.array(*[F.lit(k) for k in range(1, 13)]))
    y = p[2].try_cast("int")
    year = F.when(F.length(p[2]) == 4, y).when(y >= 69, 1900 + y).otherwise(2000 + y)
    return F.coalesce(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.try_element_at(month, F.lower(p[1])).cast("string"), 2, "0"), F.lpad(p[0], 2, "0")).try_cast("date"), F.lit(default).cast("date"))


def range_hours(x: Col) -> Column:
    """Hours of ``h[:mm]-h[:mm]`` or ``h[:mm] h[:mm]`` at the start of a text; an end before the start is 12 hours later; null without a range."""
    part = lambda k: F.regexp_extract(_c(x), r"^\s*(\d+):?(\d*)(?:am|pm)?(?:-|\s+)(\d+):?(\d*)(?:am|pm)?", k).try_cast("double")
    begin, end = part(1) + F.coalesce(part(2), F.lit(0.0)) / 60, part(3) + F.coalesce(part(4), F.lit(0.0)) / 60
    return F.when(end < begin, end + 12 - begin).otherwise(end - begin)


def short_weekday(x: Col) -> Column:
    """A line with its leading weekday in three letters: ``tuesday:`` and ``tues:`` are ``tue:``."""
    return F.regexp_replace(F.lower(_c(x)), r"^(sun|mon|tue|wed|thu|fri|sat)(?:s|nes|rs|ur)?(?:day)?:", "$1:")


def transcript_time(x: Col) -> Column:
    """``H:MM:SS`` without leading ``00:`` and then without one leading zero."""
    return F.regexp_replace(F.regexp_replace(_c(x), "^00:", ""), "^0", "")


def shown(x: Col | None = None) -> Column:
    """``2024-01-05 17:30:00`` of a timestamp, by default of now."""
    return F.date_format(F.current_timestamp() if x is None else _c(x), "yyyy-MM-dd HH:mm:ss")


def seconds(x: Col | None = None) -> Column:
    """Whole seconds since 1970 of a timestamp in the session's zone, by default of now."""
    return F.unix_seconds((F.current_timestamp() if x is None else _c(x)).cast("timestamp"))
