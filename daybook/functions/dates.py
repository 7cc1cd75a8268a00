"""Date functions of requests and of columns."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_MS = 30 * 86_400_000


def iso(at: datetime) -> str:
    return at.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = rf"(?P<name>{'|'.join(MONTHS)})[a-z]*\.?"
_WRITTEN = re.compile(
    rf"""(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?
    (?:(?P<y1>\d{{4}})[/-](?P<m1>\d\d?)[/-](?P<d1>\d\d?)|(?P<m2>\d\d?)[/-](?P<d2>\d\d?)[/-](?P<y2>\d{{4}})|{_MONTH}\s+(?P<d3>\d\d?),?\s+(?P<y3>\d{{4}})|(?P<d4>\d\d?)[\s-]+{_MONTH.replace("name", "name4")},?[\s-]+(?P<y4>\d{{4}}))
    (?:,?[\sT]+(?P<h>\d\d?):(?P<min>\d\d)(?::(?P<s>\d\d)(?:\.(?P<ms>\d{{1,3}})\d*)?)?\s*(?P<half>[ap]m)?)?
    \s*(?P<utc>z|gmt|utc)?\s*(?P<off>[+-]\d\d:?\d\d)?(?:\s*\([^()]*\))?""",
    re.VERBOSE | re.IGNORECASE,
)


def _written(value: str, zone: str) -> datetime:
    """A time in one of the usual forms that aren't ISO's: 2026/1/5, 1/5/2026 (the month first), Jan 5, 2026 and 5 January
    2026, with a weekday before it, and a time, am or pm, and a zone or an offset after it. Without these the zone's own
    midnight; a year, or a year and month, is UTC's."""
    short = re.fullmatch(r"(\d{4})(?:-(\d\d))?", value)
    if short:
        return datetime(int(short[1]), int(short[2] or 1), 1, tzinfo=UTC)
    m = _WRITTEN.fullmatch(value)
    if not m:
        raise ValueError(value)
    g = m.groupdict()
    name = (g["name"] or g["name4"] or "").lower()
    year, month, day = int(g["y1"] or g["y2"] or g["y3"] or g["y4"]), MONTHS.index(name) + 1 if name else int(g["m1"] or g["m2"]), int(g["d1"] or g["d2"] or g["d3"] or g["d4"])
    hour, half = int(g["h"] or 0), (g["half"] or "").lower()
    if half and not 1 <= hour <= 12:
        raise ValueError(value)
    hour = hour % 12 + 12 * (half == "pm") if half else hour
    at = datetime(year, month, day, hour, int(g["min"] or 0), int(g["s"] or 0), int((g["ms"] or "0").ljust(3, "0")) * 1000)
    if g["off"]:
        hours, minutes = int(g["off"][1:3]), int(g["off"][-2:])
        return (at - (1 if g["off"][0] == "+" else -1) * timedelta(hours=hours, minutes=minutes)).replace(tzinfo=UTC)
    return at.replace(tzinfo=UTC if g["utc"] else ZoneInfo(zone))


def boundary(value: str | None, end: bool, zone: str = "UTC") -> str | None:
    """A request's since or until as UTC time in text: a calendar day is a day of the zone, from its start or to its
    last millisecond (a day beyond its month's end rolls over); anything else is a time, ISO's or in a usual form."""
    if not value:
        return None
    day = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", value.strip())
    try:
        if day:
            year, month, number = map(int, day.groups())
            base = datetime(year, 1, 1) if month == 0 else datetime(year + (month - 1) // 12, (month - 1) % 12 + 1, 1)
            local = (base + timedelta(days=number - 1)).replace(tzinfo=ZoneInfo(zone))
            return iso(local.replace(hour=23, minute=59, second=59, microsecond=999_000) if end else local)
        try:
            at = _written(value.strip(), zone)
        except ValueError:
            at = datetime.fromisoformat(value.strip())
        return iso(at if at.tzinfo else at.replace(tzinfo=ZoneInfo(zone)))
    except (ValueError, OverflowError):
        raise ValueError(f"{'until' if end else 'since'}: {value!r} is neither a day (YYYY-MM-DD) nor a time") from None


def day_of(ts: Column, zone: str) -> Column:
    """The calendar day of a UTC time in text, in the zone."""
    return F.date_format(F.from_utc_timestamp(F.try_to_timestamp(ts), zone), "yyyy-MM-dd")


def age_months(ts: Column, now: str) -> Column:
    """Months of 30 days from ts to now, never below 0; null where ts is no time."""
    ms = F.unix_millis(F.try_to_timestamp(F.lit(now))) - F.unix_millis(F.try_to_timestamp(ts))
    return F.greatest(F.lit(0), ms) / F.lit(float(MONTH_MS))


def display(ts: Column, zone: str = "UTC") -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(F.try_to_timestamp(ts), zone), "MM-dd HH:mm"), F.lit(""))
