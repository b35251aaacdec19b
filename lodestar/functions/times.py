"""Times of the query language: NOW, PERIOD, DATEDIFF, zones and literal timestamps. The clock can be injected."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

UNITS = ("SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")
_STEP = {"SECOND": timedelta(seconds=1), "MINUTE": timedelta(minutes=1), "HOUR": timedelta(hours=1), "DAY": timedelta(days=1), "WEEK": timedelta(weeks=1)}


def zone(text: str | None):
    """GMT+h[:mm], an offset, or a zone's name."""
    if not text or text in ("UTC", "GMT"):
        return timezone.utc
    m = re.fullmatch(r"(?:GMT|UTC)?([+-])(\d{1,2})(?::?(\d{2}))?", text)
    if m:
        t = timedelta(hours=int(m[2]), minutes=int(m[3] or 0))
        return timezone(-t if m[1] == "-" else t)
    try:
        return ZoneInfo(text)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        raise ValueError(f"unknown zone {text}") from None


def zone_name(text: str | None) -> str:
    """The zone as Spark writes it."""
    z = zone(text)
    if isinstance(z, ZoneInfo):
        return z.key
    s = int(z.utcoffset(None).total_seconds())
    return f"{'-' if s < 0 else '+'}{abs(s) // 3600:02d}:{abs(s) % 3600 // 60:02d}"


def parse(text: str) -> datetime:
    """yyyy[-MM[-dd[ HH[:mm[:ss[.SSS]]]]]], missing parts being first or zero; naive, in UTC."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[ T](\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:[.,](\d{1,6}))?)?)?)?)?)?Z?", text.strip())
    if not m:
        raise ValueError(f"not a timestamp: {text}")
    y, mo, d, h, mi, s, f = m.groups()
    return datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), int((f or "0").ljust(6, "0")))


def add(t: datetime, n: int, unit: str) -> datetime:
    unit = unit.upper().rstrip("S") if unit.upper() != "S" else unit
    if unit in _STEP:
        return t + n * _STEP[unit]
    months = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[unit] * n + t.year * 12 + t.month - 1
    y, m = divmod(months, 12)
    last = (datetime(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return t.replace(year=y, month=m + 1, day=min(t.day, last))


def floor(t: datetime, unit: str) -> datetime:
    t = t.replace(microsecond=0)
    if unit == "SECOND":
        return t
    t = t.replace(second=0)
    if unit == "MINUTE":
        return t
    t = t.replace(minute=0)
    if unit == "HOUR":
        return t
    t = t.replace(hour=0)
    if unit == "WEEK":
        return t - timedelta(days=t.weekday())
    if unit in ("MONTH", "QUARTER", "YEAR"):
        t = t.replace(day=1)
    if unit == "QUARTER":
        return t.replace(month=(t.month - 1) // 3 * 3 + 1)
    return t.replace(month=1) if unit == "YEAR" else t


def now(args: str, clock: datetime) -> datetime:
    """NOW(zone ± n unit): the clock, in the zone's wall time, moved."""
    m = re.fullmatch(r"\s*(.*?)\s*(?:([+-]?\d+)\s+([A-Za-z]+))?\s*", args or "")
    z = m[1].strip()
    t = clock.replace(tzinfo=timezone.utc).astimezone(zone(z)).replace(tzinfo=None) if z else clock
    return add(t, int(m[2]), m[3]) if m[2] else t


def period(name: str, z: str, clock: datetime, n: int = 1) -> tuple[datetime, datetime, bool]:
    """(start, end, whether the end belongs to it). TODAY and THIS*: the current unit; LAST*: from now back by n units."""
    t = clock.replace(tzinfo=timezone.utc).astimezone(zone(z)).replace(tzinfo=None) if z else clock
    name = name.upper()
    unit = "DAY" if name == "TODAY" else name[4:]
    if name.startswith("LAST"):
        return add(t, -n, unit), t, True
    start = floor(t, unit)
    return start, add(start, 1, unit), False


def frequency(text: str) -> timedelta:
    """An interval such as "1 HOUR" or "30 MINUTES"."""
    n, unit = text.split()
    unit = unit.upper().rstrip("S")
    return int(n) * (_STEP[unit] if unit in _STEP else {"MONTH": timedelta(days=30), "YEAR": timedelta(days=365)}[unit])


def datediff(unit: str, a: datetime, b: datetime) -> int:
    """b - a: months, quarters and years by the calendar's fields, others by their length, towards zero."""
    unit = unit.upper().rstrip("S")
    if unit == "YEAR":
        return b.year - a.year
    if unit == "MONTH":
        return (b.year - a.year) * 12 + b.month - a.month
    if unit == "QUARTER":
        return (b.year - a.year) * 4 + (b.month - 1) // 3 - (a.month - 1) // 3
    return int((b - a) / _STEP[unit])
