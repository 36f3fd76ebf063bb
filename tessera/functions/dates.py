"""Dates and numbers as documents spell them."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone


def iso_date(text: str) -> bool:
    """Whether a cell is an ISO date, with or without a time, that exists."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?", text.strip()):
        return False
    try:
        datetime.fromisoformat(text.strip())
    except ValueError:
        return False
    return True


def shown(value: str) -> str | None:
    """An ISO time in UTC with a Z; a date alone at midnight."""
    try:
        at = datetime.fromisoformat(value)
    except ValueError:
        return None
    at = at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
    if (at.hour, at.minute, at.second, at.microsecond) == (0, 0, 0, 0):
        return at.strftime("%Y-%m-%d")
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def pdf_date(text: str) -> str | None:
    """D:YYYYMMDDHHmmSSOHH'mm' in part or in full, as a UTC time."""
    m = re.match(r"(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([Zz+-])(\d{2})?'?(\d{2})?'?)?$", text.strip())
    if not m:
        return None
    parts = [int(x) if x else d for x, d in zip(m.groups()[:6], (1, 1, 1, 0, 0, 0), strict=True)]
    ahead = timedelta(hours=int(m[8] or 0), minutes=int(m[9] or 0)) * (-1 if m[7] == "-" else 1)
    try:
        return shown(datetime(*parts, tzinfo=timezone(ahead)).isoformat())
    except ValueError:
        return None


def filetime(ticks: int) -> str | None:
    """Units of 100 ns since 1601."""
    if ticks <= 0:
        return None
    return (datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%dT%H:%M:%SZ")


def serial_date(n: float) -> str | None:
    """A spreadsheet's day number, with its leap day of 1900."""
    if not 1 <= n < 2958466:
        return None
    return shown((datetime(1899, 12, 30) + timedelta(days=n + (n < 60))).replace(microsecond=0).isoformat())


def looks_serial(values: list[float], header: str) -> bool:
    """Whether a numeric column is a suspicion of day numbers: whole numbers of 1990 to 2050 under a heading that names a date."""
    return bool(values) and all(float(v).is_integer() and 32874 <= v <= 55153 for v in values) and bool(re.search(r"(?i)date|day|datum|jour|fecha", header))


def number_format(value: float, pattern: str) -> str | None:
    """A spreadsheet's number under 0, 0.00, #,##0.00, 0%, 0.0%, with a currency sign in front; null for patterns beyond these."""
    m = re.fullmatch(r"([$€£]?)(#,##)?0(?:\.(0+))?(%?)", pattern)
    if not m:
        return None
    places = len(m[3] or "")
    n = value * 100 if m[4] else value
    text = f"{abs(n):,.{places}f}" if m[2] else f"{abs(n):.{places}f}"
    return f"{'-' if n < 0 else ''}{m[1]}{text}{m[4]}"


def a1(text: str) -> list[int] | None:
    """[row, column] from 0 of a reference such as $B$12."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?([1-9]\d{0,6})", text)
    if not m:
        return None
    n = 0
    for c in m[1].upper():
        n = n * 26 + ord(c) - 64
    return [int(m[2]) - 1, n - 1]
