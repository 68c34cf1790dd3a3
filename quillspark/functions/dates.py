"""Date literals, truncated dates and date arithmetic, in milliseconds UTC."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import UTC, datetime, timedelta

from ..errors import RequestError

#: Representable span of interval fields.
FIRST, LAST = -9223372036854, 9223372036854
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_UNITS = {"YEAR": "year", "MONTH": "month", "WEEK": "week", "DAY": "day", "DATE": "day", "HOUR": "hour", "MINUTE": "minute", "SECOND": "second", "MILLI": "milli", "MILLISECOND": "milli"}
_TRUNCATED = re.compile(r"([+-]?\d{4,9})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d)(?::(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?)?)?)?)?Z?")


def millis(when: datetime) -> int:
    delta = when - _EPOCH
    return (delta.days * 86400 + delta.seconds) * 1000 + delta.microseconds // 1000


def clamp(ms: int) -> int:
    return max(FIRST, min(LAST, ms))


def truncated(text: str) -> tuple[int, int]:
    """First and last millisecond of a date of any precision, from a year to a fraction of a second."""
    found = _TRUNCATED.fullmatch(text.strip())
    if not found:
        raise RequestError(f"bad date: {text}")
    parts = [int(p) if p else None for p in found.groups()[:6]]
    year = parts[0]
    if not 1 <= year <= 9998:
        return (FIRST, FIRST) if year < 1 else (LAST, LAST)
    try:
        start = datetime(year, parts[1] or 1, parts[2] or 1, parts[3] or 0, parts[4] or 0, parts[5] or 0, tzinfo=UTC)
    except ValueError:
        raise RequestError(f"bad date: {text}") from None
    if found[7]:
        ms = millis(start) + int((found[7] + "000")[:3])
        return clamp(ms), clamp(ms)
    unit = ("year", "month", "day", "hour", "minute", "second")[sum(p is not None for p in parts) - 1]
    return clamp(millis(start)), clamp(millis(shift(start, unit, 1)) - 1)


def shift(when: datetime, unit: str, n: int) -> datetime:
    """``n`` units on; days beyond a month's end become its last day."""
    try:
        if unit == "year":
            n, unit = 12 * n, "month"
        if unit == "month":
            months = when.year * 12 + when.month - 1 + n
            year, month = divmod(months, 12)
            return when.replace(year=year, month=month + 1, day=min(when.day, monthrange(year, month + 1)[1]))
        return when + {"week": timedelta(weeks=1), "day": timedelta(days=1), "hour": timedelta(hours=1), "minute": timedelta(minutes=1), "second": timedelta(seconds=1), "milli": timedelta(milliseconds=1)}[unit] * n
    except (OverflowError, ValueError):
        raise RequestError("date out of range") from None


def floor(when: datetime, unit: str) -> datetime:
    if unit == "week":
        when = when - timedelta(days=when.weekday())
        unit = "day"
    if unit == "milli":
        return when.replace(microsecond=when.microsecond // 1000 * 1000)
    order = ["year", "month", "day", "hour", "minute", "second"]
    zero = {"month": 1, "day": 1, "hour": 0, "minute": 0, "second": 0}
    return when.replace(microsecond=0, **{u: zero[u] for u in order[order.index(unit) + 1 :]})


def date_math(text: str, now: datetime | None = None) -> int:
    """``NOW`` or a date, then any of /UNIT, +nUNIT, -nUNIT, from left to right."""
    now = now or datetime.now(UTC)
    found = re.match(r"NOW|[+-]?\d{4,9}[^/+]*?Z(?=[/+-]|$)", text)
    if not found:
        return truncated(text)[0]
    when = now if found[0] == "NOW" else _EPOCH + timedelta(milliseconds=truncated(found[0])[0])
    rest = text[found.end() :]
    while rest:
        step = re.match(r"/([A-Z]+)|([+-]\d+)([A-Z]+)", rest)
        name = step and (step[1] or step[3])
        unit = name and _UNITS.get(name, _UNITS.get(name.removesuffix("S")))
        if not unit:
            raise RequestError(f"bad date math: {text}")
        when = floor(when, unit) if step[1] else shift(when, unit, int(step[2]))
        rest = rest[step.end() :]
    return clamp(millis(when))


def interval(text: str, now: datetime | None = None) -> tuple[int, int]:
    """First and last millisecond of a truncated date or of ``[a TO b]``; braces count as brackets."""
    text = text.strip()
    found = re.fullmatch(r"[\[{]\s*(\S+)\s+TO\s+(\S+)\s*[\]}]", text)
    if not found:
        if text.startswith("NOW"):
            ms = date_math(text, now)
            return ms, ms
        return truncated(text)
    ends = []
    for k, part in enumerate(found.groups()):
        if part == "*":
            ends.append((FIRST, LAST)[k])
        elif part.startswith("NOW") or re.search(r"Z[/+-]", part):
            ends.append(date_math(part, now))
        else:
            ends.append(truncated(part)[k])
    if ends[0] > ends[1]:
        raise RequestError(f"interval ends before it starts: {text}")
    return ends[0], ends[1]


def instant(text: str, now: datetime | None = None) -> int:
    """A full date and time, or date math."""
    if text.startswith("NOW") or re.search(r"Z[/+-]", text):
        return date_math(text, now)
    try:
        when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise RequestError(f"bad date: {text}") from None
    if when.tzinfo is None:
        raise RequestError(f"date without a time zone: {text}")
    return millis(when)
