"""Range strings such as 7d, 24h or 1m."""

from __future__ import annotations

from datetime import datetime, timedelta


def range_days(text: str, months: bool = True, default: int = 7) -> int:
    """Whole days; hours round down, so 12h is zero days."""
    t = text.lower().strip()
    unit, number = t[-1:], t[:-1]
    if unit == "d":
        return int(number)
    if unit == "h":
        return int(number) // 24
    if unit == "m" and months:
        return int(number) * 30
    return default


def range_hours(text: str, default: int = 24) -> int:
    t = text.lower().strip()
    scale = {"h": 1, "d": 24}.get(t[-1:])
    return default if scale is None else int(t[:-1]) * scale


def since_days(as_of: datetime, text: str, months: bool = True) -> datetime:
    return as_of - timedelta(days=range_days(text, months))


def since_hours(as_of: datetime, text: str) -> datetime:
    return as_of - timedelta(hours=range_hours(text))
