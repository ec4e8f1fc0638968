"""Time windows of since: and until:, resolved on the driver against a given now."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

DURATION = re.compile(r"^(\d+)(min|h|d|w|m|y)$")
DATE = re.compile(r"^(\d{4})-(\d{2})(?:-(\d{2}))?$")


def add_months(when: datetime, months: int) -> datetime:
    """The same day of another month; a day that month lacks runs over into the next one."""
    month = when.year * 12 + when.month - 1 + months
    first = when.replace(year=month // 12, month=month % 12 + 1, day=1)
    return first + timedelta(days=when.day - 1)


def is_window(value: str) -> bool:
    if value.lower() in ("today", "yesterday"):
        return True
    m = DATE.match(value)
    if m:
        try:
            datetime(int(m[1]), int(m[2]), int(m[3] or 1))
        except ValueError:
            return False
        return True
    m = DURATION.match(value)
    return bool(m) and len(m[1]) <= 5


def since(now: datetime, value: str) -> datetime:
    """When a window starts."""
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if value.lower() == "today":
        return midnight
    if value.lower() == "yesterday":
        return midnight - timedelta(days=1)
    if m := DATE.match(value):
        return midnight.replace(year=int(m[1]), month=int(m[2]), day=int(m[3] or 1))
    m = DURATION.match(value)
    n = int(m[1])
    if m[2] in ("m", "y"):
        return add_months(now, -n * (12 if m[2] == "y" else 1))
    return now - timedelta(**{{"min": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2]]: n})


def until(now: datetime, value: str) -> datetime:
    """When the named period ends; a length of time ends where since: would start."""
    start = since(now, value)
    if value.lower() in ("today", "yesterday"):
        return start + timedelta(days=1)
    if m := DATE.match(value):
        return start + timedelta(days=1) if m[3] else add_months(start, 1)
    return start
