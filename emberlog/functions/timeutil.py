"""Durations and time windows. The present is always an argument."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

UNITS = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hr": 3600, "d": 86400, "day": 86400, "days": 86400, "w": 604800, "week": 604800, "weeks": 604800}
_DURATION = re.compile(r"^\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]+)\s*$")


@dataclass(frozen=True)
class Window:
    """A closed window: both ends belong to it."""

    start: datetime
    end: datetime

    def shifted(self, by: timedelta) -> Window:
        return Window(self.start - by, self.end - by)


def parse_duration(text: str) -> timedelta:
    """30m, 24h, 1.5h, 7d, 2 weeks."""
    m = _DURATION.match(text or "")
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"invalid duration: {text!r}")
    return timedelta(seconds=float(m[1]) * UNITS[m[2].lower()])


def _utc(value: datetime | str) -> datetime:
    at = datetime.fromisoformat(value.replace("Z", "+00:00")) if isinstance(value, str) else value
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def resolve_window(now: datetime, since: str | None = None, from_time: datetime | str | None = None, to_time: datetime | str | None = None) -> Window:
    """`since` goes before explicit bounds; a start without end runs to now; an end alone is an error."""
    if since:
        return Window(now - parse_duration(since), now)
    if from_time is None:
        raise ValueError("give since, or from_time with or without to_time")
    start, end = _utc(from_time), _utc(to_time) if to_time is not None else now
    if start >= end:
        raise ValueError("the window starts at or after its end")
    return Window(start, end)


def baseline_window(window: Window, length: timedelta) -> Window:
    """The time right before a window; the common instant belongs to both."""
    return Window(window.start - length, window.start)


def compare_windows(now: datetime, since: str, baseline: str) -> tuple[Window, Window]:
    """A: the last `since`; B: as long, `baseline` earlier."""
    a = resolve_window(now, since)
    return a, a.shifted(parse_duration(baseline))


def format_window(w: Window) -> str:
    return f"{w.start:%Y-%m-%d %H:%M} – {w.end:%Y-%m-%d %H:%M} UTC"
