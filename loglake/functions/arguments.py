"""Driver-side reading of user arguments: durations, sizes, dates, level expressions."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from loglake.model import LEVELS, SEVERITY, level_name

_MILLIS = {"ms": 1, "s": 1_000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000}
_BYTES = {"": 1, "B": 1, "KB": 1024, "MB": 1024**2, "GB": 1024**3}
_DATE_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d")


def duration_millis(text: str | int, default_unit: str = "s") -> int:
    """``500ms``, ``2s``, ``15m``, ``1h``, ``7d`` as milliseconds; a bare number takes ``default_unit``."""
    match = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", str(text).lower())
    if not match or (match[2] and match[2] not in _MILLIS):
        raise ValueError(f"not a duration: {text!r}")
    return int(match[1]) * _MILLIS[match[2] or default_unit]


def interval_seconds(text: str | int) -> int:
    """Bucket width; a bare number means minutes. Must be whole, positive seconds."""
    millis = duration_millis(text, default_unit="m")
    if millis <= 0 or millis % 1000:
        raise ValueError(f"interval must be at least one whole second: {text!r}")
    return millis // 1000


def size_bytes(text: str | int) -> int:
    """``100``, ``100B``, ``10KB``, ``5MB``, ``1GB`` (1024-based) as bytes."""
    match = re.fullmatch(r"\s*(\d+)\s*([A-Z]*)\s*", str(text).upper())
    if not match or match[2] not in _BYTES:
        raise ValueError(f"not a size: {text!r}")
    size = int(match[1]) * _BYTES[match[2]]
    if size <= 0:
        raise ValueError(f"size must be positive: {text!r}")
    return size


def datetime_argument(value: str | datetime) -> datetime:
    """A date with optional time; a bare date means its midnight."""
    if isinstance(value, datetime):
        return value
    for pattern in _DATE_FORMATS:
        try:
            return datetime.strptime(value.strip(), pattern)
        except ValueError:
            continue
    raise ValueError(f"not a date or time: {value!r}")


def time_ago(text: str | int, now: datetime) -> datetime:
    """The moment ``text`` before ``now``; a bare number means minutes."""
    return now - timedelta(milliseconds=duration_millis(text, default_unit="m"))


def level_expression(text: str | None) -> list[str] | None:
    """Levels selected by ``ERROR`` (that level), ``ERROR+`` (it and above) or blank (None: all)."""
    if text is None or not text.strip():
        return None
    cleaned = text.strip()
    if cleaned.endswith("+"):
        return LEVELS[SEVERITY[level_name(cleaned[:-1])] :]
    return [level_name(cleaned)]
