"""Typed reading of WITH options."""

from __future__ import annotations

import re

from rivulet.errors import PlanError

#: Seconds of the units that durations are given in.
UNITS = {"microsecond": 1e-6, "us": 1e-6, "millisecond": 1e-3, "ms": 1e-3, "second": 1.0, "sec": 1.0, "s": 1.0, "minute": 60.0, "min": 60.0, "m": 60.0, "hour": 3600.0, "h": 3600.0, "day": 86400.0, "d": 86400.0}


class Options:
    def __init__(self, given: dict[str, str]) -> None:
        self.given = given

    def get(self, key: str, default: str | None = None) -> str | None:
        return self.given.get(key, default)

    def boolean(self, key: str, default: bool | None) -> bool | None:
        value = self.given.get(key)
        if value is None:
            return default
        if value.lower() in ("true", "yes"):
            return True
        if value.lower() in ("false", "no"):
            return False
        raise PlanError(f"invalid value of '{key}': {value}; true, yes, false or no")

    def integer(self, key: str, default: int | None) -> int | None:
        value = self.given.get(key)
        if value is None:
            return default
        if not re.fullmatch(r"-?\d+", value):
            raise PlanError(f"invalid value of '{key}': {value}; a whole number")
        return int(value)

    def duration(self, key: str, default: float | None) -> float | None:
        """Seconds, of ``INTERVAL '5' SECOND`` or ``5 seconds``."""
        value = self.given.get(key)
        if value is None:
            return default
        m = re.fullmatch(r"(?:interval\s+)?'?\s*(\d+(?:\.\d+)?)\s*'?\s*([a-z]+?)'?", value.strip().lower())
        unit = m and (m[2] if m[2] in UNITS else m[2].rstrip("s"))
        if not m or unit not in UNITS:
            raise PlanError(f"invalid duration of '{key}': {value}")
        return float(m[1]) * UNITS[unit]

    def under(self, prefix: str) -> dict[str, str]:
        return {k.removeprefix(prefix): v for k, v in self.given.items() if k.startswith(prefix)}
