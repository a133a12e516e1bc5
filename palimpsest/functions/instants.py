"""Instants as callers write them: RFC 3339 with up to nine decimals, or a plain date (midnight UTC)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = re.compile(r"(\d{4}-\d\d-\d\d)(?:T(\d\d:\d\d:\d\d)(?:[.,](\d+))?(Z|[+-]\d\d:\d\d))?")


@dataclass(frozen=True, order=True)
class Instant:
    """A UTC time in microseconds without a zone, and the nanoseconds left over."""

    at: datetime
    ns: int = 0

    @property
    def is_zero(self) -> bool:
        """The first instant of the calendar stands for "none given"."""
        return self == ZERO

    def lit(self) -> Column:
        return F.struct(F.lit(self.at).cast("timestamp_ntz"), F.lit(self.ns).cast("smallint"))

    def __str__(self) -> str:
        return f"{self.at:%Y-%m-%dT%H:%M:%S}.{self.at.microsecond:06d}{self.ns:03d}Z"


ZERO = Instant(datetime(1, 1, 1))


def parse(text: str | datetime | Instant) -> Instant:
    if isinstance(text, Instant):
        return text
    if isinstance(text, datetime):
        return Instant(text.astimezone(UTC).replace(tzinfo=None) if text.tzinfo else text)
    found = _FORM.fullmatch(text)
    if not found:
        raise ValueError(f"not a time: {text!r}")
    day, clock, part, zone = found.groups()
    at = datetime.fromisoformat(f"{day}T{clock or '00:00:00'}")
    digits = (part or "")[:9].ljust(9, "0")
    at += timedelta(microseconds=int(digits[:6]))
    if zone and zone != "Z":
        minutes = int(zone[1:3]) * 60 + int(zone[4:])
        at -= timedelta(minutes=minutes if zone[0] == "+" else -minutes)
    return Instant(at, int(digits[6:]))


def now(after: Instant | None = None) -> Instant:
    """The clock, and later than ``after`` in any case."""
    t = Instant(datetime.now(UTC).replace(tzinfo=None))
    if after is not None and t <= after:
        ns = after.ns + 1
        t = Instant(after.at + timedelta(microseconds=ns // 1000), ns % 1000)
    return t
