"""Time buckets: year, month, day, hour, minute, second."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Granularity letters and the form of their keys.
GRANULARITIES = ("y", "m", "d", "h", "n", "s")
KEY_FORMAT = {"y": "yyyy", "m": "yyyyMM", "d": "yyyyMMdd", "h": "yyyyMMddHH", "n": "yyyyMMddHHmm", "s": "yyyyMMddHHmmss"}

_STEP = {
    "y": "INTERVAL '1' YEAR",
    "m": "INTERVAL '1' MONTH",
    "d": "INTERVAL '1' DAY",
    "h": "INTERVAL '1' HOUR",
    "n": "INTERVAL '1' MINUTE",
    "s": "INTERVAL '1' SECOND",
}
_COARSER = {"y": "y", "m": "y", "d": "y", "h": "m", "n": "d", "s": "h"}


@dataclass(frozen=True)
class Calendar:
    granularity: str

    def __post_init__(self):
        object.__setattr__(self, "granularity", self.granularity.lower())
        if self.granularity not in GRANULARITIES:
            raise ValueError(f"unknown granularity {self.granularity!r}")

    @property
    def by_date(self) -> bool:
        """Whether only the date part of the spans matters."""
        return self.granularity in ("y", "m", "d")

    @property
    def smallest(self) -> Column:
        """Resolution of the span ends: a day, or a second."""
        return F.expr(_STEP["d" if self.by_date else "s"])

    def resolve(self, ts: Column) -> Column:
        """A span end at that resolution."""
        return truncate(ts, "d" if self.by_date else "s")

    def start(self, ts: Column) -> Column:
        return truncate(ts, self.granularity)

    def next(self, bucket: Column) -> Column:
        return bucket + F.expr(_STEP[self.granularity])

    def previous(self, bucket: Column) -> Column:
        return bucket - F.expr(_STEP[self.granularity])

    def key(self, bucket: Column) -> Column:
        return F.date_format(bucket, KEY_FORMAT[self.granularity])

    def coarser(self, bucket: Column) -> Column:
        """A wider bucket, by which long time lines are cut into blocks."""
        return truncate(bucket, _COARSER[self.granularity])


def truncate(ts: Column, unit: str) -> Column:
    """Start of the unit, whatever the session's time zone.

    ``ts`` is named only once.  These expressions are nested and copied into filters, where one
    that names it for every date field would grow with each level.
    """
    if unit in ("y", "m"):
        return F.trunc(ts.cast("date"), {"y": "year", "m": "month"}[unit]).cast("timestamp_ntz")
    if unit == "d":
        return ts.cast("date").cast("timestamp_ntz")
    width, rest = {"h": (13, ":00:00"), "n": (16, ":00"), "s": (19, "")}[unit]
    return F.concat(F.left(ts.cast("string"), F.lit(width)), F.lit(rest)).cast("timestamp_ntz")


def parse_time(text: str, end: bool = False) -> str:
    """``YYYYMMDD``, ``YYYYMMDDhhmmss`` or the dashed forms, as ``YYYY-MM-DD hh:mm:ss``.

    A day alone is its first second, or as the ``end`` of a range its last one.
    """
    digits = "".join(ch for ch in text if ch.isdigit())
    if len(digits) == 8:
        digits += "235959" if end else "000000"
    if len(digits) != 14:
        raise ValueError(f"malformed time {text!r}")
    d = digits
    return f"{d[:4]}-{d[4:6]}-{d[6:8]} {d[8:10]}:{d[10:12]}:{d[12:]}"
