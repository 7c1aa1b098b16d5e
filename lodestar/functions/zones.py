"""Versioned zone transition tables and vectorised wall-clock conversion.

A zone is two sorted arrays: the wall-clock second from which an offset holds, and the offsets. One
binary search per value gives the instant; Python's own time zone objects are never called per row.
"""

from __future__ import annotations

import datetime as dt
import warnings
import importlib.metadata
from dataclasses import dataclass, field
from pathlib import Path
from zoneinfo import ZoneInfo

import numpy as np

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
DAY = 86_400
#: A transition is looked for between samples this far apart; no zone changes twice within it.
STEP = 5 * DAY


def database_version() -> str:
    """Version of the zone database the tables are built from."""
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        pass
    for root in ("/usr/share/zoneinfo", "/usr/lib/zoneinfo"):
        for name in ("tzdata.zi", "+VERSION"):
            p = Path(root, name)
            if p.exists():
                return p.open().readline().replace("# version", "").strip()
    return "unknown"


@dataclass(frozen=True)
class ZoneTable:
    """Transitions of one zone: ``at`` (UTC seconds), ``offsets`` (one more than ``at``), ``wall`` thresholds."""

    name: str
    at: np.ndarray
    offsets: np.ndarray
    wall: np.ndarray

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        """Instants of wall times. A time that occurs twice is the first; a skipped one moves forward by the gap."""
        return wall - self.offsets[np.searchsorted(self.wall, wall, side="right")]

    def to_wall(self, utc: np.ndarray) -> np.ndarray:
        """Wall times of instants."""
        return utc + self.offsets[np.searchsorted(self.at, utc, side="right")]


def build(name: str, first_year: int = 1900, last_year: int = 2100) -> ZoneTable:
    """The table of one zone: sample its offset every ``STEP`` and bisect each change to the second."""
    zone = ZoneInfo(name)

    def offset(t: int) -> int:
        return int((EPOCH + dt.timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())

    start = int((dt.datetime(first_year, 1, 1, tzinfo=dt.timezone.utc) - EPOCH).total_seconds())
    end = int((dt.datetime(last_year, 1, 1, tzinfo=dt.timezone.utc) - EPOCH).total_seconds())
    at, offsets = [], [offset(start)]
    for t in range(start, end, STEP):
        if (after := offset(t + STEP)) != offsets[-1]:
            lo, hi = t, t + STEP
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == offsets[-1] else (lo, mid)
            at.append(hi)
            offsets.append(after)
    a, o = np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)
    return ZoneTable(name, a, o, a + np.maximum(o[:-1], o[1:]))


@dataclass(frozen=True)
class ZoneTables:
    """Tables of several zones under one database version; names the database doesn't know are in ``unknown``."""

    version: str
    tables: dict[str, ZoneTable] = field(default_factory=dict)
    unknown: tuple[str, ...] = ()

    @staticmethod
    def load(names) -> "ZoneTables":
        tables, unknown = {}, []
        for n in sorted({x for x in names if x}):
            try:
                tables[n] = build(n)
            except (KeyError, ValueError, OSError):  # a name the database doesn't know
                unknown.append(n)
        if unknown:
            warnings.warn(f"zones not in the database, their values without a zone state no instant: {', '.join(unknown)}", stacklevel=2)
        return ZoneTables(database_version(), tables, tuple(unknown))
