"""Grid alignment and time arithmetic on nanosecond longs, as Columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import LONG_MAX, LONG_MIN, NANOS, CorruptError


def saturating_subtract(a: Column, b: int) -> Column:
    """a - b, held at the ends of the long range."""
    return F.coalesce(F.try_subtract(a, F.lit(b).cast("long")), F.lit(LONG_MIN if b > 0 else LONG_MAX).cast("long"))


@dataclass(frozen=True)
class Aligner:
    """Floors corrected timestamps to a grid. `offset_ns` and `delay_ns` come from clock synchronisation and are subtracted first."""

    grid_ns: int
    offset_ns: int = 0
    delay_ns: int = 0

    def __post_init__(self) -> None:
        if self.grid_ns <= 0:
            raise CorruptError("the grid must be positive")

    def correct(self, ts: Column) -> Column:
        return saturating_subtract(saturating_subtract(ts, self.offset_ns), self.delay_ns)

    def align(self, ts: Column) -> Column:
        """The grid point at or before the corrected time, also for negative times."""
        at = self.correct(ts)
        return F.coalesce(F.try_subtract(at, self._past(at)), F.lit(LONG_MIN).cast("long"))

    def jitter(self, ts: Column) -> Column:
        """Distance from the grid point, 0 to grid_ns - 1."""
        return self._past(self.correct(ts))

    def _past(self, at: Column) -> Column:
        return F.pmod(at, F.lit(self.grid_ns).cast("long"))


def period_ns(rate_hz: float) -> int:
    return int(NANOS / rate_hz)


def epoch_grid(ts: Column, rate_hz: float) -> Column:
    """The last multiple of the rate's period at or before ts."""
    return Aligner(period_ns(rate_hz)).align(ts)


def frame_count(start: int, end: int, hz: int) -> int:
    """Frames of a fixed grid over [start, end]."""
    return (end - start) * hz // NANOS + 1


def floor_div(a: Column, k: int | Column) -> Column:
    """Floor of a / k for a positive k, in longs: the `/` of columns is a division of doubles."""
    k = k if isinstance(k, Column) else F.lit(k).cast("long")
    return F.call_function("div", a - F.pmod(a, k), k)


def frame_time(frame: Column, start: int, hz: int) -> Column:
    """Time of a frame: start + floor(frame * 1e9 / hz), by whole seconds and the rest so that no product overflows."""
    rest = F.pmod(frame, F.lit(hz).cast("long"))
    return F.lit(start).cast("long") + floor_div(frame, hz) * F.lit(NANOS).cast("long") + floor_div(rest * F.lit(NANOS).cast("long"), hz)


def frame_at_or_after(ts: Column, start: int, hz: int) -> Column:
    """The first frame whose time is not before ts: ceil((ts - start) * hz / 1e9), by whole seconds and the rest."""
    span = ts - F.lit(start).cast("long")
    rest = F.pmod(span, F.lit(NANOS).cast("long")) * F.lit(hz).cast("long")
    return floor_div(span, NANOS) * F.lit(hz).cast("long") + floor_div(rest + F.lit(NANOS - 1), NANOS)


def due_ns(ts: Column, first: Column | int, speed: float) -> Column:
    """When a replayed sample is due after the replay's begin."""
    first = first if isinstance(first, Column) else F.lit(first).cast("long")
    return (F.greatest(ts - first, F.lit(0).cast("long")) / F.lit(float(speed))).cast("long")


def lag_us(now: Column | int, ts: Column) -> Column:
    """Age of a sample in whole microseconds, never negative."""
    now = now if isinstance(now, Column) else F.lit(now).cast("long")
    return floor_div(F.greatest(now - ts, F.lit(0).cast("long")), 1000)
