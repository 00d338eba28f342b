"""Schemas, limits, errors and configuration."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1
SERIES_MAX = 2**32 - 2
#: A series id that marks control records in a committed log; never data.
SENTINEL_SERIES = 2**32 - 1
NANOS = 1_000_000_000

#: One sample: nanoseconds in the caller's clock, and a value (NaN allowed).
SAMPLE = T.StructType([T.StructField("ts", T.LongType(), False), T.StructField("value", T.DoubleType(), False)])
#: Samples with their provenance: layer 0 is not sealed yet, 1 is sealed; seg_seq and seq give the order of writing.
SAMPLES = T.StructType(
    [
        T.StructField("series", T.LongType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("value", T.DoubleType(), False),
        T.StructField("layer", T.IntegerType(), False),
        T.StructField("seg_seq", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)
SEGMENTS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("series", T.LongType()),
        T.StructField("seg_seq", T.LongType()),
        T.StructField("min_ts", T.LongType()),
        T.StructField("max_ts", T.LongType()),
        T.StructField("min_val", T.DoubleType()),
        T.StructField("max_val", T.DoubleType()),
        T.StructField("count", T.LongType()),
        T.StructField("tier", T.StringType()),
        T.StructField("home", T.LongType()),
        T.StructField("distinct", T.BooleanType()),
        T.StructField("mates", T.LongType()),
    ]
)
BINDINGS = T.StructType([T.StructField("topic", T.StringType()), T.StructField("series", T.LongType()), T.StructField("durable", T.BooleanType()), T.StructField("field", T.StringType())])
MESSAGES = T.StructType([T.StructField("topic", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("payload", T.StringType())])


class EngineError(Exception):
    """Any failure of the engine."""


class SeriesFullError(EngineError):
    """The buffer is full; the write may be tried again."""

    def __str__(self) -> str:
        return "series full"


class LogCorruptError(EngineError):
    """A frame of a log is broken at `offset`."""

    def __init__(self, offset: int):
        super().__init__(f"log corrupt at offset {offset}")
        self.offset = offset


class NotFoundError(EngineError):
    """No such series or segment."""

    def __str__(self) -> str:
        return self.args[0] if self.args else "not found"


class ProtocolError(EngineError):
    """A command line cannot be read."""

    def __str__(self) -> str:
        return f"protocol error: {self.args[0] if self.args else ''}"


class CorruptError(EngineError):
    """Malformed data or an invalid request."""


class BackpressureError(EngineError):
    """Too much in flight."""


class DurableTimeoutError(EngineError):
    """A durable write was not acknowledged in time; nothing is lost."""


def check_series(series: int) -> int:
    if not 0 <= series <= SERIES_MAX:
        raise CorruptError(f"series must be 0 to {SERIES_MAX}")
    return series


@dataclass(frozen=True)
class SyncPolicy:
    kind: str = "group"
    interval_us: int = 1000

    def __post_init__(self) -> None:
        if self.kind not in ("group", "always", "none"):
            raise ValueError(f"sync must be 'group', 'always' or 'none', got {self.kind!r}")


@dataclass(frozen=True)
class Config:
    """Engine settings; a balanced engine keeps its data in `data_dir`, a deterministic one in memory only."""

    data_dir: str | None = "tidewright-data"
    memtable_max: int = 65_536
    sync: SyncPolicy = field(default_factory=SyncPolicy)
    pool_bytes: int = 1 << 20
    profile: str = "balanced"
    mirror: tuple[str, int] | None = None
    cold_dir: str | None = None

    def __post_init__(self) -> None:
        if self.profile not in ("balanced", "deterministic"):
            raise ValueError(f"profile must be 'balanced' or 'deterministic', got {self.profile!r}")
        if self.profile == "balanced" and self.data_dir is None:
            raise CorruptError("the balanced profile needs a data_dir")

    @classmethod
    def deterministic(cls) -> Config:
        return cls(data_dir=None, sync=SyncPolicy("none"), profile="deterministic")

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


@dataclass(frozen=True)
class TimeSpan:
    """Half-open [start, end)."""

    start: int
    end: int

    def __post_init__(self) -> None:
        if self.start >= self.end:
            raise CorruptError("a window's start must be before its end")


@dataclass(frozen=True)
class EpisodeSpec:
    """An episode to export: columns with their series, over [start, end], on a fixed grid or the union of timestamps."""

    name: str
    series: tuple[tuple[str, int], ...]
    start: int
    end: int
    frame_hz: int | None = None

    def validate(self) -> EpisodeSpec:
        names = [c for c, _ in self.series]
        problems = [
            ("an episode needs a name", not self.name),
            ("an episode needs a column", not names),
            ("a column needs a name", any(not c for c in names)),
            ("column names must differ", len(set(names)) < len(names)),
            ("a column cannot be called timestamp", "timestamp" in names),
            ("end must not be before start", self.end < self.start),
            ("frame_hz must be positive", self.frame_hz is not None and self.frame_hz <= 0),
        ]
        for said, wrong in problems:
            if wrong:
                raise CorruptError(said)
        return self
