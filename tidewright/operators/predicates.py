"""Value predicates and aggregates of a range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ProtocolError


@dataclass(frozen=True)
class Pred:
    """A condition on the value; NaN never meets one (Spark alone would order it above all numbers)."""

    kind: str
    a: float
    b: float = 0.0

    @classmethod
    def gt(cls, x: float) -> Pred:
        return cls("gt", x)

    @classmethod
    def lt(cls, x: float) -> Pred:
        return cls("lt", x)

    @classmethod
    def between(cls, lo: float, hi: float) -> Pred:
        return cls("between", lo, hi)

    def column(self, value: Column) -> Column:
        """The condition as a filter that a Parquet scan can push down."""
        if self.kind == "gt":
            return (value > self.a) & ~F.isnan(value)
        if self.kind == "lt":
            return value < self.a
        return value.between(self.a, self.b) & ~F.isnan(value)

    def matches(self, v: float) -> bool:
        return v > self.a if self.kind == "gt" else v < self.a if self.kind == "lt" else self.a <= v <= self.b

    def zone(self, low: Column, high: Column) -> Column:
        """Whether a segment with these value bounds can hold a match. Unknown bounds (null or NaN) cannot be ruled out."""
        if self.kind == "gt":
            may = high > self.a
        elif self.kind == "lt":
            may = low < self.a
        else:
            may = (high >= self.a) & (low <= self.b)
        return F.coalesce(may, F.lit(True)) | F.isnan(low) | F.isnan(high)


def time_zone_overlaps(min_ts: Column, max_ts: Column, t0: int, t1: int) -> Column:
    """Whether a segment can hold a sample of [t0, t1]."""
    return (max_ts >= t0) & (min_ts <= t1)


def _finite_min(v: Column) -> Column:
    return F.coalesce(F.min(F.when(~F.isnan(v), v)), F.lit(float("inf")))


def _finite_max(v: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.lit(float("-inf")))


#: Minimum and maximum ignore NaN (all NaN: an infinity); sum and average pass it on; count counts it and is a double.
AGGREGATES = {
    "min": _finite_min,
    "max": _finite_max,
    "sum": F.sum,
    "avg": F.avg,
    "count": lambda v: F.count(v).cast("double"),
}


def aggregate(name: str, value: Column) -> Column:
    if name not in AGGREGATES:
        raise ProtocolError(f"unknown agg: {name}")
    return AGGREGATES[name](value)


def aggregate_all(value: Column) -> list[Column]:
    """Every aggregate, under its name."""
    return [f(value).alias(name) for name, f in AGGREGATES.items()]


def fold(df: DataFrame, name: str, t0: int) -> DataFrame:
    """One row (ts = t0, value), or none where there is no sample."""
    out = df.agg(aggregate(name, F.col("value")).alias("value"), F.count("*").alias("n"))
    return out.filter("n > 0").select(F.lit(t0).cast("long").alias("ts"), "value")
