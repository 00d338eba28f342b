"""Range scans with first-writer deduplication, latest values and ordered windows.

Samples are rows (series, ts, value) with optional provenance columns layer, seg_seq and seq; of samples of a series
with equal ts the one first in that order is visible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import TimeSpan
from .predicates import Pred, aggregate_all, fold

#: Samples of a series that are sorted together, on average.
BLOCK_ROWS = 200_000
PROVENANCE = ("layer", "seg_seq", "seq")


def order_of_writing(df: DataFrame) -> Column:
    """Orders the writers of one (series, ts).

    One provenance column alone is a plain key, which keeps the aggregation in Spark's hash tables; several make a
    struct, in which the value settles what they leave open.
    """
    known = [c for c in PROVENANCE if c in df.columns]
    return F.col(known[0]) if len(known) == 1 else F.struct(*known, F.isnan("value").alias("nan"), "value")


def dedup(df: DataFrame) -> DataFrame:
    """The first writer of every (series, ts).

    A minimum, not a window: Spark adds up writers on the map side, so a hot timestamp or series is thinned before
    the shuffle and no partition is sorted.
    """
    best = df.groupBy("series", "ts").agg(F.min_by("value", order_of_writing(df)).alias("value"))
    return best.select("series", "ts", "value")


def in_range(df: DataFrame, t0: int, t1: int, pred: Pred | None = None, series: int | None = None) -> DataFrame:
    """The filters of a scan, in the form that reaches the Parquet reader: series, [t0, t1], then the value."""
    if series is not None:
        df = df.filter(F.col("series") == series)
    df = df.filter(F.col("ts").between(t0, t1))
    return df.filter(pred.column(F.col("value"))) if pred else df


def scan(df: DataFrame, series: int, t0: int, t1: int, pred: Pred | None = None, agg: str | None = None, ordered: bool = True) -> DataFrame:
    """(ts, value) of one series over [t0, t1], ascending; with `agg` one row (t0, value) or none.

    The predicate stands below the deduplication: the first *matching* writer is visible.
    """
    rows = in_range(df, t0, t1, pred, series)
    if agg or not ordered:
        found = dedup(rows).select("ts", "value")
        return fold(found, agg, t0) if agg else found
    # One range shuffle serves both the first-writer rule (equal ts meet) and the order of the result.
    first = F.row_number().over(Window.partitionBy("series", "ts").orderBy(order_of_writing(df)))
    return rows.repartitionByRange("ts").withColumn("_writer", first).filter("_writer = 1").select("ts", "value").orderBy("ts")


def scan_each(df: DataFrame, t0: int, t1: int, pred: Pred | None = None) -> DataFrame:
    """All series at once: count, min, max, sum and avg of each series with a sample in the range."""
    return dedup(in_range(df, t0, t1, pred)).groupBy("series").agg(*aggregate_all(F.col("value")))


def latest(df: DataFrame) -> DataFrame:
    """(series, ts, value) of each series' largest ts; of equal ts the first writer."""
    provenance = [c for c in PROVENANCE if c in df.columns]
    order = F.struct("ts", *[(-F.col(c)).alias(c) for c in provenance], F.isnan("value"), (-F.col("value")).alias("low"))
    return df.groupBy("series").agg(F.max_by(F.struct("ts", "value"), order).alias("s")).select("series", "s.ts", "s.value")


def first_and_last(df: DataFrame) -> DataFrame:
    """First and last visible sample of each series, without a sort."""
    s = F.struct("ts", "value")
    return dedup(df).groupBy("series").agg(F.min_by(s, "ts").alias("a"), F.max_by(s, "ts").alias("b")).select("series", F.col("a.ts").alias("first_ts"), F.col("a.value").alias("first_value"), F.col("b.ts").alias("last_ts"), F.col("b.value").alias("last_value"))


def window(df: DataFrame, lanes: list[int], span: TimeSpan, ordered: bool = True) -> DataFrame:
    """(lane, series, ts, value) of several series over [start, end), merged by (ts, lane); a series may have several lanes."""
    found = dedup(in_range(df, span.start, span.end - 1).filter(F.col("series").isin(sorted(set(lanes)))))
    which = F.filter(F.array(*[F.struct(F.lit(i).alias("lane"), F.lit(s).cast("long").alias("of")) for i, s in enumerate(lanes)]), lambda x: x["of"] == F.col("series"))
    out = found.withColumn("lane", F.explode(F.transform(which, lambda x: x["lane"]))).select("lane", "series", "ts", "value")
    return out.orderBy("ts", "lane") if ordered else out


def merge(*segments: DataFrame) -> DataFrame:
    """All rows of sealed inputs, duplicates kept, each partition in the order (series, ts, seg_seq, seq)."""
    out = segments[0]
    for s in segments[1:]:
        out = out.unionByName(s)
    return out.repartition("series").sortWithinPartitions("series", "ts", "seg_seq", "seq")


def blocked(df: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds `block`: the number of an equal share of its series' time, so many that one holds `rows` samples on average.

    Windows over blocks sort no whole series; what passes from block to block is taken from a table of a row a block.
    """
    ends = df.groupBy("series").agg(F.min("ts").alias("begin"), F.max("ts").alias("stop"), F.count("*").alias("n"))
    width = F.greatest(F.lit(1.0), F.ceil((F.col("stop").cast("double") - F.col("begin").cast("double") + 1) * rows / F.col("n"))).cast("long")
    ends = ends.select("series", "begin", width.alias("width"))
    return df.join(ends, "series").select(*df.columns, F.floor((F.col("ts") - F.col("begin")) / F.col("width")).cast("long").alias("block"))


def running(df: DataFrame, value: str, name: str) -> DataFrame:
    """`blocked` rows with `name`, the sum of `value` over the samples of their series up to theirs; without `block`."""
    before = Window.partitionBy("series").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    enter = df.groupBy("series", "block").agg(F.sum(value).alias("enter")).select("series", "block", F.coalesce(F.sum("enter").over(before), F.lit(0)).alias("enter"))
    inside = Window.partitionBy("series", "block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn(name, F.sum(value).over(inside)).join(enter, ["series", "block"])
    return summed.withColumn(name, F.col(name) + F.col("enter")).drop("block", "enter")


def chunks(df: DataFrame, length: int) -> DataFrame:
    """Adds `chunk` and `place`: runs of `length` visible samples of a series."""
    ranked = running(blocked(dedup(df)).withColumn("one", F.lit(1).cast("long")), "one", "rank").withColumn("rank", F.col("rank") - 1)
    return ranked.select("series", "ts", "value", F.floor(F.col("rank") / length).cast("long").alias("chunk"), (F.col("rank") % length).cast("long").alias("place"))
