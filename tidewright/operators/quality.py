"""Gaps, sessions, episode verdicts, trends and digests."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import period_ns
from ..functions.names import double_bits, fnv1a
from ..model import NANOS
from .scan import blocked, dedup, in_range, running

#: A gap of more than so many periods is an interruption.
GAP_PERIODS = 10
TOLERANCE = 3


def with_gap(df: DataFrame) -> DataFrame:
    """Adds `gap`: nanoseconds since the series' sample before, null at its first.

    A series is gone through in blocks of time; a block's first sample has its predecessor from a table of the blocks' ends.
    """
    blocks = blocked(df)
    before = F.lag("last").over(Window.partitionBy("series").orderBy("block"))
    ends = blocks.groupBy("series", "block").agg(F.max("ts").alias("last")).select("series", "block", before.alias("last"))
    inside = F.lag("ts").over(Window.partitionBy("series", "block").orderBy("ts"))
    return blocks.withColumn("prior", inside).join(ends, ["series", "block"]).select(*df.columns, (F.col("ts") - F.coalesce("prior", "last")).alias("gap"))


def gap_report(df: DataFrame) -> DataFrame:
    """(series, samples, max_gap_ns, mean_gap_ns) of visible samples."""
    g = with_gap(dedup(df))
    return g.groupBy("series").agg(F.count("*").alias("samples"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("max_gap_ns"), F.avg("gap").alias("mean_gap_ns"))


def sessions(df: DataFrame, period: Column | int) -> DataFrame:
    """(series, session, start, end, samples): runs without an interruption, numbered from 0."""
    limit = (F.lit(period) if isinstance(period, int) else period) * GAP_PERIODS
    cut = F.coalesce(F.col("gap") > limit, F.lit(False)).cast("long")
    rows = running(blocked(with_gap(dedup(df)).withColumn("cut", cut)), "cut", "session")
    return rows.groupBy("series", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("samples"))


def episode_window(markers: DataFrame) -> DataFrame:
    """(start, end) from a marker series: the last opening (value 1), and the last closing (value 0) if later, else 0; no row without opening."""
    last = dedup(markers).agg(F.max(F.when(F.col("value") == 1, F.col("ts"))).alias("open"), F.max(F.when(F.col("value") == 0, F.col("ts"))).alias("close"))
    closed = F.when(F.col("close") > F.col("open"), F.col("close")).otherwise(F.lit(0))
    return last.filter("open is not null").select(F.col("open").alias("start"), closed.cast("long").alias("end"))


def verdicts(df: DataFrame, channels: DataFrame, t0: int, t1: int, default_rate: float = 1000.0) -> DataFrame:
    """One row a channel (channels: series, rate): expected and actual samples, gaps, interruptions, downtime, ok.

    Gaps of more than GAP_PERIODS periods are interruptions; their length beyond a period is downtime and is not expected
    to hold samples. A channel is ok if the actual number differs by TOLERANCE at most. A channel without samples
    gets a row too.
    """
    rate = F.coalesce("rate", F.lit(float(default_rate)))
    known = channels.select("series", rate.alias("rate"), F.floor(F.lit(float(NANOS)) / rate).cast("long").alias("period"))
    gaps = with_gap(dedup(in_range(df, t0, t1))).join(known.select("series", "period"), "series")
    broken = F.col("gap") > F.col("period") * GAP_PERIODS
    seen = gaps.groupBy("series").agg(
        F.count("*").alias("actual"),
        F.max("gap").alias("max_gap_ns"),
        F.count(F.when(broken, 1)).alias("interruptions"),
        F.sum(F.when(broken, F.col("gap") - F.col("period"))).alias("downtime_ns"),
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("actual", "max_gap_ns", "interruptions", "downtime_ns")}
    out = known.join(seen, "series", "left").withColumns(zero)
    expected = ((F.lit(t1 - t0) - F.col("downtime_ns")).cast("double") * F.col("rate") / float(NANOS)).cast("long")
    out = out.withColumn("expected", expected)
    return out.select("series", "rate", "expected", "actual", "max_gap_ns", "interruptions", "downtime_ns", (F.abs(F.col("actual") - F.col("expected")) <= TOLERANCE).alias("ok"))


def trend(df: DataFrame, t0: int, t1: int, least: int = 50, scale: float = -0.5, limit: float = 0.35) -> DataFrame:
    """(series, samples, target) for series with at least `least` samples in the window: scaled mean, held within the limit."""
    seen = dedup(in_range(df, t0, t1)).groupBy("series").agg(F.count("*").alias("samples"), F.avg("value").alias("mean")).filter(F.col("samples") >= least)
    return seen.select("series", "samples", F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("mean") * scale)).alias("target"))


def derivative(df: DataFrame) -> DataFrame:
    """(series, slope) per second from the last two visible samples; times closer than 1 ns count as 1 ns."""
    visible = dedup(df)
    s = F.struct("ts", "value")
    last = visible.groupBy("series").agg(F.max(s).alias("b"))
    # The two largest as a bounded state: the maximum, and the maximum below it.
    prior = visible.join(last.select("series", F.col("b.ts").alias("top")), "series").filter("ts < top").groupBy("series").agg(F.max(s).alias("a"))
    step = F.greatest(F.col("b.ts") - F.col("a.ts"), F.lit(1)) / float(NANOS)
    return last.join(prior, "series").select("series", ((F.col("b.value") - F.col("a.value")) / step).alias("slope"))


def fresh(latest: DataFrame, boot_ns: int) -> DataFrame:
    """Latest samples not older than the boot."""
    return latest.filter(F.col("ts") >= boot_ns)


def settled(df: DataFrame, now_ns: int, delay_ns: int = 100_000_000) -> DataFrame:
    """Samples old enough to be complete."""
    return df.filter(F.col("ts") <= now_ns - delay_ns)


def catch_up(state: DataFrame, now_ns: int, rate_hz: float) -> DataFrame:
    """(series, ts): the grid slots from each series' `next_ts` to now that a late writer still has to fill."""
    due = F.sequence("next_ts", F.lit(now_ns).cast("long"), F.lit(period_ns(rate_hz)).cast("long"))
    return state.filter(F.col("next_ts") <= now_ns).select("series", F.explode(due).alias("ts"))


def digest(df: DataFrame, with_series: bool = True) -> DataFrame:
    """(series, digest): FNV-1a of each series' visible samples in time order, 16 hex digits.

    The fold is sequential within a series by definition. A series streams through its task in sorted Arrow batches, so
    memory does not follow its length.
    """
    ordered = dedup(df).repartition("series").sortWithinPartitions("series", "ts")

    def run(batches):
        series, state = None, 0
        for pdf in batches:
            for s, ts, value in pdf.itertuples(index=False):
                if s != series:
                    if series is not None:
                        yield pd.DataFrame({"series": [series], "digest": [f"{state:016x}"]})
                    series, state = s, fnv1a(b"")
                head = struct.pack("<I", s) if with_series else b""
                state = fnv1a(head + struct.pack("<qQ", ts, double_bits(value)), state)
        if series is not None:
            yield pd.DataFrame({"series": [series], "digest": [f"{state:016x}"]})

    return ordered.mapInPandas(run, "series long, digest string")
