"""Last value carried forward onto frame grids, and what an export says about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import floor_div, frame_at_or_after, frame_count, frame_time
from ..model import EpisodeSpec
from .scan import dedup, in_range

#: Frames of one block; values are carried inside blocks in parallel and from block to block by a small table.
BLOCK = 8192


def _folded(df: DataFrame, spec: EpisodeSpec, key: Column) -> DataFrame:
    """One row a grid key: each column's last sample there and its number of samples, in one aggregation over all series."""
    found = dedup(in_range(df, spec.start, spec.end).filter(F.col("series").isin(sorted({s for _, s in spec.series}))))
    cells = []
    for i, (_, series) in enumerate(spec.series):
        own = F.col("series") == series
        cells += [F.max_by(F.when(own, F.col("value")), F.when(own, F.col("ts"))).alias(f"v{i}"), F.count(F.when(own, 1)).alias(f"n{i}")]
    return found.withColumn("i", key).groupBy("i").agg(*cells)


def carry_forward(frames: DataFrame, order: str, values: list[str], block: Column) -> DataFrame:
    """Fill nulls of `values` with the last one before, by `order`, without putting all rows into one task.

    Each block's last values make a small table; running over it gives what enters a block; inside a block the
    fill is a window of its own.
    """
    frames = frames.withColumn("_block", block)
    ends = frames.groupBy("_block").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    enter = ends.select("_block", *[F.last(v, ignorenulls=True).over(before).alias(f"_in_{v}") for v in values])
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = frames.join(enter, "_block")
    filled = [F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_in_{v}")).alias(v) for v in values]
    return joined.select(*[c for c in frames.columns if c not in (*values, "_block")], *filled)


def frames(df: DataFrame, spec: EpisodeSpec) -> DataFrame:
    """(frame, timestamp, a column for each of the episode, frame_samples, n0, n1, ...), one row a frame.

    A column's value is that of its last sample in [start, timestamp], NaN before the first. frame_samples counts
    the samples that fall on the frame: after the frame before, up to it. Samples after the last frame count nowhere.
    """
    spec.validate()
    spark = df.sparkSession
    k = len(spec.series)
    if spec.frame_hz is not None:
        n = frame_count(spec.start, spec.end, spec.frame_hz)
        grid = spark.range(n).select(F.col("id").alias("i"), frame_time(F.col("id"), spec.start, spec.frame_hz).alias("timestamp"))
        some = _folded(df, spec, frame_at_or_after(F.col("ts"), spec.start, spec.frame_hz)).filter(F.col("i") < n)
        rows = grid.join(some, "i", "left")
        block = floor_div(F.col("i"), BLOCK)
    else:
        rows = _folded(df, spec, F.col("ts")).withColumn("timestamp", F.col("i"))
        # Union grid: blocks are ranges of time with BLOCK samples on average.
        size = rows.agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi")).first()
        step = max(1, (size["hi"] - size["lo"] + 1) * BLOCK // max(size["n"], 1)) if size["n"] else 1
        block = floor_div(F.col("i") - F.lit(size["lo"] or 0), step)
    rows = rows.fillna(0, [f"n{j}" for j in range(k)])
    filled = carry_forward(rows, "i", [f"v{j}" for j in range(k)], block)
    columns = [F.coalesce(F.col(f"v{j}"), F.lit(float("nan"))).alias(name) for j, (name, _) in enumerate(spec.series)]
    counts = [F.col(f"n{j}").cast("long").alias(f"n{j}") for j in range(k)]
    return filled.select(F.col("i").alias("frame"), "timestamp", *columns, sum((F.col(f"n{j}") for j in range(k)), F.lit(0)).cast("long").alias("frame_samples"), *counts)


def column_stats(resampled: DataFrame, spec: EpisodeSpec) -> DataFrame:
    """(column, min, max, mean, count, frames, samples): without NaN, and null where every frame is NaN."""
    cells = []
    for j, (name, _) in enumerate(spec.series):
        v = F.when(~F.isnan(F.col(f"`{name}`")), F.col(f"`{name}`"))
        cells.append(F.struct(F.lit(name).alias("column"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.count(v).alias("count"), F.count("*").alias("frames"), F.sum(f"n{j}").alias("samples")))
    return resampled.agg(F.array(*cells).alias("c")).select(F.inline("c"))
