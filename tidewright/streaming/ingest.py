"""Structured Streaming: message bridge, exact first-writer deduplication, latest values, durable counts."""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions.align import floor_div, lag_us
from ..functions.fields import extract_by_selector
from ..sources.files import mirror_datagram


def event_time(ts: Column) -> Column:
    """A timestamp for watermarks; nanoseconds are cut to microseconds, so `ts` itself stays a long."""
    return F.timestamp_micros(floor_div(ts, 1000))


def put_lines(lines: DataFrame) -> DataFrame:
    """(series, ts, value) of a table or stream of text lines `put series ts value`; other lines are left out.

    For a socket: spark.readStream.format("socket").option("host", h).option("port", p).load()
    """
    t = F.split(F.trim("value"), r"\s+")
    out = lines.select(F.get(t, 0).alias("c"), F.size(t).alias("n"), F.get(t, 1).try_cast("long").alias("series"), F.get(t, 2).try_cast("long").alias("ts"), F.get(t, 3).try_cast("double").alias("value"))
    return out.filter("c = 'put' and n = 4 and series between 0 and 4294967294 and ts is not null and value is not null").select("series", "ts", "value")


def bind(messages: DataFrame, bindings: DataFrame) -> DataFrame:
    """Messages (topic, ts, payload) with series, durable, value, and `skipped`: no binding, or no number at the binding's field.

    Bindings are configuration: their distinct fields are read once on the driver to build the extraction. Works on streams and tables.
    """
    selectors = [r["field"] for r in bindings.select("field").distinct().collect()]
    joined = messages.join(bindings, "topic", "left")
    value = extract_by_selector(F.col("payload"), F.col("field"), selectors) if selectors else F.lit(None).cast("double")
    out = joined.withColumn("value", value)
    return out.withColumn("skipped", F.col("series").isNull() | F.col("value").isNull())


@dataclass
class BridgeStats:
    """written + skipped + dropped = received once the bridge has drained."""

    received: int = 0
    written: int = 0
    skipped: int = 0
    dropped: int = 0
    lags_us: list[int] = field(default_factory=list)

    def lag_p99(self) -> int:
        """Nearest-rank 99th percentile of the kept lags, 0 without any."""
        kept = sorted(self.lags_us)
        return kept[-(-len(kept) * 99 // 100) - 1] if kept else 0


def start_bridge(
    messages: DataFrame,
    bindings: DataFrame,
    checkpoint: str,
    sink: Callable[[DataFrame, int], None],
    durable_sink: Callable[[DataFrame, int], None] | None = None,
    now_ns: Callable[[], int] | None = None,
    lag_window: int = 4096,
    trigger: dict | None = None,
) -> tuple[StreamingQuery, BridgeStats]:
    """Run messages into two lanes, samples of durable bindings into `durable_sink`, the others into `sink`.

    Both get (series, ts, value, seq) of a micro-batch and its id, and must be idempotent for a repeated id. A batch's
    lags are summed up by Spark; the driver keeps the newest `lag_window` of them.
    """
    stats = BridgeStats()
    done: set[int] = set()

    def batch(df: DataFrame, number: int) -> None:
        bound = bind(df, bindings).withColumn("seq", F.monotonically_increasing_id()).persist()
        try:
            good = bound.filter("not skipped").select("series", "ts", "value", "seq", "durable")
            sink(good.filter(~F.col("durable") if durable_sink else F.lit(True)).drop("durable"), number)
            if durable_sink:
                durable_sink(good.filter("durable").drop("durable"), number)
            if number not in done:
                done.add(number)
                row = bound.agg(F.count("*").alias("n"), F.count(F.when(F.col("skipped"), 1)).alias("s")).first()
                stats.received += row["n"]
                stats.skipped += row["s"]
                stats.written += row["n"] - row["s"]
                if now_ns:
                    newest = good.orderBy(F.desc("seq")).limit(lag_window).select(lag_us(now_ns(), F.col("ts")).alias("lag"))
                    stats.lags_us = (stats.lags_us + [r["lag"] for r in newest.collect()][::-1])[-lag_window:]
        finally:
            bound.unpersist()

    query = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    return query, stats


def first_writers(stream: DataFrame, bucket_ns: int = 60_000_000_000) -> DataFrame:
    """(series, ts, value): each (series, ts) once over the whole stream, with the value of its first writer by `seq`.

    State is kept by series and time bucket, so that a hot series spreads; rows of one micro-batch are ordered by seq.
    Late samples are accepted at any time, as the engine has no watermark.
    """

    def first(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = set(state.get[0]) if state.exists else set()
        pdf = pd.concat(list(batches)).sort_values("seq").drop_duplicates("ts")
        fresh = pdf[~pdf["ts"].isin(known)]
        state.update((sorted(known | set(fresh["ts"].tolist())),))
        yield fresh[["series", "ts", "value"]]

    keyed = stream.withColumn("bucket", floor_div(F.col("ts"), bucket_ns))
    return keyed.groupBy("series", "bucket").applyInPandasWithState(first, "series long, ts long, value double", "seen array<long>", "append", "NoTimeout")


def recent_first_writers(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """As `first_writers`, with state bounded by a watermark: which of two writers in one batch wins is open, later ones lose."""
    return stream.withColumn("et", event_time(F.col("ts"))).withWatermark("et", delay).dropDuplicatesWithinWatermark(["series", "ts"]).drop("et")


def latest_values(stream: DataFrame) -> DataFrame:
    """Running (series, ts, value) of the largest ts, the first writer of equal ts; for update or complete mode."""
    s = F.max_by(F.struct("ts", "value"), F.struct("ts", (-F.col("seq")).alias("first"))).alias("s")
    return stream.groupBy("series").agg(s).select("series", "s.ts", "s.value")


class DurableCount:
    """Rows committed so far. It is stored beside the data by the same sink, as progress reports keep recent batches only."""

    def __init__(self) -> None:
        self.by_batch: dict[int, int] = {}

    def sink(self, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        def run(df: DataFrame, number: int) -> None:
            write(df, number)
            self.by_batch[number] = df.count()

        return run

    @property
    def watermark(self) -> int:
        return sum(self.by_batch.values())


def batch_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch to its own directory, once."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def mirror(host: str, port: int) -> Callable[[DataFrame, int], None]:
    """A best-effort sink of 20-byte datagrams; each executor sends its own rows and failures are ignored."""

    def send(df: DataFrame, _: int) -> None:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sent = failed = 0
            with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
                for pdf in batches:
                    for s, t, v in pdf[["series", "ts", "value"]].itertuples(index=False):
                        try:
                            out.sendto(mirror_datagram(s, t, v), (host, port))
                            sent += 1
                        except OSError:
                            failed += 1
            yield pd.DataFrame({"sent": [sent], "failed": [failed]})

        df.mapInPandas(run, "sent long, failed long").agg(F.sum("sent"), F.sum("failed")).first()

    return send
