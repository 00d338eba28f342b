"""Replaying stored samples at their pace."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.align import due_ns
from ..model import CorruptError
from ..operators.scan import scan


def schedule(df: DataFrame, series: int, start: int, end: int, speed: float) -> DataFrame:
    """(ts, value, due_ns, payload) of the samples of [start, end] in order; due is relative to the replay's begin."""
    if not speed > 0:
        raise CorruptError("speed must be positive")
    found = scan(df, series, start, end)
    first = found.agg(F.min("ts").alias("first"))  # one row
    out = found.crossJoin(F.broadcast(first)).withColumn("due_ns", due_ns(F.col("ts"), F.col("first"), speed))
    return out.select("ts", "value", "due_ns", F.to_json(F.struct("ts", "value")).alias("payload")).orderBy("ts")


class Replay:
    """Publishes a schedule in the background; rows reach the driver partition by partition."""

    def __init__(self, plan: DataFrame, publish: Callable[[int, str], None], clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self._plan, self._publish, self._clock, self._sleep = plan, publish, clock, sleep
        self._stopped, self._sent = threading.Event(), 0
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        begin = self._clock()
        for row in self._plan.toLocalIterator():
            while (wait := begin + row["due_ns"] / 1e9 - self._clock()) > 0 and not self._stopped.is_set():
                self._sleep(min(wait, 0.05))
            if self._stopped.is_set():
                return
            self._publish(row["ts"], row["payload"])
            self._sent += 1

    def progress(self) -> int:
        return self._sent

    def is_done(self) -> bool:
        return not self._thread.is_alive()

    def stop(self) -> None:
        self._stopped.set()
        self._thread.join()
