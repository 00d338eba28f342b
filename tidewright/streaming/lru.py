"""Buffers of limited size: eviction of whole series, and queues that drop their oldest entries.

Eviction is one global sequence by definition; it is simulated in order, on the driver or in one task, for capacity planning and tests.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class LruTable:
    """At most `capacity` samples; a write that finds it full first drops the series that was written longest ago."""

    capacity: int
    series: OrderedDict[int, list[tuple[int, float]]] = field(default_factory=OrderedDict)
    size: int = 0
    evictions: int = 0

    def insert(self, series: int, ts: int, value: float) -> int | None:
        """Add a sample; returns the series dropped for it, if any."""
        victim = None
        if self.size >= self.capacity:
            victim, gone = self.series.popitem(last=False)
            self.size -= len(gone)
            self.evictions += 1
        self.series.setdefault(series, []).append((ts, value))
        self.series.move_to_end(series)
        self.size += 1
        return victim

    def latest(self, series: int) -> tuple[int, float] | None:
        rows = self.series.get(series)
        return max(rows, key=lambda r: r[0]) if rows else None


def simulate(writes: DataFrame, capacity: int) -> DataFrame:
    """(seq, series, victim): what each write in the order of `seq` drops, null for nothing. One sequential task, in sorted batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = LruTable(capacity)
        for pdf in batches:
            yield pd.DataFrame({"seq": pdf["seq"], "series": pdf["series"], "victim": pd.array([table.insert(s, t, v) for s, t, v in pdf[["series", "ts", "value"]].itertuples(index=False)], "Int64")})

    return writes.select("seq", "series", "ts", "value").coalesce(1).sortWithinPartitions("seq").mapInPandas(run, "seq long, series long, victim long")


def drop_oldest(items: Iterable, capacity: int) -> tuple[list, int]:
    """What a bounded queue holds after all items came, and how many it dropped."""
    kept: deque = deque(maxlen=capacity)
    n = 0
    for x in items:
        kept.append(x)
        n += 1
    return list(kept), n - len(kept)
