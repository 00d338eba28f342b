"""Deterministic workloads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.names import SplitMix64

#: Fixed values of the workload: seed, series multiplier, step and jitter in ns.
SEED, MULTIPLIER = 0x5EED123456789ABC, 0xA0761D6478BD642F
STEP, JITTER = 1000, 1000
BASE_TS = 1_700_000_000_000_000_000


def series_samples(series: int, n: int, base: int = BASE_TS) -> Iterator[tuple[int, float]]:
    """n samples: steps of 1000 ns give or take 500, values in [-100, 100)."""
    rng, ts = SplitMix64(SEED ^ (series * MULTIPLIER & (1 << 64) - 1)), base
    for _ in range(n):
        ts += STEP + rng.next() % JITTER - JITTER // 2
        yield ts, rng.uniform() * 200 - 100


def workload(spark: SparkSession, series: int = 8, n: int = 125_000, base: int = BASE_TS) -> DataFrame:
    """(series, ts, value, seq) of `series` interleaved series with n samples each; each series is one task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["id"]:
                rows = []
                for i, (ts, value) in enumerate(series_samples(int(s), n, base)):
                    rows.append((s, ts, value, i * series + s))
                    if len(rows) == 50_000 or i == n - 1:
                        yield pd.DataFrame(rows, columns=["series", "ts", "value", "seq"])
                        rows = []

    return spark.range(0, series, 1, series).mapInPandas(run, "series long, ts long, value double, seq long")
