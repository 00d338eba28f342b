"""Ready-made node configurations, and a node that aligns what it takes in."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .db import Db
from .functions.align import Aligner
from .model import Config, CorruptError
from .operators.predicates import Pred


@dataclass(frozen=True)
class EdgeConfig:
    """Engine settings and a grid. Replication is the storage's and Spark's own, so a node has none to configure."""

    engine: Config
    align_ns: int | None = None

    @classmethod
    def safety_island(cls) -> EdgeConfig:
        """In memory only, with a mirror to the local host."""
        return cls(Config.deterministic().with_(mirror=("127.0.0.1", 7800)))

    @classmethod
    def cognition(cls) -> EdgeConfig:
        return cls(Config(data_dir="tidewright-cognition"))

    @classmethod
    def planning(cls) -> EdgeConfig:
        """With a cold tier in a directory."""
        return cls(Config(data_dir="tidewright-planning", cold_dir="tidewright-planning-cold"))

    @classmethod
    def ai_working_memory(cls) -> EdgeConfig:
        return cls(Config(data_dir="tidewright-working-memory"))

    def with_(self, **changes) -> EdgeConfig:
        return replace(self, **changes)


class EdgeNode:
    def __init__(self, config: EdgeConfig, spark: SparkSession | None = None):
        if config.align_ns is not None and config.align_ns <= 0:
            raise CorruptError("align_ns must be positive")
        self.aligner = Aligner(config.align_ns) if config.align_ns else None
        self.config, self.db = config, Db(config=config.engine, spark=spark)

    def ingest(self, series: int, ts: int, value: float) -> None:
        """Put one sample, floored to the grid."""
        self.db.put(series, ts - ts % self.aligner.grid_ns if self.aligner else ts, value)

    def ingest_table(self, df: DataFrame) -> int:
        return self.db.ingest(df.withColumn("ts", self.aligner.align(F.col("ts"))) if self.aligner else df)

    def scan(self, series: int, t0: int, t1: int, pred: Pred | None = None, agg: str | None = None) -> list[tuple[int, float]]:
        return self.db.scan(series, t0, t1, agg, pred)

    def flush(self) -> None:
        self.db.flush()

    def archive_older_than(self, ts: int) -> int:
        return self.db.archive_older_than(ts)

    def health(self) -> dict:
        sent, failed = self.db.mirror_stats()
        return {"profile": self.config.engine.profile, "memtable_len": self.db.memtable_len, "segments": self.db.segment_count, "archived": self.db.archived_segment_count, "evictions": self.db.lru_evictions, "mirror_sent": sent, "mirror_failed": failed}
