"""Episodes as Parquet with their metadata, and the command that exports them."""

from __future__ import annotations

import argparse
import json
import math
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import EpisodeSpec
from .operators.resample import column_stats, frames
from .sources.specs import load_episodes


CHUNK_FRAMES = 8192


def episode_path(root: str, index: int) -> str:
    return f"{root.rstrip('/')}/data/chunk-000/episode_{index:06d}.parquet"


def _number(x: float | None) -> float | None:
    return None if x is None or math.isnan(x) else x


class _Files:
    """Small files of any file system that Spark knows."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def write(self, path: str, text: str) -> None:
        fs, target = self._at(path)
        out = fs.create(target, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str | None:
        fs, target = self._at(path)
        return "\n".join(r["value"] for r in self.spark.read.text(path).collect()) if fs.exists(target) else None

    def single_part(self, directory: str, path: str) -> None:
        """Move the one part file of `directory` to `path`."""
        fs, source = self._at(directory)
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        part = [s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")]
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        fs.rename(part[0], target)
        fs.delete(source, True)


class EpisodeSink(Protocol):
    """Takes an episode's frames in order, in chunks of at most CHUNK_FRAMES, then one close."""

    def write_chunk(self, chunk: pd.DataFrame) -> None: ...

    def close(self) -> None: ...


def stream_episode(samples: DataFrame, spec: EpisodeSpec, sink: EpisodeSink) -> int:
    """Feed a sink on the driver with the frames (timestamp, columns, frame_samples); one chunk is held at a time. Returns the frames' number."""
    n, rows = 0, []
    names = ["timestamp", *[c for c, _ in spec.series], "frame_samples"]
    for row in frames(samples, spec).orderBy("timestamp").select(*[F.col(f"`{c}`") for c in names]).toLocalIterator():
        rows.append(tuple(row))
        n += 1
        if len(rows) == CHUNK_FRAMES:
            sink.write_chunk(pd.DataFrame(rows, columns=names))
            rows = []
    if rows:
        sink.write_chunk(pd.DataFrame(rows, columns=names))
    sink.close()
    return n


def export_episode(samples: DataFrame, spec: EpisodeSpec, root: str, index: int = 0) -> dict:
    """Write one episode file (timestamp, a double for each column) and its metadata; returns what stats.json says.

    One episode is one file of the target layout, so its sorted frames are written by one task; resampling before it
    is parallel. `episodes.jsonl` has a line for each episode exported so far.
    """
    spark, files = samples.sparkSession, _Files(samples.sparkSession)
    resampled = frames(samples, spec).persist()
    names = [c for c, _ in spec.series]
    try:
        path = episode_path(root, index)
        table = resampled.select("timestamp", *[F.col(f"`{c}`") for c in names])
        table.coalesce(1).sortWithinPartitions("timestamp").write.mode("overwrite").option("compression", "snappy").parquet(f"{path}.tmp")
        files.single_part(f"{path}.tmp", path)
        stats = {r["column"]: r for r in column_stats(resampled, spec).collect()}
        per_frame = [r["frame_samples"] for r in resampled.orderBy("timestamp").select("frame_samples").toLocalIterator()]
    finally:
        resampled.unpersist()
    meta = {
        "episode": spec.name,
        "frame_hz": spec.frame_hz,
        "frames": len(per_frame),
        "columns": {c: {**{k: _number(stats[c][k]) for k in ("min", "max", "mean")}, "count": stats[c]["count"], "frames": len(per_frame)} for c in names},
        "series_samples": {c: stats[c]["samples"] or 0 for c in names},
        "frame_samples": per_frame,
    }
    features = {c: {"dtype": "float64", "shape": [1]} for c in names} | {"timestamp": {"dtype": "int64", "shape": [1]}}
    files.write(f"{root}/meta/info.json", json.dumps({"name": spec.name, "fps": spec.frame_hz, "total_frames": len(per_frame), "features": features}, indent=2))
    files.write(f"{root}/meta/stats.json", json.dumps(meta, indent=2))
    known = [json.loads(x) for x in (files.read(f"{root}/meta/episodes.jsonl") or "").splitlines() if x]
    known = [x for x in known if x["episode_index"] != index] + [{"episode_index": index, "name": spec.name, "length": len(per_frame)}]
    files.write(f"{root}/meta/episodes.jsonl", "".join(json.dumps(x) + "\n" for x in sorted(known, key=lambda x: x["episode_index"])))
    return meta


def main(argv: list[str] | None = None) -> None:
    """tidewright.export --db DIR --spec EPISODES.toml --out DIR"""
    from .plans.store import SegmentStore

    parser = argparse.ArgumentParser(description=main.__doc__)
    for name in ("--db", "--spec", "--out"):
        parser.add_argument(name, required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    store = SegmentStore(spark, args.db)
    for i, spec in enumerate(load_episodes(args.spec)):
        meta = export_episode(store.samples(None, spec.start, spec.end), spec, args.out, i)
        print(f"{spec.name}: {meta['frames']} frames, {sum(meta['series_samples'].values())} samples")


if __name__ == "__main__":
    main()
