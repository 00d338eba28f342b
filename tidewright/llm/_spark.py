"""Shared-storage helpers: lineage is cut by tables written where every executor can read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BATCH_BYTES = 16 << 20
LONG_MAX = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`); a local one only where it is unset and all runs in one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext.getCheckpointDir()
    return root


def others(docs: DataFrame, *names: str) -> list[str]:
    """The columns that are not called like one of `names`, in any case."""
    lower = {n.lower() for n in names}
    return [c for c in docs.columns if c.lower() not in lower]


def packed(docs: DataFrame, *names: str) -> Column:
    """A struct of these columns, so that none of them can clash with a column of an operator's own."""
    return F.struct(*[docs[f"`{c}`"] for c in others(docs, *names)])


def fresh(df: DataFrame, name: str) -> str:
    """`name`, longer if a column is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame) -> tuple[DataFrame, str]:
    """Write `df` as a Parquet table in the shared folder and read it back; returns it with its path.

    The table goes when the application ends; `discard` removes it earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of `materialize` that nothing reads any more."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that a Python worker's memory follows bytes and not rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str, modulus: int):
    """crc32 of the doc_id's decimal text, modulo `modulus` (null doc_id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


#: A filter of `probably_in` has so many bits at most (8 MB); with many more keys than fit it passes everything.
FILTER_BITS = 1 << 26


def probably_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose `key` (not null) is among `keys`, and a few others, without a shuffle of `df`.

    A Bloom filter of fixed largest size goes to the executors, so that a following join moves only rows that can match.
    """
    spark, n = df.sparkSession, keys.count()
    if n * 4 > FILTER_BITS:
        return df
    bits = min(FILTER_BITS, 1 << max(12, (16 * n).bit_length()))

    def probes(c):
        h = F.xxhash64(c)
        return F.array(h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1))

    at = keys.select(F.explode(probes(F.col(keys.columns[0]))).alias("p"))
    found = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x")).toArrow()  # FILTER_BITS / 64 rows at most
    table = np.zeros(bits // 64, np.int64)
    table[found["w"].to_numpy()] = found["x"].to_numpy()
    shared = spark.sparkContext.broadcast(table)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            p = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
            hit = ((words[p >> 6] >> (p & 63)) & 1).all(1)
            yield batch.select(columns).filter(pa.array(hit))

    return df.select(*columns, probes(F.col(key)).alias(fresh(df, "probes"))).mapInArrow(run, df.schema)
