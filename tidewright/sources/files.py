"""Readers of latency CSV files, archive catalogs and binary logs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import bits_double, double_bits, parse_catalog_line
from ..model import SENTINEL_SERIES, CorruptError

#: A log frame, little endian: body length (20), series, ts, value bits, crc32 of all before.
FRAME = struct.Struct("<IIqQI")
BODY = 20
#: A mirror datagram: series, ts, value bits.
DATAGRAM = struct.Struct("<IqQ")


def latencies(spark: SparkSession, path: str, slope: float = 1.0, offset: float = 0.0) -> DataFrame:
    """(variant, round, ns): one integer a line; calibrated as raw * slope + offset, not below 0. Variant and round are in the file's name."""
    name = r"latencies-.*sync-(.+)-r(\d+)\.csv$"
    raw = spark.read.schema("raw long").csv(path)
    file = F.input_file_name()
    ns = F.greatest(F.col("raw") * F.lit(float(slope)) + F.lit(float(offset)), F.lit(0.0)).cast("long")
    return raw.filter("raw is not null").select(F.regexp_extract(file, name, 1).alias("variant"), F.regexp_extract(file, name, 2).try_cast("int").alias("round"), ns.alias("ns"))


def archive_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Archive catalog lines as rows; malformed lines are skipped, of one name the last line of its file counts."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"), F.input_file_name().alias("file"))
    found = lines.select("file", "line", parse_catalog_line(F.col("value")).alias("c")).filter("c is not null")
    found = found.groupBy("file", "c.name").agg(F.max_by("c", "line").alias("c")).select("c.*")

    @F.pandas_udf("string")
    def digits(bits: pd.Series) -> pd.Series:  # as text, since pandas and Arrow take NaN for null
        return pd.Series([repr(bits_double(int(b))) for b in bits], dtype=object)

    as_double = lambda c: digits(c).cast("double")
    return found.select("name", "series", "min_ts", "max_ts", as_double("min_bits").alias("min_val"), as_double("max_bits").alias("max_val"), "count")


def encode_frames(rows: list[tuple[int, int, float]]) -> bytes:
    out = bytearray()
    for series, ts, value in rows:
        body = FRAME.pack(BODY, series, ts, double_bits(value), 0)[:-4]
        out += body + struct.pack("<I", zlib.crc32(body))
    return bytes(out)


def decode_frames(data: bytes) -> Iterator[tuple[int, int, float]]:
    """Frames up to the first broken or partial one; the generator's return value is that one's offset, or None."""
    at = 0
    while at + FRAME.size <= len(data):
        size, series, ts, bits, crc = FRAME.unpack_from(data, at)
        if size != BODY or zlib.crc32(data[at : at + FRAME.size - 4]) != crc:
            return at
        yield series, ts, bits_double(bits)
        at += FRAME.size
    return at if at < len(data) else None


def log_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, series, ts, value, seq) of binary logs, each read to its first broken frame; control records are left out."""
    return frames_in(spark.read.format("binaryFile").load(path).select("path", "content"))


def frames_in(logs: DataFrame) -> DataFrame:
    """The same of a table (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(name, s, t, v, i) for i, (s, t, v) in enumerate(decode_frames(content)) if s != SENTINEL_SERIES]
                yield pd.DataFrame(rows, columns=["path", "series", "ts", "value", "seq"])

    return logs.mapInPandas(run, "path string, series long, ts long, value double, seq long")


def committed(rows: DataFrame) -> DataFrame:
    """The samples of a committed log: without its control records."""
    return rows.filter(F.col("series") != SENTINEL_SERIES)


def mirror_datagram(series: int, ts: int, value: float) -> bytes:
    return DATAGRAM.pack(series, ts, double_bits(value))


def parse_datagram(data: bytes) -> tuple[int, int, float]:
    if len(data) != DATAGRAM.size:
        raise CorruptError("a datagram has 20 bytes")
    series, ts, bits = DATAGRAM.unpack(data)
    return series, ts, bits_double(bits)
