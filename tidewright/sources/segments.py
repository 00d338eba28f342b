"""Binary segment files: one series each, times as varints of second differences, values as XORed bits."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CorruptError

#: Fixed values of the format: magic; series, count, min and max ts, bits of min and max value, length of the time column.
MAGIC = b"RTISEG01"
HEAD = struct.Struct("<IQqqQQQ")


def varints(values: np.ndarray) -> bytes:
    """Zigzag LEB128 of 64-bit integers, seven bits a byte, low bits first."""
    z = (values.astype(np.int64) << 1 ^ values.astype(np.int64) >> 63).view(np.uint64)
    septets = np.stack([z >> np.uint64(7 * i) & np.uint64(0x7F) for i in range(10)], 1).astype(np.uint8)
    used = np.maximum(1, 10 - (septets[:, ::-1] != 0).argmax(1)) * (septets != 0).any(1) + ~(septets != 0).any(1)
    place = np.arange(10)
    septets |= np.where(place < used[:, None] - 1, 0x80, 0).astype(np.uint8)
    return septets[place < used[:, None]].tobytes()


def read_varints(data: bytes) -> np.ndarray:
    """All integers of a column, at once: a byte without its high bit ends one."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    if raw[-1] & 0x80:
        raise CorruptError("the time column is cut off")
    end = np.flatnonzero(raw < 0x80)
    start = np.r_[0, end[:-1] + 1]
    if (end - start).max() > 9:
        raise CorruptError("an integer of the time column is too long")
    shift = 7 * (np.arange(len(raw)) - np.repeat(start, end - start + 1))
    z = np.add.reduceat((raw & 0x7F).astype(np.uint64) << shift.astype(np.uint64), start)
    return (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)


def encode_times(ts: np.ndarray) -> bytes:
    """The first time, the first step, then the steps' changes."""
    steps = np.diff(ts.astype(np.int64))
    return varints(np.r_[ts[:1], steps[:1], np.diff(steps)].astype(np.int64))


def decode_times(data: bytes) -> np.ndarray:
    v = read_varints(data)
    return np.r_[v[:1], v[:1] + np.cumsum(np.cumsum(v[1:]))] if len(v) else v


def encode_values(values: np.ndarray) -> bytes:
    """64 bits of the first value; then for each change a 0, or a 1, six bits of length and so many bits of the XOR; low bits first."""
    bits = values.astype(np.float64).view(np.uint64)
    changes = bits[1:] ^ bits[:-1]
    acc, used, out = int(bits[0]) if len(bits) else 0, 64 * bool(len(bits)), bytearray()
    for x in changes.tolist():
        if x:
            n = x.bit_length()
            acc |= (1 | (n - 1) << 1 | x << 7) << used
            used += 7 + n
        else:
            used += 1
        if used >= 4096:
            out += (acc & (1 << 4096) - 1).to_bytes(512, "little")
            acc >>= 4096
            used -= 4096
    return bytes(out) + acc.to_bytes(-(-used // 8), "little")


def decode_values(data: bytes, count: int) -> np.ndarray:
    if count == 0:
        return np.zeros(0)
    at, size = 64, 8 * len(data)
    out = np.empty(count, np.uint64)
    now = int.from_bytes(data[:8], "little")
    out[0] = now
    for i in range(1, count):
        # A record has at most 71 bits, so ten bytes from its first byte hold it.
        head = int.from_bytes(data[at >> 3 : (at >> 3) + 10], "little") >> (at & 7)
        if at >= size:
            raise CorruptError("the value column is cut off")
        if head & 1:
            n = (head >> 1 & 63) + 1
            now ^= head >> 7 & (1 << n) - 1
            at += 7 + n
        else:
            at += 1
        out[i] = now
    if at > size:
        raise CorruptError("the value column is cut off")
    return out.view(np.float64)


def encode_segment(series: int, ts: np.ndarray, values: np.ndarray) -> bytes:
    """A segment file of samples in time order; value bounds leave NaN out."""
    if not len(ts):
        raise CorruptError("a segment cannot be empty")
    known = values[~np.isnan(values)]
    low, high = (known.min(), known.max()) if len(known) else (np.nan, np.nan)
    bounds = np.array([low, high], np.float64).view(np.uint64).tolist()
    times, column = encode_times(ts), encode_values(values)
    body = HEAD.pack(series, len(ts), int(ts[0]), int(ts[-1]), *bounds, len(times)) + times + struct.pack("<Q", len(column)) + column
    return MAGIC + body + struct.pack("<I", zlib.crc32(body))


def decode_segment(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Series, times and values; magic, checksum and lengths are verified."""
    body = data[len(MAGIC) : -4]
    if data[: len(MAGIC)] != MAGIC or len(body) < HEAD.size + 8:
        raise CorruptError("not a segment")
    if zlib.crc32(body) != int.from_bytes(data[-4:], "little"):
        raise CorruptError("a segment's checksum is wrong")
    series, count, *_, length = HEAD.unpack_from(body)
    rest = body[HEAD.size + length :]
    if len(rest) < 8 or len(rest) - 8 != int.from_bytes(rest[:8], "little"):
        raise CorruptError("a segment's lengths are wrong")
    ts = decode_times(body[HEAD.size : HEAD.size + length])
    if len(ts) != count:
        raise CorruptError("a segment's count is wrong")
    return series, ts, decode_values(rest[8:], count)


def misses(data: bytes, t0: int, t1: int) -> bool:
    """Whether a segment file's head says that it has no sample in [t0, t1]."""
    if len(data) < len(MAGIC) + HEAD.size:
        return False  # malformed: decoding says so
    _, _, low, high, *_ = HEAD.unpack_from(data, len(MAGIC))
    return high < t0 or low > t1


def pack(samples: DataFrame) -> DataFrame:
    """(path, content): a segment file's bytes for each series of (series, ts, value), in time order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        series = int(pdf["series"].iloc[0])
        return pd.DataFrame({"path": [f"s{series}"], "content": [encode_segment(series, pdf["ts"].to_numpy(), pdf["value"].to_numpy())]})

    return samples.groupBy("series").applyInPandas(run, "path string, content binary")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, series, ts, value, seq) of segment files; a malformed file fails the job."""
    return unpack(spark.read.format("binaryFile").load(path).select("path", F.col("content")))


def unpack(files: DataFrame, t0: int = -(2**63), t1: int = 2**63 - 1) -> DataFrame:
    """The same of a table (path, content); files that end before t0 or begin after t1 are not decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                if misses(content, t0, t1):
                    continue
                series, ts, values = decode_segment(content)
                own = (ts >= t0) & (ts <= t1)
                yield pd.DataFrame({"path": name, "series": series, "ts": ts[own], "value": values[own], "seq": np.flatnonzero(own)})

    return files.mapInPandas(run, "path string, series long, ts long, value double, seq long")
