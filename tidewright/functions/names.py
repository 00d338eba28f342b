"""Names of segments, lines of the archive catalog, and small hashes."""

from __future__ import annotations

import re
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CorruptError

_M64 = (1 << 64) - 1
SEGMENT_NAME = r"^seg-(\d+)-s(\d+)\.seg$"


def segment_name(seg_seq: Column, series: Column) -> Column:
    return F.format_string("seg-%06d-s%d.seg", seg_seq, series)


def parse_segment_name(name: Column) -> Column:
    """struct(seg_seq, series); null for other names. Numbers, not text, give the order."""
    part = lambda i: F.regexp_extract(name, SEGMENT_NAME, i).try_cast("long")
    return F.when(name.rlike(SEGMENT_NAME), F.struct(part(1).alias("seg_seq"), part(2).alias("series")))


def valid_name(name: Column) -> Column:
    """Not empty, no slash or backslash, no leading dot."""
    return name.rlike(r"^[^./\\][^/\\]*$")


def double_bits(value: float) -> int:
    return struct.unpack("<Q", struct.pack("<d", value))[0]


def bits_double(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<Q", bits & _M64))[0]


def catalog_line(name: str, series: int, min_ts: int, max_ts: int, min_val: float, max_val: float, count: int) -> str:
    return f"A {name} {series} {min_ts} {max_ts} {double_bits(min_val)} {double_bits(max_val)} {count}"


def parse_catalog_line(line: Column) -> Column:
    """struct(name, series, min_ts, max_ts, min_bits, max_bits, count) of an archive line; null for a malformed one.

    The bits of the value bounds stay text-sized decimals: Spark has no cast from bits to double.
    """
    t = F.split(F.trim(line), r"\s+")
    u64 = "decimal(20,0)"
    kinds = {"series": (2, "long"), "min_ts": (3, "long"), "max_ts": (4, "long"), "min_bits": (5, u64), "max_bits": (6, u64), "count": (7, "long")}
    fields = {k: F.get(t, i).try_cast(kind) for k, (i, kind) in kinds.items()}
    good = (F.size(t) == 8) & (F.get(t, 0) == "A") & valid_name(F.get(t, 1))
    for c in fields.values():
        good = good & c.isNotNull()
    return F.when(good, F.struct(F.get(t, 1).alias("name"), *[c.alias(k) for k, c in fields.items()]))


def check_name(name: str) -> str:
    if not re.fullmatch(r"[^./\\][^/\\]*", name):
        raise CorruptError(f"bad object name: {name!r}")
    return name


class SplitMix64:
    """The public SplitMix64 generator."""

    def __init__(self, seed: int):
        self.state = seed & _M64

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & _M64
        z = self.state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _M64
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _M64
        return z ^ z >> 31

    def uniform(self) -> float:
        return (self.next() >> 11) / (1 << 53)


def fnv1a(data: bytes, state: int = 0xCBF29CE484222325) -> int:
    """64-bit FNV-1a, continued from `state`."""
    for b in data:
        state = (state ^ b) * 0x100000001B3 & _M64
    return state
