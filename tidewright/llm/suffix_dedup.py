"""Exact substring deduplication over the whole corpus: blockwise suffix sorting with a difference cover.

The question is which 200-byte strings start at two places. A suffix sort to depth 200 puts such places side by
side; it is done bucket by bucket, and a difference cover bounds what has to be sorted:

* Of every document only the positions whose offset modulo 133 lies in a perfect difference set (12 of 133)
  form the cover sample. For any two positions there is a shift below 133 that brings both into the sample, so
  two equal 200-byte strings share at least one sample pair with 200 - 132 = 68 equal bytes.
* The sample is named (ranked up to equality) first, one bucket of names at a time: which 68-byte names occur
  twice. A suffix without a repeated sample name in its first 133 bytes is unique and is never sorted.
* Long ties are settled by sample names of 332 bytes: where one occurs twice, all 133 strings of 200 bytes
  inside are repeated, and these suffixes need no sorting either.
* The remaining suffixes, those near the ends of repeats, are sorted to depth 200, one bucket at a time, together
  with the settled ones that share a 68-byte sample name with them, as these can be their only copies.

Equality, not order, decides, so keys are 64-bit fingerprints of the strings, and a bucket is a range of
fingerprints. Text stays in compressed blocks; a block sends each distinct key once to the key's bucket and gets back
one bit for each, so a string that occurs a million times costs one key in each block that has it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import materialize, small_batches, width

#: A perfect difference set: each residue but 0 modulo 133 is the difference of exactly one ordered pair.
PERIOD = 133
COVER = np.array([0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109])
#: Start of every hash.
SEED = 0x2545F4914F6CDD1D
BLOCK_BYTES = 4 << 20
BUCKET_KEYS = 2_000_000

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_DONE = pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(_SPAN))])
_DONE_SQL = "array<struct<doc_id:bigint,n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,spans:array<struct<start:bigint,end:bigint>>>>"
_BLOCK_SQL = "block long, size long, ids array<long>, ends array<long>, data binary"


def _pack(data: bytes | np.ndarray, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data.tobytes() if isinstance(data, np.ndarray) else data)


def _unpack(data: bytes, dtype: type = np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed byte planes of their differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy(), 1)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unpack(data).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


class Block:
    """The texts of some rows in one byte string."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        self.raw, self.stops = raw, ends
        self.starts = np.r_[0, ends[:-1]].astype(np.int64)
        self._eight: np.ndarray | None = None

    def keys(self, at: np.ndarray, length: int, bits: int) -> np.ndarray:
        """Hashes of the strings of `length` bytes at `at`: eight bytes after eight are mixed in, the last eight overlapping."""
        if self._eight is None:
            data = np.r_[self.raw, np.zeros(15, np.uint8)]
            n = len(self.raw)
            self._eight = np.empty(n, np.uint64)
            for i in range(min(8, n)):
                whole = data[i : i + 8 * -(-(n - i) // 8)].view(np.uint64)
                self._eight[i::8] = whole
        out = np.full(len(at), SEED ^ length, np.uint64)
        for step in [*range(0, length - 8, 8), length - 8]:
            out = (out ^ self._eight[at + step]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return _text.mix(out) >> np.uint64(64 - bits)

    def cover(self, length: int) -> np.ndarray:
        """Cover-sample positions with `length` bytes before their document's end."""
        size = self.stops - self.starts
        periods = np.maximum(0, -(-(size - length + 1) // PERIOD))
        of = np.repeat(np.arange(len(size)), periods)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(periods) - periods, periods)
        at = (self.starts[of] + nth * PERIOD)[:, None] + COVER
        return at[at + length <= self.stops[of][:, None]]

    def near(self, at: np.ndarray, before: int, after: int) -> np.ndarray:
        """Mask of the positions from `before` bytes before to `after` bytes after any of `at`, inside its document."""
        of = np.searchsorted(self.stops, at, "right")
        n = len(self.raw) + 1
        lo, hi = np.maximum(self.starts[of], at - before), np.minimum(self.stops[of], at + after + 1)
        return np.cumsum(np.bincount(lo, minlength=n) - np.bincount(hi, minlength=n))[:-1] > 0

    def fits(self, length: int) -> np.ndarray:
        """Mask of the positions with `length` bytes before their document's end."""
        left = np.repeat(self.stops, self.stops - self.starts) - np.arange(len(self.raw))
        return left >= length

    def results(self, ids: list, gone: np.ndarray) -> list[dict]:
        """Each document's row, given the mask of removed bytes."""
        removed = np.r_[0, np.cumsum(gone)]
        edge = np.diff(np.r_[False, gone, False].astype(np.int8))
        cut = np.unique(self.starts[(self.starts > 0) & (self.starts < len(gone))])
        cut = cut[gone[cut] & gone[cut - 1]]  # runs that touch at a document's end
        begin, end = np.sort(np.r_[np.flatnonzero(edge == 1), cut]), np.sort(np.r_[np.flatnonzero(edge == -1), cut])
        lo, hi = np.searchsorted(begin, self.starts), np.searchsorted(begin, self.stops)
        out = []
        for i, doc_id in enumerate(ids):
            a, b = self.starts[i], self.stops[i]
            n = int(removed[b] - removed[a])
            kept = self.raw[a:b][~gone[a:b]] if n else self.raw[a:b]
            spans = [{"start": int(x - a), "end": int(y - a)} for x, y in zip(begin[lo[i] : hi[i]], end[lo[i] : hi[i]], strict=True)] if n else []
            out.append({"doc_id": doc_id, "n_bytes": int(b - a), "n_removed": n, "n_spans": len(spans), "kept_sha256": hashlib.sha256(np.ascontiguousarray(kept)).hexdigest(), "spans": spans})
        return out

    def only(self, docs: np.ndarray) -> Block:
        """The block of some of its documents."""
        part = np.repeat(docs, self.stops - self.starts)
        return Block(self.raw[part], np.cumsum((self.stops - self.starts)[docs]))


def _blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Pack rows into blocks; a block's number is fixed once the table is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in _text.pieces(batch, text, BLOCK_BYTES):
                raw, offs = _text.texts(piece.column(text))
                row = [[number], [len(raw)], [piece.column(doc_id).to_pylist()], [offs[1:].tolist()], [_pack(raw, 6)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _types(), strict=True)], ["block", "size", "ids", "ends", "data"])
                number += 1

    return docs.select(F.col(doc_id).cast("long").alias(doc_id), text).mapInArrow(run, _BLOCK_SQL)


def _types() -> list[pa.DataType]:
    return [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _block(row: dict) -> Block:
    return Block(_unpack(row["data"]), np.array(row["ends"], np.int64))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of each input key among them, and which of them repeat."""
    kinds, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    return kinds, place, count > 1


def _exchange(blocks: DataFrame, keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray | None]], bits: int, buckets: int) -> DataFrame:
    """(block, bits): one bit for each of a block's sorted distinct keys, packed by bucket.

    `keys_of` gives these keys and which of them the block asks for, or None. The bit says whether a block
    asks for the key or, where none asks, whether another block has it.
    """

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            kinds, asks = keys_of(row)
            if not len(kinds):
                continue
            bucket = _bucket(kinds, bits, buckets)
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            sent = [pack_sorted(x) for x in np.split(kinds, first[1:])]
            asked = [None] * len(first) if asks is None else [np.packbits(x).tobytes() for x in np.split(asks, first[1:])]
            columns = [pa.array(bucket[first]), pa.array([row["block"]] * len(first), pa.int64()), pa.array(sent, pa.binary()), pa.array(asked, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "keys", "asks"])

    def answer(group: pa.Table) -> pa.Table:
        # Sort one bucket: equal keys of different blocks become neighbours.
        parts = [unpack_sorted(x) for x in group.column("keys").to_pylist()]
        asks = group.column("asks").to_pylist()
        every = np.concatenate(parts)
        order = np.argsort(every)
        new = np.r_[True, every[order[1:]] != every[order[:-1]]]
        if asks[0] is None:
            yes = ~(new & np.r_[new[1:], True])
        else:
            asked = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(asks, parts, strict=True)])[order]
            yes = np.logical_or.reduceat(asked, np.flatnonzero(new))[np.cumsum(new) - 1]
        bit = np.zeros(len(every), bool)
        bit[order] = yes
        found = [np.packbits(x).tobytes() for x in np.split(bit, np.cumsum([len(x) for x in parts])[:-1])]
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "bits": pa.array(found, pa.binary())})

    offered = blocks.mapInArrow(offer, "bucket long, block long, keys binary, asks binary")
    told = offered.groupBy("bucket").applyInArrow(answer, "block long, bucket long, bits binary")
    return told.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))


def _bucket(kinds: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    return (((kinds >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _told(row: dict, kinds: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The bits of `_exchange` as a mask over the block's sorted distinct keys."""
    mask = np.zeros(len(kinds), bool)
    bucket = _bucket(kinds, bits, buckets)
    for told in row["bits"] or ():
        lo, hi = np.searchsorted(bucket, [told["bucket"], told["bucket"] + 1])
        mask[lo:hi] = np.unpackbits(np.frombuffer(told["bits"], np.uint8), count=hi - lo)
    return mask


def repeated_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row.

    Removed are the bytes covered by a string of `depth` bytes that starts at another place as well, in the same
    text or another; matches do not cross texts and are judged on the input. `spans` are the maximal removed runs
    as byte offsets. A null text is empty; texts below `depth` bytes lose nothing; a null doc_id stays null. Equal rows are
    each other's copies and lose the same bytes. Empty input gives an empty result; other columns are ignored.

    Memory follows a block (4 MiB of text, or the longest text) and a bucket (about 2 million keys).
    """
    if depth < PERIOD + 16:
        raise ValueError(f"depth must be at least {PERIOD + 16}")
    spark = docs.sparkSession
    small_batches(spark)
    short, long = depth - PERIOD + 1, depth + PERIOD - 1
    table, _ = materialize(_blocks(docs, doc_id, text))
    total = table.agg(F.sum("size")).first()[0] or 0
    sample = total * len(COVER) / PERIOD
    sieve = min(64, max(40, math.ceil(math.log2(sample + 1)) + 14))  # false repeats of the sieve only cost work
    buckets = lambda keys: max(width(spark), math.ceil(keys / BUCKET_KEYS))

    # 1. Name the cover sample; keep the documents with a repeated name, finish the others.
    n_short = buckets(sample)
    short_keys = lambda b: b.keys(b.cover(short), short, sieve)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _block(row)
            kinds, place, twice = _distinct(short_keys(block))
            twice |= _told(row, kinds, sieve, n_short)
            at = block.cover(short)[twice[place]]
            live = np.zeros(len(block.stops), bool)
            live[np.searchsorted(block.stops, at, "right")] = True
            mask = block.near(at, PERIOD - 1, 0)
            some, none = block.only(live), block.only(~live)
            ids = np.array(row["ids"], object)
            done = none.results(list(ids[~live]), np.zeros(len(none.raw), bool))
            left = np.packbits(mask[np.repeat(live, block.stops - block.starts)])
            values = [row["block"], len(some.raw), list(ids[live]), some.stops.tolist(), _pack(some.raw, 6), done, _pack(left)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [*_types(), pa.list_(_DONE), pa.binary()], strict=True)], ["block", "size", "ids", "ends", "data", "done", "mask"])

    replies = _exchange(table, lambda row: (np.unique(short_keys(_block(row))), None), sieve, n_short)
    first, _ = materialize(table.join(replies, "block", "left").mapInArrow(suspects, f"{_BLOCK_SQL}, done {_DONE_SQL}, mask binary"))

    # 2. Settle long ties by the names of the cover sample to 332 bytes.
    live = first.filter("size > 0").select("block", "size", "ids", "ends", "data", "mask")
    n_long = buckets((live.agg(F.sum("size")).first()[0] or 0) * len(COVER) / PERIOD)
    unmask = lambda row, name, n: np.unpackbits(_unpack(row[name]), count=n).astype(bool)

    def long_keys(row: dict, block: Block) -> tuple[np.ndarray, np.ndarray]:
        at = block.cover(long)
        at = at[unmask(row, "mask", len(block.raw))[at]]
        return at, block.keys(at, long, 64)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _block(row)
            at, keys = long_keys(row, block)
            kinds, place, twice = _distinct(keys)
            twice |= _told(row, kinds, 64, n_long)
            proven = block.near(at[twice[place]], 0, PERIOD - 1)
            values = [row[c] for c in ("block", "size", "ids", "ends", "data", "mask")] + [_pack(np.packbits(proven))]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [*_types(), pa.binary(), pa.binary()], strict=True)], ["block", "size", "ids", "ends", "data", "mask", "proven"])

    replies = _exchange(live, lambda row: (np.unique(long_keys(row, _block(row))[1]), None), 64, n_long)
    second, _ = materialize(live.join(replies, "block", "left").mapInArrow(settled, f"{_BLOCK_SQL}, mask binary, proven binary"))

    # 3. Which sample names lie in the first 133 bytes of a suffix that is still open?
    def open_names(row: dict, block: Block) -> tuple[np.ndarray, ...]:
        mask, proven = unmask(row, "mask", len(block.raw)), unmask(row, "proven", len(block.raw))
        unsure = mask & ~proven & block.fits(depth)
        at = block.cover(short)
        at = at[mask[at]]
        kinds, place, _ = _distinct(block.keys(at, short, sieve))
        upto = np.r_[0, np.cumsum(unsure)]
        begin = block.starts[np.searchsorted(block.stops, at, "right")]
        ask = np.zeros(len(kinds), bool)
        np.logical_or.at(ask, place, upto[at + 1] > upto[np.maximum(begin, at - PERIOD + 1)])
        return kinds, ask, place, at, unsure, proven

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _block(row)
            kinds, ask, place, at, unsure, proven = open_names(row, block)
            wanted = ask | _told(row, kinds, sieve, n_long)
            sort = unsure | (proven & block.near(at[wanted[place]], PERIOD - 1, 0))
            values = [row["block"], int(sort.sum()), row["ids"], row["ends"], row["data"], _pack(np.packbits(sort)), row["proven"]]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [*_types(), pa.binary(), pa.binary()], strict=True)], ["block", "size", "ids", "ends", "data", "mask", "proven"])

    replies = _exchange(second, lambda row: open_names(row, _block(row))[:2], sieve, n_long)
    third, _ = materialize(second.join(replies, "block", "left").mapInArrow(joined, f"{_BLOCK_SQL}, mask binary, proven binary"))

    # 4. Sort these suffixes to the full depth.
    n_open = buckets(third.agg(F.sum("size")).first()[0] or 0)

    def open_keys(row: dict, block: Block) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(unmask(row, "mask", len(block.raw)))
        return at, block.keys(at, depth, 64)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _block(row)
            at, keys = open_keys(row, block)
            kinds, place, twice = _distinct(keys)
            twice |= _told(row, kinds, 64, n_open)
            starts = unmask(row, "proven", len(block.raw))
            starts[at[twice[place]]] = True
            gone = block.near(np.flatnonzero(starts), 0, depth - 1)
            yield pa.RecordBatch.from_arrays([pa.array([block.results(row["ids"], gone)], pa.list_(_DONE))], ["done"])

    replies = _exchange(third.filter("size > 0"), lambda row: (np.unique(open_keys(row, _block(row))[1]), None), 64, n_open)
    last = third.join(replies, "block", "left").mapInArrow(finish, f"done {_DONE_SQL}")
    return first.select("done").unionByName(last).select(F.inline("done"))
