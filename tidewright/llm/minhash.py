"""Near-duplicates by MinHash bands, verified by odd sketches and then on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._graph import components_in_buckets
from ._spark import materialize, packed, probably_in, small_batches

SHINGLE = 5
SIMILAR = (3, 4)
#: A pair at similarity 0.75 shares no band with probability (1 - 0.75**5)**48 = 2e-6.
BANDS, ROWS = 48, 5
#: Bits of an odd sketch, in 64-bit words.
SKETCH_WORDS = 16
#: Bits of the parity bitmap of a whole set, in 64-bit words.
SET_WORDS = 32
_SAMPLES = BANDS * ROWS
_rng = np.random.Generator(np.random.PCG64(99))
_MUL = _rng.integers(0, 2**63, _SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, _SAMPLES, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct k-word shingles (A-Z lower-cased) as two independent 64-bit hashes, and their rows, by row and first hash."""
    raw = _text.LOWER[raw]
    start, end, row = _text.words(raw, offs)
    code, row = _text.shingles(_text.hashed(raw, start, end), row, len(offs) - 1, k)
    order = np.lexsort((code[0], row))
    (code, more), row = code[:, order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[new], more[new], row[new]


def min_hashes(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The samples of each non-empty row: one minimum for each hash function (shape: functions, rows)."""
    out = np.empty((_SAMPLES, len(bounds) - 1), np.uint64)
    low = np.empty(len(code), np.uint64)
    for i in range(_SAMPLES):
        np.multiply(code, _MUL[i], out=low)
        low += _ADD[i]
        out[i] = np.minimum.reduceat(low, bounds[:-1])
    return _text.mix(out)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the MinHash samples: every (function, minimum) flips one of the bits (shape: rows, words)."""
    bits = SKETCH_WORDS * 64
    seeded = _text.mix(samples + np.arange(1, len(samples) + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
    at = (seeded >> np.uint64(40)).astype(np.int64) % bits
    out = np.zeros((samples.shape[1], bits), np.uint8)
    for i in range(len(samples)):
        out[np.arange(samples.shape[1]), at[i]] ^= 1
    return np.packbits(out, axis=1, bitorder="little").view("<i8")


def parity_bitmaps(code: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Odd sketches of the whole sets: every shingle flips one of the bits (shape: rows, words)."""
    bits, out = SET_WORDS * 64, np.zeros((rows, SET_WORDS), np.int64)
    at = row * bits + (code >> np.uint64(48)).astype(np.int64) % bits
    for lo in range(0, rows, 2048):
        hi = min(rows, lo + 2048)
        own = at[slice(*np.searchsorted(row, [lo, hi]))] - lo * bits
        flips = np.bincount(own, minlength=(hi - lo) * bits).astype(np.uint8) & 1
        out[lo:hi] = np.packbits(flips, bitorder="little").view("<i8").reshape(-1, SET_WORDS)
    return out


def odd_limit(least: float = 0.75, sigmas: float = 5.0) -> int:
    """XOR population count that a pair of similarity `least` exceeds by chance at `sigmas` deviations only.

    Of n samples about n(1 - J) differ, each flipping a bit on both sides; m draws on B bits leave
    B/2 (1 - exp(-2m/B)) odd ones. The bound takes the deviations of both the sampling and the folding.
    """
    bits = SKETCH_WORDS * 64
    differ = _SAMPLES * (1 - least) + sigmas * math.sqrt(_SAMPLES * least * (1 - least))
    odd = bits / 2 * (1 - math.exp(-4 * differ / bits))
    return int(odd + sigmas * math.sqrt(odd / 4)) + 1


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by `rid`, `n_shingles`, the set's 128-bit name `set_hi` and `set_lo`, `bands`, `sketch` and `parity`; empty sets: nulls.

    `rid` numbers the rows; it is fixed once the result is written. A set's name is a hash of its shingles' 128-bit hashes.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]
    longs = T.ArrayType(T.LongType())
    schema = docs.select(*kept).schema.add("rid", "long").add("n_shingles", "long").add("set_hi", "long").add("set_lo", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for piece in _text.pieces(batch, text):
                raw, offs = _text.texts(piece.column(text))
                code, more, row = shingle_sets(raw, offs)
                rows = piece.num_rows
                bounds = _text.row_bounds(row, rows)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                name, bands, sketch = np.zeros((rows, 2), np.int64), np.zeros((rows, BANDS), np.int64), np.zeros((rows, SKETCH_WORDS), np.int64)
                if len(some):
                    cut = np.r_[bounds[some], len(code)]
                    whole = np.stack([code, more], axis=1)
                    digest = b"".join([blake2b(whole[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:], strict=True)])
                    name[some] = np.frombuffer(digest, np.int64).reshape(-1, 2)
                    samples = min_hashes(code, cut)
                    weight = _text.mix(np.arange(1, ROWS + 1, dtype=np.uint64))[None, :, None] | np.uint64(1)
                    band = (samples.reshape(BANDS, ROWS, -1) * weight).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None]
                    bands[some] = _text.mix(band).T.view(np.int64)
                    sketch[some] = odd_sketches(samples)
                none = size == 0
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (bands, sketch, parity_bitmaps(code, row, rows))]
                own = [pa.array(np.arange(rid, rid + rows)), pa.array(size.astype(np.int64)), pa.array(name[:, 0], mask=none), pa.array(name[:, 1], mask=none), *lists]
                rid += rows
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], *own], [*kept, "rid", "n_shingles", "set_hi", "set_lo", "bands", "sketch", "parity"])

    return docs.select(*kept, text).mapInArrow(run, schema.add("bands", longs).add("sketch", longs).add("parity", longs))


def likely(limit: int) -> Callable[[Column, Column], Column]:
    """Odd-sketch test of two signatures: sizes that allow the similarity, and few odd bits in the XORs.

    A bit of the whole sets' XOR is odd only if the sets differ in it, so that count never exceeds the symmetric
    difference, which is (|A| + |B|) / 7 at most where the similarity is 0.75. The samples' sketch decides for sets
    so large that their bitmaps fill up.
    """

    def test(a: Column, b: Column) -> Column:
        odd = sum((F.bit_count(a[f"s{i}"].bitwiseXOR(b[f"s{i}"])) for i in range(SKETCH_WORDS)), F.lit(0))
        differ = sum((F.bit_count(a[f"p{i}"].bitwiseXOR(b[f"p{i}"])) for i in range(SET_WORDS)), F.lit(0))
        small, large = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
        return (small * SIMILAR[1] >= large * SIMILAR[0]) & (differ * (SIMILAR[0] + SIMILAR[1]) <= (a["n"] + b["n"]) * (SIMILAR[1] - SIMILAR[0])) & (odd <= limit)

    return test


def _same_shingles(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersection and the union of each pair's shingle sets, from the words themselves: no hash takes part."""
    n = len(x)
    raw, offs = _text.texts(pa.concat_arrays([x, y]))
    raw = _text.LOWER[raw]
    start, end, row = _text.words(raw, offs)
    rank, known = _text.kinds(raw, start, end)
    many, bounds = np.uint64(len(known) + 1), _text.row_bounds(row, 2 * n)
    # Windows as exact numbers: a word is added and the pairs (window so far, word) are numbered anew. 0 stands past a row's end.
    name, left = rank.astype(np.uint64), np.arange(len(rank))
    for i in range(1, SHINGLE):
        at = left + i
        inside = at < bounds[1:][row]
        word = np.zeros(len(rank), np.uint64)
        word[inside] = rank[at[inside]].astype(np.uint64) + np.uint64(1)
        name = np.unique(name * many + word, return_inverse=True)[1].astype(np.uint64)
    first = bounds[:-1][row]
    whole = (left + SHINGLE <= bounds[1:][row]) | (left == first)
    key, of = name[whole].astype(np.int64), row[whole]
    each = np.unique(np.stack([of, key]), axis=1) if len(of) else np.zeros((2, 0), np.int64)
    size = np.bincount(each[0], minlength=2 * n)
    both = np.unique(np.stack([each[0] % n, each[1]]), axis=1) if len(of) else each
    union = np.bincount(both[0], minlength=n)
    return size[:n] + size[n:] - union, union


def confirmed(pairs: DataFrame, where: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets have 100 * intersection >= 75 * union.

    where: (node, doc_id, key), a row of `docs` (doc_id, key, text) that has the node's set.
    """
    ends, _ = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(where, "node"))
    near = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    near = probably_in(near, "key", ends.select("key")).join(ends, ["doc_id", "key"]).select("node", "text")
    near, _ = materialize(near.groupBy("node").agg(F.min("text").alias("text")))  # repeated rows have the same text
    both = pairs.join(near.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(near.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _text.pieces(batch, "x"):
                for part in _text.pieces(piece, "y"):
                    same, union = _same_shingles(part.column("x"), part.column("y"))
                    yield part.select(["a", "b"]).filter(pa.array((SIMILAR[1] * same >= SIMILAR[0] * union) & (union > 0)))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key, rid, n_shingles, set_hi, set_lo) of every row, (set_hi, set_lo, group, component_id) of every set, and (doc_id, key, text).

    A node is a set, named by the smallest rid that has it; a group is the smallest node of a component.
    """
    key = F.xxhash64(F.col(text).cast("binary")).alias("key")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), key)
    sigs, _ = materialize(signatures(base))
    full = sigs.filter("n_shingles > 0 and doc_id is not null")
    classes, _ = materialize(full.groupBy("set_hi", "set_lo").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least")))
    buckets = full.select(F.explode("bands").alias("bucket"), "set_hi")
    shared = buckets.groupBy("bucket").agg(F.min("set_hi").alias("x"), F.max("set_hi").alias("y")).filter("x <> y").select("bucket")
    named = buckets.join(shared, "bucket", "left_semi").distinct()
    members, _ = materialize(named.join(classes.select("set_hi", "node"), "set_hi").select("bucket", "node"))
    nodes, _ = materialize(members.select("node").distinct())
    sig = F.struct(F.col("n_shingles").alias("n"), *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS)], *[F.col("parity")[i].alias(f"p{i}") for i in range(SET_WORDS)])
    drawn = probably_in(full.select("rid", "doc_id", "key", "n_shingles", "sketch", "parity"), "rid", nodes)
    sketched, _ = materialize(drawn.join(nodes, drawn["rid"] == nodes["node"]).select("node", "doc_id", "key", sig.alias("sig")))
    none = members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    where = sketched.select("node", "doc_id", "key")
    roots = components_in_buckets(members, sketched.select("node", "sig"), none, likely(odd_limit()), lambda pairs: confirmed(pairs, where, base))
    sets = classes.join(roots, "node", "left").select("set_hi", "set_lo", F.coalesce("root", "node").alias("group"), "least")
    sets, _ = materialize(sets)
    least = sets.groupBy("group").agg(F.min("least").alias("component_id"))
    # Only components of several sets need the second pass; they are few.
    sets = sets.join(least, "group").select("set_hi", "set_lo", "group", "component_id")
    return sigs.select("doc_id", "key", "rid", "n_shingles", "set_hi", "set_lo"), sets, base


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Documents are linked when their sets of 5-word shingles have a Jaccard similarity of 0.75 or more.
    Equal sets become one node before anything is paired. Null texts and texts without words have empty sets and
    are linked with nothing. A row without doc_id is linked with nothing: its component_id is null and it is
    kept. A row is judged by its own text: rows that share a doc_id may lie in different components, each with the smallest
    doc_id of its rows; repeated rows get equal results. Empty input gives an empty result; other columns of the input are ignored.
    Memory follows the longest text, at some 60 bytes a byte.
    """
    rows, sets, _ = _grouped(docs, doc_id, text)
    with_id = rows.withColumn("set_hi", F.when(F.col("doc_id").isNotNull(), F.col("set_hi")))
    out = with_id.join(sets, ["set_hi", "set_lo"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with one of each group of near-duplicates, that with the smallest doc_id and then the smallest hash of its text.

    Of rows that share both, the least by the other columns stays. Rows without doc_id or without words all stay.
    """
    rows, sets, _ = _grouped(docs, doc_id, text)
    placed = rows.filter("doc_id is not null").join(sets, ["set_hi", "set_lo"])
    chosen = placed.groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("at")).select(F.col("at.doc_id").alias("_at_id"), F.col("at.key").alias("_at_key"))
    chosen, _ = materialize(chosen)
    word = F.coalesce(docs[text].rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & docs[doc_id].isNotNull()
    row = docs.select(packed(docs).alias("row"), docs[doc_id].cast("long").alias("at_id"), F.xxhash64(docs[text].cast("binary")).alias("at_key"), word.alias("judged"))
    near = row.filter("judged").join(chosen, (F.col("at_id") == F.col("_at_id")) & (F.col("at_key") == F.col("_at_key")), "left_semi")
    near = near.groupBy("at_id", "at_key").agg(F.min("row").alias("row"))
    return near.select("row").unionByName(row.filter("not judged").select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
