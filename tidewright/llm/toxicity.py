"""Toxicity by class-conditional Kneser-Ney models over the letters of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._spark import discard, fresh, held_out, materialize, others, probably_in, small_batches

#: Symbols of an n-gram, the last of which is judged by those before, and bits of a symbol.
ORDER, BITS = 5, 7
#: Symbols in the windows whose worst one counts.
WINDOWS = (6, 12, 48, 384)
FEATURES = len(WINDOWS) + 3
#: A model of up to so many entries (12 bytes each) is sent to the executors; texts' n-grams are joined to a larger one.
SENT_ENTRIES = 6_000_000
_MASK = (1 << (BITS * ORDER)) - 1
#: a-z as themselves, in any case; a non-ASCII byte by its low bits (lead bytes above the continuation bytes); 0 for the rest.
_SYMBOL = np.zeros(256, np.uint64)
_SYMBOL[97:123] = np.arange(97, 123)
_SYMBOL[65:91] = np.arange(97, 123)
_SYMBOL[128:192] = np.arange(64) + 1
_SYMBOL[192:] = 64 + (np.arange(192, 256) & 31)


@dataclass
class Model:
    """Entries (key, ratio): of every n-gram seen, and of every context (ORDER - 1 symbols) for what was never seen after it."""

    entries: DataFrame
    size: int
    weights: np.ndarray  # of the features


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and row of the n-gram that ends at each symbol. Runs of other characters are one symbol 0, and each row begins after zeros."""
    sym = _SYMBOL[raw]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    zero = sym == 0
    first = np.zeros(len(raw), bool)
    first[offs[:-1][offs[1:] > offs[:-1]]] = True
    keep = ~zero
    keep[1:] |= zero[1:] & ~zero[:-1] & ~first[1:]
    sym, row = sym[keep], row[keep]
    bounds = _text.row_bounds(row, len(offs) - 1)
    place = np.arange(len(sym)) - bounds[:-1][row]
    code = sym.copy()
    for back in range(1, ORDER):
        before = np.zeros(len(sym), np.uint64)
        before[back:] = sym[:-back] if back < len(sym) else 0
        before[place < back] = 0
        code |= before << np.uint64(BITS * back)
    return code, row


def count(docs: DataFrame) -> DataFrame:
    """(g, n0, n1, t0, t1): how often each n-gram occurs in texts of either class of (text, cls, tuned), and how often of that in tuned ones.

    Each task adds up before the shuffle, and passes on what it has whenever that is a million n-grams.
    """

    def rows(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), *[pa.array(n[:, i]) for i in range(4)]], ["g", "n0", "n1", "t0", "t1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)
        for batch in batches:
            for piece in _text.pieces(batch, "text", 1 << 20):
                code, row = grams(*_text.texts(piece.column("text")))
                cls = piece.column("cls").to_numpy(zero_copy_only=False).astype(np.uint64)
                tuned = pc.cast(piece.column("tuned"), pa.int8()).to_numpy(zero_copy_only=False).astype(np.uint64)
                key = (code << np.uint64(2)) | (cls | tuned << np.uint64(1))[row]
                key.sort()
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.r_[first, len(key)])
                key = key[first]
                codes, at = np.unique(np.concatenate([codes, key >> np.uint64(2)]), return_inverse=True)
                old, n = n, np.zeros((len(codes), 4), np.int64)
                n[at[: len(old)]] = old
                kind = (key & np.uint64(3)).astype(np.int64)
                np.add.at(n, (at[len(old) :], kind & 1), times)
                np.add.at(n, (at[len(old) :][kind > 1], 2 + (kind[kind > 1] & 1)), times[kind > 1])
                if len(codes) > 1_000_000:
                    yield rows(codes, n)
                    codes, n = np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)
        yield rows(codes, n)

    found = docs.select("text", F.col("cls").cast("int").alias("cls"), "tuned").mapInArrow(run, "g long, n0 long, n1 long, t0 long, t1 long")
    return found.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "t0", "t1")])


def _discount(counts: DataFrame, c: str) -> float:
    """Of absolute discounting, from how many n-grams were seen once and twice."""
    once, twice = counts.agg(F.count(F.when(F.col(c) == 1, 1)), F.count(F.when(F.col(c) == 2, 1))).first()
    return once / (once + 2 * twice) if once and twice else 0.5


def _suffix(g: Column, size: int) -> Column:
    return g.bitwiseAND((1 << (BITS * size)) - 1)


def shared_backoff(seen: DataFrame) -> DataFrame:
    """(s, p): the probability of the last of ORDER - 1 symbols after the others, for all that end an n-gram of `seen` (g).

    Kneser-Ney down to the uniform distribution: an order counts in how many contexts its n-grams occur, in both classes together.
    """
    levels, now = [], seen.select("g")
    for size in range(ORDER - 1, 0, -1):
        now = now.groupBy(_suffix(F.col("g"), size).alias("g")).agg(F.count("*").alias("c"))
        levels.append((size, now))
        now = now.select("g")
    p = None
    for size, level in reversed(levels):
        level, _ = materialize(level)
        d = _discount(level, "c")
        context = F.shiftright("g", BITS)
        total = level.groupBy(context.alias("h")).agg(F.sum("c").alias("all"), F.count("*").alias("kinds"))
        joined = level.withColumn("h", context).join(total, "h")
        lower = F.lit(1 / (1 << BITS))
        if p is not None:
            joined = joined.withColumn("low", _suffix(F.col("g"), size - 1)).join(p.select(F.col("s").alias("low"), F.col("p").alias("below")), "low")
            lower = F.col("below")
        p = joined.select(F.col("g").alias("s"), ((F.col("c") - d + d * F.col("kinds") * lower) / F.col("all")).alias("p"))
        p, _ = materialize(p)
    return p


def fit(counts: DataFrame) -> DataFrame:
    """(key, ratio) of counts (g, n0, n1): toxic less ordinary log-probability of the last symbol after the others.

    A class's share of a symbol is its discounted count after the context; the mass of the discounts goes to the backoff
    distribution, which both classes share. After a context, what neither class has seen there differs by these masses alone, so
    the context has an entry, too (its code plus a marking bit); a context that neither class knows says nothing.
    """
    seen = counts.filter("n0 + n1 > 0")
    p = shared_backoff(seen)
    grams_, mass, above = seen.withColumn("h", F.shiftright("g", BITS)), [], []
    for c in ("n0", "n1"):
        d = _discount(seen, c)
        mass += [F.sum(c).alias(f"all_{c}"), F.count(F.when(F.col(c) > 0, 1)).alias(f"kinds_{c}")]
        left = F.when(F.col(f"all_{c}") > 0, F.lit(d) * F.col(f"kinds_{c}") / F.col(f"all_{c}")).otherwise(1.0)
        above.append((left, F.when(F.col(c) > 0, (F.col(c) - d) / F.col(f"all_{c}")).otherwise(0.0)))
    contexts, _ = materialize(grams_.groupBy("h").agg(*mass))
    joined = grams_.join(contexts, "h").join(p.withColumnRenamed("s", "low"), _suffix(F.col("g"), ORDER - 1) == F.col("low"))
    like = [F.log(own + left * F.col("p")) for left, own in above]
    known = joined.select(F.col("g").alias("key"), (like[1] - like[0]).cast("float").alias("ratio"))
    mark = F.col("h").bitwiseOR(1 << (BITS * ORDER)).alias("key")
    return known.unionByName(contexts.select(mark, (F.log(above[1][0]) - F.log(above[0][0])).cast("float").alias("ratio")))


class Lookup:
    """Ratios by key: an open-addressed table of at least twice as many slots as entries."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        self.bits = max(10, (4 * len(keys)).bit_length())
        self.keys, self.ratios = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several keys for one slot the last one stays
            won = self.keys[at] == keys[left]
            self.ratios[at[won]] = ratios[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratio of each key, 0 if there is none, and whether there is one."""
        at = self._slot(keys)
        there = self.keys[at]
        found = there == keys
        out = np.where(found, self.ratios[at], np.float32(0))
        left = np.flatnonzero(~found & (there >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]], found[left[hit]] = self.ratios[at[hit]], True
            on = ~hit & (there >= 0)
            left, at = left[on], at[on]
        return out, found


def ratios(code: np.ndarray, table: Lookup) -> np.ndarray:
    """Toxic less ordinary log-probability of each n-gram's last symbol."""
    out, found = table.of(code.astype(np.int64))
    rest = np.flatnonzero(~found)
    out[rest] = table.of((code[rest] >> np.uint64(BITS)).astype(np.int64) | (1 << (BITS * ORDER)))[0]
    return out


def features(ratio: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row, the toxic model's log-likelihood less the ordinary one's: over each worst window, over all symbols, over their root; and 1."""
    rows = len(bounds) - 1
    size = np.diff(bounds)
    sums = np.zeros(len(ratio) + 1)
    np.cumsum(ratio, dtype=np.float64, out=sums[1:])
    total = sums[bounds[1:]] - sums[bounds[:-1]]
    out = np.c_[np.zeros((rows, len(WINDOWS))), total / np.maximum(size, 1), total / np.sqrt(np.maximum(size, 1)), np.ones(rows)]
    full = np.flatnonzero(size)
    if len(full):
        here = np.arange(len(ratio))
        first = np.repeat(bounds[:-1], size)
        for i, window in enumerate(WINDOWS):
            begin = np.maximum(here - window + 1, first)
            out[full, i] = np.maximum.reduceat(sums[here + 1] - sums[begin], bounds[:-1][full]) / np.sqrt(window)
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 1e-2 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(bend, slope), -5, 5)
    return w


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20_000) -> Model:
    """Learn from the rows of `docs` that have a text and a label 0 or 1.

    The weights that turn the length-normalised differences into a probability are set on rows that the models have not
    seen: of those with crc32(doc_id) modulo 5 equal to 1, `sample` at most in the order of a hash, with the counts of all
    others. The models that are returned count every row. Repeated rows count as often as they come. Where a class is missing
    the weights are 0 but for the constant, which gives the share of class 1 seen.
    """
    small_batches(docs.sparkSession)
    tuned = F.coalesce(held_out(doc_id, 5) == 1, F.lit(False)).alias("tuned")
    picked = F.xxhash64(doc_id, text).alias("h")
    rows = docs.filter(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(tuned, picked, F.col(text).alias("text"), F.col(label).cast("int").alias("cls"))
    rows, path = materialize(rows)
    counts, _ = materialize(count(rows))
    size = counts.count()
    half = counts.select("g", (F.col("n0") - F.col("t0")).alias("n0"), (F.col("n1") - F.col("t1")).alias("n1"))
    entries, _ = materialize(fit(half))
    draft = Model(entries, entries.count() if size else 0, np.zeros(FEATURES))
    last = rows.filter("tuned").select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    some = rows.filter(F.col("tuned") & (F.col("h") <= F.lit(last))) if last is not None else rows.limit(0)
    seen = compare(some, draft).select("features", "cls").limit(sample).toPandas()
    y = seen["cls"].to_numpy(float)
    weights = np.zeros(FEATURES)
    if len(y) and 0 < y.mean() < 1:
        weights = _logistic(np.stack(seen["features"].to_numpy()), y)
    else:
        weights[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5))
    final, _ = materialize(fit(counts.select("g", "n0", "n1")))
    discard(docs.sparkSession, path)
    return replace(draft, entries=final, size=final.count(), weights=weights)


_table: list = []  # the model that this Python worker used last, and its table


def _looked_up(shared: Broadcast) -> Lookup:
    """The broadcast model as a table, made once in each Python worker."""
    if not _table or _table[0] is not shared.value:
        _table[:] = [shared.value, Lookup(*shared.value)]
    return _table[1]


def _scored(piece: pa.RecordBatch, x: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
    score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
    return pa.RecordBatch.from_arrays([*piece.columns, lists, pa.array(score)], [*piece.schema.names, "features", "score"])


def compare(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds `features` and `score` (columns called so, in any case, are replaced).

    A null or empty text has the score of no evidence. Each row is judged alone on its whole text, so equal rows get equal
    scores, and an empty table gives none. Memory follows the longest text, at some 100 bytes a byte.

    The model grows with the corpus. Up to SENT_ENTRIES entries go to the executors; beyond, the texts' n-grams are joined to them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = others(docs, "features", "score")
    schema = docs.select(*kept).schema.add("features", T.ArrayType(T.DoubleType())).add("score", "double")
    weights = model.weights
    if model.size > SENT_ENTRIES:
        return _joined(docs, model, text, kept, schema)
    found = model.entries.toArrow() if model.size else pa.table({"key": pa.array([], pa.int64()), "ratio": pa.array([], pa.float32())})  # SENT_ENTRIES rows at most
    shared = spark.sparkContext.broadcast((found["key"].to_numpy(), found["ratio"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _looked_up(shared)
        for batch in batches:
            for piece in _text.pieces(batch, text, 1 << 20):
                code, row = grams(*_text.texts(piece.column(text)))
                yield _scored(piece, features(ratios(code, table), _text.row_bounds(row, piece.num_rows)), weights)

    return docs.select(*kept).mapInArrow(run, schema)


def _joined(docs: DataFrame, model: Model, text: str, kept: list[str], schema: T.StructType) -> DataFrame:
    """`compare` for a model of any size: every n-gram of every text meets its entry in a join."""
    weights = model.weights
    number, of, values = (fresh(docs, n) for n in ("row_number", "of_row", "ratios"))
    numbered, _ = materialize(docs.select(*kept).withColumn(number, F.monotonically_increasing_id()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _text.pieces(batch, "text", 1 << 20):
                code, row = grams(*_text.texts(piece.column("text")))
                place = np.arange(len(code)) - _text.row_bounds(row, piece.num_rows)[:-1][row]
                yield pa.RecordBatch.from_arrays([piece.column("row").take(pa.array(row)), pa.array(place), pa.array(code.astype(np.int64))], ["row", "place", "g"])

    each = numbered.select(F.col(number).alias("row"), F.col(text).alias("text")).mapInArrow(spread, "row long, place long, g long")
    own = model.entries.select(F.col("key").alias("g"), "ratio")
    less = model.entries.select(F.col("key").alias("h"), F.col("ratio").alias("less"))
    each = each.join(own, "g", "left").withColumn("h", F.shiftright("g", BITS).bitwiseOR(1 << (BITS * ORDER))).join(less, "h", "left")
    line = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("ratio", "less", F.lit(0.0)).cast("float").alias("r")))).alias("line"))
    line = line.select(F.col("row").alias(of), F.transform("line", lambda x: x["r"]).alias(values))
    joined = numbered.join(line, numbered[number] == line[of], "left").select(*kept, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ratio = lists.drop_null().flatten().to_numpy(zero_copy_only=False)
            yield _scored(batch.select(kept), features(ratio, np.r_[0, np.cumsum(size)]), weights)

    return joined.mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """Rows to learn from: a label, and crc32(doc_id) modulo 5 not 0. Of several labels of a doc_id the largest counts."""
    known = labels.filter(F.col(label).isNotNull() & (held_out(doc_id, 5) != 0)).groupBy(doc_id).agg(F.max(label).alias(label))
    known, _ = materialize(known)
    near = probably_in(docs.select(*others(docs, label)).filter(held_out(doc_id, 5) != 0), doc_id, known.select(doc_id))
    return near.join(known.hint("merge"), doc_id)  # labels grow with the documents: never broadcast
