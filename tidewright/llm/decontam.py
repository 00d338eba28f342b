"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._spark import materialize, others, small_batches

K1, B = 1.2, 0.75
BLOCK = 4
#: Bytes of items' texts in one index, at most (or one item). A larger benchmark is searched part by part, each in its own pass.
INDEX_BYTES = 32 << 20
GRAM = 3
#: An item with this share of its windows in a passage is a hit, wherever the missing ones are.
WHOLE = 0.8
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each term: a run of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased."""
    ink = np.where(_TERM[raw], _text.LOWER[raw], 32).astype(np.uint8)
    start, end, row = _text.words(ink, offs)
    return _text.hashed(ink, start, end)[0], row


def _grams(term: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the distinct windows of k terms (of the whole, if it is shorter)."""
    if not len(term):
        return np.zeros(0, np.uint64)
    k = min(k, len(term))
    return np.unique(_text.chain(term, np.arange(len(term) - k + 1), k))


@dataclass
class Index:
    """An inverted index of the items of one length class. Items are numbered by id and grouped in blocks of BLOCK numbers.

    A term's postings lie together, ordered by item; those of one term in one block make a cell.
    """

    ids: np.ndarray
    window: int  # terms of a passage; passages start every half window, so that one holds any item whole
    vocabulary: np.ndarray  # sorted term hashes
    most: np.ndarray  # term: largest impact in any item
    cells: np.ndarray  # first cell of each term, and the end
    cell: np.ndarray  # term * blocks + block of each cell, sorted
    bound: np.ndarray  # cell: largest impact
    postings: np.ndarray  # first posting of each cell, and the end
    item: np.ndarray  # posting: item
    impact: np.ndarray  # posting: BM25 weight of the term in the item
    least: np.ndarray  # item: score from which a passage is verified
    lowest: np.ndarray  # block: smallest of `least`
    question: list[np.ndarray]
    answer: list[np.ndarray | None]


@dataclass
class Stats:
    """Of all items with terms: the sorted vocabulary, in how many items each term is, the items, and their terms in all."""

    vocabulary: np.ndarray
    seen: np.ndarray
    items: int
    size: int

    def __add__(self, other: Stats) -> Stats:
        vocabulary, at = np.unique(np.concatenate([self.vocabulary, other.vocabulary]), return_inverse=True)
        seen = np.bincount(at, np.concatenate([self.seen, other.seen]), len(vocabulary)).astype(np.int64)
        return Stats(vocabulary, seen, self.items + other.items, self.size + other.size)


def count(items: list[tuple[int, str | None]]) -> Stats:
    """The statistics of some items; those of parts of a benchmark add up."""
    term, row = terms(*_text.texts(pa.array([t for _, t in items], pa.string())))
    size = np.bincount(row, minlength=len(items))
    vocabulary, seen = np.unique(_text.distinct(term, row)[0], return_counts=True)
    return Stats(vocabulary, seen, int((size > 0).sum()), int(size.sum()))


def build(items: list[tuple[int, str | None]], share: float, stats: Stats | None = None) -> list[Index]:
    """One index for each length class (items of up to 64, 128, 256, ... terms). Items without terms are left out.

    `stats` are those of the whole benchmark, if `items` is a part of it.
    """
    stats = stats or count(items)
    raw, offs = _text.texts(pa.array([t for _, t in items], pa.string()))
    term, row = terms(raw, offs)
    bounds = _text.row_bounds(row, len(items))
    split = [term[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    size = np.diff(bounds)
    n = max(stats.items, 1)
    mean = stats.size / n
    out = []
    classes = np.maximum(6, np.ceil(np.log2(np.maximum(size, 1)))).astype(int)
    for c in np.unique(classes[size > 0]):
        own = np.flatnonzero((classes == c) & (size > 0))
        own = own[np.argsort([items[i][0] for i in own], kind="stable")]
        of = np.repeat(np.arange(len(own)), size[own])
        kinds, which = np.unique(np.stack([of.astype(np.uint64), np.concatenate([split[i] for i in own])]), axis=1, return_counts=True)
        holder, words = kinds[0].astype(np.int64), kinds[1]
        vocabulary, at = np.unique(words, return_inverse=True)
        seen = stats.seen[np.searchsorted(stats.vocabulary, vocabulary)]
        idf = np.log1p((n - seen + 0.5) / (seen + 0.5))
        impact = (idf[at] * which * (K1 + 1) / (which + K1 * (1 - B + B * size[own][holder] / mean))).astype(np.float32)
        least = share * np.bincount(holder, impact, len(own))
        blocks = -(-len(own) // BLOCK)
        order = np.lexsort((holder, at))
        at, holder, impact = at[order], holder[order], impact[order]
        key = at * blocks + holder // BLOCK
        cell, postings = np.unique(key, return_index=True)
        parts = [_parts(items[i][1], split[i]) for i in own]
        out.append(
            Index(
                np.array([items[i][0] for i in own], np.int64), 2 << int(c), vocabulary, np.maximum.reduceat(impact, np.searchsorted(at, np.arange(len(vocabulary)))),
                np.searchsorted(cell, np.arange(len(vocabulary) + 1) * blocks), cell, np.maximum.reduceat(impact, postings), np.r_[postings, len(key)], holder, impact,
                least, np.minimum.reduceat(least, np.arange(0, len(own), BLOCK)), [q for q, _ in parts], [a for _, a in parts],
            )
        )
    return out


def _parts(text: str, term: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Windows of the question and of the answer, which is the last line, if the lines before it have GRAM terms or more; else of the whole, and None."""
    head = text.rstrip().rpartition("\n")[0]
    n = len(terms(*_text.texts(pa.array([head])))[0])
    return (_grams(term[:n], GRAM), _grams(term[n:], GRAM)) if GRAM <= n < len(term) else (_grams(term, GRAM), None)


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs that begin at `first`, and the run of each."""
    run = np.repeat(np.arange(len(first)), count)
    return np.arange(len(run)) + np.repeat(first - (np.cumsum(count) - count), count), run


def candidates(passage: np.ndarray, which: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, item and score of all items that reach their threshold; (passage, which): the distinct known terms of passages, by passage.

    WAND with block-max bounds, for many passages side by side:
    1. A passage whose terms' largest impacts together reach no item's threshold is skipped.
    2. A passage's terms are taken by rising largest impact. Up to the pivot, where their sum reaches the lowest threshold, they cannot
       make a hit alone; so only the blocks of the terms from the pivot on are looked at, and long lists of common terms are not read
       (unless they are hardly longer in all, as in a small index).
    3. Such a block is skipped if the block's own bounds for all the passage's terms do not reach the block's lowest threshold.
    4. Only the postings of blocks that are left are added up.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(passage):
        return none
    blocks, floor = len(index.lowest), float(index.lowest.min()) * 0.9999
    order = np.lexsort((index.most[which], passage))
    passage, which = passage[order], which[order]
    first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    count = np.diff(np.r_[first, len(passage)])
    most = index.most[which].astype(float)
    sums = np.cumsum(most)
    upto = sums - np.repeat(sums[first] - most[first], count)
    last = first + count - 1
    alive = np.repeat(upto[last] >= floor, count)
    essential = np.flatnonzero(alive & (upto >= floor))
    group = np.repeat(np.arange(len(first)), count)
    lists, sizes = index.cells[which], index.cells[which + 1] - index.cells[which]
    if sizes[alive].sum() <= 8 * sizes[essential].sum():
        # Nearly as few cells in all: their bounds are added up straight away.
        pair = _bounded(group[alive], lists[alive], sizes[alive], index)
    else:
        at, run = _expand(lists[essential], sizes[essential])
        pair = np.unique(group[essential][run] * blocks + index.cell[at] % blocks)
    out = [none]
    step = 200_000
    ends = np.cumsum(count[pair // blocks])
    lo = 0
    while lo < len(pair):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, "right")))
        of, block = pair[lo:hi] // blocks, pair[lo:hi] % blocks
        lo = hi
        at, run = _expand(first[of], count[of])
        key = which[at] * blocks + block[run]
        cell = np.minimum(np.searchsorted(index.cell, key), len(index.cell) - 1)
        real = index.cell[cell] == key
        cell, run = cell[real], run[real]
        likely = np.bincount(run, index.bound[cell], len(of)) >= index.lowest[block] * 0.9999
        cell, run = cell[likely[run]], run[likely[run]]
        post, where = _expand(index.postings[cell], index.postings[cell + 1] - index.postings[cell])
        slot = run[where] * BLOCK + index.item[post] % BLOCK
        score = np.bincount(slot, index.impact[post], len(of) * BLOCK)
        item = np.minimum(block[:, None] * BLOCK + np.arange(BLOCK), len(index.least) - 1).ravel()
        hit = np.flatnonzero((score > 0) & (score >= index.least[item] * 0.9999))
        out.append((passage[first[of[hit // BLOCK]]], item[hit], score[hit]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bounded(group: np.ndarray, lists: np.ndarray, sizes: np.ndarray, index: Index) -> np.ndarray:
    """passage * blocks + block of all blocks whose bounds for the terms of a passage reach their lowest threshold; group: of each term, rising."""
    blocks, out, lo = len(index.lowest), [np.zeros(0, np.int64)], 0
    done = np.cumsum(sizes)
    most = max(1, 4_000_000 // blocks)
    while lo < len(group):
        stop = min(int(np.searchsorted(group, group[lo] + most)), int(np.searchsorted(done, (done[lo - 1] if lo else 0) + 2_000_000, "right")))
        hi = len(group) if stop >= len(group) else int(np.searchsorted(group, group[max(stop, lo + 1) - 1]))
        if hi <= lo:  # one passage alone
            hi = int(np.searchsorted(group, group[lo], "right"))
        own, base = slice(lo, hi), group[lo]
        at, run = _expand(lists[own], sizes[own])
        key = (group[own][run] - base) * blocks + index.cell[at] % blocks
        passages = int(group[hi - 1] - base) + 1
        sums = np.bincount(key, index.bound[at], passages * blocks).reshape(passages, blocks)
        out.append(np.flatnonzero(sums >= index.lowest * 0.9999) + base * blocks)
        lo = hi
    return np.concatenate(out)


def search(raw: np.ndarray, offs: np.ndarray, index: Index, overlap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, item's place and score of every verified hit of every passage of every row, a row's item once (best score)."""
    term, row = terms(raw, offs)
    rows = len(offs) - 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(term) or not len(index.vocabulary):
        return none
    bounds = _text.row_bounds(row, rows)
    size, half = np.diff(bounds), index.window // 2
    passages = np.where(size > 0, np.maximum(1, -(-(size - half) // half)), 0)
    first = np.cumsum(passages) - passages
    of = np.repeat(np.arange(rows), passages)
    begin = bounds[:-1][of] + (np.arange(len(of)) - first[of]) * half
    end = np.minimum(begin + index.window, bounds[1:][of])
    at = np.minimum(np.searchsorted(index.vocabulary, term), len(index.vocabulary) - 1)
    known = np.flatnonzero(index.vocabulary[at] == term)
    # Each known term lies in the passage that starts in its half window and in the one before.
    nth = (known - bounds[:-1][row[known]]) // half
    late = first[row[known]] + np.minimum(nth, passages[row[known]] - 1)
    both = (nth > 0) & (nth < passages[row[known]])
    pair = np.concatenate([late, late[both] - 1]).astype(np.uint64) << np.uint64(32) | np.concatenate([at[known], at[known[both]]]).astype(np.uint64)
    pair.sort()
    pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
    best: dict[tuple[int, int], float] = {}
    grams: dict[int, list[np.ndarray]] = {}
    hits = candidates((pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64), index)
    for p, item, score in zip(*(x.tolist() for x in hits), strict=True):  # retrieved passages only
        if p not in grams:
            grams[p] = [_grams(term[begin[p] : end[p]], k) for k in range(1, GRAM + 1)]
        parts = [x for x in (index.question[item], index.answer[item]) if x is not None]
        found = [_windows_in(x, grams[p]) for x in parts]
        each = all(n >= max(1, min(np.ceil(overlap * len(x) - 1e-9), len(x) - spare)) for n, x, spare in zip(found, parts, (0, GRAM), strict=False))
        if each or sum(found) >= WHOLE * sum(map(len, parts)):
            key = int(of[p]), item
            best[key] = max(best.get(key, 0.0), score)
    keys = sorted(best)
    return np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64), np.array([best[k] for k in keys])


def _windows_in(part: np.ndarray, grams: list[np.ndarray]) -> int:
    """How many of the part's windows a passage has; its windows of 1 to GRAM terms, as a part below GRAM terms has one shorter window."""
    return int(sum(np.isin(part, g, assume_unique=True).sum() for g in (grams if len(part) == 1 else grams[-1:])))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.6, overlap: float = 0.6) -> DataFrame:
    """Adds `hits`, an array of (item_id, score) by item_id, and `kept`, true where it is empty (columns called so are replaced).

    Every passage of every text (overlapping windows over the whole of it) queries the index of the items. Retrieved
    is each item on which the passage scores at least `share` of what the item's own text would. It is a hit if the passage
    has at least `overlap` of the 3-term windows of its question and of its answer (the last line), or of an answer all but
    3, as many as one changed term takes, and one at least; or at least WHOLE of all windows of both. An item of one line is
    taken whole. A null or empty
    text has no hits; a null, empty or word-less item is never hit; equal items are hit together, and repeated rows get
    equal results. Without items every row is kept, and an empty table gives none. A text's terms are searched together: memory
    follows the longest text, at some 40 bytes a byte.

    One index is sent for up to INDEX_BYTES of items' texts, with any number of items. A larger benchmark is searched part by part,
    and each pass writes its rows before the next index is sent. Document frequencies and the mean length are
    always those of the whole benchmark, so the parts have no influence on the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = others(docs, "hits", "kept")
    hit = T.ArrayType(T.StructType().add("item_id", "long").add("score", "double"))
    arrow_hit = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64())]))
    schema = docs.select(*kept).schema.add("hits", hit)
    bench = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    parts = max(1, -(-(bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // INDEX_BYTES))
    out = docs.select(*kept, F.array().cast(hit).alias("hits"))

    def items_of(part: int) -> list[tuple[int, str]]:
        rows = bench.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).orderBy("i", "t").collect()  # some INDEX_BYTES
        return [(r["i"], r["t"]) for r in rows]

    stats = count([])
    for part in range(parts):
        stats += count(items_of(part))
    for part in range(parts):
        shared = spark.sparkContext.broadcast(build(items_of(part), share, stats))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in _text.pieces(batch, text):
                    raw, offs = _text.texts(piece.column(text))
                    found: list[list] = piece.column("hits").to_pylist()
                    for index in shared.value:
                        for row, item, score in zip(*search(raw, offs, index, overlap), strict=True):
                            found[row].append({"item_id": int(index.ids[item]), "score": float(score)})
                    yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], pa.array(found, arrow_hit)], [*kept, "hits"])

        out = out.mapInArrow(run, schema)
        if part < parts - 1:
            out, _ = materialize(out)
            shared.unpersist()
    return out.withColumn("hits", F.array_sort("hits")).withColumn("kept", F.size("hits") == 0)
