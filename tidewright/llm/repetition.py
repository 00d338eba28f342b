"""Quality rules with suffix-array repetition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text
from ._spark import others, small_batches

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def suffix_array(name: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array of many sequences at once.

    `name[i]` numbers the symbol at i from 0, with different numbers in different sequences; `end[i]` is where
    i's sequence ends. Suffixes stop there. lcp[r] is the longest common prefix of the suffixes at r - 1 and r.
    Prefix doubling, sorting only the suffixes that still tie, with each round's ranks kept for the LCP.
    """
    n = len(name)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.bincount(name)
    rank = (np.cumsum(count) - count)[name].astype(np.int32)  # first place of the symbol's bucket
    history, step = [rank], 1
    live = np.flatnonzero(count[name] > 1)
    while len(live):
        ahead = live + step
        inside = ahead < end[live]
        key = rank[live].astype(np.uint64) << np.uint64(32)
        key[inside] |= rank[ahead[inside]].astype(np.uint64) + np.uint64(1)
        order = np.argsort(key)
        key, live = key[order], live[order]
        place = np.arange(len(live))
        bucket = key >> np.uint64(32)
        old = np.maximum.accumulate(np.where(np.r_[True, bucket[1:] != bucket[:-1]], place, 0))
        fresh = np.r_[True, key[1:] != key[:-1]]
        new = np.maximum.accumulate(np.where(fresh, place, 0))
        rank = rank.copy()
        rank[live] = (bucket.astype(np.int64) + new - old).astype(np.int32)
        history.append(rank)
        tied = ~(fresh & np.r_[fresh[1:], True])
        live = np.sort(live[tied])
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(history[0][order[1:]] == history[0][order[:-1]]) + 1
    a, b = order[at - 1], order[at]
    long = np.zeros(len(at), np.int64)
    for level in range(len(history) - 1, -1, -1):
        x, y = a + long, b + long
        ok = (x < end[a]) & (y < end[b])
        ok[ok] = history[level][x[ok]] == history[level][y[ok]]
        long[ok] += 1 << level
    lcp[at] = long
    return order, lcp


def repeats(name: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring that starts there and occurs again in its sequence.

    A suffix's longest repeat is the deeper of the two LCP intervals beside it; the spans of these repeats
    have the same union as the spans of all maximal repeated substrings.
    """
    order, lcp = suffix_array(name, end)
    longest = np.zeros(len(name), np.int64)
    if len(name):
        longest[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a repeated substring of at least `least` symbols."""
    start = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    edge[start] += 1
    np.subtract.at(edge, start + longest[start], 1)
    return np.cumsum(edge)[:-1] > 0


def measure(raw: np.ndarray, offs: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """The counts of every row."""
    rows = len(offs) - 1
    start, end, row = _text.words(raw, offs)
    bounds = _text.row_bounds(row, rows)
    # Words and lines are compared byte by byte; a word's name is another one in each row.
    kind, known = _text.kinds(raw, start, end)
    name = np.unique(row * len(known) + kind, return_inverse=True)[1]
    longest = repeats(name, bounds[1:][row])
    ink = ~_text.SPACE[raw]
    out = {
        "n_words": np.diff(bounds),
        "word_chars": _text.row_sums(ink & _text.LEAD[raw], offs),
        "n_symbols": _text.row_sums(SYMBOLS[raw], offs),
        "n_repeat_words": _text.row_sums(covered(longest, 3), bounds),
        "covered_words": _text.row_sums(covered(longest, least), bounds),
        "longest_repeat": np.zeros(rows, np.int64),
    }
    np.maximum.at(out["longest_repeat"], row, longest)
    # Lines: a row's start or the byte after a newline, up to the next newline or the row's end.
    newline = np.flatnonzero(raw == 10)
    full = offs[1:] > offs[:-1]
    of = np.concatenate([np.flatnonzero(full), np.searchsorted(offs, newline, "right") - 1])
    begin = np.concatenate([offs[:-1][full], newline + 1])
    order = np.lexsort((begin, of))
    of, begin = of[order], begin[order]
    last = np.r_[of[1:] != of[:-1], True] if len(of) else np.zeros(0, bool)
    stop = np.where(last, offs[of + 1], np.r_[begin[1:] - 1, 0][: len(of)])
    inks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(ink, out=inks[1:])
    some = inks[stop] > inks[begin]
    of, begin, stop = of[some], begin[some], stop[some]
    kind, known = _text.kinds(raw, begin, stop)
    out["n_dup_lines"] = np.bincount(of, minlength=rows) - np.bincount(np.unique(of * len(known) + kind) // max(len(known), 1), minlength=rows)
    return out


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def repetition(docs: DataFrame, text: str = "text", min_repeat: int = 8, max_covered: float = 0.3, max_repeat: int = 60) -> DataFrame:
    """Adds each row's counts, `base_failed` and `kept` (columns called like them, in any case, are replaced).

    Words are runs of bytes other than 0x20 and 0x09-0x0D. A text fails the base rules with under 50 words or
    when more than half of its words lie in 3-word windows that occur twice. It fails the repetition rule when
    repeats of `min_repeat` words or more cover more than `max_covered` of its words, or one repeat has more
    than `max_repeat` words. Null and empty texts have zero counts and fail the base rules.
    Each row is judged alone, so equal rows get equal results, and an empty table gives none; a text is sorted whole, so
    memory follows the longest one, at some 30 bytes a byte.
    """
    small_batches(docs.sparkSession)
    kept = others(docs, *COLUMNS, "base_failed", "kept")
    schema = docs.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _text.pieces(batch, text):
                m = measure(*_text.texts(piece.column(text)), min_repeat)
                base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                bad = (m["covered_words"] > max_covered * m["n_words"]) | (m["longest_repeat"] > max_repeat)
                arrays = [pa.array(m[c].astype(np.int64)) for c in COLUMNS] + [pa.array(base), pa.array(~(base | bad))]
                yield pa.RecordBatch.from_arrays([*piece.columns, *arrays], [*piece.schema.names, *COLUMNS, "base_failed", "kept"])

    for c in COLUMNS:
        schema = schema.add(c, "long")
    return docs.select(*kept).mapInArrow(run, schema.add("base_failed", "boolean").add("kept", "boolean"))
