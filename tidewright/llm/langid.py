"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import held_out, others, small_batches

UNKNOWN = "und"
#: Bytes of text whose n-grams are sorted at once: each byte takes some 130 bytes of memory.
PIECE = 1 << 19
_BITS = 7
#: 7-bit symbols: a-z as themselves, a non-ASCII byte by its low bits (lead bytes above the continuation bytes), 0 for the rest.
_SYMBOL = np.zeros(256, np.uint64)
_SYMBOL[97:123] = np.arange(97, 123)
_SYMBOL[65:91] = np.arange(97, 123)
_SYMBOL[128:192] = np.arange(64) + 1
_SYMBOL[192:] = 64 + (np.arange(192, 256) & 31)
_CODE_BITS = 2 + 3 * _BITS
_MOST = (1 << (48 - _CODE_BITS)) - 1


def ngrams(raw: np.ndarray, offs: np.ndarray, before: int = 0, after: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter n-grams of 1 to 3 symbols, with word edges as a symbol, and the row of each.

    Symbols are bytes of the UTF-8 text; a text is taken to begin and end at a word's edge, unless the bytes `before` and
    `after` stand beside it.
    """
    rows = len(offs) - 1
    # A 0 between rows marks the edges.
    sym = np.zeros(len(raw) + rows + 1, np.uint64)
    row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(offs))
    at = np.arange(len(raw)) + row.astype(np.int64) + 1
    sym[at] = _SYMBOL[raw]
    sym[0], sym[-1] = _SYMBOL[before], _SYMBOL[after]
    letter = at[sym[at] > 0]
    of = row[sym[at] > 0]
    here, left, right = sym[letter], sym[letter - 1], sym[letter + 1]
    one = here
    two = (np.uint64(1) << np.uint64(3 * _BITS)) | (here << np.uint64(_BITS)) | right
    edge = left == 0  # bigrams that begin a word
    first = (np.uint64(1) << np.uint64(3 * _BITS)) | here[edge]
    three = (np.uint64(2) << np.uint64(3 * _BITS)) | (left << np.uint64(2 * _BITS)) | (here << np.uint64(_BITS)) | right
    return np.concatenate([one, two, first, three]), np.concatenate([of, of, of[edge], of])


def _counted(raw: np.ndarray, offs: np.ndarray, before: int = 0, after: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, of = ngrams(raw, offs, before, after)
    key = (of << np.uint64(_CODE_BITS)) | code
    key.sort()
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(key)])
    key = key[new]
    return (key >> np.uint64(_CODE_BITS)).astype(np.int64), (key & np.uint64((1 << _CODE_BITS) - 1)).astype(np.int64), count


def counted(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of each n-gram of each row, ordered by row and code. One long row is counted in parts of PIECE bytes."""
    if len(offs) != 2 or len(raw) <= PIECE:
        return _counted(raw, offs)
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo in range(0, len(raw), PIECE):
        own = raw[lo : lo + PIECE]
        _, code, count = _counted(own, np.array([0, len(own)]), int(raw[lo - 1]) if lo else 0, int(raw[lo + PIECE]) if lo + PIECE < len(raw) else 0)
        codes, at = np.unique(np.concatenate([codes, code]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, count])).astype(np.int64)
    return np.zeros(len(codes), np.int64), codes, counts


def train(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = 300) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams, most frequent first (ties: lower code), over every whole text with a language.

    Every task adds up its counts before the shuffle; the driver gets `top` codes for each language.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for piece in _text.pieces(batch, "text", PIECE):
                row, code, count = counted(*_text.texts(piece.column("text")))
                names = pc.dictionary_encode(piece.column("lang"))
                ids = names.indices.to_numpy(zero_copy_only=False)[row]
                for i, name in enumerate(names.dictionary.to_pylist()):
                    own = ids == i
                    codes, counts = total.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    codes, at = np.unique(np.concatenate([codes, code[own]]), return_inverse=True)
                    total[name] = codes, np.bincount(at, np.concatenate([counts, count[own]])).astype(np.int64)
        for name, (codes, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null").mapInArrow(run, "lang string, code long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = rows.groupBy("lang", "code").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    profiles: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["code"])
    return {k: np.array(v, np.int64) for k, v in profiles.items()}


def identify(raw: np.ndarray, offs: np.ndarray, profiles: dict[str, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest language of each row (-1: no n-gram at all) and 1 less its distance over the runner-up's."""
    rows = len(offs) - 1
    row, code, count = counted(raw, offs)
    # One sort by row, falling count and code; counts that do not fit the key only come in a text that is sorted by itself.
    if len(count) and count.max() > _MOST:
        order = np.lexsort((code, -count, row))
        row, code = row[order], code[order]
    else:
        key = (row.astype(np.uint64) << np.uint64(48)) | ((_MOST - count).astype(np.uint64) << np.uint64(_CODE_BITS)) | code.astype(np.uint64)
        key.sort()
        row, code = (key >> np.uint64(48)).astype(np.int64), (key & np.uint64((1 << _CODE_BITS) - 1)).astype(np.int64)
    bounds = _text.row_bounds(row, rows)
    rank = np.arange(len(row)) - bounds[:-1][row]
    near = rank < top
    row, code, rank = row[near], code[near], rank[near]
    known = np.unique(np.concatenate([*profiles.values(), np.zeros(1, np.int64)]))
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    hit = known[at] == code
    away = np.zeros((rows, len(profiles)))
    for i, profile in enumerate(profiles.values()):
        place = np.full(len(known), -1, np.int64)
        place[np.searchsorted(known, profile)] = np.arange(len(profile))
        own = np.where(hit, place[at], -1)
        away[:, i] = np.bincount(row, np.where(own < 0, top, np.abs(rank - own)), rows)
    found = np.bincount(row, minlength=rows) > 0
    best = np.where(found, away.argmin(1) if profiles else -1, -1)
    two = np.sort(away, 1)
    second = two[:, 1] if len(profiles) > 1 else np.bincount(row, minlength=rows) * float(top)
    score = np.where(second > 0, 1 - (two[:, 0] if profiles else 0) / np.maximum(second, 1e-9), 0.0)
    return best, np.where(best >= 0, np.clip(score, 0, 1), 0.0)


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", top: int = 300) -> DataFrame:
    """Adds `lang_pred` and `score` (columns called so, in any case, are replaced).

    A null text, or one without letters, is `und` with score 0. Ties go to the lower language in code point
    order. Without a profile every text is `und`. Each row is judged alone on its whole text, so equal rows get equal results,
    and an empty table gives none. A long text is counted in parts: memory follows PIECE and the text's own bytes.
    """
    small_batches(docs.sparkSession)
    kept = others(docs, "lang_pred", "score")
    profiles = dict(sorted(profiles.items()))
    names = [*profiles, UNKNOWN]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ascii_letter = np.zeros(256, bool)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        for batch in batches:
            for piece in _text.pieces(batch, text, PIECE):
                raw, offs = _text.texts(piece.column(text))
                best, score = identify(raw, offs, profiles, top)
                plain = _text.row_sums(ascii_letter[raw], offs) > 0
                for i in np.flatnonzero(~plain & (best >= 0)):  # non-ASCII bytes need not be letters
                    if not any(c.isalpha() for c in raw[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")):
                        best[i], score[i] = -1, 0.0
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([names[i] for i in best], pa.string()), pa.array(score)], [*piece.schema.names, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, schema)


def learns(doc_id: str = "doc_id") -> Column:
    """The rows that profiles are learned from: crc32 of the doc_id modulo 4 is not 2."""
    return F.coalesce(held_out(doc_id, 4) != 2, F.lit(False))
