"""Quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import others, small_batches

EMBED, FILTERS, WIDTH, STRIDE = 6, 32, 8, 2
CHUNK, STEP = 512, 256
#: Training: labelled documents at most, passes, documents of a step, and chunks that are worked on at once.
SAMPLE, PASSES, DOCS, GROUP = 3000, 6, 32, 256


@dataclass
class Network:
    embed: np.ndarray  # byte, EMBED
    filters: np.ndarray  # WIDTH * EMBED, FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS + 1: of the largest and the mean of the chunks' maxima, and a constant


def positions(n: int) -> int:
    """Places of a filter in n bytes (padded to one filter's width at least)."""
    return (max(n, WIDTH) - WIDTH) // STRIDE + 1


def convolve(raw: np.ndarray, net: Network) -> np.ndarray:
    """Rectified filter answers at every STRIDE-th byte."""
    if len(raw) < WIDTH:
        raw = np.r_[raw, np.zeros(WIDTH - len(raw), np.uint8)]
    x = net.embed[raw]
    windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=0)[::STRIDE]  # place, EMBED, WIDTH
    return np.maximum(windows.transpose(0, 2, 1).reshape(len(windows), -1) @ net.filters + net.bias, 0)


def chunk_maxima(answers: np.ndarray) -> np.ndarray:
    """Max-pooling over chunks of CHUNK bytes that start every STEP bytes and cover all places."""
    step = STEP // STRIDE
    cells = np.maximum.reduceat(answers, np.arange(0, len(answers), step), axis=0)
    return np.maximum(cells[:-1], cells[1:]) if len(cells) > 1 else cells


def pooled(raw: np.ndarray, offs: np.ndarray, net: Network) -> np.ndarray:
    """Each row's pooled vector: the largest and the mean of its chunks' maxima, over the whole text."""
    rows = len(offs) - 1
    out = np.zeros((rows, 2 * FILTERS + 1), np.float32)
    out[:, -1] = 1
    most = 1 << 17
    for i in range(rows):
        a, b = int(offs[i]), int(offs[i + 1])
        top, total, n = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64), 0
        for lo in range(a, max(b - STEP, a + 1), most):  # runs of whole steps with the overlap of a chunk
            maxima = chunk_maxima(convolve(raw[lo : min(b, lo + most + STEP + WIDTH - STRIDE)], net))
            top = np.maximum(top, maxima.max(0))
            total += maxima.sum(0)
            n += len(maxima)
        out[i, :FILTERS], out[i, FILTERS:-1] = top, total / n
    return out


def chunks_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and places of every chunk that `chunk_maxima` makes of texts of so many bytes."""
    places = (np.maximum(sizes, WIDTH) - WIDTH) // STRIDE + 1
    step = STEP // STRIDE
    count = np.maximum(-(-places // step) - 1, 1)
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, nth * STEP, np.minimum(places[owner] - nth * step, 2 * step)


def _train(texts: list[bytes], labels: np.ndarray, seed: int) -> Network:
    """Adam on the log-loss over every chunk of every text; the output layer sees all chunks of a text together.

    A step finds the maxima of its texts' chunks and where they are, some chunks at a time, and then goes back through
    these places alone: memory follows GROUP chunks, and 256 bytes a chunk of the longest texts.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    net = Network(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32),
    )
    net.out[-1] = 0
    sizes = np.array([len(t) for t in texts])
    owner, begin, places = chunks_of(sizes)
    most = 2 * STEP // STRIDE
    span = CHUNK + WIDTH - STRIDE
    raw = np.frombuffer(b"".join(texts) + bytes(span), np.uint8)
    at = (np.cumsum(sizes) - sizes)[owner] + begin
    first = np.searchsorted(owner, np.arange(len(texts) + 1))

    def data_of(rows: np.ndarray) -> np.ndarray:
        data = raw[at[rows][:, None] + np.arange(span)]
        short = np.flatnonzero(sizes[owner[rows]] < WIDTH)  # padded with zeros, as in `convolve`
        for i in short:
            data[i, sizes[owner[rows[i]]] :] = 0
        return data

    params = [net.embed, net.filters, net.bias, net.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(PASSES):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), DOCS):
            docs = order[lo : lo + DOCS]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            of = np.repeat(np.arange(len(docs)), [first[d + 1] - first[d] for d in docs])
            groups = [slice(x, x + GROUP) for x in range(0, len(rows), GROUP)]
            maxima, win = np.zeros((len(rows), FILTERS), np.float32), np.zeros((len(rows), FILTERS), np.int64)
            for g in groups:
                x = net.embed[data_of(rows[g])]
                windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STRIDE].transpose(0, 1, 3, 2)
                answers = (windows.reshape(len(x) * most, -1) @ net.filters + net.bias).reshape(len(x), most, FILTERS)
                answers[np.arange(most)[None, :] >= places[rows[g]][:, None]] = -1
                win[g] = answers.argmax(1)
                maxima[g] = np.maximum(np.take_along_axis(answers, win[g][:, None], 1)[:, 0], 0)
            starts = np.searchsorted(of, np.arange(len(docs)))
            top = np.maximum.reduceat(maxima, starts)
            n = np.diff(np.r_[starts, len(of)])
            mean = np.add.reduceat(maxima, starts) / n[:, None]
            vector = np.c_[top, mean, np.ones(len(docs))].astype(np.float32)
            p = 1 / (1 + np.exp(-np.clip(vector @ net.out, -30, 30)))
            error = ((p - labels[docs]) / len(docs)).astype(np.float32)
            d_out = vector.T @ error + 1e-4 * net.out
            d_max = error[of][:, None] * (net.out[:FILTERS] * (maxima >= top[of]) + net.out[FILTERS:-1] / n[of][:, None])
            d_max = np.where(maxima > 0, d_max, 0).astype(np.float32)
            d_filters, d_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
            for g in groups:
                where = data_of(rows[g])[np.arange(len(rows[g]))[:, None, None], win[g][:, :, None] * STRIDE + np.arange(WIDTH)]
                picked = net.embed[where].reshape(len(where), FILTERS, -1)
                d_filters += np.einsum("rfk,rf->kf", picked, d_max[g])
                back = (d_max[g][:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
                for e in range(EMBED):
                    d_embed[:, e] += np.bincount(where.ravel(), back[:, e], 256)
            step += 1
            for param, grad, (m, v) in zip(params, (d_embed, d_filters, d_max.sum(0), d_out), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, seed: int = 5) -> Network:
    """Fit the network on at most `sample` labelled documents, the first in the order of a hash of the doc_id.

    Of several labels of a doc_id the largest counts; null texts and labels are left out. The labels are picked first, so
    that only their documents' texts are read on; the driver holds `sample` texts. With one class only, or no
    label, every score is that class's share. Of repeated doc_ids the least text counts. The whole of each text is trained on.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("_y"))
    picked = known.orderBy(F.xxhash64(doc_id), doc_id).limit(sample)
    rows = docs.filter(F.col(text).isNotNull()).select(doc_id, text).join(F.broadcast(picked), doc_id)  # `sample` rows at most
    rows = rows.groupBy(doc_id).agg(F.min(text).alias("_x"), F.first("_y").alias("_y")).orderBy(doc_id).toPandas()
    y = rows["_y"].to_numpy(np.float32)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        net = Network(np.zeros((256, EMBED), np.float32), np.zeros((WIDTH * EMBED, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS + 1, np.float32))
        net.out[-1] = np.log(share / (1 - share))
        return net
    return _train([t.encode() for t in rows["_x"]], y, seed)


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Adds `score`, the probability of label 1 (a column called so, in any case, is replaced).

    Null and empty texts are scored as zero bytes. Each row is judged alone on its whole text, so equal rows get equal scores,
    and an empty table gives none. Any length is pooled in runs: memory follows a text's own bytes.
    """
    small_batches(docs.sparkSession)
    kept = others(docs, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _text.pieces(batch, text):
                odds = pooled(*_text.texts(piece.column(text)), net) @ net.out
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(1 / (1 + np.exp(-np.clip(odds.astype(float), -30, 30))))], [*piece.schema.names, "score"])

    return docs.select(*kept).mapInArrow(run, docs.select(*kept).schema.add("score", "double"))
