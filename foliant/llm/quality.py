"""Text quality by a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes move over overlapping chunks of the whole text, STRIDE bytes at a time. Each filter's largest
response in a chunk describes the chunk; mean, largest and least over all chunks describe the text, and a small layer makes one
probability of them. A filter over one-hot bytes is a table for each of its places, so a response is a sum of look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import labelled_sample

#: Labelled documents, at most, that the network is fitted on, and the longest text among them.
SAMPLE_DOCS, SAMPLE_CHARS = 2400, 12_000
FILTERS, WIDTH, STRIDE, CHUNK, OVERLAP, HIDDEN = 32, 6, 3, 384, 96, 16
STEPS, BATCH, RATE = 1050, 32, 0.004
#: Chunks whose responses are in memory at once.
BLOCK = 512
_EXTENT = CHUNK + WIDTH


def chunks_of(text: str | None) -> np.ndarray:
    """(chunks, bytes) of the UTF-8 text, zero-padded; at least one. Consecutive chunks share OVERLAP bytes."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + _EXTENT, np.uint8)
    padded[: len(raw)] = raw[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, _EXTENT)[::step]


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.w1 = r.normal(0, 0.2, (3 * FILTERS, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = r.normal(0, 0.2, HIDDEN).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.w1, self.b1, self.w2, self.b2]

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's largest response of each filter (through tanh), and where it is."""
        total = None
        for j in range(WIDTH):
            at = np.take(self.table[j], chunks[:, j : j + CHUNK : STRIDE], axis=0)
            total = at if total is None else np.add(total, at, out=total)
        where = total.argmax(1)
        return np.tanh(np.take_along_axis(total, where[:, None], 1)[:, 0] + self.bias), where * STRIDE

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        return np.concatenate([self.responses(chunks[i : i + BLOCK])[0] for i in range(0, len(chunks), BLOCK)])

    def head(self, v: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        x = np.concatenate((v.mean(0), v.max(0), v.min(0)))
        h = np.tanh(x @ self.w1 + self.b1)
        return x, float(1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2[0], -30, 30)))), h

    def score(self, text: str | None) -> float:
        return self.head(self.pooled(chunks_of(text)))[1]

    def fit(self, sample: list[tuple[str, int]]) -> Network:
        """Adam on the log loss, by batches in an order of its own seed. The gradient reaches a filter where it responded most."""
        data = [(chunks_of(t), y) for t, y in sample]
        r, params = np.random.default_rng(11), self.params()
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        while step < STEPS:
            order = r.permutation(len(data))
            for at in range(0, len(order), BATCH):
                grads = [np.zeros_like(p) for p in params]
                batch = [data[i] for i in order[at : at + BATCH]]
                chunks = np.concatenate([c for c, _ in batch])
                value, where = self.responses(chunks)
                slope, i = np.zeros_like(value), 0
                for c, y in batch:
                    own = slice(i, i + len(c))
                    i += len(c)
                    vv = value[own]
                    x, p, h = self.head(vv)
                    d = (p - y) / len(batch)
                    dh = d * self.w2 * (1 - h * h)
                    grads[4] += d * h
                    grads[5] += d
                    grads[2] += np.outer(x, dh)
                    grads[3] += dh
                    dx = self.w1 @ dh
                    f = np.arange(FILTERS)
                    slope[own] += dx[:FILTERS] / len(c)
                    slope[own][vv.argmax(0), f] += dx[FILTERS : 2 * FILTERS]
                    slope[own][vv.argmin(0), f] += dx[2 * FILTERS :]
                slope *= 1 - value * value
                grads[1] += slope.sum(0)
                rows, f = np.indices(where.shape)
                for j in range(WIDTH):
                    np.add.at(grads[0][j], (chunks[rows, where + j], f), slope)
                step += 1
                rate = RATE * max(0.05, min(1.0, 2 * (1 - step / STEPS)))
                for p, g, mm, w in zip(params, grads, m, v):
                    mm += 0.1 * (g - mm)
                    w += 0.001 * (g * g - w)
                    p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(w / (1 - 0.999**step)) + 1e-7)
        return self


class Model:
    def __init__(self, sample: list[tuple[str, int]]):
        """Without examples of both kinds every score is the share of good ones (none: 1)."""
        self.rate = sum(y for _, y in sample) / len(sample) if sample else 1.0
        self.network = Network().fit(sample) if 0 < self.rate < 1 else None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.rate if self.network is None else self.network.score(t) for t in texts], float)


def train(docs: DataFrame, labels: DataFrame, fold: Column, label: str = "quality") -> Model:
    """Fit on a bounded sample of the rows of `labels` for which `fold` holds."""
    return Model(labelled_sample(docs, labels, label, fold, SAMPLE_DOCS, SAMPLE_CHARS))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the probability, from 0 to 1, that the whole text is good, as column `name`, in place of one of that name.

    Null and empty texts are one chunk of zeros; equal texts get equal scores, and rows that repeat are all kept. No rows: none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(shared.value.scores(texts.tolist()))

    return docs.withColumn(name, of(F.col(text)))
