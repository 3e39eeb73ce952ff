"""Bounded samples of labelled rows, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, most_chars: int) -> list[tuple[str, int]]:
    """At most `most` (text, label) rows of the training fold, dealt evenly by a hash of the id and in its order.

    Texts longer than `most_chars` are left out of the sample (never out of the scoring). Rows without a label or a text
    are no examples. Equal texts count once.
    """
    known = labels.where(train & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    n = known.count()
    share = min(1.0, 1.2 * most / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    known = F.broadcast(known.limit(2 * most))  # about 1.2 * most rows
    rows = docs.select("doc_id", "text").join(known, "doc_id").where(F.length("text").between(1, most_chars)).orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(most).collect()
    return list(dict((r.text, (r.text, r.label)) for r in rows).values())


class Logistic:
    """Standardised features, an L2 penalty, full-batch Adam steps; the same data give the same weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 1500, penalty: float = 1e-3):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w, m, v = (np.zeros(z.shape[1]) for _ in range(3))
        for i in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            g = z.T @ (p - y) / len(y) + penalty * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[:-1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
