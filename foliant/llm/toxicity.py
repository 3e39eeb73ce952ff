"""Toxicity by compression distance: how much shorter a window gets with a dictionary of toxic text than with one of ordinary text.

Both dictionaries are zstandard's own, trained on texts of their class: that of ordinary text on whole texts, that of toxic text
first on whole texts, then on the windows that such a dictionary of one half of the toxic texts shortens in the other half. A window is
what stands between two white spaces, with a space about it, or, where that is longer than WINDOW bytes, each of its overlapping parts:
every byte of a text but its white space is in a window. zstandard leaves the last bytes of a short input alone, so a fixed trailer that
both dictionaries hold follows each window. A text is described by how many windows pass each of several thresholds of the bytes
saved; a logistic regression calibrates these counts, on texts that its dictionaries were not trained on (Model).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import Logistic, labelled_sample

#: Labelled documents of either kind, at most, that dictionaries and thresholds are fitted on, and the longest text among them.
TOXIC_DOCS, ORDINARY_DOCS, SAMPLE_CHARS = 1500, 3000, 8000
#: Sizes of the dictionaries, the length of the segments that they are put together from, and of their samples.
TOXIC_BYTES, ORDINARY_BYTES, SEGMENT, PIECE = 8 << 10, 112 << 10, 24, 400
LEVEL, WINDOW, STEP = 9, 32, 16
#: Bytes saved by which a window gets into the second toxic dictionary.
TELLING = 3
#: Thresholds, in bytes saved, and in bytes saved for each byte of the window.
SAVED, SHARE = (2, 3, 4, 5, 6, 7, 8), (0.3, 0.36, 0.42, 0.48, 0.54, 0.6, 0.66)
#: Of the regression, chosen, like all settings here, by an inner fold of training rows.
PENALTY = 0.01
TRAILER = bytes([*range(1, 9), *range(14, 32)])
MOST_WINDOWS = 250_000
_solid = re.compile(rb"[^\x20\x09-\x0D]+").findall


def windows(text: str | None) -> list[bytes]:
    """The windows of a whole text, without the spaces about them."""
    out = _solid((text or "").encode("utf-8", "replace").lower())
    if any(len(w) > WINDOW for w in out):
        out = [p for w in out for p in ([w] if len(w) <= WINDOW else [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW + STEP, STEP)])]
    return out


def family(found: list[bytes]) -> int:
    """A number that near copies mostly share: the least hash of four windows in a row. Copies are no evidence of their own."""
    return min((zlib.crc32(b" ".join(found[i : i + 4])) for i in range(max(1, len(found) - 3))), default=0)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained by zstandard; of too few samples, the samples."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _pieces(texts: list[list[bytes]]) -> list[bytes]:
    whole = [b" " + b" ".join(t) + b" " for t in texts]
    return [w[i : i + PIECE] for w in whole for i in range(0, len(w), PIECE)]


@lru_cache(maxsize=4)
def _sizes(dictionary: bytes):
    shared = zstandard.ZstdCompressionDict(dictionary + TRAILER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False, write_checksum=False).compress


class _Saved(dict):
    """Bytes that the toxic dictionary saves on a window; kept for windows seen, in bounded memory."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.toxic, self.ordinary = _sizes(toxic), _sizes(ordinary)

    def __missing__(self, window: bytes) -> int:
        if len(self) >= MOST_WINDOWS:
            self.clear()
        padded = b" " + window + b" " + TRAILER
        self[window] = saved = len(self.ordinary(padded)) - len(self.toxic(padded))
        return saved


@lru_cache(maxsize=2)
def _saved(toxic: bytes, ordinary: bytes) -> _Saved:
    return _Saved(toxic, ordinary)


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """The dictionaries of two classes of texts, which are given as their windows."""
    plain = _dictionary(_pieces(ordinary), ORDINARY_BYTES)
    telling = []
    for half in (0, 1):
        saved = _Saved(_dictionary(_pieces(toxic[1 - half :: 2]), TOXIC_BYTES), plain)
        telling += [b" " + w + b" " for t in toxic[half::2] for w in t if saved[w] >= TELLING]
    whole = _dictionary(_pieces(toxic), TOXIC_BYTES)
    return (whole + _dictionary(telling, TOXIC_BYTES) if telling else whole), plain


def features(found: list[bytes], saved: _Saved) -> np.ndarray:
    n = max(1, len(found))
    x = np.fromiter(map(saved.__getitem__, found), np.int64, len(found))
    hit = np.flatnonzero(x >= min(SAVED))
    x, size = x[hit], np.fromiter((len(found[i]) + 1 for i in hit), np.int64, len(hit))
    counts = np.array([*((x >= t).sum() for t in SAVED), *((x >= share * size).sum() for share in SHARE)], float)
    return np.r_[np.log1p(counts), counts > 0, 10 * counts / n, np.log(n)]


class Model:
    """Two judges, each with dictionaries of one half of the examples and a regression fitted on the other half; the logit of a score is the mean of theirs.

    So a regression sees counts by the very dictionaries that it goes with in scoring. Dictionaries trained anew on all examples would be others: what they save on
    ordinary words differs from sample to sample.
    """

    def __init__(self, sample: list[tuple[str, int]]):
        """Without examples of both kinds every score is the share of toxic ones (none: 0)."""
        self.rate = sum(y for _, y in sample) / max(1, len(sample))
        self.toxic = self.ordinary = b""  # of the first judge
        self.judges: list[tuple[bytes, bytes, Logistic]] = []
        if not 0 < self.rate < 1:
            return
        found = [(windows(t), y) for t, y in sample]
        heads = [family(f) for f, _ in found]
        first: dict[int, int] = {}
        for i, h in enumerate(heads):
            first.setdefault(h, i)
        of = lambda y, wanted: [found[i][0] for h, i in first.items() if found[i][1] == y and wanted(h)]
        for part in (0, 1):  # near copies are in one part
            mine = [found[i] for i, h in enumerate(heads) if h % 2 == part]
            others = lambda h: h % 2 != part  # noqa: B023, E731
            if len({y for _, y in mine}) == 2 and of(1, others):
                self._judge(of(1, others), of(0, others), mine)
        if not self.judges:  # too few to be parted
            self._judge(of(1, lambda h: True), of(0, lambda h: True), found)
        self.toxic, self.ordinary = self.judges[0][:2]

    def _judge(self, toxic: list[list[bytes]], ordinary: list[list[bytes]], seen: list[tuple[list[bytes], int]]) -> None:
        held = dictionaries(toxic, ordinary)
        saved = _Saved(*held)
        x = np.array([features(f, saved) for f, _ in seen])
        self.judges.append((*held, Logistic(x, np.array([y for _, y in seen], float), penalty=PENALTY)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.judges:
            return np.full(len(texts), self.rate)
        if not len(texts):
            return np.zeros(0)
        found, logit = [windows(t) for t in texts], np.zeros(len(texts))
        for toxic, ordinary, fitted in self.judges:
            saved = _saved(toxic, ordinary)
            p = fitted(np.array([features(f, saved) for f in found]))
            logit += (np.log(p) - np.log1p(-p)) / len(self.judges)
        return 1 / (1 + np.exp(-logit))


def train(docs: DataFrame, labels: DataFrame, fold: Column, label: str = "toxic") -> Model:
    """Fit on a bounded sample of the rows of `labels` for which `fold` holds."""
    of = lambda y, most: labelled_sample(docs, labels.where(F.col(label) == y), label, fold, most, SAMPLE_CHARS)
    return Model(of(1, TOXIC_DOCS) + of(0, ORDINARY_DOCS))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the probability, from 0 to 1, that the whole text is toxic, as column `name`, in place of one of that name.

    Null and empty texts have no windows and get a score too; equal texts get equal scores, and rows that repeat are all kept. No rows: none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(shared.value.scores(texts.tolist()))

    return docs.withColumn(name, of(F.col(text)))
