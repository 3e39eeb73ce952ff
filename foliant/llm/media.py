"""Texts as sound: 8-bit WAV media columns, and fingerprints of pairs of spectral peaks."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, write_table

#: Samples in a frame and between frames; the payload is padded with PAD to whole frames. Samples a second in the header.
FRAME, HOP, PAD, RATE = 576, 288, 255, 8000
#: Peaks of a frame, and frames ahead in which a peak finds partners.
PEAKS, AHEAD = 3, 2
#: Frames whose spectra are in memory at once.
BLOCK = 2048
_WINDOW = np.hanning(FRAME)


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % FRAME or (0 if data else FRAME))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def peaks_of(payload: bytes) -> np.ndarray:
    """(frame, bin) of each frame's strongest local maxima of magnitude, by frame and then by strength; of equal ones the lower bin."""
    sound = np.frombuffer(payload, np.uint8)
    frames = np.lib.stride_tricks.sliding_window_view(sound, FRAME)[::HOP]
    found = []
    for at in range(0, len(frames), BLOCK):
        part = (frames[at : at + BLOCK].astype(np.float64) - 128) * _WINDOW
        power = np.abs(np.fft.rfft(part, axis=1)[:, 1:])
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        best, value = [], []
        for _ in range(PEAKS):  # argmax gives the lowest of equal ones
            at_bin = top.argmax(1)[:, None]
            best.append(at_bin)
            value.append(np.take_along_axis(top, at_bin, 1))
            np.put_along_axis(top, at_bin, 0, 1)
        bins, value = np.concatenate(best, 1) + 2, np.concatenate(value, 1)
        row, col = np.nonzero(value > 0)
        found.append(np.stack([row + at, bins[row, col]], 1))
    return np.concatenate(found)


def fingerprint(payload: bytes) -> np.ndarray:
    """Time-coded pairs: frame << 32 | bin << 16 | other bin << 4 | frames between, ascending and distinct."""
    peaks = peaks_of(payload)
    out = []
    for step in range(1, PEAKS * (AHEAD + 1)):
        a, b = peaks[:-step], peaks[step:]
        near = b[:, 0] - a[:, 0] <= AHEAD
        a, b = a[near], b[near]
        out.append((a[:, 0] << 32) | (a[:, 1] << 16) | (b[:, 1] << 4) | (b[:, 0] - a[:, 0]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as a WAV, written to the shared folder. A null text counts as empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([to_wav(padded(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return write_table(map_in_arrow(docs.select("doc_id", "text"), encode, "doc_id long, n_bytes long, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload, fingerprint), other columns left alone: the stored sound read back, and its time-coded array of peak pairs.

    Equal media have equal fingerprints. Rows that repeat a doc_id are kept; no rows, no result.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payload = [from_wav(m) for m in b.column(2).to_pylist()]
            prints = pa.array([fingerprint(p) for p in payload], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(payload, pa.binary()), prints], ["doc_id", "n_bytes", "media", "payload", "fingerprint"])

    return map_in_arrow(media.select("doc_id", "n_bytes", "media"), read, "doc_id long, n_bytes long, media binary, payload binary, fingerprint array<long>")


def digests(features: DataFrame) -> DataFrame:
    return features.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.lower(F.lpad(F.hex(F.xxhash64("fingerprint")), 16, "0")).alias("feature"), "fingerprint",
    )
