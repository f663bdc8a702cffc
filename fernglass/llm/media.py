"""Media columns: 8-bit WAV payloads and spectral-peak fingerprints.

A text's bytes, padded with zero bytes to a positive multiple of 64, become the
unsigned 8-bit samples of a mono WAV file, which stores them losslessly.  The
features come from the samples read back: a short-time Fourier transform
(frames of 256 samples, Hann window, hop 128), the strongest peaks of each
group of eight frames, and hashes of peak pairs (f1, f2, dt) with the time of
the first, stored as time-coded arrays.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLOCK, RATE, FRAME, HOP, GROUP, PEAKS, FAN = 64, 8000, 256, 128, 8, 2, 2


def payload(text: bytes) -> bytes:
    return text + b"\0" * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono 8-bit WAV file")
        return w.readframes(w.getnframes())


def spectrum(samples: np.ndarray) -> np.ndarray:
    """Magnitudes (frames x FRAME/2+1); the last frame is filled with silence (128)."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    x = np.full((n - 1) * HOP + FRAME, 128, np.float32)
    x[: len(samples)] = samples
    x -= 128
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)).astype(np.float32)


def peaks(mag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the PEAKS strongest cells of every GROUP frames, in order of time."""
    n, bins = mag.shape
    groups = -(-n // GROUP)
    m = np.zeros((groups * GROUP, bins), np.float32)
    m[:n] = mag
    m[:, :2] = 0  # the mean level says nothing
    flat = m.reshape(groups, GROUP * bins)
    top = np.argpartition(-flat, PEAKS, axis=1)[:, :PEAKS]
    top.sort(axis=1)
    t, f = top // bins + np.arange(groups)[:, None] * GROUP, top % bins
    keep = np.take_along_axis(flat, top, axis=1).ravel() > 0
    return t.ravel()[keep], f.ravel()[keep]


def landmarks(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, hash): every peak with its FAN next ones; hash = f1, f2 and the time between, 8 bits each."""
    ts, hs = [], []
    for j in range(1, FAN + 1):
        if len(t) > j:
            dt = np.minimum(t[j:] - t[:-j], 255)
            ts.append(t[:-j])
            hs.append((f[:-j].astype(np.int64) << 16) | (f[j:] << 8) | dt)
    if not ts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    time, h = np.concatenate(ts), np.concatenate(hs)
    order = np.lexsort((h, time))
    return time[order].astype(np.int32), h[order].astype(np.int32)


def fingerprint(samples: bytes, piece: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded landmarks; a long payload is transformed in pieces of whole groups, so memory is bounded."""
    x = np.frombuffer(samples, np.uint8)
    step = piece // (HOP * GROUP) * HOP * GROUP
    ts, fs = [], []
    for at in range(0, len(x), step):
        t, f = peaks(spectrum(x[at : at + step + FRAME - HOP])[: step // HOP])
        ts.append(t + at // HOP)
        fs.append(f)
    return landmarks(np.concatenate(ts), np.concatenate(fs))


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_landmarks long, landmark_time array<int>, landmark_hash array<int>"
)
FULL = ", media binary"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row per input row with the digests and time-coded arrays of SCHEMA; ``keep_media`` adds the WAV file.

    ``feature`` is ``<landmarks>:<sha256 of the time-coded arrays, 32 digits>``; equal texts have equal values.

    * null and empty text: 64 zero bytes of payload, n_bytes 0.
    * a very long text is transformed a piece at a time; of equally strong peaks the choice is numpy's, the same for equal texts.
    * doc_id is cast to long; one that isn't a number fails there in ANSI mode.
    * null doc_id stays null; repeated rows are repeated; no rows give no rows; other columns are not looked at.
    """

    def rows(batches):
        for b in batches:
            out = {k: [] for k in names}
            ids = b.column(0)
            for i, text in enumerate(b.column(1)):
                text = text.as_py() or b""
                stored = to_wav(payload(text))
                back = from_wav(stored)
                t, h = fingerprint(back)
                code = hashlib.sha256(t.astype("<i4").tobytes() + h.astype("<i4").tobytes()).hexdigest()[:32]
                made = (
                    ids[i].as_py(), len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]),
                    len(stored), hashlib.sha256(stored).hexdigest(), f"{len(t)}:{code}", len(t),
                )
                for k, v in zip(names, (*made, t, h, stored)):
                    out[k].append(v)
                if len(out["doc_id"]) >= 512:
                    yield pa.record_batch([pa.array(out[f.name], f.type) for f in fields], names=names)
                    out = {k: [] for k in names}
            if out["doc_id"]:
                yield pa.record_batch([pa.array(out[f.name], f.type) for f in fields], names=names)

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    schema = SCHEMA + FULL * keep_media
    fields = [pa.field(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in schema.split(", ")]
    names = [f.name for f in fields]
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return small_batches(src).mapInArrow(rows, schema)


def op6(spark, sf_dir):
    from .common import table

    return media_columns(table(spark, sf_dir, "documents"))
