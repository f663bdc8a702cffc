"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are its byte 1- to 4-grams (A-Z lower-cased), hashed into
``BUCKETS`` rows of an embedding table; the text is the average of their
embeddings, and a linear softmax over it gives the language.  The table and the
softmax are trained by stochastic gradient descent in numpy on the driver, from
a bounded hash-drawn sample of labelled rows, whose histograms (never texts)
come to the driver.  A temperature and a rejection threshold are calibrated on
a part of that sample kept out of the descent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, small_batches
from .textarrays import LOWERED, chunks

BUCKETS, WIDTH, GRAMS = 4096, 16, (1, 2, 3, 4)
#: The bound of the fitting sample, in rows.
SAMPLE = 3000
MULTIPLIER = np.array([1, 257, 66_049 + 2, 16_974_593 + 8, 0x9E3779B1], np.uint32)


def buckets(data: np.ndarray, k: int) -> np.ndarray:
    """The bucket of the k bytes from every position that has as many."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(n, k * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
    for j in range(k):
        h += data[j : j + n]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(20)


def histogram(text: np.ndarray) -> np.ndarray:
    data = LOWERED[text]
    out = np.zeros(BUCKETS, np.int64)
    for k in GRAMS:
        out += np.bincount(buckets(data, k), minlength=BUCKETS)
    return out


class Model:
    def __init__(self, langs: list[str], embed: np.ndarray, weight: np.ndarray, bias: np.ndarray, heat: float = 1.0, least: float = 0.0):
        self.langs, self.bias, self.heat, self.least = langs, bias, heat, least
        self.table = (embed @ weight).astype(np.float64)  # both layers are linear

    def logits(self, hist: np.ndarray) -> np.ndarray:
        return hist @ self.table / max(1, hist.sum()) + self.bias

    def probabilities(self, hist: np.ndarray) -> np.ndarray:
        z = self.logits(hist) / self.heat
        e = np.exp(z - z.max())
        return e / e.sum()


def train(rows: list[tuple[str, np.ndarray]], seed: int = 7, epochs: int = 12, batch: int = 32) -> Model | None:
    """``rows``: (lang, histogram).  Every fifth is kept for calibration."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    x = np.stack([h / max(1, h.sum()) for _, h in rows]).astype(np.float32)
    y = np.array([langs.index(lang) for lang, _ in rows])
    kept = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~kept) if (~kept).any() else np.arange(len(y))
    rng = np.random.default_rng(seed)
    scale = np.float32(np.sqrt(BUCKETS) / 4)
    x *= scale
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    w = rng.normal(0, 0.1, (WIDTH, len(langs))).astype(np.float32)
    b = np.zeros(len(langs), np.float32)
    one = np.eye(len(langs), dtype=np.float32)
    for epoch in range(epochs):
        rate = np.float32(0.5 * (1 - epoch / epochs) + 0.02)
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            a = x[at] @ e
            z = a @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - one[y[at]]) / len(at)
            gw, ge = a.T @ g, x[at].T @ (g @ w.T)
            w -= rate * gw
            b -= rate * g.sum(0)
            e -= rate * ge
    m = Model(langs, e * scale, w, b.astype(np.float64))
    if kept.any():
        z = np.stack([m.logits(h) for (_, h), k in zip(rows, kept) if k])
        loss = lambda t: np.mean(np.log(np.exp(z / t - (z / t).max(1, keepdims=True)).sum(1)) + (z / t).max(1) - (z / t)[np.arange(len(z)), y[kept]])
        m.heat = float(min(np.geomspace(0.1, 10, 41), key=loss))
        p = np.stack([m.probabilities(h) for (_, h), k in zip(rows, kept) if k])
        right = p.argmax(1) == y[kept]
        # rejected: surer than that are 99 of 100 kept rows whose language is told right
        m.least = float(np.quantile(p.max(1)[right], 0.01)) if right.any() else 0.0
    return m


def _flat(hist: np.ndarray) -> tuple[list[int], list[int]]:
    at = np.flatnonzero(hist)
    return at.tolist(), hist[at].tolist()


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Train on at most ``sample`` rows with text and lang; only text and lang are looked at (doc_id seeds the draw)."""
    labelled = docs.where("text is not null and lang is not null")
    u = hash_fraction(F.col("doc_id"), F.lit("language sample"))
    # ids are drawn without their texts; at most ``sample`` of them are broadcast
    drawn = labelled.select(F.col("doc_id").alias("__id"), u.alias("__u")).distinct().orderBy("__u", "__id").limit(sample)
    rows = labelled.join(F.broadcast(drawn), F.col("doc_id").eqNullSafe(F.col("__id"))).select("text", "lang", "__u")

    def histograms(batches):
        for b in batches:
            made = [_flat(histogram(np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), np.uint8))) for t in b.column(0)]
            yield pa.record_batch([b.column(1).cast(pa.string()), b.column(2), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int64()))], names=["lang", "u", "at", "n"])

    found = small_batches(rows).mapInArrow(histograms, "lang string, u double, at array<int>, n array<long>").toArrow().combine_chunks()
    langs, draws, got = found.column("lang").to_pylist(), found.column("u").to_pylist(), []
    at, n = found.column("at"), found.column("n")
    for i in sorted(range(len(langs)), key=lambda i: (draws[i], langs[i], len(at[i])))[:sample]:  # rows of one id may be several
        h = np.zeros(BUCKETS, np.int32)
        h[at[i].values.to_numpy()] = np.minimum(n[i].values.to_numpy(), 1 << 30)
        got.append((langs[i], h))
    return train(got)


def has_letter(text: bytes) -> bool:
    a = np.frombuffer(text, np.uint8)
    if (((a | 32) >= 97) & ((a | 32) <= 122)).any():
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace"))) if (a >= 128).any() else False


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected.

    * null text or text without a letter: ``und``, score 0.
    * no labelled row to learn from: ``und`` everywhere.
    * ``rejected`` marks texts below the calibrated threshold; they keep the likeliest language.
    * null doc_id: its crc32 is null and the row counts as learned from, not held out.
    * repeated rows are repeated and get the same prediction; an empty table gives no rows.
    * a very long text is one histogram; of equally likely languages the first by code point.
    * doc_id is cast to long; one that isn't a number fails there in ANSI mode; other columns are not looked at.
    """

    def rows(batches):
        for b in batches:
            for row, data, off in chunks(b.column(1)):
                langs, scores = [], []
                for i in range(len(off) - 1):
                    text = data[off[i] : off[i + 1]]
                    if model is None or not has_letter(text.tobytes()):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    p = model.probabilities(histogram(text))
                    langs.append(model.langs[int(p.argmax())])
                    scores.append(float(p.max()))
                part = b.slice(row, len(langs))
                low = [x == "und" or s < model.least for x, s in zip(langs, scores)]
                yield pa.record_batch([part.column(0), part.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(low, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), held.alias("held_out"))
    return small_batches(src).mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    learn = docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return predict(docs, fit(learn, sample))


def op5(spark, sf_dir):
    from .common import table

    return identify(table(spark, sf_dir, "documents"))
