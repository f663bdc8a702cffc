"""Toxicity by compression distance between two zstandard dictionaries.

A text's bytes are folded (A-Z lower-cased, runs of ASCII punctuation and white
space one blank) and cut into windows of about ``WINDOW`` bytes that end with a
word where one ends; the windows are the whole text.  Each is compressed with a
dictionary trained on ordinary text and with one trained on toxic text; the
difference of the lengths says which class it resembles.

Both dictionaries are trained by zstandard.  The ordinary one comes from
windows of ordinary documents.  Most of a toxic document is ordinary too, so
the toxic dictionary is trained on its short pieces that the ordinary
dictionary compresses worst, and then, in rounds, on those that a toxic
dictionary trained on the *other* half of the toxic documents compresses
better: only what toxic documents have in common survives that.  It stands
behind the ordinary content, where the ordinary dictionary has noise of the same
length, so that ordinary text costs the same under both.

A logistic over a document's window differences (their mean, and how many reach
each of LEVELS against what ordinary text of that length shows) is fitted on
sample rows kept out of the dictionaries.  The same rows choose between the dictionaries of several
sizes and rounds, and calibrate the threshold, which is moved to 0.5 and
maximises the share caught minus ``FALSE_COST`` times the share falsely rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_fraction, lean, small_batches

#: Bytes of a scored window, of a piece the toxic dictionary learns from, of a window the ordinary one learns from.
WINDOW, PIECE, BACKGROUND = 48, 24, 128
#: The bounded fitting sample: labelled rows, and how many windows and pieces of them train the dictionaries.
SAMPLE, BACKGROUND_WINDOWS, PIECES = 20_000, 60_000, 200_000
#: Dictionary sizes; the toxic ones are candidates, after each of ROUNDS rounds.
ORDINARY_SIZE, TOXIC_SIZES, ROUNDS = 65_536, (1024, 2048, 4096), 4
SURPRISING, GAIN, ENOUGH, FALSE_COST = 0.4, 2, 30, 10
PUNCTUATION = bytes(b for b in range(128) if not bytes([b]).isalnum())
FOLD = bytes.maketrans(PUNCTUATION + bytes(range(65, 91)), b" " * len(PUNCTUATION) + bytes(range(97, 123)))
COMPRESS = dict(window_log=18, chain_log=17, hash_log=17, search_log=7, min_match=5, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2)


def folded(text: bytes) -> bytes:
    return b" ".join([b"", *text.translate(FOLD).split(), b""])


def _cutter(size: int) -> re.Pattern:
    """Matches the longest run of up to ``size`` bytes that a blank follows, else ``size`` bytes."""
    return re.compile(rb".{1,%d}(?= )|.{1,%d}" % (size, size), re.S)


def windows(text: bytes, size: int) -> list[bytes]:
    """Consecutive windows of a folded text, each with the blank after it; none are left out and an empty text has one."""
    return [w + b" " for w in _cutter(size).findall(text)] or [b" "]


def compressor(content: bytes):
    how = zstandard.ZstdCompressionParameters(**COMPRESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress


def trained(samples: list[bytes], size: int, segment: int) -> bytes | None:
    """A dictionary trained by zstandard, or None where the samples are too few for one."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


class Pair:
    """The ordinary and the toxic dictionary, as compressors of windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        noise = np.random.default_rng(1).integers(0, 256, len(toxic), dtype=np.uint8).tobytes()
        self.plain, self.toxic = compressor(ordinary + noise), compressor(ordinary + toxic)

    def gains(self, pieces: list[bytes]) -> np.ndarray:
        """By how many bytes the toxic dictionary compresses each piece better."""
        return np.array([len(self.plain(w)) - len(self.toxic(w)) for w in pieces], dtype=np.float64)

    def features(self, text: bytes) -> list[float]:
        """Number of windows, sum of the gains, and how many reach each of LEVELS."""
        d = self.gains(windows(folded(text), WINDOW))
        return [len(d), d.sum(), *((d >= k).sum() for k in LEVELS)]


LEVELS = (1, 2, 3, 4, 5, 6, 8)
N_RAW, N_FEATURES = len(LEVELS) + 2, len(LEVELS) + 1


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.mean, self.scale, self.weight, self.bias = np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0
        self.usual = np.zeros(len(LEVELS))

    def pair(self) -> Pair:
        return Pair(self.ordinary, self.toxic)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Standardised; far outside the sample's range a feature says no more than at its edge."""
        return np.clip((self.relative(x) - self.mean) / self.scale, -4, 4)

    def relative(self, x: np.ndarray) -> np.ndarray:
        """The mean gain, and the windows that reach each level against as many windows of ordinary text, whatever the length."""
        return np.c_[x[:, 1] / x[:, 0], np.log((x[:, 2:] + 1) / (x[:, :1] * self.usual + 1))]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.usual = x[y == 0, 2:].sum(0) / max(1, x[y == 0, 0].sum())
        own = self.relative(x)
        self.mean, self.scale = own.mean(0), own.std(0) + 1e-6
        a = np.c_[self.scaled(x), np.ones(len(x))]
        w = np.zeros(a.shape[1])
        ridge = np.diag([*[0.1] * N_FEATURES, 1e-6])
        for _ in range(50):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w -= np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        self.weight, self.bias = w[:-1], float(w[-1])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.fit(x, y)
        z = self.logits(x)
        cuts = np.unique(z)
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        pos, neg = np.sort(z[y == 1]), np.sort(z[y == 0])
        gain = (len(pos) - np.searchsorted(pos, cuts)) / max(1, len(pos)) - FALSE_COST * (len(neg) - np.searchsorted(neg, cuts)) / max(1, len(neg))
        best = cuts[np.flatnonzero(gain >= gain.max() - 1e-12)]
        self.bias -= float(best[len(best) // 2])


def rank_quality(z: np.ndarray, y: np.ndarray) -> float:
    """The share of (toxic, ordinary) pairs in the right order."""
    pos, neg = z[y == 1], np.sort(z[y == 0])
    if not len(pos) or not len(neg):
        return 0.5
    return float((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).mean() / (2 * len(neg)))


def crossed_quality(x: np.ndarray, y: np.ndarray) -> float:
    """Rank quality of a logistic on rows it wasn't fitted on, in three folds."""
    fold, got = np.arange(len(y)) % 3, []
    for k in range(3):
        if (y[fold != k] == 1).any() and (y[fold != k] == 0).any():
            m = Model(b"", b"")
            m.fit(x[fold != k], y[fold != k])
            got.append(rank_quality(m.logits(x[fold == k]), y[fold == k]))
    return float(np.mean(got)) if got else 0.5


def toxic_dictionaries(ordinary: bytes, halves: list[list[bytes]]) -> list[bytes]:
    """Candidates, for each size and round; ``halves`` are the pieces of two halves of the toxic documents, in the texts' order."""
    plain, out = compressor(ordinary), []

    def surprising(pieces):
        cost = np.array([len(plain(w)) / (len(w) + 4) for w in pieces])
        return [pieces[i] for i in np.sort(np.argsort(-cost, kind="stable")[: int(np.ceil(len(pieces) * SURPRISING))])]

    first = [surprising(h) for h in halves]
    for size in TOXIC_SIZES:
        picked = first
        for step in range(ROUNDS):
            whole = trained(picked[0] + picked[1], size, 16)
            if whole is None:
                break
            out.append(whole)
            if step == ROUNDS - 1:
                break
            other = [trained(p, size, 16) for p in picked]
            if None in other:
                break
            gains = [Pair(ordinary, other[1 - h]).gains(halves[h]) for h in (0, 1)]
            picked = [[halves[h][i] for i in np.flatnonzero(gains[h] >= GAIN)] for h in (0, 1)]
            if min(map(len, picked)) < ENOUGH:
                break
    return out


def _pieces(rows: DataFrame, size: int, most: int) -> list[tuple[int, bytes]]:
    """(half, piece) of the windows of ``size`` bytes of hash-drawn ``rows`` (text, half, draw), at most ``most``, in the texts' order."""

    def cutting(batches):
        for b in batches:
            for i, text in enumerate(b.column(0)):
                got = [w for w in windows(folded(text.as_py().encode()), size) if len(w) >= 9]
                for at in range(0, len(got), 65_536):
                    part = got[at : at + 65_536]
                    same = [pa.array([b.column(k)[i].as_py()] * len(part), t) for k, t in ((1, pa.int32()), (2, pa.float64()))]
                    yield pa.record_batch([*same, pa.array(part, pa.binary()), pa.array(range(at, at + len(part)), pa.int64())], names=["half", "draw", "piece", "at"])

    made = small_batches(rows).mapInArrow(lean(cutting), "half int, draw double, piece binary, at long")
    got = made.orderBy("draw", "at", "piece").limit(most).toArrow()  # ``most`` short pieces
    return list(zip(got.column("half").to_pylist(), got.column("piece").to_pylist()))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from at most ``sample`` labelled rows (text and label only; doc_id seeds the draw and the folds).

    None if no toxic or no ordinary document is labelled, or too few texts are there to train dictionaries on.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    u = hash_fraction(F.col("doc_id"), F.lit("toxicity sample"))
    drawn = known.select(F.col("doc_id").alias("__i"), "__toxic", u.alias("__u")).orderBy("__u", "__i").limit(sample)
    rows = docs.where("text is not null").join(F.broadcast(drawn), F.col("doc_id") == F.col("__i"))  # ``sample`` rows at most
    part = F.floor(F.col("__u") * 999_983 % 1 * 10).cast("int")
    rows = cut(rows.select("text", (F.col("__toxic") == 1).cast("int").alias("__toxic"), part.alias("__part"), F.col("__u").alias("draw")))
    build = rows.where("__part < 7").select("text", (F.col("__part") % 2).alias("half"), "draw", "__toxic")
    background = [w for _, w in _pieces(build.where("__toxic = 0").drop("__toxic"), BACKGROUND, BACKGROUND_WINDOWS)]
    toxic = _pieces(build.where("__toxic = 1").drop("__toxic"), PIECE, PIECES)
    halves = [[w for h, w in toxic if h == k] for k in (0, 1)]
    ordinary = trained(background, min(ORDINARY_SIZE, sum(map(len, background)) // 2), 32) if background else None
    if ordinary is None or not all(halves):
        return None
    candidates = toxic_dictionaries(ordinary, halves)
    if not candidates:
        return None

    def features(batches):
        pairs = [Pair(ordinary, c) for c in candidates]
        for b in batches:
            x = [[float(v) for p in pairs for v in p.features(t.as_py().encode())] for t in b.column(0)]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    kept = small_batches(rows).where("__part >= 7").select("text", "__toxic").mapInArrow(lean(features), "x array<double>, y int").collect()
    if not kept:
        return Model(ordinary, candidates[0])
    x, y = np.array([r["x"] for r in kept]).reshape(len(kept), len(candidates), N_RAW), np.array([r["y"] for r in kept])
    order = np.lexsort((*x.reshape(len(kept), -1).T[:3], y))  # the same folds whatever the order of rows
    x, y = x[order], y[order]
    best = max(range(len(candidates)), key=lambda i: (crossed_quality(x[:, i], y), -i))
    model = Model(ordinary, candidates[best])
    model.calibrate(x[:, best], y)
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predict(docs: DataFrame, model: Model | None, keep: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_windows.

    With ``keep`` the rows have the columns of ``docs`` instead, and those predicted toxic are gone.

    * null, empty and wordless texts are one blank window and get its score.
    * a very long text is all scored, a window at a time; a text without blanks is cut at every WINDOW bytes.
    * no labelled toxic (or ordinary) document: score 0 everywhere.
    * repeated rows get the same score; null doc_id stays null and isn't held out.
    * an empty table gives no rows; columns of ``docs`` other than doc_id and text are not looked at.
    * doc_id is cast to long; one that isn't a number fails there in ANSI mode.
    """

    def measured(pair, column):
        return np.array([pair.features((t.as_py() or "").encode()) for t in column], dtype=np.float64).reshape(-1, N_RAW)

    def rows(batches):
        pair = model and model.pair()
        for b in batches:
            x = measured(pair, b.column(1)) if model else np.zeros((b.num_rows, N_RAW))
            s = model.score(x) if model else np.zeros(b.num_rows)
            n = x[:, 0].astype(np.int64)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(n)], names=["doc_id", "held_out", "score", "predicted", "n_windows"])

    def kept(batches):
        pair = model and model.pair()
        for b in batches:
            yield b.filter(pa.array(model.score(measured(pair, b.column("text"))) < 0.5)) if model else b

    if keep:
        return small_batches(docs).mapInArrow(lean(kept), docs.schema)
    src = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return small_batches(src).mapInArrow(lean(rows), "doc_id long, held_out boolean, score double, predicted int, n_windows long")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    return fit(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))), sample)


def op4(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs, table(spark, sf_dir, "labels")))
