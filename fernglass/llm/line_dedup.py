"""Line deduplication by winnowing over line hashes.

A document is its sequence of non-blank lines, one hash each.  From every line
starts a window: the fewest lines that have ``LONG`` words, but at most ``RUN``
lines; so any run of RUN lines, or of LONG words in fewer, that two places
share begins with the same window at both.  The least hash of a window is
selected (the leftmost of equal ones); selected positions are the fingerprints,
and equal windows have equal ones.  Fingerprints are joined by hash; only those
met at two places or more go on.  Around each of them the match is extended
both ways, window by window: one that also stands at an earlier place is
repeated, and adjoining repeated windows are one run.  The lines of repeated
windows are deleted; the first place keeps them.  A text of fewer than RUN
lines and LONG words is one window, which meets only other whole texts.

The order of places is (doc_id, text hash, line).  Everything is an aggregation
per fingerprint or window and a join back, so a line or passage that stands
everywhere is pre-aggregated and never a list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, unskewed_join
from .textarrays import SHINGLE, SPACE, Prefix, U, chunks, mix, words

RUN, LONG = 3, 50
LOWEST = -(1 << 63)


class Lines:
    """Non-blank lines of a chunk of texts: start, end, first (by text), hash, and number of words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, count: bool = False):
        starts, ends, first = words(data, off, data != 10)
        solid = np.r_[0, np.cumsum(~SPACE[data])]
        some = solid[ends] > solid[starts]
        prefix = Prefix(data)
        self.starts, self.ends = starts[some], ends[some]
        self.first = np.r_[0, np.cumsum(some)][first]
        self.hash = prefix.of(self.starts, self.ends)
        if count:
            at = words(data, off)[0]
            self.words = np.searchsorted(at, self.ends) - np.searchsorted(at, self.starts)

    def windows(self, run: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first line, number of lines, hash, fingerprint's line) of every window."""
        n = len(self.hash)
        text = np.searchsorted(self.first, np.arange(n), "right") - 1
        begin, left = self.first[text], self.first[text + 1] - np.arange(n)
        padded, seen = np.concatenate([self.hash, np.zeros(run, np.uint64)]), np.r_[0, np.cumsum(self.words)]
        size = np.full(n, run)
        for k in range(run - 1, 0, -1):
            size[seen[np.minimum(np.arange(n) + k, n)] - seen[:-1] >= long] = k
        short = (size > left) & (np.arange(n) == begin)  # a text with fewer lines and words is one window
        size = np.where(short, left, size)
        ok = size <= left
        h, best, at = size.astype(np.uint64) + U(1 << 32) * short.astype(np.uint64), padded[:n].copy(), np.arange(n)
        for j in range(run):
            inside = j < size
            h[inside] += padded[j : j + n][inside] * SHINGLE[j]
            less = inside & (padded[j : j + n] < best)
            best[less], at[less] = padded[j : j + n][less], np.arange(n)[less] + j
        p = np.flatnonzero(ok)
        return p, size[p], mix(h)[p], at[p]


def fingerprints(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """A row per selected position: fp, doc, mark, and the starts, sizes and hashes of the windows that it stands for."""
    schema = "fp long, doc long, mark long, starts array<int>, sizes array<int>, wins array<long>"

    def rows(batches):
        for b in batches:
            ids, marks = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for row, data, off in chunks(b.column(1)):
                x = Lines(data, off, count=True)
                if not len(x.hash):
                    continue
                p, size, wins, at = x.windows(run, long)
                text = np.searchsorted(x.first, p, "right") - 1
                if not len(p):
                    continue
                head = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])]
                cuts = pa.array(np.r_[np.flatnonzero(head), len(p)].astype(np.int32))
                listed = lambda v: pa.ListArray.from_arrays(cuts, pa.array(v))
                yield pa.record_batch([
                    pa.array(x.hash[at[head]].view(np.int64)), pa.array(ids[row + text[head]]), pa.array(marks[row + text[head]]),
                    listed((p - x.first[text]).astype(np.int32)), listed(size.astype(np.int32)), listed(wins.view(np.int64)),
                ], names=["fp", "doc", "mark", "starts", "sizes", "wins"])

    return _ids(docs).mapInArrow(rows, schema)


def _ids(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("mark"))


def repeated_windows(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """(doc, mark, windows): (start, size) of the windows of each document that also stand at an earlier place."""
    found = cut(fingerprints(docs, run, long))  # used twice
    shared = cut(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    around = unskewed_join(found, shared, "fp", "n", ["doc", "mark"], "left_semi")
    around = around.select("doc", "mark", F.explode(F.arrays_zip("starts", "sizes", "wins")).alias("w"))
    around = cut(around.select("doc", "mark", F.col("w.starts").alias("start"), F.col("w.sizes").alias("size"), F.col("w.wins").alias("win")))
    place = F.struct("doc", "mark", "start")
    first = cut(around.groupBy("win").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = unskewed_join(around, first, "win", "n", ["doc", "mark", "start"]).where(place > F.col("first"))
    return later.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "size")).alias("windows"))  # no more than the document's lines


RESULT = "doc_id long, n_lines long, n_removed long, n_runs long, kept_bytes long, kept_sha256 string"


def dedup_lines(docs: DataFrame, run: int = RUN, keep: bool = False, long: int = LONG) -> DataFrame:
    """One row per input row: RESULT, with ``keep`` also the remaining text (column kept).

    ``n_lines`` are the non-blank lines, ``n_removed`` those deleted, in
    ``n_runs`` runs.  Blank lines stay where they are and don't interrupt runs.

    * null and empty texts have no lines.
    * a text of fewer than RUN lines and LONG words loses all or nothing: all where an earlier document has the same lines and no others.
    * null doc_id: before all other ids, and null in the result.
    * rows with equal doc_id and text are one document: they keep or lose the same lines.
    * a very long text is hashed at once, an array of a few words per byte; a line of any length is one line.
    * an empty table gives no rows; columns of ``docs`` other than doc_id and text are not looked at.
    """
    gone = repeated_windows(docs, run, long)
    g = gone.select(F.col("doc").alias("__d"), F.col("mark").alias("__m"), "windows")
    both = _ids(docs).join(g, (F.col("doc") == F.col("__d")) & (F.col("mark") == F.col("__m")), "left").select("doc", "text", "windows")
    schema = RESULT + ", kept string" * keep

    def rows(batches):
        import hashlib

        for b in batches:
            ids, marks, out = b.column(0), b.column(2), []
            for row, data, off in chunks(b.column(1)):
                x = Lines(data, off)
                for i in range(len(off) - 1):
                    n = int(x.first[i + 1] - x.first[i])
                    drop = np.zeros(n, bool)
                    for w in marks[row + i].as_py() or ():
                        drop[w["start"] : w["start"] + w["size"]] = True
                    text = data[off[i] : off[i + 1]].tobytes()
                    if drop.any():
                        dead = set((x.starts[x.first[i] : x.first[i + 1]][drop] - off[i]).tolist())
                        lines, at = [], 0
                        for line in text.split(b"\n"):
                            if at not in dead:
                                lines.append(line)
                            at += len(line) + 1
                        text = b"\n".join(lines)
                    runs = int((drop[1:] & ~drop[:-1]).sum() + (drop[0] if n else 0))
                    ident = ids[row + i].as_py()
                    out.append((None if ident == LOWEST else ident, n, int(drop.sum()), runs, len(text), hashlib.sha256(text).hexdigest(), *([text.decode("utf-8", "replace")] * keep)))
            names = [c.split(" ")[0] for c in schema.split(", ")]
            kinds = [pa.int64() if c.endswith("long") else pa.string() for c in schema.split(", ")]
            yield pa.record_batch([pa.array([o[j] for o in out], k) for j, k in enumerate(kinds)], names=names)

    return both.mapInArrow(rows, schema)


def op3(spark, sf_dir):
    from .common import table

    return dedup_lines(table(spark, sf_dir, "documents"))


SQL = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM split),
solid AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM solid),
ahead AS (SELECT *, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3, lead(w, 1) OVER o AS w2, count(*) OVER (PARTITION BY doc_id) AS n
  FROM counted WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sized AS (SELECT *, CASE WHEN w >= 50 THEN 1 WHEN w + w2 >= 50 THEN 2 WHEN l3 IS NOT NULL THEN 3 WHEN k = 1 THEN n END AS size,
  w < 50 AND coalesce(w + w2 < 50, true) AND l3 IS NULL AS whole FROM ahead),
wins AS (SELECT doc_id, k, size, whole, [line, l2, l3][1:size] AS win FROM sized WHERE size IS NOT NULL),
firsts AS (SELECT *, doc_id > min(doc_id) OVER g OR k > min(k) OVER h AS later FROM wins
  WINDOW g AS (PARTITION BY whole, size, win), h AS (PARTITION BY doc_id, whole, size, win)),
dead AS (SELECT DISTINCT doc_id, k + j AS k FROM firsts, range(0, 3) AS r(j) WHERE later AND j < size),
marked AS (SELECT l.doc_id, l.line, l.i, s.k, d.k IS NOT NULL AS gone FROM lines l
  LEFT JOIN solid s ON l.doc_id = s.doc_id AND l.i = s.i LEFT JOIN dead d ON s.doc_id = d.doc_id AND s.k = d.k),
runs AS (SELECT *, k IS NOT NULL AND gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id, k IS NULL ORDER BY i), false) AS opens FROM marked),
kept AS (SELECT doc_id, count(k) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
  CAST(strlen(coalesce(t, '')) AS BIGINT) AS kept_bytes, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
