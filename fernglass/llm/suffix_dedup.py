"""Removal of repeated passages of ``LENGTH`` bytes, with logarithmic families of sparse suffix arrays.

A byte goes if a LENGTH-byte string that covers it also starts in a document
with a smaller doc_id.  All strings are judged on the input.

Every LENGTH-byte string is named by its anchor: the place of the least
``GRAM``-byte hash within it, so equal strings have equal anchors.  Consecutive
strings of one anchor form a run; only the runs' suffixes (one per 16 bytes of
text or so) are indexed, sorted by fingerprints.  A partition holds the
suffixes whose anchors fall to it.  There documents arrive in batches by
doc_id: a batch's suffix array is merge-scanned against the levels of the
index, then becomes a level itself, and levels of about equal size are merged,
so sizes grow geometrically (``Family``).

Round one decides whole runs: an equal run in an earlier document covers all
its strings.  A run whose anchor has also been seen in a different run is
undecided; round two indexes its single strings in the same way.  It sends the
bytes of such a run, compressed, to its anchor's partition, as equal strings
have equal anchors; where an anchor has more than ``HOT`` runs, it deals the
hashes of the single strings instead.  What comes
back to a document is a byte per run or string, in order, so the text itself is
shuffled once per round and never replicated.

A passage that stands in every document is met once per batch of texts and not
once per document: within a batch only the first document asks for a key, and
the others, which have an earlier one beside them, are answered on the spot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_and_free, small_batches
from .textarrays import Prefix, U, chunks, mix, window_min

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
PLACE = U((1 << 31) - 1)
#: Text bytes of a partition of suffixes, of a bucket of texts, of a message's batch; keys of an index batch.
PART_MB, BUCKET_MB, MESSAGE_BYTES, BATCH = 48, 16, 32 << 20, 1 << 18
CHUNK = 1 << 19
#: Runs of an anchor beyond which round two deals its single strings by their own hashes.
HOT = 1 << 16
#: Stands for a null doc_id, before all others.
LOWEST = -(1 << 63)


class Runs:
    """The runs of a chunk of texts: first and last string's start, anchor hash, run hash, text."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.prefix = Prefix(data)
        gram = self.prefix.grams(GRAM)
        none = np.zeros(0, np.int64)
        self.start = self.last = self.text = none
        self.anchor = self.code = np.zeros(0, np.uint64)
        if len(data) < LENGTH:
            return
        # the least hash, the leftmost of equal ones: the place stands in the low bits
        least = window_min((gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64), SPAN)
        at = (least & PLACE).astype(np.int64)
        valid = np.ones(len(at), bool)  # strings that end within their text
        for end in off[1:-1][(off[1:-1] > 0)]:
            valid[max(0, end - LENGTH + 1) : end] = False
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
        inner = off[1:-1]
        fresh[inner[inner < len(at)]] = True
        fresh &= valid
        self.start = np.flatnonzero(fresh)
        stop = np.ones(len(at), bool)
        stop[:-1] = fresh[1:] | ~valid[1:]
        self.last = np.flatnonzero(stop & valid)
        self.anchor = gram[at[self.start]]
        self.code = self.prefix.of(self.start, self.last + LENGTH)
        self.text = np.searchsorted(off, self.start, "right") - 1

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, texts) of the single strings of some runs, in order."""
        n = self.last[which] - self.start[which] + 1
        p = np.repeat(self.start[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return p, np.repeat(self.text[which], n)


class Family:
    """A logarithmic family of sorted arrays: key -> the first document that had it."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _sorted(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        return keys[first], docs[first]

    @staticmethod
    def _merged(one, two):
        keys, docs = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
        order = np.argsort(keys, kind="stable")  # two sorted runs, which it merges
        keys, docs = keys[order], docs[order]
        again = np.flatnonzero(keys[1:] == keys[:-1])
        docs[again] = np.minimum(docs[again], docs[again + 1])
        first = np.ones(len(keys), bool)
        first[again + 1] = False
        return keys[first], docs[first]

    def add(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Index a batch; returns for each of its keys the least document that has it, in this batch or before."""
        own, first = self._sorted(keys, docs)
        least = first.copy()
        for level, there in self.levels:
            at = np.searchsorted(level, own)
            at[at == len(level)] = 0
            hit = level[at] == own
            least[hit] = np.minimum(least[hit], there[at[hit]])
        self.levels.append((own, first))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            self.levels.append(self._merged(self.levels.pop(), self.levels.pop()))
        return least[np.searchsorted(own, keys)]


def first_docs(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For every key the least document that has it, batch by batch in the order of documents."""
    order = np.argsort(docs, kind="stable")
    out, family = np.empty(len(keys), np.int64), Family()
    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        out[rows] = family.add(keys[rows], docs[rows])
    # a document that is cut by a batch's end is no earlier than itself, so nothing is lost there
    return out


def spread(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U(40)) % U(parts)).astype(np.int64)


MESSAGE = "part int, own int, batch long, docs binary, marks binary, counts binary, keys binary, anchors binary"
#: ``part`` is -1 for what the batches decided themselves, which are the codes of whole texts.
REPLY = "bucket int, part int, kind int, batches binary, docs binary, marks binary, counts binary, codes binary"
#: ``own`` of a message; kinds of replies.
DECIDED, KEYS, CONTEXTS = 0, -1, -2
#: What a batch decides itself: a document before has the key; the document has no id, so none is before.
ASK, COVERED, FREE = 0, 1, 2


def pressed(a: np.ndarray) -> bytes:
    """An array compressed, by planes of its numbers' bytes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else a
    return zstandard.compress(planes.tobytes(), 3)


def opened(x: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def steps(docs: np.ndarray) -> bytes:
    """Ids compressed by their differences, signs in the lowest bit."""
    d = np.diff(docs, prepend=np.int64(0))
    return pressed((d << 1) ^ (d >> 63))


def unstepped(x: bytes) -> np.ndarray:
    z = opened(x, np.uint64)
    return np.cumsum((z >> U(1)) ^ (U(0) - (z & U(1)))).view(np.int64)


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (n[0] numbers), start[1], .."""
    return np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def decided(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """ASK, COVERED or FREE for each key of a batch and its document; every key's first document asks, or stays for it."""
    out = np.zeros(len(keys), np.uint8)
    if not len(keys):
        return out
    order = np.lexsort((doc, keys))
    sorted_keys, sorted_doc = keys[order], doc[order]
    heads = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    least = np.repeat(sorted_doc[heads], np.diff(np.r_[heads, len(keys)]))
    out[order] = np.where(sorted_doc > least, COVERED, ASK)
    seen = np.ones(len(keys), bool)
    seen[heads] = False
    out[order[seen & (sorted_doc == LOWEST)]] = FREE
    return out


def message_rows(doc: np.ndarray, mark: np.ndarray, text: np.ndarray, keys: np.ndarray, anchors: np.ndarray | None, parts: int, batch: int):
    """Rows of MESSAGE; text numbers the rows of doc and mark, ascending.

    One row carries what was decided here, for whole texts; it goes to any part and passes through it.
    """
    part = spread(anchors if anchors is not None else keys, parts)
    known, out = decided(keys, doc[text]), []
    here = known != ASK
    if here.any():
        t, start, n = np.unique(text, return_index=True, return_counts=True)
        some = np.add.reduceat(here, start, dtype=np.int64) > 0
        out.append((batch % parts, DECIDED, batch, steps(doc[t[some]]), mark[t[some]].tobytes(), pressed(n[some].astype(np.uint32)), pressed(known[np.repeat(some, n)]), b""))
    asked = np.flatnonzero(~here)
    order = asked[np.argsort(part[asked].astype(np.uint16) if parts <= 65_536 else part[asked], kind="stable")]
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(ends)):
        rows = order[ends[p] : ends[p + 1]]
        t, n = np.unique(text[rows], return_counts=True)
        low = (anchors[rows] & U(0xFFFFFFFF)).astype(np.uint32).tobytes() if anchors is not None else b""
        out.append((int(p), KEYS, batch, steps(doc[t]), mark[t].tobytes(), pressed(n.astype(np.uint32)), keys[rows].tobytes(), low))
    return out


def context_rows(doc: np.ndarray, mark: np.ndarray, text: np.ndarray, anchor: np.ndarray, size: np.ndarray, data: np.ndarray, parts: int, batch: int):
    """Rows of MESSAGE with runs' bytes, end to end in ``data``, as keys and their sizes as anchors; counts are of strings."""
    part, start, out = spread(anchor, parts), np.cumsum(size) - size, []
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(ends)):
        rows = order[ends[p] : ends[p + 1]]
        t, first = np.unique(text[rows], return_index=True)
        n = np.add.reduceat(size[rows] - LENGTH + 1, first)
        out.append((int(p), CONTEXTS, batch, steps(doc[t]), mark[t].tobytes(), pressed(n.astype(np.uint32)), zstandard.compress(data[ranges(start[rows], size[rows])].tobytes(), 3), pressed(size[rows].astype(np.uint8))))
    return out


def context_keys(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hashes of the strings of runs that stand end to end, about CHUNK bytes at a time."""
    off, row, out = np.r_[0, np.cumsum(size)], 0, [np.zeros(0, np.uint64)]
    while row < len(size):
        end = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK, "right")) - 1)
        p = ranges(off[row:end] - off[row], size[row:end] - LENGTH + 1)
        out.append(Prefix(data[off[row] : off[end]]).of(p, p + LENGTH))
        row = end
    return np.concatenate(out)


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [c.split(" ") for c in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def marks_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64 bits of every text's hash, which tell rows of one doc_id apart."""
    return np.array([mark_of(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.uint64)


def firsts(doc: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its doc and mark; repeated rows get the same answers, so the first asks for all."""
    seen: dict[tuple, int] = {}
    return np.array([seen.setdefault(who, i) == i for i, who in enumerate(zip(doc.tolist(), mark.tolist()))], bool)


def mark_of(text) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


def run_messages(docs: DataFrame, parts: int) -> DataFrame:
    def rows(batches):
        held, size, base = [], 0, 0
        batch = TaskContext.get().partitionId() << 32

        def flush():
            nonlocal batch
            batch += 1
            doc, mark, text, code, anchor = (np.concatenate(x) for x in zip(*held))
            asks = firsts(doc, mark)[text]
            text, code, anchor = text[asks], code[asks], anchor[asks]
            return table_of(message_rows(doc, mark, text, code, anchor, parts, batch), MESSAGE).to_batches()

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, data, off in chunks(b.column(1), CHUNK):
                r = Runs(data, off)
                n = len(off) - 1
                held.append((ids[row : row + n], marks_of(data, off), r.text + base, r.code, r.anchor))
                base, size = base + n, size + len(data)
                if size >= MESSAGE_BYTES:
                    yield from flush()
                    held, size, base = [], 0, 0
        if held:
            yield from flush()

    return docs.mapInArrow(rows, MESSAGE)


def replies(messages: DataFrame, buckets: int, runs: bool) -> DataFrame:
    """For every key a code: 1 an earlier document has it, 2 (runs only) it is undecided, 3 so is it with a hot anchor, else 0.

    Documents without any code don't come back.
    """

    def decide(key: tuple, t: pa.Table) -> pa.Table:
        out, own = [], t.column("own").to_numpy()
        for kind in (DECIDED, KEYS, CONTEXTS):
            mine = t.filter(pa.array(own == kind))
            if not mine.num_rows:
                continue
            of = lambda name, f: np.concatenate([f(x) for x in mine.column(name).to_pylist()])  # noqa: B023, E731
            docs, marks = of("docs", unstepped), of("marks", lambda x: np.frombuffer(x, np.uint64))
            counts = of("counts", lambda x: opened(x, np.uint32)).astype(np.int64)
            batches = np.repeat(mine.column("batch").to_numpy(), [len(x) // 8 for x in mine.column("marks").to_pylist()])
            if kind == DECIDED:
                codes = of("keys", lambda x: opened(x, np.uint8))
            else:
                doc = np.repeat(docs, counts)
                if kind == KEYS:
                    keys = of("keys", lambda x: np.frombuffer(x, np.uint64))
                else:
                    both = zip(mine.column("keys").to_pylist(), mine.column("anchors").to_pylist())
                    keys = np.concatenate([context_keys(np.frombuffer(zstandard.decompress(x), np.uint8), opened(n, np.uint8).astype(np.int64)) for x, n in both])
                codes = (first_docs(keys, doc) < doc).astype(np.uint8)
            if kind == KEYS and runs:
                anchors = of("anchors", lambda x: np.frombuffer(x, np.uint32))
                order = np.argsort(anchors, kind="stable")
                heads = np.flatnonzero(np.r_[True, anchors[order][1:] != anchors[order][:-1]])
                sorted_keys, n = keys[order], np.diff(np.r_[heads, len(keys)])
                many = np.minimum.reduceat(sorted_keys, heads) != np.maximum.reduceat(sorted_keys, heads)
                undecided = np.empty(len(keys), np.uint8)
                undecided[order] = np.repeat(np.where(many, np.where(n > HOT, 3, 2), 0).astype(np.uint8), n)
                codes = np.where(codes == 0, undecided, codes)
            starts = np.cumsum(counts) - counts
            some = np.flatnonzero(np.add.reduceat(codes, starts, dtype=np.int64) > 0)
            bucket = bucket_of(docs[some], marks[some], buckets)
            order = np.lexsort((docs[some], batches[some], bucket))
            some, bucket = some[order], bucket[order]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)):
                rows = some[ends[b] : ends[b + 1]]
                which = (-1, KEYS) if kind == DECIDED else (int(key[0].as_py()), kind)
                out.append((int(b), *which, steps(batches[rows]), steps(docs[rows]), marks[rows].tobytes(), pressed(counts[rows].astype(np.uint32)), pressed(codes[ranges(starts[rows], counts[rows])])))
        return table_of(out, REPLY)

    return messages.groupBy("part").applyInArrow(decide, REPLY)


def identity(docs: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """64 bits that name a doc and mark."""
    return mix(docs.view(np.uint64) ^ mix(marks))


def bucket_of(docs: np.ndarray, marks: np.ndarray, buckets: int) -> np.ndarray:
    return (identity(docs, marks) % U(buckets)).astype(np.int64)


class Answers:
    """What came back for a bucket: rows of (identity, part) in order, with their codes.

    Rows of one doc_id and text get the same whichever batch they were in, so one batch's answers are enough.
    """

    def __init__(self, t: pa.Table):
        of = lambda name, f: [f(x) for x in t.column(name).to_pylist()] if t.num_rows else []
        whole = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
        docs, marks = whole(of("docs", unstepped), np.int64), whole(marks_ := of("marks", lambda x: np.frombuffer(x, np.uint64)), np.uint64)
        counts = whole(of("counts", lambda x: opened(x, np.uint32)), np.uint32).astype(np.int64)
        batches = whole(of("batches", unstepped), np.int64)
        self.codes = whole(of("codes", lambda x: opened(x, np.uint8)), np.uint8)
        part = np.repeat(t.column("part").to_numpy(), [len(x) for x in marks_]).astype(np.int64) if t.num_rows else np.zeros(0, np.int64)
        who, start = identity(docs, marks), np.cumsum(counts) - counts
        order = np.lexsort((part, batches, who))
        if len(order):
            head = np.r_[True, who[order][1:] != who[order][:-1]]
            of_one = batches[order] == batches[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
            order = order[of_one]
        self.who, self.part, self.count, self.start = who[order], part[order], counts[order], start[order]

    def apply(self, doc: np.ndarray, mark: np.ndarray, text: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The codes of the keys of some texts, in their order."""
        out = np.zeros(len(text), np.uint8)
        who = identity(doc, mark)
        lo = np.searchsorted(self.who, who, "left")
        n = np.searchsorted(self.who, who, "right") - lo
        if not len(text) or not n.sum():
            return out
        rows, owner = ranges(lo, n), np.repeat(np.arange(len(doc)), n)
        known, own = np.zeros(len(text), np.uint8), self.part[rows] < 0
        local, ends = rows[own], np.searchsorted(text, np.arange(len(doc)))
        known[ranges(ends[owner[own]], self.count[local])] = self.codes[ranges(self.start[local], self.count[local])]
        out[known == COVERED] = 1
        rows, owner, parts = rows[~own], owner[~own], 1 + max(int(part.max()), int(self.part.max()))
        asked = np.flatnonzero(known == ASK)
        at = text[asked] * parts + part[asked]
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], owner * parts + self.part[rows])
        out[asked[order[ranges(first, self.count[rows])]]] = self.codes[ranges(self.start[rows], self.count[rows])]
        return out


TEXTS = "bucket int, docs binary, marks binary, copies binary, sizes binary, texts binary"


def texts_by_bucket(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of TEXTS: the texts of a batch that fall to one bucket, end to end and compressed; equal rows once, with their number."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))

    def rows(batches):
        press = zstandard.ZstdCompressor(level=3)

        def packed(held):
            own, texts = np.concatenate([h[0] for h in held]), [t for h in held for t in h[1]]
            mark = np.array([mark_of(t) for t in texts], np.uint64)
            first: dict[tuple, int] = {}
            same = np.array([first.setdefault((d, t), i) for i, (d, t) in enumerate(zip(own.tolist(), texts))])
            copies = np.bincount(same, minlength=len(texts))
            bucket, out = bucket_of(own, mark, buckets), []
            for at in np.unique(bucket):
                rows = np.flatnonzero((bucket == at) & (copies > 0))
                mine = [texts[i] for i in rows]
                sizes = np.array([len(x) for x in mine], np.int64)
                out.append((int(at), own[rows].tobytes(), mark[rows].tobytes(), copies[rows].astype(np.int64).tobytes(), sizes.tobytes(), press.compress(b"".join(mine))))
            return table_of(out, TEXTS).to_batches()

        held, size = [], 0
        for b in batches:
            texts = [x or b"" for x in b.column(1).to_pylist()]
            held.append((b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), texts))
            size += sum(map(len, texts))
            if size >= MESSAGE_BYTES:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    return docs.select(ids.alias("doc"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, TEXTS)


def unpacked(t: pa.Table):
    """(doc ids, marks, copies, bytes, offsets) of consecutive texts of a bucket, about CHUNK bytes at a time."""
    open_ = zstandard.ZstdDecompressor()
    for i in range(t.num_rows):
        docs, marks, copies, sizes = (np.frombuffer(t.column(c)[i].as_py(), k) for c, k in (("docs", np.int64), ("marks", np.uint64), ("copies", np.int64), ("sizes", np.int64)))
        total = int(sizes.sum())
        data = np.frombuffer(open_.decompress(t.column("texts")[i].as_py(), max_output_size=max(1, total)) if total else b"", np.uint8)
        off, row = np.r_[0, np.cumsum(sizes)], 0
        while row < len(docs):
            end = min(len(docs), max(row + 1, int(np.searchsorted(off, off[row] + CHUNK, "right")) - 1))
            yield docs[row:end], marks[row:end], copies[row:end], data[off[row] : off[end]], off[row : end + 1] - off[row]
            row = end


def string_messages(texts: DataFrame, first: DataFrame, parts: int) -> DataFrame:
    """Round two's keys: the strings of undecided runs."""

    def rows(t: pa.Table, replied: pa.Table) -> pa.Table:
        answers, who, runs, strings, base, out = Answers(replied), [], [], [], 0, []
        if len(answers.who):
            for doc, mark, _, data, off in unpacked(t):
                r = Runs(data, off)
                codes = answers.apply(doc, mark, r.text, spread(r.anchor, parts))
                two = np.flatnonzero(codes == 2)
                size = r.last[two] + LENGTH - r.start[two]
                runs.append((r.text[two] + base, r.anchor[two], size, data[ranges(r.start[two], size)]))
                p, text = r.strings(np.flatnonzero(codes == 3))
                strings.append((text + base, r.prefix.of(p, p + LENGTH)))
                who.append((doc, mark))
                base += len(doc)
        if who:
            doc, mark = (np.concatenate(x) for x in zip(*who))
            asks, batch = firsts(doc, mark), int(t.column("bucket")[0].as_py())
            text, anchor, size, data = (np.concatenate(x) for x in zip(*runs))
            mine = asks[text]
            out += context_rows(doc, mark, text[mine], anchor[mine], size[mine], data[np.repeat(mine, size)], parts, batch)
            text, keys = (np.concatenate(x) for x in zip(*strings))
            mine = asks[text]
            out += message_rows(doc, mark, text[mine], keys[mine], None, parts, batch)
        return table_of(out, MESSAGE)

    return texts.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(rows, MESSAGE)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEPT = ", kept binary"


def removal(texts: DataFrame, both: DataFrame, parts: int, keep: bool) -> DataFrame:
    """``both``: replies of both rounds, told apart by ``round``."""

    def rows(t: pa.Table, replied: pa.Table) -> pa.Table:
        level = replied.column("round").to_numpy() if replied.num_rows else np.zeros(0)
        kind = replied.column("kind").to_numpy() if replied.num_rows else level
        one, two, three = (Answers(replied.filter(pa.array(x))) for x in (level == 1, (level == 2) & (kind == CONTEXTS), (level == 2) & (kind == KEYS)))
        out = []
        for doc, mark, copies, data, off in unpacked(t):
            r, n = Runs(data, off), len(doc)
            codes = one.apply(doc, mark, r.text, spread(r.anchor, parts))
            edge = np.zeros(len(data) + 1, np.int32)
            full = codes == 1
            np.add.at(edge, r.start[full], 1)
            np.add.at(edge, r.last[full] + LENGTH, -1)
            runs = np.flatnonzero(codes == 2)
            p, text = r.strings(runs)
            found = [p[two.apply(doc, mark, text, np.repeat(spread(r.anchor[runs], parts), r.last[runs] - r.start[runs] + 1)) == 1]]
            p, text = r.strings(np.flatnonzero(codes == 3))
            if len(p):
                found.append(p[three.apply(doc, mark, text, spread(r.prefix.of(p, p + LENGTH), parts)) == 1])
            for p in found:  # each string once
                np.add.at(edge, p, 1)
                np.add.at(edge, p + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            rising = gone.copy()
            rising[1:] &= ~gone[:-1]
            starts = off[1:-1][off[1:-1] < len(data)]
            rising[starts] = gone[starts]
            removed, spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(rising)]
            for i in range(n):
                a, b = off[i], off[i + 1]
                kept = data[a:b][~gone[a:b]].tobytes()
                out.append((int(doc[i]), int(b - a), int(removed[b] - removed[a]), int(spans[b] - spans[a]), hashlib.sha256(kept).hexdigest(), *([kept] * keep), int(copies[i])))
        return table_of(out, schema)

    schema = RESULT + KEPT * keep + ", copies long"
    out = texts.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(rows, schema)
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def remove_repeats(docs: DataFrame, keep: bool = False) -> DataFrame:
    """One row per input row: RESULT, with ``keep`` also the remaining bytes (column kept).

    * null text: as an empty one.  Texts under LENGTH bytes lose nothing.
    * null doc_id: before all other ids, and null in the result.
    * rows with one doc_id never lose anything to each other; repeated rows are repeated.
    * a very long text is one message and one text of a bucket; its arrays take some 40 bytes per byte.
    * doc_id is cast to long; one that isn't a number fails there in ANSI mode.
    * an empty table gives no rows; columns of ``docs`` other than doc_id and text are not looked at.
    """
    total = small_batches(docs).select(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = max(8, -(-total // (PART_MB << 20)))
    buckets = max(8, -(-total // (BUCKET_MB << 20)))
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    first = cut_and_free(replies(run_messages(docs.select(ids.alias("doc"), F.col("text").cast("binary").alias("text")), parts), buckets, runs=True))
    texts = texts_by_bucket(docs, buckets)
    # not cut: within one plan the texts' exchange serves both rounds
    second = replies(string_messages(texts, first, parts), buckets, runs=False)
    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    out = removal(texts, both, parts, keep)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(LOWEST), F.col("doc_id")))


def op7(spark, sf_dir):
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents"))
