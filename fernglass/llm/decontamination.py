"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: numbers, names (capitalised words
within a sentence) and units (after a number) are typed placeholders, other
words stand lower-cased for themselves.  Windows of ``K`` template tokens of
the documents are hash-joined with the benchmark items' windows, and the
matches of a document with an item are gathered by their offset.  The slots
under a matched stretch must be filled consistently: one value of the item
always meets the same value of the document.  So a re-parameterised question is
found like a literal one, and a chance meeting of placeholders is not.  Windows
are also joined word for word without regard to case, as a text in capitals
doesn't show its names and an item may have few words besides numbers, names
and units.  Template windows need LITERALS literal words; equal words are
evidence whatever their kind.

Before the join a document's windows meet a bit filter of the benchmark's, of
at most ``FILTER_BITS``, so few go further.  The filter is all that the driver
and the tasks hold of the benchmark: its windows stay a distributed table,
which the engine broadcasts only where its own measure of it is small.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, small_batches
from .textarrays import LOWERED, SHINGLE, Prefix, U, chunks, mix, words

K, LITERALS, NEEDED = 8, 4, 4
#: Bits of the filter for every window, and its largest size (32 MB).
BITS_PER_WINDOW, FILTER_BITS, PROBES = 64, 1 << 28, (0, 18, 36)
NUMBER, NAME, UNIT, LITERAL = 1, 2, 3, 0
#: Words taken for units where a number stands before them.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees mph kmh kph hz khz mhz ghz w kw kwh v j kj n pa kpa"
).split()
_byte = np.arange(256)
DIGIT = (_byte >= 48) & (_byte <= 57)
CAPITAL = (_byte >= 65) & (_byte <= 90)
INSIDE = DIGIT | CAPITAL | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
POINT = np.isin(_byte, [0x2C, 0x2E])
BREAK = np.isin(_byte, [0x0A, 0x21, 0x2E, 0x3A, 0x3B, 0x3F])
SLOT_CODE = np.array([0, 0xB5297A4D3C6EF372, 0x68E31DA4A54FF53A, 0x1B56C4E9510E527F], np.uint64)


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower-cased at the same byte positions; letters whose lower case has another length stay."""
    out = LOWERED[data]
    if len(data) and ((data >= 0xC4) & (data <= 0xF4)).any():
        encoded = [c.encode("utf-8", "surrogateescape") for c in data.tobytes().decode("utf-8", "surrogateescape")]
        low = [c.decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape") if len(c) > 1 else c for c in encoded]
        same = b"".join(b if len(b) == len(a) else a for a, b in zip(encoded, low))
        return LOWERED[np.frombuffer(same, np.uint8)]
    if len(data) > 1:  # A-grave to Thorn, without the multiplication sign
        out[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 0x20
    return out


class Tokens:
    """Template tokens of a chunk of texts: starts, ends, first (by text), kind, code."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        digit = DIGIT[data]
        inside = INSIDE[data]
        if len(data) > 2:  # 3.5 and 1,000 are one number
            inside[1:-1] |= POINT[data[1:-1]] & digit[:-2] & digit[2:]
        self.data = data
        self.starts, self.ends, self.first = words(data, off, inside)
        n = len(self.starts)
        self.kind = np.zeros(n, np.int8)
        if not n:
            self.code = self.plain = np.zeros(0, np.uint64)
            return
        self.low = lowered(data)
        self.plain = Prefix(self.low).of(self.starts, self.ends)
        head = data[self.starts]
        second = data[np.minimum(self.starts + 1, len(data) - 1)]
        ended = np.concatenate([[0], np.cumsum(BREAK[data])])
        opening = np.ones(n, bool)  # of a text or a sentence
        opening[1:] = ended[self.starts[1:]] > ended[self.ends[:-1]]
        firsts = self.first[:-1]
        opening[firsts[firsts < n]] = True
        self.kind[CAPITAL[head] & ~opening & ~(CAPITAL[second] & (self.ends - self.starts > 1))] = NAME
        self.kind[DIGIT[head]] = NUMBER
        after = np.zeros(n, bool)
        after[1:] = self.kind[:-1] == NUMBER
        after[firsts[firsts < n]] = False
        self.kind[after & np.isin(self.plain, UNIT_CODES) & (self.kind != NUMBER)] = UNIT
        self.code = np.where(self.kind == LITERAL, self.plain, SLOT_CODE[self.kind])

    def windows(self, k: int, plain: bool = False) -> np.ndarray:
        """A hash of the k tokens from every token that has as many (windows across texts are to be left out)."""
        code = self.plain if plain else self.code
        n = len(code) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.full(n, U(k))
        for j in range(k):
            h += code[j : j + n] * SHINGLE[j]
        return mix(h)

    def value(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()


def _tokens(text: str) -> Tokens:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return Tokens(data, np.array([0, len(data)]))


UNIT_CODES = np.zeros(0, np.uint64)
UNIT_CODES = np.sort(np.concatenate([_tokens(u).plain for u in UNITS]))


ITEMS = (
    "h long, k int, number long, item_id long, q int, total int, n_usable int, usable boolean, same boolean, "
    "slots array<struct<j:int,kind:int,value:binary>>"
)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """ITEMS: a row for every window of every item, word for word (same) and as a template where it is usable.

    Items of fewer than LITERALS tokens can't be told from ordinary text and have none.
    """
    kind = pa.list_(pa.struct([("j", pa.int32()), ("kind", pa.int32()), ("value", pa.binary())]))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), kind]
    names = [c.strip().split(" ")[0] for c in ITEMS.split(", ")]

    def rows(batches):
        for b in batches:
            out = []
            for i, text in enumerate(b.column(2).to_pylist()):
                t = _tokens(text or "")
                n = len(t.code)
                if n < LITERALS:
                    continue
                k = min(K, n)
                literal = np.concatenate([[0], np.cumsum(t.kind == LITERAL)])
                usable = literal[k:] - literal[: n - k + 1] >= LITERALS
                template, plain = t.windows(k).view(np.int64).tolist(), t.windows(k, plain=True).view(np.int64).tolist()
                slots = {int(j): {"kind": int(t.kind[j]), "value": t.value(j)} for j in np.flatnonzero(t.kind != LITERAL)}
                for q in range(n - k + 1):
                    own = [{"j": j - q, **slots[j]} for j in range(q, q + k) if j in slots]
                    rest = (k, b.column(0)[i].as_py(), b.column(1)[i].as_py(), q, n - k + 1, int(usable.sum()), bool(usable[q]))
                    out.append((plain[q], *rest, True, own))
                    if usable[q] and template[q] != plain[q]:
                        out.append((template[q], *rest, False, own))
            yield pa.record_batch([pa.array([r[j] for r in out], x) for j, x in enumerate(kinds)], names=names)

    numbered = benchmark.select(F.monotonically_increasing_id().alias("number"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string"))
    return cut(small_batches(numbered).mapInArrow(lean(rows), ITEMS))  # which fixes the numbers


class Filter:
    """Bits of a set of hashes: may say yes to others, never no to its own."""

    def __init__(self, bits: int):
        self.mask, self.bits = U(bits - 1), np.zeros(bits // 8, np.uint8)

    def places(self, h: np.ndarray, probe: int) -> np.ndarray:
        return (h >> U(probe)) & self.mask

    def has(self, h: np.ndarray) -> np.ndarray:
        at = np.arange(len(h))
        for probe in PROBES:  # most fall out at the first
            where = self.places(h[at], probe)
            at = at[(self.bits[(where >> U(3)).astype(np.int64)] >> (where & U(7)).astype(np.uint8)) & 1 > 0]
        return at


def window_filter(windows: DataFrame) -> tuple[Filter, list[int]]:
    """The filter of all windows' hashes, and the lengths that they have (K and less)."""
    count, ks = windows.agg(F.count(F.lit(1)), F.collect_set("k")).first()
    bits = 1 << 10
    while bits < min(FILTER_BITS, BITS_PER_WINDOW * count):
        bits *= 2
    out = Filter(bits)
    places = F.array(*[F.shiftrightunsigned("h", p).bitwiseAND(F.lit(bits - 1)) for p in PROBES])
    byte = windows.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 3).alias("byte"))
    set_ = byte.agg(F.bit_or(F.expr("shiftleft(1, CAST(at & 7 AS INT))")).alias("v")).toArrow()  # at most a row per byte of the filter
    out.bits[set_.column("byte").to_numpy()] = set_.column("v").to_numpy().astype(np.uint8)
    return out, sorted(ks)


def consistent(pairs: list[tuple[int, bytes, bytes]]) -> bool:
    """Whether nine of ten slot pairs (kind, item's value, document's value) agree with one renaming."""
    if not pairs:
        return True
    there, back = {}, {}
    good = sum(there.setdefault((k, a), b) == b and back.setdefault((k, b), a) == a for k, a, b in pairs)
    return good >= 0.9 * len(pairs)


FOUND = "row long, doc_id long, mark long, h long, p int, fillers array<binary>"


def candidates(docs: DataFrame, filter_: Filter, ks: list[int]) -> DataFrame:
    """FOUND: the windows of all documents that pass the filter, with the values in their slots where they are templates."""

    def rows(batches):
        for b in batches:
            at, hs, ps, fills = [], [], [], []
            for row, data, off in chunks(b.column(3)):
                t = Tokens(data, off)
                last = t.first[1:]
                for k in ks:
                    for plain in (False, True):
                        h = t.windows(k, plain)
                        p = filter_.has(h)
                        text = np.searchsorted(t.first, p, "right") - 1
                        inside = p + k <= last[text]
                        p, text = p[inside], text[inside]
                        at.append(row + text)
                        hs.append(h[p].view(np.int64))
                        ps.append(p - t.first[text])
                        fills += [[] if plain else [t.value(j) for j in range(i, i + k) if t.kind[j] != LITERAL] for i in p.tolist()]
            take = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64), pa.int64())
            own = [b.column(j).take(take) for j in range(3)]
            yield pa.record_batch([*own, pa.array(np.concatenate(hs) if hs else [], pa.int64()), pa.array(np.concatenate(ps) if ps else [], pa.int32()), pa.array(fills, pa.list_(pa.binary()))], names=["row", "doc_id", "mark", "h", "p", "fillers"])

    return small_batches(docs).mapInArrow(lean(rows), FOUND)


def verdict(hits: list[dict], total: int, n_usable: int) -> tuple | None:
    """(windows found, first token, slots, changed slots) if the hits of an item in a text are a leak."""
    offsets: dict[int, tuple[set, set, dict]] = defaultdict(lambda: (set(), set(), {}))
    for x in hits:
        alike, equal, slots = offsets[x["p"] - x["q"]]
        if x["usable"]:
            alike.add(x["q"])
        if x["same"]:
            equal.add(x["q"])
        own = {x["q"] + s["j"]: (s["kind"], s["value"], s["value"] if x["same"] else v) for s, v in zip(x["slots"], x["fillers"] or [None] * len(x["slots"]))}
        slots[(x["q"], x["same"])] = own
    found, template, literal, n_slots, changed, first = set(), set(), set(), 0, 0, None
    for offset, (alike, equal, slots) in offsets.items():

        def filled(qs, slots=slots):
            out = {}
            for (q, _), own in slots.items():
                if q in qs:
                    out.update(own)
            return [out[j] for j in sorted(out)]

        alike = alike if consistent(filled(alike)) else set()
        if qs := alike | equal:
            pairs = filled(qs)
            found |= qs
            template |= alike
            literal |= equal
            n_slots, changed = n_slots + len(pairs), changed + sum(a != b for _, a, b in pairs)
            first = offset + min(qs) if first is None else min(first, offset + min(qs))
    # enough template windows, or enough windows word for word
    if (template and len(template) >= min(n_usable, NEEDED)) or len(literal) >= min(total, NEEDED):
        return len(found), first, n_slots, changed
    return None


SCHEMA = "doc_id long, item_id long, n_windows long, item_windows long, first_token long, n_slots long, n_changed long"


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """SCHEMA and the mark (text hash) of every document and item it holds."""
    windows = item_windows(benchmark)
    if windows.isEmpty():
        return docs.sparkSession.createDataFrame([], SCHEMA + ", mark long")
    filter_, ks = window_filter(windows)
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    hits = candidates(own, filter_, ks).join(windows, "h")
    hit = F.struct("q", "p", "usable", "same", "slots", "fillers")
    # the hits of one document with one item, no more than the document has tokens
    met = hits.groupBy("row", "number", "doc_id", "mark", "item_id", "total", "n_usable").agg(F.collect_list(hit).alias("hits"))

    def rows(batches):
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")] + ["mark"]
        for b in batches:
            out = []
            for r in b.to_pylist():
                if got := verdict(r["hits"], r["total"], r["n_usable"]):
                    out.append((r["doc_id"], r["item_id"], got[0], r["total"], *got[1:], r["mark"]))
            yield pa.record_batch([pa.array([o[i] for o in out], pa.int64()) for i in range(len(names))], names=names)

    return met.mapInArrow(lean(rows), SCHEMA + ", mark long")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for every document and item it holds: SCHEMA.

    ``n_windows`` of the item's ``item_windows`` were found (at least NEEDED
    template windows or NEEDED word for word, or all where it has fewer of
    that kind), ``n_changed`` of ``n_slots`` slots hold another
    value than the item's.

    * null and empty texts hold nothing; null items and items with fewer than
      LITERALS tokens match nothing; an empty table, of either kind, gives no rows.
    * repeated rows give repeated rows, and so do repeated items; null ids stay null.
    * doc_id and item_id are cast to long; one that isn't a number fails there in ANSI mode.
    * a very long text is looked up whole; other columns are not looked at.
    """
    return _leaks(docs, benchmark).drop("mark")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item.

    Rows of one doc_id and text go or stay together.  The engine broadcasts the
    keys of the leaks where they are few, and shuffles otherwise.
    """
    gone = cut(_leaks(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__gone")).distinct())
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__gone")), "left_anti")


def op10(spark, sf_dir):
    from .common import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
