"""N-gram Jaccard self-join with size-banded tiles and bitmap signatures.

Every text's word shingles become a sorted array of distinct 64-bit hashes; a
class is a distinct set (copies are one class and never meet each other), told
apart by 128 bits and numbered thereafter.  A tile is a set of classes that share a key, in a band of sizes that can reach
the threshold:

* a set of at most ``SMALL * 4/3`` shingles has its shortest prefixes as keys
  (prefix filtering: two sets with J >= t share one of their n - ceil(t n) + 1
  least hashes), which finds every link between small sets;
* a set of more than ``SMALL`` shingles has ``BANDS`` keys of ``ROWS`` minima
  under random multipliers; a link at exactly t = 0.75 lacks a common key with
  probability (1 - 0.75**3)**40 < 4e-10.  With ``exact`` these sets have their
  prefixes as keys too (a quarter of their shingles each), and no link is lost.

Within a tile, bit counts of the hashed parity bitmaps bound the overlap from
above; what passes is decided by the exact intersection of the sorted arrays,
made anew from the texts.  First every class is compared with one leader of its
tiles, which links groups of near copies as stars.  Then every
component of a tile is compared with its nearest neighbour there by bit counts
(a step of Boruvka's), and at last all pairs of a tile whose classes still lie
in different components, in blocks.  Pairs within one component need no
comparison.  Components come from alternating stars over the links, so no group
is ever held in one place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, lean_groups, small_batches
from .components import components
from .textarrays import LOWERED, Prefix, chunks, mix, shingles, words

WORDS, PERCENT = 5, 75
SMALL, ROWS, BANDS, BLOCK = 80, 3, 40, 1024
#: Rounds of nearest neighbours, and up to how many documents' ids are broadcast (8 bytes each) to pick their texts.
NEAREST_ROUNDS, BROADCAST_IDS = 1, 1_000_000
_seeded = np.random.Generator(np.random.PCG64(7))
MULTIPLIERS = _seeded.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets(column: pa.Array):
    """(row, sorted distinct shingle hashes) of every text."""
    for row, data, off in chunks(column):
        starts, ends, first = words(data, off)
        h, at = shingles(Prefix(LOWERED[data]).of(starts, ends), first, WORDS)
        for i in range(len(off) - 1):
            yield row + i, np.unique(h[at[i] : at[i + 1]])


def keys(s: np.ndarray, exact: bool = False) -> np.ndarray:
    n, out = len(s), []
    if not n:
        return s
    if exact or not is_banded(n):
        out.append(mix(s[: n + (-n * PERCENT // 100) + 1] ^ np.uint64(0x51)))
    if n > SMALL and not exact:
        least = np.full(len(MULTIPLIERS), ~np.uint64(0))
        for at in range(0, n, 2048):
            np.minimum(least, (s[at : at + 2048, None] * MULTIPLIERS).min(0), out=least)
        bands = least.reshape(BANDS, ROWS)
        h = np.arange(BANDS, dtype=np.uint64)
        for j in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + bands[:, j])
        out.append(h)
    return np.concatenate(out)


def is_banded(n):
    """Whether a set of n shingles has nothing but bands as keys; one that isn't banded can't link with another below SMALL."""
    return n > SMALL * 100 // PERCENT + 1


def digest(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the hashes' last bits, in 64 to 65,536 bits, four for every hash if that is possible."""
    bits = 64
    while bits < 4 * len(s) and bits < 65_536:
        bits *= 2
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def fold(m: np.ndarray, size: int) -> np.ndarray:
    while m.shape[-1] > size:
        m = m[..., : m.shape[-1] // 2] ^ m[..., m.shape[-1] // 2 :]
    return m


def overlap_bound(na, a: np.ndarray, nb, b: np.ndarray):
    """The overlap is at most (na + nb - differing bits) / 2, and no more than the smaller set."""
    size = min(a.shape[-1], b.shape[-1])
    differ = np.bitwise_count(fold(a, size) ^ fold(b, size)).sum(-1, dtype=np.int64)
    return np.minimum((na + nb - differ) // 2, np.minimum(na, nb))


def may_link(na, a: np.ndarray, nb, b: np.ndarray):
    """Whether the bound still allows the threshold."""
    most = overlap_bound(na, a, nb, b)
    return 100 * most >= PERCENT * (na + nb - most)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def described(docs: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, mark, n, hi, lo, keys, sig) of every row; mark names the text, (hi, lo) the set; 0-length sets have null."""

    def rows(batches):
        for b in batches:
            n, name, ks, sig = [], [], [], []
            for _, s in sets(b.column(1)):
                n.append(len(s))
                name.append(digest(s) if len(s) else None)
                ks.append(keys(s, exact).tobytes() if len(s) else None)
                sig.append(bitmap(s) if len(s) else None)
            half = [pa.array([x and int.from_bytes(x[k : k + 8], "little", signed=True) for x in name], pa.int64()) for k in (0, 8)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64()), *half, pa.array(ks, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "mark", "n", "hi", "lo", "keys", "sig"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), F.xxhash64("text")).mapInArrow(lean(rows), "doc_id long, mark long, n long, hi long, lo long, keys binary, sig binary")


def tile_rows(classes: DataFrame) -> DataFrame:
    """(key, cls, m, leader) for the keys that more than one class has; of tiles with the same classes only one."""

    def rows(batches):
        for b in batches:
            ks = [np.frombuffer(k.as_py(), np.int64) for k in b.column(1)]
            counts = np.array([len(k) for k in ks])
            key = np.concatenate(ks) if ks else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(key), pa.array(np.repeat(b.column(0).to_numpy(), counts))], names=["key", "cls"])

    each = classes.select("cls", "keys").mapInArrow(lean(rows), "key long, cls long")
    marks = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"x{k}") for k in (1, 2)]  # 128 bits name the set
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("cls").alias("leader"), *marks).where("m > 1")
    once = shared.groupBy("m", "leader", "x1", "x2").agg(F.min("key").alias("key")).select("key", "m", "leader")
    return each.join(once, "key")


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the bit counts leave, with the documents that stand for them."""
    a = classes.select(F.col("cls").alias("a"), F.col("rep").alias("ra"), F.col("hi").alias("ha"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = classes.select(F.col("cls").alias("b"), F.col("rep").alias("rb"), F.col("hi").alias("hb"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = pairs.join(a, "a").join(b, "b").where((100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")))

    def rows(batches):
        for x in batches:
            na, nb = x.column("na").to_numpy(), x.column("nb").to_numpy()
            keep = [bool(may_link(na[i], np.frombuffer(x.column("sa")[i].as_py(), np.uint8), nb[i], np.frombuffer(x.column("sb")[i].as_py(), np.uint8))) for i in range(x.num_rows)]
            yield x.select(["a", "ra", "ha", "b", "rb", "hb"]).filter(pa.array(keep, pa.bool_()))

    return sized.select("a", "ra", "ha", "na", "sa", "b", "rb", "hb", "nb", "sb").mapInArrow(lean(rows), "a long, ra long, ha long, b long, rb long, hb long")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``bounded`` whose texts link."""
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("binary").alias("__text"))
    wanted = pairs.select(F.col("ra").alias("__w")).union(pairs.select("rb")).distinct()
    if wanted.count() <= BROADCAST_IDS:  # else all texts are shuffled
        texts = texts.join(F.broadcast(wanted), F.col("__id").eqNullSafe(F.col("__w")), "left_semi")
    half = pairs.join(texts.withColumnRenamed("__text", "ta"), F.col("ra").eqNullSafe(F.col("__id"))).drop("__id")
    full = half.join(texts.withColumnRenamed("__text", "tb"), F.col("rb").eqNullSafe(F.col("__id"))).drop("__id")

    def named(s: np.ndarray) -> int:
        return int.from_bytes(digest(s)[:8], "little", signed=True)

    def rows(batches):
        seen: dict[int, np.ndarray] = {}

        def fill(cls, names, text):  # a doc_id with several texts joins with each; only the class's own counts
            out = []
            fresh = [i for i, c in enumerate(cls) if c not in seen]
            made = {fresh[r]: s for r, s in sets(text.take(pa.array(fresh, pa.int64())))} if fresh else {}
            for i, c in enumerate(cls):
                s = made.get(i)
                if s is None:
                    s = seen.get(c)
                elif named(s) == names[i]:
                    seen[c] = s
                else:
                    s = None
                out.append(s)
            return out

        for b in batches:
            for at in range(0, b.num_rows, 256):
                x = b.slice(at, 256)
                ca, cb = x.column("a").to_pylist(), x.column("b").to_pylist()
                sa, sb = fill(ca, x.column("ha").to_pylist(), x.column("ta")), fill(cb, x.column("hb").to_pylist(), x.column("tb"))
                keep = [s is not None and t is not None and linked(s, t) for s, t in zip(sa, sb)]
                yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
                if sum(map(len, seen.values())) > 4_000_000:
                    seen.clear()

    return full.select("a", "ha", "ta", "b", "hb", "tb").mapInArrow(lean(rows), "a long, b long").distinct()


def cross_pairs(tiles: DataFrame, classes: DataFrame, roots: DataFrame, nearest: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of classes that share a tile, lie in different components and pass the bounds.

    ``nearest``: of each component only its nearest pair in the tile (in each pair of blocks).
    """
    known = roots.select(F.col("node").alias("cls"), "root")
    at = tiles.select("key", "cls").join(known, "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    mixed = at.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("m")).where("r0 <> r1")
    rows = at.join(mixed.select("key", "m"), "key").join(classes.select("cls", "n", "sig", "keys"), "cls")
    # a tile of m classes is cut into blocks; every pair of blocks is a task's work of bounded size
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    rows = rows.select("key", "cls", "root", "n", "sig", "keys", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))

    def compare(_, t: pa.Table) -> pa.Table:
        cls, root, n, own = (t.column(c).to_numpy() for c in ("cls", "root", "n", "own"))
        sig = [np.frombuffer(x, np.uint8) for x in t.column("sig").to_pylist()]
        order = np.argsort(n, kind="stable")
        cls, root, n, own, sig = cls[order], root[order], n[order], own[order], [sig[i] for i in order]
        p, q, key = (t.column(c)[0].as_py() for c in ("p", "q", "key"))
        known = [np.frombuffer(x, np.int64) for x in t.column("keys").to_pylist()]
        known = [known[i] for i in order]
        banded = np.array([len(k) == BANDS for k in known]) & is_banded(n)
        bands = np.stack([k if b else np.full(BANDS, -1) for k, b in zip(known, banded)])
        lengths = np.array([len(x) for x in sig])
        stacks = [(at, np.stack([sig[j] for j in at])) for size in np.unique(lengths) for at in [np.flatnonzero(lengths == size)]]
        out_a, out_b, best = [], [], {}
        for i in range(len(cls)):
            # the band of sizes that can reach the threshold, larger ones only; blocks p and q meet each other, p = q itself
            end = int(np.searchsorted(n, n[i] * 100 // PERCENT, "right"))
            for at, stack in stacks:
                lo, hi = np.searchsorted(at, [i + 1, end])
                js = at[lo:hi]
                fit = root[js] != root[i]
                if p != q:
                    fit &= own[js] != own[i]
                if not fit.any():
                    continue
                js, rows = js[fit], stack[lo:hi][fit]
                most = overlap_bound(n[i], sig[i], n[js], rows)
                both = n[i] + n[js]
                ok = 100 * most >= PERCENT * (both - most)
                js, far = js[ok], 1 - most[ok] / (both[ok] - most[ok])
                if nearest:
                    order = np.argsort(far, kind="stable")
                    ends = [(root[i], order[:1]), *((r, order[k : k + 1]) for r, k in zip(*np.unique(root[js][order], return_index=True)))]
                    for r, k in ends:
                        if len(k) and (r not in best or far[k[0]] < best[r][0]):
                            best[r] = (far[k[0]], int(cls[i]), int(cls[js[k[0]]]))
                else:
                    if banded[i]:  # a pair is emitted only in the tile of its least common key, which is never a left out tile
                        same = np.where(bands[js] == bands[i], bands[i], np.iinfo(np.int64).max).min(1)
                        js = js[~banded[js] | (same == key)]
                    out_a += [int(cls[i])] * len(js)
                    out_b += cls[js].tolist()
        if nearest:
            out_a, out_b = [x[1] for x in best.values()], [x[2] for x in best.values()]
        a, b = np.array(out_a, np.int64), np.array(out_b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("key", "p", "q").applyInArrow(lean_groups(compare), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, exact: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_id.

    ``exact`` finds candidates by prefixes for sets of all sizes; else large sets have bands (see above).

    * a text without words (or null) has an empty set: n_shingles 0, linked
      with nothing, component_id its own doc_id, class_id null.
    * copies have one class_id; repeated rows give repeated rows.
    * null doc_id: kept; it is the component_id only if no other id is there.
    * doc_id is cast to long; one that isn't a number fails there in ANSI mode.
    * a very long text is one set like others; its bitmap has at most 65,536 bits.
    * no rows give no rows; other columns of ``docs`` are not looked at.
    """
    rows = cut(described(docs, exact))
    found = class_components(rows, docs)
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "hi", "lo").join(found.select("cls", "component_id", F.col("hi").alias("h"), F.col("lo").alias("l")), (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("lo").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("cls").alias("class_id"))


def class_components(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(hi, lo, cls, component_id, root) of every class; root names the component, as several may have no id or the same.

    ``cls`` is the class's number, unique whatever its 128 bits; the checkpoint fixes it.
    """
    named = rows.where("lo is not null").groupBy("hi", "lo")
    classes = named.agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    tiles = cut(tile_rows(classes))
    stars = tiles.where("cls <> leader").groupBy("cls").agg(F.min("leader").alias("b")).select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b"))
    tested = links = roots = None
    for step in range(NEAREST_ROUNDS + 2):
        if step:
            pairs = cross_pairs(tiles, classes, roots, nearest=step <= NEAREST_ROUNDS).join(tested, ["a", "b"], "left_anti")
        else:
            pairs = stars
        pairs = cut(bounded(pairs, classes))
        if step and pairs.isEmpty():
            if step <= NEAREST_ROUNDS:
                continue
            break
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        more = cut(verified(pairs, docs))
        links = more if links is None else links.unionByName(more)
        if step == 0 or not more.isEmpty():
            roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.select("hi", "lo", "cls", "rep").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("hi", "lo", "cls", "rep", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return named.join(least, "root").select("hi", "lo", "cls", "component_id", "root")


def one_of_each(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``docs`` with one row of each component: the one with the least (doc_id, class, text hash), ids before null.

    Of rows that are equal in doc_id and text one stays.  Texts without words
    are linked with nothing and all stay.
    """
    rows = cut(described(docs, exact))
    found = class_components(rows, docs).select(F.col("hi").alias("__h"), F.col("lo").alias("__l"), "root")
    each = rows.where("lo is not null").groupBy("doc_id", "hi", "lo", "mark").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hi", "lo", "mark", "n")
    first = each.join(found, (F.col("hi") == F.col("__h")) & (F.col("lo") == F.col("__l"))).groupBy("root").agg(F.min(place).alias("f"))
    keep = first.select(F.col("f.doc_id").alias("__id"), F.col("f.mark").alias("__mark"), F.col("f.n").alias("__rows"))
    wordless = rows.where("lo is null").select("doc_id", "mark").distinct()
    keep = cut(keep.unionByName(wordless.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.lit(1).cast("long").alias("__rows"))))
    out = docs.withColumn("__own", F.xxhash64("text"))
    out = out.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark")))
    if not keep.where("__rows > 1").isEmpty():
        # only rows of a text that stands several times are compared, all others have a number of their own
        out = out.withColumn("__number", F.when(F.col("__rows") == 1, F.monotonically_increasing_id())).dropDuplicates(["__id", "__mark", "__number"])
    return out.select(*[out[c] for c in docs.columns])


def op2(spark, sf_dir):
    from .common import table

    return jaccard_components(table(spark, sf_dir, "documents"))
