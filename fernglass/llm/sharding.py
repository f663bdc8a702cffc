"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id, number of the row), so equal
texts are neighbours and no two records share a key.  Size-weighted samples of
that key give quantile splitters for many fine ranges; a range that turns out
overfull is subdivided at further samples of its own until none is.  Exact sizes of the ranges and a running sum within each range give
every record its exact place in the global order of bytes, which fixes its
shard (``n`` equal parts of all bytes) and its slot.  A shard's end that falls
into a group of equal texts is moved to the group's nearer end, if the group
is at most ``group_share`` of a shard; only a larger group is divided.  The splitters, the ranges'
sums and the shards' first ranks are the only things the driver sees, and
their number is of the order of ``max_ranges``: only a range above twice the
even share gains splitters, and there are fewer than half as many of those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_fraction

LOWEST = -(1 << 63)
KEY = ("__k1", "__k2", "__k3")


def key_of(keyed: DataFrame) -> list[str]:
    return [c for c in KEY if c in keyed.columns]


def _any(conditions: list):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def place(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """For each key (its parts, the first decides first) the number of splitters that are not above it."""
    lo, hi = np.searchsorted(splitters[0], keys[0], "left"), np.searchsorted(splitters[0], keys[0], "right")
    if len(keys) == 1:
        return hi
    out = hi.copy()
    for at in np.unique(lo[hi > lo]):  # keys that share their first part with splitters: the others decide
        rows = np.flatnonzero((lo == at) & (hi > lo))
        out[rows] = at + place([k[rows] for k in keys[1:]], [s[at : hi[rows[0]]] for s in splitters[1:]])
    return out


def range_of(splitters: list[tuple], width: int):
    parts = [c.copy() for c in np.array(splitters, dtype=np.int64).reshape(-1, width).T]

    @F.pandas_udf("int")
    def f(key: pd.DataFrame) -> pd.Series:
        return pd.Series(place([key.iloc[:, i].to_numpy(np.int64) for i in range(width)], parts).astype(np.int32))

    return f


def weighted_samples(keyed: DataFrame, n: int) -> list[tuple]:
    """At most ``n`` keys, drawn without replacement with weights ``size``; the draw is a hash of the key."""
    key = key_of(keyed)
    u = (hash_fraction(*[F.col(c) for c in key]) * 4294967296.0 + 0.5) / 4294967296.0
    rows = keyed.select(*key, (-F.log(u) / F.col("size")).alias("__e")).orderBy("__e", *key).limit(n)
    return sorted({tuple(r[c] for c in key) for r in rows.collect()})


def quantiles(samples: list, parts: int) -> list:
    """Every sample has the same weight, as they were drawn by size."""
    picked = [samples[len(samples) * i // parts] for i in range(1, parts)] if samples else []
    return sorted(set(picked))


def split_ranges(keyed: DataFrame, rows_per_range: int, max_ranges: int, samples_per_range: int = 24):
    """(splitters, [(range, bytes, rows)]): sampled splitters, overfull ranges subdivided until none can be.

    The sums are those of the splitters returned.  Of several rows with one key (where ``keyed``
    has no ``__k3``) a range of its own is final.
    """
    key = key_of(keyed)
    n, total = keyed.agg(F.count(F.lit(1)), F.sum("size")).first()
    parts = max(32, min(max_ranges, -(-n // rows_per_range)))
    splitters = quantiles(weighted_samples(keyed, parts * samples_per_range), parts)
    while True:
        at = range_of(splitters, len(key))(F.struct(*key))
        low, high = F.min(F.struct(*key)), F.max(F.struct(*key))
        found = keyed.groupBy(at.alias("__range")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.max("size").alias("m"), (low < high).alias("divisible")).collect()
        # a range with one giant record can't be made smaller
        over = [r["__range"] for r in found if r["b"] > 2 * total / parts + r["m"] and r["divisible"]]
        if not over:
            break
        more = weighted_samples(keyed.where(at.isin(over)), samples_per_range * len(over))
        new = set(quantiles(more, 4 * len(over))) - set(splitters)
        # the least key of a range may be its splitter; others are among the samples, or all keys are the same few
        new = new or set(more) - set(splitters)
        splitters = sorted(set(splitters) | new)
    return splitters, sorted((r["__range"], r["b"], r["n"]) for r in found)


def shard(docs: DataFrame, shards: int = 16, rows_per_range: int = 4096, max_ranges: int = 4096, group_share: float = 0.05) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1.  Law ``bytes``: shards hold equal
    bytes up to one record, or to ``group_share`` where a group of equal texts
    stays whole; such a group is in one shard.

    * null text: size 1, crc 0, and first in the order; null doc_id: before other ids.
    * doc_id is cast to long; one that isn't a number fails there in ANSI mode.
    * a very long text is one record, and the shard that has it may be as much larger.
    * repeated rows are separate records; which of two equal rows is first doesn't show.
    * an empty table gives no rows; columns of ``docs`` other than doc_id and text are not looked at.
    """
    keyed = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(LOWEST)).otherwise(F.xxhash64("text")).alias("__k1"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("__k2"),
        F.monotonically_increasing_id().alias("__k3"),  # fixed by the checkpoint
    )
    keyed = cut(keyed)
    spark = docs.sparkSession
    splitters, ranges = split_ranges(keyed, rows_per_range, max_ranges)
    offsets, b0, n0 = [], 0, 0
    for r, b, n in ranges:
        offsets.append((r, b0, n0))
        b0, n0 = b0 + b, n0 + n
    before = spark.createDataFrame(offsets, "__r int, __b0 long, __n0 long")
    placed = keyed.withColumn("__range", range_of(splitters, len(KEY))(F.struct(*KEY)))
    w = Window.partitionBy("__range").orderBy(*KEY)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("__in", F.sum("size").over(run) - F.col("size")).withColumn("__rank", F.row_number().over(w) - 1)
    placed = placed.join(F.broadcast(before), placed["__range"] == before["__r"])  # max_ranges bounds it
    placed = placed.withColumn("__start", F.col("__b0") + F.col("__in")).withColumn("__rank", F.col("__n0") + F.col("__rank"))
    placed = cut(placed.select("doc_id", "size", "text_crc32", "__k1", "__start", "__rank"))

    def part(middle):
        return F.least(F.lit(shards - 1), F.floor(middle * F.lit(float(shards)) / F.lit(float(max(b0, 1)))).cast("int"))

    # at most one group lies across each of the shards' ends
    ends = [b0 * k // shards for k in range(1, shards)]
    across = _any([(F.col("__start") <= e) & (F.col("__start") + F.col("size") > e) for e in ends])
    split = [r["__k1"] for r in placed.where(across).select("__k1").distinct().collect()]
    groups = placed.where(F.col("__k1").isin(split)).groupBy("__k1").agg(F.sum("size").alias("b"), F.min("__start").alias("s"))
    whole = groups.where(F.col("b") <= group_share * b0 / shards).select("__k1", part(F.col("s") + F.col("b") / 2).alias("p")).collect()
    own = part(F.col("__start") + F.col("size") / 2)
    for r in whole:
        own = F.when(F.col("__k1") == r["__k1"], F.lit(r["p"])).otherwise(own)
    placed = placed.withColumn("shard", own.cast("int"))
    first = placed.groupBy(F.col("shard").alias("__s")).agg(F.min("__rank").alias("__first")).collect()
    firsts = spark.createDataFrame([tuple(r) for r in first], "__s int, __first long")
    out = placed.join(F.broadcast(firsts), placed["shard"] == firsts["__s"])  # a row per shard
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__rank") - F.col("__first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op9(spark, sf_dir):
    from .common import table

    return shard(table(spark, sf_dir, "documents"))
