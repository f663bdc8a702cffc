"""Changes between two snapshots of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..records import Records


def content(records: Records) -> Column:
    """A digest of fields and body."""
    return F.sha2(F.concat_ws("\u0000", F.to_json("raw"), F.coalesce("body", F.lit(""))), 256)


def snapshot_diff(old: Records, new: Records) -> DataFrame:
    """(event, path, old_path): file_created, file_modified, file_deleted, file_renamed, type_changed.

    A deleted and a created record of equal content, when each is the only one
    of it, are one renamed record.
    """
    shown = lambda r, p: r.df.select(F.col("path").alias(f"{p}path"), content(r).alias(f"{p}digest"), F.array_sort("types").alias(f"{p}types"))
    both = shown(old, "o").join(shown(new, "n"), F.col("opath") == F.col("npath"), "full")
    gone = both.where("npath is null").select("opath", F.col("odigest").alias("d1"))
    come = both.where("opath is null").select("npath", F.col("ndigest").alias("d2"))
    one = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(df.columns[0]).alias(df.columns[0])).where("n = 1").drop("n")
    moved = one(gone, "d1").join(one(come, "d2"), F.col("d1") == F.col("d2")).select(F.lit("file_renamed").alias("event"), F.col("npath").alias("path"), F.col("opath").alias("old_path"))
    event = F.when(F.col("npath").isNull(), "file_deleted").when(F.col("opath").isNull(), "file_created").when(F.col("odigest") != F.col("ndigest"), "file_modified")
    plain = both.select(event.alias("event"), F.coalesce("npath", "opath").alias("path"), F.lit(None).cast("string").alias("old_path")).where("event is not null")
    ends = moved.select(F.explode(F.array("path", "old_path")).alias("__m"))
    plain = plain.join(ends, (F.col("path") == F.col("__m")) & (F.col("event") != "file_modified"), "left_anti")
    retyped = both.where(F.col("opath").isNotNull() & F.col("npath").isNotNull() & ~F.col("otypes").eqNullSafe(F.col("ntypes"))).select(F.lit("type_changed").alias("event"), F.col("npath").alias("path"), F.lit(None).cast("string").alias("old_path"))
    return plain.unionByName(moved).unionByName(retyped)
