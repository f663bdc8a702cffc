"""Writes as new versions of a collection: each operator takes a snapshot's rows and gives the next snapshot's.

Nothing is changed in place.  A batch is one plan over the old snapshot; the
store (``fernglass.sources.snapshot``) swaps versions when all of it succeeds.
"""

from __future__ import annotations

import json
import re
import unicodedata
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cel import Scope, compile_expression
from ..functions.values import STRING, Val, as_kind, value_of
from ..records import Records, field_value, map_value, path_of_field
from .links import backlinks, link_texts, parse_link, resolve
from .structured_where import structured_where


class WriteError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def slugify(text: Column) -> Column:
    """Accents stripped, everything but letters and digits a hyphen, none at the ends; NULL for NULL."""
    return F.regexp_replace(F.regexp_replace(F.lower(_folded(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


def condition(records: Records, where: str | dict | None) -> Column:
    """A batch's condition: an expression or a structured condition; true for none."""
    if where is None:
        return F.lit(True)
    t = records.type_of("fields")
    if isinstance(where, dict):
        return structured_where(where, lambda ref: path_of_field(F.col("fields"), t, ref))
    names = lambda n: Val(STRING, F.col("path")) if n == "path" else map_value(F.col("fields"), t) if n in ("record", "raw") else field_value(F.col("fields"), t, n)
    return F.coalesce(as_kind(compile_expression(where, Scope(names=names)), "bool"), F.lit(False))


def _set(records: Records, changes: dict[str, Column | object], where: Column) -> DataFrame:
    """Rows with some fields set (a Column or a constant) where the condition holds."""
    t, cols = records.type_of("fields"), []
    as_col = lambda x, kind=None: x if isinstance(x, Column) else F.lit(x).cast(kind) if kind is not None else F.lit(x)
    if isinstance(t, T.StructType):
        for f in t.fields:
            old = F.col("fields")[f.name]
            cols.append((F.when(where, as_col(changes[f.name], f.dataType).cast(f.dataType)).otherwise(old) if f.name in changes else old).alias(f.name))
        cols += [F.when(where, as_col(v)).alias(k) for k, v in changes.items() if k not in t.names]
        new = F.struct(*cols)
    else:
        given = F.try_variant_get("fields", "$", "map<string,variant>")
        fresh = F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), v.cast("variant") if isinstance(v, Column) else F.parse_json(F.lit(json.dumps(v))))])
        merged = F.map_concat(F.map_filter(given, lambda k, _: ~k.isin(list(changes))), fresh)
        new = F.when(where, F.to_variant_object(merged)).otherwise(F.col("fields"))
    return records.df.withColumn("fields", new).withColumn("raw", F.col("fields"))


def batch_update(records: Records, fields: dict, where: str | dict | None = None) -> Records:
    """Sets fields of all matching records; all right-hand sides see the old values."""
    return records.with_df(_set(records, fields, condition(records, where)))


def batch_delete(records: Records, where: str | dict | None = None, paths: list[str] | None = None) -> Records:
    gone = condition(records, where) if paths is None else F.col("path").isin(paths)
    return records.with_df(records.df.where(~gone))


def broken_by_delete(records: Records, deleted: DataFrame) -> DataFrame:
    """(path, source): links of remaining records that lead to deleted ones."""
    links = backlinks(records).select("path", F.explode("backlinks").alias("source"))
    left = deleted.select(F.col("path").alias("__d"))
    hit = links.join(left, F.col("path") == F.col("__d"), "left_semi").withColumn("__src", F.regexp_extract("source", r"^\[\[(.*)\]\]$", 1))
    return hit.join(left, F.col("__src") == F.col("__d"), "left_anti").select("path", "source")


def apply_updates(records: Records, updates: DataFrame) -> Records:
    """Per-path changes: ``updates`` has path and columns named like fields; NULL leaves a field as it is."""
    names = [c for c in updates.columns if c != "path"]
    u = updates.select(F.col("path").alias("__u"), *[F.col(c).alias(f"__new_{c}") for c in names])
    df = records.df.join(u, F.col("path") == F.col("__u"), "left")
    joined = records.with_df(df)
    t = records.type_of("fields")
    if not isinstance(t, T.StructType):
        changed = _set(joined, {c: F.coalesce(F.col(f"__new_{c}").cast("variant"), F.try_variant_get("fields", f"$['{c}']", "variant")) for c in names}, F.col("__u").isNotNull())
    else:
        changed = _set(joined, {c: F.coalesce(F.col(f"__new_{c}"), F.col("fields")[c]) if c in t.names else F.col(f"__new_{c}") for c in names}, F.col("__u").isNotNull())
    return records.with_df(changed.drop("__u", *[f"__new_{c}" for c in names]))


def create(records: Records, new: DataFrame) -> Records:
    """Appends rows of the record schema; a path that is there already is an error."""
    if not new.join(records.df.select("path"), "path", "left_semi").isEmpty():
        raise WriteError("path_conflict", "a record of that path exists")
    return records.with_df(records.df.unionByName(new))


def delete(records: Records, path: str) -> tuple[Records, DataFrame]:
    """(the next snapshot, broken backlinks)."""
    gone = records.df.where(F.col("path") == path)
    if gone.isEmpty():
        raise WriteError("file_not_found", f"{path!r} is not a record")
    return batch_delete(records, paths=[path]), broken_by_delete(records, gone)


def rename(records: Records, old: str, new: str) -> Records:
    """Moves a record and rewrites the links in other records' bodies that lead to it; style, alias and anchor stay."""
    if re.search(r"(^|/)\.\.(/|$)", new) or new.startswith("/"):
        raise WriteError("path_traversal", "the new path leads outside")
    found = {r["path"] for r in records.df.where(F.col("path").isin(old, new)).select("path").collect()}
    if old not in found:
        raise WriteError("file_not_found", f"{old!r} is not a record")
    if new in found:
        raise WriteError("path_conflict", f"{new!r} exists")
    stem = lambda p: re.sub(r"\.[^./]*$", "", p)
    base = lambda p: stem(p).rsplit("/", 1)[-1]
    texts = resolve(link_texts(records), F.col("link"), F.col("src"), records, "r").where(F.col("r.path") == old).select("src", "link").distinct()
    p = parse_link(F.col("link"))
    path_style = p["target"].contains("/") | (p["format"] == "markdown")
    keeps_ext = p["target"].endswith("." + old.rsplit(".", 1)[-1])
    folder = F.when(F.col("src").contains("/"), F.regexp_replace("src", "/[^/]*$", "")).otherwise("")
    ups = F.when(folder == "", F.lit("")).otherwise(F.repeat(F.lit("../"), F.size(F.split(folder, "/"))))
    full = F.when(keeps_ext, F.lit(new)).otherwise(F.lit(stem(new)))
    relative = p["is_relative"] | ((p["format"] == "markdown") & ~p["target"].startswith("/"))
    target = F.when(relative, F.concat(F.when(ups == "", "./").otherwise(ups), full)).when(p["target"].startswith("/"), F.concat(F.lit("/"), full)).when(path_style, full).otherwise(F.lit(base(new)))
    inner = F.when(p["format"] == "markdown", F.concat(F.when(p["is_embed"], "!").otherwise(""), F.lit("["), F.coalesce(p["alias"], F.lit("")), F.lit("]("), target, F.coalesce(F.concat(F.lit("#"), p["anchor"]), F.lit("")), F.lit(")")))
    wiki = F.concat(F.when(p["is_embed"], "!").otherwise(""), F.lit("[["), target, F.coalesce(F.concat(F.lit("#"), p["anchor"]), F.lit("")), F.coalesce(F.concat(F.lit("|"), p["alias"]), F.lit("")), F.lit("]]"))
    fixed = texts.withColumn("fresh", inner.when(p["format"] == "path", target).otherwise(wiki))
    per = fixed.groupBy(F.col("src").alias("__s")).agg(F.map_from_entries(F.collect_list(F.struct("link", "fresh"))).alias("__fix"))
    df = records.df.join(per, F.col("path") == F.col("__s"), "left")
    swap = lambda col: F.when(F.col("__fix").isNotNull(), F.aggregate(F.map_entries("__fix"), col, lambda acc, e: F.replace(acc, e["key"], e["value"]))).otherwise(col)
    df = df.withColumn("body", swap(F.col("body")))
    t = records.type_of("fields")
    if isinstance(t, T.StructType):
        text = [f.name for f in t.fields if isinstance(f.dataType, T.StringType)]
        df = df.withColumn("fields", F.struct(*[(swap(F.col("fields")[n]) if n in text else F.col("fields")[n]).alias(n) for n in t.names]))
    else:
        as_json = F.to_json("fields")
        df = df.withColumn("fields", F.when(F.col("__fix").isNotNull(), F.parse_json(swap(as_json))).otherwise(F.col("fields")))
    df = df.withColumn("raw", F.col("fields")).withColumn("path", F.when(F.col("path") == old, new).otherwise(F.col("path")))
    return records.with_df(df.drop("__s", "__fix"))


def provider(spec, records: Records, instant: datetime) -> Column:
    """A generated value: now, today, uuid, ulid, slugify, copy, literal."""
    t = records.type_of("fields")
    if not isinstance(spec, dict):
        return F.lit(spec)
    stamp = instant.astimezone(timezone.utc)
    if spec.get("now"):
        return F.lit(stamp.strftime("%Y-%m-%dT%H:%M:%S.") + f"{stamp.microsecond // 1000:03d}Z")
    if spec.get("today"):
        return F.lit(stamp.date().isoformat())
    if spec.get("uuid"):
        return F.uuid()
    if spec.get("ulid"):
        return F.concat(F.upper(F.lpad(F.conv(F.lit(int(stamp.timestamp() * 1000)).cast("string"), 10, 32), 10, "0")), F.upper(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)))
    for key in ("slugify", "copy"):
        if key in spec:
            v = path_of_field(F.col("fields"), t, spec[key])
            if v is None:
                return F.lit(None).cast("string")
            return slugify(as_kind(v, "string")) if key == "slugify" else v.col
    return F.lit(spec.get("literal"))


def lifecycle(records: Records, actions: list[dict], instant: datetime | None = None) -> Records:
    """Guarded assignments ``{if?: expr, set: {field: provider}}``, in order; each sees the values before it."""
    instant = instant or datetime.now(timezone.utc)
    for a in actions:
        where = condition(records, a.get("if"))
        changes = {k: provider(v, records, instant) for k, v in a.get("set", {}).items()}
        records = records.with_df(_set(records, changes, where))
    return records


def backfill(records: Records, defaults: dict | None = None, sequence: str | None = None, where: str | dict | None = None) -> Records:
    """Fills fields that records lack: constants, and a running number after the present maximum, in path order.

    The numbers come from a range-sorted index of the rows that lack one: rows
    are numbered within partitions and shifted by the partitions' counts, so
    no single task holds them all.
    """
    chosen, t = condition(records, where), records.type_of("fields")
    for name, value in (defaults or {}).items():
        v = path_of_field(F.col("fields"), t, name)
        missing = F.lit(True) if v is None else v.col.isNull() if isinstance(t, T.StructType) else F.try_variant_get("fields", f"$['{name}']", "variant").isNull()
        records = records.with_df(_set(records, {name: value}, chosen & missing))
    if sequence is None:
        return records
    v = path_of_field(F.col("fields"), records.type_of("fields"), sequence)
    number = as_kind(v, "int") if v is not None else F.lit(None).cast("bigint")
    lacking = records.df.where(condition(records, where) & number.isNull()).select("path")
    numbered = global_index(lacking, "path", "__n")
    top = records.df.agg(F.coalesce(F.max(number), F.lit(0)).alias("__top"))
    numbered = numbered.crossJoin(F.broadcast(top)).select(F.col("path").alias("__s"), (F.col("__top") + F.col("__n")).alias("__seq"))
    df = records.df.join(numbered, F.col("path") == F.col("__s"), "left")
    filled = _set(records.with_df(df), {sequence: F.coalesce(F.col("__seq"), number)}, F.col("__seq").isNotNull())
    return records.with_df(filled.drop("__s", "__seq"))


def global_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with their place (from 1) in the order of ``key``; a running count within range partitions plus their offsets."""
    from pyspark.sql import Window

    ranged = df.repartitionByRange(F.col(key)).withColumn("__pid", F.spark_partition_id())
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))  # a row per partition
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.partitionBy(F.lit(0)).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = ranged.withColumn("__rn", F.row_number().over(Window.partitionBy("__pid").orderBy(key)))
    joined = within.join(F.broadcast(before.select(F.col("__pid").alias("__p"), "__before")), F.col("__pid") == F.col("__p"))
    return joined.withColumn(name, F.col("__before") + F.col("__rn")).drop("__pid", "__p", "__before", "__rn")


__all__ = ["WriteError", "apply_updates", "backfill", "batch_delete", "batch_update", "create", "delete", "lifecycle", "rename", "slugify", "value_of"]
