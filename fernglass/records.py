"""Record collections: the one schema that queries, links, rules and writes work on.

A collection is a DataFrame with

    path string, types array<string>, body string, fields struct|variant, raw struct|variant,
    mtime timestamp, ctime timestamp, size bigint, revision string

``fields`` are the effective fields (defaults, computed fields), ``raw`` the
stored ones.  Over a table they are structs of its columns, which Catalyst
resolves to the columns themselves, so filters and pruning reach the scan.
Over Markdown they are VARIANTs, because every record may have other fields.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

from .functions.values import DYN, TIMESTAMP, Val, is_variant_null, value_of, variant_path

META = ("path", "types", "body", "fields", "raw", "mtime", "ctime", "size", "revision")


@dataclass(frozen=True)
class Records:
    df: DataFrame
    #: fields that hold links, the field that holds ids, and the extensions that links may leave out
    link_fields: tuple[str, ...] = ()
    id_field: str | None = None
    extensions: tuple[str, ...] = (".md",)
    #: records of other kinds that links may lead to (paths only)
    assets: DataFrame | None = None
    tag_field: str = "tags"
    #: date-time fields whose texts are timestamps in expressions
    instants: tuple[str, ...] = ()
    #: whether bodies may hold links and tags
    parse_body: bool = False

    def with_df(self, df: DataFrame) -> "Records":
        return replace(self, df=df)

    def type_of(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    @property
    def field_names(self) -> list[str]:
        t = self.type_of("fields")
        return t.names if isinstance(t, T.StructType) else []


def from_table(df: DataFrame, path: Column, *, types=(), fields: list[str] | None = None, body: Column | None = None, tags: Column | None = None, **options) -> Records:
    """Rows of a table as records; every column (or those named) is a field, a NULL cell a missing one."""
    cols = [F.col(c) for c in (fields if fields is not None else df.columns)]
    if tags is not None:
        cols.append(tags.alias("tags"))
    none = lambda kind: F.lit(None).cast(kind)
    whole = F.struct(*cols)
    out = df.select(
        path.cast("string").alias("path"), F.array(*[F.lit(t.lower()) for t in types]).cast("array<string>").alias("types"),
        (body if body is not None else F.lit("")).alias("body"), whole.alias("fields"), whole.alias("raw"),
        none("timestamp").alias("mtime"), none("timestamp").alias("ctime"), none("bigint").alias("size"), none("string").alias("revision"),
    )
    return Records(out, **options)


def once(col: Column) -> Column:
    """``col`` computed once per row, however often it is used; conditions on it stay above it.

    For values that are dear to make and used again and again, such as a parsed JSON text.
    """
    return F.when(F.rand(0) >= 0, col)  # not deterministic as far as the optimizer knows, so it is not copied into its uses


def numbered(df: DataFrame, name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in the order that it stands in; no task sees more than its own part of the rows.

    The parts are counted and each counts on from those before it, which a window over everything would do in one task.
    """
    return df.withColumn(name, InternalFunction.distributed_sequence_id() + 1)


def file_parts(path: Column) -> dict[str, Column]:
    """name, basename, ext and folder of a path; a leading dot doesn't start an extension."""
    name = F.substring_index(path, "/", -1)
    dotted = name.contains(".") & name.rlike(r"^.+\.[^.]*$")  # the pattern only where there is a dot
    return {
        "name": name,
        "basename": F.when(dotted, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name),
        "ext": F.when(dotted, F.substring_index(name, ".", -1)).otherwise(F.lit("")),
        "folder": F.when(path.contains("/"), F.left(path, F.char_length(path) - F.char_length(name) - 1)).otherwise(F.lit("")),
    }


def field_value(col: Column, t: T.DataType, name: str, origin: Column | None = None, instants=()) -> Val | None:
    """A bare name: the field of that name, null where the record lacks it; None if no record can have it."""
    if isinstance(t, T.StructType):
        kinds = {f.name: f.dataType for f in t.fields}
        got = value_of(col[name], kinds[name]) if name in kinds else None
    else:
        got = value_of(F.try_variant_get(col, variant_path(name), "variant"), T.VariantType())
    if got is not None and name in instants and got.kind in ("string", "dyn"):
        from .functions.cel import INSTANT
        from .functions.values import as_kind

        text = as_kind(got, "string")
        got = Val(TIMESTAMP, F.when(text.rlike(INSTANT), F.try_to_timestamp(text)))
    return got.at(origin) if got is not None else None


def map_value(col: Column, t: T.DataType, origin: Column | None = None) -> Val:
    """``raw`` and ``record``: selecting a key that isn't there is an error."""
    v = value_of(col, t) if isinstance(t, T.StructType) else Val(DYN, col)
    if v.members is not None:
        inner = v.members
        v.members = lambda n: inner(n).at(origin) if inner(n) is not None else None
    return v.at(origin)


def path_of_field(col: Column, t: T.DataType, ref: str) -> Val | None:
    """A dotted field reference: arrays aren't traversed, anything missing is null."""
    first, *rest = ref.split(".")
    got = field_value(col, t, first)
    for name in rest:
        if got is None:
            return None
        if got.kind == "dyn":
            inner = F.try_variant_get(got.col, variant_path(name), "variant")
            got = Val(DYN, F.when(~is_variant_null(inner), inner))
        elif got.kind == "map":
            got = Val(got.shape.item, F.try_element_at(got.col, F.lit(name)))
        elif got.members is not None:
            got = got.members(name)
        else:
            return None
    return got
