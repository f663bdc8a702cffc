"""Directories of Markdown records: scanning, frontmatter parsing, and writing back.

Only YAML needs Python (an Arrow batch at a time); everything else about a
record is a column.  Files are listed and read by Spark's binaryFile source,
so the root may be in any store that Spark reads.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.globs import glob_regex
from ..records import Records

PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("json", "body", "error_code", "error")])


class CoreLoader(yaml.SafeLoader):
    """YAML 1.2 core rules: true/false only, no dates, decimal integers, exponents without a dot."""


CoreLoader.yaml_implicit_resolvers = {}
for tag, pattern, first in (
    ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
    ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
    ("float", r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)", "-+0123456789."),
):
    CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(f"^(?:{pattern})$"), list(first))


def _int(loader, node) -> int:
    text = loader.construct_scalar(node)
    return int(text, 8) if text[:2] == "0o" else int(text, 16) if text[:2] == "0x" else int(text)


def _float(loader, node) -> float:
    text = loader.construct_scalar(node).lower()
    return float(text.replace(".inf", "inf").replace(".nan", "nan"))


CoreLoader.add_constructor("tag:yaml.org,2002:int", _int)
CoreLoader.add_constructor("tag:yaml.org,2002:float", _float)


def load_yaml(text: str):
    return yaml.load(text, Loader=CoreLoader)  # noqa: S506  a SafeLoader


def split_frontmatter(raw: str) -> tuple[str, str] | None:
    """(YAML, body), or None where the text has no frontmatter."""
    first, sep, rest = raw.partition("\n")
    if not raw.startswith("---") or not sep or first.strip() != "---":
        return None
    close = re.search(r"^---\s*?$", rest, re.M)
    if close is None:
        return None
    end = re.match(r"---\s*$", rest[close.start() :], re.M)
    body = rest[close.start() + end.end() :]
    return rest[: close.start()], body[1:] if body.startswith("\n") else body


def parse_record(data: bytes, whole_document: bool = False) -> tuple[str, str, str | None, str | None]:
    """(fields as JSON, body, error code, message); an error of code ``non_mapping`` leaves the record readable."""
    try:
        raw = data.decode("utf-8")
    except UnicodeDecodeError:
        return "{}", "", "invalid_frontmatter", "the file holds invalid UTF-8"
    if whole_document:
        source, body = raw.removeprefix("﻿"), ""
    else:
        parts = split_frontmatter(raw)
        if parts is None:
            return "{}", raw, None, None
        source, body = parts
    if not source.strip():
        return "{}", body, None, None
    try:
        got = load_yaml(source)
    except (yaml.YAMLError, ValueError) as e:
        return "{}", body, "invalid_frontmatter", f"frontmatter is not YAML: {str(e).splitlines()[0]}"
    if isinstance(got, dict):
        return json.dumps({str(k): v for k, v in got.items()}, ensure_ascii=False, default=str), body, None, None
    if got is None and source.strip() not in ("null", "~", "Null", "NULL"):
        return "{}", body, None, None
    return "{}", body, "non_mapping", "frontmatter must be a mapping"


@F.pandas_udf(PARSED)
def parse_files(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_record(c, p.endswith(".base")) for p, c in zip(path, content)], columns=PARSED.names)


@dataclass(frozen=True)
class Scan:
    extensions: tuple[str, ...] = ("md",)
    exclude: tuple[str, ...] = ()
    include_subfolders: bool = True
    types_folder: str = "_types"
    #: names of a collection's configuration file; a folder with one of its own is another collection
    config_names: tuple[str, ...] = ("collection.yaml", "collection.yml")
    #: off: unreadable frontmatter is empty; warn: kept in read_error; error: the record is left out
    validation_level: str = "warn"


def scan(spark: SparkSession, root: str, options: Scan = Scan(), all_files: bool = False) -> DataFrame:
    """(path, content, mtime, size, uri) of the files of a collection, relative to its root.

    Hidden names, excluded globs, the types folder, control files and nested
    collections (folders with a configuration of their own) are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(root)).toUri().getPath().rstrip("/")
    bare = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    rel = F.expr("substring(__bare, %d)" % (len(base) + 2))
    files = files.withColumn("__bare", F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))).withColumn("rel", rel)
    boundaries = files.where(F.substring_index("rel", "/", -1).isin(*options.config_names) & F.col("rel").contains("/")).select(F.regexp_replace("rel", "/[^/]*$", "").alias("b"))
    keep = ~F.col("rel").rlike(r"(^|/)\.|(^|/)node_modules(/|$)") & ~F.substring_index("rel", "/", -1).isin(*options.config_names)
    keep = keep & ~F.col("rel").startswith(options.types_folder + "/")
    for g in options.exclude:
        keep = keep & ~F.col("rel").rlike(glob_regex(g)) & ~F.col("rel").rlike(glob_regex(g.rstrip("/") + "/**"))
    if not options.include_subfolders:
        keep = keep & ~F.col("rel").contains("/")
    if not all_files:
        keep = keep & F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1)).isin([e.lstrip(".") for e in options.extensions])
    out = files.where(keep)
    # a file lies in a nested collection if one of its folders is a boundary: an equi-join on folders
    folders = out.select("rel", F.explode(F.expr("transform(sequence(1, greatest(size(split(rel, '/')) - 1, 1)), i -> array_join(slice(split(rel, '/'), 1, i), '/'))")).alias("f"))
    inside = folders.join(boundaries, F.col("f") == F.col("b"), "left_semi").select(F.col("rel").alias("__in")).distinct()
    out = out.join(inside, F.col("rel") == F.col("__in"), "left_anti")
    return out.select(F.col("rel").alias("path"), "content", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("path").alias("uri"))


def read_markdown(spark: SparkSession, root: str, options: Scan = Scan(), **record_options) -> Records:
    """The records of a directory; ``fields`` and ``raw`` are VARIANTs."""
    files = scan(spark, root, options)
    parsed = files.withColumn("p", parse_files("path", "content"))
    if options.validation_level == "error":
        parsed = parsed.where(F.col("p.error_code").isNull())
    else:
        parsed = parsed.where(F.coalesce(F.col("p.error_code") == "non_mapping", F.lit(True)) | F.col("p.error_code").isNull())
    fields = F.parse_json("p.json")
    df = parsed.select(
        "path", F.array().cast("array<string>").alias("types"), F.col("p.body").alias("body"), fields.alias("fields"), fields.alias("raw"),
        "mtime", F.col("mtime").alias("ctime"), "size", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("revision"),
    )
    assets = scan(spark, root, options, all_files=True).select("path").where(~F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lstrip(".") for e in options.extensions]))
    return Records(df, parse_body=True, extensions=tuple(f".{e.lstrip('.')}" for e in options.extensions), assets=assets, **record_options)


def read_errors(spark: SparkSession, root: str, options: Scan = Scan()) -> DataFrame:
    """(path, code, message) of files whose frontmatter can't be read or isn't a mapping."""
    parsed = scan(spark, root, options).withColumn("p", parse_files("path", "content"))
    return parsed.where("p.error_code is not null").select("path", F.lit("invalid_frontmatter").alias("code"), F.col("p.error").alias("message"))


# --- writing ---


class Dumper(yaml.SafeDumper):
    """Quotes texts that the core rules would read as something else."""


def _text(dumper, value: str):
    plain = isinstance(load_yaml(value) if value.strip() == value and value and "\n" not in value and ": " not in value and not value.startswith(tuple("[{&*!|>%@`'\"#-?:,")) else value, str)
    return dumper.represent_scalar("tag:yaml.org,2002:str", value, style=None if plain else '"' if "\n" not in value else "|")


Dumper.add_representer(str, _text)
Dumper.yaml_implicit_resolvers = CoreLoader.yaml_implicit_resolvers


def render_record(fields: dict, body: str, *, nulls: str = "explicit", empty_lists: bool = True) -> str:
    """Frontmatter and body as text; ``nulls='omit'`` leaves null fields out, ``empty_lists=False`` empty lists."""
    kept = {k: v for k, v in fields.items() if not (v is None and nulls == "omit") and not (v == [] and not empty_lists)}
    if not kept:
        return body
    return "---\n" + yaml.dump(kept, Dumper=Dumper, sort_keys=False, allow_unicode=True, default_flow_style=False, width=10_000) + "---\n" + body


def render(records: Records) -> DataFrame:
    """(path, text) of every record, rendered an Arrow batch at a time."""

    @F.pandas_udf("string")
    def text(fields: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([render_record(json.loads(f or "{}"), b or "") for f, b in zip(fields, body)])

    return records.df.select("path", text(F.to_json("raw"), "body").alias("text"))


def write_markdown(records: Records, root: str) -> int:
    """Writes every record under ``root`` from the executors: a hidden sibling first, then a rename.

    ``root`` must be a folder that driver and executors share.
    """

    def write(batches):
        import os

        for b in batches:
            for path, text in zip(b["path"], b["text"]):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                temp = os.path.join(os.path.dirname(target), f".{os.path.basename(target)}.{os.getpid()}.tmp")
                with open(temp, "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(temp, target)
            yield pd.DataFrame({"n": [len(b)]})

    return render(records).mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
