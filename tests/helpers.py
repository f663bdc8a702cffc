"""Small Markdown collections and records for tests."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from fernglass.records import Records
from fernglass.sources.markdown import Scan, read_markdown


def collection(spark, root: Path, files: dict[str, str], scan: Scan = Scan(), **options) -> Records:
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text, encoding="utf-8")
    return read_markdown(spark, str(root), scan, **options)


def variant_records(spark, rows: dict[str, dict], types: dict[str, list] | None = None, bodies: dict[str, str] | None = None, **options) -> Records:
    """Records with dynamic fields, as Markdown gives them."""
    data = [(p, (types or {}).get(p, []), (bodies or {}).get(p, ""), json.dumps(f)) for p, f in rows.items()]
    df = spark.createDataFrame(data, "path string, types array<string>, body string, j string")
    none = lambda k: F.lit(None).cast(k)
    df = df.select("path", "types", "body", F.parse_json("j").alias("fields"), F.parse_json("j").alias("raw"), none("timestamp").alias("mtime"), none("timestamp").alias("ctime"), none("bigint").alias("size"), none("string").alias("revision"))
    return Records(df, parse_body=True, **options)


def native(row_value):
    """VARIANT values as Python ones."""
    return row_value.toPython() if hasattr(row_value, "toPython") else row_value
