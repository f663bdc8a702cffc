"""A versioned store of parsed records: Parquet folders and a pointer to the present one.

A version is written whole and becomes present by one rename of the pointer,
so a failed batch leaves the collection as it was.  ``refresh`` parses only
files whose time or size has changed since the present version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..records import META, Records
from .markdown import Scan, parse_files, scan


class Conflict(ValueError):
    """The store has moved on since the version that a write was based on."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """0 while nothing is stored."""
        at = self._path(f"{self.folder}/present")
        if not self._fs.exists(at):
            return 0
        return max(int(s.getPath().getName()) for s in self._fs.listStatus(at))

    def read(self, version: int | None = None, **options) -> Records:
        df = self.spark.read.parquet(f"{self.folder}/v{version if version is not None else self.version()}")
        return Records(df, **options)

    def label(self, version: int | None = None) -> str | None:
        """What a version was stored under."""
        at = self._path(f"{self.folder}/v{version if version is not None else self.version()}/_label")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def commit(self, records: Records | DataFrame, based_on: int | None = None, label: str | None = None) -> int:
        """Stores the next version; with ``based_on`` only if that is still the present one.  ``label`` becomes present with it."""
        df = records.df if isinstance(records, Records) else records
        now = self.version()
        if based_on is not None and based_on != now:
            raise Conflict(f"version {based_on} is no longer present, {now} is")
        df.select(*META).write.mode("overwrite").parquet(f"{self.folder}/v{now + 1}")  # over what a failed write may have left
        if label is not None:
            stream = self._fs.create(self._path(f"{self.folder}/v{now + 1}/_label"), True)
            stream.writeUTF(label)
            stream.close()
        self._fs.mkdirs(self._path(f"{self.folder}/present"))
        if not self._fs.createNewFile(self._path(f"{self.folder}/present/{now + 1}")):
            raise Conflict(f"version {now + 1} was stored by another writer")
        return now + 1

    def clear(self) -> None:
        self._fs.delete(self._path(self.folder), True)

    def refresh(self, root: str, options: Scan = Scan()) -> DataFrame:
        """The records of ``root``: rows of the present version where time and size agree, newly parsed ones elsewhere."""
        files = scan(self.spark, root, options)
        if not self.version():
            return _parsed(files)
        old = self.read().df
        key = [F.col("path").alias("__p"), F.col("mtime").alias("__m"), F.col("size").alias("__s")]
        same = files.select(*key)
        on = (F.col("path") == F.col("__p")) & (F.col("mtime") == F.col("__m")) & (F.col("size") == F.col("__s"))
        hits = old.join(same, on, "left_semi")
        fresh = files.join(old.select(*key), on, "left_anti")
        return hits.select(*META).unionByName(_parsed(fresh))


def _parsed(files: DataFrame) -> DataFrame:
    p = files.withColumn("p", parse_files("path", "content")).where("p.error_code is null or p.error_code = 'non_mapping'")
    fields = F.parse_json("p.json")
    return p.select("path", F.array().cast("array<string>").alias("types"), F.col("p.body").alias("body"), fields.alias("fields"), fields.alias("raw"), "mtime", F.col("mtime").alias("ctime"), "size", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("revision"))
