"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder.

    The folder is the cluster's ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and all runs on one machine, as in tests, a temporary folder."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="fernglass-")


#: Rows of an Arrow batch of texts; a batch is held several times over between the JVM and Python.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that passes texts to Python in batches of BATCH_ROWS, unless it has a size of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) == 10_000:  # Spark's default
        conf.set(key, str(BATCH_ROWS))
    return df


def cut_and_free(df: DataFrame) -> DataFrame:
    """``cut``, after which the shuffle files of ``df``'s plan are gone; else they stay until the driver happens to collect its garbage.

    For plans that are run this once and share no exchange with another.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return cut(df.select("*"))  # a new plan, which heeds the setting
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def give_back() -> None:
    """Return this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # no glibc
        pass


def lean(rows):
    """``rows`` of a mapInArrow, after which its worker holds no free memory: idle workers live on beside the next stages."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def lean_groups(table, least: int = 512):
    """The same for the function of an applyInArrow, after groups of at least ``least`` rows."""

    def run(key, t):
        try:
            return table(key, t)
        finally:
            if t.num_rows >= least:
                give_back()

    return run


def unskewed_join(big: DataFrame, small: DataFrame, key: str, n: str, spread_by: list[str], how: str = "inner", parts: int = 32) -> DataFrame:
    """``big`` joined with ``small`` on ``key``, where ``small`` has one row per key and in ``n`` how many rows of ``big`` have it.

    Keys of more than a thousandth of the rows, of which there are fewer than a
    thousand, are dealt over ``parts`` by ``spread_by``, and their rows of ``small`` repeated for each.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    hot = [r[key] for r in small.where(F.col(n) > max(1000, total / 1000)).select(key).collect()]
    if not hot:
        return big.join(small, key, how)
    salt = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*spread_by), F.lit(parts)).cast("int")).otherwise(0)
    salts = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return big.withColumn("__salt", salt).join(small.withColumn("__salt", F.explode(salts)), [key, "__salt"], how).drop("__salt")


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def text_partitions(docs: DataFrame, text: str = "text", mb: int = 16) -> int:
    """How many partitions hold ``mb`` MB of text each, but not fewer than the session's."""
    total = docs.select(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // (mb << 20)))


def hash_fraction(*cols):
    """A reproducible number in [0, 1) from the columns, the same in any engine with md5."""
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
