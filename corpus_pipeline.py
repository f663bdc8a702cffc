"""A training corpus from the documents table, in five stages.

``run(spark, sf_dir)`` applies them in order; each stage's rows are written as
Parquet in the shared folder and read again, so a lost executor costs one
stage's tasks and no more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fernglass.llm import decontamination, mixing, ngram_join, sharding, toxicity
from fernglass.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that the toxicity model rejects.

    It learns from those labelled rows that are in ``docs``; without any toxic or ordinary one all rows stay.
    Null and empty texts are scored as blank; rows with equal texts stay or go together; no rows give no rows.
    """
    return toxicity.predict(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), keep=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the least doc_id, ids before null.

    Rows without words (null and empty texts among them) are linked with nothing and stay, equal ones once;
    no rows give no rows.
    """
    return ngram_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, literal or re-parameterised.

    Null and empty texts hold none and stay; rows equal in doc_id and text stay or go together; an empty benchmark takes nothing.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of ``docs`` as often as its source's repetition rate and its draw say, 0 to 3 times.

    Null sources are one source; null and empty texts have size 0 and are drawn like others; no rows give no rows.
    """
    return mixing.emit(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row of ``docs`` with its shard and slot, not its text.

    Repeated rows are separate records; null texts have size 1; no rows give no rows.
    """
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]

#: The first stage's trained model can't be expressed in SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, as written; a stage's folder goes once the next one's is complete."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        here = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            _remove(spark, before)
        before = here
    return docs
