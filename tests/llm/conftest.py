import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with an extra column of a clashing name."""

    def f(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        from pyspark.sql import functions as F

        return df.withColumn("size", F.lit("clash")).withColumn("score", F.lit(True)).withColumn("shard", F.lit(None).cast("string"))

    return f
