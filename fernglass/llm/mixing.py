"""Mixing sources to target weights, with DataFrame functions only.

Words per source are aggregated first.  Every source has a share of the wanted
total by its weight; a share ends at ``max_rate`` times the source's size, and
what is above flows to the others by weight (water filling, in closed form over
the sources sorted by capacity per weight).  The repetition rate of a source is
its target over its size.  A document is emitted floor(rate) times plus one
more copy with a probability equal to the fraction.

The extra copy's draw is hash-seeded and stratified: within a stratum (at most
some hundred documents of one source, dealt by a hash of their ids) documents
stand by size, and document k gets ``floor(h + k r) - floor(h + (k - 1) r)``
copies, where h is the stratum's hash in [0, 1).  Over h that is Bernoulli with
probability frac(r) for every document, but the sum stays near the target even
in small sources.  A stratum is bounded, so a hot source is many strata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hash_fraction

WEIGHTS = (3, 1, 2)
STRATUM = 256


def source_targets(sized: DataFrame, weights=WEIGHTS, total_share: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, n_docs, weight, target.

    ``sized`` has source and size.  Sources stand by code point, null last, and
    take the weights in turn.  The table has a row per source and is worked on
    in one task, which spills; documents never meet there.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn.cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_rate)))
    whole = Window.partitionBy(F.lit(0))
    fill = whole.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(whole) * F.lit(float(total_share))
    left = wanted - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    open_weight = F.sum("weight").over(rest)
    per = per.withColumn("level", left / open_weight).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # after the last full source, all others share what is left at one level
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return per.withColumn("target", share).select("source", "source_size", "n_docs", "weight", "target")


def draw_copies(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds source_size, target, rate and copies to rows of (doc_id, source, size, ..)."""
    t = targets.select(F.col("source").alias("__s"), "source_size", "target", "n_docs")
    # planned as a shuffle join; the engine broadcasts ``t`` only if its measured size is small,
    # and splits a hot source otherwise
    rows = sized.join(t, sized["source"].eqNullSafe(t["__s"]))
    strata = F.ceil(F.col("n_docs") / F.lit(STRATUM))
    draw = hash_fraction(F.col("doc_id"))
    rows = rows.withColumn("__draw", draw).withColumn("__stratum", F.floor(F.col("__draw") * strata))
    rows = rows.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    w = Window.partitionBy("source", "__stratum").orderBy(F.col("size").desc(), "__draw", "doc_id")
    k = F.row_number().over(w)
    h = hash_fraction(F.col("source"), F.col("__stratum"))
    copies = F.floor(h + k * F.col("rate")) - F.floor(h + (k - 1) * F.col("rate"))
    return rows.withColumn("copies", copies.cast("long")).select(*sized.columns, "source_size", "target", "rate", "copies")


def sizes(docs: DataFrame, *more) -> DataFrame:
    """(doc_id, source, size, *more): words of the whole text, 0 for null."""
    n = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id"), F.col("source"), n.alias("size"), *more)


def mix(docs: DataFrame, weights=WEIGHTS, total_share: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, rate, copies.

    * null text or no word: size 0; such documents are drawn like others.
    * null source: a source of its own, last in the order.
    * a source without words has target 0 and rate 0.
    * rows repeated in the input are separate documents; an empty table gives no rows.
    * other columns of ``docs`` are not looked at.
    """
    sized = cut(sizes(docs))  # small rows; the text is scanned once
    return draw_copies(sized, source_targets(sized, weights, total_share, max_rate))


def emit(docs: DataFrame, weights=WEIGHTS, total_share: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it was drawn, in its own columns.

    Rows are told apart by doc_id, source and text.  Of rows that are equal in
    all three, each gets the floor or the ceiling of their mean, and together
    they get what they were drawn; they meet in one task, which spills.
    """
    mark = F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), "text", F.col("text").isNull())
    sized = cut(sizes(docs, mark.alias("__mark")))
    drawn = draw_copies(sized, source_targets(sized, weights, total_share, max_rate))
    drawn = drawn.groupBy("__mark").agg(F.sum("copies").alias("__n"), F.count(F.lit(1)).alias("__rows")).where("__n > 0")
    out = docs.withColumn("__own", mark).join(drawn, F.col("__own") == F.col("__mark"))
    if not sized.groupBy("__mark").count().where("count > 1").isEmpty():
        k = F.row_number().over(Window.partitionBy("__mark").orderBy("__own"))
        upto = lambda i: F.expr(f"(__k - {i}) * __n div __rows")
        out = out.withColumn("__k", k.cast("long")).withColumn("__n", upto(0) - upto(1)).where("__n > 0")
    # a copy is one row of the sequence 1..n, and n is at most max_rate + 1
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return out.select(*[out[c] for c in docs.columns])


def op1(spark, sf_dir):
    from .common import table

    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
turned AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
  source_size * CAST(2.0 AS DOUBLE) AS cap FROM per),
levels AS (SELECT *,
  (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM turned),
marked AS (SELECT *, cap <= level * weight AS f FROM levels),
targets AS (SELECT source, source_size, n_docs,
  CASE WHEN f THEN cap ELSE least(cap, max(CASE WHEN NOT f THEN level END) OVER () * weight) END AS target FROM marked),
drawn AS (SELECT s.*, t.source_size, t.target, t.n_docs,
  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE) AS d
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
strata AS (SELECT *, CAST(floor(d * ceil(n_docs / 256)) AS BIGINT) AS stratum,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM drawn),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY size DESC, d, doc_id) AS k,
  CAST(('0x' || substr(md5(coalesce(source, 'null') || '|' || CAST(stratum AS VARCHAR)), 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE) AS h FROM strata),
counted AS (SELECT *, CAST(floor(h + k * rate) - floor(h + (k - 1) * rate) AS BIGINT) AS copies FROM ranked)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, rate FROM counted
"""
