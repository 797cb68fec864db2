"""Mixing sources to target weights by capped water-filling.

Sources are clamped at `epochs` times their size and what they cannot take is shared among the others
by weight, until none is above. A source's documents are then taken in a seeded order: each a whole
number of times, one more for those that come first, and a fraction for the one at which the target is met."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm._shared import save, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows (source, size); weights repeat over sources by code point, null last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    by = save(totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(epochs)))
    budget = (by.agg(F.sum("source_size")).first()[0] or 0) * share
    level, clamped = 0.0, -1
    while True:
        full = F.col("most") < F.col("weight") * level
        n, taken, free = by.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == clamped or free is None:
            break
        clamped, level = n, (budget - (taken or 0.0)) / free
    return by.select("source", "source_size", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", share: float = 1.5, epochs: float = 2.0, weights: tuple = WEIGHTS, id_column: str = "doc_id") -> DataFrame:
    """(id, source, size, source_size, target, taken), one row per row of docs.

    size counts the words of text (null: 0); taken is the number of words that the mix takes of it, repeats
    counted, at most `epochs` times size. A source's taken words add up to its target rounded down. The
    seeded order is that of md5(seed|id), so reruns agree; rows with one id share its place. A null source is a source.
    With no words at all, every target and taken is 0. Other columns are not read.

    Only (id, source, size, place) are kept of the texts. The seeded order is found in two steps, sums by
    4,096 ranges of the hash and then a window inside the one range of each source in which its target is
    met, so no source is sorted in one task."""
    sized = save(
        docs.select(F.col(id_column).alias("id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        .withColumn("place", F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))))
        .withColumn("range", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    )
    targets = save(source_targets(sized.select("source", "size"), share, epochs, weights))
    rest = F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    plans = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plans = plans.withColumn("rest", F.when(F.col("source_size") > 0, F.floor(rest)).otherwise(F.lit(0)))
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    met = ranges.alias("r").join(plans.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    met = met.where("before <= rest AND rest < before + n").groupBy("p.source").agg(F.min(F.struct("range", "before")).alias("met"))
    plans = plans.alias("p").join(met.alias("m"), F.col("p.source").eqNullSafe(F.col("m.source")), "left").select("p.*", F.col("met.range").alias("at"), F.col("met.before").alias("before"))
    plans = save(plans)
    rows = sized.alias("d").join(plans.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "source_size", "target", "whole", "rest", "at", "before")
    inside = F.col("range") == F.col("at")
    earlier = Window.partitionBy("source", "range").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.where(inside).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    here = here.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))).drop("start")
    there = rows.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", F.when(F.col("at").isNull() | (F.col("range") > F.col("at")), F.lit(0)).otherwise(F.col("size")))
    both = there.unionByName(here)
    return both.select(F.col("id").alias(id_column), "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR))) AS place FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM totals),
ranked AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM weighed),
levels AS (SELECT max(level) AS level FROM (
  SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM totals) - below) / free AS level, most, weight FROM ranked) WHERE most >= weight * level),
targets AS (SELECT source, source_size, least(most, weight * (SELECT level FROM levels)) AS target FROM weighed),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
rows_ AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
         floor(p.target - p.whole * p.source_size) AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken
FROM rows_
"""
