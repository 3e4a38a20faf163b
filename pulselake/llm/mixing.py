"""Mixing sources to target weights: capped water-filling with seeded repetitions.

Every source's target rises in proportion to its weight until it holds ``max_epochs`` times the
source; what it cannot take is shared by the others in proportion to their weights until no target is
above its cap. With the sources in the order of cap / weight the resulting water level is a prefix
sum, so no loop is needed: a source is clamped if the level that the sources before it leave
would lift it over its cap.

A source's target is then ``whole`` repetitions of every document and one more of the documents that
come first in a seeded order, as many as bring it closest to the target. The order is cut at one
key per source. The key is found in two steps, in sums over 4096 slices of the order and then
within one slice, so a source that holds a third of all rows is never gathered in one task.

Defined results: sizes are word counts (null text: 0); a null source is a source of its own and comes
last; repeated rows have the same key and are taken or left together; sources without words have
target 0; extra columns are kept by ``mix``; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, documents, fresh, materialize

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0))


def seeded_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded_key(F.col("doc_id"), seed).alias("key"))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources (source, source_size, weight)`` with ``target``: ``share`` of all sizes, dealt out by
    weight and clamped at ``max_epochs`` times each size."""
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = sources.withColumn("budget", share * F.sum("source_size").over(everything)).withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    out = out.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(here))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return out.withColumn("target", target).select("source", "source_size", "target")


def plan(sizes: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target, whole, cut)``: each document is taken ``whole`` times and once
    more if its key is at most ``cut`` (null: never)."""
    slices = sizes.groupBy("source", F.substring("key", 1, 3).alias("slice")).agg(F.sum("size").alias("slice_size"))
    totals = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    totals = totals.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), rank))
    targets = water_fill(totals, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = materialize(targets)

    # the slice in which the rest ends
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    ends = slices.join(targets.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).where("rest > 0 and before <= rest")
    ends = ends.groupBy("source").agg(F.max(F.struct("slice", "before", "rest")).alias("e")).select(F.col("source").alias("s"), "e.*")
    within = sizes.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.substring("key", 1, 3) == F.col("slice")))
    within = within.groupBy("source", "key").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    middle = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key")) - F.col("size") / 2
    cut = within.withColumn("middle", middle).groupBy("source").agg(
        F.max(F.when(F.col("middle") <= F.col("rest"), F.col("key"))).alias("inside"), F.min("key").alias("first"))
    # nothing of the slice fits: everything before its first key
    cut = cut.select(F.col("source").alias("s"), F.coalesce("inside", F.substring("first", 1, 3)).alias("cut"))
    return materialize(targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "cut"))


def copies(key: Column) -> Column:
    return F.col("whole") + F.coalesce((key <= F.col("cut")).cast("int"), F.lit(0))


def mix(docs: DataFrame, seed: int = 23, **how) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is taken, columns unchanged."""
    found = plan(materialize(sized(docs, seed)), **how)
    times = found["whole"] + F.coalesce((seeded_key(docs["doc_id"], seed) <= found["cut"]).cast("int"), F.lit(0))
    copy = fresh(docs, "copy")
    rows = docs.join(found, docs["source"].eqNullSafe(found["source"])).where(times > 0)
    return rows.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), times)).alias(copy)).drop(copy)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(sized(documents(spark, sf_dir), 23))
    found = plan(sizes).withColumnRenamed("source", "s")
    rows = sizes.join(found, F.col("source").eqNullSafe(F.col("s")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("key"))).alias("taken"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('23:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source
), o AS (
  SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS ratio, 1.5 * sum(source_size) OVER () AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1), 1e300) * weight) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), k AS (
  SELECT d.*, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key) - sum(size) OVER (PARTITION BY d.source, key) / 2 AS middle
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * (whole + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM k
"""
