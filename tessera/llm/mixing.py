"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key; rows are ordered by it within their source by way of 4,096 key ranges: sums of ranges give each range's offset in its
source (a distributed prefix sum, so that a source with a third of all rows is no single task), a window inside a range gives the rest. Each source is
cut at its exact budget; the row at the cut gives part of its words. A budget above the source's size takes further epochs.

Null text has size 0; null sources are a source of their own, ordered last; rows that repeat an id are ordered by size. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Hexadecimal digits of the key that name a range.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds target: weights repeat over the sources by code point, null last; together they get
    share[0]/share[1] of all sizes; none gets more than cap times its own, and what is cut off goes to the others by weight until none is above."""
    up, down = share
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("__n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__n") % len(weights) + 1).cast("int")).cast("bigint")
    # In the order of cap / weight, the sources that end at their caps come first: find the fewest whose cutting leaves none above.
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    d = (
        ranked.withColumn("__w", weight)
        .withColumn("__cap", F.lit(cap) * F.col("source_size"))
        .withColumn("__all", F.sum("source_size").over(whole))
        .withColumn("__capped", F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        .withColumn("__rest", F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__left", F.lit(up) * F.col("__all") - F.lit(down) * F.col("__capped"))
    )
    fits = F.col("__left") * F.col("__w") <= F.lit(down) * F.col("__cap") * F.col("__rest")
    level = F.min(F.when(fits, F.struct(F.col("__capped").alias("c"), F.col("__left").alias("left"), F.col("__rest").alias("rest")))).over(whole)
    d = d.withColumn("__level", level)
    target = F.least(F.col("__cap").cast("double"), (F.col("__level.left") * F.col("__w")).cast("double") / (F.lit(down) * F.col("__level.rest")).cast("double"))
    return d.select("source", "source_size", F.coalesce(target, F.col("__cap").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **targets) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row: taken is the words of it in the mix, repeats counted."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("bigint")
    name = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size")).withColumn("__key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = common.materialize(rows.select("*", name.alias("__s"), F.substring("__key", 1, RANGE_DIGITS).alias("__r")))
    ranges = rows.groupBy("__s", "__r").agg(F.first("source").alias("source"), F.sum("size").alias("__size"))
    ranges = common.materialize(ranges)
    sizes = ranges.groupBy("__s").agg(F.first("source").alias("source"), F.sum("__size").alias("source_size"))
    targets_ = source_targets(sizes.select("source", "source_size"), **targets).select(name.alias("__s"), "source_size", "target")
    base = F.coalesce(F.sum("__size").over(Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("__s", "__r", base.alias("__base")).join(targets_, "__s")
    inside = Window.partitionBy("__s", "__r").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(ranges, ["__s", "__r"]).withColumn("__before", F.col("__base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    placed = placed.withColumn("__e", epochs).withColumn("__cut", budget - F.col("__e") * F.col("source_size") - F.col("__before"))
    taken = F.col("__e") * F.col("size") + F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), F.col("__cut")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(common.read(spark, sf_dir, "documents")).drop("source")


def sql(docs: str = "documents") -> str:
    """The same in DuckDB's SQL, over the rows of `docs`."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM {docs}),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM sums),
weighed AS (SELECT *, CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed),
level AS (SELECT 3 * total - 2 * capped AS left_over, rest FROM levels WHERE (3 * total - 2 * capped) * w <= 2 * cap * rest ORDER BY capped LIMIT 1),
targets AS (SELECT w.source, source_size, least(CAST(cap AS DOUBLE), CAST(left_over * w AS DOUBLE) / CAST(2 * rest AS DOUBLE)) AS target FROM weighed w, level),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM placed"""


ORACLES = {"op10_mixing": sql()}
