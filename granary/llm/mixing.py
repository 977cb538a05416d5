"""Mixing sources to target weights by weighted fair queueing.

Within its source, every document stands at a place of a reproducible shuffle, and the source's queue is
gone through as often as its documents may repeat. A document's virtual finish time is its queue's
cumulative words divided by the source's weight. All queues are served in the order of these times until
the total budget is spent. Sources thus advance in proportion to their weights, and one whose queue runs
dry leaves its share to the others, which is the water-filling that defines the targets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm._common import fresh, materialise, table, words

WEIGHTS, BUDGET, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix"
#: Parts of a source's shuffle order, and of the range of virtual times, whose sums are taken before their members are sorted.
PARTS, HEX_DIGITS = 4096, 3


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) for each source of sizes (source, size).

    Sources by code point, null last, take the weights in turn. A target stops at epochs times its source's
    size and what it leaves is shared by weight among the rest. Windows here run over one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * epochs)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) * F.lit(budget) - before) / after)
    level = F.coalesce(F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"], F.max(F.col("cap") / F.col("weight")).over(everything))
    return s.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"))


@dataclass
class Mix:
    """rows: (id, source, size, key, source_size, weight, target, ahead), ahead being the queue's words up to the row's end."""

    rows: DataFrame
    time: float
    epochs: int

    def copies(self) -> Column:
        """How often a row is taken."""
        return sum((F.when((F.col("ahead") + e * F.col("source_size")) / F.col("weight") <= self.time, 1).otherwise(0) for e in range(self.epochs)), F.lit(0)).cast("long")


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: str = SEED) -> Mix:
    """The mix of docs. No source is handled whole by one task, nor are all rows ever sorted by one.

    The shuffle order is that of the MD5 of id and seed. A source is cut by the first digits of it: the parts'
    sums give each part's start, and only a part's rows are sorted together. In the same way the range of
    virtual times is cut, the parts' sums show in which the budget ends, and only that part is sorted.
    Rows with equal times are taken together or not at all. Null texts have size 0; null ids are
    shuffled as one id; repeated rows are rows of their own; a null source is a source, the last one.
    """
    ident, source = F.col(f"`{id_col}`"), F.col(f"`{source_col}`")
    key = F.md5(F.concat_ws(":", F.coalesce(ident.cast("string"), F.lit("")), F.lit(seed)))
    sizes = materialise(spark, docs.select(ident.alias("id"), source.alias("source"), size_of(F.col(f"`{text_col}`")).alias("size"), key.alias("key")), "sizes")
    part = F.substring("key", 1, HEX_DIGITS)
    parts = sizes.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"))
    start = F.sum("words").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words")
    of = targets(parts.select("source", F.col("words").alias("size")), weights, budget, epochs)
    parts = parts.withColumn("start", start).select(F.col("source").alias("s"), F.col("part").alias("p"), "start")
    parts = parts.join(of, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    own = F.sum("size").over(W.partitionBy("source", part).orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = sizes.withColumn("own", own).join(parts, F.col("source").eqNullSafe(F.col("s")) & (part == F.col("p")))
    rows = materialise(spark, placed.select("id", "source", "size", "key", "source_size", "weight", "target", (F.col("start") + F.col("own")).alias("ahead")), "queue")
    whole = rows.agg(F.sum("size"), F.max(epochs * F.col("source_size") / F.col("weight"))).first()
    limit, last = (whole[0] or 0) * budget, whole[1] or 0.0
    if not last:
        return Mix(rows, 0.0, epochs)
    served = rows.select("size", F.explode(F.array(*((F.col("ahead") + e * F.col("source_size")) / F.col("weight") for e in range(epochs)))).alias("v"))
    served = served.withColumn("part", F.floor(F.col("v") * (PARTS / last)).cast("long"))
    sums = served.groupBy("part").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)))
    cut = sums.where(F.col("upto") > limit).agg(F.min(F.struct("part", F.col("upto") - F.col("words"))).alias("cut")).first()["cut"]
    if cut is None:
        return Mix(rows, last, epochs)
    upto = F.sum("size").over(W.orderBy("v").rangeBetween(W.unboundedPreceding, W.currentRow)) + cut[1]
    within = served.where(F.col("part") == cut[0]).withColumn("upto", upto).where(F.col("upto") <= limit).agg(F.max("v")).first()[0]
    if within is None:
        within = served.where(F.col("part") < cut[0]).agg(F.max("v")).first()[0]
    return Mix(rows, -1.0 if within is None else within, epochs)


def take(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copies_col: str = "copies", **options) -> DataFrame:
    """The rows of docs that the mix takes, with the number of times as `copies_col` (an equally named column is replaced).

    Rows that repeat an id are taken as often as the one of them that the mix takes most.
    """
    m = mix(spark, docs, id_col, source_col, text_col, **options)
    taken = fresh([*docs.columns, copies_col], "taken_id")
    found = m.rows.select(F.col("id").alias(taken), m.copies().alias(copies_col)).where(F.col(copies_col) > 0).groupBy(taken).agg(F.max(copies_col).alias(copies_col))
    rest = [c for c in docs.columns if c.lower() != copies_col.lower()]
    return docs.select(*(F.col(f"`{c}`") for c in rest)).join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(taken))).drop(taken)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(spark, table(spark, sf_dir, "documents"))
    return m.rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (m.copies() * F.col("size")).alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), '{SEED}')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT source, source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, source_size * {EPOCHS} AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () * {BUDGET}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, coalesce(arg_min(level, cap / weight) FILTER (level * weight <= cap) OVER (), max(cap / weight) OVER ()) AS v FROM s2),
q AS (SELECT d.*, s3.source_size, s3.weight, least(s3.cap::DOUBLE, s3.weight * s3.v) AS target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ahead FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
e AS (SELECT size, (ahead + epoch * source_size) / weight AS v FROM q, range({EPOCHS}) AS r(epoch)),
cut AS (SELECT max(v) AS v FROM (SELECT v, sum(size) OVER (ORDER BY v) AS upto FROM e) WHERE upto <= (SELECT sum(size) * {BUDGET}::DOUBLE FROM d))
SELECT doc_id, size, source_size, target, CAST(size * ({" + ".join(f"CASE WHEN (ahead + {e} * source_size) / weight <= (SELECT v FROM cut) THEN 1 ELSE 0 END" for e in range(EPOCHS))}) AS BIGINT) AS taken FROM q"""
