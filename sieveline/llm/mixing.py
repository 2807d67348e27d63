"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key (md5 of a seed and its doc_id), rows are range-sorted by that key within
their source, running word counts are the sum of two parts (words of lower key ranges, words before the row in its
own range), and each source is cut where its budget ends. A budget above the source's size takes whole epochs first.
No step gathers a source: a range holds 1/buckets of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.llm.common import settle, words

BUCKET_DIGITS = 3


def shares(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Targets of sources: (s_null, s, source_size) plus target; one row a source.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target stops at most
    times the source's size and the rest is shared by weight among the others: by the least ratio of limit to weight
    first, a source is at its limit if an equal level for all remaining would pass it. The unpartitioned windows here
    see one narrow row a source.
    """
    w = sizes.withColumn("rank", F.row_number().over(W.orderBy("s_null", "s")))
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rank") - 1) % len(weights) + 1).cast("long"))
    w = w.withColumn("limit", F.col("source_size") * most)
    ordered = W.orderBy(F.col("limit").cast("double") / F.col("weight"), "rank")
    everything = W.partitionBy()
    w = w.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        (F.sum("limit").over(ordered.rowsBetween(W.unboundedPreceding, 0)) - F.col("limit")).alias("limits_before"),
        (F.sum("weight").over(ordered.rowsBetween(W.unboundedPreceding, 0)) - F.col("weight")).alias("weight_before"),
    )
    w = w.withColumn("full", F.col("limit") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * (F.col("total") - F.col("limits_before")))
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(everything)
    weight_left = F.col("all_weight") - F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(everything)
    w = w.select("s_null", "s", "source_size", "weight", "full", "limit", left.alias("left"), weight_left.alias("weight_left"))
    level = (F.col("weight") * F.col("left")).cast("double") / F.when(F.col("weight_left") > 0, F.col("weight_left")).cast("double")
    return w.select("s_null", "s", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(level).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix", keep: Sequence[str] = (), size: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, then the columns named in keep.

    size is the number of words of text unless given as an expression. taken counts words with repeats: whole
    epochs times size, plus the part of the document that falls below the cut of the last, partial epoch, so that
    the words taken from a source are its target rounded down.

    Edge cases: a null text has size 0; a null source is a source of its own, after all others; a null doc_id is
    replaced by the text's md5 in the random key; rows with the same doc_id stand side by side, the smaller first;
    an empty table gives no rows; other columns of docs, whatever their names, are ignored unless in keep.
    """
    base = docs.select(
        F.col("doc_id"),
        F.col("source"),
        (F.size(words(F.col("text"))).cast("long") if size is None else size).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")))).alias("key"),
        F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(None).alias("none")]).alias("kept"),
    ).select("*", F.col("source").isNull().alias("s_null"), F.coalesce("source", F.lit("")).alias("s"), F.substring("key", 1, BUCKET_DIGITS).alias("bucket"))
    narrow = settle(base.drop("kept"))
    ranges = narrow.groupBy("s_null", "s", "bucket").agg(F.sum("size").alias("words"))
    sizes = narrow.groupBy("s_null", "s").agg(F.sum("size").alias("source_size"))
    before = F.sum("words").over(W.partitionBy("s_null", "s").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")
    starts = ranges.select("*", before.alias("before")).drop("words").join(shares(sizes, weights, most), ["s_null", "s"])
    rows = base if keep else narrow
    inside = W.partitionBy("s_null", "s", "bucket").orderBy("key", "size", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(starts, ["s_null", "s", "bucket"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(0)
    rows = rows.withColumn("epochs", epochs)
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("inside")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    kept = [F.col("kept").getField(c).alias(c) for c in keep]
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *kept)


def op1_mix(spark, sf_dir):
    from sieveline.llm.common import read

    return mix(read(spark, sf_dir, "documents")).drop("source")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, source_size * 3 AS lim FROM r),
o AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS all_weight,
             sum(lim) OVER p::BIGINT - lim AS lim_before, sum(weight) OVER p::BIGINT - weight AS weight_before
      FROM w WINDOW p AS (ORDER BY lim::DOUBLE / weight, rank ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, lim * (all_weight - weight_before) <= weight * (total - lim_before) AS at_limit FROM o),
t AS (SELECT source, source_size, CASE WHEN at_limit THEN lim::DOUBLE ELSE
        (weight * (total - sum(CASE WHEN at_limit THEN lim ELSE 0 END) OVER ()))::DOUBLE
        / (all_weight - sum(CASE WHEN at_limit THEN weight ELSE 0 END) OVER ())::DOUBLE END AS target FROM f),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size, d.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - start)) END::BIGINT AS taken FROM x
"""
