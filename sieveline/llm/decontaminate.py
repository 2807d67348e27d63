"""Benchmark decontamination: SimHash windows of an item's size, a multi-index over Hamming blocks, and verification.

A window of a text has as many words as the benchmark item it is held against. Windows that share no five-word
shingle with any item can't pass the verification, so windows are laid only where a shingle of an item stands in the
text as it does in the item. Their fingerprints are looked up in the index of the items' fingerprints: two that
differ in at most r bits agree in one of r + 1 blocks, so every item of that size within the radius is found. Each
pair found is verified: the similarity is the weight of the item's words that lie in shingles the window also has, over the
weight of all its words. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.plan import fixed
from sieveline.llm.common import may_and_cannot, only, read, settle, words

SHINGLE, RADIUS, LEAST = 5, 20, 0.8
#: The most item shingles, or items, that are broadcast; beyond it the same joins shuffle.
BROADCAST_ROWS = 500_000


def with_shingles(df: DataFrame, text: Column) -> DataFrame:
    """Adds w, the lower-cased words of the text, and shingles, the hashes of their five-word shingles in order."""
    df = fixed(df, {"w": words(F.lower(text))})
    df = fixed(df, {"h1": F.transform("w", lambda x: F.xxhash64(x)), "n": F.size("w")})
    join = lambda a, b, skip, size: F.zip_with(F.slice(a, 1, F.greatest(F.col("n") - size + 1, F.lit(0))), F.slice(b, skip + 1, F.greatest(F.col("n") - size + 1, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    df = fixed(df, {"h2": join("h1", "h1", 1, 2)})
    df = fixed(df, {"h4": join("h2", "h2", 2, 4)})
    return fixed(df, {"shingles": join("h4", "h1", 4, 5)}).drop("h1", "h2", "h4", "n")


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def simhash(h: Column) -> Column:
    """A bit is 1 if it is set in over half the word hashes. Two counters of 32 bits share a sum."""
    out = F.lit(0).cast("long")
    for k in range(32):
        both = _sum_bits(h, k)
        low, high = both.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(both, 32)
        for c, place in ((low, k), (high, k + 32)):
            out = out.bitwiseOR(F.shiftleft(F.when(c * 2 > F.size(h), F.lit(1)).otherwise(F.lit(0)).cast("long"), place))
    return out


def _sum_bits(h: Column, k: int) -> Column:
    return F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: acc + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(0x0000000100000001)))


def blocks(fp: Column) -> Column:
    """(block, value) of each of RADIUS + 1 blocks that together are the 64 bits."""
    n, at, out = RADIUS + 1, 0, []
    for k in range(n):
        width = (64 - at) // (n - k)
        out.append(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).alias("value")))
        at += width
    return F.array(*out)


def strings(w: str) -> Column:
    """The five-word shingles of an array of at least five words, as strings."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.array_join(F.slice(w, i + 1, SHINGLE), " "))


def similarity(pairs: DataFrame) -> DataFrame:
    """Adds similarity to pairs of item and window (arrays of words): the share of the item's words that lie in one of
    its shingles which the window has too."""
    pairs = fixed(pairs, {"of_item": strings("item"), "of_window": strings("window")})
    pairs = fixed(pairs, {"shared": F.array_intersect("of_item", "of_window")})
    pairs = fixed(pairs, {"at": F.filter(F.transform("of_item", lambda s, i: F.when(F.array_contains("shared", s), i)), lambda i: i.isNotNull())})
    # from one shared shingle to the next at most five words are covered
    pairs = fixed(pairs, {"steps": F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(SHINGLE)), F.lit(SHINGLE)))})
    covered = F.aggregate("steps", F.lit(0), lambda acc, x: acc + x)
    return pairs.withColumn("similarity", covered / F.size("item")).drop("of_item", "of_window", "shared", "at", "steps")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, id, h, item_id, start, similarity) of documents and the items they hold, once each: the window with
    the greatest similarity, of those the first. id and h identify the row where doc_id is null or not unique.

    Texts are lower-cased. Near its ends a text has the part of a window that lies in it.

    Edge cases: null and empty texts, texts of fewer than five words and items of fewer than five words match nothing; a
    null doc_id or item_id is kept as it is; rows equal in doc_id and text are one document here; an empty table on
    either side gives no rows; texts of any length are searched whole; other columns are ignored.
    """
    items = with_shingles(benchmark.select("item_id", "text"), F.col("text")).where(F.size("w") >= SHINGLE)
    items = fixed(items, {"hashes": hashes(F.col("w")), "size": F.size("w")})
    items = settle(items.select("item_id", F.col("w").alias("item"), "shingles", "size", simhash(F.col("hashes")).alias("item_fp")))
    counts = items.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()
    small = F.broadcast if counts.n <= BROADCAST_ROWS else lambda x: x
    places = items.select(F.posexplode("shingles").alias("at", "shingle"), "size").distinct()

    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.coalesce(F.xxhash64("text", F.col("doc_id").isNull()), F.lit(0)).alias("h"), F.col("text"))
    # outer, since a filter for empty arrays would make each array a second time
    each = with_shingles(rows.select("id", "h", "text"), F.col("text")).select("id", "h", F.posexplode_outer("shingles").alias("pos", "shingle"))
    hits = each.join(small(places), "shingle")
    starts = hits.select("id", "h", "size", (F.col("pos") - F.col("at")).alias("start")).distinct()
    starts = settle(starts.groupBy("id", "h").agg(F.collect_list(F.struct("size", "start")).alias("windows")))

    some = only(rows, starts, ["id", "h"]).join(starts, ["id", "h"]).dropDuplicates(["id", "h"])
    some = some.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "h")
    some = fixed(some, {"w": words(F.lower(F.col("text")))})
    some = some.select("doc_id", "id", "h", "w", F.explode("windows").alias("x")).select("doc_id", "id", "h", "w", "x.*")
    some = fixed(some, {"from": F.greatest("start", F.lit(0)), "to": F.least(F.col("start") + F.col("size"), F.size("w"))}).where(F.col("to") - F.col("from") >= SHINGLE)
    some = fixed(some, {"window": F.expr("slice(w, from + 1, to - from)")}).drop("w", "from", "to")
    some = fixed(some, {"hashes": hashes(F.col("window"))})
    some = fixed(some, {"fp": simhash(F.col("hashes"))}).drop("hashes")
    index = items.select("item_id", "item", "size", "item_fp", F.inline(blocks(F.col("item_fp"))))
    near = some.select("*", F.inline(blocks(F.col("fp")))).join(small(index), ["size", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    # a pair that agrees in several blocks is taken at the first of them
    same = F.zip_with(blocks(F.col("fp")), blocks(F.col("item_fp")), lambda x, y: x["value"] == y["value"])
    near = near.where(F.col("block") == F.array_position(same, True) - 1)
    sure = similarity(near).where(F.col("similarity") >= LEAST)
    best = sure.groupBy("doc_id", "id", "h", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best"))
    return best.select("doc_id", "id", "h", "item_id", (-F.col("best.s")).alias("start"), F.col("best.similarity").alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item; all columns as they are. Edge cases as in find_leaks."""
    leaks = settle(find_leaks(docs, benchmark).select("id", "h").distinct())
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.coalesce(F.xxhash64("text", F.col("doc_id").isNull()), F.lit(0)).alias("h")]
    may, cannot = may_and_cannot(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key), leaks, ["id", "h"])
    return cannot.select("row").unionByName(may.join(leaks, ["id", "h"], "left_anti").select("row")).select("row.*")


def op8_decontaminate(spark, sf_dir):
    found = find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.round("similarity", 6).alias("similarity"))


OP8_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
b AS (SELECT item_id, len(w) AS size, j, array_to_string(w[j + 1:j + 5], ' ') AS s FROM (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS j FROM i WHERE len(w) >= 5)),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, len(w) AS n, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM t WHERE len(w) >= 5)),
h AS (SELECT DISTINCT d.doc_id, d.n, d.p, b.item_id, b.size, b.j FROM d JOIN b ON d.s = b.s),
x AS (SELECT DISTINCT doc_id, n, item_id, size, p - j AS start FROM h),
m AS (SELECT DISTINCT x.doc_id, x.item_id, x.size, x.start, h.j FROM x JOIN h ON x.doc_id = h.doc_id AND x.item_id = h.item_id
      WHERE h.p >= greatest(x.start, 0) AND h.p + 5 <= least(x.start + x.size, x.n)),
c AS (SELECT doc_id, item_id, start, size, count(DISTINCT j + o) AS covered FROM m, (SELECT unnest(range(0, 5)) AS o) GROUP BY ALL)
SELECT doc_id, item_id, arg_max(start, (covered / size, -start))::BIGINT AS start, round(max(covered / size), 6) AS similarity
FROM c WHERE covered / size >= 0.8 GROUP BY doc_id, item_id
"""
