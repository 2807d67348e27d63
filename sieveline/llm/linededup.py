"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words; lines with the same set are one class, told apart by 128-bit hashes and known by the place of
its first line. The words of a class are ordered by rarity, by counts over all lines in a table of a fixed size
(words that share a counter only make the order, and so the speed, worse). Its keys are the runs of three neighbours in the
prefix of that order. If two sets reach the threshold, one lacks few words of the other; each word that is lacking parts three runs
at most, and each that is added two. So the first run that they share lies in both prefixes (`RUNS`). Single rare words, and pairs of them,
are shared by ever more lines as the corpus grows; runs of three seldom are, except by similar lines. Sets of four and five words, which
are similar if one holds the other, have too few runs and meet in pairs of neighbours (`PAIRS`).

Classes that share a key pass a length filter, a positional filter and a 64-bit parity map of their words, and are verified
on the words. A line is removed if an earlier line matches it; all filters are exact, so no match is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.llm.common import LAST, SPACES, discard, join_counted, line_words, may_and_cannot, odd_space, only, read, store, words

#: Counters of the rarity order, a power of two.
COUNTERS = 1 << 18
#: Sets of fewer words reach the threshold only if they are equal, so they are classes but not joined.
LEAST_JOINED = 4
#: The threshold 4/5 in whole numbers: two sets of a and b words reach it if they share at least (4 * (a + b) + 8) div 9.
OVERLAP = "(4 * ({a} + {b}) + 8) div 9"
#: Runs of three that are keys of a set of n words. With p words of it lacking in a similar set of m, and q added, p + q <= (n + m) / 9 and
#: p - q = n - m, so that 3 * p + 2 * q <= (7 * n - 2 * m) / 9 <= 3 * n / 5 runs are parted. A set of n > 5 words has more than that.
RUNS = "(3 * n) div 5 + 1"
#: Pairs that are keys of sets of up to PAIRED words, since 2 * p + q <= 2 * n / 3 - m / 3 <= 2 * n / 5 pairs are parted. Of sets of four words
#: only those of five hold all; other sets of five meet theirs in runs.
PAIRS, PAIRED = "(2 * n) div 5 + 1", 5
#: Bits of a key: fewer make its tables smaller, and keys that agree by chance only bring pairs that the filters drop.
KEY_BITS = 40
PLACE = ["id", "h", "line_no"]
#: Rows of a key that are compared in one task.
CELL = 4096
#: Lines before it with the same key that a line is held against first. With the earliest of a key, these are all of its earlier lines for the first
#: ALL_HELD.
BESIDE = 3
ALL_HELD = BESIDE + 2
#: Sets of more words have a parity map of 192 bits, since in one of 64 the maps of any two of them differ in few bits more than those of similar ones.
LONG = 80


def split(rows: DataFrame) -> DataFrame:
    """rows: id, h, text. One row (id, h, odd, line_no, line) for each line that isn't empty; odd is what line_words needs."""
    # in a step of its own, since beside a generator it would be computed for each line
    rows = rows.select("id", "h", "text", odd_space(F.col("text")).alias("odd"))
    return rows.select("id", "h", "odd", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")).where("line != ''")


def lines(rows: DataFrame) -> DataFrame:
    """rows: id, h, text. One row for each line with a word: line_no, n (distinct words), tokens (a 32-bit hash of each) and
    k1, k2, a 128-bit hash of the set."""
    # no filter on what is computed here, since the optimizer would compute it a second time for the filter
    each = split(rows).where(F.btrim("line", F.lit(SPACES)) != "")
    each = each.select(*PLACE, F.sort_array(F.array_distinct(F.transform(line_words(F.col("line"), F.col("odd")), lambda w: F.xxhash64(w)))).alias("hashes"))
    return each.select(*PLACE, F.size("hashes").alias("n"), F.xxhash64("hashes").alias("k1"), F.xxhash64(F.lit(7), "hashes").alias("k2"), F.transform("hashes", lambda x: F.hash(x)).alias("tokens"))


def rarity(each: DataFrame) -> DataFrame:
    """One row with levels, an array of COUNTERS: of the count of the tokens x with x & (COUNTERS - 1) there six levels a
    doubling, 0 for a single one. Its size is fixed."""
    level = F.least(F.lit(126), F.floor(6 * F.log2("c")).cast("int"))
    at = F.col("x").bitwiseAND(F.lit(COUNTERS - 1)).alias("at")
    got = each.select(F.explode("tokens").alias("x")).groupBy(at).agg(F.count(F.lit(1)).alias("c")).select("at", level.alias("level")).toArrow()
    table = np.zeros(COUNTERS, np.int8)
    table[got.column("at").to_numpy()] = got.column("level").to_numpy()
    return each.sparkSession.createDataFrame(pa.table({"levels": pa.array([table], pa.list_(pa.int8()))}))


def later_copies(each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The places of the lines whose set of words an earlier line has, and those sets: k1, k2, copies, first (the place of the
    earliest line)."""
    copied = store(each.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*PLACE)).alias("first")).where("copies > 1"))
    both = join_counted(only(each.select(*PLACE, "k1", "k2"), copied, ["k1", "k2"]), copied, ["k1", "k2"], "copies")
    return store(both.where(F.struct(*PLACE) > F.col("first")).select(*PLACE)), copied


def with_keys(each: DataFrame, late: DataFrame, copied: DataFrame) -> DataFrame:
    """One row for each class of LEAST_JOINED words or more: the place of its first line, n, copies (its lines), parity
    (64 bits, 1 if an odd number of words falls on it), wide (null up to LONG words; else two more such maps, each of another
    third of the words) and keys. Stored."""
    counts = rarity(each)
    asked = each.where(F.col("n") >= LEAST_JOINED).select(*PLACE, "n", "tokens")
    # later copies go by their places alone, so that their tokens are not shuffled; missed are those that only seem to be ones
    may, on_time = may_and_cannot(asked, late, PLACE)
    missed = store(may.select(*PLACE).join(late, PLACE, "left_anti").distinct())
    firsts = copied.select("first.*", "copies")
    some, single = may_and_cannot(on_time, firsts, PLACE)
    # rows that are equal in doc_id and text have their lines in one place
    one = some.unionByName(only(may, missed, PLACE).join(missed, PLACE, "left_semi")).dropDuplicates(PLACE)
    one = one.join(firsts, PLACE, "left").withColumn("copies", F.coalesce("copies", F.lit(1))).unionByName(single.withColumn("copies", F.lit(1).cast("long")))
    level = lambda x: F.get("levels", x.bitwiseAND(F.lit(COUNTERS - 1))).cast("long")
    # by a subquery, since the driver writes a literal of this size out with every change of the plan, some megabytes each time
    one = one.withColumn("levels", counts.scalar())
    one = one.select(*PLACE, "n", "copies", F.sort_array(F.transform("tokens", lambda x: F.shiftleft(level(x), 32) + x)).alias("order"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    parity = F.aggregate("order", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bit(x)))
    third = lambda k: F.aggregate("order", F.lit(0).cast("long"), lambda acc, x: F.when(F.pmod(F.shiftright(x, 6), F.lit(3)) == k, acc.bitwiseXOR(bit(x))).otherwise(acc))
    wide = F.when(F.col("n") > LONG, F.array(third(0), third(1)))
    short = lambda x, y: F.xxhash64(x, y).bitwiseAND(F.lit((1 << KEY_BITS) - 1))
    part = lambda at, many: F.slice("order", F.lit(at), many)
    many = F.least(F.expr(RUNS), F.col("n") - 2)
    runs = F.zip_with(F.zip_with(part(1, many), part(2, many), lambda x, y: F.xxhash64(x, y)), part(3, many), short)
    pairs = F.zip_with(part(1, F.expr(PAIRS)), part(2, F.expr(PAIRS)), short)
    # the place of a key in the order is its place among the keys, of a set of five words by the number of its runs
    keys = F.when(F.col("n") < PAIRED, pairs).when(F.col("n") == PAIRED, F.concat(runs, pairs)).otherwise(runs)
    out = store(one.select(*PLACE, "n", "copies", parity.alias("parity"), wide.alias("wide"), keys.alias("keys")))
    discard(missed)
    return out


def fits(a: str, b: str) -> str:
    """The filters of two rows with the same key, in SQL: length, words before the key and from it on that they can share, parity."""
    share = OVERLAP.format(a=f"{a}.n", b=f"{b}.n")
    left = f"least({a}.pos, {b}.pos) + least({a}.n - {a}.pos, {b}.n - {b}.pos)"
    differ, (first, second) = f"{a}.n + {b}.n - 2 * ({share})", [f"({a}.wide[{k}] ^ {b}.wide[{k}])" for k in range(2)]
    wide = f"bit_count({first}) + bit_count({second}) + bit_count({a}.parity ^ {b}.parity ^ {first} ^ {second}) <= {differ}"
    return f"5 * least({a}.n, {b}.n) >= 4 * greatest({a}.n, {b}.n) AND {left} >= {share} AND bit_count({a}.parity ^ {b}.parity) <= {differ} AND coalesce({wide}, true)"


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (x, y) of places of lines. The places x of those whose sets of words are similar, once each."""
    asked = store(pairs.select(F.explode(F.array("x", "y")).alias("p")).distinct().select("p.*"))
    docs = only(rows, asked, ["id", "h"])
    text = only(split(docs), asked, PLACE).join(asked, PLACE).dropDuplicates(PLACE)
    sets = store(text.select(F.struct(*PLACE).alias("p"), F.array_distinct(line_words(F.col("line"), F.col("odd"))).alias("words")))
    both = pairs.join(sets.select(F.col("p").alias("x"), F.col("words").alias("a")), "x").join(sets.select(F.col("p").alias("y"), F.col("words").alias("b")), "y")
    out = store(both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("x.*").distinct())
    discard(asked, sets)
    return out


def similar(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """keyed: what with_keys gives, discarded here. The places of the classes that are similar to an earlier one.

    One earlier match decides, and in a large group of alike lines most match the line that has most copies or one of those just
    before them. So each line is first held against the BESIDE lines before it, the earliest and the most copied of each of its keys. Only lines that
    these don't decide are held against all earlier lines of a key, so that the pairs grow with the lines and not with the square of a group's size.
    Neighbours, earliest and most copied are those of a cell, which takes one shuffle for nearly all keys; only keys of several cells also look for
    the earliest and most copied of all their cells.
    """
    shared = store(keyed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    every = keyed.select(*PLACE, "n", "copies", "parity", "wide", "keys", F.posexplode("keys").alias("pos", "key")).withColumn("before", F.get("keys", F.col("pos") - 1)).drop("keys")
    every = every.withColumn("pos", F.when(F.col("n") == PAIRED, F.col("pos") % (PAIRED - 2)).otherwise(F.col("pos")))
    x = F.struct(F.struct(*PLACE).alias("place"), "n", "pos", "before", "parity", "wide")

    def beside(keys: DataFrame, *cell: str) -> DataFrame:
        """The rows of keys, with y: the places of the lines beside them that the filters let through. Rows that are not needed again go."""
        cells = F.ceil(F.col("size") / CELL).cast("int")
        rows = only(every, keys, ["key"]).join(keys, "key").select("key", cells.alias("cells"), F.pmod(F.xxhash64(*PLACE), cells).cast("int").alias("cell"), "size", "copies", x.alias("x"))
        near = W.partitionBy("key", *cell).orderBy("x.place")
        whole = near.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        lags = [F.lag("x", k).over(near).alias(f"y{k}") for k in range(1, BESIDE + 1)]
        most, least = F.max_by("x", F.struct("copies", "x.place")).over(whole), F.first("x").over(whole)
        rows = rows.select("*", *lags, F.when(F.col("size") > ALL_HELD, most).alias("most"), F.when(F.col("size") > BESIDE + 1, least).alias("least"), F.row_number().over(near).alias("row"))
        y = [F.expr(f"CASE WHEN {y}.place < x.place AND {fits('x', y)} THEN {y}.place END") for y in [*[f"y{k}" for k in range(1, BESIDE + 1)], "most", "least"]]
        return rows.select("key", "cells", "cell", "size", "copies", "row", "x", F.array_compact(F.array(*y)).alias("y")).where(f"size > {ALL_HELD} OR size(y) > 0")

    # rows come to a join in order of their keys, so that those of a key that fits in a cell need no other shuffle
    made = beside(shared.where(F.col("size") <= CELL))
    if not (large := shared.where(F.col("size") > CELL)).isEmpty():
        made = made.unionByName(beside(large, "cell"))
    every = store(made)
    discard(keyed, shared)
    beside_it = every.select(F.col("x.place").alias("x"), F.explode("y").alias("y"))
    rest = every.where(f"size > {ALL_HELD}").drop("y")
    large = rest.where("cells > 1")
    middle = large.groupBy("key").agg(F.max_by("x", F.struct("copies", "x.place")).alias("most"), F.min_by("x", "x.place").alias("least"))
    large = large.join(middle, "key").select(F.col("x").withField("before", F.lit(None).cast("long")).alias("x"), F.explode(F.array("most", "least")).alias("y"))
    # two lines that share the key before have been found there
    found = lambda df: df.where(F.expr(f"y.place < x.place AND coalesce(x.before != y.before, true) AND {fits('x', 'y')}")).select(F.col("x.place").alias("x"), F.col("y.place").alias("y")).distinct()
    pairs = store(beside_it.unionByName(found(large)).distinct())
    decided = verified(pairs, rows)
    discard(pairs)

    may, cannot = may_and_cannot(rest.where(f"cells > 1 OR row > {ALL_HELD}").select("*", "x.place.*"), decided, PLACE)
    asking = may.join(decided, PLACE, "left_anti").unionByName(cannot).select("key", "x", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    pairs = store(found(asking.join(rest.select("key", "cell", F.col("x").alias("y")), ["key", "cell"])))
    more = verified(pairs, rows)
    discard(pairs, every)
    return decided.unionByName(more).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of docs, with text without the lines removed, and n_lines and n_removed.

    A line is removed if a line of an earlier document, or an earlier one of the same, has a set of words whose
    Jaccard similarity with its own is at least 0.8, whether or not that earlier line is itself removed. Documents
    are in order of doc_id. Lines end at a line feed; a carriage return is white space.

    Edge cases: null texts have no lines and stay null, an empty text has none and stays empty; lines
    without a word are kept; rows without doc_id are last; rows with equal doc_id are in order of a hash of their text, and if that is equal
    too they are one document, each of whose rows loses the same lines; lines of any length are compared whole; an empty
    table gives no rows; a column of docs called n_lines or n_removed is replaced.
    """
    base = docs.drop("n_lines", "n_removed")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    # it only tells rows of equal doc_id apart, and takes room in every table
    once = base.groupBy(doc.alias("id")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).isEmpty()
    h = F.lit(0).cast("long") if once else F.coalesce(F.xxhash64("text", F.col("doc_id").isNull()), F.lit(0))
    rows = base.select(doc.alias("id"), h.alias("h"), F.col("text"))
    each = store(lines(rows))
    late, copied = later_copies(each)
    keyed = with_keys(each, late, copied)
    discard(each)
    gone = late.unionByName(similar(rows, keyed))
    removed = store(gone.groupBy("id", "h").agg(F.collect_set("line_no").alias("removed")))
    # texts that lose nothing are not shuffled
    whole = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"), doc.alias("id"), h.alias("h"))
    may, cannot = may_and_cannot(whole, removed, ["id", "h"])
    both = may.join(removed, ["id", "h"], "left").select("row", "removed").unionByName(cannot.select("row", F.lit(None).cast("array<int>").alias("removed")))
    # counted by bytes, since most texts need not be split
    n = F.octet_length("row.text") - F.octet_length(F.replace(F.col("row.text"), F.lit("\n"), F.lit(""))) + 1
    n = F.when(F.coalesce(F.col("row.text"), F.lit("")) == "", 0).otherwise(n)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed")), lambda i: F.get(F.col("lines"), i))
    both = both.select("row", "removed", F.when(F.col("removed").isNotNull(), F.split("row.text", "\n")).alias("lines"), n.cast("long").alias("n_lines"))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    cols = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in base.columns]
    return both.select(*cols, "n_lines", F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs with the columns it has, without the lines that dedup_lines removes and without the documents of which it leaves
    nothing but white space; a column n_chars is counted anew."""
    out = dedup_lines(docs).where(~((F.col("n_removed") > 0) & (F.btrim("text", F.lit(SPACES)) == "")))
    return out.select(*[F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def op4_lines(spark, sf_dir):
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


OP4_SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS no, list_distinct(regexp_extract_all(s[i], '[^\x20\x09-\x0D]+')) AS w
           FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
c AS (SELECT list_sort(w) AS w, len(w) AS n, min((doc_id, no)) AS first, row_number() OVER () AS k FROM l WHERE len(w) >= 1 GROUP BY ALL),
t AS (SELECT k, n, unnest(w) AS t FROM c),
r AS (SELECT t, count(*) AS f FROM t GROUP BY t HAVING count(*) > 1),
o AS (SELECT t.k, t.n, t.t, row_number() OVER (PARTITION BY t.k ORDER BY coalesce(f, 1), t.t) AS p FROM t LEFT JOIN r ON t.t = r.t),
q AS (SELECT * FROM o WHERE p <= n - (4 * n + 4) // 5 + 1),
j AS (SELECT DISTINCT a.k AS x, b.k AS y FROM q a JOIN q b ON a.t = b.t AND a.k <> b.k AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
v AS (SELECT x, y FROM j JOIN c a ON a.k = x JOIN c b ON b.k = y WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)),
m AS (SELECT c.w, least(c.first, coalesce((SELECT min(b.first) FROM v JOIN c b ON b.k = v.y WHERE v.x = c.k), c.first)) AS lim FROM c),
g AS (SELECT l.doc_id, list(l.no) AS gone FROM l JOIN m ON list_sort(l.w) = m.w WHERE (l.doc_id, l.no) > m.lim GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
       coalesce(len(gone), 0)::BIGINT AS n_removed,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(gone, i - 1)), lambda i: string_split(text, chr(10))[i]), chr(10)), '') END AS text
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
