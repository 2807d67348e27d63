"""Helpers shared by the operators: words, lineage, hashing and connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
#: Stands for a null doc_id, after all others.
LAST = (1 << 63) - 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(text: Column, one_line: bool = False) -> Column:
    """The words of a text in order; an empty array for null and for texts without a word.

    Most texts have single spaces and line feeds only, and are cut at one character, which needs no regular expression.
    one_line: the text has no line feed.
    """
    odd = (text == "") | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" ")) | F.contains(text, F.lit("  "))
    for c in "\t\x0b\f\r":
        odd = odd | F.contains(text, F.lit(c))
    if not one_line:
        for c in ("\n ", " \n", "\n\n"):
            odd = odd | F.contains(text, F.lit(c))
        odd = odd | F.startswith(text, F.lit("\n")) | F.endswith(text, F.lit("\n"))
    plain = text if one_line else F.replace(text, F.lit("\n"), F.lit(" "))
    some = F.filter(F.split(text, GAP), lambda w: w != "")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(~odd, F.split(plain, " ")).otherwise(some)


def odd_space(text: Column) -> Column:
    """Whether text has other white space than line feeds and single blanks between words."""
    # plain searches: a regular expression takes longer than all else that is done with a text
    odd = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for c in ("  ", "\n ", " \n", "\t", "\x0b", "\f", "\r"):
        odd = odd | F.contains(text, F.lit(c))
    return odd


def line_words(line: Column, odd: Column) -> Column:
    """The words of a line that is not empty; odd: odd_space of its whole text."""
    return F.when(odd, F.filter(F.split(line, GAP), lambda w: w != "")).otherwise(F.split(line, " "))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. A folder of our own is made only in local mode."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: Folders of the tables made so far, for `scope` and for the end of the driver.
_MADE: list[tuple[SparkSession, str]] = []


#: Spark removes a step's shuffle files when the step ends, and not when its driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame) -> DataFrame:
    """Runs df once and keeps its rows as compressed Parquet in the shared folder, so that later steps neither repeat the work
    nor depend on one executor's disk. The table is removed by `discard`, at the end of a `scope`, or when the driver ends."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        # most of what is stored is hashes, of which dictionaries hold nothing twice
        df.write.options(**{"compression": "zstd", "parquet.enable.dictionary": "false"}).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _release(spark)
    out = spark.read.parquet(path)
    out.stored_at = path
    return out


#: The name that small tables are stored by.
settle = store


def _release(spark: SparkSession) -> None:
    """Spark drops broadcasts of a finished step, and shuffle files of counts, when the driver's collector finds that nothing
    refers to them, which may take long. So the collector is asked to look."""
    gc.collect()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and with it its folder
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*stored: DataFrame) -> None:
    """Removes what store has written, once everything made of it has been run."""
    for df in stored:
        _remove(df.sparkSession, df.stored_at)


@contextlib.contextmanager
def scope():
    """Removes, when it ends, all tables that were stored within it and not handed to `keep`: what was made of them must have
    been stored by then."""
    since, kept = len(_MADE), []
    try:
        yield kept.append
    finally:
        stays = {df.stored_at for df in kept}
        for spark, path in _MADE[since:]:
            if path not in stays:
                _remove(spark, path)


@atexit.register
def _remove_all() -> None:
    for spark, path in _MADE:
        _remove(spark, path)


#: Least and most bits of the filter that `may_and_cannot` sends to the executors: 128 KiB to 16 MiB, and bits a key. Beyond the most,
#: the filter lets more through, and no row is lost.
FILTER_BITS, BITS_A_KEY = (1 << 20, 1 << 27), 16
#: Longs of a row of the filter.
FILTER_ROW = 1 << 12


def may_and_cannot(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among keys, and those whose key is not. The first has all that are, and few others while
    the keys are fewer than some millions. If only the first are joined, few texts are shuffled for nothing; the filter is
    broadcast and has a bounded size. Rows with a null key, as one of xxhash64's, are treated like any other."""
    spark = rows.sparkSession
    bits = FILTER_BITS[0]
    n = keys.count()
    while bits < FILTER_BITS[1] and bits < BITS_A_KEY * n:
        bits *= 2
    h = F.xxhash64(*on)
    place = F.pmod(h, F.lit(bits // 64))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", h, F.lit(58)).cast("int"))
    # every long of the filter has a row, so that those of a row of the filter are an array without gaps
    longs = keys.select(place.alias("place"), one.alias("bit")).unionByName(spark.range(bits // 64).select(F.col("id").alias("place"), F.lit(0).cast("long").alias("bit")))
    longs = longs.groupBy("place").agg(F.bit_or("bit").alias("bits"))
    table = longs.groupBy((F.col("place") / FILTER_ROW).cast("long").alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("place", "bits")))["bits"].alias("bits"))
    found = rows.withColumns({"bucket": F.floor(place / FILTER_ROW).cast("long"), "slot": F.pmod(place, F.lit(FILTER_ROW)).cast("int"), "bit": one}).join(F.broadcast(table), "bucket", "left")
    found = found.withColumn("may", F.get("bits", "slot").bitwiseAND(F.col("bit")) != 0).drop("bucket", "slot", "bit", "bits")
    return found.where("may").drop("may"), found.where("not may").drop("may")


def only(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return may_and_cannot(rows, keys, on)[0]


#: The most keys that join_counted broadcasts.
HEAVY = 10_000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """rows joined with keys, a stored table of one row a key and the number of rows that have it. Keys with more than a HEAVY-th
    of all rows, HEAVY at most, are broadcast, so that none of them lands in one task; the rest are shuffled."""
    total = keys.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first().n
    heavy = keys.where(F.col(n) * HEAVY > total)
    light = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(keys, on)
    return light.unionByName(rows.join(F.broadcast(heavy), on).select(light.columns))


def small_batches(spark: SparkSession, rows: int = 256, size: str = "4m") -> None:
    """Texts go to Python workers a few at a time: a batch of 10,000 long documents would fill a worker's memory.
    Lowers the session's limits and never raises them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list by alternating large-star and small-star rounds.

    Returns one row (node, root) for each node that has an edge to another node; root is the component's smallest node.
    Each round is a grouped minimum with map-side combination and a join that broadcasts the minima of the nodes with very
    many neighbours, so that these are not gathered in one task; the number of rounds grows with the logarithm of the
    number of nodes. Self-loops and null ends are ignored; no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    pairs = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    pairs = store(pairs.distinct())
    if pairs.isEmpty():
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        # large star: neighbours above u hang below the least of u and its neighbours
        large = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = join_counted(large, low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.where("u != v").distinct())
        # small star: u and its lower neighbours hang below the lowest of them
        least = store(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = join_counted(large, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, pairs = pairs, store(small.where("u != v").distinct())
        discard(last, low, large, least)
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
