"""Embedding near-dedup with a forest of random-projection trees.

A tree splits its vectors at the middle of their projections on a random direction, again and again; vectors near the
middle go to both sides (spill overlap). Trees are fitted on a bounded sample, every vector is sent down every tree,
and vectors are compared within leaves, by cosine in double precision. Equal vectors are one class with a count, so a
very common vector costs no more than a rare one. Pairs are not written: a leaf gives the number of links of each
of its classes, counting a pair only in the first leaf that holds both, and edges that join its linked classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import components, read, settle, small_batches, store
from sieveline.llm.simhash import grouped, stars

TREES = 10
#: The most vectors that the trees are fitted on.
SAMPLE = 16_384
#: Vectors that a leaf should get, and the least number of sampled vectors that are split by their own quantiles.
LEAF, LEAF_SAMPLE = 256, 8
#: Each side of a split gets this share of the vectors beyond the middle as well.
SPILL = 0.06
#: The same in standard deviations of a normal distribution, for levels below those that the sample can fit.
SPILL_Z = 0.15
#: Vectors of a leaf compared in one task; larger leaves are cut into chunks and all pairs of chunks compared.
CELL = 2048


class Tree:
    """Splits fitted on a sample, then `extra` more levels in each leaf on directions of its own."""

    def __init__(self, sample: np.ndarray, seed: int, least: int, extra: int):
        self.seed, self.extra = seed, extra
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # (direction, low, high, left, right), or (leaf, bounds of its further levels)
        self.leaves = 0
        self._grow(sample, rng, least)

    def _leaf(self, x: np.ndarray) -> int:
        at, self.leaves = len(self.nodes), self.leaves + 1
        p = x @ self.directions(self.leaves - 1, x.shape[1])
        mid, dev = p.mean(0), p.std(0)
        self.nodes.append((self.leaves - 1, mid - SPILL_Z * dev, mid + SPILL_Z * dev))
        return at

    def directions(self, leaf: int, dims: int) -> np.ndarray:
        return np.random.default_rng([self.seed, leaf]).normal(size=(dims, self.extra))

    def _grow(self, x: np.ndarray, rng, least: int) -> int:
        if len(x) <= least:
            return self._leaf(x)
        d = rng.normal(size=x.shape[1])
        p = x @ d
        low, high = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
        left, right = x[p <= high], x[p >= low]
        if max(len(left), len(right)) > 0.9 * len(x):
            return self._leaf(x)
        at = len(self.nodes)
        self.nodes.append(())
        self.nodes[at] = (d, low, high, self._grow(left, rng, least), self._grow(right, rng, least))
        return at

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every leaf that each row of x falls in."""
        rows, cells = [], []
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, own = todo.pop()
            node = self.nodes[at]
            if not len(own):
                continue
            if len(node) == 5:
                p = x[own] @ node[0]
                todo += [(node[3], own[p <= node[2]]), (node[4], own[p >= node[1]])]
                continue
            leaf, low, high = node
            path = np.full(len(own), leaf << self.extra, np.int64)
            if self.extra:
                p = x[own] @ self.directions(leaf, x.shape[1])
                at = np.arange(len(own))
                for k in range(self.extra):
                    l, r = p[at, k] <= high[k], p[at, k] >= low[k]
                    path = np.concatenate([path[l], path[r] | (1 << k)])
                    at = np.concatenate([at[l], at[r]])
                own = own[at]
            rows.append(own)
            cells.append(path)
        return np.concatenate(rows) if rows else np.empty(0, np.int64), np.concatenate(cells) if cells else np.empty(0, np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column, dims: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as rows, with zeros after the shorter ones, which leaves the cosines of equally long ones
    as they are; and their lengths."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), max(dims, int(sizes.max(initial=0)))))
    own = np.arange(out.shape[1]) < sizes[:, None]
    out[own] = column.flatten().to_numpy(zero_copy_only=False)
    return out, sizes


def fit(classes: DataFrame, n: int, dims: int, trees: int, sample: int) -> list[Tree]:
    """Trees on the vectors of the `sample` classes with the least hashes."""
    some = classes.orderBy(F.xxhash64("h"), "h").limit(sample).select("v").toArrow()
    x = unit(matrix(some.column(0).combine_chunks(), dims)[0])
    least = max(LEAF_SAMPLE, LEAF * len(x) // n)
    extra = max(0, math.ceil(math.log(n * least / len(x) / (2 * LEAF)) / math.log(2))) if n * least > 2 * LEAF * len(x) else 0
    return [Tree(x, seed, least, extra) for seed in range(trees)]


def shares_earlier(lists: list[np.ndarray], cell: int) -> np.ndarray:
    """Which pairs of rows have a cell before this one in common. Only cells that at least two of the rows have count, and
    each marks its pairs, so that nothing grows with the number of different cells."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    name = np.concatenate(lists)
    row, name = row[name < cell], name[name < cell]
    order = np.argsort(name, kind="stable")
    row, name = row[order], name[order]
    out = np.zeros((len(lists), len(lists)), bool)
    for own in np.split(row, np.flatnonzero(np.diff(name)) + 1):
        if len(own) > 1:
            out[np.ix_(own, own)] = True
    return out


def linked(classes: DataFrame, n: int, dims: int, threshold: float, trees: int, sample: int, cell: int) -> DataFrame:
    """classes: h, n, v, stored; dims: the greatest length. Rows (a, b, links): class a has `links` partners that it shares no
    earlier leaf with, or, with links null, a is joined to b."""
    forest = fit(classes, n, dims, trees, sample)

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(matrix(b.column(1), dims)[0])
            rows, cells = zip(*(t.route(x) for t in forest), strict=True)
            cells = np.concatenate([c + (k << 48) for k, c in enumerate(cells)])
            rows = np.concatenate(rows)
            order = np.lexsort((cells, rows))
            rows, cells = rows[order], cells[order]
            starts = np.searchsorted(rows, np.arange(len(x) + 1))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(cells))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["h", "cells"])

    # each vector is routed once; where it belongs is narrow, and vectors join it for the comparison only
    routed = store(classes.select("h", "v").mapInArrow(route, "h bigint, cells array<bigint>"))
    sizes = store(routed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    rows = classes.join(routed, "h").select("h", "n", "v", "cells", F.explode("cells").alias("cell")).join(sizes, "cell")
    rows = rows.withColumn("g", F.ceil(F.col("size") / cell).cast("int")).withColumn("c", F.pmod(F.xxhash64("h"), F.col("g")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j")))
    rows = rows.select("cell", F.inline(pairs), "c", "h", "n", "v", "cells")
    rows = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "h")

    def compare(batches):
        for cells, i, j, c, h, n, v, lists in grouped(batches, 3):
            if len(h) < 2:
                continue
            x, sizes = matrix(pa.array(v))
            x = unit(x)
            near = np.empty((len(h), len(h)), bool)
            for s in range(0, len(h), 512):
                near[s : s + 512] = x[s : s + 512] @ x.T >= threshold
            near &= sizes[:, None] == sizes[None, :]
            np.fill_diagonal(near, False)
            if i[0] != j[0]:
                near &= c[:, None] != c[None, :]
            a, b = np.nonzero(near)
            links = ((near & ~shares_earlier(list(lists), cells[0])) * n[None, :]).sum(1) if len(a) else np.zeros(len(h), np.int64)
            root = stars(len(h), a, b)
            own, has = np.flatnonzero(root != np.arange(len(h))), np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([h[own], h[has]])),
                pa.array([*h[root[own]].tolist(), *[None] * len(has)], pa.int64()),
                pa.array([*[None] * len(own), *links[has].tolist()], pa.int64()),
            ], ["a", "b", "links"])

    return rows.mapInArrow(compare, "a bigint, b bigint, links bigint")


def near_duplicates(table: DataFrame, threshold: float = 0.9, trees: int = TREES, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of table (vec_id, embedding).

    Links are the pairs found with a cosine of at least the threshold; component_id is the smallest vec_id reachable.

    Edge cases: embeddings that are null, empty, zero, or hold null or non-finite components link with nothing; those of
    different lengths don't link with each other; equal embeddings always link; a row without vec_id
    links like any other but is never the smallest, so its component_id is null if no linked row has one, and it is not kept;
    repeated rows are rows of their own; an empty table gives no rows; other columns are ignored.
    """
    small_batches(table.sparkSession, 2048)
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(~bad & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = table.select("vec_id", F.when(usable, e).alias("v")).withColumn("d", F.coalesce(F.size("v"), F.lit(-1)))
    dims = rows.agg(F.max("d").alias("d")).first().d
    alone = lambda r: r.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if dims is None or dims <= 0:
        return alone(rows)
    some = rows.where("d > 0").withColumn("h", F.xxhash64("v"))
    classes = settle(some.groupBy("h").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")))
    found = settle(linked(classes, classes.count(), dims, threshold, trees, sample, cell))
    links = found.where("links is not null").groupBy(F.col("a").alias("h")).agg(F.sum("links").alias("links"))
    roots = components(found.where("links is null")).withColumnRenamed("node", "h")
    named = classes.select("h", "first", "n").join(roots, "h", "left").join(links, "h", "left").withColumn("root", F.coalesce("root", "h"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(least, "root").select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return some.select("vec_id", "h").join(of, "h").select("vec_id", "n_links", "component_id", kept).unionByName(alone(rows.where("d <= 0")))


def op10_embedding(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "embeddings"))
