"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over chunks that overlap and together cover the whole document, each chunk
keeps the largest response of each filter, and the document's largest and mean responses are combined into one
probability. The network is fitted on the driver on a bounded sample of labelled rows and applied by the executors.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.llm.common import read, small_batches
from sieveline.llm.language import fold

#: Bytes of a chunk and from one chunk to the next; bytes of a step; a filter sees two steps.
CHUNK, HOP, STEP = 512, 448, 4
DIMS, FILTERS = 8, 32
#: The most labelled rows of each class that a fit uses, the most bytes of their texts, its steps and rows a step.
FIT_ROWS, FIT_BYTES, FIT_STEPS, FIT_BATCH = 2000, 1 << 16, 500, 48
#: Chunks scored at a time.
BATCH = 1024
THRESHOLD = 0.3


class Net(NamedTuple):
    embed: np.ndarray  # (256, DIMS)
    near: np.ndarray  # (STEP * DIMS, 2 * FILTERS): each filter's halves
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,)
    shift: np.ndarray  # (1,)


def chunks(text: str | None) -> np.ndarray:
    """(chunks, CHUNK) bytes that cover the whole text; zeros after its end; one chunk for an empty text."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = 1 + max(0, -(-(len(data) - CHUNK) // HOP))
    padded = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


def responses(net: Net, x: np.ndarray) -> np.ndarray:
    """(chunks, positions, FILTERS) before the maximum."""
    steps = net.embed[x].reshape(len(x), CHUNK // STEP, STEP * DIMS)
    halves = steps @ net.near
    return halves[:, :-1, :FILTERS] + halves[:, 1:, FILTERS:] + net.bias


def pooled(net: Net, x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.maximum(responses(net, x[k : k + BATCH]).max(1), 0) for k in range(0, len(x), BATCH)])


def probability(net: Net, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ net.out + net.shift, -30, 30)))


def fit_net(x: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Net:
    """Adam on the weighted cross-entropy; gradients pass the maxima to the positions that gave them."""
    rng = np.random.default_rng(seed)
    net = Net(*(a.astype(np.float32) for a in (rng.normal(0, 0.5, (256, DIMS)), rng.normal(0, 0.15, (STEP * DIMS, 2 * FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.05, 2 * FILTERS), np.zeros(1))))
    if len(y) == 0 or (y == y[0]).all():  # nothing to tell apart: the share of label 1 with one of each added
        share = (y.sum() + 1) / (len(y) + 2)
        return net._replace(out=net.out * 0, shift=np.array([np.log(share / (1 - share))], np.float32))
    m, v = [[np.zeros_like(a) for a in net] for _ in range(2)]
    for t in range(1, FIT_STEPS + 1):
        at = rng.integers(0, len(y), FIT_BATCH)
        sizes = np.array([len(x[i]) for i in at])
        own = np.repeat(np.arange(len(at)), sizes)
        first = np.cumsum(sizes) - sizes
        b = np.concatenate([x[i] for i in at])
        r = responses(net, b)
        pos = r.argmax(1)
        top = np.take_along_axis(r, pos[:, None, :], 1)[:, 0]
        act = np.maximum(top, 0)
        most = np.maximum.reduceat(act, first)
        f = np.concatenate([most, np.add.reduceat(act, first) / sizes[:, None]], 1)
        d = (probability(net, f) - y[at]) * weight[at] / len(at)
        df = d[:, None] * net.out
        da = df[own, FILTERS:] / sizes[own, None] + df[own, :FILTERS] * (act == most[own])
        da = (da * (top > 0)).astype(np.float32)  # (chunks, FILTERS)
        steps = net.embed[b].reshape(len(b), CHUNK // STEP, STEP * DIMS)
        rows = np.arange(len(b))[:, None]
        g_near, g_embed = np.zeros_like(net.near), np.zeros_like(net.embed)
        cells = b.reshape(len(b), CHUNK // STEP, STEP)
        for half in (0, 1):
            cols = slice(half * FILTERS, (half + 1) * FILTERS)
            g_near[:, cols] = np.einsum("cf,cfk->kf", da, steps[rows, pos + half])
            back = da[:, :, None] * net.near[:, cols].T[None]
            np.add.at(g_embed, cells[rows, pos + half].reshape(-1), back.reshape(-1, DIMS))
        grads = (g_embed, g_near, da.sum(0), f.T @ d + 1e-4 * net.out, d.sum(keepdims=True))
        rate = 0.01 * min(1, 2 - 2 * t / FIT_STEPS)
        new = []
        for k, (a, g) in enumerate(zip(net, grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            new.append((a - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32))
        net = Net(*new)
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, folds: int = 5, held: int = 0) -> Net:
    """A network for labels.quality. At most `rows` labelled rows of each class, those with the least md5 of doc_id, are used, whole,
    but for those above FIT_BYTES; they are weighed so that the classes keep their shares."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(folds) != held))
    shares = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [usable.where(F.col("quality") == q).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows) for q in (0, 1)]
    sample = parts[0].unionByName(parts[1])  # at most 2 * rows narrow rows, so a broadcast of a known size

    def take(batches):
        for b in batches:
            out = [chunks(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], ["doc_id", "quality", "data"])

    some = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    # rows that repeat a doc_id teach once, so that what comes to the driver stays bounded
    some = some.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES).dropDuplicates(["doc_id"])
    got = some.mapInArrow(take, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, data binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.quality, r.data))
    y = np.array([r.quality for r in got], float)
    n = {q: max(1, (y == q).sum()) for q in (0, 1)}
    weight = np.array([shares[int(q)] / n[q] for q in y])
    weight = weight / weight.mean() if len(y) else weight
    return fit_net([np.frombuffer(r.data, np.uint8).reshape(-1, CHUNK) for r in got], y, weight)


def score(docs: DataFrame, net: Net, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, then the columns in keep, of every row."""

    def run(batches):
        for b in batches:
            scores, held, sizes = [], [], []

            def out():
                if not sizes:
                    return
                first = np.cumsum(sizes) - sizes
                act = pooled(net, np.concatenate(held))
                f = np.concatenate([np.maximum.reduceat(act, first), np.add.reduceat(act, first) / np.array(sizes)[:, None]], 1)
                scores.extend(probability(net, f.astype(np.float64)).round(6).tolist())
                held.clear()
                sizes.clear()

            for t in b.column(1):
                held.append(chunks(t.as_py()))
                sizes.append(len(held[-1]))
                if sum(sizes) >= BATCH:
                    out()
            out()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), *b.columns[2:]], names)

    names = ["doc_id", "score", *(f"kept_{i}" for i in range(len(keep)))]
    cols = [F.col("doc_id"), F.col("text").cast("string"), *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names[2:], strict=True))]
    some = docs.select(*cols)
    kinds = [some.schema[0].dataType.simpleString(), "double", *(f.dataType.simpleString() for f in some.schema[2:])]
    return some.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; learned from labels of rows that are not held out.

    Edge cases: null and empty texts are one chunk of zeros and get that chunk's score; without labels of both
    classes every score is the smoothed share of label 1; labels other than 0 and 1, and labels or documents without
    doc_id, teach nothing, and the latter are scored; repeated rows are each scored; texts of any length are scored whole, a bounded number of
    chunks at a time; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    out = score(docs, fit(docs, labels, folds=folds, held=held)).withColumn("held_out", fold(folds) == held)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is at least THRESHOLD; all columns as they are. Edge cases as in quality."""
    small_batches(docs.sparkSession)
    scored = score(docs, fit(docs, labels), tuple(docs.columns)).where(F.col("score") >= THRESHOLD)
    return scored.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op3_quality(spark, sf_dir):
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
