"""SimHash near-duplicates found with BK-trees.

Fingerprints are made a document at a time, in numpy. Equal fingerprints are one class, whatever their number, so
only distinct fingerprints are searched. Two fingerprints that differ in at most r bits agree in one of r + 1
blocks, so the trees are sharded by (block, value): every shard that can hold a partner of a fingerprint is one of
the r + 1 shards the fingerprint itself belongs to. In a BK-tree the children of a node are keyed by their integer
Hamming distance to it, and by the triangle inequality a query at distance d from a node need follow only the edges
from d - r to d + r. Trees travel to their queries by the shuffle rather than as broadcasts: shards have no size
bound, and fingerprints of all documents may not pass the driver. A shard above `cell` fingerprints is cut into
chunks and every pair of chunks is searched in a task of its own, so no partner is lost and no task grows with a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import LAST, U, components, discard, may_and_cannot, mix, only, read, settle, small_batches, store

BITS = 64
#: Fingerprints of one shard that are searched as one tree.
CELL = 1024
#: Subtrees of so few members are compared whole.
LEAF = 24
#: Shingles hashed at a time, so that a very long text needs no more memory than a short one beside its own bytes.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the text's word shingles, A-Z lower-cased, in chunks; nothing for a text without words."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(size, len(found))
    first, last = starts[: len(found) - size + 1], ends[size - 1 :]
    for k in range(0, len(first), CHUNK):
        spans = zip(first[k : k + CHUNK].tolist(), last[k : k + CHUNK].tolist(), strict=True)
        yield np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.uint64)


def simhash(text: str | None, size: int) -> int:
    """A bit is 1 if it is set in over half the shingle hashes; 0 for a text without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, size):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def bk_links(tree: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (query, member) of all pairs within the radius. Each subtree is made as the search enters it, and is
    entered once, with all the queries that follow the edge to it."""
    qs, ts = [], []
    todo = [(np.arange(len(tree)), np.arange(len(queries)))] if len(tree) else []
    while todo:
        members, asking = todo.pop()
        if len(members) <= LEAF:
            x, y = np.nonzero(np.bitwise_count(queries[asking][:, None] ^ tree[members][None, :]) <= radius)
            qs.append(asking[x])
            ts.append(members[y])
            continue
        root, rest = members[0], members[1:]
        d = np.bitwise_count(queries[asking] ^ tree[root]).astype(np.int16)
        near = asking[d <= radius]
        if len(near):
            qs.append(near)
            ts.append(np.full(len(near), root))
        if len(rest):
            edge = np.bitwise_count(tree[rest] ^ tree[root]).astype(np.int16)
            order = np.argsort(edge, kind="stable")
            edge, rest = edge[order], rest[order]
            cuts = np.flatnonzero(np.diff(edge)) + 1
            for child in np.split(np.arange(len(rest)), cuts):
                follow = asking[np.abs(d - edge[child[0]]) <= radius]
                if len(follow):
                    todo.append((rest[child], follow))
    none = np.empty(0, np.int64)
    return (np.concatenate(qs), np.concatenate(ts)) if qs else (none, none)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches by the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def grouped(batches, keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows whose first `keys` columns are equal; input is sorted by them."""
    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        for s, e in zip([0, *at[:-1]], at, strict=False) if len(at) else ():
            yield [c[s:e] for c in cols]
        last = at[-1] if len(at) else 0
        held = [c[last:] for c in cols]
    if held is not None and len(held[0]):
        yield held


def shard_links(prints: DataFrame, radius: int, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join all those within the radius: for every tree that is
    searched, its linked fingerprints hang below one of them. Their transitive closure is that of all links."""
    width, rows = BITS // (radius + 1), []
    for k in range(radius + 1):
        low = k * width
        bits = BITS - low if k == radius else width
        rows.append(F.struct(F.lit(k).alias("block"), F.expr(f"shiftrightunsigned(fp, {low})").bitwiseAND(F.lit((1 << bits) - 1)).alias("value")))
    shards = prints.select("fp", F.inline(F.array(*rows)))
    sizes = shards.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shards = shards.join(sizes, ["block", "value"]).withColumn("g", F.ceil(F.col("n") / cell).cast("int")).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j")))
    cells = shards.select("block", "value", F.inline(pairs), "c", "fp")
    cells = cells.repartition("block", "value", "i", "j").sortWithinPartitions("block", "value", "i", "j")

    def run(batches):
        a, b, held = [], [], 0
        for _, _, i, j, c, fp in grouped((x.select(["block", "value", "i", "j", "c", "fp"]) for x in batches), 4):
            fp = fp.view(np.uint64)
            if len(fp) < 2:
                continue
            t = np.flatnonzero(c == i[0])
            q = np.flatnonzero(c == j[0])
            x, y = bk_links(fp[t], fp[q], radius)
            root = stars(len(fp), q[x], t[y])
            own = np.flatnonzero(root != np.arange(len(fp)))
            a.append(fp[own].view(np.int64))
            b.append(fp[root[own]].view(np.int64))
            held += len(own)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return cells.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs.

    Rows link if their fingerprints differ in at most `radius` bits; component_id is the smallest doc_id reachable.

    Edge cases: null and empty texts have the fingerprint zero and link like any other; texts with fewer words than a
    shingle are one shingle; rows without doc_id are kept, and count for reaching others but not for the smallest id
    (null if a whole component has none); repeated rows each give their row; an empty table gives no rows; other
    columns of docs are ignored.
    """
    small_batches(docs.sparkSession)
    prints = settle(fingerprints(docs, shingle))
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(shard_links(classes.select("fp"), radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


#: keep_one: fingerprints of a document; blocks of each, of which one must be equal; the radius in which that fingerprint must
#: agree; the most of all their bits that may differ. They only search: sets of Jaccard similarity 0.8 have a cosine of 8/9, so
#: a bit differs with probability arccos(8/9) / pi = 0.15, and of independent bits a pair of 0.8 is missed about once in 7,000.
WIDE, WIDE_BLOCKS, WIDE_RADIUS, WIDE_BITS = 4, 8, 14, 80
WIDE_CELL = 4096


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    found = [np.unique(h) for h in shingle_hashes(text, size)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def wide_simhash(shingles: np.ndarray) -> list[int]:
    """WIDE fingerprints as signed longs, from the shingle hashes and hashes of these."""
    ones = np.zeros((WIDE, BITS), np.int64)
    for at in range(0, len(shingles), CHUNK):
        h = shingles[at : at + CHUNK]
        for k in range(WIDE):
            x = h if k == 0 else mix(h + U(k * 0x9E3779B97F4A7C15 % (1 << 64)))
            ones[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def wide_pairs(classes: DataFrame, radius: int, most: int, cell: int, least: bool) -> DataFrame:
    """classes: node, root, f (array of WIDE longs). Pairs (a, b) of nodes of different roots that have one of WIDE_BLOCKS blocks of a
    fingerprint in common, and differ in `radius` bits of it and in `most` of all at most. Sharded and searched like shard_links, for
    each fingerprint. least: of every node that is in a pair, in both ways, only the pair with the least partner."""
    width, rows = BITS // WIDE_BLOCKS, []
    for w in range(WIDE):
        for k in range(WIDE_BLOCKS):
            value = F.shiftrightunsigned(F.get("f", w), k * width).bitwiseAND(F.lit((1 << width) - 1))
            rows.append(F.struct(F.lit(w).alias("w"), F.lit(k).alias("block"), value.alias("value")))
    shards = classes.select("node", "root", "f", F.inline(F.array(*rows)))
    sizes = shards.groupBy("w", "block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shards = shards.join(sizes, ["w", "block", "value"]).withColumn("g", F.ceil(F.col("n") / cell).cast("int")).withColumn("c", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j")))
    keys = ["w", "block", "value", "i", "j"]
    prints = [F.get("f", k).alias(f"f{k}") for k in range(WIDE)]
    cells = shards.select("w", "block", "value", F.inline(pairs), "c", "node", "root", *prints)
    cells = cells.select(*keys, "c", "node", "root", *[f"f{k}" for k in range(WIDE)]).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        for w, _, _, i, j, c, node, root, *f in grouped(batches, 5):
            if len(node) < 2:
                continue
            f = [x.view(np.uint64) for x in f]
            t, q = np.flatnonzero(c == i[0]), np.flatnonzero(c == j[0])
            for at in range(0, len(q), CELL):
                x, y = bk_links(f[w[0]][t], f[w[0]][q[at : at + CELL]], radius)
                x, y = q[at + x], t[y]
                near = root[x] != root[y]
                near &= sum(np.bitwise_count(v[x] ^ v[y]).astype(np.int32) for v in f) <= most
                a, b = node[x[near]], node[y[near]]
                if least:
                    a, b = np.concatenate([a, b]), np.concatenate([b, a])
                    order = np.lexsort((b, a))
                    a, b = a[order], b[order]
                    new = np.ones(len(a), bool)
                    new[1:] = a[1:] != a[:-1]
                else:
                    a, b = np.minimum(a, b), np.maximum(a, b)
                    new = np.unique(np.stack([a, b], 1), axis=0, return_index=True)[1]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    out = cells.mapInArrow(run, "a bigint, b bigint")
    if not least:
        return out.distinct()
    out = out.groupBy("a").agg(F.min("b").alias("b"))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) have a Jaccard similarity of 4/5 or more, counted on the sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    # the length bound spares most intersections that can't pass
    both = both.where(5 * F.least(F.size("x"), F.size("y")) >= 4 * F.greatest(F.size("x"), F.size("y")))
    return settle(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = WIDE_RADIUS, most: int = WIDE_BITS, cell: int = WIDE_CELL) -> DataFrame:
    """The rows of docs without near-duplicates: of each group of linked documents the one with the smallest doc_id.

    Documents link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Fingerprints find the pairs, and each
    pair is verified on the sets, so that none below 0.8 links. Pairs are verified in two rounds: of each document that with one
    partner, then all pairs that these links don't join already. A large group of copies so needs few; the components are the same.

    Edge cases: null and empty texts are one group; rows without doc_id come after all others; of rows equal in doc_id
    and text one stays; an empty table gives no rows; all columns are kept as they are.
    """
    small_batches(docs.sparkSession)
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.xxhash64("text", F.col("doc_id").isNull()), F.lit(0)).alias("h")]

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            found = [shingle_set(t.as_py(), shingle) for t in b.column(2)]
            node = np.fromiter((xxh64_intdigest(s.tobytes(), 42) for s in found), np.uint64, len(found)).view(np.int64)
            f = [wide_simhash(s) for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(f, pa.list_(pa.int64()))], ["id", "h", "node", "f"])

    def whole_sets(batches):
        for b in batches:
            for node, text in zip(b.column(0), b.column(1), strict=True):
                s = pa.array([shingle_set(text.as_py(), shingle).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), s], ["node", "shingles"])

    # texts with the same set of shingles are one node
    prints = settle(docs.select(*key, F.col("text").cast("string")).mapInArrow(run, "id bigint, h bigint, node bigint, f array<bigint>"))
    classes = settle(prints.groupBy("node").agg(F.min(F.struct("id", "h")).alias("first"), F.first("f").alias("f")))
    one = settle(wide_pairs(classes.select("node", F.col("node").alias("root"), "f"), radius, most, cell, True))
    asked = settle(one.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node").select("node", "first.*", "f"))
    texts = only(docs.select(*key, F.col("text").cast("string")), asked, ["id", "h"]).join(asked.drop("f"), ["id", "h"])
    sets = store(texts.dropDuplicates(["node"]).select("node", "text").mapInArrow(whole_sets, "node bigint, shingles array<bigint>"))
    links = similar_sets(one, sets)
    joined = asked.select("node", "f").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = similar_sets(settle(wide_pairs(settle(joined), radius, most, cell, False)), sets)
    discard(sets)
    roots = components(links.unionByName(more))
    named = classes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    best = named.join(best, "root").select("node", "best")
    rows = prints.groupBy("id", "h", "node").agg(F.count(F.lit(1)).alias("n")).join(best, "node")
    stays = (F.col("best.id") == F.col("id")) & (F.col("best.h") == F.col("h"))
    # rows that are neither removed nor repeated are not shuffled
    odd = settle(rows.withColumn("stays", stays).where("n > 1 or not stays").select("id", "h", "stays"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    may, cannot = may_and_cannot(whole, odd, ["id", "h"])
    may = may.join(odd, ["id", "h"], "left").where("stays is null or stays")
    may = may.where("stays is null").select("row").unionByName(may.where("stays").dropDuplicates(["id", "h"]).select("row"))
    return cannot.select("row").unionByName(may).select("row.*")
