"""Substring dedup by recompression.

Every text is a sequence of words. A round replaces runs of equal symbols, then pairs of adjacent symbols of which a
hash calls the first left and the second right, by new symbols named after what they replace; a name is a hash of its
parts, so it is the same in every document and no dictionary has to be shared. Equal substrings get equal symbols
except near their ends. A symbol carries the interval of words that its making looked at: if a window holds that
interval, then every occurrence of the window has the symbol. A window's anchor is the widest such symbol in it (ties by
name), or its own fingerprint if it has none, so equal windows always have equal anchors, and no repeat is missed.

Spark then finds the anchors that more than one document has. Runs of windows under one anchor whose words are the same
as a whole are one kind, however many documents have it. Only where an anchor has several kinds are their windows
compared one by one, of one document a kind. All comparisons are of two fingerprints: polynomials over the halves of 128-bit word
hashes, modulo 2^61 - 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import LAST, U, discard, join_counted, mix, only, read, small_batches, store

ROUNDS = 4
#: The most words under one symbol.
WIDEST = 16
#: Words parsed at a time; longer texts are parsed in segments that overlap by a window less one word.
SEGMENT = 1 << 16
#: Random-looking constants of the names.
BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
#: Fingerprints are polynomials modulo this prime, at two fixed points.
PRIME = (1 << 61) - 1
POINTS = (0x1B873593CC9E2D51 % PRIME, 0x165667B19E3779F9 % PRIME)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it: products of halves of 30 and 31 bits fit 64."""
    low = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    middle = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << U(1)) + (middle >> U(30)) + ((middle & U((1 << 30) - 1)) << U(31)) + a0 * b0)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any 64 bits."""
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


class Powers:
    """Powers of a point modulo PRIME, and of its inverse, as far as asked for."""

    def __init__(self, point: int):
        self.points = point, pow(point, -1, PRIME)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up, self.down = (np.concatenate([x, times(x, np.full(k, pow(p, k, PRIME), U))]) for x, p in zip((self.up, self.down), self.points, strict=True))
        return self.up, self.down


POWERS = tuple(map(Powers, POINTS))


def ranged(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A hash of values[start:end] for each start and end that depends on the values alone."""
    up, down = POWERS[which].to(len(values) + 1)
    terms = times(reduced(values), up[: len(values)])
    # halves are summed apart, so that the sums of millions of terms fit
    sums = [np.concatenate([np.zeros(1, U), np.cumsum(x)]) for x in (terms >> U(31), terms & U((1 << 31) - 1))]
    high, low = (reduced(x[ends] - x[starts]) for x in sums)
    total = reduced(times(high, np.full(len(high), 1 << 31, U)) + low)
    return mix(times(total, down[starts]) + (ends - starts).astype(U) * BASES[which])


def word_hashes(data: bytes) -> np.ndarray:
    """(words, 2): the two halves of a 128-bit hash of each word."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, data.split())), U).reshape(-1, 2)


def symbols(words: np.ndarray, cuts: np.ndarray, rounds: int = ROUNDS, widest: int = WIDEST):
    """Symbols of segments, words[cuts[k]:cuts[k + 1]] each, as (name, start, end, lo, hi): the words from start to
    end, made by looking at the words from lo to hi, which reach beyond the segment if its end was looked at."""
    n = len(words)
    sym, s, e = words.copy(), np.arange(n), np.arange(1, n + 1)
    lo, hi = s.copy(), e.copy()
    seg = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    for r in range(rounds):
        if not len(sym):
            break
        # runs
        new = np.concatenate([[True], (sym[1:] != sym[:-1]) | (seg[1:] != seg[:-1])])
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(sym)))
        last = first + count - 1
        before = np.where((first > 0) & (seg[first - 1] == seg[first]), lo[first - 1], cuts[seg[first]] - 1)
        after_at = np.minimum(last + 1, len(sym) - 1)
        after = np.where((last + 1 < len(sym)) & (seg[after_at] == seg[last]), hi[after_at], cuts[seg[last] + 1] + 1)
        long = (count > 1) & (e[last] - s[first] > widest)
        one = (count > 1) & ~long
        k = np.arange(len(sym))
        sees_start, sees_end = k - widest < first[run], k + widest > last[run]
        lo_own = np.where(sees_start, before[run], lo[np.maximum(k - widest, 0)])
        hi_own = np.where(sees_end, after[run], hi[np.minimum(k + widest, len(sym) - 1)])
        lo = np.where(long[run], lo_own, before[run])
        hi = np.where(long[run], hi_own, after[run])
        sym = np.where(one[run], mix(sym * U(3) + count[run].astype(U)), sym)
        e = np.where(one[run], e[last][run], e)
        keep = new | long[run]
        sym, s, e, lo, hi, seg = (x[keep] for x in (sym, s, e, lo, hi, seg))
        # pairs
        left = mix(sym + U((r + 1) * int(BASES[1]) % (1 << 64))) >> U(63) == 0
        joined = np.append(seg[1:] == seg[:-1], False)
        following = np.append(np.arange(1, len(sym)), len(sym) - 1)
        pair = joined & left & ~left[following] & (e[following] - s <= widest)
        second = np.concatenate([[False], pair[:-1]])
        has_prev = np.concatenate([[False], joined[:-1]])
        new_hi = np.where(left, np.where(joined, hi[following], cuts[seg + 1] + 1), hi)
        new_lo = np.where(left, lo, np.where(has_prev, lo[np.arange(len(sym)) - 1], cuts[seg] - 1))
        sym = np.where(pair, mix(sym * U(5) + mix(sym[following] + BASES[0])), sym)
        e = np.where(pair, e[following], e)
        sym, s, e, lo, hi, seg = (x[~second] for x in (sym, s, e, new_lo, new_hi, seg))
    return sym, s, e, lo, hi


def anchors(words: np.ndarray, cuts: np.ndarray, window: int):
    """(segment, first window, last window, name, r1): the anchors of the windows of each segment, each run of windows
    with the same anchor once, with a fingerprint of the run's words."""
    ends = np.repeat(cuts[1:], np.diff(cuts))
    at = np.flatnonzero(np.arange(len(words)) + window <= ends)
    sym, s, e, lo, hi = symbols(words, cuts)
    width = (e - s).astype(U)
    value = (width << U(59)) | (mix(sym) >> U(5)) if WIDEST < 31 else mix(sym)
    a, b = np.searchsorted(lo, at, "left"), np.searchsorted(hi, at + window, "right")
    name = (U(31) << U(59)) | (ranged(words, at, at + window, 0) >> U(5))
    some = np.flatnonzero(b > a)
    size = (b - a)[some]
    table = value
    best = np.zeros(len(some), U)
    for k in range(int(size.max(initial=0)).bit_length()):
        own = np.flatnonzero((size >> k) == 1)
        best[own] = np.maximum(table[a[some[own]]], table[b[some[own]] - (1 << k)])
        table = np.maximum(table, np.append(table[1 << k :], np.zeros(min(1 << k, len(table)), U)))
    name[some] = best
    seg = np.searchsorted(cuts, at, "right") - 1
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (seg[1:] != seg[:-1])]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return seg[first], at[first], at[last], name[first], ranged(words, at[first], at[last] + window, 0)


def find_anchors(docs: DataFrame, window: int) -> DataFrame:
    """docs: id, h, text. Rows (id, h, name, lo, hi, r1, r2): the windows lo to hi of the text have the anchor, and r1 and
    r2 are a 128-bit fingerprint of their words together."""

    def run(batches):
        for b in batches:
            ids, hs = b.column(0).to_numpy(), b.column(1).to_numpy()
            held, more, of, off, size = [], [], [], [], 0

            def out():
                cuts = np.cumsum([0, *map(len, held)])
                seg, lo, hi, name, r1 = anchors(np.concatenate(held), cuts, window)
                r2 = ranged(np.concatenate(more), lo, hi + window, 1)
                d = np.array(of)[seg]
                shift = cuts[seg] - np.array(off)[seg]
                for x in (held, more, of, off):
                    x.clear()
                cols = (ids[d], hs[d], name.view(np.int64), (lo - shift).astype(np.int32), (hi - shift).astype(np.int32), r1.view(np.int64), r2.view(np.int64))
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "h", "name", "lo", "hi", "r1", "r2"])

            for k, t in enumerate(b.column(2)):
                data = (t.as_py() or "").encode("utf-8", "replace")
                both = word_hashes(data)
                if len(both) < window:
                    continue
                words, others = both[:, 0].copy(), both[:, 1].copy()
                for at in range(0, len(words) - window + 1, SEGMENT - window + 1):
                    held.append(words[at : at + SEGMENT])
                    more.append(others[at : at + SEGMENT])
                    of.append(k)
                    off.append(at)
                    size += len(held[-1])
                    if size >= SEGMENT:
                        yield out()
                        size = 0
            if held:
                yield out()

    return docs.select("id", "h", "text").mapInArrow(run, "id bigint, h bigint, name bigint, lo int, hi int, r1 bigint, r2 bigint")


def window_prints(docs: DataFrame, window: int) -> DataFrame:
    """docs: id, h, text, runs (kind, lo, hi). Rows (f1, f2, kind, id, at): a 128-bit fingerprint of the words of each
    window of the runs; at counts from the run's first window."""

    def run(batches):
        for b in batches:
            runs = b.column(3)
            at = np.cumsum([0, *runs.value_lengths().to_numpy()])
            kind, lo, hi = (runs.flatten().field(k).to_numpy() for k in range(3))
            for k, t in enumerate(b.column(2)):
                data = t.as_py().encode("utf-8", "replace")
                one, two = word_hashes(data).T.copy()
                for s in range(at[k], at[k + 1], 4096):
                    own = np.arange(s, min(s + 4096, at[k + 1]))
                    sizes = hi[own] - lo[own] + 1
                    of = np.repeat(own, sizes)
                    offset = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    pos = lo[of] + offset
                    cols = (ranged(one, pos, pos + window, 0).view(np.int64), ranged(two, pos, pos + window, 1).view(np.int64), kind[of], np.full(len(of), b.column(0)[k].as_py()), offset.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["f1", "f2", "kind", "id", "at"])

    return docs.select("id", "h", "text", "runs").mapInArrow(run, "f1 bigint, f2 bigint, kind bigint, id bigint, at int")


def remove(marked: DataFrame, window: int, text: bool) -> DataFrame:
    """marked: id, h, text and the runs (lo, hi) of windows to remove. Rows (id, h, n_removed, kept_sha256, kept)."""

    def run(batches):
        for b in batches:
            runs = b.column(3)
            cut = np.cumsum([0, *runs.value_lengths().to_numpy()])
            lo, hi = (runs.flatten().field(k).to_numpy() for k in range(2))
            rows = []
            for k, t in enumerate(b.column(2)):
                found = t.as_py().encode("utf-8", "replace").split()
                own = np.zeros(len(found) + 1, np.int64)
                np.add.at(own, lo[cut[k] : cut[k + 1]], 1)
                np.add.at(own, hi[cut[k] : cut[k + 1]] + window, -1)
                covered = np.cumsum(own)[:-1] > 0
                kept = b" ".join([w for w, c in zip(found, covered.tolist(), strict=True) if not c])
                rows.append((int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if text else None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["id", "h", "n_removed", "kept_sha256", "kept"])

    return marked.select("id", "h", "text", "runs").mapInArrow(run, "id bigint, h bigint, n_removed bigint, kept_sha256 string, kept string")


def _with_text(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    return only(rows.select("id", "h", "text"), keyed, ["id", "h"]).dropDuplicates(["id", "h"]).join(keyed, ["id", "h"])


def dedup_substrings(docs: DataFrame, window: int = 50, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs, with text also the kept text (words joined by spaces
    where something was removed).

    A word is removed if it lies in a window of `window` words whose sequence of words also starts in a
    document with a smaller doc_id. Windows are judged on the input.

    Edge cases: null and empty texts, and texts shorter than a window, lose nothing; a null doc_id counts as larger than any
    other, and rows without doc_id do not count as smaller than each other; rows with equal doc_id are not compared
    with each other; an empty table gives no rows; texts of any length are parsed whole; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), F.col("text").cast("string").alias("text"))
    found = store(find_anchors(rows, window))
    common = store(found.groupBy("name").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("name", "n"))
    shared = store(join_counted(only(found, common, ["name"]), common, ["name"]).drop("n"))
    discard(found)
    # runs of windows with equal words are one kind; in all its documents but the first every window is a repeat
    same = ["name", "r1", "r2"]
    kinds = store(shared.groupBy(*same).agg(F.min(F.struct("id", "h", "lo", "hi")).alias("rep"), F.count(F.lit(1)).alias("n")).select(*same, "rep.*", "n"))
    repeats = join_counted(shared, kinds.select(*same, F.col("id").alias("first"), "n"), same).where("id > first").select("id", "h", "lo", "hi")
    # the first document of a kind can repeat windows of another kind with the same anchor
    several = kinds.groupBy("name").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("name")
    reps = store(kinds.join(several, "name").groupBy("id", "h").agg(F.collect_list(F.struct(F.xxhash64(*same).alias("kind"), "lo", "hi")).alias("runs")))
    prints = store(window_prints(_with_text(rows, reps), window))
    least = prints.groupBy("f1", "f2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("f1", "f2", "first")
    later = prints.join(least, ["f1", "f2"]).where("id > first").select("kind", "id", "at")
    others = shared.withColumn("kind", F.xxhash64(*same)).join(later, ["kind", "id"]).select("id", "h", (F.col("lo") + F.col("at")).alias("lo"), (F.col("lo") + F.col("at")).alias("hi"))
    # a set, since rows that are equal in doc_id and text have the same runs
    marked = store(repeats.unionByName(others).groupBy("id", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")))
    discard(shared, kinds, reps, prints)
    changed = remove(_with_text(rows, marked), window, text)

    def whole(batches):
        for b in batches:
            rows = []
            for t in b.column(3):
                found = (t.as_py() or "").encode("utf-8", "replace").split()
                rows.append((len(found), hashlib.sha256(b" ".join(found)).hexdigest()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), *b.columns[4:]], ["doc_id", "id", "h", "n_words", "all_sha256", *(["text"] if text else [])])

    kind = docs.schema["doc_id"].dataType.simpleString()
    every = rows.select("doc_id", "id", "h", "text", *([F.col("text").alias("whole")] if text else []))
    every = every.mapInArrow(whole, f"doc_id {kind}, id bigint, h bigint, n_words bigint, all_sha256 string" + (", text string" if text else ""))
    out = every.join(changed, ["id", "h"], "left")
    cols = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256")]
    return out.select(*cols, *([F.coalesce("kept", "text").alias("kept_text")] if text else []))


def op7_substring(spark, sf_dir):
    return dedup_substrings(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS lo FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
f AS (SELECT h.doc_id, h.i FROM h JOIN m ON h.k = m.k AND m.lo < h.doc_id),
g AS (SELECT DISTINCT doc_id, i + o AS p FROM f, (SELECT unnest(range(0, 50)) AS o) t),
r AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n_words, len(coalesce(ps, [])) AS n_removed,
        CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END AS kept
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
