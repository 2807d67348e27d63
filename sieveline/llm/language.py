"""Language ID by segmentation-marginalised unigrams.

A language gives every piece of a fixed public vocabulary a probability. The probability of a word is the sum over
all its segmentations into pieces of the product of theirs, by a forward algorithm; that of a text is the product over
its words. Probabilities are learned by expectation maximisation over the word counts of all training documents:
Spark counts words by language, each round spreads each word's count over its segmentations on the executors
(forward-backward) and sums the pieces. Only the piece table, vocabulary times languages, comes to the driver.
"""

from __future__ import annotations

from collections import Counter
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import read, settle, small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
#: The probabilities of words of so many characters fit a double; those of longer ones are added up as logarithms.
SHORT = 24
#: Parts whose probabilities a Python worker keeps, and words that it counts, before it starts anew.
HELD = 200_000
#: Bytes of texts scored at a time.
BATCH = 1 << 22
#: The least probability of a piece, and that of a character outside the vocabulary.
FLOOR, UNKNOWN = 1e-8, 1e-7
BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a public SentencePiece model in id order, in lower case, each once."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return list(dict.fromkeys(sp.id_to_piece(i).lower() for i in ids))


def parts(text: str | None) -> list[str]:
    """The words of a text in lower case, whole."""
    return (text or "").lower().split()


def summed(logs: list[np.ndarray]) -> np.ndarray:
    """The logarithm of the sum of what these are the logarithms of; all may be -inf."""
    top = np.maximum.reduce(logs)
    with np.errstate(divide="ignore"):
        return np.where(top > -np.inf, top + np.log(sum(np.exp(x - np.where(top > -np.inf, top, 0)) for x in logs)), -np.inf)


class Lattice:
    """Finds the pieces of words of equal length, and runs forward and backward over them all at once."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)  # id size: a character outside the vocabulary; size + 1: no piece
        none = self.size + 1
        self.single = np.full(1 << 21, self.size, np.int32)  # by code point
        # by length: hashes of the beginnings of pieces, and the id of the piece that each is, if it is one
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        starts: dict[int, dict[str, int]] = {}
        for i, p in enumerate(pieces):
            for n in range(2, len(p)):
                starts.setdefault(n, {}).setdefault(p[:n], none)
            if len(p) == 1:
                self.single[ord(p)] = i
            else:
                starts.setdefault(len(p), {})[p] = i
        for n, own in starts.items():
            codes = np.array(list(own), f"U{n}").view(np.uint32).reshape(-1, n).astype(np.uint64)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = h * BASE + codes[:, k]
            order = np.argsort(h)
            self.tables[n] = h[order], np.fromiter(own.values(), np.int32, len(own))[order]

    def edges(self, words: list[str], length: int) -> list[list[tuple[int, np.ndarray]]]:
        """For each end position, the (start, piece id of each word) of the pieces that end there. Longer pieces are only
        looked for where their beginnings were found."""
        codes = np.array([START + w for w in words], f"U{length}").view(np.uint32).reshape(len(words), length)
        found: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(length + 1)]
        first = self.single[codes]
        for s in range(length):
            found[s + 1].append((s, first[:, s]))
        codes = codes.astype(np.uint64)
        # places that are still the beginning of some piece, start by start
        s, w = (x.ravel() for x in np.indices((length, len(words))))
        h = codes.T.ravel().copy()
        for n in range(2, length + 1):
            if n not in self.tables or not len(s):
                break
            fits = s + n <= length
            s, w, h = s[fits], w[fits], h[fits]
            h = h * BASE + codes[w, s + n - 1]
            keys, ids = self.tables[n]
            at = np.searchsorted(keys, h).clip(0, len(keys) - 1)
            alive = keys[at] == h
            s, w, h, got = s[alive], w[alive], h[alive], ids[at[alive]]
            is_piece = got <= self.size
            cuts = np.searchsorted(s, np.arange(length + 1))
            for k in range(length - n + 1):
                own = slice(cuts[k], cuts[k + 1])
                if is_piece[own].any():
                    column = np.full(len(words), self.size + 1, np.int32)
                    column[w[own]] = got[own]
                    found[k + n].append((k, column))
        return found

    def forward(self, edges, table: np.ndarray) -> list[np.ndarray]:
        """table: (pieces + 2, languages). The summed probability of each prefix."""
        n = len(edges[-1][0][1])
        alpha = [np.ones((n, table.shape[1]))]
        for end in edges[1:]:
            alpha.append(sum(alpha[s] * table[ids] for s, ids in end))
        return alpha

    def forward_logs(self, edges, logs: np.ndarray) -> list[np.ndarray]:
        """The same by logarithms, for words of any length."""
        alpha = [np.zeros((len(edges[-1][0][1]), logs.shape[1]))]
        for end in edges[1:]:
            alpha.append(summed([alpha[s] + logs[ids] for s, ids in end]))
        return alpha

    def log_probability(self, words: list[str], length: int, table: np.ndarray) -> np.ndarray:
        """(words, languages); length: of each word with its start mark."""
        edges = self.edges(words, length)
        if length <= SHORT + 1:
            return np.log(np.maximum(self.forward(edges, table)[-1], 1e-300))
        with np.errstate(divide="ignore"):
            return self.forward_logs(edges, np.log(table))[-1]

    def expected(self, edges, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The expected number of uses of each piece, if word i is seen counts[i] times; table has one language."""
        out = np.zeros(self.size + 2)
        if len(edges) > SHORT + 2:
            with np.errstate(divide="ignore"):
                logs = np.log(table)
            alpha = self.forward_logs(edges, logs)
            # the parts of each beta, and from the end on the beta itself, as logarithms
            beta = [[] for _ in edges]
            beta[-1] = [np.log(counts)[:, None] - alpha[-1]]
            for e in range(len(edges) - 1, 0, -1):
                own = summed(beta[e]) if beta[e] else np.full_like(alpha[0], -np.inf)
                beta[e] = []
                for s, ids in edges[e]:
                    through = logs[ids] + own
                    beta[s].append(through)
                    out += np.bincount(ids, np.exp(alpha[s] + through)[:, 0], self.size + 2)
            return out
        alpha = self.forward(edges, table)
        beta = [np.zeros_like(alpha[0]) for _ in edges]
        beta[-1] += counts[:, None] / np.maximum(alpha[-1], 1e-300)
        for e in range(len(edges) - 1, 0, -1):
            for s, ids in edges[e]:
                through = table[ids] * beta[e]
                beta[s] += through
                out += np.bincount(ids, (alpha[s] * through)[:, 0], self.size + 2)
        return out


@cache
def lattice(pieces: tuple[str, ...]) -> Lattice:
    return Lattice(list(pieces))


def by_length(found: list[str], most: int = 20_000):
    """Indexes of words of equal length, with their start mark, a bounded number of characters at a time."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        step = max(1, most * SHORT // max(n, SHORT))
        for k in range(0, len(at), step):
            yield n + 1, at[k : k + step]


def gathered(batches, size, most: int):
    """Tables of consecutive batches whose sizes together reach `most`: numpy is slow on a few words at a time."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += size(b)
        if total >= most:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n over the texts of all rows; rows without lang or text count nothing."""

    def run(batches):
        held: Counter = Counter()

        def out():
            keys = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()
            return batch

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                lang = lang.as_py()
                for w, n in Counter(parts(text.as_py())).items():
                    held[lang, w] += n
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    some = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return some.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str = VOCABULARY, rounds: int = 2) -> tuple[list[str], tuple[str, ...], np.ndarray]:
    """Languages in order, pieces, and the table of probabilities (pieces + 2, languages) learned from all of docs."""
    pieces = tuple(vocabulary(path))
    counts = settle(count_words(docs))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    table = np.full((len(pieces) + 2, len(langs)), 1 / len(pieces))
    for _ in range(rounds if langs else 0):
        table[-2], table[-1] = UNKNOWN, 0

        def run(batches, table=table):
            net = lattice(pieces)
            sums = np.zeros((len(langs), len(pieces) + 2))
            for t in gathered(batches, lambda b: b.num_rows, HELD):
                of = np.array([langs.index(x) for x in t.column(0).to_pylist()], np.int64)
                found, n = t.column(1).to_pylist(), t.column(2).to_numpy().astype(float)
                for k in np.unique(of).tolist():
                    own = np.flatnonzero(of == k)
                    for length, at in by_length([found[i] for i in own]):
                        at = own[at]
                        sums[k] += net.expected(net.edges([found[i] for i in at], length), table[:, [k]], n[at])
            k, i = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(sums[k, i])], ["k", "i", "x"])

        rows = counts.select("lang", "word", "n").mapInArrow(run, "k int, i int, x double").groupBy("k", "i").agg(F.sum("x").alias("x")).toPandas()
        table = np.full_like(table, 0.01)
        np.add.at(table, (rows.i.to_numpy(), rows.k.to_numpy()), rows.x.to_numpy())
        table[-1] = 0
        table = np.maximum(table / table.sum(0), FLOOR)
        table[-2], table[-1] = UNKNOWN, 0
    return langs, pieces, table


def predict(docs: DataFrame, langs: list[str], pieces: tuple[str, ...], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (the share of the best language's probability)."""

    def run(batches):
        net, held, logs = lattice(pieces), {}, np.zeros((0, len(langs)))

        def score(texts):
            nonlocal logs
            words = [parts(t) for t in texts]
            flat = list(chain.from_iterable(words))
            if len(held) > HELD:
                held.clear()
                logs = logs[:0]
            new = list(set(flat) - held.keys())
            more = np.empty((len(new), len(langs)))
            for length, at in by_length(new):
                more[at] = net.log_probability([new[i] for i in at], length, table)
            held.update(zip(new, range(len(logs), len(logs) + len(new)), strict=True))
            logs = np.concatenate([logs, more])
            ends = np.cumsum([len(x) for x in words])
            sums = np.concatenate([np.zeros((1, len(langs))), np.cumsum(logs[np.fromiter(map(held.__getitem__, flat), np.int64, len(flat))], 0)])
            totals = sums[ends] - sums[ends - [len(x) for x in words]]
            best = totals.argmax(1) if langs else None
            share = 1 / np.exp(totals - totals.max(1, keepdims=True)).sum(1) if langs else None
            for k, t in enumerate(texts):
                if not langs or not any(map(str.isalpha, t or "")):
                    yield "und", 0.0
                else:
                    yield langs[best[k]], round(float(share[k]), 6)

        for t in gathered(batches, lambda b: b.column(1).nbytes, BATCH):
            done = list(score(t.column(1).to_pylist()))
            yield from pa.table([t.column(0), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.float64())], ["doc_id", "lang_pred", "score"]).to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def fold(folds: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds))


def language_id(docs: DataFrame, path: str = VOCABULARY, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that are not held out.

    Edge cases: texts that are null or have no letter are `und` with score 0, and so is everything if no row has both a
    lang and a text to learn from; a null doc_id counts as an empty one; rows with the same doc_id are each scored;
    words of any length are used whole; an empty table gives no rows; other columns are ignored. The best
    of equally probable languages is the first by name.
    """
    small_batches(docs.sparkSession)
    model = fit(docs.where(fold(folds) != held), path)
    return predict(docs, *model).withColumn("held_out", fold(folds) == held).select("doc_id", "held_out", "lang_pred", "score")


def op2_language(spark, sf_dir):
    return language_id(read(spark, sf_dir, "documents"))
