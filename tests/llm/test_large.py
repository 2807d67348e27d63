"""Long texts, many spans, and inputs that simple hashes don't tell apart."""

import random

import numpy as np
import pyarrow as pa
from cases import table, words

from sieveline.llm import embedding, language, linededup, pii, quality, secret_scan, substring


def thue_morse(n):
    return [bin(k).count("1") % 2 for k in range(n)]


def test_words_that_polynomials_modulo_powers_of_two_mix_up(spark):
    one = "".join("ab"[x] for x in thue_morse(1024))
    two = "".join("ba"[x] for x in thue_morse(1024))
    common = words(random.Random(3), 49)
    rows = [(1, " ".join([*common, one])), (2, " ".join([*common, two])), (3, " ".join([*common, one]))]
    got = {r.doc_id: r.n_removed for r in substring.dedup_substrings(table(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_runs_of_words_that_polynomials_modulo_powers_of_two_mix_up():
    one = substring.word_hashes(" ".join(["x", "y"][k] for k in thue_morse(4096)).encode())
    two = substring.word_hashes(" ".join(["y", "x"][k] for k in thue_morse(4096)).encode())
    for which in (0, 1):
        a, b = (substring.ranged(x[:, which].copy(), np.array([0]), np.array([4096]), which) for x in (one, two))
        assert a != b


def test_products_modulo_the_prime():
    rng = random.Random(4)
    a, b = ([rng.randrange(substring.PRIME) for _ in range(500)] + [0, 1, substring.PRIME - 1] for _ in range(2))
    got = substring.times(np.array(a, np.uint64), np.array(b, np.uint64))
    assert got.tolist() == [x * y % substring.PRIME for x, y in zip(a, b, strict=True)]


def test_many_equal_rows_are_one_text(spark):
    rng = random.Random(5)
    text = " ".join(words(rng, 120))
    got = substring.dedup_substrings(table(spark, [(1, text), *[(2, text)] * 2000])).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 120, 2000)]


def test_thousands_of_spans(spark):
    n = 20_000
    mails = [f"u{k}@m{k % 7}.example.com" for k in range(n)]
    found = pii.find_pii(table(spark, [(1, " ".join(mails))])).first().pii
    at = np.cumsum([0, *[len(m) + 1 for m in mails]])
    assert [(x.start, x.end) for x in found] == [(int(a), int(a) + len(m)) for a, m in zip(at, mails, strict=False)]
    keys = [f"token = 'abcdef{k:06d}'" for k in range(n)]
    found = secret_scan.find_secrets(table(spark, [(1, " ".join(keys)), (2, "nothing")])).where("doc_id = 1").first().secrets
    assert [x.start for x in found] == [k * (len(keys[0]) + 1) for k in range(n)]


def test_context_is_whole_words(spark):
    rows = [(1, "ship to 10.0.0.1"), (2, "server 10.0.0.1"), (3, "hostel 123-45-6789"), (4, "ssn 123-45-6789")]
    got = {r.doc_id: [(x.kind, round(x.score, 2)) for x in r.pii] for r in pii.find_pii(table(spark, rows)).collect()}
    assert got == {1: [("ip", 0.6)], 2: [("ip", 0.8)], 3: [], 4: [("ssn", 0.8)]}


def test_context_across_chunks(spark):
    pad = "x" * (4096 - 10)
    got = pii.find_pii(table(spark, [(1, f"{pad} ssn is 123-45-6789 ok"), (2, f"{pad}{pad} 123-45-6789 ssn")])).collect()
    assert [[x.kind for x in r.pii] for r in got] == [["ssn"], ["ssn"]]


def test_long_words_are_whole():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    net = language.Lattice(pieces)
    rng = random.Random(6)
    table_ = np.array([[rng.uniform(0.01, 0.2) for _ in range(2)] for _ in pieces] + [[0.01, 0.02], [0.0, 0.0]])
    word = "".join(rng.choice("abz") for _ in range(60))

    def brute(w, lang):
        sums = [1.0]
        for e in range(1, len(w) + 1):
            sums.append(sum(sums[s] * (table_[pieces.index(w[s:e]), lang] if w[s:e] in pieces else table_[-2, lang] if e - s == 1 else 0) for s in range(e)))
        return np.log(sums[-1])

    got = net.log_probability([word], len(word) + 1, table_)[0]
    assert np.allclose(got, [brute("▁" + word, k) for k in (0, 1)])
    edges = net.edges([word], len(word) + 1)
    uses = net.expected(edges, table_[:, :1], np.array([3.0]))
    # every character is covered three times, whatever the segmentation
    assert abs(sum(u * len(p) for u, p in zip(uses, [*pieces, "z"], strict=False)) - 3 * (len(word) + 1)) < 1e-6
    assert np.isfinite(net.log_probability(["a" * 5000], 5001, table_)).all()


def test_vectors_of_each_length_link(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=8).tolist(), rng.normal(size=12).tolist()
    rows = [(1, a), (2, a), (3, b), (4, b), (5, [x * 2 for x in b]), (6, a[:7]), (7, [*a, 0.0, 0.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6), 7: (0, 7)}


def test_cells_in_common():
    lists = [np.array([1, 5]), np.array([5, 9]), np.array([1, 2]), np.array([9])]
    assert embedding.shares_earlier(lists, 9).astype(int).tolist() == [[1, 1, 1, 0], [1, 1, 0, 0], [1, 0, 1, 0], [0, 0, 0, 0]]
    assert embedding.matrix(pa.array([[1.0], [2.0, 3.0]]))[0].tolist() == [[1, 0], [2, 3]]


def test_network_is_embedding_filters_max_and_mean():
    rng = np.random.default_rng(8)
    net = quality.Net(rng.normal(size=(256, quality.DIMS)), rng.normal(size=(quality.STEP * quality.DIMS, 2 * quality.FILTERS)), rng.normal(size=quality.FILTERS), rng.normal(size=2 * quality.FILTERS), rng.normal(size=1))
    x = quality.chunks("".join(chr(97 + k % 23) for k in range(1200)))
    best = []
    for chunk in x:
        e = [net.embed[b] for b in chunk]
        steps = [np.concatenate(e[k : k + quality.STEP]) for k in range(0, quality.CHUNK, quality.STEP)]
        best.append([max(0, max(steps[k] @ net.near[:, f] + steps[k + 1] @ net.near[:, quality.FILTERS + f] + net.bias[f] for k in range(len(steps) - 1))) for f in range(quality.FILTERS)])
    best = np.array(best)
    want = 1 / (1 + np.exp(-np.clip(np.concatenate([best.max(0), best.mean(0)]) @ net.out + net.shift[0], -30, 30)))
    act = quality.pooled(net, x)
    assert np.allclose(quality.probability(net, np.concatenate([act.max(0), act.mean(0)])[None])[0], want)


def test_groups_of_alike_lines(spark):
    """Many variants of one line, of which some are only similar to others than their neighbours, against all pairs."""
    rng = random.Random(9)
    base = words(rng, 30)
    rows = [(k, "\n".join(" ".join(w if rng.random() > 0.07 else rng.choice(base) + str(k) for w in base) for _ in range(2)) + "\nshort line\n") for k in range(80)]
    flat = [(d, no, set(line.split())) for d, t in rows for no, line in enumerate(t.split("\n")) if line]
    want = {}
    for k, (d, _, s) in enumerate(flat):
        want[d] = want.get(d, 0) + any(9 * len(s & o) >= 4 * (len(s) + len(o)) for *_, o in flat[:k])
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(table(spark, rows)).collect()}
    assert got == want
