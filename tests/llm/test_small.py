"""Operators against brute force on small tables that hold nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from cases import odd_rows, table, words

from sieveline.llm import common, decontaminate, embedding, language, linededup, mixing, pii, quality, secret_scan, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(n, pairs):
    own = list(range(n))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        own[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_words(spark):
    from pyspark.sql import functions as F

    texts = [r[1] for r in odd_rows()] + ["a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a\tb\x0bc\fd\re", "\n", "é\xa0x y", "a \nb"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", common.words(F.col("t")).alias("w")).collect()
    assert {r.k: r.w for r in got} == {k: WORD.findall(t or "") for k, t in enumerate(texts)}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(400, k) for k in range(401, 480)] + [(k, k + 1) for k in range(500, 560)]
    want = roots(600, pairs)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 1


def test_mix(spark):
    docs = table(spark)
    rows = mixing.mix(docs, keep=["text", "n_chars"]).collect()
    assert len(rows) == docs.count()
    sizes, by = [len(WORD.findall(r.text or "")) for r in rows], {}
    assert [r["size"] for r in rows] == sizes
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s or "")), [5, 2, 1, 5], strict=True))
    total, own = sum(sizes), {s: sum(r["size"] for r in x) for s, x in by.items()}
    target, free = {}, set(by)
    while True:
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 3 * own[s]}
        if not over:
            break
        target |= {s: 3.0 * own[s] for s in over}
        free -= over
    target |= {s: weights[s] * level for s in free}
    for s, x in by.items():
        assert abs(x[0].target - target[s]) < 1e-6 and x[0].source_size == own[s]
        assert sum(r.taken for r in x) == math.floor(x[0].target)
    key = lambda r: (r.doc_id is None, r.doc_id, r["size"], r.taken)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(docs.limit(0)).count() == 0


# 2


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab"]
    net = language.Lattice(pieces)
    table_ = np.array([[0.1 + 0.05 * k] for k in range(len(pieces))] + [[0.01], [0.0]])
    p = {x: table_[k, 0] for k, x in enumerate(pieces)}

    def brute(w):
        return sum(p.get(w[:n], 0.01 if n == 1 else 0) * brute(w[n:]) for n in range(1, len(w) + 1)) if w else 1.0

    for group in (["ab", "ba", "bb"], ["abab", "babb", "azab"]):
        got = net.forward(net.edges(group, len(group[0]) + 1), table_)[-1][:, 0]
        assert np.allclose(got, [brute("▁" + w) for w in group])
    # each use of a piece is counted by the share of segmentations that have it
    uses = net.expected(net.edges(["ab"], 3), table_, np.array([2.0]))
    ways = [("▁", "a", "b"), ("▁", "ab"), ("▁a", "b")]
    mass = [math.prod(p[x] for x in w) for w in ways]
    want = {x: 2 * sum(m for m, w in zip(mass, ways, strict=True) if x in w) / sum(mass) for x in pieces}
    assert all(abs(uses[k] - want[x]) < 1e-9 for k, x in enumerate(pieces))


def test_language(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(words(rng, 30, "aeiou" if k % 2 else "bcdfg")), "vo" if k % 2 else "co", "s", 0) for k in range(80)]
    rows += [(1000, None, "vo", "s", 0), (1001, "", "co", "s", 0), (1002, "123 !!", None, "s", 0), (None, "aei oua", None, None, None), (1003, "x" * 5000, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in language.language_id(docs).collect()}
    assert len(got) == len(rows) and {got[k].lang_pred for k in (1000, 1001, 1002)} == {"und"}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:80]) and all(0 <= r.score <= 1 for r in got.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(d if d is not None else "").encode()) % 4 == 2) for d, r in got.items())
    assert language.language_id(docs.limit(0)).count() == 0
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in language.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 3


def test_chunks_cover_the_text():
    for n in (0, 1, quality.CHUNK, quality.CHUNK + 1, 5000):
        c = quality.chunks("z" * n)
        back = np.zeros((len(c) - 1) * quality.HOP + quality.CHUNK, np.uint8)
        for k, x in enumerate(c):
            back[k * quality.HOP : k * quality.HOP + quality.CHUNK] = x
        assert bytes(back[:n]) == b"z" * n and not back[n:].any()


def test_quality(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(words(rng, 60)) if k % 3 else "#$% ".join(words(rng, 60))) for k in range(150)]
    docs = table(spark, [*rows, (900, None), (901, ""), (None, "abc")])
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(150)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == 153
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 150]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.9 * len(held) > 10
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert {round(r.score, 3) for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 95 <= kept.count() <= 110


def test_gradients_fit_what_can_be_told_apart():
    rng = np.random.default_rng(0)
    x = [rng.integers(97, 110, (2, quality.CHUNK)).astype(np.uint8) for _ in range(60)]
    for k in range(0, 60, 2):
        x[k][0, 100:104] = 35
    y = np.array([k % 2 for k in range(60)], float)
    net = quality.fit_net(x, y, np.ones(60))
    f = [quality.pooled(net, c) for c in x]
    p = quality.probability(net, np.array([np.concatenate([a.max(0), a.mean(0)]) for a in f]))
    assert ((p > 0.5) == y).mean() > 0.95


# 4


def lines_removed(rows):
    seen, gone = [], {}
    for d, t in sorted(rows):
        for k, line in enumerate(t.split("\n")):
            s = set(WORD.findall(line))
            if len(s) >= 1:
                if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    gone.setdefault(d, set()).add(k)
                seen.append(s)
    return gone


def test_lines(spark):
    rng = random.Random(8)
    base = [words(rng, rng.choice([4, 5, 6, 9, 20, 40])) for _ in range(25)]

    def edit(w):
        return [x if rng.random() > 0.07 else "new" + x for x in w]

    rows = [(k, "\n".join(" ".join(edit(rng.choice(base))) for _ in range(rng.randint(1, 6)))) for k in range(90)]
    gone = lines_removed(rows)
    docs = table(spark, rows)
    got = linededup.dedup_lines(docs).collect()
    assert {r.doc_id: r.n_removed for r in got if r.n_removed} == {d: len(x) for d, x in gone.items()} and len(gone) > 30
    for r in got:
        assert r.text == "\n".join(x for k, x in enumerate(dict(rows)[r.doc_id].split("\n")) if k not in gone.get(r.doc_id, ()))


def test_short_lines(spark):
    rows = [(0, "Les.\na b\na b c\na b c d\n\n \nx x x x x"), (1, "b a\nLes.\nles.\n\nc b a\na b"), (2, "a b c d e\na b d\n \nx\nx y")]
    got = {r.doc_id: r for r in linededup.dedup_lines(table(spark, rows)).collect()}
    assert {d: (r.text, r.n_removed) for d, r in got.items()} == {0: (rows[0][1], 0), 1: ("les.\n", 4), 2: ("a b d\n \nx y", 2)}


def test_few_words(spark):
    """Sets of four to twelve words that differ in a few, at the ends of their order or within it, against all pairs."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(14)]
    rows = [(k, "\n".join(" ".join(rng.sample(base, rng.randint(4, 12)) + [f"z{rng.randint(0, 400)}"] * rng.randint(0, 1)) for _ in range(3))) for k in range(60)]
    gone = lines_removed(rows)
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(table(spark, rows)).collect()}
    assert got == {d: len(gone.get(d, ())) for d, _ in rows} and 10 < len(gone) < 60


def test_long_lines_of_common_words(spark, monkeypatch):
    """Long lines that have words, but no more, in common are told apart before their words are compared."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(rng.sample(base, 170))) for k in range(60)]
    rows.append((60, " ".join(sorted(rows[7][1].split()[:150]))))
    pairs, verified = [], linededup.verified
    monkeypatch.setattr(linededup, "verified", lambda some, *x: pairs.append(some.count()) or verified(some, *x))
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(table(spark, rows)).collect()}
    assert got == {k: int(k == 60) for k in range(61)} and sum(pairs) < 20


def test_lines_of_odd_rows(spark):
    docs = table(spark)
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == docs.count()
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[100][0].text is None and by[100][0].n_lines == 0 and by[101][0].text == "" and by[102][0].n_removed == 0
    assert (by[200][0].n_removed, by[201][0].n_removed, by[303][0].n_removed) == (1, 1, 3) and by[5][0].n_removed == 0
    assert sorted(r.n_removed for r in by[None]) == [0, 1]
    left = linededup.drop_lines(docs)
    assert left.columns == docs.columns and not left.where("doc_id in (200, 201, 303)").count()
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


# 5 and 6

PII = (
    "mail a.b@c.org, a@b@c.d.e x@y z@q..r _@-.-  1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 call +1 (555) 123-4567 or +12 +1 2 card 4111 1111 1111 1111 "
    "4111-1111-1111-1112 0000000000000000 é a@é.com ü b.c+d@e-f.g.h. IBAN GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33 ssn 123-45-6789 and then much later, without any such word nearby, nothing but 987-65-4321"
)


def base_pii(t):
    luhn = lambda d: sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(rules) for m in re.finditer(p, t or "") if ok(m[0]))


def test_pii(spark):
    rng = random.Random(9)
    texts = [PII, None, "", "@" * 50, "1" * 3000, "a" * 20000 + "@b.c", "a@" + "b." * 4000 + "c", "1 " * 4000] + ["".join(rng.choice("ab1290.@+- ()é") for _ in range(200)) for _ in range(150)]
    got = {r.doc_id: r.pii for r in pii.find_pii(table(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        assert [f"{x.kind}:{x.start}:{x.end}" for x in got[k] if x.kind in pii.BASE] == [x[2] for x in base_pii(t)]
    extra = [(x.kind, PII[x.start : x.end]) for x in got[0] if x.kind not in pii.BASE]
    assert extra == [("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")]
    assert pii.find_pii(table(spark, [])).count() == 0 and pii.find_pii(table(spark)).count() == len(odd_rows())


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("hello") == [["ell", "hel", "llo"]] and q("ab") == [] and q("[0-9]+abcd?") == [["abc"]] and q("(?:foo|bar)x") == [["arx", "bar"], ["foo", "oox"]]
    assert q("(?:foo|[a-z]+)") == [] and q("a(?:bcd)+") == [["bcd"]] and q("(?i)KEY") == [["key"]]


def base_secrets(t):
    rules = [
        ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    return sorted((m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p, ok) in enumerate(rules) for m in re.finditer(p, t or "", re.A) if ok(m))


def test_secrets(spark):
    rng = random.Random(10)
    parts = ["token", "Secret", "PASSWD", "api_key", "APIKEY", "=", ": ", '"', "'", "abcdef", "x1", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", " ", "é", "=token:abcdef", "ghp_" + "a1" * 12, "://u:p@", "http"]
    texts = [None, "", "AKIA" + "A" * 16, "f" * 24, "f" * 23, "secret=token:abcdef", "token=abc", "-----BEGIN RSA PRIVATE KEY-----"] + ["".join(rng.choice(parts) for _ in range(12)) for _ in range(200)]
    got = {r.doc_id: r.secrets for r in secret_scan.find_secrets(table(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        assert [f"{x.kind}:{x.start}:{x.end}" for x in got[k] if x.kind in secret_scan.BASE] == [x[2] for x in base_secrets(t)], t
        for name, p in list(secret_scan.RULES.items())[3:]:
            assert [(x.start, x.end) for x in got[k] if x.kind == name] == [m.span() for m in re.finditer(p, t or "", re.A)], (name, t)
    assert secret_scan.find_secrets(table(spark)).count() == len(odd_rows()) and secret_scan.find_secrets(table(spark, [])).count() == 0


def test_only_candidates_are_searched(spark, monkeypatch):
    asked, find = [], secret_scan.spans.find
    monkeypatch.setattr(secret_scan.spans, "find", lambda df, text, patterns: asked.append((df.count(), [*patterns])) or find(df, text, patterns))
    docs = table(spark, [(k, f"plain {k}") for k in range(200)] + [(200, "token=abcdef 123"), (201, None)])
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.secrets] for r in secret_scan.find_secrets(docs).collect()}
    assert got == {k: [] for k in range(202)} | {200: [("assign", 0, 12)]}
    # any text may match a rule without trigrams
    assert asked == [(1, [*secret_scan.RULES]), (201, ["hex"])]
    some = {r: secret_scan.RULES[r] for r in ("assign", "hex")} | {"digits": "[0-9]{3}"}
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.secrets] for r in secret_scan.find_secrets(docs, some).collect()}
    assert got == {k: [("digits", 6, 9)] if 100 <= k < 200 else [] for k in range(202)} | {200: [("assign", 0, 12), ("digits", 13, 16)]}


def test_plans_of_lines_are_small(spark, monkeypatch):
    sizes, store = [], linededup.store
    monkeypatch.setattr(linededup, "store", lambda df: sizes.append(len(df._jdf.queryExecution().toString())) or store(df))
    text = "one two three four five six"
    got = linededup.dedup_lines(table(spark, [(1, text), (2, f"{text}\nseven eight nine ten"), (3, "seven eight nine ten eleven")])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 1, 3: 1}
    # the driver keeps the text of each plan, so no table belongs in it
    assert max(sizes) < 200_000


# 7


def kept_words(rows, n):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            s = tuple(w[k : k + n])
            first[s] = min(first.get(s, (1, 0)), (d is None, d or 0))
    for d, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (d is None, d or 0):
                gone.update(range(k, k + n))
        yield len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["few words", "runs", "passages"])
def test_substrings(spark, kind):
    rng = random.Random(kind)
    passage, phrases = words(rng, 120), [words(rng, 8, "ab") for _ in range(2)]

    def text():
        if kind == "few words":
            return [w for _ in range(rng.randint(0, 14)) for w in rng.choice(phrases)]
        if kind == "runs":
            return [w for x in words(rng, rng.randint(1, 9), "ab") for w in [x] * rng.randint(1, 60)]
        at = rng.randint(0, 80)
        return words(rng, rng.randint(0, 60)) + passage[at : at + rng.randint(10, 110)] + words(rng, 5)

    rows = [(k, " ".join(text())) for k in range(70)] + [(None, " ".join(passage)), (None, " ".join(passage))]
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(table(spark, rows), window=20).collect())
    want = sorted(kept_words(rows, 20))
    assert got == want and sum(x[1] for x in want) > 100


def test_substrings_of_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    out = substring.dedup_substrings(table(spark), text=True)
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in out.collect())
    assert got == sorted(kept_words(rows, 50))
    assert substring.dedup_substrings(table(spark, [])).count() == 0


def test_segments_of_long_texts_give_the_same_anchors(monkeypatch):
    rng = np.random.default_rng(2)
    text = rng.integers(0, 50, 3000).astype(np.uint64)
    whole = {(int(n), k) for s, a, b, n, _ in zip(*substring.anchors(text, np.array([0, 3000]), 50), strict=True) for k in range(a, b + 1)}
    for at in range(0, 2951, 451):
        part = text[at : at + 500]
        for s, a, b, n, _ in zip(*substring.anchors(part, np.array([0, len(part)]), 50), strict=True):
            assert all((int(n), at + k) in whole for k in range(a, b + 1))


# 8


def test_leaks(spark):
    rng = random.Random(12)
    items = [words(rng, n) for n in (4, 5, 12, 40, 60)] + [[], words(rng, 30)]
    items[6] = items[3][:30]

    def edit(w, n):
        w = list(w)
        for k in rng.sample(range(len(w)), n):
            w[k] = "other"
        return w

    texts = [words(rng, 20) + edit(items[k], n) + words(rng, 20) for k, n in ((1, 0), (2, 0), (3, 0), (3, 2), (3, 12), (4, 3), (4, 30))]
    texts += [items[4][8:], items[4][:50], words(rng, 80), items[0], items[3][:20] + ["gap"] + items[3][20:]]
    rows = [(k, " ".join(t).upper() if k % 2 else "\n".join(t)) for k, t in enumerate(texts)] + [(None, " ".join(items[4])), (50, None), (51, ""), (52, " ".join(items[2])), (52, " ".join(items[2]))]
    want = {}
    for d, t in rows:
        w = WORD.findall((t or "").lower())
        for i, item in enumerate(items):
            n, best = len(item), None
            sh = [tuple(item[k : k + 5]) for k in range(n - 4)]
            for start in {p - j for p in range(len(w) - 4) for j, s in enumerate(sh) if tuple(w[p : p + 5]) == s}:
                x = w[max(start, 0) : start + n]
                has = {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
                share = len({j + o for j, s in enumerate(sh) if s in has for o in range(5)}) / n
                if share >= 0.8:
                    best = max(best or (0, 0), (share, -start))
            if best:
                want[d, i] = (-best[1], round(best[0], 6))
    benchmark = spark.createDataFrame([(k, " ".join(x) or None, "z") for k, x in enumerate(items)], "item_id bigint, text string, size string")
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 6)) for r in decontaminate.find_leaks(table(spark, rows), benchmark).collect()}
    assert got == want and {d for d, _ in want} >= {0, 1, 2, 3, 5, 7, 8, 11, None, 52}
    left = decontaminate.drop_leaks(table(spark, rows), benchmark)
    assert left.columns == table(spark, rows).columns and {r.doc_id for r in left.collect()} == {4, 6, 9, 10, 50, 51}
    assert decontaminate.find_leaks(table(spark, rows), benchmark.limit(0)).count() == 0 and decontaminate.find_leaks(table(spark, []), benchmark).count() == 0


def test_blocks_guarantee_the_radius(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = []
    for _ in range(50):
        a = rng.getrandbits(63)
        b = a
        for k in rng.sample(range(63), decontaminate.RADIUS):
            b ^= 1 << k
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a bigint, b bigint").select(decontaminate.blocks(F.col("a")).alias("x"), decontaminate.blocks(F.col("b")).alias("y"))
    assert all(any(p == q for p, q in zip(r.x, r.y, strict=True)) and len(r.x) == decontaminate.RADIUS + 1 for r in df.collect())


# 9


def fingerprint(t, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_bk_search_finds_all():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for _ in range(30)]))
    for radius in (0, 2, 5):
        q, t = simhash.bk_links(fps, fps, radius)
        want = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
        assert sorted(zip(q.tolist(), t.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


@pytest.mark.parametrize("cell", [5, 1000])
def test_near_duplicates(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash.shard_links, "__defaults__", (cell,))
    rng = random.Random(4)
    base = [words(rng, 150) for _ in range(6)]
    rows = [(r[0], r[1]) for r in odd_rows()]
    for k in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(150)] = "zz"
        rows.append((1000 + k, " ".join(w).capitalize()))
    fps = [fingerprint(t, 3) for _, t in rows]
    own = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    least = {}
    for (d, _), r in zip(rows, own, strict=True):
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    want = sorted((str(d), f"{f:016x}", str(least[r])) for (d, _), f, r in zip(rows, fps, own, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(table(spark, rows)).collect())
    assert got == want and len(set(own)) < len(rows) - 20
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_keep_one(spark):
    rng = random.Random(14)
    base = [words(rng, 200) for _ in range(5)]
    clean = [(k, " ".join(words(rng, 100))) for k in range(20)]
    rows = clean + [(100 + k, " ".join(base[k % 5][: 200 - k // 5])) for k in range(25)] + [(300, None), (301, ""), (3, clean[3][1]), (None, clean[4][1])]
    docs = table(spark, rows)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [*range(20), *range(100, 105), 300]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_is_by_exact_similarity(spark):
    rng = random.Random(33)
    rows = []
    for k in range(60):
        w = words(rng, 160)
        n = rng.randint(4, 30)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: 160 - n] + words(rng, n)))]
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(156)} for _, t in rows]
    want = {2 * k for k in range(60)} | {2 * k + 1 for k in range(60) if len(sets[2 * k] & sets[2 * k + 1]) < 0.8 * len(sets[2 * k] | sets[2 * k + 1])}
    assert 70 < len(want) < 110
    assert {r.doc_id for r in simhash.keep_one(table(spark, rows)).collect()} == want


# 10


@pytest.mark.parametrize("cell", [7, 2048])
def test_embeddings(spark, cell):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(15, 24))
    x = np.concatenate([rng.normal(size=(300, 24)), (centres[rng.integers(0, 15, 150)] + 0.3 * rng.normal(size=(150, 24)))]).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(500 + k, x[10].tolist(), 1) for k in range(20)]
    rows += [(600, None, 1), (601, [0.0] * 24, 1), (602, [None] * 24, 1), (603, [math.nan] * 24, 1), (604, [1.0] * 5, 1), (605, [], 1), (606, (3 * x[11]).tolist(), 1), (None, x[12].tolist(), 1), (700, [1e38] * 24, 1), (701, [3e38] * 24, 1), (702, [1e-30] * 24, 1)]
    usable = [k for k, r in enumerate(rows) if r[1] and len(r[1]) == 24 and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    m = np.array([np.array(rows[k][1], float) for k in usable])
    m = m / np.abs(m).max(1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    links = {usable[k]: int(near[k].sum()) - 1 for k in range(len(usable))}
    own = roots(len(rows), [(usable[a], usable[b]) for a, b in np.argwhere(near) if a < b])
    got = {r.vec_id: r for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), cell=cell).collect()}
    assert len(got) == len(rows) and sum(links.values()) > 800
    assert {i: r.n_links for i, r in got.items()} == {r[0]: links.get(k, 0) for k, r in enumerate(rows)}
    for k, r in enumerate(rows):
        assert got[r[0]].component_id == rows[own[k]][0] and got[r[0]].kept == (r[0] is not None and own[k] == k)
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_deeper_levels_keep_neighbours():
    rng = np.random.default_rng(5)
    x = embedding.unit(rng.normal(size=(4000, 16)))
    y = embedding.unit(x + 0.02 * rng.normal(size=x.shape))
    trees = [embedding.Tree(x[:500], s, 60, 3) for s in range(6)]
    met = np.zeros(len(x), bool)
    for t in trees:
        cells = [set(zip(*t.route(z), strict=True)) for z in (x, y)]
        for r, _ in cells[0] & cells[1]:
            met[r] = True
    assert met.mean() > 0.98
