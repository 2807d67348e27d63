"""The pipeline on a corpus of which every document's fate is known, and its stages against plain Python."""

import math
import random

import pytest
from cases import SCHEMA, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    top = str(tmp_path_factory.mktemp("corpus"))
    good = [(k, "\n".join(" ".join(words(rng, 30)) for _ in range(4))) for k in range(60)]
    junk = [(100 + k, "#$% ".join(words(rng, 80))) for k in range(40)]
    item = words(rng, 30)
    copies = [(200, good[0][1]), (201, good[1][1])]
    near = [(210 + k, " ".join(good[2 + k][1].split()[:-3]) + " ending") for k in range(3)]
    leaks = [(220 + k, " ".join(words(rng, 40) + item + words(rng, 40))) for k in range(3)]
    rows = good + junk + copies + near + leaks + [(300, None), (301, "")]
    spark.createDataFrame([(d, t, "en", f"s{d % 2}", len(t or ""), "9", "8", "7", "6", "5") for d, t in rows], SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in [*range(60), *range(100, 140)]], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, dict(rows)


def test_stages(spark, folder):
    top, texts = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    good, copies, near, leaks, blank = set(range(60)), {200, 201}, {210, 211, 212}, {220, 221, 222}, {300, 301}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, top)
        path = f"{top}/stage{k}-{random.random()}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        if k < 4:
            assert now.columns == docs.columns
        if k == 0:
            assert ids(now) - blank == good | copies | near | leaks
        if k == 1:
            assert ids(now) - blank == good | near | leaks
            assert {r.doc_id: r.text for r in now.where("doc_id < 100").collect()} == {d: texts[d] for d in good}
        if k == 2:
            assert ids(now) - blank == good | leaks and len(ids(now) & blank) <= 1
        if k == 3:
            assert ids(now) - blank == good
    got = now.collect()
    total = sum(len(texts[d].split()) for d in good)
    assert ids(now) <= good and all(0 < r.taken <= 3 * r["size"] for r in got)
    # 5 to 2, unless the first would be taken more than three times
    own = {s: sum(len(texts[d].split()) for d in good if d % 2 == s) for s in (0, 1)}
    first = min(3 * own[0], total * 5 / 7)
    want = {"s0": math.floor(first), "s1": math.floor(total - first)}
    assert {s: sum(r.taken for r in got if r.source == s) for s in want} == pytest.approx(want, abs=1)


def test_run_is_the_stages(spark, folder):
    rows = {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, folder[0]).collect()}
    assert rows and {d for d, _ in rows} <= set(range(60))
    assert corpus_pipeline.ORACLE_SQL is None
