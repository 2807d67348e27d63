"""Every query of the scanner against its SQL at the smallest scale."""

import os

import pytest

from sieveline.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents pages events".split()


def test_pages_that_share_a_url_are_all_scanned(spark, tmp_path):
    tail = "Q7ZX5KLM2PWV8RTN"
    rows = [(k, url, "AWS=" + "AK" + "IA" + tail[k:] + tail[:k]) for k, url in enumerate(["https://a.io/x.conf", "http://a.io/x.conf", "https://a.io/x.conf"])]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.file_path for r in registry.findings_pages(spark, str(tmp_path)).collect()} == {f"{k}/a.io/x.conf" for k in range(3)}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda df: sorted(map(tuple, df[cols].astype(str).replace({"nan": "None", "<NA>": "None"}).to_numpy().tolist()))
    assert text(got) == text(want)
