"""Sources, the command line, streams and SQL."""

import json
import subprocess

import pytest

from sieveline import cli, sql
from sieveline.config import Config
from sieveline.sources import git
from sieveline.sources.files import read_files, text_of

KEY = "AKIA" + "ABCD1234EFGH5678"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub" / "vendor").mkdir(parents=True)
    for name, data in {".env": f"AWS={KEY}\n".encode(), "_hidden.conf": b"x\n", "sub/a.py": b"print()\n", "sub/vendor/b.py": b"x", "bin.dat": b"a\0b", "empty": b"", "bad.txt": b"caf\xe9\n"}.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_folder(spark, folder):
    rows = {r.file_path.removeprefix(f"{folder}/"): r for r in read_files(spark, str(folder)).collect()}
    assert set(rows) == {".env", "_hidden.conf", "sub/a.py", "bin.dat", "empty", "bad.txt"}
    assert (rows["bin.dat"].skipped, rows["empty"].skipped, rows["bad.txt"].content) == ("binary", "empty", "café\n")
    flat = read_files(spark, str(folder), recursive="false")
    assert flat.where("file_path like '%sub%'").count() == 0
    assert read_files(spark, str(folder / ".env")).count() == 1
    assert read_files(spark, str(folder / "missing")).first().skipped.startswith("unreadable")


def test_repository(spark, folder):
    run = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".env")
    run("commit", "-qm", "one")
    (folder / ".env").write_text(f"AWS={KEY}\nNEW=1\n")
    run("add", ".env", "sub/a.py")
    staged = {r.file_path: (r.status, r.content) for r in read_files(spark, str(folder), "staged").collect()}
    assert staged == {".env": ("M", "NEW=1\n"), "sub/a.py": ("A", "print()\n")}
    chunks = git.chunks(git.log_lines(read_files(spark, str(folder), "history")), 1 << 20).collect()
    assert [(c.path, c.content) for c in chunks] == [(".env", f"AWS={KEY}\n")]


def test_staged_names_of_any_characters_and_history_of_merges(spark, folder):
    run = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("add", ".env")
    run("commit", "-qm", "one")
    run("checkout", "-qb", "side")
    (folder / "side.txt").write_text("side\n")
    run("add", "side.txt")
    run("commit", "-qm", "two")
    run("checkout", "-q", "main")
    (folder / "main.txt").write_text("main\n")
    run("add", "main.txt")
    run("commit", "-qm", "three")
    run("merge", "-q", "--no-commit", "side")
    (folder / "side.txt").write_text("side\nboth\n")
    run("add", "side.txt")
    run("commit", "-qm", "four")
    chunks = git.chunks(git.log_lines(read_files(spark, str(folder), "history")), 1 << 20).collect()
    assert sorted(c.content for c in chunks) == sorted([f"AWS={KEY}\n", "side\n", "main\n"])
    for name in ("café.txt", 'quo"te.txt', "a b.txt"):
        (folder / name).write_text("new\n")
        run("add", name)
    assert {r.file_path: r.content for r in read_files(spark, str(folder), "staged").collect()} == dict.fromkeys(("café.txt", 'quo"te.txt', "a b.txt"), "new\n")


def test_command_line(spark, folder, capsys):
    out = folder / "report.json"
    assert cli.main(["scan", str(folder), "--format", "json", "--output", str(out)]) == 1
    assert [f["signature_id"] for f in json.loads(out.read_text())["findings"]] == ["aws-access-key"]
    assert KEY not in capsys.readouterr().out
    assert cli.main(["scan", str(folder / "sub"), "--format", "plain"]) == 0


def test_malformed_bytes():
    assert text_of(b"\xff\xfea\xc3\xa9") == "ÿþa" + "é"


def test_history_chunks_over_the_cap_go_alone(spark):
    log = ["commit " + "a" * 40, "diff --git a/x b/x", "+++ b/x", "+" + "y" * 50, "diff --git a/z b/z", "+++ b/z", "+ok"]
    rows = spark.createDataFrame([("l", k, x) for k, x in enumerate(log)], "log string, pos int, line string")
    assert [(r.path, r.content) for r in git.chunks(rows, 20).collect()] == [("z", "ok\n")]


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from sieveline.streaming import scan as stream

    spark.createDataFrame([("a.conf", f"AWS={KEY}")], "file_path string, content string").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("file_path string, content string").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(stream.each_batch(Config(), lambda f, n: f.write.mode("append").parquet(out))).start().awaitTermination()
    assert [r.token for r in spark.read.parquet(out).collect()] == [KEY]
    spark.createDataFrame([("t1", "HIGH", 0), ("t1", "HIGH", 60), ("t2", "LOW", 7200)], "token string, severity string, s int").select("token", "severity", F.timestamp_seconds("s").alias("found_at")).write.parquet(str(tmp_path / "f"))
    found = spark.readStream.schema("token string, severity string, found_at timestamp").parquet(str(tmp_path / "f"))
    for name, df, n in (("firsts", stream.first_seen(found), 2), ("counts", stream.by_severity(found), 2)):
        df.writeStream.trigger(availableNow=True).format("memory").queryName(name).outputMode("append" if name == "firsts" else "update").start().awaitTermination()
        assert spark.table(name).count() == n


def test_sql(spark):
    sql.register(spark)
    assert spark.sql("SELECT count(*) FROM signatures").first()[0] == 92
    row = spark.sql("SELECT mask_token('abcdefghijkl') m, round(shannon('aabb'), 6) e, severity_weight('high') w, entropy_severity(5.5) s, shannon('') z").first()
    assert tuple(row) == ("abcdef**ijkl", 1.0, 3, "MEDIUM", 0.0)
