"""Whole scans: cases as data, with literals of our own."""

import pytest

from sieveline.catalog import Signature, names_value, signatures
from sieveline.config import Config, from_mapping
from sieveline.operators import report, resolve
from sieveline.plans import scan as plan

KEY = "AKIA" + "ABCD1234EFGH5678"
PAT = "ghp_" + "aB3dE6gH9j" * 3
HEXES = ["9f8e7d6c5b4a39281706f5e4d3c2b1a0" + f"{k:08x}" for k in range(4)]
RANDOM = "Zx9Kq2Lw8Vn4Tb7Rc1Yd6Mf3Gh0Js5Pa"

# name, path, content, (signature, token) expected
CASES = [
    ("environment", "app/.env", f"GITHUB_TOKEN={PAT}\nAWS={KEY}\n", [("github-env-token", PAT), ("aws-access-key", KEY)]),
    ("lower case prefix", "a.cfg2", f"x = {KEY.lower()}", [("high-entropy-base64", KEY.lower())]),
    ("marker", "a.ini", "# sieveline:ignore\nsecret_key = 'abcd1234efgh5678'\nsecret_key = 'abcd1234efgh5679'\n", [("django-secret-key", "abcd1234efgh5679")]),
    ("marker on the line", "a.ini", "secret_key = 'abcd1234efgh5678' // sieveline:ignore\n", []),
    ("header without footer", "k.key2", "-----BEGIN RSA PRIVATE KEY-----\nMIIEpAIBAAKCAQEA\n", []),
    ("header and footer", "k.key2", "-----BEGIN RSA PRIVATE KEY-----\nMIIEpAIBAAKCAQEA\n-----END RSA PRIVATE KEY-----\n", [("pem-private-key", "-----BEGIN RSA PRIVATE KEY-----")]),
    ("comment", "a.py", f'# key = "{KEY}"', []),
    ("test file", "pkg/a_test.go", f'key := "{KEY}"', []),
    ("placeholder", "a.py", 'password = "changeme1"', []),
    ("template", "a.ini", "password = ${{ secrets.PASS }}", []),
    ("identifier", "a.py", "password = some_function(x)", []),
    ("quoted password", "a.py", 'password = "hunter2X9z"', [("generic-pass-key", "hunter2X9z")]),
    ("unquoted in source", "a.py", "password = hunter2X9z", []),
    ("netrc", "home/.netrc", "machine x login y password hunter2X9z", [("generic-pass-key", "hunter2X9z")]),
    ("DSN", "a.ini", "url=postgres://me:s3cretPw@db/x", [("postgres-dsn", "postgres://me:s3cretPw@db/x")]),
    ("plain URL", "a.ini", "url=https://example.org/x", []),
    ("log", "srv.log", f"2024 INFO request Authorization: Bearer {RANDOM} done", [("log-high-entropy-base64", RANDOM)]),
    ("random", "a.conf", f"blob = {RANDOM}", [("high-entropy-base64", RANDOM)]),
    ("carriage returns", "a.conf", f"x\r\nAWS={KEY}\r\n", [("aws-access-key", KEY)]),
    ("spread over strings", "a.conf", "x '" + KEY[:2] + "' + '" + KEY[2:] + "'", [("aws-access-key", KEY)]),
    ("empty lines only", "a.conf", "\n\n\n", []),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(f"{k}/{path}", content) for k, (_, path, content, _) in enumerate(CASES)], "file_path string, content string")
    rows = plan.scan(files, Config(entropy_threshold=3.5)).collect()
    return {k: sorted((r.signature_id, r.token) for r in rows if r.file_path.startswith(f"{k}/")) for k in range(len(CASES))}


@pytest.mark.parametrize("k", range(len(CASES)), ids=[c[0] for c in CASES])
def test_case(found, k):
    assert found[k] == sorted(CASES[k][3])


def test_a_large_file_is_scanned_whole(spark):
    lines = [f"AWS=AKIA{k:016X}".replace("0", "Z") if k % 300 == 0 else "nothing to see here, only words" for k in range(6000)]
    got = plan.scan(spark.createDataFrame([("big.conf", "\n".join(lines))], "file_path string, content string"), Config(entropy=False))
    assert sorted(r.line_no for r in got.collect()) == [k + 1 for k in range(0, 6000, 300)]


def test_long_lines_are_passed_over(spark):
    content = "# sieveline:ignore\n" + "x" * 5000 + f"\nAWS={KEY}\nAWS={KEY[:-1]}9\n"
    got = plan.scan(spark.createDataFrame([("a.conf", content)], "file_path string, content string"))
    assert [r.line_no for r in got.collect()] == [4]


def test_blobs_allowlist_custom_signatures(spark):
    blob = "\n".join(f"q9Zx3kL0pWv7Tn2Rb8Yc5Md1Gh4Js6Fa{k}Qw" for k in range(4))
    files = spark.createDataFrame([("b.bin2", blob), ("c.conf", "corp_abc123XYZ-9\n" + KEY)], "file_path string, content string")
    config = Config(entropy_threshold=3.5, allowlist_patterns=("AKIA*",), custom_signatures=(Signature("corp", "corp_", "", r"^corp_[A-Za-z0-9-]+$", "Corp key"),))
    got = {(r.file_path, r.signature_id, r.token, r.severity) for r in plan.scan(files, config).collect()}
    assert got == {("b.bin2", "massive-base64-blob", "<4 lines aggregated>", "CRITICAL"), ("c.conf", "corp", "corp_abc123XYZ-9", "HIGH")}


def test_phrases(spark):
    words = tuple("alpha bravo delta eagle fancy gamma hotel index joker kilo".split())
    text = " ".join(words[k % 10] for k in range(12))
    files = spark.createDataFrame([("w.conf", text), ("v.conf", text + " zulu")], "file_path string, content string")
    got = plan.scan(files, Config(phrase_words=words)).collect()
    assert [(r.file_path, r.signature_id) for r in got] == [("w.conf", "bip39-mnemonic")]


def test_phrases_are_found_by_default(spark):
    from sieveline.config import PHRASE_WORDS

    assert len(set(PHRASE_WORDS)) == 2048
    phrase = " ".join(PHRASE_WORDS[k * 83 % 2048] for k in range(12))
    files = spark.createDataFrame([("w.conf", phrase), ("v.conf", phrase[:-1] + "#")], "file_path string, content string")
    for config in (Config(), Config(patterns=False, entropy=False)):
        assert [(r.file_path, r.signature_id, r.severity) for r in plan.scan(files, config).collect()] == [("w.conf", "bip39-mnemonic", "CRITICAL")]


def test_tiers_can_be_off_and_nothing_is_found_in_nothing(spark):
    files = spark.createDataFrame([("a.conf", f"AWS={KEY}\nblob = {RANDOM}")], "file_path string, content string")
    assert {r.tier for r in plan.scan(files, Config(entropy=False)).collect()} == {"PATTERN"}
    assert {r.tier for r in plan.scan(files, Config(patterns=False)).collect()} == {"ENTROPY"}
    assert plan.scan(files, Config(patterns=False, entropy=False)).count() == 0
    assert plan.scan(files.limit(0)).count() == 0


def test_pruning_names_its_reasons(spark):
    files = spark.createDataFrame([("a.png", "x"), ("vendor/a.go", "x"), ("doc.go", "x"), ("e.py", ""), ("ok.py", "x"), ("l.py", "x" * 50)], "file_path string, content string")
    config = Config(max_file_size_bytes=40)
    assert {r.file_path: r.reason for r in plan.skipped(files, config).collect()} == {"a.png": "extension", "vendor/a.go": "path", "doc.go": "safe file", "e.py": "empty", "l.py": "too large"}
    assert [r.file_path for r in plan.prune(files, config).collect()] == ["ok.py"]


def test_resolution_of_files(spark):
    files = spark.createDataFrame([("b.conf", f"AWS={KEY}"), ("a.conf", f"x\nAWS={KEY}"), ("c.conf", f"t={PAT}")], "file_path string, content string")
    found = plan.scan(files).persist()
    assert {(r.file_path, r.token) for r in resolve.first_seen(found).collect()} == {("a.conf", KEY), ("c.conf", PAT)}
    assert [r.file_path for r in plan.stop_at_first(found).collect()] == ["a.conf"]
    assert resolve.new_findings(found, found.where("file_path = 'a.conf'")).count() == 2
    assert {r.severity: r.n for r in report.by_severity(found).collect()} == {"CRITICAL": 3}
    assert report.blocks(found).first().blocked is True
    text = report.json_report(found, 3)
    assert '"status": "blocked"' in text and KEY not in text
    assert '"ruleId": "aws-access-key"' in report.sarif_report(found)
    assert "3 CRITICAL" in report.text_report(found, 3)
    assert report.text_report(found.limit(0), 3).endswith("clean: 3 files scanned in 0 ms")


def test_catalogue_and_config():
    sigs = signatures()
    assert len(sigs) == 92 and len({s.id for s in sigs}) == 91 and sum(names_value(s.prefix) for s in sigs) == 29 and sum(bool(s.validator) for s in sigs) == 47
    assert Config(min_secret_length=-3).min_secret_length == 1 and Config(max_file_size_bytes=-1).max_file_size_bytes == 10 << 20
    for bad in ({"entropy_threshold": 9}, {"custom_signatures": [{"id": "", "prefix": "x"}]}, {"custom_signatures": [{"id": "x", "prefix": "x", "regex": "("}]}, {"custom_signatures": [{"id": "x", "prefix": "x", "severity": "BAD"}]}, {"custom_signatures": [{"id": "x", "prefix": "é"}]}):
        with pytest.raises(ValueError):
            from_mapping(bad)
    c = from_mapping({"entropy_threshold": 3, "disable_tiers": {"entropy": True}, "custom_signatures": [{"id": "x", "prefix": "x_"}], "exclude_paths": ["a/**"]})
    assert (c.entropy, c.patterns, c.custom_signatures[0].severity, c.exclude_paths) == (False, True, "HIGH", ("a/**",))
    assert report.parse_format("TEXT") == "plain" and report.parse_format("x") == "pretty"
