"""Queries of the scanner, by name, with the SQL that gives the same rows.

Documents stand for files: `src/<source>/<doc_id>.txt`; pages too: their path is the URL without its scheme.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.catalog import signatures
from sieveline.config import EXCLUDE_EXTENSIONS, EXCLUDE_PATHS, Config
from sieveline.functions import entropy as E
from sieveline.functions import paths
from sieveline.functions import strings as S
from sieveline.functions.plan import fixed, spread
from sieveline.operators import context, lines, match, plausible, report, resolve
from sieveline.plans import scan as plan
from sieveline.sources import git

_QUERIES, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", document_path().alias("file_path"), F.coalesce("text", F.lit("")).alias("content"))


def document_path():
    """A path for every document, also without source or doc_id."""
    return F.concat(F.lit("src/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))


def pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("file_path"), F.coalesce("html", F.lit("")).alias("content"))


def document_lines(spark, sf_dir) -> DataFrame:
    return lines.numbered(spread(documents(spark, sf_dir).select("doc_id", "content")))


def values(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def in_sql(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


# Lines in SQL: as lines.split_lines makes them.
SQL_LINES = r"""
f AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text <> ''),
g AS (SELECT doc_id, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS s FROM f),
l AS (SELECT doc_id, i::INT AS line_no, regexp_replace(s[i], '\r$', '') AS raw FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM g))"""
SQL_TRIM = r"trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160))"


# Sources and lines


def scan_ledger(spark, sf_dir):
    files = documents(spark, sf_dir)
    found = plan.scan(files)
    return plan.ledger(files, found).join(files.select("file_path", "doc_id"), "file_path").drop("file_path")


@query(f"WITH {SQL_LINES} SELECT doc_id, line_no, length(raw)::INT AS n_chars, strlen(raw)::INT AS n_bytes FROM l")
def line_split(spark, sf_dir):
    return document_lines(spark, sf_dir).select("doc_id", "line_no", F.length("raw").alias("n_chars"), F.octet_length("raw").alias("n_bytes"))


@query(f"WITH {SQL_LINES} SELECT doc_id, line_no FROM l WHERE strlen({SQL_TRIM}) > 4096")
def overlong_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).where(F.octet_length(S.strip(F.col("raw"))) > lines.LONGEST).select("doc_id", "line_no")


@query(f"""WITH {SQL_LINES}, t AS (SELECT doc_id, line_no, {SQL_TRIM} AS trim FROM l),
k AS (SELECT * FROM t WHERE strlen(trim) <= 4096)
SELECT doc_id, line_no, trim, lag(trim) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM k""")
def prev_line(spark, sf_dir):
    return lines.scanned(spread(documents(spark, sf_dir).select("doc_id", "content")), "").select("doc_id", "line_no", F.col("trim"), "prev")


@query(f"""WITH {SQL_LINES}, t AS (SELECT doc_id, line_no, {SQL_TRIM} AS trim FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k, contains(trim, ' the ') AS m, contains(trim, ' the ') AND regexp_matches(trim, '^(?:T|A|O)') AS d FROM t WHERE strlen(trim) <= 4096),
r AS (SELECT *, k - coalesce(max(CASE WHEN NOT d THEN k END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS run FROM k)
SELECT doc_id, line_no FROM r WHERE NOT m AND run % 2 = 0""")
def suppression_runs(spark, sf_dir):
    """With a word of the text as the marker and capital letters as the signs of comments."""
    return lines.scanned(documents(spark, sf_dir).select("doc_id", "content"), " the ", comments=("T", "A", "O")).select("doc_id", "line_no")


_STATUS = ["M\tsrc/a.go", "A\tsrc/new file.py", "R100\told/x.txt\tnew/y.txt", "C75\ta\tb", "", "bad"]


@query("SELECT 'M' AS status, 'src/a.go' AS path UNION ALL SELECT 'A', 'src/new file.py' UNION ALL SELECT 'R100', 'new/y.txt' UNION ALL SELECT 'C75', 'b'")
def name_status(spark, sf_dir):
    return git.name_status(values(spark, [(x,) for x in _STATUS], "line string"))


_LOG = [
    "commit 0123456789abcdef", "Author: a", "", "diff --git a/x.py b/x.py", "--- a/x.py", "+++ b/x.py", "@@ -0,0 +1,2 @@", "+one", "-gone", "+two", " same",
    "diff --git a/y.md b/y.md", "+++ b/y.md", "+three", "commit fedcba9876543210", "diff --git a/x.py b/x.py", "+++ b/x.py", "+four",
]


@query("SELECT '0123456:x.py' AS file_path, 'one' || chr(10) || 'two' || chr(10) AS content UNION ALL SELECT '0123456:y.md', 'three' || chr(10) UNION ALL SELECT 'fedcba9:x.py', 'four' || chr(10)")
def history_chunks(spark, sf_dir):
    log = values(spark, [("log", k, x) for k, x in enumerate(_LOG)], "log string, pos int, line string")
    return git.chunks(log, 1 << 20).select("file_path", "content")


@query(f"SELECT line, substr(line, 2) AS added FROM (VALUES {', '.join(f'({in_sql(x)})' for x in _LOG)}) t(line) WHERE starts_with(line, '+') AND NOT starts_with(line, '+++')")
def added_lines(spark, sf_dir):
    log = values(spark, [(x,) for x in _LOG], "line string")
    return log.select("line", git.added(F.col("line")).alias("added")).where("added is not null")


# Paths

_PATHS = [
    "src/a.go", "src/a_test.go", "README", "docs/x.txt", "pkg/testing/x.go", "pkg/testWork/x.go", "mock-server/x", "a/b/specs/c.rb", "vendor/x/y.js", "a/vendor/z.c",
    "x.min.js", "web/x.min.css", "go.sum", "a/go.sum", "img/x.PNG", "x.pb.go", "api/x.gen.go", ".env", "doc.go", "zz_generated.deep.go", "cgmanifest.json", "product.json",
    "a/locales/en.json", "t.tar.gz", "Main.JAVA", "run.sh", "conf.yaml", "x.pem", "yarn.lock", "a/b.snyk",
]
_SQL_PATHS = f"p AS (SELECT path FROM (VALUES {', '.join(f'({in_sql(x)})' for x in _PATHS)}) t(path) UNION SELECT regexp_replace(url, '^[a-z]+://', '') FROM pages)"


def _any(xs):
    return "|".join(x.replace(".", r"\.").replace("*", "[^/]*") for x in xs)


def all_paths(spark, sf_dir):
    return values(spark, [(x,) for x in _PATHS], "path string").unionByName(pages(spark, sf_dir).select(F.col("file_path").alias("path"))).distinct()


@query(rf"""WITH {_SQL_PATHS} SELECT path, regexp_matches(lower(path), '({_any(paths.TEST_ENDS)})$')
 OR regexp_matches(lower(path), '(^|/)({_any(paths.TEST_SEGMENTS)})(/|$)') OR regexp_matches(lower(path), '{_any(paths.TEST_PARTS)}')
 OR len(list_filter(string_split(lower(path), '/')[:-2], lambda s: contains(s, 'test') AND s <> 'testing')) > 0 AS is_test,
 regexp_matches(lower(path), '({_any(paths.SOURCE)})$') AND regexp_matches(path, '\.[^./]*$') AS is_source,
 regexp_matches(lower(path), '({_any(paths.SAFE_EXTENSIONS)}|(^|/)({_any(paths.SAFE_NAMES)})|{_any(paths.SAFE_ENDS)})$') OR regexp_matches(lower(path), '(^|/)zz_generated[^/]*$') AS is_safe FROM p""")
def path_flags(spark, sf_dir):
    p = F.col("path")
    return all_paths(spark, sf_dir).select(p, paths.is_test_path(p).alias("is_test"), paths.is_source(p).alias("is_source"), paths.is_safe_file(p).alias("is_safe"))


_FOLDERS = [p.removesuffix("/**").removeprefix("**/") for p in EXCLUDE_PATHS]


@query(rf"""WITH {_SQL_PATHS} SELECT path, regexp_matches(lower(path), '({_any(EXCLUDE_EXTENSIONS)})$') AS by_extension, regexp_matches(path, '(^|/)({_any(_FOLDERS)})(/|$)') AS by_path FROM p""")
def excluded_paths(spark, sf_dir):
    p = F.col("path")
    return all_paths(spark, sf_dir).select(p, paths.has_extension(p, EXCLUDE_EXTENSIONS).alias("by_extension"), paths.excluded(p, EXCLUDE_PATHS).alias("by_path"))


# Strings and entropy

_SHANNON = "CASE WHEN length({0}) = 0 THEN 0 ELSE -list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: (length({0}) - length(replace({0}, c, ''))) / length({0}) * log2((length({0}) - length(replace({0}, c, ''))) / length({0})))) END"


@query(rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}')) AS token FROM documents)
SELECT token, round({_SHANNON.format('token')}, 6) AS entropy FROM w""")
def shannon_per_token(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode_outer(F.regexp_extract_all("content", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("token")).where("token is not null").distinct()
    return words.select("token", F.round(E.shannon(F.col("token")), 6).alias("entropy"))


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '[A-Za-z0-9+/=_-]{12,}')) AS token FROM pages)
SELECT page_id, token FROM t WHERE NOT regexp_matches(token, '^[A-Za-z._]*$') AND NOT regexp_matches(token, '^[0-9a-fA-F]*$') AND replace(token, token[1], '') <> ''""")
def base64_tokens(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.explode_outer(E.base64_tokens(F.col("content"), 12)).alias("token")).where("token is not null")


_SQL_HEX = "h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9a-fA-F]{12,}')) AS token FROM documents)"


def hex_of_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode_outer(E.hex_tokens(F.col("content"), 12)).alias("token")).where("token is not null")


@query(f"WITH {_SQL_HEX} SELECT doc_id, token, round({_SHANNON.format('token')}, 6) AS entropy FROM h WHERE length(token) % 2 = 0 OR length(token) >= 32")
def hex_tokens(spark, sf_dir):
    return hex_of_documents(spark, sf_dir).select("doc_id", "token", F.round(E.shannon(F.col("token")), 6).alias("entropy"))


@query(f"""WITH {_SQL_HEX}, e AS (SELECT round({_SHANNON.format('token')}, 6) AS e FROM h WHERE length(token) % 2 = 0 OR length(token) >= 32)
SELECT CASE WHEN e >= 7 THEN 'CRITICAL' WHEN e >= 6 THEN 'HIGH' WHEN e >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity, e >= 3 AS reaches, count(*) AS n FROM e GROUP BY ALL""")
def entropy_severity_hist(spark, sf_dir):
    e = F.round(E.shannon(F.col("token")), 6)
    return hex_of_documents(spark, sf_dir).groupBy(E.severity(e).alias("severity"), (e >= E.HEX_LEAST).alias("reaches")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SQL_LINES}, q AS (SELECT doc_id, line_no, list_transform(regexp_extract_all(raw, '"[^"]*"|''[^'']*''|`[^`]*`'), lambda x: substr(x, 2, length(x) - 2)) AS found FROM l WHERE regexp_matches(raw, '["''`]') AND NOT contains(raw, chr(92)))
SELECT doc_id, line_no, coalesce(found[1], '') AS first, CASE WHEN len(list_filter(found, lambda x: x <> '')) > 0 THEN array_to_string(list_filter(found, lambda x: x <> ''), ' ') END AS joined FROM q""")
def quoted_literals(spark, sf_dir):
    some = document_lines(spark, sf_dir).where(F.col("raw").rlike("[\"'`]") & ~F.col("raw").contains("\\"))
    return some.select("doc_id", "line_no", S.first_quoted(F.col("raw")).alias("first"), S.all_quoted(F.col("raw")).alias("joined"))


@query(f"""WITH {SQL_LINES}, t AS (SELECT doc_id, line_no, {SQL_TRIM} AS x FROM l)
SELECT doc_id, line_no, CASE WHEN strlen(x) BETWEEN 16 AND 400 THEN translate(x, ' +.""' || chr(39) || '`', '') ELSE '' END AS compact,
 CASE WHEN strlen(x) > 120 THEN substr(x, 1, 120) || '…' ELSE x END AS shown FROM t""".replace('""', '"'))
def compact_and_shortened(spark, sf_dir):
    x = S.strip(F.col("raw"))
    return document_lines(spark, sf_dir).select("doc_id", "line_no", S.compact(x).alias("compact"), S.shorten(F.col("raw"), 120).alias("shown"))


@query(f"WITH {_SQL_HEX} SELECT DISTINCT token, CASE WHEN length(token) <= 10 THEN repeat('*', length(token)) ELSE substr(token, 1, 6) || repeat('*', length(token) - 10) || right(token, 4) END AS masked FROM h WHERE length(token) % 2 = 0 OR length(token) >= 32")
def mask_tokens(spark, sf_dir):
    return hex_of_documents(spark, sf_dir).select("token", S.mask(F.col("token")).alias("masked")).distinct()


_VERSIONS = [("v1.2.3", "1.2.2"), ("1.2.3", "1.2.3"), ("1.10.0", "1.9.9"), ("2.0.0-rc1", "2.0.0"), ("2.0.0", "2.0.0-rc1"), ("1.2", "1.1.9")]


@query("SELECT * FROM (VALUES ('v1.2.3', '1.2.2', true), ('1.2.3', '1.2.3', false), ('1.10.0', '1.9.9', true), ('2.0.0-rc1', '2.0.0', false), ('2.0.0', '2.0.0-rc1', true), ('1.2', '1.1.9', true)) t(latest, current, newer)")
def version_order(spark, sf_dir):
    return values(spark, _VERSIONS, "latest string, current string").select("latest", "current", S.is_newer(F.col("latest"), F.col("current")).alias("newer"))


# Signatures

_SQL_SIGS = "s(ord, id, low) AS (VALUES " + ", ".join(f"({k}, {in_sql(s.id)}, {in_sql(s.prefix.lower())})" for k, s in enumerate(signatures())) + ")"


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {in_sql(s.id)}, {in_sql(s.prefix)}, {in_sql(s.severity)}, {str(bool(s.validator)).lower()})" for k, s in enumerate(signatures())) + ") t(ord, id, prefix, severity, validated)")
def signature_table(spark, sf_dir):
    return match.table(spark, signatures()).select("ord", "id", "prefix", "severity", (F.col("validator") != "").alias("validated"))


def _occurrences(spark, sf_dir):
    url = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), "page_id").alias("place"), F.col("url").alias("text"))
    text = document_lines(spark, sf_dir).select(F.concat(F.lit("doc "), "doc_id", F.lit(" "), "line_no").alias("place"), F.col("raw").alias("text"))
    rows = fixed(url.unionByName(text), {"low": F.lower("text")}).where(match.any_prefix(F.col("low"), signatures()))
    return match.occurrences(rows, "text", signatures()).select("place", "text", "start", "stop", "sig.id")


_SQL_PLACES = f"""{SQL_LINES}, x AS (SELECT 'page ' || page_id AS place, url AS text FROM pages UNION ALL SELECT 'doc ' || doc_id || ' ' || line_no, raw FROM l), {_SQL_SIGS},
y AS (SELECT place, text, lower(text) AS t, id, low FROM x, s WHERE contains(lower(text), low)),
o AS (SELECT place, text, id, low, i FROM (SELECT *, unnest(range(1, length(t) - length(low) + 2)) AS i FROM y) WHERE substr(t, i, length(low)) = low)"""


@query(f"WITH {_SQL_PLACES} SELECT place, id, i::INT AS start, (i + length(low) - 1)::INT AS stop FROM o")
def raw_matches(spark, sf_dir):
    return _occurrences(spark, sf_dir).select("place", "id", "start", "stop")


@query(f"WITH {_SQL_PLACES} SELECT id, count(*) AS n, count(DISTINCT place) AS n_places FROM o WHERE i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[A-Za-z0-9_]') GROUP BY id")
def match_counts(spark, sf_dir):
    some = _occurrences(spark, sf_dir).where(match.stands_alone(F.col("text"), F.col("start")))
    return some.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("place").alias("n_places"))


# The one rule that finds something in documents, in SQL: token = "<hex>", one finding for each token of a line.
_SQL_FOUND = f"""{SQL_LINES}, r AS (SELECT doc_id, line_no, raw, unnest(regexp_extract_all(raw, '(?i)(?:^|[^A-Za-z0-9_])token = "([0-9a-f]{{40}})"', 1)) AS token FROM l WHERE strlen(raw) <= 4096),
u AS (SELECT DISTINCT d.source, r.* FROM r JOIN documents d ON r.doc_id = d.doc_id), v AS (SELECT 'src/' || coalesce(source, 'none') || '/' || coalesce(doc_id::VARCHAR, 'none') || '.txt' AS file_path, line_no, token, raw FROM u)"""


def document_findings(spark, sf_dir):
    return plan.scan(documents(spark, sf_dir).select("file_path", "content"))


@query(f"WITH {_SQL_FOUND} SELECT file_path, line_no, token, 'generic-token-key' AS signature_id, 'MEDIUM' AS severity, 'PATTERN' AS tier, round({_SHANNON.format('token')}, 6) AS entropy FROM v")
def findings_documents(spark, sf_dir):
    return document_findings(spark, sf_dir).select("file_path", "line_no", "token", "signature_id", "severity", "tier", F.round("entropy", 6).alias("entropy"))


@query()
def findings_pages(spark, sf_dir):
    config = Config(entropy_threshold=3.5, min_secret_length=12)
    # pages may share a URL; below the folder of its page_id the path of each is its own
    path = F.concat_ws("/", F.col("page_id").cast("string"), "file_path").alias("file_path")
    return plan.scan(pages(spark, sf_dir).select(path, "content"), config)


@query(f"WITH {_SQL_FOUND} SELECT token, min(file_path) AS file_path FROM v GROUP BY token")
def first_seen_tokens(spark, sf_dir):
    return resolve.first_seen(document_findings(spark, sf_dir)).select("token", "file_path")


@query(f"WITH {_SQL_FOUND} SELECT 'MEDIUM' AS severity, 'generic-token-key' AS signature_id, count(*) AS n, count(DISTINCT token) AS n_tokens FROM v HAVING count(*) > 0 UNION ALL SELECT 'MEDIUM', NULL, count(*), count(DISTINCT token) FROM v HAVING count(*) > 0 UNION ALL SELECT NULL, NULL, count(*), count(DISTINCT token) FROM v HAVING count(*) > 0")
def severity_rollup(spark, sf_dir):
    return report.by_severity_and_rule(document_findings(spark, sf_dir))


@query(f"WITH {_SQL_FOUND} SELECT count(*) < 0 AS blocked FROM v")
def blocker_flag(spark, sf_dir):
    return report.blocks(document_findings(spark, sf_dir))


@query(f"WITH {_SQL_FOUND} SELECT DISTINCT 'generic-token-key' AS rule_id, {in_sql(next(s.description for s in signatures() if s.id == 'generic-token-key'))} AS description FROM v")
def rule_distinct(spark, sf_dir):
    return report.rules(document_findings(spark, sf_dir))


@query(f"WITH {_SQL_FOUND} SELECT file_path, line_no, 'generic-token-key' AS rule_id, 'Secret detected: ' || {in_sql(next(s.description for s in signatures() if s.id == 'generic-token-key'))} || ' (Severity: MEDIUM)' AS message FROM v")
def sarif_results(spark, sf_dir):
    return report.sarif_results(document_findings(spark, sf_dir)).select("file_path", "line_no", F.col("result.ruleId").alias("rule_id"), F.col("result.message.text").alias("message"))


@query()
def json_rows(spark, sf_dir):
    return report.json_rows(document_findings(spark, sf_dir))


@query(f"""WITH {SQL_LINES}, n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id), {_SQL_FOUND.replace(SQL_LINES + ',', '').strip()},
c AS (SELECT file_path, count(*) AS n_findings, round(max({_SHANNON.format('token')}), 6) AS max_entropy FROM v GROUP BY file_path)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_findings, 0) AS n_findings, max_entropy, CASE WHEN n_findings > 0 THEN 'MEDIUM' END AS worst_severity
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON c.file_path = 'src/' || coalesce(d.source, 'none') || '/' || coalesce(d.doc_id::VARCHAR, 'none') || '.txt'""")
def ledger(spark, sf_dir):
    return scan_ledger(spark, sf_dir).withColumn("max_entropy", F.round("max_entropy", 6))


# Predicates


@query(f"""WITH {_SQL_HEX} SELECT token, length(token) > 400 OR length(token) < 10 OR regexp_matches(token, '^[a-z_]*$') OR regexp_matches(token, '^[A-Za-z]*$') OR (regexp_matches(token, '^[A-Z0-9_]*$') AND regexp_matches(token, '[A-Z]')) AS rejected
FROM (SELECT DISTINCT token FROM h WHERE length(token) % 2 = 0 OR length(token) >= 32)""")
def plausibility_flags(spark, sf_dir):
    some = hex_of_documents(spark, sf_dir).select("token").distinct()
    return some.select("token", plausible.first_reason(F.col("token"), F.lit("token"), F.lit("generic-token-key"), 20).isNotNull().alias("rejected"))


_CASES = [
    ("src/a.py", 'api_key = "your-key-here-123"', "your-key-here-123", "generic-api-key", "placeholder", "0E"),
    ("src/a_test.go", 'token := "Zk39xQ"', "Zk39xQ", "generic-token-key", "test-file", "1"),
    ("src/a.py", '# token = "Zk39xQ81"', "Zk39xQ81", "generic-token-key", "comment", "2"),
    ("a.env", '# token = "Zk39xQ81"', "Zk39xQ81", "generic-token-key", "real", None),
    ("a/.env", '# token = "Zk39xQ81"', "Zk39xQ81", "generic-token-key", "real", None),
    ("src/a.py", 'version = "1.2.3-beta"', "1.2.3-beta", "generic-token-key", "version", "4"),
    ("src/a.py", "password = ${DB_PASS}", "${DB_PASS}", "generic-password-key", "placeholder", "5"),
    ("src/a.py", 'sample_key = "q8Zx72Lm"', "q8Zx72Lm", "generic-api-key", "variable-name", "7"),
    ("src/a.py", 'x = "123e4567-e89b-12d3-a456-426614174000"', "123e4567-e89b-12d3-a456-426614174000", "hex", "uuid", "3"),
    ("src/a.py", 'alpha = "0123456789abcdef0123"', "0123456789abcdef0123", "hex", "version", "13"),
    ("src/a.py", 'password = "hunter2X9"', "hunter2X9", "generic-password-key", "real", None),
    ("src/a.py", 'cfg = "/home/me/x1"', "/home/me/x1", "base64", "file-path", "14a"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {in_sql(c[4])}, {in_sql(c[5]) if c[5] else 'NULL'})" for k, c in enumerate(_CASES)) + ") t(id, decision, \"check\")")
def context_decisions(spark, sf_dir):
    rows = values(spark, [(k, *c[:4]) for k, c in enumerate(_CASES)], "id int, path string, line string, token string, sig string")
    c = F.col
    rows = fixed(rows, {"name": S.variable_name(c("line"), c("token")), "is_test": paths.is_test_path(c("path"))})
    checks = context.checks(c("path"), c("line"), c("token"), c("sig"), c("name"), c("is_test"))
    return rows.select("id", context.decide(checks).alias("d")).select("id", "d.*")


# Islands, overlaps, sets


@query("""WITH e AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS n FROM i GROUP BY user_id, event_type, island HAVING count(*) >= 2""")
def islands_rollup(spark, sf_dir):
    """Gaps and islands on events, as blobs are found among findings."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    starts = F.when(F.lag("event_type").over(w) == F.col("event_type"), 0).otherwise(1)
    rows = table(spark, sf_dir, "events").withColumn("s", starts).withColumn("island", F.sum("s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("island")


_LINE_OF = [
    ("a", 1, 0, "abcdef", "generic-x", "MEDIUM"), ("a", 1, 1, "abcdefgh", "aws", "CRITICAL"), ("a", 2, 0, "one", "aws", "LOW"), ("a", 2, 1, "two", "aws", "HIGH"),
    ("b", 1, 0, "xyz123", "aws", "HIGH"), ("b", 1, 1, "yz12", "gcp", "HIGH"), ("b", 1, 2, "z1", "gcp", "LOW"), ("b", 3, 0, "k1", "aws", "HIGH"), ("b", 3, 1, "k1", "generic-y", "CRITICAL"),
]


@query("SELECT * FROM (VALUES ('a', 1, 'abcdefgh', 'aws'), ('a', 2, 'one', 'aws'), ('a', 2, 'two', 'aws'), ('b', 1, 'yz12', 'gcp'), ('b', 3, 'k1', 'aws')) t(file_path, line_no, token, signature_id)")
def overlap_winner(spark, sf_dir):
    rows = values(spark, _LINE_OF, "file_path string, line_no int, seq int, token string, signature_id string, severity string")
    more = {"pass": F.lit(resolve.LINE), "entropy": F.lit(0.0), "tier": F.lit("PATTERN"), "description": F.lit(""), "line_content": F.lit("")}
    return resolve.per_line(rows.withColumns(more), ["file_path", "line_no"]).select("file_path", "line_no", "token", "signature_id")


@query("SELECT doc_id, item FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9a-f]{12,40}'))) AS item FROM documents) EXCEPT SELECT doc_id, item FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'token = \"([0-9a-f]{40})', 1)) AS item FROM documents)")
def unlabelled_hashes(spark, sf_dir):
    """Long hex strings that no token assignment holds: an anti-join, as of findings with a baseline."""
    d = documents(spark, sf_dir)
    of = lambda p, g: d.select("doc_id", F.explode_outer(F.regexp_extract_all("content", F.lit(p), F.lit(g))).alias("item")).where("item is not null").distinct()
    return of("[0-9a-f]{12,40}", 0).join(of('token = "([0-9a-f]{40})', 1), ["doc_id", "item"], "left_anti")


@query()
def stream_of_findings(spark, sf_dir):
    """Findings of documents that arrive as a stream of files, as the batch scan gives them."""
    return _stream(spark, sf_dir)


def _stream(spark, sf_dir):
    from sieveline.streaming.scan import each_batch

    source = table(spark, sf_dir, "documents")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stream-")
    out = f"{folder}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/documents.parque[t]")
    rows = rows.select(document_path().alias("file_path"), F.coalesce("text", F.lit("")).alias("content"))
    # a batch that is tried again replaces its own folder
    sink = lambda found, n: found.drop("batch").write.mode("overwrite").parquet(f"{out}/batch={n}")
    run = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}-state").foreachBatch(each_batch(Config(), sink)).start()
    run.awaitTermination()
    return spark.read.parquet(out).drop("batch")


from sieveline.plans import cases  # noqa: E402, F401  registers its queries here
