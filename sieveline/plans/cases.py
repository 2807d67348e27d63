"""Queries that run single operators of the scanner on tokens, lines and events of the tables, with SQL that computes the same.

Where the tables lack a shape (comments, footers, assignments), it is put around what they hold by the same rule in both.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.functions import entropy as E
from sieveline.functions import paths
from sieveline.functions import strings as S
from sieveline.operators import lines, plausible, resolve
from sieveline.plans import scan as plan
from sieveline.plans.registry import _PATHS, _SHANNON, SQL_LINES, _any, all_paths, document_lines, documents, in_sql, pages, query, table, values

#: Tokens of shapes that pages lack.
TOKENS = [
    "abcdefghijklmnop", "0123456789abcdef", "aabbccddeeffgghhiijjkkllmm", "fedcba9876543210zz", "abcdefghijk", "changeme", "api_key", "client-secret", "userPassword", "authtoken",
    "MAX_RETRY_2", "std::string::npos", "a[0]xx[1]yyyyyy", "(?:abc.*)", "settings.key.value", "os.env.HOME_DIR", "key=abc", "key=abcdefghijklmnop", "key=ab=cdefghijk", "ab+cd/ef-gh_ij", "sk", "skAb12cd34ef56gh78ij90",
    "sk-Ab12cd34-ef56-gh78-ij90", "urn:isbn:0451450523", "vless://abcdefgh", "0123456789abcdef0123", "deadbeefdeadbeefdeadbeefdeadbeefdeadbeef", "password123", "$HOME/xyz/abcdef", "a->b->cdefghijkl", "'q8Zx72Lm',",
]
_MORE = "unnest([" + ", ".join(map(in_sql, [*TOKENS, "x" * 401])) + "])"
SQL_TOKENS = f"k AS (SELECT unnest(regexp_extract_all(url || ' ' || html, '[!-~]{{3,}}')) AS token FROM pages UNION SELECT {_MORE})"
#: Signatures and prefixes that tokens are held against.
AGAINST = [
    ("generic-token-key", "token"), ("generic-password-key", "password"), ("generic-pass-x", "pass"), ("high-entropy-hex", ""), ("high-entropy-base64", ""), ("aws", "AK"), ("openai", "sk"),
    ("mysql-dsn", "mysql://"), ("generic-base64-key", "key"),
]


def tokens(spark, sf_dir):
    found = pages(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    found = found.select(F.explode(F.regexp_extract_all(F.concat_ws(" ", "url", "content"), F.lit("[!-~]{3,}"), F.lit(0))).alias("token"))
    return found.unionByName(values(spark, [(x,) for x in [*TOKENS, "x" * 401]], "token string")).distinct()


_REASONS = rf"""too_long: length(g) > 400
address: regexp_matches(g, '^(http://|https://|//|www\.|urn:|vless://|vmess://|ss://|trojan://|shadowsocks://)') AND NOT regexp_matches(sig, '-dsn|url-basic-auth|webhook')
hash_length: sig = 'high-entropy-hex' AND length(g) IN (20, 40)
too_short: length(g) < CASE WHEN sig IN ('generic-password-key', 'generic-secret-key') OR sig LIKE 'generic-pass-%' OR sig LIKE 'generic-pwd-%' THEN 6 ELSE 10 END
brackets: length(translate(g, '(){{}}<>', '')) < length(g)
base64_form: contains(sig, 'base64') AND ((t <> g AND (length(t) < 6 OR contains(t, '='))) OR ((contains(t, '+') OR contains(t, '/')) AND (contains(t, '-') OR contains(t, '_'))))
settings: contains(lower(t), 'settings.') OR contains(lower(t), 'config.') OR contains(lower(t), 'env.')
generic_lower: generic AND regexp_full_match(t, '[a-z_]*')
generic_operator: generic AND (length(translate(t, '$[]*;|&"!? :', '')) < length(t) OR contains(t, '->'))
generic_dot: generic AND contains(t, '.')
generic_key_name: generic AND t IN ({", ".join(map(in_sql, S.KEY_NAMES))})
generic_letters: generic AND NOT contains(sig, 'password') AND regexp_full_match(t, '[A-Za-z]*')
dummy: contains(sig, 'password') AND lower(t) IN ({", ".join(map(in_sql, plausible.DUMMIES))})
constant: (generic OR sig IN ('hex', 'base64') OR contains(sig, 'high-entropy')) AND regexp_full_match(t, '[A-Z0-9_]*') AND regexp_matches(t, '[A-Z]')
scope: contains(t, '::')
grammar: contains(t, '.') AND regexp_full_match(t, '[a-z.-]*')
index: contains(t, '[') AND contains(t, ']')
pattern: contains(t, '(?:') OR contains(t, '.*')
only_prefix: t = prefix
short_prefix: length(prefix) BETWEEN 1 AND 3 AND (length(rest) < 20 OR regexp_full_match(rest, '[A-Za-z0-9]*'))"""


@query(
    f"WITH {SQL_TOKENS}, s(sig, prefix) AS (VALUES {', '.join(f'({in_sql(a)}, {in_sql(b)})' for a, b in AGAINST)}),"
    " a AS (SELECT token AS g, sig, prefix, starts_with(sig, 'generic-') AS generic, CASE WHEN contains(sig, 'base64') AND strpos(token, '=') BETWEEN 1 AND length(token) - 2 THEN substr(token, strpos(token, '=') + 1) ELSE token END AS t FROM k, s),"
    " b AS (SELECT *, CASE WHEN starts_with(lower(t), lower(prefix)) THEN substr(t, length(prefix) + 1) ELSE t END AS rest FROM a)"
    " SELECT g AS token, sig, concat_ws(',', " + ", ".join(f"CASE WHEN {x.split(': ', 1)[1]} THEN {in_sql(x.split(': ')[0])} END" for x in _REASONS.split("\n")) + ") AS reasons FROM b"
)
def plausible_reasons(spark, sf_dir):
    """All reasons that speak against each token, for each of AGAINST."""
    some = tokens(spark, sf_dir).select("token", F.inline(F.array(*[F.struct(F.lit(a).alias("sig"), F.lit(b).alias("prefix")) for a, b in AGAINST])))
    every = plausible.reasons(F.col("token"), F.col("prefix"), F.col("sig"), 20)
    return some.select("token", "sig", F.concat_ws(",", *[F.when(holds, F.lit(name)) for name, holds in every.items()]).alias("reasons"))


_CHARS = in_sql(S.WRAPPING)


@query(rf"""WITH {SQL_TOKENS}, d AS (SELECT token, list_filter(string_split(lower(token), ''), lambda c, i: i = 1 OR c <> string_split(lower(token), '')[i - 1]) AS c FROM k),
e AS (SELECT token, array_to_string(list_transform(range(2, len(c) + 1), lambda i: CASE WHEN abs(ascii(c[i]) - ascii(c[i - 1])) = 1 OR (c[i - 1] || c[i]) IN ('9a', 'a9') THEN '1' ELSE '0' END), '') AS steps FROM d)
SELECT token, trim(token, {_CHARS}) AS clean, regexp_replace(lower(token), '[^a-z0-9]', '', 'g') AS identifier, regexp_matches('%' || token, '^%[+\-# 0-9]*[vTtbcdoOqxXUeEfFgGsSpw]') AS verb,
 length(regexp_replace(token, '[^A-Za-z0-9+/=_-]', '', 'g')) / length(token) >= 0.75 AS base64_like, regexp_full_match(token, '[0-9a-fA-F]+') AS hex_like,
 regexp_full_match(lower(token), '({"|".join(S.VARIABLE_STARTS)})?({"|".join(S.VARIABLE_ENDS)})') AS reference, token IN ({", ".join(map(in_sql, S.KEY_NAMES))}) AS key_name,
 contains(steps, '11111111111') AS sequential, CASE WHEN length(base64(encode(token))) >= 20 THEN token END AS decoded FROM e""")
def token_tests(spark, sf_dir):
    """Clean form, identifier and predicates of each token; decoded is of its base64 form."""
    t = F.col("token")
    tests = {"verb": S.is_format_verb(F.concat(F.lit("%"), t)), "base64_like": E.is_base64_like(t), "hex_like": E.is_hex_like(t), "reference": S.is_variable_reference(t), "key_name": S.is_key_name(t), "sequential": S.is_sequential(t)}
    found = [x.alias(name) for name, x in tests.items()]
    return tokens(spark, sf_dir).select(t, S.clean_token(t).alias("clean"), S.clean_identifier(t).alias("identifier"), *found, S.decoded(F.regexp_replace(F.base64(F.encode(t, "UTF-8")), r"\s", "")).alias("decoded"))


# Lines that a word stands in: line, whether of a source file, value, whether assigned, name that the word is assigned to.
_SHAPES = [
    ('x := "@" + y', False, "@", True, "x"), ("key = @; rest", False, "@", True, "key"), ("key = @", True, None, True, "key"), ('if a == b "@"', True, "@", False, ""),
    ("a != \"@\" 'z'", False, "@ z", False, ""), ("db.name: '@'", False, "@", True, "name"), ("see http://x/@", False, None, False, "http"), ('type T = "@"', True, None, False, "T"),
    ('type T = "@"', False, "@", True, "T"), ('"a=b" = "@"', False, "@", True, "b"), ("plain @ =", False, None, False, ""), ("const my_key = `@`", True, "@", True, "my_key"), ('f("@", "")', True, "@", False, ""),
]
_SQL_WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{12,}')) AS word FROM documents)"


@query(
    f"WITH {_SQL_WORDS}, s(shape, value, assigned, name) AS (VALUES "
    + ", ".join(f"({k}, {in_sql(v) if v else 'NULL'}, {str(a).lower()}, {in_sql(n)})" for k, (_, _, v, a, n) in enumerate(_SHAPES))
    + ") SELECT word, shape, replace(value, '@', word) AS value, assigned, name FROM w, s"
)
def assigned_values(spark, sf_dir):
    """Values and names of lines of fixed shapes around each word of the documents."""
    words = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z]{12,}"), F.lit(0))).alias("word")).distinct()
    shapes = F.array(*[F.struct(F.lit(k).alias("shape"), F.replace(F.lit(x), F.lit("@"), F.col("word")).alias("line"), F.lit(s).alias("source")) for k, (x, s, *_) in enumerate(_SHAPES)])
    made = words.select("word", F.inline(shapes))
    got = made.select("word", "shape", S.secret_value(F.col("line"), F.col("source")).alias("v"), S.variable_name(F.col("line"), F.col("word")).alias("name"))
    return got.select("word", "shape", "v.value", "v.assigned", "name")


_EXTRA = ["home/.netrc", ".netrc", "a.netrc", "x/yarn.lock.bak", "a.MD", "src/b.Toml", "srcs/a", "pnpm-lock.yaml/x"]


@query(rf"""WITH p AS (SELECT path FROM (VALUES {', '.join(f'({in_sql(x)})' for x in [*_PATHS, *_EXTRA])}) t(path) UNION SELECT regexp_replace(url, '^[a-z]+://', '') FROM pages)
SELECT path, regexp_matches(lower(path), '({_any(paths.NO_ENTROPY)})$') OR regexp_matches(path, '{_any(paths.NO_ENTROPY_NAMES)}') AS no_entropy,
 path = '.netrc' OR path LIKE '%/.netrc' AS netrc, CASE WHEN path LIKE 'src/%' THEN substr(path, 5) ELSE path END AS below FROM p""")
def path_kinds(spark, sf_dir):
    p = F.col("path")
    some = all_paths(spark, sf_dir).unionByName(values(spark, [(x,) for x in _EXTRA], "path string")).distinct()
    return some.select(p, paths.without_entropy(p).alias("no_entropy"), paths.is_netrc(p).alias("netrc"), paths.relative(p, F.lit("src//")).alias("below"))


@query("SELECT doc_id, coalesce(strpos(text, 'q') > 0 AND strlen(substr(text, 1, strpos(text, 'q') - 1)) < 8192, false) AS is_binary FROM documents")
def binary_contents(spark, sf_dir):
    """Documents with zero bytes for each q."""
    zeros = F.encode(F.replace("content", F.lit("q"), F.lit("\0")), "UTF-8")
    return documents(spark, sf_dir).select("doc_id", paths.is_binary(zeros).alias("is_binary"))


_LEADS = ["", "#", "//", " # ", "// #", "Authorization: "]
_BLANKS = "chr(32) || " + " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 133, 160))


@query(f"""WITH {SQL_LINES}, x AS (SELECT doc_id, line_no, trim([{', '.join(map(in_sql, _LEADS))}][line_no % {len(_LEADS)} + 1] || raw, {_BLANKS}) AS t FROM l)
SELECT doc_id, line_no, CASE WHEN t LIKE '//%' THEN trim(substr(t, 3), {_BLANKS}) WHEN t LIKE '#%' THEN trim(substr(t, 2), {_BLANKS}) ELSE t END AS bare, strlen(t) >= 30 AND (contains(lower(t), 'bearer ') OR contains(lower(t), 'authorization:')) AS log FROM x""")
def comment_and_log_lines(spark, sf_dir):
    """Lines of documents behind signs of comments and words of logs."""
    lead = F.get(F.array(*map(F.lit, _LEADS)), F.col("line_no") % len(_LEADS))
    made = document_lines(spark, sf_dir).select("doc_id", "line_no", S.strip(F.concat(lead, "raw")).alias("t"))
    return made.select("doc_id", "line_no", lines.uncomment(F.col("t")).alias("bare"), lines.is_log(F.col("t")).alias("log"))


_TAILS = ["\n  -----END X", "\nx -----END X", "\nplain"]


@query(rf"""WITH c AS (SELECT doc_id, coalesce(text, '') || [{', '.join('chr(10) || ' + in_sql(x[1:]) for x in _TAILS)}][doc_id % 3 + 1] AS c FROM documents)
SELECT doc_id, len(list_filter(string_split(c, chr(10)), lambda x: regexp_matches(x, '^\s*-----END '))) > 0 AS has_footer FROM c""")
def footers(spark, sf_dir):
    tail = F.get(F.array(*map(F.lit, _TAILS)), (F.col("doc_id") % 3).cast("int"))
    files = documents(spark, sf_dir).select("doc_id", F.concat("content", tail).alias("content"))
    return lines.scanned(files, "").groupBy("doc_id").agg(F.max("has_footer").alias("has_footer"))


@query(rf"""WITH c AS (SELECT page_id, unnest(string_split(html, '"')) AS x FROM pages), d AS (SELECT page_id, x FROM c WHERE NOT contains(x, '//')),
b AS (SELECT page_id, 'base64' AS kind, unnest(regexp_extract_all(x, '[A-Za-z0-9+/=_-]{{12,}}')) AS token FROM d), h AS (SELECT page_id, 'hex' AS kind, unnest(regexp_extract_all(x, '[0-9a-fA-F]{{12,}}')) AS token FROM d),
a AS (SELECT * FROM b WHERE NOT regexp_full_match(token, '[A-Za-z._]*') AND NOT regexp_full_match(token, '[0-9a-fA-F]*') AND replace(token, token[1], '') <> '' UNION ALL SELECT * FROM h WHERE length(token) % 2 = 0 OR length(token) >= 32),
e AS (SELECT *, {_SHANNON.format('token')} AS e FROM a)
SELECT page_id, kind, token, round(e, 6) AS entropy, count(*) AS n FROM e WHERE e >= CASE WHEN kind = 'hex' THEN greatest(3.0, 3.01 * 4 / 6) ELSE 3.01 END GROUP BY ALL""")
def entropy_hits(spark, sf_dir):
    """Random tokens of the parts of pages between double quotes."""
    parts = pages(spark, sf_dir).select("page_id", F.explode(F.split("content", '"')).alias("x"))
    each = parts.select("page_id", F.inline(E.hits(F.col("x"), F.lit(3.01), 12)))
    return each.groupBy("page_id", "kind", "token", F.round("entropy", 6).alias("entropy")).agg(F.count(F.lit(1)).alias("n"))


_SQL_EVENTS = """f AS (SELECT user_id::VARCHAR AS file_path, event_id, r + r // 5 AS line_no, CASE WHEN event_id % 11 < 5 THEN 'high-entropy-hex' WHEN event_id % 11 < 9 THEN 'high-entropy-base64' ELSE 'private-key' END AS signature_id
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events))"""


def event_findings(spark, sf_dir):
    """Events as findings: users are files, every fifth line is left out."""
    rows = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    kind = F.when(F.col("event_id") % 11 < 5, "high-entropy-hex").when(F.col("event_id") % 11 < 9, "high-entropy-base64").otherwise("private-key")
    return rows.select(F.col("user_id").cast("string").alias("file_path"), "event_id", (F.col("r") + F.floor(F.col("r") / 5)).alias("line_no"), kind.alias("signature_id"))


@query(f"""WITH {_SQL_EVENTS}, s AS (SELECT *, CASE WHEN signature_id = lag(signature_id) OVER w AND line_no - lag(line_no) OVER w <= 1 AND signature_id <> 'private-key' THEN 0 ELSE 1 END AS s FROM f WINDOW w AS (PARTITION BY file_path ORDER BY line_no)),
i AS (SELECT *, sum(s) OVER (PARTITION BY file_path ORDER BY line_no) AS i FROM s), g AS (SELECT *, count(*) OVER (PARTITION BY file_path, i) AS n, min(line_no) OVER (PARTITION BY file_path, i) AS first FROM i),
h AS (SELECT *, n >= 3 AND signature_id <> 'private-key' AS blob, CASE WHEN signature_id LIKE '%hex' THEN 'Hex' ELSE 'Base64' END AS kind FROM g)
SELECT file_path, line_no, CASE WHEN blob THEN 'massive-' || lower(kind) || '-blob' ELSE signature_id END AS signature_id, CASE WHEN blob THEN 'CRITICAL' ELSE 'LOW' END AS severity,
 CASE WHEN blob THEN '<' || n || ' lines aggregated>' ELSE 't' || event_id END AS token, CASE WHEN blob THEN '[... ' || n || ' consecutive lines of ' || kind || ' ...]' ELSE '' END AS line_content FROM h WHERE NOT blob OR line_no = first""")
def blobs_of_events(spark, sf_dir):
    """resolve.roll_up on events."""
    more = {"place": F.lit(0), "token": F.concat(F.lit("t"), "event_id"), "line_content": F.lit(""), "description": F.lit(""), "severity": F.lit("LOW")}
    out = resolve.roll_up(event_findings(spark, sf_dir).withColumns(more), ["file_path"])
    return out.select("file_path", "line_no", "signature_id", "severity", "token", "line_content")


@query(rf"""WITH {_SQL_EVENTS} SELECT file_path, event_id, signature_id FROM f WHERE (signature_id <> 'private-key' OR file_path::BIGINT % 2 = 0) AND NOT regexp_matches('t' || event_id, '^t\d*7$|^t1\d$|^t[2-3]0$|^t44$')""")
def headers_and_allowlist(spark, sf_dir):
    """Events of which users with even numbers have a footer, without those that an allowlist names."""
    rows = event_findings(spark, sf_dir).withColumns({"has_footer": F.col("file_path").cast("long") % 2 == 0, "token": F.concat(F.lit("t"), "event_id")})
    return resolve.drop_allowed(resolve.drop_headers(rows), ("t*7", "t1?", "t[2-3]0", "t44")).select("file_path", "event_id", "signature_id")


@query("""WITH e AS (SELECT event_id // 2 AS line_no, event_id, (CASE WHEN event_id % 4 = 1 THEN (event_id - 1) || 'z' ELSE event_id::VARCHAR END) AS token FROM events),
p AS (SELECT a.*, b.token AS before FROM e a LEFT JOIN e b ON b.event_id = a.event_id - 1 AND b.line_no = a.line_no)
SELECT line_no, token FROM p WHERE before IS NULL OR NOT (contains(before, token) OR contains(token, before))""")
def overlaps_dropped(spark, sf_dir):
    """Two events are the candidates of a line of the pass of random tokens, where the later of two that overlap goes."""
    e = F.col("event_id")
    token = F.when(e % 4 == 1, F.concat((e - 1).cast("string"), F.lit("z"))).otherwise(e.cast("string"))
    more = {"pass": F.lit(resolve.RANDOM), "entropy": F.lit(0.0), "tier": F.lit("ENTROPY"), "signature_id": F.lit("high-entropy-hex"), "severity": F.lit("LOW"), "description": F.lit(""), "line_content": F.lit("")}
    rows = table(spark, sf_dir, "events").select(F.floor(e / 2).alias("line_no"), (e % 2).cast("int").alias("seq"), token.alias("token"))
    return resolve.per_line(rows.withColumns(more), ["line_no"]).select("line_no", "token")


#: Lines that a random token stands in, for what speaks against it there.
_AROUND = [
    "key = ~", "x @~", "a @b ~", "image: sha256:~", "commit ~", "Client_ID=~", "Verify sha256sum ~", 'hex.DecodeString("~")', '"$ref": "~"', '"digest": "~"', "/sys/class/~", "my_token := '~'", "auth: ~",
]
_HELD = "[A-Za-z0-9+/=_.-]{12,}"
_SQL_HELD = f"t AS (SELECT DISTINCT unnest(regexp_extract_all(html, '{_HELD}')) AS token FROM pages UNION SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9a-f]{{12,}}')) FROM documents UNION SELECT {_MORE})"


def _one_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {in_sql(w)})" for w in words) + ")"


_HARMLESS = f"""mention: strpos(line, token) > 1 AND line[strpos(line, token) - 1] = '@'
image_digest: hex AND contains(line, 'sha256:')
named_hash: hex AND length(token) IN (40, 64) AND {_one_of('lower(line)', plan.HASH_WORDS)}
client_id: hex AND {_one_of('lower(line)', plan.CLIENT_WORDS)}
checksum: hex AND {_one_of('lower(line)', plan.CHECK_WORDS)}
decoded_constant: hex AND {_one_of('line', plan.DECODERS)}
dotted: NOT hex AND contains(token, '.')
camel_case: NOT hex AND regexp_full_match(token, '[A-Za-z._]*') AND regexp_matches(token, '[A-Z]') AND regexp_matches(token, '[a-z][a-z][a-z][a-z]')
decimal: hex AND NOT regexp_matches(token, '[^0-9]')
kernel_path: starts_with(compact, '/sys/')
api_schema: {_one_of('line', plan.API_FIELDS)}
digest_field: hex AND {_one_of('lower(line)', plan.DIGEST_FIELDS)}"""


@query(
    f"WITH {_SQL_HELD}, s AS (SELECT unnest([{', '.join(map(in_sql, _AROUND))}]) AS shape), l AS (SELECT token, shape, replace(shape, '~', token) AS line, regexp_full_match(token, '[0-9a-fA-F]+') AS hex FROM t, s),"
    " c AS (SELECT *, CASE WHEN strlen(line) BETWEEN 16 AND 400 THEN translate(line, ' +.\"`' || chr(39), '') ELSE '' END AS compact,"
    " CASE WHEN contains(line, ':=') THEN split_part(line, ':=', 1) WHEN contains(line, '=') THEN split_part(line, '=', 1) WHEN contains(line, ':') THEN split_part(line, ':', 1) ELSE '' END AS lhs FROM l)"
    " SELECT token, shape, concat_ws(',', " + ", ".join(f"CASE WHEN {x.split(': ', 1)[1]} THEN {in_sql(x.split(': ')[0])} END" for x in _HARMLESS.split("\n")) + ") AS reasons,"
    f" CASE WHEN {_one_of('lower(lhs)', plan.CREDENTIALS)} THEN {plan.NAMED}::DOUBLE ELSE 5.0::DOUBLE END AS threshold FROM c"
)
def harmless_reasons(spark, sf_dir):
    """What speaks against random tokens in lines of fixed shapes, and the entropy that they must have there if assigned."""
    found = lambda name, column, p: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(column, F.lit(p), F.lit(0))).alias("token"))
    some = found("pages", "html", _HELD).unionByName(found("documents", "text", "[0-9a-f]{12,}")).unionByName(values(spark, [(x,) for x in [*TOKENS, "x" * 401]], "token string")).distinct()
    made = some.select("token", F.explode(F.array(*map(F.lit, _AROUND))).alias("shape")).withColumn("line", F.replace("shape", F.lit("~"), F.col("token")))
    kind = F.when(E.is_hex_like(F.col("token")), "hex").otherwise("base64")
    every = plan.harmless(F.col("line"), F.col("token"), kind, S.compact(F.col("line")))
    reasons = F.concat_ws(",", *[F.when(holds, F.lit(name)) for name, holds in every.items()]).alias("reasons")
    return made.select("token", "shape", reasons, plan.threshold(F.col("line"), F.lit(True), 5.0).alias("threshold"))
