"""Secret scans with a trigram index.

From each rule's regular expression the driver derives which trigrams every match must hold: alternatives of sets of
trigrams. The index has a posting (trigram, document) for every document and every trigram that some rule asks for.
A rule's candidates are the documents in the postings of all trigrams of one of its alternatives, and only they are
searched with its expression; a rule without mandatory trigrams is searched for in every text. DataFrame
operations only.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm import spans
from sieveline.llm.common import may_and_cannot, read, store

BASE = ("assign", "access", "hex")
#: Java patterns, read without regard to case where they start with (?i). The base kinds' lengths beyond what the pattern says are tested by `kept`.
RULES = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "github": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "slack": r"xox[abpr]-[A-Za-z0-9-]{10,}",
    "stripe": r"[sr]k_live_[A-Za-z0-9]{16,}",
    "google": r"AIza[A-Za-z0-9_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "login": r"[a-z]{3,10}://[A-Za-z0-9._-]{1,80}:[A-Za-z0-9._-]{1,80}@",
}
KINDS = tuple(RULES)
SECRETS = "array<struct<start:int,ord:int,end:int,kind:string>>"
#: Exact strings that a part of an expression may stand for before they are no longer listed.
MOST = 64


def _strings(node) -> list[str] | None:
    """The strings that a parsed part can match, lower-cased, or None if they are too many or unknown."""
    op, arg = node
    if op is C.LITERAL:
        return [chr(arg).lower()]
    if op is C.IN and all(o is C.LITERAL for o, _ in arg):
        return sorted({chr(a).lower() for _, a in arg})
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op is C.BRANCH:
        each = [_sequence(x) for x in arg[1]]
        return None if None in each else sorted({s for x in each for s in x})
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] != C.MAXREPEAT and arg[1] <= 4:
        one = _sequence(arg[2])
        if one is None:
            return None
        found = {""} if arg[0] == 0 else set()
        now = [""]
        for k in range(1, arg[1] + 1):
            now = [a + b for a in now for b in one]
            if len(now) > MOST:
                return None
            found |= set(now) if k >= arg[0] else set()
        return sorted(found)
    return None


def _sequence(nodes) -> list[str] | None:
    out = [""]
    for x in nodes:
        more = _strings(x)
        if more is None or len(out) * len(more) > MOST:
            return None
        out = [a + b for a in out for b in more]
    return out


def _clauses(nodes) -> list[frozenset[frozenset[str]]]:
    """What a match must satisfy: of each clause, all trigrams of one alternative."""
    found, held = [], [""]

    def close():
        nonlocal held
        if all(len(s) > 2 for s in held):
            found.append(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in held))
        held = [""]

    for op, arg in nodes:
        more = _strings((op, arg))
        if more is not None and len(held) * len(more) <= MOST:
            held = [a + b for a in held for b in more]
            continue
        close()
        if more is not None:
            held = more
        elif op is C.SUBPATTERN:
            found += _clauses(arg[-1])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            found += _clauses(arg[2])
        elif op is C.BRANCH:
            each = [_clauses(x) for x in arg[1]]
            if all(each):
                found.append(frozenset(a for x in each for a in min(x, key=len)))
    close()
    return found


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives of trigrams: a text with a match, lower-cased, holds all of one alternative. [] if any text may match."""
    out = [frozenset()]
    for clause in sorted(_clauses(_parser.parse(pattern)), key=len):
        if len(out) * len(clause) <= MOST:
            out = [a | b for a in out for b in clause]
    least = [a for a in set(out) if not any(b < a for b in out)]
    return [] if frozenset() in out else sorted(sorted(a) for a in least)


def _any_of(trigrams: list[str]) -> str:
    """A pattern that gives, at every place, the trigram that starts there, if it is one of these."""
    by: dict[str, dict[str, list[str]]] = {}
    for t in trigrams:
        by.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    e = lambda c: c if c.isalnum() else "\\" + c
    heads = (e(a) + "(?:" + "|".join(e(b) + "[" + "".join(map(e, c)) + "]" for b, c in rest.items()) + ")" for a, rest in by.items())
    return "(?i)(?=(" + "|".join(heads) + "))"


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """rows: id, h, text. Rows (trigram, id, h): the index, for these trigrams."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_any_of(trigrams)), F.lit(1)), F.lower))
    return rows.select(F.explode(found).alias("trigram"), "id", "h")


def candidates(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rows: id, h, text. Rows (id, h, rules): the rules whose trigram query the document satisfies."""
    spark = rows.sparkSession
    asked = [(r, k, t, len(a)) for r, p in rules.items() for k, a in enumerate(trigram_query(p)) for t in a]
    if not asked:
        return rows.select("id", "h", F.array().cast("array<string>").alias("rules")).where(F.lit(False))
    table = spark.createDataFrame(asked, "rule string, alternative int, trigram string, size int")  # at most MOST alternatives a rule
    index = postings(rows, sorted({t for *_, t, _ in asked}))
    both = index.join(F.broadcast(table), "trigram").groupBy("id", "h", "rule", "alternative").agg(F.countDistinct("trigram").alias("n"), F.first("size").alias("size"))
    return both.where("n = size").groupBy("id", "h").agg(F.collect_set("rule").alias("rules"))


def _kept(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1)) >= 6
    return F.lit(True)


def _spans(place: int, rule: str) -> Column:
    kept = F.filter(rule, lambda x: _kept(rule, x["match"]))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("ord"), x["end"].alias("end"), F.lit(rule).alias("kind")))


def find_secrets(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id and secrets, the spans of the text: (start, ord, end, kind), in order of start and rule.

    Edge cases: null and empty texts have no spans; a null doc_id is an id like any other; rows that are equal in
    doc_id and text share their postings and each get the spans; texts of any length are searched whole; an empty table
    gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("h"), text.alias("text"))
    # texts that are no rule's candidates are neither shuffled nor searched, but with the rules that any text may match
    asked = store(candidates(rows, rules))
    may, cannot = may_and_cannot(rows, asked, ["id", "h"])
    everywhere = [r for r, p in rules.items() if not trigram_query(p)]
    held = may.join(asked, ["id", "h"], "left")
    found = spans.find(held, "text", {r: (p, F.lit(True) if r in everywhere else F.array_contains("rules", r)) for r, p in rules.items()})
    rest = spans.find(cannot, "text", {r: (rules[r], F.lit(True)) for r in everywhere})
    of = lambda df, some: df.select("doc_id", F.array_sort(F.concat(F.array().cast(SECRETS), *[_spans(k, r) for k, r in enumerate(rules) if r in some])).alias("secrets"))
    return of(found, rules).unionByName(of(rest, everywhere))


def op6_secrets(spark, sf_dir):
    found = find_secrets(read(spark, sf_dir, "documents"))
    of = lambda k: F.filter("secrets", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("secrets", lambda x: x["ord"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(spans.joined(base, KINDS), 256).alias("base_sha256"), spans.joined(F.col("secrets"), KINDS).alias("spans"))


OP6_SQL = spans.sql(
    [
        (
            k,
            {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.get(k, p),
            {
                "assign": r"length(regexp_extract($m, '(?i)^(password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 6",
                "access": "length($m) >= 20",
                "hex": "length($m) >= 24",
            }.get(k, "true"),
        )
        for k, p in RULES.items()
    ],
    len(BASE),
)
