"""Personal data: regular expressions propose spans, checksums confirm them, and words nearby adjust the score.

DataFrame expressions only, and no shuffle: every text is searched where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm import spans
from sieveline.llm.common import read

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Possessive, so that no run of characters is read more than once; a match starts where its run starts or the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: What a text must have for a pattern to be tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
#: The score of a confirmed span, what a word nearby adds, and those words.
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.2), "card": (0.7, 0.3), "phone": (0.5, 0.3), "iban": (0.8, 0.2), "ssn": (0.3, 0.5)}
WORDS = {"email": "mail|contact", "ip": "ip|address|host|server", "card": "card|credit|debit|visa|payment", "phone": "phone|tel|call|mobile|fax", "iban": "iban|bank|account", "ssn": "ssn|social|security"}
NEAR = {k: rf"\b(?:{w})\b" for k, w in WORDS.items()}
#: Characters before and after a span in which such words count; kinds beyond the base need the score.
BEFORE, AFTER, LEAST = 40, 20, 0.5
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(acc: Column, x: Column) -> Column:
        twice = x.cast("int") * 2
        more = F.when(acc["odd"], x.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
        return F.struct((acc["sum"] + more).alias("sum"), (~acc["odd"]).alias("odd"))

    zero = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd"))
    return F.aggregate(F.split(F.reverse(number), "(?!$)(?<=.)"), zero, add, lambda acc: acc["sum"] % 10 == 0)


def mod97(number: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 modulo 97 once its first four characters stand last and letters are numbers from 10."""
    moved = F.split(F.concat(number.substr(F.lit(5), F.lit(100)), number.substr(1, 4)), "(?!$)(?<=.)")
    step = lambda acc, c: F.when(c < "A", (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(moved, F.lit(0), step, lambda acc: acc == 1)


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        d = digits(match)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and pii, the spans of the text: (start, ord, end, kind, score), in order of start and kind.

    Base kinds keep every confirmed span; others also need a score of LEAST, which some reach only with context: whole words
    that speak of the kind, just before or after.

    Edge cases: null and empty texts have no spans; a null doc_id stays null; rows with the same doc_id are each searched; texts of
    any length and with any number of spans are searched whole; an empty table gives no rows; other columns of docs are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = spans.find(rows, "text", {k: (PATTERNS[k], F.col("text").contains("@") if k == "email" else F.col("text").rlike(NEEDS[k])) for k in KINDS})

    def scored(kind: str) -> Column:
        base, more = SCORES[kind]

        def one(x: Column) -> Column:
            before = spans.part(F.col("chunks"), F.greatest(x["start"] - BEFORE, F.lit(0)), F.least(x["start"], F.lit(BEFORE)))
            near = F.lower(F.concat_ws(" ", before, spans.part(F.col("chunks"), x["end"], F.lit(AFTER))))
            score = F.lit(base) + F.when(near.rlike(NEAR[kind]), more).otherwise(0.0)
            return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

        found = F.transform(F.filter(kind, lambda x: confirmed(kind, x["match"])), one)
        return found if kind in BASE else F.filter(found, lambda x: x["score"] >= LEAST)

    any_found = F.lit(False)
    for k in KINDS:
        any_found = any_found | (F.size(k) > 0)
    rows = rows.withColumn("chunks", F.when(any_found, spans.chunks(F.col("text"))))
    return rows.select("doc_id", F.array_sort(F.concat(*map(scored, KINDS))).alias("pii"))


def op5_pii(spark, sf_dir):
    found = find_pii(read(spark, sf_dir, "documents"))
    of = lambda k: F.filter("pii", lambda x: x["kind"] == k)
    base = F.filter("pii", lambda x: x["ord"] < len(BASE))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(spans.joined(base, KINDS), 256).alias("base_sha256"), spans.joined(F.col("pii"), KINDS).alias("spans"), F.round(F.array_max(F.transform("pii", lambda x: x["score"])), 2).alias("max_score"))


def _near(words: str) -> str:
    return f"regexp_matches(lower(substr($t, greatest($s - {BEFORE}, 0)::BIGINT + 1, least($s, {BEFORE})) || ' ' || substr($t, $e + 1, {AFTER})), '{words}')"


_DIGITS = "regexp_replace($m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN {_DIGITS}[i]::INT ELSE CASE WHEN {_DIGITS}[i]::INT > 4 THEN {_DIGITS}[i]::INT * 2 - 9 ELSE {_DIGITS}[i]::INT * 2 END END)) % 10 = 0"
_IBAN = "replace($m, ' ', '')"
_MOD97 = f"list_reduce(list_concat([0], list_transform(range(1, length({_IBAN}) + 1), lambda i: ascii((substr({_IBAN}, 5) || substr({_IBAN}, 1, 4))[i]) - 48)), lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c - 7) % 97 END) = 1"
OP5_SQL = spans.sql(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split($m, '.'), lambda p: try_cast(p AS HUGEINT) > 255 OR try_cast(p AS HUGEINT) IS NULL)) = 0"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
        ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", _MOD97),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _near(NEAR["ssn"])),
    ],
    len(BASE),
    [f"{SCORES[k][0]} + CASE WHEN {_near(NEAR[k])} THEN {SCORES[k][1]} ELSE 0 END" for k in KINDS],
)
