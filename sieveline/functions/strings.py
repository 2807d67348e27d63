"""String functions of the scanner, as columns.

Texts are ASCII where it matters to a result, so characters are counted where the rules speak of bytes, except for limits
on a line's length, which are in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
QUOTES = "\"'`"
#: What is stripped from both ends of a token.
WRAPPING = "\\\"'`{}[](),;:.<>"
#: A quoted literal: the closing quote is the first that no backslash precedes.
_QUOTED = "|".join(rf"{q}[^{q}]*+(?:(?<=\\){q}[^{q}]*+)*+(?<!\\){q}" for q in QUOTES)
# Names of settings that are taken for keys and not for values.
KEY_NAMES = (
    "api-key api_key auth-key auth_key auth-password auth_password access-key access_key secret-key secret_key private-key"
    " private_key api-token api_token auth-token auth_token access-token access_token secret-token secret_token bearer-token"
    " bearer_token client-id client_id client-secret client_secret app-key app_key app-secret app_secret db-password"
    " db_password database-password database_password redis-password redis_password mysql-password mysql_password"
    " admin-password admin_password user-password user_password webhook-secret webhook_secret signing-secret signing_key"
).split()
# Beginnings of names of variables that hold credentials.
VARIABLE_STARTS = (
    "auto default temp mock user admin db config sys old new test fake dummy local client server raw read write get set"
    " current next prev var const let my our their your"
).split()
VARIABLE_ENDS = "password token secret key auth".split()
DECLARATIONS = ["let ", "const ", "var ", "local ", "ref ", "ref", "mut "]


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def lstrip(x: Column, chars: str) -> Column:
    return F.ltrim(x, F.lit(chars))


def ascii_lower(x: Column) -> Column:
    """Lower-cases A-Z and nothing else; the Kelvin sign stays what it is."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_any(x: Column, words: list[str]) -> Column:
    from sieveline.functions.paths import any_of

    return x.rlike(any_of(words))


def starts_any(x: Column, words: list[str]) -> Column:
    from sieveline.functions.paths import any_of

    return x.rlike(r"\A" + any_of(words))


def quoted_literals(x: Column) -> Column:
    """The contents of all quoted literals in order, empty ones included."""
    whole = F.regexp_extract_all(x, F.lit(_QUOTED), F.lit(0))
    return F.transform(whole, lambda q: q.substr(F.lit(2), F.length(q) - 2))


def first_quoted(x: Column) -> Column:
    """The content of the first quoted literal; empty if there is none."""
    return F.coalesce(F.try_element_at(quoted_literals(x), F.lit(1)), F.lit(""))


def all_quoted(x: Column) -> Column:
    """The contents of all quoted literals that are not empty, joined by spaces; null if there are none."""
    found = F.filter(quoted_literals(x), lambda q: q != "")
    return F.when(F.size(found) > 0, F.array_join(found, " "))


def right_side(line: Column) -> Column:
    """What follows the assignment: after the first :=, else after the first = that is neither quoted nor part of a
    comparison, else after the first colon unless that begins a URL; null if there is none of these."""
    plain = rf"\A(?:[^\"'`=]|{_QUOTED}|(?<=[=!<>])=|=(?==))*+=(?!=)"
    colon = F.instr(line, ":")
    after_colon = strip(line.substr(colon + 1, F.length(line)))
    length = F.length(F.regexp_extract(line, plain, 0))
    return (
        F.when(line.contains(":="), strip(line.substr(F.instr(line, ":=") + 2, F.length(line))))
        .when(length > 0, F.when(length < F.length(line), strip(line.substr(length + 1, F.length(line)))))
        .when((colon > 0) & ~F.startswith(after_colon, F.lit("//")), after_colon)
    )


def secret_value(line: Column, source: Column) -> Column:
    """(value, assigned): the part of a line that may be a secret. On the right of an assignment it is the first quoted literal,
    or in files that are not source code the first word; elsewhere all quoted literals. Declarations of types have none."""
    typed = source & line.rlike(r"\A(?:export )?(?:type|interface) ")
    right = right_side(line)
    quoted = first_quoted(right)
    word = F.rtrim(F.regexp_extract(right, r"\A[^ \t\n\r]*", 0), F.lit("\"'`,;)"))
    bare = F.when(~source & (word != ""), word)
    assigned = F.struct(F.when(quoted != "", quoted).otherwise(bare).alias("value"), F.lit(True).alias("assigned"))
    loose = F.struct(all_quoted(line).alias("value"), F.lit(False).alias("assigned"))
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit(False).alias("assigned"))
    return F.when(typed, none).when(right.isNotNull(), assigned).otherwise(loose)


def compact(target: Column) -> Column:
    """The target without what joins strings, if it has 16 to 400 bytes; else empty."""
    return F.when(F.octet_length(target).between(16, 400), F.translate(target, " +.\"'`", "")).otherwise(F.lit(""))


def clean_token(x: Column) -> Column:
    return F.btrim(strip(x), F.lit(WRAPPING))


def mask(token: Column) -> Column:
    """Stars for all but the first six and the last four characters; for all of up to ten."""
    n = F.length(token)
    return F.when(n <= 10, F.call_function("repeat", F.lit("*"), n)).otherwise(F.concat(F.substring(token, 1, 6), F.call_function("repeat", F.lit("*"), n - 10), F.right(token, F.lit(4))))


def shorten(x: Column, most: int) -> Column:
    bare = strip(x)
    return F.when(F.octet_length(bare) > most, F.concat(F.substring(bare, 1, most), F.lit("…"))).otherwise(bare)


def decoded(x: Column) -> Column:
    """The text of padded standard base64 of at least 20 characters; null for anything else."""
    fits = x.rlike(r"\A[A-Za-z0-9+/]+={0,2}\z") & (F.length(x) >= 20) & (F.length(x) % 4 == 0)
    return F.when(fits, F.decode(F.call_function("try_to_binary", x, F.lit("base64")), "ISO-8859-1"))


def is_format_verb(token: Column) -> Column:
    return token.rlike(r"\A%[+\-# 0-9]*[vTtbcdoOqxXUeEfFgGsSpw]")


def is_key_name(token: Column) -> Column:
    return (F.length(token) <= 30) & token.rlike(r"\A[a-z_-]*[_-][a-z_-]*\z") & token.isin(KEY_NAMES)


def is_variable_reference(token: Column) -> Column:
    ends = "|".join(VARIABLE_ENDS)
    return token.rlike(r"\A\p{L}+\z") & F.lower(token).rlike(rf"\A(?:{'|'.join(VARIABLE_STARTS)})?(?:{ends})\z")


def clean_identifier(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def is_sequential(token: Column) -> Column:
    """Whether at least 12 characters in a row, repeats left out, are neighbours in ASCII or from 9 to a."""
    codes = F.transform(F.split(F.regexp_replace(F.lower(token), r"(?s)(.)\1+", "$1"), ""), F.ascii)

    def step(acc: Column, c: Column) -> Column:
        next_to = (F.abs(c - acc["last"]) == 1) | ((F.least(c, acc["last"]) == 57) & (F.greatest(c, acc["last"]) == 97))
        run = F.when(next_to, acc["run"] + 1).otherwise(1)
        return F.struct(c.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    start = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    return F.aggregate(codes, start, step, lambda acc: acc["most"] >= 12)


def variable_name(line: Column, token: Column) -> Column:
    """The name that the token is assigned to: within a token like name=value, else the last identifier before the assignment
    nearest on its left; empty if there is none."""

    def undeclared(x: Column) -> Column:
        for d in DECLARATIONS:
            x = F.regexp_replace(x, rf"(?i)\A{d}", "")
        return strip(x)

    inner = F.regexp_extract(token, r"(?s)\A([^=:]+)[=:].", 1)
    from_end = F.instr(F.reverse(line), F.reverse(token))
    left = line.substr(F.lit(1), F.length(line) - from_end - F.length(token) + 1)
    pattern = r"(?s)\A(.*)(?:((?<![=!<>])=(?!=))|:)"
    head = F.regexp_extract(left, pattern, 1)
    head = F.when(F.regexp_extract(left, pattern, 2) != "", F.regexp_replace(head, r":\z", "")).otherwise(head)
    name = undeclared(strip(head))
    last = F.regexp_extract(name, r"([A-Za-z0-9_-]+)[^A-Za-z0-9_-]*\z", 1)
    outer = F.when((from_end > 0) & left.rlike(pattern), F.when(last != "", last).otherwise(name)).otherwise(F.lit(""))
    return F.when(inner != "", undeclared(strip(inner))).otherwise(outer)


def is_newer(latest: Column, current: Column) -> Column:
    """Whether a version is later: by its three numbers, and a release is later than its pre-releases."""

    def parts(v: Column) -> Column:
        bare = F.regexp_replace(strip(v), r"\A[vV]", "")
        numbers = F.regexp_extract(bare, r"\A([0-9]+(?:\.[0-9]+)*)", 1)
        at = lambda i: F.coalesce(F.try_element_at(F.split(numbers, r"\."), F.lit(i)).try_cast("int"), F.lit(0))
        return F.struct(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"), (~bare.contains("-")).alias("d"))

    return parts(latest) > parts(current)
