"""Signature matching: where prefixes occur in a text, and which token each occurrence leads to."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.catalog import Signature, names_value
from sieveline.functions import strings as S
from sieveline.functions.plan import fixed

ADDRESS_IDS = "-dsn|url-basic-auth|webhook"


def table(spark: SparkSession, sigs: list[Signature]) -> DataFrame:
    rows = [(k, *s, names_value(s.prefix)) for k, s in enumerate(sigs)]
    return spark.createDataFrame(rows, "ord int, id string, prefix string, severity string, validator string, description string, names_value boolean")


def literal(sigs: list[Signature]) -> Column:
    """The signatures as an array of structs, a literal of the plan."""

    # as one JSON text, which the optimizer folds: a call for each value would take longer than the scan of a small table
    rows = [{"ord": k, "id": s.id, "prefix": s.prefix, "low": s.prefix.lower(), "severity": s.severity, "validator": s.validator, "description": s.description, "names_value": names_value(s.prefix)} for k, s in enumerate(sigs)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<ord:int,id:string,prefix:string,low:string,severity:string,validator:string,description:string,names_value:boolean>>")


def any_prefix(low: Column, sigs: list[Signature]) -> Column:
    """Whether some prefix occurs, which is false for most lines. low: the text in lower case, as a column and not as an
    expression, since it is looked at once for each of the shortest prefixes; a prefix that holds another adds nothing."""
    prefixes = {s.prefix.lower() for s in sigs}
    short = sorted(p for p in prefixes if not any(q != p and q in p for q in prefixes))
    out = F.contains(low, F.lit(short[0]))
    for p in short[1:]:
        out = out | F.contains(low, F.lit(p))
    return out


def may_stand_alone(text: Column, sigs: list[Signature]) -> Column:
    """Whether some prefix occurs where no letter, digit or underscore precedes. Short prefixes occur within words of most
    lines, so this is asked before occurrences are placed."""
    heads = sorted({s.prefix.lower() for s in sigs})
    short = [p for p in heads if not any(q != p and p.startswith(q) for q in heads)]
    return text.rlike("(?i)(?<![A-Za-z0-9_])(?:" + "|".join(f"\\Q{p}\\E" for p in short) + ")")


def any_joined_prefix(text: Column, sigs: list[Signature]) -> Column:
    """Whether a prefix occurs that need not stand alone, since it begins with an underscore."""
    out = F.lit(False)
    for p in sorted({s.prefix.lower() for s in sigs if s.prefix.startswith("_")}):
        out = out | F.contains(F.lower(text), F.lit(p))
    return out


def overlaps_itself(prefix: str) -> bool:
    return any(prefix.endswith(prefix[:k]) for k in range(1, len(prefix)))


def occurrences(df: DataFrame, text: str, sigs: list[Signature]) -> DataFrame:
    """A row for each occurrence of each prefix in the text, without regard to ASCII case, overlapping ones included: sig, start
    and stop (1-based, inclusive) and seq, which orders those of a text by end, then longest prefix, then signature."""
    df = fixed(df, {"low_": S.ascii_lower(F.col(text))})
    df = fixed(df, {"held_": F.filter(literal(sigs), lambda sig: F.contains("low_", sig["low"]))}).withColumn("sig", F.explode_outer("held_")).drop("held_").where("sig is not null")
    n = F.length("sig.low")
    parts = F.transform(F.split("low_", F.concat(F.lit("\\Q"), "sig.low", F.lit("\\E")), -1), F.length)
    df = fixed(df, {"parts_": parts, "n_": n})
    # where one occurrence can begin in another, every place is tried; else what lies between them tells where they are
    each = F.filter(F.sequence(F.lit(1), F.length("low_") - F.col("n_") + 1), lambda i: F.col("low_").substr(i, F.col("n_")) == F.col("sig.low"))
    between = F.transform(F.sequence(F.lit(1), F.size("parts_") - 1), lambda k: F.aggregate(F.slice("parts_", 1, k), F.lit(1), lambda acc, x: acc + x) + (k - 1) * F.col("n_"))
    selves = [s.prefix.lower() for s in sigs if overlaps_itself(s.prefix.lower())]
    df = df.withColumn("start", F.explode_outer(F.when(F.col("sig.low").isin(selves), each).otherwise(between) if selves else between))
    df = fixed(df, {"stop": F.col("start") + F.col("n_") - 1}).drop("low_", "parts_")
    return df.withColumn("seq", F.col("stop") * (1 << 18) + (255 - F.least("n_", F.lit(255))) * (1 << 10) + F.least("sig.ord", F.lit(1023))).drop("n_")


def stands_alone(text: Column, start: Column) -> Column:
    """Whether no letter, digit or underscore precedes."""
    return ~text.substr(start - 1, F.lit(1)).rlike("[A-Za-z0-9_]") | (start == 1)


def extract(df: DataFrame, text: str, sig: str, start: str, stop: str) -> DataFrame:
    """Adds token: what the occurrence leads to, or an empty string.

    After a prefix that names a value the rest of the name is passed over; in source code the value of a generic one must be
    quoted. A PEM header is taken whole, and so are template expressions; else quotes around the value end it, or white space
    and, but for addresses, @ / ? and &. What is left of brackets around it goes; calls give nothing; a generic name
    must be followed by = or : unless the file is a .netrc.
    """
    c = F.col
    names, generic = c(f"{sig}.names_value"), F.startswith(c(f"{sig}.id"), F.lit("generic-"))
    rest = c(text).substr(c(stop) + 1, F.length(text))
    first = F.when(names, S.strip(F.regexp_replace(rest, r"\A[A-Za-z0-9_]+", ""))).otherwise(S.strip(c(text).substr(c(start), F.length(text))))
    df = fixed(df, {"rest_": rest, "a_": first})
    unquoted = names & generic & c("is_source") & ~c("a_").rlike("\\A[^=:]*[=:][ \t\r\n]*[\"'`]")
    header = F.regexp_extract("a_", r"(?s)\A-----BEGIN .*?-----", 0)
    whole = F.when(unquoted, "").when(F.startswith("a_", F.lit("-----BEGIN ")), F.when(header != "", header).otherwise(c("a_")))
    df = fixed(df, {"whole_": whole, "b_": S.lstrip(c("a_"), "=:,() \t\n\r")})
    df = fixed(df, {"q_": F.regexp_extract("b_", "\\A[\"'`]", 0)})
    inner = c("b_").substr(F.lit(2), F.length("b_"))
    df = fixed(df, {"value_": S.lstrip(inner, "=:, \t\n\r")})
    hop = (c("q_") != "") & c("value_").rlike("\\A[\"'`]")
    df = fixed(df, {
        "q_": F.when(hop, F.substring("value_", 1, 1)).otherwise(c("q_")),
        "b_": F.when(hop, c("value_").substr(F.lit(2), F.length("value_"))).when(c("q_") != "", inner).otherwise(c("b_")),
    })
    template = F.regexp_extract("b_", r"(?s)\A\$?\{\{.*?\}\}", 0)
    whole = F.coalesce("whole_", F.when(c("b_").rlike(r"\A\$?\{\{"), F.when(template != "", template).otherwise(c("b_"))))
    cut = F.when(c("q_") != "", F.expr("substring_index(b_, q_, 1)")).otherwise(F.regexp_extract("b_", "\\A(?:[\"'`]|)[^\"'`]*", 0))
    address = c(f"{sig}.id").rlike(ADDRESS_IDS)
    df = fixed(df, {"whole_": whole, "cut_": cut})
    cut = c("cut_")
    df = fixed(df, {"b_": F.when(address, F.regexp_extract(cut, r"\A[^ \t\n\r]*", 0)).otherwise(F.regexp_extract(cut, r"\A[^ \t\n\r@/?&]*", 0))})
    df = fixed(df, {"b_": F.when(c("b_").rlike("[()]"), "").otherwise(S.clean_token(c("b_")))})
    between = c("rest_").substr(F.lit(1), F.instr(c("rest_"), c("b_")) - 1)
    unassigned = generic & ~c("is_netrc") & ~between.rlike("[=:]")
    token = F.coalesce("whole_", F.when((c("b_") == "") | unassigned, "").otherwise(c("b_")))
    return fixed(df, {"token": token}).drop("rest_", "a_", "whole_", "b_", "q_", "value_", "cut_")


def is_phrase(target: Column, words: tuple[str, ...]) -> Column:
    """Whether it is 12, 15, 18, 21 or 24 words of the list, with single spaces between them."""
    each = F.split(target, " ", -1)
    # the list is a map with constant-time look-up only if it is a set, so membership is by array_except
    return F.size(each).isin(12, 15, 18, 21, 24) & (F.size(F.array_except(each, F.split(F.lit(" ".join(words)), " "))) == 0)
