"""Shannon entropy and the tokens it is taken of, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE64 = "A-Za-z0-9+/=_-"
HEX = "0-9a-fA-F"
#: A hex token's limit is this share of the threshold, and at least HEX_LEAST.
HEX_SHARE, HEX_LEAST = 4.0 / 6.0, 3.0


def shannon(x: Column) -> Column:
    """Bits a character; 0 for an empty string."""
    n = F.length(x)
    parts = F.transform(F.array_distinct(F.split(x, "")), lambda c: (n - F.length(F.replace(x, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.filter(parts, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(F.lit(0.0))


def base64_tokens(x: Column, least: int) -> Column:
    """Maximal runs of the base64 alphabets, but not of letters, dots and underscores or of hex digits only, nor of one character."""
    runs = F.regexp_extract_all(x, F.lit(rf"[{BASE64}]{{{least},}}"), F.lit(0))
    return F.filter(runs, lambda t: ~t.rlike(r"\A[A-Za-z._]*\z") & ~t.rlike(rf"\A[{HEX}]*\z") & ~t.rlike(r"\A(.)\1*\z"))


def hex_tokens(x: Column, least: int) -> Column:
    """Maximal runs of hex digits, of even length or at least 32."""
    runs = F.regexp_extract_all(x, F.lit(rf"[{HEX}]{{{least},}}"), F.lit(0))
    return F.filter(runs, lambda t: (F.length(t) % 2 == 0) | (F.length(t) >= 32))


def hits(x: Column, threshold: Column, least: int) -> Column:
    """(token, entropy, kind) of a line's base64 and then hex tokens whose entropy reaches the threshold; none if it has //."""
    low = F.greatest(threshold * HEX_SHARE, F.lit(HEX_LEAST))
    each = F.concat(
        F.transform(base64_tokens(x, least), lambda t: F.struct(t.alias("token"), shannon(t).alias("entropy"), F.lit("base64").alias("kind"))),
        F.transform(hex_tokens(x, least), lambda t: F.struct(t.alias("token"), shannon(t).alias("entropy"), F.lit("hex").alias("kind"))),
    )
    kept = F.filter(each, lambda h: h["entropy"] >= F.when(h["kind"] == "hex", low).otherwise(threshold))
    return F.when(x.contains("//"), F.slice(kept, 1, 0)).otherwise(kept)


def severity(entropy: Column) -> Column:
    return F.when(entropy >= 7, "CRITICAL").when(entropy >= 6, "HIGH").when(entropy >= 5, "MEDIUM").otherwise("LOW")


def is_base64_like(x: Column) -> Column:
    """Whether at least three quarters of the characters are of the base64 alphabets."""
    return (F.length(x) > 0) & (F.length(F.regexp_replace(x, rf"[^{BASE64}]", "")) / F.length(x) >= 0.75)


def is_hex_like(x: Column) -> Column:
    return x.rlike(rf"\A[{HEX}]+\z")
