"""Which tokens can be secrets at all: reasons against one, each a named predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import strings as S

# What addresses start with, and passwords of examples.
ADDRESSES = "http:// https:// // www. urn: vless:// vmess:// ss:// trojan:// shadowsocks://".split()
DUMMIES = "password new-password current-password false true null undefined dummy test secret example changeme password123".split()
#: Signatures whose tokens are addresses.
ADDRESS_IDS = "-dsn|url-basic-auth|webhook"


def base64_value(token: Column, sig: Column) -> Column:
    """Of base64 tokens like name=value the value."""
    at = F.instr(token, "=")
    return F.when(sig.contains("base64") & (at > 0) & (at < F.length(token) - 1), token.substr(at + 1, F.length(token))).otherwise(token)


def reasons(given: Column, prefix: Column, sig: Column, least: int) -> dict[str, Column]:
    """Reason by reason, whether it speaks against the token."""
    token = base64_value(given, sig)
    low = F.lower(token)
    generic = F.startswith(sig, F.lit("generic-"))
    short_ok = sig.rlike(r"\Ageneric-(?:password-key\z|secret-key\z|pass-|pwd-)")
    entropic = generic | sig.isin("hex", "base64") | sig.contains("high-entropy")
    rest = F.when(F.startswith(F.lower(token), F.lower(prefix)), token.substr(F.length(prefix) + 1, F.length(token))).otherwise(token)
    tail = token != given
    return {
        "too_long": F.length(given) > 400,
        "address": S.starts_any(given, ADDRESSES) & ~sig.rlike(ADDRESS_IDS),
        "hash_length": (sig == "high-entropy-hex") & F.length(given).isin(20, 40),
        "too_short": F.length(given) < F.when(short_ok, 6).otherwise(least // 2),
        "brackets": given.rlike(r"[(){}<>]"),
        "base64_form": sig.contains("base64") & ((tail & ((F.length(token) < 6) | token.contains("="))) | (token.rlike("[+/]") & token.rlike("[-_]"))),
        "settings": low.rlike(r"settings\.|config\.|env\."),
        "generic_lower": generic & token.rlike(r"\A[a-z_]*\z"),
        "generic_operator": generic & token.rlike(r"[$\[\]*;|&\"!? :]|->"),
        "generic_dot": generic & token.contains("."),
        "generic_key_name": generic & S.is_key_name(token),
        "generic_letters": generic & ~sig.contains("password") & token.rlike(r"\A[A-Za-z]*\z"),
        "dummy": sig.contains("password") & low.isin(DUMMIES),
        "constant": entropic & token.rlike(r"\A[A-Z0-9_]*\z") & token.rlike("[A-Z]"),
        "scope": token.contains("::"),
        "grammar": token.contains(".") & token.rlike(r"\A[a-z.-]*\z"),
        "index": token.contains("[") & token.contains("]"),
        "pattern": token.contains("(?:") | token.contains(".*"),
        "only_prefix": token == prefix,
        "short_prefix": F.length(prefix).between(1, 3) & ((F.length(rest) < least) | rest.rlike(r"\A[A-Za-z0-9]*\z")),
    }


def first_reason(token: Column, prefix: Column, sig: Column, least: int) -> Column:
    """The first reason against a token, or null if it is plausible."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(reasons(token, prefix, sig, least).items()):
        out = F.when(holds, name).otherwise(out)
    return out


def is_plausible(token: Column, prefix: Column, sig: Column, least: int) -> Column:
    return first_reason(token, prefix, sig, least).isNull()
