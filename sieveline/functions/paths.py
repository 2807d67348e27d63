"""Predicates on file paths, as columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and names that decide how a file is scanned.
SOURCE = ".go .rb .js .ts .jsx .tsx .py .java .scala .kt .c .cpp .h .cs .php .pl .sh .bash .zsh".split()
NO_ENTROPY = (
    ".pem .rsa .crt .pub .json .nix .lock .sum .xml .html .md .txt .log .sql .yaml .yml .toml .gradle .kts .cmake .patch .diff .plist .editorconfig"
).split()
NO_ENTROPY_NAMES = "package-lock.json yarn.lock pnpm-lock.yaml".split()
SAFE_EXTENSIONS = ".gdnsuppress .snyk .dotsettings".split()
SAFE_NAMES = "doc.go cgmanifest.json .git-blame-ignore-revs product.json .terraform.lock.hcl".split()
SAFE_ENDS = ".pb.go .pb.gw.go _pb2.py _pb2_grpc.py".split()
SAFE_STARTS = ["zz_generated"]
TEST_ENDS = (
    "_test.go _spec.rb .test.js .spec.js .test.ts .spec.ts .test.tsx .spec.tsx .test.jsx .spec.jsx _spec.js _spec.ts _spec.tsx"
    " _spec.jsx readme .md .rst .supp .po .pot .mo .xliff"
).split()
TEST_SEGMENTS = (
    "test tests testdata fixtures __tests__ __mocks__ mock mocks sample samples docs doc spec specs seed seeds"
).split()
TEST_PARTS = ["mock", "fixture", "testdata"]


def any_of(values: Iterable[str]) -> str:
    return "(?:" + "|".join(map(re.escape, values)) + ")"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def extension(path: Column) -> Column:
    """From the last dot of the last segment, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def is_source(path: Column) -> Column:
    return extension(path).isin(SOURCE)


def is_netrc(path: Column) -> Column:
    return base_name(path) == ".netrc"


def without_entropy(path: Column) -> Column:
    return extension(path).isin(NO_ENTROPY) | path.rlike(any_of(NO_ENTROPY_NAMES))


def is_safe_file(path: Column) -> Column:
    """Files that by their kind hold no secrets."""
    base = F.lower(base_name(path))
    return extension(path).isin(SAFE_EXTENSIONS) | base.isin(SAFE_NAMES) | base.rlike(any_of(SAFE_ENDS) + r"\z") | base.rlike("^" + any_of(SAFE_STARTS))


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    way = F.replace(low, F.lit("\\"), F.lit("/"))
    return (
        low.rlike(any_of(TEST_ENDS) + r"\z")
        | way.rlike("(?:^|/)" + any_of(TEST_SEGMENTS) + r"(?:/|\z)")
        | way.rlike(any_of(TEST_PARTS))
        | F.exists(F.split(F.regexp_replace(way, r"[^/]*\z", ""), "/"), lambda s: s.contains("test") & (s != "testing"))
    )


def glob(pattern: str) -> str:
    """A regular expression for a shell pattern whose wild cards stop at slashes, without anchors; ValueError if it is malformed."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"{pattern!r}: no closing bracket")
            inside = pattern[i + 1 : end].replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{inside}]")
            i = end
        elif c == "\\":
            raise ValueError(f"{pattern!r}: ends in a backslash")
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def matches_glob(value: Column, patterns: Iterable[str]) -> Column:
    """Equal to a pattern, or matched by it as a whole."""
    ways = []
    for p in patterns:
        ways.append(re.escape(p))
        try:
            ways.append(glob(p))
        except ValueError:
            continue  # a malformed pattern matches only itself
    return value.rlike(r"\A(?:" + "|".join(ways) + r")\z") if ways else F.lit(False)


def has_extension(path: Column, extensions: Iterable[str]) -> Column:
    ends = [e.lower() for e in extensions]
    return F.lower(path).rlike(any_of(ends) + r"\z") if ends else F.lit(False)


def excluded(path: Column, patterns: Iterable[str]) -> Column:
    """A pattern matches the base name, if it has no slash, or the whole path, or a run of the path's segments; for the last,
    /** or /* at its end and **/ at its start are left out."""
    whole, base, inner = [], [], []
    for p in patterns:
        try:
            whole.append(glob(p))
            if not re.search(r"[/\\]", p):
                base.append(glob(p))
            short = p.replace("\\", "/").removesuffix("/**").removesuffix("/*").removeprefix("**/")
            if short.split("/")[0]:
                inner.append(glob(short))
        except ValueError:
            continue
    way = F.replace(path, F.lit("\\"), F.lit("/"))
    tests = [(path, r"\A(?:{})\z", whole), (base_name(path), r"\A(?:{})\z", base), (way, r"(?:\A|/)(?:{})(?:/|\z)", inner)]
    out = F.lit(False)
    for column, form, ways in tests:
        if ways:
            out = out | column.rlike(form.format("|".join(ways)))
    return out


def relative(path: Column, root: Column) -> Column:
    """The path below a root, or as it is."""
    start = F.concat(F.regexp_replace(root, r"/+\z", ""), F.lit("/"))
    return F.when(F.startswith(path, start), path.substr(F.length(start) + 1, F.length(path))).otherwise(path)


def is_binary(content: Column) -> Column:
    """Whether there is a zero byte among the first 8192."""
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\0"))
