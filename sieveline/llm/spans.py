"""Spans of regular expressions in column expressions, and the same in SQL.

Spark gives the matches of a pattern but not where they are; splitting the text by the same pattern gives what
lies between, and the running lengths of both give every start and end in code points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"


#: Spans placed at a time: a list that is appended to is copied each time, so none grows beyond this.
BLOCK = 256
#: Code points from one chunk of a text to the next, and how many more a chunk has.
CHUNK, BEYOND = 4096, 64


def find(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds a column for each name: the leftmost non-overlapping matches of its Java pattern, as (start, end, match).
    The pattern runs only where the condition beside it holds, and the text is split only where there are matches. The time grows
    with the length of the text, whatever the number of matches."""
    none = F.array().cast("array<string>")
    df = df.select("*", *[F.when(F.coalesce(when, F.lit(False)), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(none).alias(name) for name, (p, when) in patterns.items()])
    # lengths, then blocks of them, then the place where each block starts, each in a step of its own
    df = df.withColumns({f"{name}_z": F.when(F.size(name) > 0, F.zip_with(F.slice(F.split(F.col(text), p, -1), F.lit(1), F.size(name)), name, _lengths)) for name, (p, _) in patterns.items()})
    df = df.withColumns({f"{name}_b": _blocks(F.col(f"{name}_z")) for name in patterns})
    df = df.withColumns({f"{name}_s": _starts(F.transform(f"{name}_b", lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["g"] + x["n"]))) for name in patterns})
    return df.withColumns({name: F.coalesce(F.flatten(F.zip_with(f"{name}_b", f"{name}_s", _placed)), F.array().cast(SPAN)) for name in patterns}).drop(*[f"{name}_{x}" for name in patterns for x in "zbs"])


def _blocks(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))


def _lengths(gap: Column, match: Column) -> Column:
    return F.struct(F.length(gap).alias("g"), F.length(match).alias("n"), match.alias("m"))


def _starts(sizes: Column) -> Column:
    """The sums of the sizes before each, in blocks of blocks as well."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, empty, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def _placed(block: Column, start: Column) -> Column:
    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + x["n"]
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("start"), e.alias("end"), x["m"].alias("match"))).alias("out"))

    return F.aggregate(block, F.struct(start.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])


def chunks(text: Column) -> Column:
    """The text in chunks of CHUNK code points, each with the first BEYOND of the next: a part of the text is found without counting from its start."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda k: text.substr(k * CHUNK + 1, F.lit(CHUNK + BEYOND)))


def part(chunked: Column, start: Column, size: Column) -> Column:
    """At most BEYOND code points of the text from start (counted from 0)."""
    return F.get(chunked, F.floor(start / CHUNK).cast("int")).substr(start % CHUNK + 1, size)


def joined(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:start:end of structs (start, ord, end, ...) in order of start and kind, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["ord"] + 1), x["start"], x["end"])), ",")


def sql(kinds: Sequence[tuple[str, str, str]], base: int, scores: Sequence[str] = ()) -> str:
    """The query's rows for (kind, RE2 pattern, condition on m, s and e) in order; the first `base` kinds are the base.
    In a condition t is the whole text, m the match, s and e its start and end. scores: an expression of each kind's score, for max_score."""
    out = ["WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),", "x AS (SELECT doc_id, t"]
    for name, pattern, _ in kinds:
        p = pattern.replace("'", "''")
        out.append(f", regexp_extract_all(t, '{p}') AS {name}_m, list_transform(string_split_regex(t, '{p}'), lambda g: length(g)) AS {name}_g")
    out.append("FROM d), y AS (SELECT doc_id, t")
    for name, _, _ in kinds:
        out.append(f", list_transform(range(1, len({name}_m) + 1), lambda i: {{'m': {name}_m[i], 's': (coalesce(list_sum({name}_g[1:i]), 0) + coalesce(list_sum(list_transform({name}_m[1:i - 1], lambda q: length(q))), 0))::BIGINT, 'n': length({name}_m[i])}}) AS {name}")
    out.append("FROM x), z AS (SELECT doc_id")
    for k, (name, _, keep) in enumerate(kinds):
        cond = keep.replace("$m", "v.m").replace("$s", "v.s").replace("$e", "(v.s + v.n)").replace("$t", "t")
        score = f", 'p': {scores[k].replace('$m', 'v.m').replace('$s', 'v.s').replace('$e', '(v.s + v.n)').replace('$t', 't')}" if scores else ""
        out.append(f", list_transform(list_filter({name}, lambda v: {cond}), lambda v: {{'s': v.s, 'o': {k}, 'w': '{name}:' || v.s || ':' || (v.s + v.n){score}}}) AS {name}")
    out.append("FROM y) SELECT doc_id")
    out += [f", len({name})::BIGINT AS n_{name}" for name, _, _ in kinds[:base]]
    both = ["list_concat(" * (len(own) - 1) + own[0][0] + "".join(f", {n})" for n, *_ in own[1:]) for own in (kinds[:base], kinds)]
    text = [f"array_to_string(list_transform(list_sort({b}), lambda v: v.w), ',')" for b in both]
    out.append(f", sha256(coalesce({text[0]}, '')) AS base_sha256, coalesce({text[1]}, '') AS spans" + (f", round(list_max(list_transform({both[1]}, lambda v: v.p)), 2) AS max_score" if scores else "") + " FROM z")
    return " ".join(out)
