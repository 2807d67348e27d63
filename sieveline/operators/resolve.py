"""Findings of one line, one file and all files, resolved against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.functions.paths import matches_glob

FINDING = (
    "struct<pass:int,seq:int,token:string,entropy:double,tier:string,signature_id:string,description:string,severity:string,line_content:string>"
)
#: Passes: of the whole line, its compact and its decoded form, random tokens, tokens of logs.
LINE, COMPACT, DECODED, RANDOM, LOG = 1, 2, 3, 4, 5


def weight(severity: Column) -> Column:
    up = F.upper(severity)
    return F.when(up == "CRITICAL", 4).when(up == "HIGH", 3).when(up == "MEDIUM", 2).when(up == "LOW", 1).otherwise(0)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two tokens of a line are equal or one holds the other."""
    return F.contains(a, b) | F.contains(b, a)


def fold(found: Column) -> Column:
    """An ordered fold over a line's candidates (FINDING). One whose token overlaps none so far is added. In the pass of the whole
    line one that overlaps is held against the line's first finding and takes its place if it is specific and that is
    generic, or, both being alike in this, if it is more severe or as severe and shorter; in other passes it is dropped."""
    none = F.array().cast(f"array<{FINDING}>")

    def better(x: Column, first: Column) -> Column:
        general = lambda y: F.startswith(y["signature_id"], F.lit("generic-"))
        more, as_much = weight(x["severity"]) > weight(first["severity"]), weight(x["severity"]) == weight(first["severity"])
        return F.when(general(first) != general(x), general(first)).otherwise(more | (as_much & (F.length(x["token"]) < F.length(first["token"]))))

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda y: overlaps(y["token"], x["token"]))
        replaced = F.transform(acc, lambda y, i: F.when(i == 0, x).otherwise(y))
        return F.when(~clash, F.concat(acc, F.array(x))).when((x["pass"] == LINE) & better(x, F.get(acc, 0)), replaced).otherwise(acc)

    return F.aggregate(F.array_sort(found), none, step)


def per_line(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with the columns of FINDING to findings, with their place on the line. Groups are single lines."""
    names = [x.split(":")[0] for x in FINDING[7:-1].split(",")]
    each = candidates.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("all"))
    return each.select(*keys, F.posexplode(fold(F.col("all").cast(f"array<{FINDING}>"))).alias("place", "f")).select(*keys, "place", "f.*").drop("pass", "seq")


def drop_headers(findings: DataFrame) -> DataFrame:
    """Private keys only stay in files that also have a footer (has_footer)."""
    return findings.where(~F.col("signature_id").rlike("private-key|pem-") | F.col("has_footer"))


def drop_allowed(findings: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    return findings.where(~matches_glob(F.col("token"), patterns)) if patterns else findings


def roll_up(findings: DataFrame, file: list[str]) -> DataFrame:
    """Three or more findings in a row of the same random kind, on the same or next lines, become one of a massive blob.

    findings are in order of line_no and place within a file; windows are over the findings of a file only.
    """
    random = F.col("signature_id").isin("high-entropy-base64", "high-entropy-hex")
    order = W.partitionBy(*file).orderBy("line_no", "place")
    last = lambda c: F.lag(c).over(order)
    goes_on = random & (last("signature_id") == F.col("signature_id")) & (F.col("line_no") - last("line_no") <= 1)
    rows = findings.withColumn("island", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    island = W.partitionBy(*file, "island")
    rows = rows.withColumns({"n_": F.count(F.lit(1)).over(island), "k_": F.row_number().over(island.orderBy("line_no", "place"))})
    blob = random & (F.col("n_") >= 3)
    kind = F.when(F.col("signature_id").contains("hex"), "Hex").otherwise("Base64")
    changed = {
        "line_content": F.format_string("[... %d consecutive lines of %s ...]", F.col("n_"), kind),
        "token": F.format_string("<%d lines aggregated>", F.col("n_")),
        "signature_id": F.concat(F.lit("massive-"), F.lower(kind), F.lit("-blob")),
        "description": F.concat(F.lit("Massive "), kind, F.lit("/Cryptographic Blob Detected (Potential Keystore/Vault)")),
        "severity": F.lit("CRITICAL"),
    }
    rows = rows.where(~blob | (F.col("k_") == 1))
    return rows.withColumns({c: F.when(blob, v).otherwise(F.col(c)) for c, v in changed.items()}).drop("island", "n_", "k_")


def first_seen(findings: DataFrame) -> DataFrame:
    """Of findings with the same token only the first by path, line and place; blobs, whose token is a count, all stay.

    Grouped with map-side combination, so that a token which a third of all files hold is not gathered in a task.
    """
    blob = F.col("signature_id").rlike(r"\Amassive-.*-blob\z")
    cols = findings.columns
    order = F.struct("file_path", "line_no", "place")
    one = findings.where(~blob).groupBy("token").agg(F.min(F.struct(order.alias("o"), F.struct(*cols).alias("f"))).alias("m"))
    return findings.where(blob).unionByName(one.select("m.f.*").select(*cols))


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose file, signature and token a baseline doesn't have."""
    return findings.join(baseline.select("file_path", "signature_id", "token").distinct(), ["file_path", "signature_id", "token"], "left_anti")
