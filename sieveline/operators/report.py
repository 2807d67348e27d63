"""Roll-ups of findings, and reports in text, JSON and SARIF."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import strings as S

NAME, VERSION = "sieveline", "0.1.0"
SARIF = "https://schemastore.azurewebsites.net/schemas/json/sarif-2.1.0-rtm.5.json"
FORMATS = {"json": "json", "plain": "plain", "text": "plain", "sarif": "sarif"}


def parse_format(name: str) -> str:
    return FORMATS.get(name.strip().lower(), "pretty")


def known(severity: Column) -> Column:
    up = F.upper(severity)
    return F.when(up.isin("CRITICAL", "HIGH", "MEDIUM"), up).otherwise("LOW")


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy(known(F.col("severity")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def by_severity_and_rule(findings: DataFrame) -> DataFrame:
    """With subtotals of each severity and a total."""
    return findings.withColumn("severity", known(F.col("severity"))).rollup("severity", "signature_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("n_tokens"))


def blocks(findings: DataFrame) -> DataFrame:
    """One row: whether any finding is CRITICAL or HIGH."""
    return findings.agg(F.coalesce(F.bool_or(F.col("severity").isin("CRITICAL", "HIGH")), F.lit(False)).alias("blocked"))


def rules(findings: DataFrame) -> DataFrame:
    """Each rule with the description of its last finding by path and line."""
    rule = F.when(F.coalesce("signature_id", F.lit("")) == "", "generic-secret").otherwise(F.col("signature_id"))
    return findings.groupBy(rule.alias("rule_id")).agg(F.max_by("description", F.struct("file_path", "line_no", "description")).alias("description"))


def shown(findings: DataFrame, redact: bool = True) -> DataFrame:
    """The fields of a report, with masked tokens; redact masks them in the snippets too."""
    masked = S.mask(F.col("token"))
    snippet = F.replace(F.col("line_content"), F.col("token"), masked) if redact else F.col("line_content")
    return findings.select("file_path", F.col("line_no").alias("line"), "severity", "tier", "signature_id", "description", masked.alias("token"), "entropy", S.shorten(snippet, 200).alias("line_snippet"))


def json_rows(findings: DataFrame, redact: bool = True) -> DataFrame:
    """A JSON object a finding, for df.write.text at any size."""
    return shown(findings, redact).select(F.to_json(F.struct("*")).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF result a finding, as a struct."""
    rule = F.when(F.coalesce("signature_id", F.lit("")) == "", "generic-secret").otherwise(F.col("signature_id"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine"), F.lit(1).alias("startColumn")).alias("region")).alias("physicalLocation"))
    text = F.format_string("Secret detected: %s (Severity: %s)", F.col("description"), F.col("severity"))
    return findings.select("file_path", "line_no", F.struct(rule.alias("ruleId"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations")).alias("result"))


def json_report(findings: DataFrame, scanned: int, elapsed_ms: int = 0, redact: bool = True) -> str:
    """A report for people or a build, so its findings are collected; json_rows is for tables."""
    rows = [r.asDict() for r in shown(findings, redact).orderBy("file_path", "line").collect()]
    return json.dumps({"version": VERSION, "status": "blocked" if rows else "clean", "scanned_files": scanned, "elapsed_ms": elapsed_ms, "findings": rows}, indent=2)


def sarif_report(findings: DataFrame) -> str:
    found = [json.loads(r.j) for r in sarif_results(findings).orderBy("file_path", "line_no").select(F.to_json("result").alias("j")).collect()]
    own = [{"id": r.rule_id, "shortDescription": {"text": r.description}} for r in rules(findings).orderBy("rule_id").collect()]
    return json.dumps({"$schema": SARIF, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": NAME, "version": VERSION, "rules": own}}, "results": found}]}, indent=2)


def text_report(findings: DataFrame, scanned: int, elapsed_ms: int = 0, pretty: bool = False, skipped: DataFrame | None = None) -> str:
    rows = shown(findings).orderBy("file_path", "line").collect()
    out = [f"{NAME} {VERSION}"]
    if pretty and skipped is not None:
        out += [f"skipped {r.file_path}: {r.reason}" for r in skipped.collect()]
    if not rows:
        return "\n".join([*out, f"clean: {scanned} files scanned in {elapsed_ms} ms"])
    for r in rows:
        head = f"[{r.severity:<8}] {r.file_path}:{r.line} {r.description} ({r.signature_id}, {r.tier})"
        out += [head, f"    {r.token}  {r.line_snippet[:120]}"] if pretty else [head]
    counts = {r.severity: r.n for r in by_severity(findings).collect()}
    return "\n".join([*out, f"blocked: {len(rows)} findings in {scanned} files, " + ", ".join(f"{counts.get(s, 0)} {s}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))])
