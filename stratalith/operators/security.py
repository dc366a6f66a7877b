"""Line rules, entropy rule, enrichment, histogram, score and posture of security findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.functions import exprs, rules
from stratalith.operators.files import lines


def line_findings(files: DataFrame) -> DataFrame:
    """A row for each line and rule that matches it; matches in examples and tests are low."""
    hits = F.filter(
        F.array(*(F.when(F.col("content").rlike(pattern), F.struct(F.lit(rule).alias("rule_id"), F.lit(message).alias("message"))) for rule, pattern, message in rules.LINE_RULES)), lambda x: x.isNotNull()
    )
    some = files.filter(F.col("text").rlike("|".join(f"(?:{pattern})" for _, pattern, _ in rules.LINE_RULES)))  # files without a hit are not cut into lines
    found = lines(some).select("repo_id", "path", "line", F.explode(hits).alias("hit")).select("repo_id", "path", "line", "hit.*")
    return found.withColumn("severity", F.when(exprs.example_path(F.col("path")), "low").when(F.col("rule_id") == "hardcoded-secret", "high").otherwise("medium"))


def entropy_findings(files: DataFrame, least: float = 4.1) -> DataFrame:
    """repo_id, path, line, rule_id, severity, entropy of lines with a quoted token of 32 characters or more whose entropy reaches `least`: the first such token counts."""
    token = F.get(F.filter(F.regexp_extract_all("content", F.lit(rules.ENTROPY_TOKEN), F.lit(1)), lambda t: exprs.dec_round(exprs.entropy(t), 4) >= least), F.lit(0))
    some = lines(files.filter(F.col("text").rlike(rules.ENTROPY_TOKEN)))  # most files hold no such token and are not cut into lines
    found = some.select("repo_id", "path", "line", token.alias("token")).filter("token IS NOT NULL")
    severity = F.when(exprs.example_path(F.col("path")), "low").otherwise("high")
    return found.select("repo_id", "path", "line", F.lit("high-entropy-secret").alias("rule_id"), severity.alias("severity"), exprs.dec_round(exprs.entropy(F.col("token")), 4).alias("entropy"))


def enriched(findings: DataFrame) -> DataFrame:
    """findings with owasp, cwe, cvss, scanner, exploitability, business_impact, impact, remediation."""
    rule, severity = F.lower("rule_id"), F.col("severity")
    tax = None
    for tokens, values in rules.TAXONOMY:
        entry = F.struct(*(F.lit(v).alias(n) for n, v in zip(("owasp", "cwe", "cvss"), values, strict=True)))
        tax = F.when(exprs.any_contains(rule, tokens), entry) if tax is None else tax.when(exprs.any_contains(rule, tokens), entry)
    for prefix, values in rules.TAXONOMY_PREFIXES:
        tax = tax.when(rule.startswith(prefix), F.struct(*(F.lit(v).alias(n) for n, v in zip(("owasp", "cwe", "cvss"), values, strict=True))))
    tax = tax.otherwise(F.struct(*(F.lit(v).alias(n) for n, v in zip(("owasp", "cwe", "cvss"), rules.TAXONOMY_ELSE, strict=True))))
    scanner = reduce(lambda acc, x: acc.when(rule.startswith(x[0]), x[1]), rules.SCANNERS[1:], F.when(rule.startswith(rules.SCANNERS[0][0]), rules.SCANNERS[0][1]))
    serious = severity.isin("critical", "high")
    return findings.withColumn("__tax", tax).withColumns({
        "owasp": F.col("__tax.owasp"), "cwe": F.col("__tax.cwe"), "cvss": F.col("__tax.cvss"),
        "scanner": scanner.when(rule.contains("secret"), "secret-detection").otherwise("custom-rules"),
        "exploitability": F.when(serious, "high").when(exprs.any_contains(rule, rules.EXPLOITABLE), "medium").otherwise("low"),
        "impact": exprs.case_contains(F.col("rule_id"), rules.IMPACTS, F.concat(F.initcap(severity), F.lit(" finding: an engineer should look at it before a release."))),
        "remediation": exprs.case_contains(F.col("rule_id"), rules.REMEDIATIONS, rules.REMEDIATION_ELSE),
        "business_impact": F.when(rule.contains("secret"), "An exposed credential may cost an incident, an audit and the trust of customers.")
        .when(serious, "May stop a purchase or has to be mended before one.").otherwise("Belongs on the list of security work."),
    }).drop("__tax")


def counts(findings: DataFrame) -> DataFrame:
    """A column for each severity, zero-filled, for each repository."""
    return findings.groupBy("repo_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in rules.RANK))


def histogram(findings: DataFrame) -> DataFrame:
    """repo_id, severity, findings with all four severities."""
    wide = counts(findings)
    return wide.select("repo_id", F.explode(F.array(*(F.struct(F.lit(s).alias("severity"), F.col(s).alias("findings")) for s in rules.RANK))).alias("x")).select("repo_id", "x.*")


def posture(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id").agg(F.count(F.lit(1)).alias("findings"), F.sum(exprs.by_value(F.col("severity"), rules.POSTURE_WEIGHT, 1)).cast("long").alias("weighted"), F.countDistinct("rule_id").alias("rules"))
