"""Reports of external scanners, whatever their shape, as findings and one prediction a package.

A payload is a variant. Items are looked for under the known keys, at the top, within one object below
a key, and within nested reports; SARIF results are items too. Fields go by any of their known names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

# --- fixed values: names that scanners use --------------------------------------------------------------
LISTS = ("filtered_findings", "findings", "issues", "results", "alerts", "detections", "threats", "vulnerabilities", "violations", "security_issues", "securityIssues", "security_results", "securityResults")
NESTED = ("scan_results", "scanResults", "report", "analysis", "risk_assessment", "riskAssessment", "result")
TEXTS = ("rule_id", "ruleId", "id", "check_id", "issue_code", "title", "category", "message", "message.text", "description", "explanation")
IDS = ("rule_id", "ruleId", "id", "check_id", "issue_code")
SEVERITIES = ("severity", "level", "risk", "risk_severity")
PATHS = ("file", "path", "location.file", "location.path", "locations[0].physicalLocation.artifactLocation.uri")
LINES = ("line", "start_line", "location.start_line", "location.line", "locations[0].physicalLocation.region.startLine")
TOP = ("max_severity", "risk_severity", "severity", "status")
SCORES = ("risk_score", "score", "trust_score")


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({v}, '$.{path}', '{kind}')")


def _first(v: str, paths: tuple[str, ...], kind: str = "string") -> Column:
    return F.coalesce(*(_get(v, p, kind) for p in paths))


def items(payloads: DataFrame) -> DataFrame:
    """``(key, item)`` of each distinct item; ``payloads(key, payload)``. A report nested in another is
    looked into once, as deep as scanners nest them."""
    places = [*LISTS, *(f"{k}.{n}" for k in LISTS for n in ("findings", "issues", "results")), *(f"{k}.{n}" for k in NESTED for n in LISTS)]
    lists = [F.coalesce(_get("payload", p, "array<variant>"), F.expr("cast(array() as array<variant>)")) for p in places]
    runs = F.flatten(F.transform(F.coalesce(_get("payload", "runs", "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda r: F.coalesce(F.try_variant_get(r, "$.results", "array<variant>"), F.expr("cast(array() as array<variant>)"))))
    whole = F.coalesce(F.expr("try_variant_get(payload, '$', 'array<variant>')"), F.expr("cast(array() as array<variant>)"))
    rows = payloads.select("key", F.explode(F.concat(*lists, runs, whole)).alias("item"))
    # Keys of a variant are sorted, so its JSON is the same for the same content.
    return rows.withColumn("json", F.to_json("item")).groupBy("key", "json").agg(F.count("*").alias("n")).select("key", F.parse_json("json").alias("item"))


def findings(payloads: DataFrame) -> DataFrame:
    """``(key, finding, severity, label, subtype, atoms, path, line)``; an item without text and rank is none."""
    rows = items(payloads).select("key", "item", rules.severity(_first("item", SEVERITIES)).alias("rank"), F.concat_ws(" ", *(_get("item", p) for p in TEXTS)).alias("text"))
    rows = rows.where("rank > 0 or text <> ''")
    unsafe = F.coalesce(_get("item", "is_malicious", "boolean"), F.lit(False)) | F.coalesce(_get("item", "unsafe", "boolean"), F.lit(False))
    rows = rows.withColumn("label", rules.report_label(F.col("rank"), F.col("text"), unsafe))
    return rows.select("key", _first("item", IDS).alias("finding"), F.col("rank").alias("severity"), "label", F.when(F.col("label") == "violation", rules.report_subtype(F.col("text"))).alias("subtype"), rules.report_atoms(F.col("text")).alias("atoms"), _first("item", PATHS).alias("path"), _first("item", LINES, "int").alias("line"))


def predictions(payloads: DataFrame) -> DataFrame:
    """``(key, label, findings, violations, score, max_severity)``, one row a payload. A payload without
    items is judged by its overall severity and score."""
    found = findings(payloads).groupBy("key").agg(F.count("*").alias("findings"), F.count_if(F.col("label") == "violation").alias("violations"))
    nested = lambda names, kind: F.coalesce(_first("payload", names, kind), *(_first("payload", tuple(f"{k}.{n}" for n in names), kind) for k in ("risk_assessment", "riskAssessment", "summary")))
    rows = payloads.select("key", nested(SCORES, "double").alias("score"), nested(TOP, "string").alias("top")).join(found, "key", "left").fillna(0, ["findings", "violations"])
    rank = rules.severity(F.col("top"))
    alone = F.when((rank >= 4) | (F.coalesce("score", F.lit(0.0)) >= 51), "violation").when((rank >= 3) | (F.coalesce("score", F.lit(0.0)) >= 21), "exposure-only").otherwise("benign")
    label = F.when(F.col("violations") > 0, "violation").when(F.col("findings") > 0, "exposure-only").otherwise(alone)
    worst = F.coalesce("top", F.when(F.col("violations") > 0, "high").when(F.col("findings") > 0, "low"))
    return rows.select("key", label.alias("label"), "findings", "violations", "score", worst.alias("max_severity"))
