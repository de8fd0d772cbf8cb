"""Findings as JSON records, SARIF, tables and audit lines. Secrets themselves are never written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.functions import findings as K
from leakloom.functions import text as X


def json_records(findings: DataFrame) -> DataFrame:
    """One JSON object a finding, in the column ``record``."""
    wanted = [c for c in ("detector", "severity", "verdict", "path", "line", "start_byte", "end_byte", "redacted", "secret_hash", "decoded_from", "archive_path", "suppressed_by") if c in findings.columns]
    return findings.select(F.to_json(F.struct(*wanted)).alias("record"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """The detectors that found something, sorted, with level and security severity of their worst finding."""
    worst = findings.groupBy("detector").agg(F.max("severity_rank").alias("rank"), F.count("*").alias("results"))
    return worst.select("detector", K.sarif_level("rank").alias("level"), F.when(F.col("rank") >= 4, "9.0").when(F.col("rank") == 3, "5.0").otherwise("2.0").alias("security_severity"), "results")


def sarif_results(findings: DataFrame) -> DataFrame:
    prints = K.fingerprints("detector", "raw", X.uri_path("path"), F.col("line").cast("string"))
    location = F.struct(F.struct(F.struct(X.uri_path("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select("detector", "path", "line", F.to_json(F.struct(F.col("detector").alias("ruleId"), K.sarif_level("severity_rank").alias("level"), F.struct(F.concat(F.col("detector"), F.lit(": "), F.col("redacted")).alias("text")).alias("message"), F.array(location).alias("locations"), prints.alias("partialFingerprints"))).alias("result"))


def sarif(spark: SparkSession, findings: DataFrame, limit: int = 25_000) -> dict:
    """A SARIF 2.1.0 log on the driver; larger result sets are refused, as viewers do, and belong in ``sarif_results``."""
    results = sarif_results(findings).orderBy("path", "line", "detector").limit(limit + 1).collect()
    if len(results) > limit:
        raise ValueError(f"more than {limit} results")
    rules = [{"id": r["detector"], "properties": {"security-severity": r["security_severity"]}} for r in sarif_rules(findings).orderBy("detector").collect()]
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "leakloom", "rules": rules}}, "results": [json.loads(r["result"]) for r in results]}]}


def table(findings: DataFrame) -> DataFrame:
    place = F.concat(F.col("path"), F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))
    suppressed = F.col("suppressed_by") if "suppressed_by" in findings.columns else F.lit(None).cast("string")
    return findings.select(X.terminal_safe("detector").alias("DETECTOR"), F.col("severity").alias("SEVERITY"), X.terminal_safe(place).alias("LOCATION"), X.terminal_safe("redacted").alias("REDACTED"), F.coalesce(suppressed, F.lit("")).alias("SUPPRESSED"))


def audit(findings: DataFrame, at: str) -> DataFrame:
    """Audit lines with a trail id of 16 digits of the digest of detector, secret digest and time."""
    trail = F.left(F.sha2(F.concat_ws("|", F.col("detector"), F.col("secret_hash"), F.lit(at)), 256), F.lit(16))
    return findings.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), trail.alias("trail_id"), F.col("detector"), F.col("secret_hash"), F.col("redacted"), F.lit(at).alias("at"))).alias("line"))


def write(findings: DataFrame, path: str, kind: str = "json") -> None:
    """Write as text lines (json, sarif results, table) or as Parquet."""
    if kind == "parquet":
        findings.drop("raw", "raw_v2").write.parquet(path)
    elif kind == "json":
        json_records(findings).write.text(path)
    elif kind == "sarif":
        sarif_results(findings).select("result").write.text(path)
    elif kind == "table":
        t = table(findings)
        t.select(F.concat_ws("\t", *t.columns).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


#: Labels of recognised entities, and scores of verdicts.
ENTITIES = {
    "AWS": "AWS_ACCESS_KEY", "GitHub": "GITHUB_TOKEN", "GitHubApp": "GITHUB_TOKEN", "GitHubFineGrained": "GITHUB_TOKEN", "GitLab": "GITLAB_TOKEN", "Slack": "SLACK_TOKEN", "SlackUserToken": "SLACK_TOKEN",
    "OpenAI": "OPENAI_API_KEY", "Anthropic": "ANTHROPIC_API_KEY", "GoogleOAuth": "GCP_OAUTH_TOKEN", "Stripe": "STRIPE_KEY", "SendGrid": "SENDGRID_KEY", "Twilio": "TWILIO_KEY", "PrivateKeyPEM": "PRIVATE_KEY", "JWT": "JWT",
    "BasicAuth": "PASSWORD", "HardcodedPassword": "PASSWORD", "Postgres": "DATABASE_CREDENTIAL", "MySQL": "DATABASE_CREDENTIAL", "MongoDBAtlas": "DATABASE_CREDENTIAL", "Snowflake": "DATABASE_CREDENTIAL",
}
SCORES = {"verified": 1.0, "indeterminate": 0.5, "unverified": 0.3}


def entities(findings: DataFrame, label: str = "detector") -> DataFrame:
    """Findings as recogniser results: entity, character span, score."""
    known = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    plain = F.left(F.trim(F.regexp_replace(F.upper(label), "[^A-Z0-9]+", "_"), F.lit("_")), F.lit(40))
    fallback = F.when(plain == "", "SECRET").otherwise(plain)
    score = F.create_map(*(F.lit(x) for pair in SCORES.items() for x in pair))
    verdict = F.col("verdict") if "verdict" in findings.columns else F.lit("unverified")
    return findings.select(F.coalesce(F.try_element_at(known, F.col(label)), fallback).alias("entity"), (F.col("start") - 1).alias("start"), (F.col("end") - 1).alias("end"), F.coalesce(F.try_element_at(score, verdict), F.lit(0.5)).alias("score"))
