"""Attributes of findings: severity, verdict, assurance, keys, containers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakloom.functions.text import col

#: Names by rank.
SEVERITIES = ("info", "info", "low", "medium", "high", "critical")
ASSURANCES = ("unknown", "heuristic", "response-confirmed", "provider-confirmed")
#: File types whose rows are records.
STRUCTURED = ("csv", "tsv", "sql", "json", "jsonl", "ndjson", "parquet", "avro", "xlsx", "xls", "ods", "sqlite", "db", "dump", "bak")
#: Detectors whose unverified findings are of medium severity.
MEDIUM = ("GenericHighEntropy", "JWT", "PrivateKeyPEM", "PIIEmail", "PIIUSSSN", "PIICreditCard", "PIIIBAN", "PIIAnonymize", "PIIOpenAIPF")


def severity_name(rank) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(F.lit(0), F.least(F.lit(5), col(rank))).cast("int") + 1)


def severity_rank(name) -> Column:
    c = F.lower(col(name))
    return F.when(c == "critical", 5).when(c == "high", 4).when(c == "medium", 3).when(c == "low", 2).when(c == "info", 1).otherwise(0)


def default_severity(detector, verified, override=None) -> Column:
    """Rank: critical if verified, else the rule's own, else medium for weak kinds and high for others."""
    base = F.when(col(verified), 5).when(col(detector).isin(*MEDIUM), 3).otherwise(4)
    return base if override is None else F.when(col(verified), 5).otherwise(F.coalesce(col(override).cast("int"), base))


def verdict(verified, error) -> Column:
    return F.when(col(verified), "verified").when(col(error).isNotNull(), "indeterminate").otherwise("unverified")


def severity_for_verdict(v, rank) -> Column:
    return F.when(col(v).isin("verified", "indeterminate"), 5).otherwise(col(rank))


def sarif_level(rank) -> Column:
    return F.when(col(rank) >= 4, "error").when(col(rank) == 3, "warning").otherwise("note")


def bounded_assurance(verified, assurance, most) -> Column:
    """(verified, assurance, error): verified without assurance takes the most allowed; above it the verdict is refused."""
    v, a, m = col(verified), col(assurance), col(most)
    refused = v & (a > m)
    return F.struct((v & ~refused).alias("verified"), F.when(v & (a == 0), m).when(refused, F.lit(0)).otherwise(a).alias("assurance"), F.when(refused, F.lit("assurance above the detector's maximum")).alias("error"))


def blast_radius(extra) -> Column:
    return F.exists(F.map_entries(col(extra)), lambda e: e["key"].rlike("_(?:privileged|high_value|high_risk)$") & (e["value"] == "true"))


def http_verdict(status) -> Column:
    s = col(status)
    return F.when(s.between(200, 299), "accepted").when((s == 429) | (s >= 500), "transient").when(s.isin(401, 403), "rejected").otherwise("ambiguous")


def fingerprints(detector, raw, uri, line) -> Column:
    return F.struct(F.sha2(F.concat(col(detector), F.lit(":"), col(raw)), 256).alias("secret"), F.concat(F.sha2(col(uri), 256), F.lit(":"), col(line)).alias("location"))


#: What is one container, its parent, and the field that has a path, by source; {a} is a field, {a/} its folder.
PLACES = {
    "filesystem": ("{path}", "{path/}", "path"),
    "git": ("{repository}@{commit}:{file}", "{repository}:{file/}", "file"),
    "github": ("{repository}@{commit}:{file}", "{repository}:{file/}", "file"),
    "gitlab": ("{group}/{project}@{sha}:{path}", "{group}/{project}:{path/}", "path"),
    "s3": ("s3://{bucket}/{key}", "s3://{bucket}/{key/}", "key"),
    "gcs": ("gs://{bucket}/{object}", "gs://{bucket}/{object/}", "object"),
    "slack": ("{channel}@{timestamp}", "{channel}", None),
    "confluence": ("{space_key}/{page_id}", "{space_key}", None),
    "jira": ("{project}/{issue_key}:{part}", "{project}", None),
    "notion": ("{page_id}:{part}", "{database}", None),
    "bitbucket": ("{workspace}/{repo}@{commit}:{path}", "{workspace}/{repo}:{path/}", "path"),
    "forge": ("{provider}/{repository}@{commit}:{file}", "{provider}/{repository}:{file/}", "file"),
    "stdin": ("stdin:{label}", "stdin", None),
}
#: Sources whose folders are key prefixes, empty rather than a dot at the top.
PREFIXED = ("s3", "gcs")


def _filled(template: str, meta: Column, top: str) -> Column:
    parts = []
    for literal, name in re.findall(r"([^{]*)(?:\{([^}]*)\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            value = F.coalesce(F.try_element_at(meta, F.lit(name.rstrip("/"))), F.lit(""))
            if name.endswith("/"):
                folder = F.regexp_extract(value, r"(?s)^(.*)/[^/]*$", 1)
                value = F.when(~value.contains("/"), top).when((folder == "") & (F.lit(top) == "."), "/").otherwise(folder)
            parts.append(value)
    return F.concat(*parts)


def container_key(source_type, meta, source_name=None) -> Column:
    """(container, parent, ext) by source and its metadata: where personal data is counted. Other sources are one container by name."""
    t, m = col(source_type), col(meta)
    name = F.lit("") if source_name is None else col(source_name)
    container, parent, path = name, F.lit(""), F.lit("")
    for source, (inside, above, field) in PLACES.items():
        top = "" if source in PREFIXED else "."
        container = F.when(t == source, _filled(inside, m, top)).otherwise(container)
        up = _filled(above, m, top)
        if source == "notion":
            up = F.when(up == "", _filled("{page_id}", m, top)).otherwise(up)
        parent = F.when(t == source, up).otherwise(parent)
        if field:
            path = F.when(t == source, F.coalesce(F.try_element_at(m, F.lit(field)), F.lit(""))).otherwise(path)
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.struct(container.alias("container"), parent.alias("parent"), ext.alias("ext"))


def location_key(source_type, path, line) -> Column:
    """Where a finding counts as the same: object, chat and in-memory sources have no lines."""
    return F.concat(col(path), F.lit(":"), F.when(col(source_type).isin("s3", "gcs", "slack", "chat", "stdin"), F.lit(0)).otherwise(col(line)).cast("string"))
