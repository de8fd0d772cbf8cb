"""Chunks from tables, texts and files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that are skipped by default.
EXCLUDES = (
    ".git", ".hg", ".svn", "node_modules", "vendor", "target", "dist", "build", "__pycache__", ".venv", ".tox", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock",
    "go.sum", "Pipfile.lock", "poetry.lock", "composer.lock", "Gemfile.lock", "mix.lock", "Podfile.lock", "*.min.js", "*.min.css", "*.map", "*.bundle.js",
)
MAX_FILE, SNIFF = 10 << 20, 512
_EMPTY_META = "cast(map() as map<string,string>)"


def _chunk(df: DataFrame, source_type: str, source_name, text, container, parent, ext="", path=None, base_line=1, meta=None) -> DataFrame:
    lit = lambda v: v if not isinstance(v, str | int) else F.lit(v)
    return df.select(
        F.col("chunk_id").cast("long").alias("chunk_id"), F.lit(source_type).alias("source_type"), lit(source_name).alias("source_name"), text.cast("string").alias("text"), container.cast("string").alias("container"),
        parent.cast("string").alias("parent"), lit(ext).alias("ext"), (path if path is not None else container).cast("string").alias("path"), lit(base_line).cast("int").alias("base_line"), (meta if meta is not None else F.expr(_EMPTY_META)).alias("meta"),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents: the id is the container, the source its parent."""
    return _chunk(docs.withColumn("chunk_id", F.col("doc_id")), "filesystem", F.col("source"), F.coalesce("text", F.lit("")), F.col("doc_id"), F.col("source"), "txt")


def from_conversations(turns: DataFrame) -> DataFrame:
    """Messages: a turn is a container, its conversation the parent."""
    place = F.concat_ws("@", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return _chunk(turns.withColumn("chunk_id", F.xxhash64("conv_id", "turn")), "chat", F.lit("conversations"), F.coalesce("text", F.lit("")), place, F.col("conv_id"))


def from_rows(table: DataFrame, key: str, name: str) -> DataFrame:
    """Any table: each row as a JSON object of strings."""
    row = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in table.columns)))
    return _chunk(table.withColumn("chunk_id", F.col(key).cast("long")).withColumn("_row", row), "bigquery", name, F.col("_row"), F.concat(F.lit(name + "#"), F.col(key).cast("string")), F.lit(name), "json")


def from_text(spark: SparkSession, text: str, label: str = "stdin", limit: int = 64 << 20) -> DataFrame:
    """One text as one chunk; longer ones are cut at the limit, which the caller learns from its length."""
    df = spark.createDataFrame([(0, label, text[:limit])], "chunk_id long, label string, t string")
    return _chunk(df, "stdin", F.col("label"), F.col("t"), F.col("label"), F.lit(""))


def from_files(spark: SparkSession, roots: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (), max_bytes: int = MAX_FILE, source_type: str = "filesystem") -> DataFrame:
    """Text files below folders of any store: not too large, not binary, not excluded; exclusion wins."""
    from leakloom.operators.pipeline import glob_regex

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots)).filter(F.col("length") <= max_bytes)
    path = F.regexp_replace("path", "^file:/+", "/")
    inside = "|".join(re.escape(e).replace(r"\*", "[^/]*") for e in EXCLUDES)
    keep = ~path.rlike(f"(?:^|/)(?:{inside})(?:/|$)")
    if include:
        keep = keep & F.array_contains(F.array(*(path.rlike(glob_regex(g)) for g in include)), True)
    for g in exclude:
        keep = keep & ~path.rlike(glob_regex(g))
    head = F.hex(F.substring("content", 1, SNIFF))
    binary = head.rlike("^(?:..)*?00") & ~head.rlike("^(?:FFFE|FEFF)")
    read = files.filter(keep).filter(~binary)
    return _chunk(read.withColumn("chunk_id", F.xxhash64("path")), source_type, F.lit(source_type), F.decode("content", "UTF-8"), path, F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def from_objects(spark: SparkSession, url: str, max_bytes: int = 250 << 20, **filters) -> DataFrame:
    """Objects below an s3a:// or gs:// URL; the store's connector handles roles and keys."""
    return from_files(spark, [url], max_bytes=max_bytes, source_type="s3" if url.startswith("s3") else "gcs" if url.startswith("gs") else "filesystem", **filters)


#: Sources by name, and how they are read here.
CATALOG = {
    "filesystem": "files", "git": "history", "stdin": "text", "sqldump": "dump", "s3": "objects", "gcs": "objects", "docker-image": "archive", "github": "json", "gitlab": "json",
    "bitbucket": "json", "forgejo": "json", "gitea": "json", "gogs": "json", "gitbucket": "json", "codeberg": "json", "onedev": "json", "codebase": "json", "pagure": "json", "slack": "json", "jira": "json",
    "confluence": "json", "notion": "json", "huggingface": "files", "datadog": "json", "splunk": "json", "bigquery": "rows", "redash": "rows", "elasticsearch": "json", "jenkins": "json", "postman": "json", "circleci": "json",
}


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(CATALOG.items()), "source string, reader string")


def from_json_dump(spark: SparkSession, path: str, source: str, text_fields: Sequence[str], id_field: str = "id", parent_field: str | None = None) -> DataFrame:
    """Exported records of a hosted service, one JSON object a line: each named field is a chunk."""
    if source not in CATALOG:
        raise ValueError(f"unknown source {source!r}")
    schema = ", ".join(f"`{c}` string" for c in dict.fromkeys([id_field, *text_fields, *([parent_field] if parent_field else [])]))
    rows = spark.read.schema(schema).json(path)
    parts = rows.select("*", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("t")) for f in text_fields))).alias("p")).filter("p.t is not null")
    place = F.concat_ws("#", F.col(f"`{id_field}`"), F.col("p.field"))
    return _chunk(parts.withColumn("chunk_id", F.xxhash64(place)), source, source, F.col("p.t"), place, F.col(f"`{parent_field}`") if parent_field else F.lit(""))
