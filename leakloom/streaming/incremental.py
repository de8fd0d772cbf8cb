"""Incremental state, and continuous scans."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changed(resources: DataFrame, state: DataFrame, key: str = "resource_key", fingerprint: str = "fingerprint") -> DataFrame:
    """Resources that are new or whose fingerprint differs from the last run's."""
    return resources.join(state.select(key, fingerprint), [key, fingerprint], "left_anti")


def next_state(state: DataFrame, seen: DataFrame, coverage: DataFrame | None = None, key: str = "resource_key", fingerprint: str = "fingerprint") -> DataFrame:
    """The state after a run; a run with gaps in its coverage leaves the state as it was."""
    if coverage is not None and coverage.filter("severity = 'gap'").limit(1).count():
        return state.select(key, fingerprint)
    return seen.select(key, fingerprint).unionByName(state.join(seen, key, "left_anti").select(key, fingerprint))


def resource_fingerprint(parts: DataFrame, key: str, value: str) -> DataFrame:
    """One digest a key over the multiset of its values, whatever their order.

    Each value's SHA-256 is eight numbers of 32 bits, added up exactly; the fingerprint is the digest of their number
    and these sums. Sums are partly made before the shuffle, and no group holds its values. A null value counts as one
    that no string equals; null keys are one key.
    """
    digest = F.coalesce(F.sha2(value, 256), F.sha2(F.lit("\0null"), 512))
    sums = parts.groupBy(key).agg(F.count("*").alias("_n"), *(F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(10,0)")).alias(f"_w{i}") for i in range(8)))
    return sums.select(key, F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("_n", *(f"_w{i}" for i in range(8))))), 256).alias("fingerprint"))


def scanner_fingerprint(options: dict) -> str:
    return hashlib.sha256(json.dumps(options, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def stream_scan(chunks: DataFrame, detect, out: str, checkpoint: str, once: bool = True):
    """Scan a stream of chunks, appending findings batch by batch.

    A batch is written to its own folder, in place of what a lost attempt left, so findings come once.
    """

    def batch(df: DataFrame, number: int) -> None:
        detect(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def stream_files(spark: SparkSession, folder: str, files_per_trigger: int = 1_000) -> DataFrame:
    """New text files of a folder as chunks, each once."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return raw.select(F.xxhash64("_metadata.file_path").alias("chunk_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def throttled(events: DataFrame, fingerprint: str, at: str, interval: str) -> DataFrame:
    """At most one event a fingerprint within an interval of event time; state is dropped behind the watermark."""
    return events.withWatermark(at, interval).dropDuplicatesWithinWatermark([fingerprint])
