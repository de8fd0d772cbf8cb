"""Verdicts from outside: asked for once per candidate, looked up by digest, never with the secret itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.functions import findings as K
from leakloom.operators.pipeline import join_counted


def cache_key(detector="detector", raw="raw", raw_v2="raw_v2") -> Column:
    """Digest of what a verdict is about."""
    return F.sha2(F.concat_ws("\0", F.col(detector), F.coalesce(F.col(raw), F.lit("")), F.coalesce(F.col(raw_v2), F.lit(""))), 256)


def candidates(findings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(verdict_key, detector): what a verifier has to be asked, each once, less what is known already."""
    wanted = findings.select(cache_key().alias("verdict_key"), "detector").distinct()
    return wanted if known is None else wanted.join(known.select("verdict_key"), "verdict_key", "left_anti")


def resolve(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with verdict, assurance and verification_error of the verdict table; unverified without an entry.

    A value that is found everywhere is one key with very many rows: keys are counted, and hot ones' verdicts go to
    the findings instead of the findings to them. Of several entries for a key one with a verdict wins.
    """
    known = verdicts.groupBy("verdict_key").agg(F.max_by(F.struct("verified", F.col("assurance").alias("_a"), F.col("error").alias("_e")), F.struct(F.coalesce("verified", F.lit(False)), F.coalesce("assurance", F.lit(0)))).alias("_v"))
    keyed = findings.withColumn("verdict_key", cache_key())
    counts = keyed.groupBy("verdict_key").agg(F.count("*").alias("_n")).join(known, "verdict_key", "left")
    joined = join_counted(keyed, counts, "verdict_key", "_n").select(*keyed.columns, "_v.*")
    out = joined.withColumn("verified", F.coalesce("verified", F.lit(False))).withColumn("verdict", K.verdict("verified", "_e"))
    return out.withColumn("assurance", F.coalesce("_a", F.lit(0))).withColumnRenamed("_e", "verification_error").drop("_a", "verdict_key")
