"""Allowlists as tables, against the conditions of the small ones."""

import random

import pytest
from pyspark.sql import functions as F

from leakloom.operators import allowlist, pipeline

SCHEMA = "id long, detector string, raw string, path string, entry long, _key string"


def _findings(spark, n=400):
    r = random.Random(1)
    pick = lambda *x: r.choice(x)
    return spark.createDataFrame([(k, pick("AWS", "aws", "Git", None), pick("a1", "b2", "long-value-77", "", None), pick("src/a.py", "a.py", "x/y/a.py", "src/t/[b].txt", "fixtures/z.json", None), 7, "k") for k in range(n)], SCHEMA)


ENTRIES = [
    {"raw": "b2", "path": "nowhere.txt"}, {"detector": "AWS", "path": "a.py", "raw": "a1"}, {"raw_regex": r"^long-(value|other)-\d+$", "detector": "git"}, {"path": "fixtures/**"}, {"path": "src/a.py", "detector": "GIT"},
    {"raw_regex": "(a)1", "path": "x/**/a.py"}, {"raw_regex": r"(?i)^LONG.*\b77$", "path": "src/*.py"}, {"detector": "git", "raw": "b2"}, {"raw": ""}, {"path": "[a-b].py"}, {"detector": "aws"},
]


@pytest.mark.parametrize("few", [allowlist.FEW, 1])
def test_entries_fit_as_written_out(spark, few):
    df = _findings(spark)
    want = {r["id"]: r["w"] for r in df.select("id", pipeline.allow_condition(ENTRIES).alias("w")).collect()}
    out = allowlist.allowed(df, allowlist.table(spark, ENTRIES), few)
    got = {r["id"]: r["allowed_by"] for r in out.collect()}
    assert got == want and len(set(want.values())) > 8 and out.columns == [*df.columns, "allowed_by"]


def test_no_entries_and_no_findings(spark):
    df = _findings(spark, 20)
    assert {r["allowed_by"] for r in allowlist.allowed(df, spark.createDataFrame([], allowlist.ENTRY)).collect()} == {None}
    assert {r["allowed_by"] for r in allowlist.allowed(df, spark.createDataFrame([(1, None, None, None, None)], allowlist.ENTRY)).collect()} == {None}
    assert allowlist.allowed(df.filter("id < 0"), allowlist.table(spark, ENTRIES)).collect() == []
    for bad in ([{"reason": "x"}], [{"raw": "x", "odd": 1}]):
        with pytest.raises(ValueError):
            allowlist.table(spark, bad)


def test_a_hundred_thousand_entries(spark):
    """A plan as large as for ten, and the right entries."""
    entries = lambda n: spark.range(n).select(F.col("id").alias("entry"), F.lit(None).cast("string").alias("detector"), F.concat(F.lit("v"), "id").alias("raw"), F.lit(None).cast("string").alias("raw_regex"), F.when(F.col("id") % 2 == 0, "a.txt").alias("path"))
    df = spark.range(0, 200_000, 50).select("id", F.lit("D").alias("detector"), F.concat(F.lit("v"), "id").alias("raw"), F.when(F.col("id") % 100 == 0, "d/a.txt").otherwise("d/b.txt").alias("path")).unionByName(spark.createDataFrame([(1, "D", "v77", "x")], "id long, detector string, raw string, path string"))
    out = allowlist.allowed(df, entries(100_000))
    size = lambda o: len(o._jdf.queryExecution().optimizedPlan().toString())  # noqa: E731, SLF001
    assert size(out) < 1.2 * size(allowlist.allowed(df, entries(10)))
    got = {(r["id"], r["raw"]): r["allowed_by"] for r in out.filter("allowed_by is not null").collect()}
    assert got == {(k, f"v{k}"): k for k in range(0, 100_000, 100)} | {(1, "v77"): 77}
