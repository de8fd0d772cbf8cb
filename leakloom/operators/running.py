"""Numbers that run over a whole table in an order, without a task that sees all of it."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for what lies between steps, which all machines share: the session's ``spark.checkpoint.dir``.

    Without one a session on one machine (``local[...]``) gets a temporary folder, and any other call fails.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():  # noqa: SLF001
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.startswith("local") and not context.master.startswith("local-cluster"):
            folder = Path(tempfile.mkdtemp(prefix="leakloom-")).as_uri()
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()  # noqa: SLF001


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def running(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Add sums over all earlier rows in a total order; ``totals``: new column to what is summed.

    Rows are dealt out by range and written down with the number of their range, so that a task done again can't deal
    them otherwise; one row a range is added up by itself and broadcast. Rows of equal order must be few.
    """
    dealt = checkpointed(df.withColumns({f"_v_{k}": v for k, v in totals.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(*(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in totals))
    ranges = ranges.select("_range", *(F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in totals))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({k: F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in totals})
    out = out.join(F.broadcast(ranges), "_range").withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in totals})
    return out.drop("_range", *(f"_{x}_{k}" for k in totals for x in "vb"))


def numbered(df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """Add each row's place in a total order, from 0."""
    return running(df, order, {into: F.lit(1).cast("long")})


#: Tables of fewer bytes than this for each core are dealt out anew before work that takes far longer than reading.
SMALL = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt out over all cores, as a file of one row group is one task however many there are.

    Small goes by the size that Spark estimates before it runs; larger tables have tasks enough and are left alone, and so
    are streams. Rows stay the same; their order doesn't.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001
    return df.repartition(cores) if size < SMALL * cores else df
