"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that are Python objects at a time, unless one row has more.
PART_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(prefix: str) -> str:
    """A column name that no caller's column can have."""
    return f"_{prefix}_{uuid.uuid4().hex[:12]}"


def parts(columns: Sequence[pa.Array], most: int = PART_BYTES) -> Iterator[Sequence[pa.Array]]:
    """All rows in order, in parts of at most so many bytes, or of one row."""
    n = len(columns[0])
    if n > 1 and sum(c.nbytes for c in columns) > most:
        for at, size in ((0, n // 2), (n // 2, n - n // 2)):
            yield from parts([c.slice(at, size) for c in columns], most)
    else:
        yield columns


def text_udf(ddl: str, rows: Callable[[Sequence], list[dict]], n_args: int = 1):
    """An Arrow UDF that returns one struct a row.

    ``rows`` gets one Python list per argument and returns one dict per row. A batch goes through it in parts, so
    that a worker holds a part's Python objects and not a batch's. It is marked non-deterministic, so that a filter
    on its result doesn't make Spark evaluate it twice.
    """
    kind = pa.struct([(f.name, _arrow(f.dataType)) for f in T._parse_datatype_string(ddl).fields])  # noqa: SLF001

    def every(*columns: pa.Array) -> pa.Array:
        out = pa.concat_arrays([pa.array(rows(*(c.to_pylist() for c in part)), kind) for part in parts(columns)])
        pa.default_memory_pool().release_unused()  # workers are kept, and with them what Arrow keeps of earlier batches
        return out

    def one(a: pa.Array) -> pa.Array:
        return every(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return every(a, b)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return every(a, b, c)

    body = {1: one, 2: two, 3: three}[n_args]
    return F.arrow_udf(f"struct<{ddl}>")(body).asNondeterministic()


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def shared_folder(spark: SparkSession) -> str:
    """The folder for what lies between stages: the session's ``spark.checkpoint.dir``; without one the call fails."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():  # noqa: SLF001
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()  # noqa: SLF001


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files of frames that are no longer referred to.

    It does so when the driver's JVM collects garbage, which by itself may be half an hour away.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # noqa: SLF001


#: A key is hot if it holds more than such a part of all rows; at most so many keys can be hot.
HOT = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key and in ``n`` at least the number of its rows.

    Keys with over a thousandth of all ``total`` rows would each fill a task; there can be few of them, so they
    are broadcast, and their rows stay where they are. The others meet by a shuffle. ``rows`` is read twice.
    """
    hot = F.col(n) * HOT > total
    few = keyed.filter(hot)
    cold = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(keyed.filter(~hot), key)
    return rows.join(F.broadcast(few), key).unionByName(cold)


def global_offsets(df: DataFrame, order: Sequence, totals: dict[str, str]) -> DataFrame:
    """Add running totals over all earlier rows in the order given; ``totals``: new column to summed column.

    Rows are dealt out by range and written to the checkpoint folder with the number of their
    range, so that a retried task can't deal them otherwise; the totals of the ranges (a row
    each) are accumulated and joined back. No task sees more than a range. Rows with equal keys
    come in one range, so ties must be few or differ in a later key.
    """
    part = fresh("range")
    before = {into: fresh("before") for into in totals}
    dealt = checkpointed(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(part).agg(*(F.sum(value).alias(before[into]) for into, value in totals.items()))
    ranges = ranges.select(part, *(F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(b) for b in before.values()))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = dealt.withColumns({into: F.coalesce(F.sum(value).over(within), F.lit(0)) for into, value in totals.items()})
    return running.join(F.broadcast(ranges), part).withColumns({into: F.col(into) + F.col(b) for into, b in before.items()}).drop(part, *before.values())


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
