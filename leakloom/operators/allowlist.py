"""Allowlists of any size, as tables.

An entry fits a finding if all the fields that it has do: the detector's name in any case, the value, a pattern found in
the value, a glob of the path. Fields that ask for equality (detector, value, paths and base names without wildcards) make
an entry's key; which of them it has is its shape, and there are twelve shapes at most. A finding has one key for each
shape in use, so a join on one column finds the entries that may fit, however many there are, and their patterns are
tried on these only. Entries of nothing but patterns are compiled once a task, many to an alternation, and tried one by
one only where that finds something. The plan has the same size for ten entries and for a million.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.functions.regex import to_java, to_python
from leakloom.operators.pipeline import glob_regex, join_counted

FIELDS = ("detector", "raw", "raw_regex", "path")
ENTRY = "entry long, detector string, raw string, raw_regex string, path string"
#: Entries that are broadcast at most, after counting, and patterns in one alternation.
FEW, TOGETHER = 200_000, 200
_WILD = re.compile(r"[*?\[]")


def table(spark: SparkSession, entries: Sequence[dict]) -> DataFrame:
    """Entries of a list, numbered in its order; fields that aren't known, and entries without any, are errors."""
    for e in entries:
        if unknown := set(e) - {"reason", *FIELDS}:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        if not set(e) & set(FIELDS):
            raise ValueError("an entry needs a detector, raw, raw_regex or path")
        re.compile(to_python(e.get("raw_regex", "")))
    return spark.createDataFrame([(i, *(e.get(f) for f in FIELDS)) for i, e in enumerate(entries)], ENTRY)


def _shape(parts: dict[str, Column]) -> Column:
    """The key of some equality fields: their names and values, values of others left out."""
    return F.sha2(F.concat_ws("\0", *(F.concat(F.lit(f"{k}="), v) for k, v in parts.items())), 256)


@lru_cache(maxsize=4)
def _compiled(patterns: tuple[tuple[int, str | None, str | None], ...]):
    """Entries by the pattern that is tried first, in alternations: (alternation or None, whether it is of paths, entries)."""
    out = []
    for of_path in (True, False):
        mine = [(e, re.compile(to_python(r)) if r else None, re.compile(g) if g else None, g if of_path else r) for e, r, g in patterns if bool(g) == of_path]
        for k in range(0, len(mine), TOGETHER):
            some = mine[k : k + TOGETHER]
            sources = [s if of_path else to_python(s) for *_, s in some]
            safe = not any(re.search(r"\\[1-9]|\(\?P|\(\?[aiLmsux-]+\)", s) for s in sources)  # groups by number or name, and flags, can't be joined
            out.append((re.compile("|".join(f"(?:{s})" for s in sources)) if safe else None, of_path, [x[:3] for x in some]))
    return out


def _by_pattern(findings: DataFrame, patterns: tuple) -> Column:
    """The first of some entries without equality fields that fits."""

    @F.arrow_udf("long")
    def first(raws: pa.Array, paths: pa.Array) -> pa.Array:
        groups, out = _compiled(patterns), []
        for raw, path in zip(raws.to_pylist(), paths.to_pylist()):
            best = None
            for any_, of_path, entries in groups:
                what = path if of_path else raw
                if what is None or any_ is not None and not any_.search(what):
                    continue
                for e, value, glob in entries:
                    if (best is None or e < best) and (value is None or raw is not None and value.search(raw)) and (glob is None or path is not None and glob.search(path)):
                        best = e
            out.append(best)
        return pa.array(out, pa.int64())

    return first("raw", "path")


def allowed(findings: DataFrame, entries: DataFrame, few: int = FEW) -> DataFrame:
    """Findings (detector, raw, path and others) with ``allowed_by``, the least entry that fits, or null.

    Distinct findings are looked up, so that a value that is found everywhere is looked up once, and the outcome is
    joined back with hot ones apart. A null field of a finding fits no entry that asks for it; entries without
    fields fit nothing. Entries of nothing but patterns are gathered by the driver, where such lists come from.
    """
    wild = F.col("path").rlike(r"[*?\[]")
    base = F.col("path").isNotNull() & ~wild & ~F.col("path").contains("/")
    as_regex = F.udf(lambda g: glob_regex(g) if g is not None and _WILD.search(g) else None, "string")
    as_java = F.udf(lambda p: None if p is None else to_java(p), "string")
    known = entries.select(
        "entry", F.lower("detector").alias("d"), F.col("raw").alias("r"), F.when(F.col("path").isNotNull() & ~wild & ~base, F.col("path")).alias("p"), F.when(base, F.col("path")).alias("b"),
        F.col("raw_regex").alias("pattern"), as_java("raw_regex").alias("java"), as_regex("path").alias("glob"),
    )
    equal = {"d": F.col("d"), "r": F.col("r"), "p": F.col("p"), "b": F.col("b")}
    names = F.concat_ws("", *(F.when(c.isNotNull(), F.lit(k)) for k, c in equal.items()))
    known = known.withColumn("shape", names)
    keyed = known.filter("shape <> ''").select("entry", "java", "glob", _shape(equal).alias("_key"), "shape")
    rest = tuple((r["entry"], r["pattern"], r["glob"]) for r in known.filter("shape = '' and (pattern is not null or glob is not null)").select("entry", "pattern", "glob").orderBy("entry").collect())
    shapes = sorted(r["shape"] for r in keyed.select("shape").distinct().collect())
    what = F.struct("detector", "raw", "path")
    each = findings.groupBy(F.xxhash64("detector", "raw", "path").alias("_h"), "detector", "raw", "path").agg(F.count("*").alias("_n"))
    own = {"d": F.lower("detector"), "r": F.col("raw"), "p": F.col("path"), "b": F.regexp_extract("path", r"([^/]*)$", 1)}
    looked = each.select("*", (_by_pattern(each, rest) if rest else F.lit(None).cast("long")).alias("_rest"))
    if shapes:
        keys = F.array_compact(F.array(*(F.when(F.lit(True) if not s else _all(own[k] for k in s), _shape({k: own[k] if k in s else F.lit(None).cast("string") for k in own})) for s in shapes)))
        small = keyed.limit(few + 1).count() <= few
        named = keyed.drop("shape")
        met = looked.select("detector", "raw", "path", F.explode(keys).alias("_key")).join(F.broadcast(named) if small else named, "_key")
        fits = (F.col("java").isNull() | F.regexp_like("raw", F.col("java"))) & (F.col("glob").isNull() | F.regexp_like("path", F.col("glob")))
        best = met.filter(fits).groupBy(what.alias("_w")).agg(F.min("entry").alias("_best"))
        looked = looked.join(best.select("_w.*", "_best").toDF("_d", "_r", "_p", "_best"), F.col("detector").eqNullSafe(F.col("_d")) & F.col("raw").eqNullSafe(F.col("_r")) & F.col("path").eqNullSafe(F.col("_p")), "left").drop("_d", "_r", "_p")
        looked = looked.withColumn("_rest", F.least("_rest", "_best"))
    looked = looked.select(F.sha2(F.to_json(what), 256).alias("_w"), "_n", F.col("_rest").alias("allowed_by"))
    return join_counted(findings.withColumn("_w", F.sha2(F.to_json(what), 256)), looked, "_w", "_n").drop("_w", "_n")


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out
