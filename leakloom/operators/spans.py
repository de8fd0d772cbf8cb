"""Cutting texts up: windows, neighbourhoods of keyword hits, lines, blobs, encoded variants."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakloom.functions import decode as D
from leakloom.functions.regex import to_python
from leakloom.functions.text import col

WINDOW, OVERLAP, RADIUS = 32_768, 1_024, 2_048
BLOB, BLOB_OVERLAP = 1 << 20, 512


def matches(c, pattern: str, group: int = 0) -> Column:
    """Array of (value, start, end) of a group in all matches of a pattern that are not empty, left to right; 1-based characters.

    The built-in functions give matches but not where they are; one pass over a text, whatever their number.
    """
    translated = to_python(pattern)

    @F.arrow_udf("array<struct<value:string,start:bigint,end:bigint>>")
    def found(texts: pa.Array) -> pa.Array:
        find = re.compile(translated).finditer
        rows = [[{"value": m[group], "start": m.start(group) + 1, "end": m.end(group) + 1} for m in find(t) if m[0] and m[group] is not None] if t else [] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("value", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return found(col(c))


def windows(chunks: DataFrame, size: int = WINDOW, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """Add window_no, window_start (0-based) and window_text; consecutive windows overlap, the last one ends at the text's end."""
    n, step = F.char_length(text), size - overlap
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - overlap - 1, F.lit(0)).cast("long"), F.lit(step).cast("long"))
    out = chunks.select("*", F.posexplode(starts).alias("window_no", "window_start"))
    return out.withColumn("window_text", F.substring(F.col(text), (F.col("window_start") + 1).cast("int"), F.lit(size)))


def blobs(chunks: DataFrame, text: str = "text", base_line: str | None = None) -> DataFrame:
    """Windows for long files, each with the line on which it begins."""
    out = windows(chunks, BLOB, BLOB_OVERLAP, text)
    before = F.substring(F.col(text), F.lit(1), F.col("window_start").cast("int"))
    first = F.col(base_line) if base_line else F.lit(1)
    return out.withColumn("window_line", first + F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"))))


def vicinity(hits: DataFrame, keys: Sequence[str], end: str = "hit_end", size: str = "size", radius: int = RADIUS) -> DataFrame:
    """Merge the neighbourhoods of hits: (keys, span_start, span_end, hits), by gaps and islands.

    A hit at ``end`` covers [end - radius, end + 1 + radius), clipped to the text; spans that
    overlap or touch become one.
    """
    low = F.greatest(F.col(end) - radius, F.lit(0))
    high = F.least(F.col(end) + 1 + radius, F.col(size))
    each = hits.select(*keys, low.cast("long").alias("low"), high.cast("long").alias("high"))
    order = Window.partitionBy(*keys).orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = each.withColumn("fresh", F.when(reach.isNull() | (F.col("low") > reach), 1).otherwise(0))
    island = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("low").alias("span_start"), F.max("high").alias("span_end"), F.count("*").alias("hits")).drop("island")


def lines(chunks: DataFrame, needle: str | None = None, least: int = 1, most: int | None = None, text: str = "text") -> DataFrame:
    """One row a line (line from 1, line_text); with a needle only lines that hold it so often."""
    out = chunks.select("*", F.posexplode(F.split(text, "\n", -1)).alias("line", "line_text")).withColumn("line", (F.col("line") + 1).cast("long"))
    if needle is None:
        return out
    n = (F.char_length("line_text") - F.char_length(F.replace(F.col("line_text"), F.lit(needle)))) / len(needle)
    return out.filter((n >= least) & (n <= most if most is not None else F.lit(True)))


def variants(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row for the text and for each decoding of it: variant, vtext."""
    return chunks.withColumn("v", F.explode(D.variants(text))).select("*", "v.variant", "v.vtext").drop("v")


def _starts(texts: pa.Array, raws: pa.Array) -> pa.Array:
    out = []
    for text, raw in zip(texts.to_pylist(), raws.to_pylist()):
        found = []
        at = text.find(raw) if text and raw else -1
        while at >= 0:
            found.append(at + 1)
            at = text.find(raw, at + len(raw))
        out.append(found)
    return pa.array(out, pa.list_(pa.int64()))


def all_occurrences(findings: DataFrame, text: str = "text", raw: str = "raw") -> DataFrame:
    """One row per occurrence of each finding's value, with occurrence (from 1) and position (1-based).

    One pass over a text, whatever the number of its occurrences.
    """
    rows = findings.filter(F.col(text).contains(F.col(raw)) & (F.char_length(raw) > 0))
    return rows.select("*", F.posexplode(F.arrow_udf("array<long>")(_starts)(text, raw)).alias("occurrence", "position")).withColumn("occurrence", (F.col("occurrence") + 1).cast("long"))


_PLACES = pa.list_(pa.struct([("raw", pa.string()), ("occurrence", pa.int64()), ("position", pa.int64()), ("start_byte", pa.int64()), ("line", pa.int64())]))


def _placed(texts: pa.Array, values: pa.Array) -> pa.Array:
    import ahocorasick
    import numpy as np

    out = []
    for text, wanted in zip(texts.to_pylist(), values.to_pylist()):
        automaton, free, number, found = ahocorasick.Automaton(), {}, {}, []
        for v in wanted or ():
            if v:
                automaton.add_word(v, v)
        if text and len(automaton):
            automaton.make_automaton()
            for end, v in automaton.iter(text):
                start = end - len(v) + 1
                if start >= free.get(v, 0):
                    free[v] = end + 1
                    number[v] = number.get(v, 0) + 1
                    found.append((v, number[v], start))
        starts = np.array([x[2] for x in found], np.int64)
        lines = np.searchsorted(np.array([m.start() for m in re.finditer("\n", text)] if found else [], np.int64), starts)
        ascii_ = text is None or text.isascii()
        before = None if ascii_ or not found else np.concatenate([[0], np.cumsum(_widths(text))])
        out.append([{"raw": v, "occurrence": k, "position": a + 1, "start_byte": a if before is None else int(before[a]), "line": int(n) + 1} for (v, k, a), n in zip(found, lines.tolist())])
    return pa.array(out, _PLACES)


def _widths(text: str):
    import numpy as np

    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


def placed(chunks: DataFrame, findings: DataFrame, key: str = "chunk_id", text: str = "text", raw: str = "raw") -> DataFrame:
    """(key, raw, occurrence, position, start_byte, line) of every place of each finding's value in its chunk's text.

    Findings carry no texts: their distinct values are gathered by chunk, and each text is gone through once by one
    automaton for all of its values, however many there are. Places of one value don't overlap, left to right;
    positions and lines count from 1, bytes from 0. Chunks of equal key are each gone through; null keys, null
    texts and null or empty values have no places. A chunk's values must fit a task, as its text does.
    """
    wanted = findings.filter(F.col(raw) != "").groupBy(F.col(key).alias("_key")).agg(F.collect_set(raw).alias("_values"))
    met = chunks.select(F.col(key), F.col(text).alias("_text")).join(wanted, F.col(key) == F.col("_key"))
    each = F.explode(F.arrow_udf("array<struct<raw:string,occurrence:bigint,position:bigint,start_byte:bigint,line:bigint>>")(_placed)("_text", "_values"))
    return met.select(key, each.alias("_p")).select(key, F.col("_p.raw").alias(raw), "_p.occurrence", "_p.position", "_p.start_byte", "_p.line")


def relocated(places: DataFrame, locations: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Places in a text that was put together from lines of files, with the path and line that each comes from.

    ``locations``: (key, line, path, source_line), a row for each line that has one; places on other lines are dropped.
    """
    known = locations.select(F.col(key).alias("_key"), F.col("line").alias("_line"), "path", "source_line")
    return places.join(known, (F.col(key) == F.col("_key")) & (F.col("line") == F.col("_line"))).drop("_key", "_line")
