"""Added lines of unified diffs, and data lines of SQL dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words that make a comment in a dump worth scanning, lines in a chunk, longest line.
COMMENT_WORDS = ("password", "passwd", "secret", "token", "key", "api_key", "apikey", "auth", "credential", "private", "access_key")
CHUNK_LINES, MAX_LINE = 50, 4 << 20


def added_lines(diffs: DataFrame, key: str = "diff_id", text: str = "text") -> DataFrame:
    """(key, path, line, content) of the lines that diffs add, with their place in the new file.

    Windows run over one diff each; a diff is a document, so no group grows with the table.
    """
    rows = diffs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "raw"))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hunk = F.regexp_extract("raw", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    starts = rows.withColumn("hunk", F.when(F.col("raw").rlike(r"^@@ "), hunk.cast("long"))).withColumn("is_file", F.col("raw").startswith("+++ "))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring("raw", 5, 1 << 20), "\t.*$", ""), '^"|"$', ""), "^b/", "")
    known = starts.withColumn("path", F.last(F.when(F.col("is_file"), name), True).over(order)).withColumn("block", F.sum((F.col("hunk").isNotNull() | F.col("is_file") | F.col("raw").startswith("diff ")).cast("long")).over(order))
    inside = Window.partitionBy(key, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = known.withColumn("first", F.first("hunk", True).over(inside)).withColumn("new", F.sum(F.when(F.col("hunk").isNull() & (F.col("raw").startswith("+") | F.col("raw").startswith(" ")), 1).otherwise(0)).over(inside))
    return counted.filter("first is not null and hunk is null and raw like '+%' and path <> '/dev/null'").select(key, "path", (F.col("first") + F.col("new") - 1).alias("line"), F.substring("raw", 2, 1 << 30).alias("content"))


def buffers(added: DataFrame, key: str = "diff_id") -> tuple[DataFrame, DataFrame]:
    """(key, text) of each diff's added lines by path and line, and (key, line, path, source_line) of where each of them comes from."""
    order = Window.partitionBy(key).orderBy("path", "line", "content")
    numbered = added.withColumn("_line", F.row_number().over(order).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "content"))), lambda x: x["content"]), "\n")
    return numbered.groupBy(key).agg(text.alias("text")), numbered.select(key, F.col("_line").alias("line"), "path", F.col("line").alias("source_line"))


def dump_lines(dumps: DataFrame, key: str = "dump_id", text: str = "text") -> DataFrame:
    """(key, db, table, line, content): data lines and telling comments of SQL dumps in any of three dialects.

    The table comes from the nearest CREATE, INSERT or COPY above; a COPY block ends with a
    backslash and a dot; overlong lines are left out.
    """
    rows = dumps.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "raw")).filter(F.octet_length("raw") <= MAX_LINE)
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    name = r"[`\"\[]?([A-Za-z0-9_$.]+)[`\"\]]?"
    used = F.regexp_extract("raw", rf"(?i)^\s*(?:USE|\\connect)\s+{name}", 1)
    table = F.regexp_extract("raw", rf"(?i)^\s*(?:CREATE\s+TABLE(?:\s+IF\s+NOT\s+EXISTS)?|INSERT\s+(?:IGNORE\s+)?INTO|COPY)\s+(?:[`\"\[]?[A-Za-z0-9_$]+[`\"\]]?\.)?{name}", 1)
    copies = F.when(F.col("raw").rlike(r"(?i)^\s*COPY\s.*\sFROM\s+stdin"), 1).when(F.col("raw") == "\\.", 0)
    full = rows.withColumn("db", F.coalesce(F.last(F.nullif(used, F.lit("")), True).over(order), F.lit(""))).withColumn("table", F.coalesce(F.last(F.nullif(table, F.lit("")), True).over(order), F.lit(""))).withColumn("copying", F.coalesce(F.last(copies, True).over(order), F.lit(0)))
    telling = F.lit(False)
    for w in COMMENT_WORDS:
        telling = telling | F.lower("raw").contains(w)
    comment = F.col("raw").rlike(r"^\s*(?:--|#|/\*)")
    data = ((F.col("copying") == 1) & copies.isNull()) | F.col("raw").rlike(r"(?i)^\s*(?:INSERT\s|\(|VALUES\b)") & ~comment | (comment & telling)
    return full.filter(data).select(key, "db", "table", (F.col("pos") + 1).cast("long").alias("line"), F.col("raw").alias("content"))


def dump_chunks(lines: DataFrame, key: str = "dump_id") -> DataFrame:
    """Fifty data lines of a table to a chunk, in order, with the line of the first."""
    n = F.row_number().over(Window.partitionBy(key, "db", "table").orderBy("line")) - 1
    ordered = F.array_sort(F.collect_list(F.struct("line", "content")))
    return lines.withColumn("part", F.floor(n / CHUNK_LINES)).groupBy(key, "db", "table", "part").agg(F.min("line").alias("base_line"), F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("text"))


def staged(repository: str) -> str:
    """The staged changes of a repository as a diff."""
    import subprocess

    return subprocess.run(["git", "-C", repository, "diff", "--cached", "--no-color"], capture_output=True, check=True).stdout.decode("utf-8", "replace")
