"""The scan as a whole: texts and archives, raw and decoded, to findings with their provenance and to coverage.

``views`` finds the encoded runs of a text and decodes them; ``scan`` tries the rules on the text and on each decoding
of it and keeps, for a rule and value, the first view that tells it: raw before base64, percent, hex and Unicode
escapes. A decoding is a list of pieces with their places in the source, so that a value found in it is traced back to
the source bytes that it was decoded from. Texts aren't copied onto findings, and all values of a text are placed by one
pass over it.

``opened`` turns files' bytes into chunks and failures in one pass, as rows of either kind; ``split`` writes them once,
apart by kind, so that no file is read and no archive is unpacked twice.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.functions import decode as D
from leakloom.functions.text import col, mostly_printable
from leakloom.operators import archives, detect, pipeline
from leakloom.operators import spans as P
from leakloom.operators.running import checkpoint_folder, spread
from leakloom.plans import rules as R

VARIANTS = ("base64", "percent", "hex", "unicode-escape")
_DECODE = {"base64": D.base64_run, "percent": D.percent_run, "hex": D.hex_run, "unicode-escape": D.unicode_run}
#: What a failure to open an archive is called.
ARCHIVE_KINDS = {"nested too deep": "max-depth", "unsafe name": "path", "entry too large": "max-entry-bytes", "archive too large": "max-files"}
_PLACE = [("decoded_from", "string"), ("source_start", "bigint"), ("source_end", "bigint")]
_FOUND = "detector string, verifier_backed boolean, raw string, raw_v2 string, start long, end long, start_byte long, end_byte long, line long, severity_override int, shown int, decoded_from string, source_start long, source_end long, source_line long"


def views(c) -> Column:
    """Array of (variant, start, end, piece): the runs of a text that decode, by variant and place (characters from 0)."""
    s, out = col(c), []
    whole = {"percent": D.percent(s), "unicode-escape": D.unicode_escapes(s)}
    for variant in VARIANTS:
        one = lambda m: F.struct(F.lit(variant).alias("variant"), (m["start"] - 1).alias("start"), (m["end"] - 1).alias("end"), F.make_valid_utf8(_DECODE[variant](m["value"])).alias("piece"))  # noqa: E731, B023
        pieces = F.transform(P.matches(s, D.RUNS[variant]), one)
        if variant in whole:
            out.append(F.when(whole[variant].isNotNull(), pieces))
        else:
            out.append(F.filter(pieces, lambda x: x["piece"].isNotNull() & mostly_printable(x["piece"])))
    none = F.expr("cast(array() as array<struct<variant:string,start:bigint,end:bigint,piece:string>>)")
    return F.concat(*(F.coalesce(x, none) for x in out))


class View:
    """One decoding of a text, and the way back from its characters to those of the text."""

    def __init__(self, text: str, variant: str, pieces: list[dict]):
        self.variant, parts, self.at, self.back, size = variant, [], [], [], 0
        joined, last = variant in ("base64", "hex"), 0
        for p in pieces:
            between = "" if joined else text[last : p["start"]]
            if between:
                self.at.append(size)
                self.back.append((last, None))
                parts.append(between.replace("+", " ") if variant == "percent" else between)
                size += len(between)
            elif joined and parts:
                parts.append("\n")
                size += 1
            self.at.append(size)
            self.back.append((p["start"], p["piece"]))
            parts.append(p["piece"])
            size, last = size + len(p["piece"]), p["end"]
        if not joined:
            self.at.append(size)
            self.back.append((last, None))
            parts.append(text[last:].replace("+", " ") if variant == "percent" else text[last:])
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The characters of the source that those of the decoding come from."""
        return self._back(start, False), self._back(end - 1, True)

    def _back(self, at: int, last: bool) -> int:
        k = bisect_right(self.at, at) - 1
        source, piece = self.back[k]
        part = at - self.at[k] + last
        if piece is None:
            return source + part
        if self.variant == "unicode-escape":
            return source + 6 * (len(piece[:part].encode("utf-16-le", "surrogatepass")) // 2)
        n = len(piece[:part].encode())
        if self.variant == "base64":
            return source + (-(-4 * n // 3) if last else 4 * n // 3)
        return source + (3 if self.variant == "percent" else 2) * n


def _scanned(compiled, text: str, pieces: list[dict], vicinity: int | None) -> list[dict]:
    """The findings of a text and its decodings, a value once for each rule, the first view first."""
    kept, seen, back = [], set(), []
    by = {v: [p for p in pieces if p["variant"] == v] for v in VARIANTS}
    for view in (None, *(View(text, v, ps) for v, ps in by.items() if ps)):
        inside = []
        for rule, raw, partner in compiled.find(view.text if view else text, vicinity):
            if (rule.name, raw) not in seen:
                seen.add((rule.name, raw))
                inside.append((rule, raw, partner))
        places = detect.first_places(view.text, (raw for _, raw, _ in inside)) if view and inside else {}
        kept += inside
        back += [(view.variant, *view.source(places[raw], places[raw] + len(raw))) if view else None for _, raw, _ in inside]
    rows = detect.told(text, kept)
    at = detect._Places(text)  # noqa: SLF001
    for row, source in zip(rows, back):
        if source:
            row |= {"decoded_from": source[0], "source_start": at.byte(source[1]), "source_end": at.byte(source[2]), "source_line": at.line(source[1])}
        else:
            row |= {"source_start": row["start_byte"], "source_end": row["end_byte"], "source_line": row["line"]}
    return rows


def scan(chunks: DataFrame, rules: Sequence[R.Rule], text: str = "text", vicinity: int | None = P.RADIUS) -> DataFrame:
    """Findings of texts and of what is encoded in them, with the chunks' other columns.

    ``decoded_from`` is null for what stands in the text as it is. ``start`` to ``end_byte`` and ``line`` are the first
    place of the value in the text, null if it is only in a decoding; ``source_start``, ``source_end`` (bytes) and
    ``source_line`` say where it or the run that it was decoded from stands. Null and empty texts have no findings;
    repeated chunks have theirs as often. Lines count from the text's beginning, from 0.
    """
    fixed = tuple(rules)
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T.ArrayType(T._parse_datatype_string(_FOUND)))  # noqa: SLF001

    @F.arrow_udf(f"array<struct<{_FOUND}>>")
    def found(texts: pa.Array, pieces: pa.Array) -> pa.Array:
        compiled = detect.compiled_rules(fixed)
        return pa.array([_scanned(compiled, t, p or [], vicinity) if t else [] for t, p in zip(texts.to_pylist(), pieces.to_pylist())], kind)

    seen = spread(chunks).withColumn("_v", views(text)).withColumn("f", F.explode(found(F.col(text), F.col("_v"))))
    return seen.select(*(c for c in chunks.columns if c != text), "f.*")


def enriched(found: DataFrame, base_line: str | None = None) -> DataFrame:
    """Severity, digest and rendering, and lines from ``base_line``; a value that isn't in the text has the chunk's own line."""
    base = F.col(base_line) if base_line else F.lit(1)
    out = detect.enrich(found.withColumn("line", F.coalesce("line", F.lit(0))), base_line)
    return out.withColumn("source_line", (F.col("source_line") + base).cast("long"))


def opened(files: DataFrame, max_bytes: int = 10 << 20, limit: int | None = None) -> DataFrame:
    """(tag, path, archive_path, text, kind, severity, error) of files (path, content): a row for each text and each failure.

    Archives are unpacked within limits; UTF-16 is told and decoded. Files of more than ``max_bytes`` and, with a
    ``limit``, what lies beyond so many bytes are gaps of kind source; archives and entries that can't be read are skipped
    by policy, of kind archive. Files with zero bytes at their beginning that aren't UTF-16 are binary and leave nothing,
    like empty ones; a null content is a gap.
    """
    size = F.octet_length("content")
    text_of = lambda c: F.coalesce(D.utf16(c), F.make_valid_utf8(c.cast("string")))
    bad = F.when(F.col("content").isNull(), "no content").when(size > max_bytes, F.concat(F.lit("too large: "), size.cast("string"), F.lit(" bytes")))
    failed = lambda kind, severity, error: (F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), error.alias("error"))
    row = lambda tag, path, text, *failure: F.struct(F.lit(tag).alias("tag"), path.cast("string").alias("archive_path"), text.cast("string").alias("text"), *(failure or failed(None, None, F.lit(None).cast("string"))))
    none = F.lit(None)
    entries = archives.explode(files.withColumn("_bad", bad).withColumn("content", F.when(F.col("_bad").isNull(), F.col("content")).otherwise(F.lit(b""))))
    body = F.col("content") if limit is None else F.substring("content", 1, limit)
    binary = F.hex(F.substring(body, 1, 512)).rlike("^(?:..)*?00") & D.utf16(body).isNull()
    inside = F.nullif(F.col("archive_path"), F.lit(""))
    kinds = F.create_map(*(F.lit(x) for pair in ARCHIVE_KINDS.items() for x in pair))
    said = F.coalesce(F.element_at(kinds, F.col("problem")), F.lit("corrupt-archive"))
    rows = F.array(
        F.when(F.col("_bad").isNotNull(), row("failure", none, none, *failed("source", "gap", F.col("_bad")))),
        F.when(F.col("problem").isNotNull(), row("failure", inside, none, *failed("archive", "policy-skip", said))),
        F.when((F.octet_length(body) > 0) & ~binary, row("chunk", inside, text_of(body))),
        F.when(F.lit(limit is not None) & (F.octet_length("content") > F.lit(limit or 0)), row("failure", inside, none, *failed("source", "gap", F.lit("cut")))),
    )
    out = entries.withColumn("_r", F.explode(F.filter(rows, lambda r: r.isNotNull())))
    keep = [c for c in files.columns if c != "content"]
    return out.select(*keep, "_r.*")


def split(tagged: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The chunks and the failures of ``opened``, written once to a folder that all machines share and read from there.

    Without a folder they go to the session's ``spark.checkpoint.dir``.
    """
    spark = tagged.sparkSession
    if folder is None:
        folder = f"{checkpoint_folder(spark)}/opened-{uuid.uuid4().hex}"
    tagged.write.partitionBy("tag").parquet(folder)
    known = [f for f in tagged.schema.fields if f.name != "tag"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known) + ", tag string"
    rows = spark.read.schema(schema).parquet(folder)
    chunks = rows.filter("tag = 'chunk'").drop("tag", "kind", "severity", "error")
    return chunks, rows.filter("tag = 'failure'").drop("tag", "text")


@dataclass(frozen=True)
class Options:
    """What a scan looks for and what becomes of it; severities by name."""

    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    custom: str | None = None
    allow: Sequence[dict] = ()
    show_suppressed: bool = False
    vicinity: int | None = P.RADIUS
    fail_on: str = "any"
    fail_on_coverage: str = "gap"
    max_bytes: int = 10 << 20
    limit: int | None = None
    rules: Sequence[R.Rule] = field(default=())

    def chosen(self) -> list[R.Rule]:
        """The rules given, else the catalog, and custom ones from their JSON."""
        from leakloom.plans import catalog

        own = R.load_custom(self.custom) if self.custom else []
        return R.select([*(self.rules or catalog.load()), *own], self.include, self.exclude)


@dataclass(frozen=True)
class Scanned:
    """A scan's outcome: findings, coverage, and a row with the numbers and the exit code."""

    findings: DataFrame
    coverage: DataFrame
    gate: DataFrame


def scan_files(files: DataFrame, options: Options = Options(), folder: str | None = None) -> Scanned:
    """Scan files (path, content): open them, detect, enrich, de-duplicate and filter; the exit code is the worse of both gates."""
    chunks, coverage = split(opened(files, options.max_bytes, options.limit), folder)
    found = enriched(scan(chunks, options.chosen(), vicinity=options.vicinity))
    place = F.concat_ws("!", F.col("path").cast("string"), "archive_path")
    found = pipeline.suppress(pipeline.dedup(found.withColumn("location", place).withColumn("seq", F.struct(~F.col("verifier_backed"), "detector", "start_byte", "source_start")), order="seq"), options.allow, options.show_suppressed)
    findings, covered = pipeline.gate(found if not options.show_suppressed else found.filter("suppressed_by is null"), options.fail_on), pipeline.coverage_gate(coverage, options.fail_on_coverage)
    both = findings.withColumnRenamed("exit_code", "_f").withColumn("_k", F.lit(1)).join(covered.withColumnRenamed("exit_code", "_c").withColumn("_k", F.lit(1)), "_k")
    gate = both.select("findings", "failing", "gaps", "skips", F.greatest("_f", "_c").alias("exit_code"))
    return Scanned(found.drop("seq", "location"), coverage, gate)
