"""Redaction of free text: ordered patterns and matches by JVM functions, detectors by their Arrow stage."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.functions.regex import to_java
from leakloom.functions.text import col, entropy
from leakloom.operators.detect import ascii_lowered, compiled_rules
from leakloom.plans.rules import Rule

#: What is replaced, in order.
STEPS = (
    (r" \+0x[0-9a-fA-F]+", ""),
    (r"0x[0-9a-fA-F]+", "0x?"),
    (r"goroutine [0-9]+ \[", "goroutine ["),
    (r"in goroutine [0-9]+", "in goroutine N"),
    (r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s\"'<>()\[\]]+", "[URL]"),
    (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\b(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}\b|\b(?:[0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{0,4}::(?:[0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{1,4}\b", "[IP]"),
    (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP]"),
    (r"(^|[\s\"'=:(])/[^/\s\"':()][^\s\"':()]*", "$1[PATH]"),
    (r"\b[A-Za-z]:\\[^\s\"':()]+", "[PATH]"),
)
TOKEN, TOKEN_ENTROPY = r"[A-Za-z0-9+_=\-]{20,}", 3.5


def redact(c) -> Column:
    """URLs, addresses, paths, and tokens of twenty or more characters that are hexadecimal or mixed and varied."""
    out = col(c)
    for pattern, mark in STEPS:
        out = F.regexp_replace(out, to_java(pattern), mark)
    pieces = F.regexp_extract_all(out, F.lit(rf"(?s){TOKEN}|(?:(?!{TOKEN}).)+"), F.lit(0))
    telling = lambda p: p.rlike(f"^{TOKEN}$") & (p.rlike("^[0-9a-fA-F]+$") | (p.rlike("[0-9]") & p.rlike("[A-Za-z]") & (entropy(p) >= TOKEN_ENTROPY)))
    return F.array_join(F.transform(pieces, lambda p: F.when(telling(p), F.lit("[TOKEN]")).otherwise(p)), "")


def replaced(c, matches) -> Column:
    """A text with every match (type, text) replaced by its type, the longest first, so that no part of one is taken before it.

    Lengths are in bytes, equal ones go as they stand; a match is replaced wherever it stands. Blank and null
    matches are left out, a match without a type is ``UNKNOWN``. A null text stays null, null matches are none.
    """
    numbered = F.transform(F.coalesce(col(matches), F.expr("cast(array() as array<struct<type:string,text:string>>)")), lambda m, i: F.struct((-F.octet_length(m["text"])).alias("n"), i.alias("i"), m["type"].alias("type"), m["text"].alias("text")))
    good = F.array_sort(F.filter(numbered, lambda m: m["text"].isNotNull() & m["text"].rlike(r"\S")))
    kind = lambda m: F.coalesce(F.nullif(F.upper(F.trim(m["type"])), F.lit("")), F.lit("UNKNOWN"))
    return F.aggregate(good, col(c), lambda text, m: F.replace(text, m["text"], F.concat(F.lit("[PII:"), kind(m), F.lit("]"))))


def scrubbed(chunks: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """The rows with all values and partners that rules find in their text replaced by the detector's name.

    Rules are tried one after another on the whole text as the ones before have left it, if one of their keywords
    stands in the text that came. Null texts stay null.
    """
    fixed, at = tuple(rules), chunks.columns.index(text)

    def scrub(batches):
        known = compiled_rules(fixed)
        for batch in batches:
            out = []
            for found in batch.column(at).to_pylist():
                for k in sorted(known.hits(ascii_lowered(found))) if found else ():
                    for rule, raw, partner in list(known.only(k).find(found, None)):
                        for value in filter(None, (raw, partner)):
                            found = found.replace(value, f"[REDACTED:{rule.name}]")
                out.append(found)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return chunks.mapInArrow(scrub, chunks.schema)


def redact_all(chunks: DataFrame, rules: Sequence[Rule], matches: str | None = None, text: str = "text") -> DataFrame:
    """The rows with their text redacted by pattern, then by detectors, then by the matches (type, text) of a column."""
    out = scrubbed(chunks.withColumn(text, redact(text)), rules, text)
    return out.withColumn(text, replaced(text, matches)) if matches else out
