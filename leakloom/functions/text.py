"""Measures and renderings of strings, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a hidden value, the first that doesn't contain it.
MARKERS = ("***", "...", "(redacted)", "[hidden]")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c) -> Column:
    """Lower-case A to Z only, as keyword matching needs it."""
    return F.translate(col(c), _UPPER, _LOWER)


def _entropy_of(units: Column, n: Column) -> Column:
    """Entropy of an array of strings whose counts are held against ``n``."""
    sizes = F.transform(F.array_distinct(units), lambda x: F.size(F.filter(units, lambda y: y == x)))
    return F.aggregate(sizes, F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n))


def entropy(c, by_character: bool = False) -> Column:
    """Shannon entropy in bits a byte of UTF-8; 0 for empty strings.

    By character, characters are counted but still held against the number of bytes.
    """
    s = col(c)
    n = F.octet_length(s).cast("double")
    characters = F.filter(F.split(s, ""), lambda x: x != "")
    if by_character:
        out = _entropy_of(characters, n)
    else:
        pairs = F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit("(..)"), F.lit(1))
        plain = F.aggregate(F.transform(F.array_distinct(characters), lambda x: F.char_length(s) - F.char_length(F.replace(s, x))), F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n))
        out = F.when(F.char_length(s) == F.octet_length(s), plain).otherwise(_entropy_of(pairs, n))
    return F.when(s.isNull(), None).when(F.char_length(s) == 0, 0.0).otherwise(out)


def occurrences(c, needle: str) -> Column:
    """Number of non-overlapping occurrences of a string."""
    s = col(c)
    return ((F.char_length(s) - F.char_length(F.replace(s, F.lit(needle)))) / len(needle)).cast("long")


def byte_offset(c, position) -> Column:
    """Bytes before a 1-based character position."""
    return F.octet_length(F.substring(col(c), F.lit(1), col(position) - 1)).cast("long")


def line_at(c, position, base=1) -> Column:
    """Line of a 1-based character position; ``base`` is the line of the first character."""
    before = F.substring(col(c), F.lit(1), col(position) - 1)
    return (F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"))) + (F.lit(base) if isinstance(base, int) else base)).cast("long")


def near(c, start, end, radius: int, pattern: str) -> Column:
    """Whether a pattern is found within a radius around a span, in lower-cased text."""
    s = ascii_lower(c)
    first = F.greatest(col(start) - radius, F.lit(1))
    return F.substring(s, first, col(end) + radius - first).rlike(pattern)


def redacted(c, keep: int | Column = 6) -> Column:
    """The first characters and dots; short values are hidden altogether. What is shown never holds the value."""
    s, keep = col(c), F.lit(keep) if isinstance(keep, int) else keep
    hidden = F.lit(MARKERS[-1])
    for marker in MARKERS[-2::-1]:
        hidden = F.when(~F.lit(marker).contains(s), marker).otherwise(hidden)
    return F.when(F.char_length(s) == 0, "").when(F.char_length(s) > keep, F.concat(F.left(s, keep), F.lit("..."))).otherwise(hidden)


def pii_redacted(kind, c) -> Column:
    """E-mail addresses keep their first character and domain, others their first and last; under three characters stay."""
    s = col(c)
    at = F.instr(s, "@")
    mail = F.concat(F.left(s, F.lit(1)), F.lit("***"), F.substring(s, at, F.char_length(s)))
    ends = F.concat(F.left(s, F.lit(1)), F.lit("***"), F.right(s, F.lit(1)))
    return F.when(F.char_length(s) < 3, s).when((col(kind) == "EMAIL_ADDRESS") & (at > 2), mail).otherwise(ends)


def secret_hash(c) -> Column:
    s = col(c)
    return F.when(F.coalesce(F.char_length(s), F.lit(0)) == 0, "").otherwise(F.sha2(s, 256))


def mostly_printable(c) -> Column:
    """At least four fifths of the characters are printable ASCII, tab or line ends."""
    s = col(c)
    n = F.char_length(s)
    bad = F.char_length(F.regexp_replace(s, r"[\x20-\x7e\t\n\r]", ""))
    return (n > 0) & (bad <= n - F.floor(n * 0.8))


def terminal_safe(c) -> Column:
    """Control and direction characters made visible."""
    out = F.replace(F.replace(F.replace(col(c), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.regexp_replace(out, "[\\x00-\\x1f\\x7f-\\x9f​-‏‪-‮⁦-⁩﻿]", "�")


def uri_path(c) -> Column:
    """A path with each segment percent-encoded."""
    return F.array_join(F.transform(F.split(col(c), "/"), lambda x: F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))), "/")
