"""Encoded variants of a text: base64, hexadecimal, percent, Unicode escapes and UTF-16."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakloom.functions.text import col, mostly_printable

#: Shortest encoded runs.
BASE64_RUN, HEX_RUN = 32, 40


def once(value: Column, body) -> Column:
    """Bind a value to a name inside an expression, so that it is computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def _joined(parts: Column) -> Column:
    return once(F.filter(parts, lambda s: s.isNotNull() & mostly_printable(s)), lambda good: F.when(F.size(good) > 0, F.array_join(good, "\n")))


#: Runs that are decoded, by variant.
RUNS = {"base64": rf"[A-Za-z0-9+/_-]{{{BASE64_RUN},}}={{0,2}}", "percent": r"(?:%[0-9A-Fa-f]{2})+", "hex": rf"[0-9a-fA-F]{{{HEX_RUN},}}", "unicode-escape": r"(?:\\u[0-9A-Fa-f]{4})+"}


def base64_run(r: Column) -> Column:
    """A base64 run decoded; null if its length can't be."""
    plain = F.rtrim(F.translate(r, "-_", "+/"), F.lit("="))
    whole = F.rpad(plain, (F.ceil(F.char_length(plain) / 4) * 4).cast("int"), "=")
    return F.when(F.char_length(plain) % 4 != 1, F.try_to_binary(whole, F.lit("base64")).cast("string"))


def base64_runs(c) -> Column:
    """All base64 runs of a text, decoded and joined by newlines; null if none decodes to printable text."""
    return _joined(F.transform(F.regexp_extract_all(col(c), F.lit(RUNS["base64"]), F.lit(0)), base64_run))


def hex_run(r: Column) -> Column:
    """A run of hexadecimal digits decoded; null if it is no text."""
    return F.when(F.char_length(r) % 2 == 0, F.try_validate_utf8(F.unhex(r).cast("string")))


def hex_runs(c) -> Column:
    """All long runs of hexadecimal digits of even length, decoded."""
    return _joined(F.transform(F.regexp_extract_all(col(c), F.lit(RUNS["hex"]), F.lit(0)), hex_run))


def percent_run(r: Column) -> Column:
    return F.unhex(F.replace(r, F.lit("%"))).cast("string")


def percent(c) -> Column:
    """The text with %HH and + decoded, if two escapes stand side by side and the result is printable."""
    s = col(c)
    pieces = F.regexp_extract_all(s, F.lit(r"(?s)(?:%[0-9A-Fa-f]{2})+|[^%]+|%"), F.lit(0))
    one = lambda p: F.when(p.rlike("^(?:%[0-9A-Fa-f]{2})+$"), percent_run(p)).otherwise(F.translate(p, "+", " "))
    whole = F.when(s.rlike("%[0-9A-Fa-f]{2}%[0-9A-Fa-f]{2}"), F.array_join(F.transform(pieces, one), ""))
    return once(whole, lambda out: F.when(mostly_printable(out) & (F.char_length(out) != F.char_length(s)), out))


#: Halves of surrogate pairs that stand alone.
_LONE = r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F][0-9a-fA-F]{2})|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}"


def unicode_run(r: Column) -> Column:
    """A run of \\uXXXX decoded; halves of surrogate pairs that stand alone become U+FFFD."""
    return F.decode(F.unhex(F.replace(F.regexp_replace(r, _LONE, r"\\uFFFD"), F.lit("\\u"))), "UTF-16BE")


def unicode_escapes(c) -> Column:
    """The text with \\uXXXX decoded, surrogate pairs included, if two escapes stand side by side."""
    s = col(c)
    pieces = F.regexp_extract_all(s, F.lit(r"(?s)(?:\\u[0-9A-Fa-f]{4})+|[^\\]+|\\"), F.lit(0))
    one = lambda p: F.when(p.rlike(r"^(?:\\u[0-9A-Fa-f]{4})+$"), unicode_run(p)).otherwise(p)
    whole = F.when(s.rlike(r"\\u[0-9A-Fa-f]{4}\\u[0-9A-Fa-f]{4}"), F.array_join(F.transform(pieces, one), ""))
    return once(whole, lambda out: F.when(mostly_printable(out), out))


def utf16(data) -> Column:
    """UTF-16 bytes as text, told by a byte-order mark or by zero bytes in every other place of the first 128."""
    b = col(data)
    head = F.hex(F.substring(b, 1, 128))
    even, odd = (F.size(F.filter(F.regexp_extract_all(head, F.lit("(..)(..)"), F.lit(k)), lambda x: x == "00")) for k in (1, 2))
    pairs = F.floor(F.char_length(head) / 4)
    long = F.octet_length(b) >= 8
    kind = F.when(head.startswith("FFFE"), "LE").when(head.startswith("FEFF"), "BE").when(long & (odd >= 0.75 * pairs), "LE").when(long & (even >= 0.75 * pairs), "BE")
    body = F.when(head.startswith("FFFE") | head.startswith("FEFF"), F.substring(b, 3, 2147483647)).otherwise(b)
    digits = F.hex(body)
    digits = F.substring(digits, F.lit(1), (F.floor(F.char_length(digits) / 4) * 4).cast("int"))  # a last odd byte is dropped
    units = F.when(kind == "LE", F.regexp_replace(digits, "(..)(..)", r"\\u$2$1")).when(kind == "BE", F.regexp_replace(digits, "(....)", r"\\u$1"))
    out = unicode_run(units)
    return F.when(mostly_printable(out), out)


def variants(c) -> Column:
    """Array of (variant, vtext): the text itself and each decoding that yields something."""
    s = col(c)
    made = [("raw", s), ("base64", base64_runs(s)), ("percent", percent(s)), ("hex", hex_runs(s)), ("unicode-escape", unicode_escapes(s))]
    return F.filter(F.array(*(F.struct(F.lit(n).alias("variant"), v.alias("vtext")) for n, v in made)), lambda x: x["vtext"].isNotNull())
