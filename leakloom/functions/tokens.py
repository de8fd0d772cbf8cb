"""Structured secrets taken apart: web tokens, connection strings, key blocks, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakloom.functions.text import col


def _segment(token: Column, k: int) -> Column:
    plain = F.translate(F.element_at(F.split(token, "\\."), k), "-_", "+/")
    return F.try_to_binary(F.rpad(plain, (F.ceil(F.char_length(plain) / 4) * 4).cast("int"), "="), F.lit("base64")).cast("string")


def jwt(c, now: Column | None = None) -> Column:
    """(alg, iss, aud, sub, scope, exp, severity_rank) of a web token: unsigned is critical, expired low, others high."""
    t = col(c)
    head, body = _segment(t, 1), _segment(t, 2)
    claim = lambda name: F.get_json_object(body, f"$.{name}")
    alg, exp = F.get_json_object(head, "$.alg"), claim("exp").cast("double").cast("long")
    at = F.unix_timestamp() if now is None else now
    rank = F.when(F.lower(alg) == "none", 5).when(exp < at, 2).otherwise(4)
    return F.struct(alg.alias("alg"), claim("iss").alias("iss"), claim("aud").alias("aud"), claim("sub").alias("sub"), claim("scope").alias("scope"), exp.alias("exp"), rank.alias("severity_rank"))


def dsn(c) -> Column:
    """(scheme, user, password, host, database) of a connection URL; the password percent-decoded."""
    parts = rf"^([a-z][a-z0-9+.\-]*)://([^:/@\s]*):(.*)@([^/?#@\s]+)(?:/([^?#\s]*))?"
    get = lambda k: F.regexp_extract(col(c), parts, k)
    return F.struct(get(1).alias("scheme"), get(2).alias("user"), F.coalesce(F.try_url_decode(F.replace(get(3), F.lit("+"), F.lit("%2B"))), get(3)).alias("password"), get(4).alias("host"), get(5).alias("database"))


def pem_blocks(c) -> Column:
    """All private-key blocks of a text."""
    return F.regexp_extract_all(col(c), F.lit(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"), F.lit(0))


def pgpass(line) -> Column:
    """(host, port, database, user, password) of a password-file line, with escaped colons; null if it isn't one."""
    field = r"((?:[^:\\]|\\.)*)"
    pattern = f"^{field}:{field}:{field}:{field}:{field}$"
    get = lambda k: F.regexp_replace(F.regexp_extract(col(line), pattern, k), r"\\(.)", "$1")
    names = ("host", "port", "database", "user", "password")
    return F.when(col(line).rlike(pattern) & ~col(line).startswith("#") & (get(5) != ""), F.struct(*(get(k + 1).alias(n) for k, n in enumerate(names))))


def markup_text(c) -> Column:
    """Text of storage markup: scripts and comments dropped, block ends as newlines, common references decoded."""
    out = F.regexp_replace(col(c), r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1>", "")
    out = F.regexp_replace(out, r"(?i)</(?:p|div|li|h[1-6]|tr|table|ul|ol|article|footer|nav|title)>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s*\n\s*", "\n"), F.lit(" \n\t\r"))


def rich_text(c) -> Column:
    """All "text" values of a nested JSON document in order, whatever its depth, joined by spaces."""
    values = F.regexp_extract_all(col(c), F.lit(r'"text"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.array_join(F.transform(values, lambda v: F.get_json_object(F.concat(F.lit('{"v":"'), v, F.lit('"}')), "$.v")), " ")
