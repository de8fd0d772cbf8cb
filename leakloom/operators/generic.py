"""Secrets of no known shape: long varied runs near credential words that nothing else explains."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.functions import text as X
from leakloom.functions.regex import to_java
from leakloom.operators.spans import matches

#: Words, lengths, floors and look-alikes.
KEYWORDS = (
    "api_key", "apikey", "api-key", "access_key", "access-key", "accesskey", "secret_key", "secret-key", "secretkey", "private_key", "private-key", "privatekey",
    "client_secret", "client-secret", "clientsecret", "auth_token", "auth-token", "authtoken", "bearer ", "bearer:", "x-api-key", "x-auth-token", "password", "passwd",
    "credential", "token=", "token:", "token ", "secret=", "secret:", "signing_secret", "signing-secret", "webhook_secret", "webhook-secret", "webhooksecret",
    "private_token", "private-token", "privatetoken", "auth=", "auth:", "authorization:", "x-secret", "x-token",
)
SHAPE, RADIUS, MIN_ENTROPY, CRYPT_BEFORE = r"[A-Za-z0-9+/_-]{20,128}", 256, 4.0, 100
DIGESTS = (32, 40, 56, 64, 128)
CRYPT = r"\$(2[abxy]|argon2(?:id|i|d)|1|5|6|pbkdf2(?:-sha\d+)?)\$"
ALGORITHMS = "(?i)sha512|sha384|sha256|sha224|sha1|md5|md4|base64|base58|base32|aes256|aes192|aes128|argon2id|argon2i|argon2d|pbkdf2|utf8|utf16|rsa2048|rsa4096|crc32|hmac256|hmac512"
ASSETS = (".js", ".mjs", ".cjs", ".css", ".vue", ".map", ".json", ".woff", ".woff2", ".png", ".svg", ".ts", ".tsx")
MIME = r"^[a-z][a-z0-9.+-]*/[a-z0-9.+-]*[a-z][a-z0-9.+-]*$"


def readable_base64(value: Column) -> Column:
    """Whether a value is base64, in either alphabet, of eight or more printable bytes."""
    alphabet = ~value.rlike("[-_]") | ~value.rlike("[+/]")
    plain = F.translate(value, "-_", "+/")
    decoded = F.hex(F.try_to_binary(F.rpad(plain, (F.ceil(F.char_length(plain) / 4) * 4).cast("int"), "="), F.lit("base64")))
    return F.coalesce(alphabet & (F.char_length(value) % 4 != 1) & decoded.rlike("^(?:[2-6][0-9A-F]|7[0-9A-E]){8,}$"), F.lit(False))


def explained(value: Column, before: Column, after: Column) -> Column:
    """Whether a run is an identifier, path, digest, hash fragment, file name, media type or readable base64.

    ``before`` and ``after``: the text around it.
    """
    stripped = F.regexp_replace(value, to_java(ALGORITHMS), "")
    asset = F.lit(False)
    for ending in ASSETS:
        asset = asset | after.startswith(ending)
    return (
        value.rlike("^[A-Za-z_]*$") | value.rlike("/.*/") | F.lower(value).rlike("^sha(?:256|384|512)-")
        | (F.char_length(value).isin(*DIGESTS) & value.rlike("^[0-9A-Fa-f]*$"))
        | F.right(before, F.lit(CRYPT_BEFORE)).rlike(to_java(CRYPT)) | (before.endswith("$") & after.startswith("$"))
        | ((stripped != value) & stripped.rlike("^[A-Za-z_]*$")) | (value.contains("-") & asset) | value.rlike(to_java(MIME)) | readable_base64(value)
    )


def near_credential_word(lowered: Column, start: Column, end: Column) -> Column:
    """Whether a credential word begins within RADIUS before or after a span, or inside it."""
    first = F.greatest(start - RADIUS, F.lit(1))
    out = F.lit(False)
    for size, words in groupby(sorted(KEYWORDS, key=len), key=len):
        around = F.substring(lowered, first, end + RADIUS + size - first)
        for w in words:
            out = out | around.contains(w)
    return out


def detect_generic(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row per different value of a chunk, the first that nothing explains, with the input's columns, detector, raw, start and end (1-based)."""
    lowered = X.ascii_lower(text)
    word = F.lit(False)
    for w in KEYWORDS:
        word = word | lowered.contains(w)
    body = F.col(text)

    def telling(s: Column) -> Column:
        start, end = s["start"], s["end"]
        before = F.substring(body, F.greatest(start - CRYPT_BEFORE, F.lit(1)), F.least(start - 1, F.lit(CRYPT_BEFORE)))
        return (X.entropy(s["value"]) >= MIN_ENTROPY) & near_credential_word(lowered, start, end) & ~explained(s["value"], before, F.substring(body, end, F.lit(8)))

    marked = chunks.filter(word & body.rlike(SHAPE)).withColumn("_s", matches(text, SHAPE)).withColumn("_s", F.filter("_s", telling))
    values = F.transform("_s", lambda s: s["value"])
    once = marked.withColumn("_s", F.explode(F.filter("_s", lambda s, i: F.array_position(values, s["value"]) == i + 1)))
    rows = once.select("*", F.lit("GenericHighEntropy").alias("detector"), F.lit(False).alias("verifier_backed"), F.col("_s")["value"].alias("raw"), F.lit(None).cast("string").alias("raw_v2"), F.col("_s")["start"].alias("start"), F.col("_s")["end"].alias("end"), F.lit(None).cast("int").alias("severity_override"))
    return rows.drop("_s")
