"""Queries over the public tables, one for each operator, with the SQL that checks them."""

from __future__ import annotations

import gzip
import io
import tarfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakloom.functions import decode as D
from leakloom.functions import findings as K
from leakloom.functions import text as X
from leakloom.functions import tokens as TK
from leakloom.operators import allowlist, detect, generic, pipeline, redact, running, scan, spans, verdicts
from leakloom.plans import catalog
from leakloom.plans.rules import load_custom
from leakloom.sinks import render
from leakloom.sources import diffs, history, tables
from leakloom.streaming import generations, incremental

_QUERIES: dict = {}
_SQL: dict = {}

CUSTOM = r"""[
 {"name": "HexToken", "keywords": ["token"], "regex": "token\\s*=\\s*\"([0-9a-f]{40})\"", "entropy_min": 3.0, "severity": "high"},
 {"name": "PasswordLine", "keywords": ["password="], "regex": "password=([0-9a-z]{8,40})\\b", "severity": "medium"},
 {"name": "MailAddress", "keywords": ["@"], "regex": "\\b([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+)", "severity": "low"}
]"""


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf) -> DataFrame:
    return tables.from_documents(table(spark, sf, "documents"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans_sql(relation: str, key: str, text: str, pattern: str) -> str:
    """(key, full_text, i, value, start, end) of all matches; starts are added up from the pieces between them."""
    p = _q(pattern)
    return f"""(select {key}, {text} as full_text, i, w[i] as value, start, start + length(w[i]) as "end" from (
      select {key}, {text}, w, i, cast(1 + list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) as bigint) as start from (
        select {key}, {text}, w, s, unnest(range(1, len(w) + 1)) as i from (
          select {key}, {text}, regexp_extract_all({text}, {p}) as w, string_split_regex({text}, {p}) as s from {relation}) where len(w) > 0)))"""


# Bits a byte: counts of pairs of hexadecimal digits.
_ENTROPY = "list_aggregate(regexp_extract_all(hex(encode({0})), '..'), 'entropy')"
#: The custom rules' patterns again, without groups: the secret is the whole match, told once a text and placed at its first copy.
_CUSTOM_PATTERNS = {"HexToken": "token\\s*=\\s*\"[0-9a-f]{40}\"", "PasswordLine": "password=[0-9a-z]{8,40}\\b", "MailAddress": "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"}


def _custom_matches_sql() -> str:
    """(doc_id, text, detector, severity_rank, value) of every match."""
    parts = []
    for r in load_custom(CUSTOM):
        low = f"translate(text, '{X._UPPER}', '{X._LOWER}')"  # noqa: SLF001
        matches = f"select doc_id, text, unnest(regexp_extract_all(text, {_q(_CUSTOM_PATTERNS[r.name])})) as value from documents where {' or '.join(f'contains({low}, {_q(k)})' for k in r.keywords)}"
        characters = "list_aggregate(string_split(value, ''), 'entropy')"  # characters against bytes are alike for ASCII values, which these rules find
        gate = f"and {characters} >= {r.min_entropy}" if r.min_entropy else ""
        parts.append(f"select doc_id, text, '{r.name}' as detector, {r.severity} as severity_rank, '{K.SEVERITIES[r.severity]}' as severity, value from ({matches}) where length(value) > 0 {gate}")
    return " union all ".join(parts)


def _custom_sql() -> str:
    before = "substr(text, 1, strpos(text, value) - 1)"
    return f"""select distinct doc_id as chunk_id, detector, sha256(value) as secret_hash, case when length(value) > 6 then substr(value, 1, 6) || '...' when value = '***' then '...' else '***' end as redacted, severity_rank, severity,
      cast(1 + length({before}) - length(replace({before}, chr(10), '')) as bigint) as line, cast(strlen({before}) as bigint) as start_byte, cast(strlen({before}) + strlen(value) as bigint) as end_byte, value from ({_custom_matches_sql()})"""


def custom_matches(spark, sf) -> DataFrame:
    return detect.enrich(detect.detect(documents(spark, sf), load_custom(CUSTOM), vicinity=None), "base_line")


def custom_findings(spark, sf) -> DataFrame:
    """What is left of them when copies are dropped."""
    return pipeline.dedup(custom_matches(spark, sf), "container", "start_byte")


@query("select chunk_id, detector, secret_hash, redacted, severity_rank, severity, line, start_byte, end_byte from (" + _custom_sql() + ")")
def scan_custom_rules(spark, sf):
    return custom_findings(spark, sf).select("chunk_id", "detector", "secret_hash", "redacted", "severity_rank", "severity", "line", "start_byte", "end_byte")


@query(f"select source, detector, severity, count(*) as findings, count(distinct secret_hash) as secrets from ({_custom_sql()}) f join documents d on d.doc_id = f.chunk_id group by all")
def scan_source_counts(spark, sf):
    found = custom_findings(spark, sf)
    return found.groupBy(F.col("parent").alias("source"), "detector", "severity").agg(F.count("*").alias("findings"), F.countDistinct("secret_hash").alias("secrets"))


# Texts with secrets made of digests, alike in both engines; prefixes are split, so that none stands here in full.
_PAD = "repeat('- ', 140)"
_SEEDS = {
    "AWS": f"concat({_PAD}, ' key AK', 'IA', upper(substr({{md}}, 1, 16)), ' secret: ', substr({{sha}}, 1, 40), ' end')",
    "GitHub": "concat(' gh', 'p_', substr({sha}, 1, 36), ' x')",
    "Brevo": "concat(' xkey', 'sib-', {sha}, '-', substr({md}, 1, 16), ' x')",
    "Agenta": "concat(' agen', 'ta_', substr({sha}, 1, 40), ' x')",
    "Stripe": "concat(' sk_', 'live_', substr({sha}, 1, 24), ' x')",
    "AbnormalSec": f"concat({_PAD}, ' abnormal_api_key = ', substr({{sha}}, 1, 48), ' x')",
}
_REGEX_BATCH = ("GitHub", "Brevo", "Agenta", "Stripe")


def _seed(names, duck: bool) -> str:
    md = "md5(cast(doc_id as varchar))" if duck else "md5(cast(doc_id as string))"
    sha = "sha256(cast(doc_id as varchar))" if duck else "sha2(cast(doc_id as string), 256)"
    return "concat(text, " + ", ".join(_SEEDS[n].format(md=md, sha=sha) for n in names) + ")"


def _seeded_sql(names) -> str:
    return f"(select doc_id, {_seed(names, True)} as text from documents)"


def seeded(spark, sf, names=tuple(_SEEDS)) -> DataFrame:
    docs = table(spark, sf, "documents")
    return tables.from_documents(docs.withColumn("text", F.expr(_seed(names, False))))


def _hits_sql(r, relation: str) -> str:
    """Matches of all forms of a rule whose secrets are whole matches, in texts with one of its keywords."""
    low = f"translate(text, '{X._UPPER}', '{X._LOWER}')"  # noqa: SLF001
    keys = " or ".join(f"contains({low}, {_q(k)})" for k in r.keywords)
    return "(" + " union all ".join(f"select * from {_spans_sql(f'(select * from {relation} where {keys})', 'doc_id', 'text', p)}" for p in r.patterns) + ")"


def _batch_sql() -> str:
    parts = []
    for r in catalog.named(*_REGEX_BATCH):
        gate = f"and {_ENTROPY.format('value')} >= {r.min_entropy}" if r.min_entropy else ""
        parts.append(f"select '{r.name}' as detector, doc_id as chunk_id, sha256(value) as secret_hash, min(start) as start from {_hits_sql(r, _seeded_sql(_REGEX_BATCH))} where length(value) > 0 {gate} group by doc_id, value")
    return " union all ".join(parts)


@query(_batch_sql())
def detect_regex_batch(spark, sf):
    found = detect.detect(seeded(spark, sf, _REGEX_BATCH), catalog.named(*_REGEX_BATCH), vicinity=None)
    return found.select("detector", "chunk_id", X.secret_hash("raw").alias("secret_hash"), "start")


def _near_sql() -> str:
    # The radius is in bytes; the padding is as long as it and ASCII, and so is what follows, so that characters say the same.
    (r,) = catalog.named("AbnormalSec")
    around = f"""substr(translate(full_text, '{X._UPPER}', '{X._LOWER}'), greatest(start - {r.radius}, 1), "end" + {r.radius} - greatest(start - {r.radius}, 1))"""  # noqa: SLF001
    return f"select distinct doc_id as chunk_id, sha256(value) as secret_hash from {_hits_sql(r, _seeded_sql(('AbnormalSec',)))} where {_ENTROPY.format('value')} >= {r.min_entropy} and regexp_matches({around}, {_q(r.arms[0])})"


@query(_near_sql())
def detect_near_context(spark, sf):
    found = detect.detect(seeded(spark, sf, ("AbnormalSec",)), catalog.named("AbnormalSec"), vicinity=None)
    return found.select("chunk_id", X.secret_hash("raw").alias("secret_hash"))


def _pair_sql() -> str:
    # A partner is the 40 characters inside a match with a character of another kind on each side.
    (r,) = catalog.named("AWS")
    apart = "[^A-Za-z0-9+/]"
    b = f"(select doc_id, start + 1 as start, substr(value, 2, 40) as value from {_spans_sql(_seeded_sql(('AWS',)), 'doc_id', 'text', apart + '[A-Za-z0-9+/]{40}' + apart)})"
    a = f"(select * from {_hits_sql(r, _seeded_sql(('AWS',)))} where start = 1 or not regexp_matches(substr(full_text, start - 1, 1), '[0-9A-Za-z_]'))"
    return f"select distinct chunk_id, id_hash, secret_hash from (select a.doc_id as chunk_id, sha256(a.value) as id_hash, sha256(first(b.value order by abs(b.start - a.start), b.start)) as secret_hash from {a} a left join {b} b on b.doc_id = a.doc_id and abs(b.start - a.start) <= {r.partner_radius} and b.value <> a.value group by a.doc_id, a.start, a.value)"


@query(_pair_sql())
def detect_pair_nearest(spark, sf):
    found = detect.detect(seeded(spark, sf, ("AWS",)), catalog.named("AWS"), vicinity=None)
    return found.select("chunk_id", X.secret_hash("raw").alias("id_hash"), F.sha2("raw_v2", 256).alias("secret_hash"))


@query()
def detect_catalog_all(spark, sf):
    found = detect.enrich(detect.detect(seeded(spark, sf), catalog.load()))
    return found.select("chunk_id", "detector", "verifier_backed", "secret_hash", "redacted", "severity", "line", "start_byte", "end_byte")


# A secret in one of four encodings behind each text, or as it is behind its base64 form; SQL follows from where it stands in what is encoded.
_PLAIN = "concat('key: gh', 'p_', substr({sha}, 1, 36), ' of ', {id}, ' .')"
_ENCODED = {
    "base64": ("to_base64(encode({plain}))", "regexp_replace(base64(encode({plain}, 'UTF-8')), '\\\\s', '')", "4 * {k} // 3", "(4 * {k} + 2) // 3"),
    "hex": ("lower(hex(encode({plain})))", "lower(hex(encode({plain}, 'UTF-8')))", "2 * {k}", "2 * {k}"),
    "percent": ("regexp_replace(hex(encode({plain})), '(..)', '%\\1', 'g')", "regexp_replace(hex(encode({plain}, 'UTF-8')), '(..)', '%$1')", "3 * {k}", "3 * {k}"),
    "unicode-escape": ("regexp_replace(hex(encode({plain})), '(..)', '\\\\u00\\1', 'g')", "regexp_replace(hex(encode({plain}, 'UTF-16BE')), '(....)', '\\\\\\\\u$1')", "6 * {k}", "6 * {k}"),
}


def _plain(duck: bool) -> str:
    cast = "cast(doc_id as varchar)" if duck else "cast(doc_id as string)"
    return _PLAIN.format(sha=f"sha256({cast})" if duck else f"sha2({cast}, 256)", id=cast)


def _encoded_sql() -> str:
    plain, parts = _plain(True), []
    printable = "length(regexp_replace({0}, '[\\x20-\\x7e\\t\\n\\r]', '', 'g')) <= length({0}) - floor(length({0}) * 0.8)"
    for n, (variant, (duck, _, low, high)) in enumerate(_ENCODED.items()):
        k = "strpos({0}, concat('gh', 'p_')) - 1".format("plain")
        whole = f" and {printable.format('decoded')}" if variant in ("percent", "unicode-escape") else ""
        blank = "replace(text, '+', ' ')" if variant == "percent" else "text"
        parts.append(f"""select doc_id as chunk_id, 'GitHub' as detector, sha256(substr(plain, k + 1, 40)) as secret_hash, '{variant}' as decoded_from, cast(null as bigint) as start_byte, cast(strlen(text) + 1 + {low.format(k='k')} as bigint) as source_start,
          cast(strlen(text) + 1 + {high.format(k='(k + 40)')} as bigint) as source_end, cast(1 as bigint) as line, cast(1 + length(text) - length(replace(text, chr(10), '')) as bigint) as source_line
          from (select *, {k} as k, concat({blank}, ' ', plain, ' ') as decoded from (select doc_id, text, {plain} as plain from documents where doc_id % 5 = {n})) where strlen({duck.format(plain='plain')}) > 0{whole}""")
    parts.append(f"""select doc_id, 'GitHub', sha256(substr(plain, k + 1, 40)), null, strlen(text) + 3 + n + k, strlen(text) + 3 + n + k, strlen(text) + 43 + n + k, 1 + length(text) - length(replace(text, chr(10), '')), 1 + length(text) - length(replace(text, chr(10), ''))
      from (select *, strpos(plain, concat('gh', 'p_')) - 1 as k, strlen({_ENCODED['base64'][0].format(plain='plain')}) as n from (select doc_id, text, {plain} as plain from documents where doc_id % 5 = 4))""")
    return " union all ".join(parts)


@query(_encoded_sql())
def scan_encoded(spark, sf):
    plain = _plain(False)
    forms = [spark_form.format(plain=plain) for _, spark_form, _, _ in _ENCODED.values()]
    tail = "case cast(doc_id % 5 as int) " + " ".join(f"when {n} then concat(' ', {f}, ' ')" for n, f in enumerate(forms)) + f" else concat(' ', {forms[0]}, '\t ', {plain}) end"
    chunks = tables.from_documents(table(spark, sf, "documents").withColumn("text", F.concat("text", F.expr(tail))))
    found = scan.enriched(scan.scan(chunks, catalog.named("GitHub")), "base_line")
    return found.select("chunk_id", "detector", "secret_hash", "decoded_from", "start_byte", "source_start", "source_end", "line", "source_line")


def _packed(spark, sf, kinds: dict[int, str]) -> DataFrame:
    """Documents' bytes (path, content) in the archives named by the rest of doc_id by 6; null is the text itself."""

    @F.arrow_udf("binary")
    def pack(kind: pa.Array, data: pa.Array) -> pa.Array:
        def one(kind, body):
            if kind is None or body is None:
                return body
            out = io.BytesIO()
            if kind == "gzip":
                return gzip.compress(body, mtime=0)
            if kind == "tar":
                with tarfile.open(fileobj=out, mode="w") as t:
                    entry = tarfile.TarInfo("in/a.txt")
                    entry.size = len(body)
                    t.addfile(entry, io.BytesIO(body))
                return out.getvalue()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("../a.txt" if kind == "unsafe" else "b.gz" if kind == "nested" else "a.txt", gzip.compress(body, mtime=0) if kind == "nested" else body)
            return out.getvalue()

        return pa.array([one(k, b) for k, b in zip(kind.to_pylist(), data.to_pylist())], pa.binary())

    kind = F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), (F.col("doc_id") % 6).cast("int"))
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("path"), pack(kind, F.encode(F.expr(f"concat(coalesce(text, ''), '\n', {_plain(False)})"), "UTF-8")).alias("content"))


_ARCHIVES = {1: "zip", 2: "gzip", 3: "tar", 4: "nested"}


@query(f"""select cast(doc_id as varchar) as path, case doc_id % 6 when 1 then 'a.txt' when 3 then 'in/a.txt' when 4 then 'b.gz' end as archive_path, 'GitHub' as detector, sha256(substr(plain, strpos(plain, concat('gh', 'p_')), 40)) as secret_hash,
  cast(2 + length(text) - length(replace(text, chr(10), '')) as bigint) as line, cast(strlen(text) + strpos(plain, concat('gh', 'p_')) as bigint) as start_byte from (select doc_id, coalesce(text, '') as text, {_plain(True)} as plain from documents)""")
def scan_archives(spark, sf):
    chunks, _ = scan.split(scan.opened(_packed(spark, sf, _ARCHIVES)))
    found = scan.enriched(scan.scan(chunks, catalog.named("GitHub")))
    return found.select("path", "archive_path", "detector", "secret_hash", "line", "start_byte")


_LIMIT = 4_000


@query(f"""select kind, severity, error, count(*) as failures, min(path) as first_path from (
  select cast(doc_id as varchar) as path, 'archive' as kind, 'policy-skip' as severity, case when doc_id % 6 = 4 then 'path' else 'corrupt-archive' end as error from documents where doc_id % 6 in (1, 4)
  union all select cast(doc_id as varchar), 'source', 'gap', 'too large' from documents where doc_id % 6 = 2
  union all select cast(doc_id as varchar), 'source', 'gap', 'cut' from documents where doc_id % 6 in (0, 3, 5) and strlen(concat(coalesce(text, ''), chr(10), {_plain(True)})) > {_LIMIT}) group by kind, severity, error""")
def scan_coverage(spark, sf):
    files = _packed(spark, sf, {4: "unsafe", 3: "gzip"})
    malformed = F.unhex(F.concat(F.lit("504B0304"), F.hex("content")))
    huge = F.concat("content", F.encode(F.repeat(F.lit(" "), F.lit(2 << 20)), "UTF-8"))
    rest = F.col("path").cast("long") % 6
    files = files.withColumn("content", F.when(rest == 1, malformed).when(rest == 2, huge).otherwise(F.col("content")))
    _, failures = scan.split(scan.opened(files, max_bytes=2 << 20, limit=_LIMIT))
    return failures.groupBy("kind", "severity", F.split("error", ":")[0].alias("error")).agg(F.count("*").alias("failures"), F.min("path").alias("first_path"))


@query()
def detector_catalog(spark, sf):
    rows = [(r.name, r.family, ",".join(r.keywords), len(r.patterns), r.verifier_backed, r.whole_text, r.min_entropy, r.radius) for r in catalog.load()]
    return spark.createDataFrame(rows, "detector string, family string, keywords string, forms int, verifier_backed boolean, whole_text boolean, min_entropy double, radius int")


@query(f"select p_partkey, round({_ENTROPY.format('p_name')}, 9) as entropy, {_ENTROPY.format('p_name')} >= 3.0 as enough from part")
def shannon_entropy(spark, sf):
    e = X.entropy("p_name")
    return table(spark, sf, "part").select("p_partkey", F.round(e, 9).alias("entropy"), (e >= 3.0).alias("enough"))


_CUSTOMER = "concat('customer=', c_name, ' segment=', c_mktsegment, ' note=plain words')"


def _customers(spark, sf):
    return table(spark, sf, "customer").withColumn("plain", F.expr(_CUSTOMER))


@query(f"select c_custkey, {_CUSTOMER} as decoded from customer")
def decode_base64(spark, sf):
    coded = _customers(spark, sf).withColumn("text", F.concat(F.lit("x: "), F.regexp_replace(F.base64(F.encode("plain", "UTF-8")), "\\s", ""), F.lit(" .")))
    return coded.select("c_custkey", D.base64_runs("text").alias("decoded"))


@query(f"select c_custkey, {_CUSTOMER} as decoded from customer")
def decode_hex(spark, sf):
    coded = _customers(spark, sf).withColumn("text", F.concat(F.lit("x: "), F.lower(F.hex(F.encode("plain", "UTF-8"))), F.lit(" .")))
    return coded.select("c_custkey", D.hex_runs("text").alias("decoded"))


@query(f"select c_custkey, {_CUSTOMER} as decoded from customer")
def decode_percent(spark, sf):
    coded = _customers(spark, sf).withColumn("text", F.regexp_replace(F.hex(F.encode("plain", "UTF-8")), "(..)", "%$1"))
    return coded.select("c_custkey", D.percent("text").alias("decoded"))


@query(f"select c_custkey, {_CUSTOMER} as decoded from customer")
def decode_unicode_escapes(spark, sf):
    coded = _customers(spark, sf).withColumn("text", F.regexp_replace(F.hex(F.encode("plain", "UTF-16BE")), "(....)", "\\\\u$1"))
    return coded.select("c_custkey", D.unicode_escapes("text").alias("decoded"))


@query(f"select c_custkey, {_CUSTOMER} as decoded from customer")
def decode_utf16(spark, sf):
    return _customers(spark, sf).select("c_custkey", D.utf16(F.encode("plain", "UTF-16LE")).alias("decoded"))


@query("select variant, count(*) as n from (select 'raw' as variant from customer union all select 'base64' from customer) group by variant")
def explode_variants(spark, sf):
    chunks = _customers(spark, sf).select("c_custkey", F.concat(F.lit("x: "), F.regexp_replace(F.base64(F.encode("plain", "UTF-8")), "\\s", "")).alias("text"))
    return spans.variants(chunks).groupBy("variant").agg(F.count("*").alias("n"))


@query("""select doc_id, n as window_no, n * 900 as window_start, length(substr(text, cast(n * 900 + 1 as bigint), 1000)) as chars, md5(substr(text, cast(n * 900 + 1 as bigint), 1000)) as digest
  from (select doc_id, text, unnest(range(0, cast(greatest(length(text) - 101, 0) // 900 + 1 as bigint))) as n from documents)""")
def window_spans(spark, sf):
    out = spans.windows(table(spark, sf, "documents").select("doc_id", "text"), 1000, 100)
    return out.select("doc_id", F.col("window_no").cast("long").alias("window_no"), "window_start", F.char_length("window_text").cast("long").alias("chars"), F.md5("window_text").alias("digest"))


_HITS = _spans_sql("(select doc_id, translate(text, '%s', '%s') as low from documents)" % (X._UPPER, X._LOWER), "doc_id", "low", "token|from ")  # noqa: SLF001


@query(f"""with e as (select doc_id, greatest("end" - 2 - 200, 0) as low, least("end" - 2 + 1 + 200, length(full_text)) as high from {_HITS}),
 f as (select *, case when max(high) over w is null or low > max(high) over w then 1 else 0 end as fresh from e window w as (partition by doc_id order by low, high rows between unbounded preceding and 1 preceding)),
 i as (select *, sum(fresh) over (partition by doc_id order by low, high rows unbounded preceding) as island from f)
 select doc_id, min(low) as span_start, max(high) as span_end, count(*) as hits from i group by doc_id, island""")
def vicinity_islands(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.char_length("text").alias("size"))
    found = docs.withColumn("h", F.explode(spans.matches(X.ascii_lower("text"), "token|from "))).select("doc_id", "size", (F.col("h")["end"] - 2).alias("hit_end"))
    return spans.vicinity(found, ["doc_id"], radius=200)


@query("""select doc_id, cast(i as bigint) as line, l as line_text from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
  where length(l) - length(replace(l, '|', '')) between 2 and 60""")
def line_gate(spark, sf):
    return spans.lines(table(spark, sf, "documents").select("doc_id", "text"), "|", 2, 60).select("doc_id", "line", "line_text")


def _event_findings(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.col("event_id").alias("seq"), F.col("event_type").alias("detector"), (F.col("event_type") == "purchase").alias("verifier_backed"), (F.col("user_id") % 40).cast("string").alias("raw"),
        F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("location"), (F.col("event_id") % 3).alias("line"), "user_id", "value", "event_type",
    )


_EVENTS = "(select event_id, event_id as seq, event_type as detector, event_type = 'purchase' as verifier_backed, cast(user_id % 40 as varchar) as raw, 'f' || (event_id % 7) as location, event_id % 3 as line, user_id, value, event_type from events)"


@query(f"""with o as (select * from {_EVENTS} qualify row_number() over (partition by detector, raw, location, line order by seq) = 1),
 b as (select *, coalesce(max(cast(verifier_backed as int)) over (partition by raw, location, line order by seq rows between unbounded preceding and 1 preceding), 0) as beaten from o)
 select event_id, detector, raw, location, line from b where verifier_backed or beaten = 0""")
def dedup_findings(spark, sf):
    return pipeline.dedup(_event_findings(spark, sf)).select("event_id", "detector", "raw", "location", "line")


@query("""with f as (select l_orderkey * 10 + l_linenumber as commit_seq, cast(l_partkey % 50 as varchar) as raw, 'p' || (l_suppkey % 9) as path, case when l_returnflag = 'A' then 's3' else 'git' end as source_type from lineitem)
 select commit_seq, raw, path, source_type, cast(n as bigint) as occurrence_count from (select *, count(*) over (partition by raw, path) as n, row_number() over (partition by raw, path order by commit_seq) as r from f where source_type = 'git') where r = 1
 union all select commit_seq, raw, path, source_type, 1 from f where source_type <> 'git'""")
def cross_commit_collapse(spark, sf):
    f = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("commit_seq"), (F.col("l_partkey") % 50).cast("string").alias("raw"), F.concat(F.lit("p"), (F.col("l_suppkey") % 9).cast("string")).alias("path"), F.when(F.col("l_returnflag") == "A", "s3").otherwise("git").alias("source_type"))
    return pipeline.cross_commit(f)


_VALUES = """case p_partkey % 6 when 0 then 'example-placeholder-k' when 1 then 'XXXXXXXXXX' || p_partkey when 2 then md5(p_name) when 3 then 'a-long-redacted-value-' || p_size when 4 then 'changeme' else upper(substr(md5(p_name), 1, 20)) end"""


def _placeholder_sql(raw: str) -> str:
    words = ", ".join(map(_q, pipeline.PLACEHOLDER_WORDS))
    parts = " or ".join(f"contains(lower({raw}), {_q(p)})" for p in pipeline.PLACEHOLDER_PARTS)
    marked = f"coalesce(list_sum(list_transform(list_filter(string_split_regex(lower({raw}), '[^a-z0-9]+'), lambda w: w in ({words})), lambda w: length(w))), 0)"
    return f"({parts} or regexp_matches(lower({raw}), '{pipeline.PLACEHOLDER_RUNS}') or lower({raw}) in ({', '.join(map(_q, pipeline.PLACEHOLDER_EXACT))}) or 2 * {marked} > length(regexp_replace(lower({raw}), '[^a-z0-9]', '', 'g')))"


@query(f"select p_partkey, raw, {_placeholder_sql('raw')} as placeholder from (select p_partkey, {_VALUES} as raw from part)")
def placeholder_filter(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(_VALUES).alias("raw")).withColumn("placeholder", pipeline.is_placeholder())


_ALLOW = [{"reason": "clerks", "detector": "CLICK", "path": "f[0-3]"}, {"reason": "value", "raw": "17"}, {"reason": "pattern", "raw_regex": "^3[0-4]$", "path": "**/f?"}]


@query(f"select event_id, detector, raw, location from {_EVENTS} where not ((lower(detector) = 'click' and regexp_matches(location, '^(?:.*/)?f[0-3]$')) or raw = '17' or (regexp_matches(raw, '^3[0-4]$') and regexp_matches(location, '^(?:.*/)?(?:[^/]+/)*f[^/]$')))")
def allowlist_antijoin(spark, sf):
    f = _event_findings(spark, sf)
    return f.filter(pipeline.allow_condition(_ALLOW, path="location").isNull()).select("event_id", "detector", "raw", "location")


_VERDICTS = "event_id, event_type as detector, case when event_id % 5 = 0 then 'verified' when event_id % 5 = 1 then 'indeterminate' else 'unverified' end as verdict, cast(event_id % 4 as int) as assurance, user_id % 10 = 0 as blast_radius"


@query(f"select 'verified' as kept, count(*) as n from (select {_VERDICTS} from events) where verdict in ('verified', 'indeterminate') union all select 'strict', count(*) from (select {_VERDICTS} from events) where verdict = 'verified' union all select 'provider', count(*) from (select {_VERDICTS} from events) where verdict = 'verified' and assurance = 3 union all select 'blast', count(*) from (select {_VERDICTS} from events) where blast_radius and assurance >= 2")
def verdict_filter(spark, sf):
    f = table(spark, sf, "events").selectExpr(*_split_select(_VERDICTS))
    kept = {"verified": {"only_verified": True}, "strict": {"only_verified": True, "drop_indeterminate": True}, "provider": {"only_provider_confirmed": True}, "blast": {"blast_radius_only": True, "min_assurance": 2}}
    out = None
    for name, options in kept.items():
        one = pipeline.verdict_filter(f, **options).agg(F.count("*").alias("n")).select(F.lit(name).alias("kept"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _split_select(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


_DENSE = "event_id, cast(user_id as varchar) as container, cast(user_id % 20 as varchar) as parent, case when user_id % 3 = 0 then 'csv' else 'txt' end as ext, cast(2 + event_id % 3 as int) as severity_rank"


@query(f"""with f as (select {_DENSE} from events), c as (select *, count(*) over (partition by container) as b, count(*) over (partition by parent) as u, ext = 'csv' as t from f),
 s as (select *, b >= case when t then 2 else 3 end as ib from c), p as (select *, not ib and u >= 5 as ip from s)
 select event_id, case when ib then 'container' when ip then 'parent' end as pii_scope, case when ib then b when ip then u end as pii_count,
 greatest(severity_rank, case when ib and ((t and b >= 5) or b >= 10) then 5 when ib then 4 when ip and ((t and u >= 10) or u >= 20) then 5 when ip then 4 else 0 end) as severity_rank from p""")
def pii_container_density(spark, sf):
    f = table(spark, sf, "events").selectExpr(*_split_select(_DENSE.replace("varchar", "string")))
    return pipeline.pii_density(f).select("event_id", "pii_scope", "pii_count", "severity_rank")


@query("select count(*) as findings, sum(cast(r >= 4 as bigint)) as failing, cast(max(cast(r >= 4 as int)) as int) as exit_code from (select 2 + event_id % 4 as r from events)")
def fail_on_gate(spark, sf):
    f = table(spark, sf, "events").select((F.lit(2) + F.col("event_id") % 4).alias("severity_rank"))
    return pipeline.gate(f, "high")


_COVERAGE = "event_type as kind, case when event_id % 4 = 0 then 'gap' else 'policy-skip' end as severity, cast(user_id as varchar) as source, '' as detector, cast(event_id as varchar) as error"


@query(f"select kind, severity, count(*) as failures, least(count(*), 32) as kept from (select {_COVERAGE} from events) group by kind, severity")
def coverage_rollup(spark, sf):
    f = table(spark, sf, "events").selectExpr(*_split_select(_COVERAGE.replace("varchar", "string")))
    return pipeline.coverage_rollup(f).select("kind", "severity", "failures", F.size("examples").cast("long").alias("kept"))


@query("select sum(cast(event_id % 4 = 0 as bigint)) as gaps, sum(cast(event_id % 4 <> 0 as bigint)) as skips, 2 as exit_code from events")
def coverage_gate(spark, sf):
    return pipeline.coverage_gate(table(spark, sf, "events").selectExpr(*_split_select(_COVERAGE.replace("varchar", "string"))))


@query("select count(*) as chunks, cast(sum(strlen(text)) as bigint) as bytes, (select count(*) from (" + _custom_matches_sql() + ")) as findings from documents")
def scan_stats(spark, sf):
    return pipeline.stats(documents(spark, sf), custom_matches(spark, sf))


@query("select detector, case when max(r) >= 4 then 'error' when max(r) = 3 then 'warning' else 'note' end as level, case when max(r) >= 4 then '9.0' when max(r) = 3 then '5.0' else '2.0' end as security_severity, count(*) as results from (select detector, severity_rank as r from (" + _custom_sql() + ")) group by detector")
def sarif_rules(spark, sf):
    return render.sarif_rules(custom_findings(spark, sf))


@query()
def sarif_results(spark, sf):
    return render.sarif_results(custom_findings(spark, sf))


@query("select '{\"detector\":\"' || detector || '\",\"severity\":\"' || severity || '\",\"path\":\"' || chunk_id || '\",\"line\":' || line || ',\"start_byte\":' || start_byte || ',\"end_byte\":' || end_byte || ',\"redacted\":\"' || redacted || '\",\"secret_hash\":\"' || secret_hash || '\"}' as record from (" + _custom_sql() + ")")
def json_records(spark, sf):
    return render.json_records(custom_findings(spark, sf))


@query("select detector as \"DETECTOR\", severity as \"SEVERITY\", chunk_id || ':' || line as \"LOCATION\", redacted as \"REDACTED\", '' as \"SUPPRESSED\" from (" + _custom_sql() + ")")
def table_records(spark, sf):
    return render.table(custom_findings(spark, sf))


@query("select severity, count(*) as findings, count(distinct chunk_id) as chunks from (" + _custom_sql() + ") group by severity")
def severity_rollup(spark, sf):
    return custom_findings(spark, sf).groupBy("severity").agg(F.count("*").alias("findings"), F.countDistinct("chunk_id").alias("chunks"))


_DIFF = "concat('diff --git a/c.txt b/c.txt', chr(10), '--- a/c.txt', chr(10), '+++ b/dir/', c_mktsegment, '.txt', chr(10), '@@ -1,2 +', c_custkey, ',3 @@', chr(10), ' kept', chr(10), '-gone', chr(10), '+', c_name, chr(10), '+second', chr(10), '@@ -9 +90,2 @@ f', chr(10), '+third')"


@query("select c_custkey as diff_id, 'dir/' || c_mktsegment || '.txt' as path, c_custkey + 1 as line, c_name as content from customer union all select c_custkey, 'dir/' || c_mktsegment || '.txt', c_custkey + 2, 'second' from customer union all select c_custkey, 'dir/' || c_mktsegment || '.txt', 90, 'third' from customer")
def diff_added_lines(spark, sf):
    return diffs.added_lines(table(spark, sf, "customer").select(F.col("c_custkey").alias("diff_id"), F.expr(_DIFF).alias("text")))


_DUMP = "concat('-- dump', chr(10), 'USE shop;', chr(10), 'CREATE TABLE `users` (a int);', chr(10), 'INSERT INTO `users` VALUES (', c_custkey, ');', chr(10), '-- the password is ', c_name, chr(10), 'COPY public.keys (a) FROM stdin;', chr(10), c_mktsegment, chr(10), '\\\\.', chr(10), 'SELECT 1;')"


@query("select c_custkey as dump_id, 'shop' as db, 'users' as \"table\", 4 as line, 'INSERT INTO `users` VALUES (' || c_custkey || ');' as content from customer union all select c_custkey, 'shop', 'users', 5, '-- the password is ' || c_name from customer union all select c_custkey, 'shop', 'keys', 7, c_mktsegment from customer")
def sqldump_rows(spark, sf):
    return diffs.dump_lines(table(spark, sf, "customer").select(F.col("c_custkey").alias("dump_id"), F.expr(_DUMP).alias("text")))


@query("select cast(o_orderkey as varchar) as resource_key, md5(o_orderstatus || o_custkey) as fingerprint from orders where o_orderkey % 10 in (0, 3)")
def incremental_antijoin(spark, sf):
    o = table(spark, sf, "orders")
    now = o.select(F.col("o_orderkey").cast("string").alias("resource_key"), F.md5(F.concat("o_orderstatus", F.col("o_custkey").cast("string"))).alias("fingerprint"), "o_orderkey")
    state = now.filter("o_orderkey % 10 <> 0").withColumn("fingerprint", F.when(F.col("o_orderkey") % 10 == 3, "old").otherwise(F.col("fingerprint")))
    return incremental.changed(now.drop("o_orderkey"), state)


@query("select event_type as kind, sha256(concat_ws(':', count(*), " + ", ".join(f"sum(cast('0x' || substr(sha256(cast(event_id as varchar)), {8 * i + 1}, 8) as bigint))" for i in range(8)) + ")) as fingerprint from events group by event_type")
def resource_fingerprint(spark, sf):
    parts = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("k"))
    return incremental.resource_fingerprint(parts, "kind", "k")


@query("""select n_nationkey as chunk_id, json_object('n_nationkey', cast(n_nationkey as varchar), 'n_name', n_name, 'n_regionkey', cast(n_regionkey as varchar)) as text from nation""")
def rows_as_json(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return tables.from_rows(n, "n_nationkey", "nation").select("chunk_id", "text")


@query("select conv_id || '@' || turn as container, cast(conv_id as varchar) as parent, text from conversations")
def conversation_chunks(spark, sf):
    return tables.from_conversations(table(spark, sf, "conversations")).select("container", "parent", "text")


@query("select event_id, case when s between 200 and 299 then 'accepted' when s = 429 or s >= 500 then 'transient' when s in (401, 403) then 'rejected' else 'ambiguous' end as verdict from (select event_id, [200, 204, 301, 401, 403, 404, 429, 500, 503][cast(event_id % 9 as int) + 1] as s from events)")
def http_verdicts(spark, sf):
    codes = F.array(*map(F.lit, (200, 204, 301, 401, 403, 404, 429, 500, 503)))
    return table(spark, sf, "events").select("event_id", K.http_verdict(F.element_at(codes, (F.col("event_id") % 9 + 1).cast("int"))).alias("verdict"))


_JWT_BODY = "concat('{\"iss\":\"https://id', c_nationkey, '.example.com\",\"sub\":\"', c_custkey, '\",\"exp\":', case when c_custkey % 2 = 0 then '4102444800' else '946684800' end, '}')"
_JWT_HEAD = "concat('{\"alg\":\"', case when c_custkey % 5 = 0 then 'none' else 'HS256' end, '\",\"typ\":\"JWT\"}')"


@query("select c_custkey, case when c_custkey % 5 = 0 then 'none' else 'HS256' end as alg, 'https://id' || c_nationkey || '.example.com' as iss, cast(c_custkey as varchar) as sub, case when c_custkey % 5 = 0 then 5 when c_custkey % 2 = 1 then 2 else 4 end as severity_rank from customer")
def jwt_claims(spark, sf):
    part = lambda e: f"translate(rtrim('=', regexp_replace(base64(encode({e}, 'UTF-8')), '[\\r\\n]', '')), '+/', '-_')"
    t = table(spark, sf, "customer").withColumn("jwt", F.expr(f"concat({part(_JWT_HEAD)}, '.', {part(_JWT_BODY)}, '.sig')"))
    j = TK.jwt("jwt", F.lit(1_700_000_000))
    return t.select("c_custkey", j["alg"].alias("alg"), j["iss"].alias("iss"), j["sub"].alias("sub"), j["severity_rank"].alias("severity_rank"))


@query("select c_custkey, 'postgres' as scheme, 'u' || c_nationkey as \"user\", 'p@' || c_mktsegment as password, 'db.example.com:5432' as host, 'shop' as \"database\" from customer")
def dsn_parts(spark, sf):
    t = table(spark, sf, "customer").withColumn("dsn", F.concat(F.lit("postgres://u"), "c_nationkey", F.lit(":p%40"), "c_mktsegment", F.lit("@db.example.com:5432/shop?x=1")))
    return t.select("c_custkey", TK.dsn("dsn").alias("d")).select("c_custkey", "d.*")


@query("select p_partkey, sha256(p_type || ':' || p_name) as secret, sha256(p_brand) || ':' || p_size as location from part")
def fingerprints(spark, sf):
    f = K.fingerprints("p_type", "p_name", "p_brand", F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", f["secret"].alias("secret"), f["location"].alias("location"))


@query("select p_partkey, 'dir/' || replace(p_type, ' ', '%20') || '/' || replace(replace(p_brand, '#', '%23'), ' ', '%20') as uri from part")
def source_uri(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.uri_path(F.concat_ws("/", F.lit("dir"), "p_type", "p_brand")).alias("uri"))


@query("select o_orderkey, 's3://b' || o_custkey || '/data/' || o_orderkey || '.csv' as container, 's3://b' || o_custkey || '/data' as parent, 'csv' as ext from orders")
def container_keys(spark, sf):
    meta = F.create_map(F.lit("bucket"), F.concat(F.lit("b"), "o_custkey"), F.lit("key"), F.concat(F.lit("data/"), "o_orderkey", F.lit(".csv")))
    return table(spark, sf, "orders").select("o_orderkey", K.container_key(F.lit("s3"), meta).alias("k")).select("o_orderkey", "k.*")


@query()
def redact_text(spark, sf):
    return running.spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", redact.redact("text").alias("text"))


@query()
def markup_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", TK.markup_text("html").alias("text"))


@query(f"select doc_id as chunk_id, 'MailAddress' as entity_of, start - 1 as start, \"end\" - 1 as \"end\" from {_spans_sql('documents', 'doc_id', 'text', _CUSTOM_PATTERNS['MailAddress'])}")
def entity_spans(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = docs.withColumn("s", F.explode(spans.matches("text", load_custom(CUSTOM)[2].patterns[0], 1)))
    return found.select(F.col("doc_id").alias("chunk_id"), F.lit("MailAddress").alias("entity_of"), (F.col("s")["start"] - 1).alias("start"), (F.col("s")["end"] - 1).alias("end"))

_GENERIC = "concat(text, ' api_key=', upper(substr({md}, 1, 10)), substr({sha}, 1, 14), translate(substr({sha}, 20, 14), '0123456789abcdef', 'ghijklmnopqrstuv'), case when doc_id % 7 = 0 then '.js' when doc_id % 11 = 0 then '/a/b' else ' end' end, case when doc_id % 5 = 0 then concat(' sha256-', substr({sha}, 1, 30)) else '' end)"


def _generic_sql() -> str:
    text = _GENERIC.format(md="md5(cast(doc_id as varchar))", sha="sha256(cast(doc_id as varchar))")
    low = f"translate(full_text, '{X._UPPER}', '{X._LOWER}')"  # noqa: SLF001
    first = f"greatest(start - {generic.RADIUS}, 1)"
    near = " or ".join(f"contains(substr({low}, {first}, \"end\" + {generic.RADIUS + len(w)} - {first}), {_q(w)})" for w in generic.KEYWORDS)
    stripped = f"regexp_replace(value, {_q(generic.ALGORITHMS)}, '', 'g')"
    after, before = 'substr(full_text, "end", 8)', f"substr(full_text, greatest(start - {generic.CRYPT_BEFORE}, 1), least(start - 1, {generic.CRYPT_BEFORE}))"
    asset = " or ".join(f"starts_with({after}, {_q(e)})" for e in generic.ASSETS)
    decoded = "hex(try(from_base64(rpad(translate(value, '-_', '+/'), cast(ceil(length(value) / 4) * 4 as int), '='))))"
    readable = f"coalesce((not regexp_matches(value, '[-_]') or not regexp_matches(value, '[+/]')) and length(value) % 4 <> 1 and regexp_matches({decoded}, '^(?:[2-6][0-9A-F]|7[0-9A-E]){{8,}}$'), false)"
    explained = f"""regexp_matches(value, '^[A-Za-z_]*$') or regexp_matches(value, '/.*/') or regexp_matches(lower(value), '^sha(?:256|384|512)-') or (length(value) in ({', '.join(map(str, generic.DIGESTS))}) and regexp_matches(value, '^[0-9A-Fa-f]*$'))
      or regexp_matches({before}, {_q(generic.CRYPT)}) or (ends_with({before}, '$') and starts_with({after}, '$')) or ({stripped} <> value and regexp_matches({stripped}, '^[A-Za-z_]*$')) or (contains(value, '-') and ({asset})) or regexp_matches(value, {_q(generic.MIME)}) or {readable}"""
    return f"select doc_id as chunk_id, sha256(value) as secret_hash, start from {_spans_sql(f'(select doc_id, {text} as text from documents)', 'doc_id', 'text', generic.SHAPE)} where {_ENTROPY.format('value')} >= {generic.MIN_ENTROPY} and ({near}) and not ({explained}) qualify row_number() over (partition by doc_id, value order by start) = 1"


@query(_generic_sql())
def detect_generic_entropy(spark, sf):
    text = _GENERIC.format(md="md5(cast(doc_id as string))", sha="sha2(cast(doc_id as string), 256)")
    found = generic.detect_generic(tables.from_documents(table(spark, sf, "documents").withColumn("text", F.expr(text))))
    return found.select("chunk_id", X.secret_hash("raw").alias("secret_hash"), "start")


@query("""select doc_id, cast(i as bigint) as occurrence, cast(1 + list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * 4 as bigint) as position
  from (select doc_id, s, unnest(range(1, len(s))) as i from (select doc_id, string_split(text, 'tion') as s from documents))""")
def all_occurrences(spark, sf):
    f = table(spark, sf, "documents").select("doc_id", "text", F.lit("tion").alias("raw"))
    return spans.all_occurrences(f).select("doc_id", "occurrence", "position")


# A graph of commits: an order follows its customer's one before, and every seventh also the one of half its number.
_EDGES = """select o_orderkey as "commit", lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as parent from orders
  union all select a.o_orderkey, b.o_orderkey from orders a join orders b on b.o_orderkey = cast(floor(a.o_orderkey / 2) as bigint) where a.o_orderkey % 7 = 0"""


@query(f"""with recursive e as ({_EDGES}), r as (select o_orderkey as k from orders where o_orderkey % 50 = 0 and o_orderkey % 77 <> 0
  union select e.parent from r join e on e."commit" = r.k where e.parent is not null and e.parent % 77 <> 0)
  select k as "commit", cast(row_number() over (order by o_orderdate, k) - 1 as bigint) as commit_seq from r join orders on o_orderkey = k""")
def history_reachable(spark, sf):
    orders = table(spark, sf, "orders")
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    follows = orders.select(F.col("o_orderkey").alias("commit"), F.lag("o_orderkey").over(before).alias("parent"))
    halves = orders.filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("commit"), F.floor(F.col("o_orderkey") / 2).alias("parent"))
    known = orders.select(F.col("o_orderkey").alias("parent"))
    edges = follows.unionByName(halves.join(known, "parent").select("commit", "parent"))
    keys = lambda where: orders.filter(where).select(F.col("o_orderkey").alias("commit"))
    found = history.reachable(edges, keys("o_orderkey % 50 = 0"), keys("o_orderkey % 77 = 0"))
    dated = found.join(orders.select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("when")), "commit")
    return history.oldest_first(dated).select("commit", "commit_seq")


class _Killed(Exception):
    pass


@query("select left(o_orderpriority, 1) as unit, o_orderkey, case left(o_orderpriority, 1) when '1' then 1 when '2' then 2 else cast(left(o_orderpriority, 1) as bigint) end as generation from orders where o_totalprice > 100000")
def resumed_units(spark, sf):
    """A run over the orders by priority that is killed before its third unit is committed, taken up again, then run unchanged."""
    base = f"{running.checkpoint_folder(spark)}/units-{uuid.uuid4().hex}"
    orders = table(spark, sf, "orders").withColumn("unit", F.left("o_orderpriority", F.lit(1)))
    prints = {r["kind"]: r["fingerprint"] for r in incremental.resource_fingerprint(orders.select(F.col("unit").alias("kind"), F.concat_ws(":", "o_orderkey", "o_totalprice").alias("v")), "kind", "v").collect()}
    work = lambda unit: orders.filter(F.col("unit") == unit).filter("o_totalprice > 100000").select("o_orderkey")

    def kill(unit):
        if unit == "3":
            raise _Killed

    run = lambda **more: generations.resume(generations.Generations(spark, f"{base}/state"), prints, work, "scanner", f"{base}/out", **more)
    try:
        run(before_commit=kill)
    except _Killed:
        pass
    second, third = run(), run()
    if second.worked != ("3", "4", "5") or not third.unchanged or third.exit_code != second.exit_code:
        raise RuntimeError("the run wasn't taken up where it stopped")
    state = generations.Generations(spark, f"{base}/state").read()
    return generations.results(spark, f"{base}/out", sorted(prints)).join(F.broadcast(state.select("unit", "generation")), "unit").select("unit", "o_orderkey", "generation")


# An allowlist with an entry a part, of six shapes, and its fit written out.
_ENTRIES = """select p_partkey as entry, case when p_partkey % 6 in (0, 1, 5) then case p_partkey % 4 when 0 then 'CLICK' when 1 then 'view' when 2 then 'Purchase' else 'refund' end end as detector, case when p_partkey % 6 in (1, 2) then cast(p_partkey % 97 as {0}) end as raw,
  case when p_partkey % 6 in (0, 3) then concat('^', cast(p_partkey % 89 as {0}), '$') end as raw_regex, case p_partkey % 6 when 2 then concat('f', cast(p_partkey % 9 as {0})) when 3 then concat('f[0-', cast(p_partkey % 3 as {0}), ']') when 4 then concat('x/g', cast(p_partkey as {0})) when 5 then concat('f', cast(p_partkey % 5 as {0})) end as path from part where p_partkey % 24 <> 5 and p_partkey > 30"""


@query(f"""with f as (select event_id, event_type as detector, cast(user_id % 97 as varchar) as raw, 'd/f' || (event_id % 9) as path from events), e as ({_ENTRIES.format('varchar')})
 select event_id, min(entry) as allowed_by from f left join e on (e.detector is null or lower(e.detector) = lower(f.detector)) and (e.raw is null or e.raw = f.raw) and (e.raw_regex is null or regexp_matches(f.raw, e.raw_regex))
   and (e.path is null or (e.path not like '%/%' and regexp_matches(f.path, '^(?:.*/)?' || e.path || '$')) or e.path = f.path) group by event_id""")
def allowlist_table(spark, sf):
    e = table(spark, sf, "events")
    found = e.select("event_id", F.col("event_type").alias("detector"), (F.col("user_id") % 97).cast("string").alias("raw"), F.concat(F.lit("d/f"), (F.col("event_id") % 9).cast("string")).alias("path"))
    entries = spark.sql(_ENTRIES.format("string").replace("from part", "from {part}"), part=table(spark, sf, "part"))
    return allowlist.allowed(found, entries).select("event_id", "allowed_by")


@query(f"""select reason, count(*) as findings from (select case when {_placeholder_sql('raw')} then 'placeholder' when regexp_matches(raw, '^[0-9a-f]+$') then 'allowlist' else 'kept' end as reason from (select {_VALUES} as raw from part)) group by reason""")
def suppression_counts(spark, sf):
    """What each filter drops, counted on the way to the write of what is kept."""
    values = table(spark, sf, "part").select(F.lit("D").alias("detector"), F.expr(_VALUES).alias("raw"), F.lit("p").alias("path"))
    marked, seen = pipeline.counted(pipeline.suppress(values, [{"raw_regex": "^[0-9a-f]+$"}], show=True))
    marked.filter("suppressed_by is null").write.parquet(f"{running.checkpoint_folder(spark)}/kept-{uuid.uuid4().hex}")
    return pipeline.suppression_counts(spark, seen)


# A name, its parts, a place and a token behind each text; the text's own patterns are left to redact_text.
_PERSON = "concat('Ada', doc_id, ' Lovelace')"
_PEOPLE = f"concat(doc_id, ': ', {_PERSON}, ' of Acme Holdings, Acme, gh', 'p_', substr({{sha}}, 1, 36), ' Ada Lovelace; ')"


@query(f"""select doc_id, replace(replace(replace(replace(replace(replace(replace(t, concat('gh', 'p_', substr({{sha}}, 1, 36)), '[REDACTED:GitHub]'), {_PERSON}, '[PII:PERSON]'), 'Acme Holdings', '[PII:ORG]'), ' Lovelace', '[PII:NAME]'),
  concat('Ada', doc_id), '[PII:UNKNOWN]'), 'Acme', '[PII:UNKNOWN]'), 'Ada', '[PII:NAME]') as text from (select doc_id, concat(text, {_PEOPLE}) as t from documents)""".replace("{sha}", "sha256(cast(doc_id as varchar))"))
def redact_longest_first(spark, sf):
    docs = table(spark, sf, "documents").withColumn("text", F.expr(f"concat(text, {_PEOPLE})".replace("{sha}", "sha2(cast(doc_id as string), 256)")))
    texts = [F.lit(" Lovelace"), F.expr(_PERSON), F.lit("Ada"), F.lit("   "), F.expr("concat('Ada', doc_id)"), F.lit("Acme"), F.lit("Acme Holdings")]
    matches = F.array(*(F.struct(F.lit(k).alias("type"), t.alias("text")) for k, t in zip(("name", "Person", " NAME ", "x", "", None, "org"), texts)))
    found = redact.scrubbed(docs, catalog.named("GitHub")).withColumn("m", matches)
    return found.select("doc_id", redact.replaced("text", "m").alias("text"))


_SOUGHT = ("tion", "the ", "\u00e9", "er", "token = ")


@query("""select chunk_id, raw, cast(i as bigint) as occurrence, cast(n + 1 as bigint) as position, cast(strlen(substr(text, 1, n)) as bigint) as start_byte, cast(1 + n - length(replace(substr(text, 1, n), chr(10), '')) as bigint) as line from (
  select doc_id as chunk_id, text, raw, i, cast(list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * length(raw) as bigint) as n from (select doc_id, text, raw, s, unnest(range(1, len(s))) as i from (
  select doc_id, text, raw, string_split(text, raw) as s from documents, (select unnest(['tion', 'the ', '\u00e9', 'er', 'token = ']) as raw))))""")
def occurrences_by_text(spark, sf):
    docs = documents(spark, sf)
    sought = docs.select("chunk_id", F.explode(F.array(*map(F.lit, _SOUGHT))).alias("raw"))
    return spans.placed(docs, sought)


@query(f"""with lines as (select c_custkey, case l when 2 then 90 else c_custkey + 1 + l end as source_line, l + 1 as line, case l when 0 then c_name when 1 then 'second' else 'third' end as content from customer, range(0, 3) t(l))
 select c_custkey as diff_id, 'r' as raw, 'dir/' || c_mktsegment || '.txt' as path, source_line, cast(row_number() over (partition by c_custkey order by source_line, content, i) as bigint) as occurrence
 from (select *, unnest(range(1, len(string_split(content, 'r')))) as i from lines join customer using (c_custkey))""")
def diff_occurrences(spark, sf):
    added = diffs.added_lines(table(spark, sf, "customer").select(F.col("c_custkey").alias("diff_id"), F.expr(_DIFF).alias("text")))
    chunks, locations = diffs.buffers(added)
    places = spans.placed(chunks, chunks.select("diff_id", F.lit("r").alias("raw")), "diff_id")
    return spans.relocated(places, locations, "diff_id").select("diff_id", "raw", "path", "source_line", "occurrence")


_VERDICT_TABLE = "select sha256('click' || chr(0) || cast(k as varchar) || chr(0)) as verdict_key, k % 2 = 0 as verified, cast(k % 4 as int) as assurance, case when k % 3 = 0 then 'timeout' end as error from range(0, 20) t(k)"


@query(f"select event_id, case when verified then 'verified' when error is not null then 'indeterminate' else 'unverified' end as verdict, coalesce(assurance, 0) as assurance from {_EVENTS} f left join ({_VERDICT_TABLE}) v on v.verdict_key = sha256(f.detector || chr(0) || f.raw || chr(0))")
def verdict_join(spark, sf):
    keys = F.sha2(F.concat_ws("\0", F.lit("click"), F.col("id").cast("string"), F.lit("")), 256)
    known = spark.range(20).select(keys.alias("verdict_key"), (F.col("id") % 2 == 0).alias("verified"), (F.col("id") % 4).cast("int").alias("assurance"), F.when(F.col("id") % 3 == 0, "timeout").alias("error"))
    f = _event_findings(spark, sf).withColumn("raw_v2", F.lit(None).cast("string"))
    return verdicts.resolve(f, known).select("event_id", "verdict", "assurance")


@query(f"select count(*) as candidates from (select distinct detector, raw from {_EVENTS}) where not (detector = 'click' and cast(raw as int) < 20)")
def verdict_candidates(spark, sf):
    keys = F.sha2(F.concat_ws("\0", F.lit("click"), F.col("id").cast("string"), F.lit("")), 256)
    f = _event_findings(spark, sf).withColumn("raw_v2", F.lit(None).cast("string"))
    return verdicts.candidates(f, spark.range(20).select(keys.alias("verdict_key"))).agg(F.count("*").alias("candidates"))


@query("select cast(o_orderkey as varchar) as resource_key, case when o_orderkey % 10 = 3 then 'new' else 'old' end as fingerprint from orders where o_orderkey % 2 = 1 or o_orderkey % 10 = 4")
def state_advance(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("resource_key"), "o_orderkey")
    state = o.filter("o_orderkey % 2 = 1").select("resource_key", F.lit("old").alias("fingerprint"))
    seen = o.filter("o_orderkey % 10 in (3, 4)").select("resource_key", F.when(F.col("o_orderkey") % 10 == 3, "new").otherwise("old").alias("fingerprint"))
    return incremental.next_state(state, seen)


@query("select upper(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g')) as entity, count(*) as n, cast(0.3 as double) as score from part group by 1")
def recogniser_entities(spark, sf):
    f = table(spark, sf, "part").select(F.col("p_type").alias("detector"), F.lit(1).alias("start"), F.lit(5).alias("end"))
    return render.entities(f).groupBy("entity").agg(F.count("*").alias("n"), F.max("score").alias("score"))


@query("select '{\"schema_version\":1,\"trail_id\":\"' || substr(sha256(p_type || '|' || sha256(p_name) || '|2024-01-01T00:00:00Z'), 1, 16) || '\",\"detector\":\"' || p_type || '\",\"secret_hash\":\"' || sha256(p_name) || '\",\"redacted\":\"' || case when length(p_name) > 6 then substr(p_name, 1, 6) || '...' when p_name = '' then '' when contains('***', p_name) then '...' else '***' end || '\",\"at\":\"2024-01-01T00:00:00Z\"}' as line from part")
def audit_trail(spark, sf):
    f = table(spark, sf, "part").select(F.col("p_type").alias("detector"), X.secret_hash("p_name").alias("secret_hash"), X.redacted("p_name").alias("redacted"))
    return render.audit(f, "2024-01-01T00:00:00Z")


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
