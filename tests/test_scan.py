"""The scan as a whole: provenance, coverage, repeats, one pass a text, and hot keys."""

import base64
import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from leakloom.operators import detect, pipeline, redact, scan, spans, verdicts
from leakloom.plans import rules
from leakloom.sources import diffs
from leakloom.streaming import incremental

TOKEN = "gh" + "p_" + "a1B2c3D4e5F6g7H8i9J0a1B2c3D4e5F6g7H8"
RULE = rules.Rule("Token", ("gh" + "p_",), (r"\b(gh" + r"p_[A-Za-z0-9]{36})\b",))
ENCODE = {
    "base64": lambda s: base64.b64encode(s.encode()).decode(), "hex": lambda s: s.encode().hex().upper(), "percent": lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    "unicode-escape": lambda s: "".join(f"\\u{x:04x}" for x in memoryview(s.encode("utf-16-le")).cast("H")),
}


def _texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k long, text string")


def test_repeats_of_catalog_and_custom_rules(spark):
    text = f"x {TOKEN}\n{TOKEN} y\n\n{TOKEN}"
    (row,) = detect.detect(_texts(spark, [text]), [RULE]).collect()
    assert (row["raw"], row["start"], row["line"]) == (TOKEN, 3, 0)
    far = text + "- " * 6000 + TOKEN  # another part of the text: told again, at the same place, and dropped as a copy
    told = detect.detect(_texts(spark, [far]), [RULE])
    assert [(r["start"], r["line"]) for r in told.collect()] == [(3, 0), (3, 0)]
    assert pipeline.dedup(told.withColumn("location", F.lit("f")), order="start").count() == 1
    custom = rules.load_custom(json.dumps([{"name": "Own", "keywords": ["key="], "regex": "key=([a-z]+)[0-9]", "severity": "high"}]))
    rows = detect.detect(_texts(spark, ["key=abc1 key=abc1\nkey=xyz2"]), custom, vicinity=None).collect()
    assert [(r["raw"], r["start"], r["line"]) for r in rows] == [("key=abc1", 1, 0), ("key=abc1", 1, 0), ("key=xyz2", 19, 1)]


def test_place_is_the_first_copy_even_where_no_pattern_fits(spark):
    text = f"pre{TOKEN}\nthen {TOKEN}"
    (row,) = detect.detect(_texts(spark, [text]), [RULE]).collect()
    assert (row["start"], row["start_byte"], row["line"]) == (4, 3, 0)


@pytest.mark.parametrize("variant", list(ENCODE))
def test_encoded_secrets_far_from_window_edges(spark, variant):
    """Runs of 80,000 characters that begin at any offset, the secret in a later window of what is decoded."""
    texts = ["!" * k + " né" * 2 + "\n " * 2 + ENCODE[variant]("x" * 60_000 + " é " + TOKEN + " 😀 " + "y" * 20_000) + " end" for k in range(4)]
    rows = scan.scan(_texts(spark, texts), [RULE]).collect()
    assert sorted(r["k"] for r in rows) == [0, 1, 2, 3]
    for r in rows:
        assert (r["decoded_from"], r["raw"], r["start_byte"], r["line"], r["source_line"]) == (variant, TOKEN, None, None, 2)
        part = texts[r["k"]].encode()[r["source_start"] : r["source_end"]].decode()
        if variant == "base64":  # characters at its ends hold bits of what stands around it
            assert len(part) * 6 >= len(TOKEN) * 8 and texts[r["k"]].encode().index(part.encode()) == r["source_start"]
        else:
            assert part == ENCODE[variant](TOKEN)


def test_raw_wins_and_views_are_merged(spark):
    coded = ENCODE["base64"](f"token {TOKEN} tail")
    both = scan.scan(_texts(spark, [f"{coded} {TOKEN}", f"{coded} {ENCODE['hex']('see ' + TOKEN)} {coded}"]), [RULE]).collect()
    assert {(r["k"], r["decoded_from"]) for r in both} == {(0, None), (1, "base64")} and len(both) == 2
    (raw,) = [r for r in both if r["k"] == 0]
    assert raw["source_start"] == raw["start_byte"] == len(coded) + 1


def test_scan_of_awkward_texts(spark):
    texts = [None, "", "%zz%4", "\\ud800\\ud800 x", "%ff%fe%fd" + "a" * 30, "A" * 33, "=" * 50, "\n" * 5000, ENCODE["base64"]("\x00\x01\x02" * 20)]
    assert scan.scan(_texts(spark, texts), [RULE]).collect() == []
    clash = _texts(spark, [f"a {TOKEN}"] * 2).withColumn("source_id", F.lit(1))
    out = scan.scan(clash, [RULE])
    assert "text" not in out.columns and [r["source_id"] for r in out.collect()] == [1, 1]
    assert scan.scan(_texts(spark, ["x"]).filter("k < 0"), [RULE]).collect() == []


def _zip(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name.replace("__", "/").replace("UP", ".."), body)
    return out.getvalue()


def _tar(name, body):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        entry = tarfile.TarInfo(name)
        entry.size = len(body)
        t.addfile(entry, io.BytesIO(body))
    return out.getvalue()


def test_files_to_chunks_and_coverage(spark, tmp_path):
    text = f"one\ntwo {TOKEN}".encode()
    files = {
        "plain.txt": text, "a.zip": _zip(**{"in__a.txt": text, "UP__b.txt": text}), "b.tgz": gzip.compress(_tar("x/y.txt", text)), "bad.zip": b"PK\3\4rest", "big.txt": b"x" * 5001, "long.txt": text + b" " * 3000,
        "wide.txt": ("﻿" + text.decode()).encode("utf-16-le"), "bin": b"\0\1\2" * 50, "none": b"", "null": None, "odd.txt": b"\xff\xfe\x00\xd8", "latin.txt": b"caf\xe9 " + text,
    }
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "path string, content binary")
    options = scan.Options(rules=(RULE,), max_bytes=5000, limit=2000)
    done = scan.scan_files(df, options, f"{tmp_path}/opened")
    found = {(r["path"], r["archive_path"]): r for r in done.findings.collect()}
    assert set(found) == {("plain.txt", None), ("a.zip", "in/a.txt"), ("b.tgz", "x/y.txt"), ("long.txt", None), ("wide.txt", None), ("latin.txt", None)}
    assert all(r["line"] == 2 and r["raw"] == TOKEN for k, r in found.items() if k[0] != "latin.txt")
    gaps = {(r["path"], r["archive_path"], r["kind"], r["severity"], r["error"]) for r in done.coverage.collect()}
    assert gaps == {("a.zip", "../b.txt", "archive", "policy-skip", "path"), ("bad.zip", None, "archive", "policy-skip", "corrupt-archive"), ("big.txt", None, "source", "gap", "too large: 5001 bytes"), ("long.txt", None, "source", "gap", "cut"), ("null", None, "source", "gap", "no content")}
    assert done.gate.first().asDict() == {"findings": 6, "failing": 6, "gaps": 3, "skips": 2, "exit_code": 2}


def test_malformed_archive_fails_only_when_asked(spark, tmp_path):
    df = spark.createDataFrame([("broken.zip", bytearray(b"PK\3\4"))], "path string, content binary")
    codes = [scan.scan_files(df, scan.Options(rules=(RULE,), fail_on_coverage=c), f"{tmp_path}/{c}").gate.first() for c in ("gap", "any")]
    assert [(c["skips"], c["exit_code"]) for c in codes] == [(1, 0), (1, 2)]


def test_options_choose_and_suppress(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", bytearray(f"{TOKEN} own=abc".encode()))], "path string, content binary")
    own = json.dumps([{"name": "Own", "keywords": ["own="], "regex": "own=[a-z]+", "severity": "low"}])
    run = lambda name, **o: {r["detector"] for r in scan.scan_files(df, scan.Options(rules=(RULE,), **o), f"{tmp_path}/{name}").findings.collect()}
    assert run("a", custom=own) == {"Token", "Own"} and run("b", custom=own, exclude=["Token"]) == {"Own"}
    assert run("c", custom=own, allow=[{"detector": "own"}]) == {"Token"} and run("d", custom=own, allow=[{"detector": "own"}], show_suppressed=True) == {"Token", "Own"}


def test_places_of_many_values_in_one_pass(spark):
    values = [f"v{k:05d}x" for k in range(10_000)]
    text = "é\n".join(values) + " v00003x"
    chunks = spark.createDataFrame([(1, text), (2, None), (3, "aaaa v00001x"), (None, "v00001x")], "chunk_id long, text string")
    rows = [(1, v) for v in values] + [(3, "aa"), (3, "v00001x"), (3, ""), (3, None), (2, "v"), (4, "x"), (1, "v00003x"), (None, "v00001x")]
    out = spans.placed(chunks, spark.createDataFrame(rows, "chunk_id long, raw string")).collect()
    first = [r for r in out if r["chunk_id"] == 1]
    assert len(first) == 10_001 and {r["raw"]: r["occurrence"] for r in first}["v00003x"] == 2
    data = text.encode()
    assert all(data[r["start_byte"] :].startswith(r["raw"].encode()) and r["line"] == 1 + text.count("\n", 0, r["position"] - 1) for r in first[::97])
    assert sorted((r["raw"], r["position"]) for r in out if r["chunk_id"] == 3) == [("aa", 1), ("aa", 3), ("v00001x", 6)]
    assert len(out) == 10_004


def test_places_in_put_together_texts(spark):
    added = spark.createDataFrame([(1, "a.txt", 5, f"x {TOKEN}"), (1, "b.txt", 9, f"{TOKEN} {TOKEN}"), (1, "b.txt", 2, "none")], "diff_id long, path string, line long, content string")
    chunks, locations = diffs.buffers(added)
    places = spans.placed(chunks, chunks.select("diff_id", F.lit(TOKEN).alias("raw")), "diff_id")
    assert sorted((r["path"], r["source_line"], r["occurrence"]) for r in spans.relocated(places, locations, "diff_id").collect()) == [("a.txt", 5, 1), ("b.txt", 9, 2), ("b.txt", 9, 3)]


def test_hot_keys_and_nulls(spark):
    n = 3000
    rows = [(k, None if k % 3 == 0 else "hot" if k % 3 == 1 else f"c{k}", "hot" if k % 2 else None, "txt", 2) for k in range(n)]
    found = spark.createDataFrame(rows, "id long, container string, parent string, ext string, severity_rank int")
    out = {r["id"]: (r["pii_scope"], r["pii_count"]) for r in pipeline.pii_density(found).collect()}
    assert len(out) == n and out[0] == out[1] == ("container", 1000) and out[2] == ("parent", 1500)
    values = spark.createDataFrame([(k, "D", "same" if k % 3 else f"v{k}", None) for k in range(n)], "id long, detector string, raw string, raw_v2 string")
    key = lambda v: values.select(verdicts.cache_key().alias("k"), "raw").filter(F.col("raw") == v).first()["k"]
    known = spark.createDataFrame([(key("same"), True, 3, None), (key("same"), False, 1, "late"), (key("v3"), False, 1, "timeout")], "verdict_key string, verified boolean, assurance int, error string")
    got = {r["id"]: (r["verdict"], r["assurance"]) for r in verdicts.resolve(values, known).collect()}
    assert len(got) == n and got[1] == ("verified", 3) and got[3] == ("indeterminate", 1) and got[6] == ("unverified", 0)
    git = spark.createDataFrame([(1, "git", "a", "p"), (2, "git", "a", "p"), (3, None, "a", "p"), (4, "s3", "a", "p")], "commit_seq long, source_type string, raw string, path string")
    assert sorted((r["commit_seq"], r["occurrence_count"]) for r in pipeline.cross_commit(git).collect()) == [(1, 2), (3, 1), (4, 1)]


def test_fingerprints_of_resources_are_those_of_multisets(spark):
    parts = [("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x"), ("c", "x"), ("d", None), ("e", ""), (None, "x"), ("f", "x"), ("f", "y"), ("f", None)]
    got = {r["k"]: r["fingerprint"] for r in incremental.resource_fingerprint(spark.createDataFrame(parts, "k string, v string"), "k", "v").collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == len(got) - 1 == 6


def test_counts_are_taken_on_the_way_to_the_write(spark, tmp_path):
    rows = [("placeholder",)] * 3 + [("allowlist",), ("odd",), (None,), (None,)]
    marked, seen = pipeline.counted(spark.createDataFrame(rows, "suppressed_by string"))
    marked.filter("suppressed_by is null").write.parquet(f"{tmp_path}/kept")
    assert {r["reason"]: r["findings"] for r in pipeline.suppression_counts(spark, seen).collect()} == {"placeholder": 3, "allowlist": 1, "other": 1, "kept": 2}
    nothing, seen = pipeline.counted(spark.createDataFrame([], "suppressed_by string"))
    nothing.write.parquet(f"{tmp_path}/none")
    assert [tuple(r) for r in pipeline.suppression_counts(spark, seen).collect()] == [("kept", 0)]


def test_longest_matches_go_first(spark):
    text = "山田太郎 of Acme Holdings (Acme), alice@example.com and " + TOKEN + " again " + TOKEN
    matches = [("person", "山田太郎"), ("ORGANIZATION", "Acme Holdings"), ("", "Acme"), ("PERSON", "  "), (None, None), ("x", "nowhere")]
    df = spark.createDataFrame([(1, text, matches), (2, text, None), (3, None, matches), (4, "", matches)], "k long, text string, m array<struct<type:string,text:string>>")
    out = {r["k"]: r["text"] for r in redact.redact_all(df, [RULE], "m").collect()}
    assert out[1] == "[PII:PERSON] of [PII:ORGANIZATION] ([PII:UNKNOWN]), [EMAIL] and [TOKEN] again [TOKEN]"
    assert "山田太郎 of Acme Holdings (Acme)" in out[2] and out[3] is None and out[4] == ""
    pair = rules.Rule("Pair", ("id=",), (r"id=([a-z]{4})\b",), partner=r"\bpw=([a-z]{5})\b")
    both = df.filter("k = 1").select(F.lit("id=abcd pw=efghi, again abcd and efghi").alias("t"), F.lit(f"see {TOKEN}").alias("u"))
    got = redact.scrubbed(redact.scrubbed(both, [RULE, pair], "t"), [RULE, pair], "u").first()
    assert got["t"] == "id=[REDACTED:Pair] pw=[REDACTED:Pair], again [REDACTED:Pair] and [REDACTED:Pair]" and got["u"] == "see [REDACTED:Token]"
