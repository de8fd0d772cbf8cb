import bz2
import gzip
import io
import json
import random
import re
import tarfile
import zipfile

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakloom.functions import decode, findings, text, tokens
from leakloom.functions.regex import to_java, to_python
from leakloom.operators import archives, detect, generic, pipeline, redact, spans
from leakloom.plans import catalog, rules
from leakloom.sinks import render
from leakloom.sources import diffs, history, tables
from leakloom.streaming import incremental

PATTERNS = (r"\b([a-z0-9]{3})\b", r"(?i)to\s*ken[\s:]+(\w+)", r"(?m)^a.$", r"[^\s&\[]+$", r"é\B\w", r"a\z")


@settings(max_examples=150, deadline=None)
@given(st.text("abk é\n\r\x0b12&[]:tokenTOK", max_size=25), st.sampled_from(PATTERNS))
def test_python_dialect(value, pattern):
    theirs = duckdb.execute("select regexp_extract_all(?, ?, 0)", [value, pattern]).fetchone()[0]
    ours = [m[0] for m in re.finditer(to_python(pattern), value, re.A if "i" not in pattern[:4] else 0)]
    assert [x for x in ours if x] == [x for x in theirs if x]


def test_java_dialect(spark):
    values = ["abc é12 x\n", "Token:\x0b ab", "ab\r\nac\n", "a", "x&[", "café1 éa", "toKen: k1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for p in PATTERNS:
        ours = [r[0] for r in df.select(F.regexp_extract_all("v", F.lit(to_java(p)), F.lit(0))).collect()]
        theirs = [duckdb.execute("select regexp_extract_all(?, ?, 0)", [v, p]).fetchone()[0] for v in values]
        assert ours == theirs, p


def test_named_classes_are_refused():
    with pytest.raises(ValueError):
        to_java("[[:alpha:]]")


def test_catalog_is_complete():
    found = catalog.load()
    assert len(found) == 614 and len({r.name for r in found}) == len(found) and list(found) == sorted(found, key=lambda r: [x.name for x in found].index(r.name))
    for r in found:
        assert r.keywords is not None and r.patterns
        for p in (*r.patterns, *r.arms, *((r.partner,) if r.partner else ())):
            re.compile(to_python(p))
        assert all(re.compile(to_python(p)).groups >= max(r.groups or (0,)) for p in r.patterns)
        assert r.family == "REGEX" or "NEAR" not in r.family or r.radius
    with pytest.raises(FileNotFoundError):
        catalog.load("/nowhere/detectors.toml")


def _sample(pattern: str, r: random.Random) -> str:
    """A text that a pattern fits, by its parsed form; look-arounds and anchors are left to chance."""
    from re import _constants as C
    from re import _parser

    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def one(items):
        out = []
        for op, value in items:
            if op is C.LITERAL:
                out.append(chr(value))
            elif op is C.NOT_LITERAL:
                out.append(r.choice([c for c in letters if ord(c) != value]))
            elif op is C.ANY:
                out.append(r.choice(letters))
            elif op is C.IN:
                fits = re.compile("[" + "".join(_class(v) for v in value) + "]").fullmatch
                good = [c for c in letters if fits(c)] or [c for c in map(chr, range(33, 127)) if fits(c)] or [c for c in "\t\n " if fits(c)]
                out.append(r.choice(good))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, body = value
                out += [one(body) for _ in range(low if low or high == 1 else 1)]
            elif op is C.SUBPATTERN:
                out.append(one(value[-1]))
            elif op is C.BRANCH:
                out.append(one(value[1][0]))
            elif op is C.GROUPREF:
                out.append("")
        return "".join(out)

    def _class(v):
        op, value = v
        if op is C.NEGATE:
            return "^"
        if op is C.LITERAL:
            return re.escape(chr(value))
        if op is C.RANGE:
            return f"{re.escape(chr(value[0]))}-{re.escape(chr(value[1]))}"
        return {C.CATEGORY_SPACE: r"\s", C.CATEGORY_NOT_SPACE: r"\S", C.CATEGORY_DIGIT: r"\d", C.CATEGORY_WORD: r"\w", C.CATEGORY_NOT_WORD: r"\W", C.CATEGORY_NOT_DIGIT: r"\D"}[value]

    return one(_parser.parse(to_python(pattern)))


def test_every_detector_finds_a_sample_and_not_what_is_near_it(spark):
    """For each detector a value of its first form in its company is found; the same text without any keyword finds nothing of it."""
    r, rows = random.Random(2), []
    for rule in catalog.load():
        arm = _sample(rule.arms[0].removeprefix("(?i)"), r) if rule.arms else ""
        company = " ".join((*rule.keywords[:1], *rule.context[:1], arm))
        value = _sample(rule.patterns[0], r)
        other = _sample(rule.partner, r) if rule.partner else ""
        if rule.whole_text:
            text = value if not rule.keywords[0] else f"{company}\n{value}\n{other}\n"
        else:
            text = f"x {company}\n{value}\n {other} \n"
        rows.append((rule.name, text))
    chunks = spark.createDataFrame(rows, "name string, text string")
    found = {x["name"] for x in detect.detect(chunks, catalog.load()).filter("name = detector").collect()}
    missed = sorted({n for n, _ in rows} - found)
    assert len(missed) <= 30, missed
    without = chunks.withColumn("text", F.lit("nothing to see here, only plain words in a line"))
    assert detect.detect(without, catalog.load()).count() == 0


def test_detectors_find_all_their_token_forms(spark):
    texts = {
        "BitbucketCloud": "x ATBB" + "a1B2" * 8 + " end", "GitHub": "x github_pat_" + "aB" * 41 + " end", "Buildkite": "buildkite bka_" + "a1B2" * 10 + " end", "NewRelic": "x NRAK-" + "A1B" * 9 + " end",
        "AWSS3PresignedURL": "x https://s3.amazonaws.com/b/k?X-Amz-Algorithm=AWS4-HMAC-SHA256&X-Amz-Signature=ab end", "HardcodedPassword": "a:\n  password: hunter2hunter2\n", "Honeycomb": "honeycomb " + "a1b2" * 8 + " end",
    }
    chunks = spark.createDataFrame(list(texts.items()), "name string, text string")
    found = [(r["name"], r["detector"], r["start"]) for r in detect.detect(chunks, catalog.load()).collect()]
    assert {n for n, d, _ in found if n == d} == set(texts) and len(found) == len(set(found))


def test_spans_are_the_secrets_and_partners_are_others(spark):
    quoted = rules.Rule("Q", ("token",), (r"token\s*=\s*\"([0-9a-f]{8})\"",))
    pair = rules.Rule("P", ("pair",), (r"\b([a-z]{5})\b",), partner=r"\b([a-z]{5})\b", partner_radius=20)
    tagged = rules.Rule("U", ("://",), (r"\b(h://[a-z]*:([a-z]+)@x)",), groups=(2,), partner_group=1)
    body = 'é\ntoken = "0a1b2c3d" pair abcde zzzzz; h://a:bcd@x'
    got = {r["raw"]: r for r in detect.detect(tables.from_text(spark, body), [quoted, pair, tagged], vicinity=None).collect()}
    assert all(body[r["start"] - 1 : r["end"] - 1] == raw and body.encode()[r["start_byte"] : r["end_byte"]].decode() == raw and r["line"] == 1 for raw, r in got.items())
    assert got["0a1b2c3d"]["start"] == body.index("0a1b") + 1 and got["abcde"]["raw_v2"] == "zzzzz" and got["bcd"]["raw_v2"] == "h://a:bcd@x" and "token" not in {k for k, v in got.items() if v["raw_v2"] == k}


def test_entropy_is_per_byte(spark):
    words = ["", "a", "aabb", "éé", "aé", "日本日", "zz9"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.entropy("w").alias("e"), text.entropy("w", True).alias("c")).collect()
    for r in got:
        assert abs(r["e"] - detect.measured_entropy(r["w"])) < 1e-9 and abs(r["c"] - detect.measured_entropy(r["w"], True)) < 1e-9
    assert detect.measured_entropy("éé") == 1.0 and detect.measured_entropy("éé", True) == 0.5


def test_radius_is_in_bytes(spark):
    rule = rules.Rule("R", ("key",), (r"\b([0-9]{6})\b",), context=("word",), radius=20)
    rows = [(1, "key word" + " " * 12 + "123456"), (2, "key word" + "é" * 11 + " 123456"), (3, "key word" + "é" * 5 + " 123456")]
    assert [r["k"] for r in detect.detect(spark.createDataFrame(rows, "k long, text string"), [rule]).orderBy("k").collect()] == [1, 3]


def test_generic_tells_a_value_once(spark):
    value = "Hf83KdjL9qZ8xVn" + "B2Wm7TpRcJyXuAbCdEfGhIjKlMnOp01"
    chunks = tables.from_text(spark, f"api_key={value}\nfallback_token={value}")
    assert [(r["raw"], r["start"]) for r in generic.detect_generic(chunks).collect()] == [(value, 9)]


def test_all_occurrences_in_long_texts(spark):
    texts = [("tion", "é😀tion " * 40_000), ("a\\Eb", "x a\\Eb a\\Eb"), ("aa", "aaaaa"), ("z", "none"), ("", "x"), ("q", None)]
    got = {}
    for r in spans.all_occurrences(spark.createDataFrame(texts, "raw string, text string")).select("raw", "occurrence", "position").collect():
        got.setdefault(r["raw"], []).append((r["occurrence"], r["position"]))
    want = {w: [(k, m.start() + 1) for k, m in enumerate(re.finditer(re.escape(w), t), 1)] for w, t in texts if w and t and w in t}
    assert {w: sorted(v) for w, v in got.items()} == want and len(want["tion"]) == 40_000


def test_custom_rules():
    good = [{"name": "N", "keywords": ["Key"], "regex": "key=(\\w+)"}]
    (r,) = rules.load_custom(json.dumps(good))
    assert (r.severity, r.patterns, r.keywords) == (1, ("key=(\\w+)",), ("key",))
    for bad in ([], [{"name": "N", "regex": "x"}], [{**good[0], "extra": 1}], [{**good[0], "severity": "odd"}]):
        with pytest.raises(ValueError):
            rules.load_custom(json.dumps(bad))
    assert [x.name for x in rules.select([r, *catalog.load()], include=["netrc"])] == ["N", "Netrc"]
    with pytest.raises(ValueError):
        rules.select([r], exclude=["nothing"])


def test_vicinity_limits_where_patterns_are_tried(spark):
    far = "agen" + "ta_ " + "x " * 3000 + "agen" + "ta_" + "a" * 32
    rule = rules.Rule("R", ("keyword",), (r"\b([a-z]{5}[0-9]{5})\b",))
    text_ = "keyword abcde12345 " + "x " * 2000 + "vwxyz12345"
    chunks = tables.from_text(spark, text_)
    assert [r["raw"] for r in detect.detect(chunks, [rule]).collect()] == ["abcde12345"]
    assert detect.detect(chunks, [rule], vicinity=None).count() == 2
    assert far


def test_variants(spark):
    df = spark.createDataFrame([("%70%61ss+word ok",), ("\\u0061\\u0062 tail",), ("%zz",), (None,), ("",)], "t string")
    got = df.select(decode.percent("t").alias("p"), decode.unicode_escapes("t").alias("u"), decode.base64_runs("t").alias("b"), decode.hex_runs("t").alias("h")).collect()
    assert got[0]["p"] == "pass word ok" and got[1]["u"] == "ab tail"
    assert all(r["p"] is None and r["b"] is None and r["h"] is None for r in got[2:])
    data = spark.createDataFrame([("wide text here".encode("utf-16"),), (b"plain bytes",)], "d binary")
    assert [r[0] for r in data.select(decode.utf16("d")).collect()] == ["wide text here", None]


def test_windows_cover_texts(spark):
    for n in (0, 1, 999, 1000, 1001, 1900, 1901, 5000):
        body = "".join(chr(97 + i % 26) for i in range(n))
        got = spans.windows(tables.from_text(spark, body), 1000, 100).orderBy("window_no").collect()
        rebuilt = "".join(r["window_text"][0 if not i else 100 :] for i, r in enumerate(got))
        assert rebuilt == body


def test_all_occurrences(spark):
    df = spark.createDataFrame([("ab.ab.xab", "ab"), ("none", "zz")], "text string, raw string")
    assert [r["position"] for r in spans.all_occurrences(df).orderBy("position").collect()] == [1, 4, 8]


def test_dedup_keeps_what_came_before_a_verifier(spark):
    rows = [(1, "G", False, "r", "f", 1), (2, "V", True, "r", "f", 1), (3, "H", False, "r", "f", 1), (4, "V", True, "r", "f", 1)]
    df = spark.createDataFrame(rows, "seq long, detector string, verifier_backed boolean, raw string, location string, line int")
    assert sorted(r["seq"] for r in pipeline.dedup(df).collect()) == [1, 2]


@pytest.mark.parametrize(("glob", "path", "fits"), [("*.env", "a/b/.env", True), ("src/**/x.py", "src/x.py", True), ("src/**/x.py", "src/a/b/x.py", True), ("src/*.py", "src/a/b.py", False), ("**/test/**", "a/test/b/c", True)])
def test_globs(glob, path, fits):
    assert bool(re.search(pipeline.glob_regex(glob), path)) == fits


def test_allowlist_errors():
    for bad in ([{"reason": "x"}], [{"what": 1}]):
        with pytest.raises(ValueError):
            pipeline.allow_condition(bad)


def test_archives():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("../up.txt", "no")
        inner = io.BytesIO()
        with tarfile.open(fileobj=inner, mode="w") as t:
            info = tarfile.TarInfo("b.txt")
            info.size = 3
            t.addfile(info, io.BytesIO(b"two"))
        z.writestr("c.tar.gz", gzip.compress(inner.getvalue()))
        z.writestr("d.bz2", bz2.compress(b"three"))
    got = {p: (b, e) for p, b, e in archives.entries(buffer.getvalue())}
    assert got["a.txt"] == (b"one", None) and got["c.tar.gz/b.txt"][0] == b"two" and got["../up.txt"] == (None, "unsafe name")
    assert list(archives.entries(b"PK\3\4"))[0][2].startswith("malformed")
    assert list(archives.entries(b"plain")) == [("", b"plain", None)]


def test_archive_explode(spark):
    df = spark.createDataFrame([(1, gzip.compress(b"hello")), (2, b"raw"), (3, None)], "chunk_id long, content binary")
    assert {(r["chunk_id"], bytes(r["content"])) for r in archives.explode(df).collect()} == {(1, b"hello"), (2, b"raw")}


def test_redaction(spark):
    body = "see https://a.b/c?d=1 mail x.y@z.org at 10.1.2.3 in /usr/lib/x.py with 0123456789abcdef0123 and plain"
    (r,) = spark.createDataFrame([(body,)], "t string").select(redact.redact("t")).collect()
    assert r[0] == "see [URL] mail [EMAIL] at [IP] in [PATH] with [TOKEN] and plain"


def test_attributes(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(text.pii_redacted(F.lit("EMAIL_ADDRESS"), F.lit("joe@x.org"))) == "j***@x.org"
    assert get(text.entropy(F.lit("aabb"))) == 1.0 and get(text.entropy(F.lit(""))) == 0.0
    assert get(findings.severity_name(F.lit(5))) == "critical" and get(findings.severity_rank(F.lit("High"))) == 4
    assert get(findings.verdict(F.lit(False), F.lit("e"))) == "indeterminate"
    assert get(findings.blast_radius(F.create_map(F.lit("is_privileged"), F.lit("true"))))
    bound = get(findings.bounded_assurance(F.lit(True), F.lit(3), F.lit(2)))
    assert not bound["verified"] and bound["error"]
    assert get(tokens.pgpass(F.lit("h:5432:db:me:a\\:b")))["password"] == "a:b"
    assert get(tokens.rich_text(F.lit('{"a":[{"text":"x \\"q\\""},{"b":{"text":"y"}}]}'))) == 'x "q" y'
    assert get(text.terminal_safe(F.lit("a\x1bb\nc"))) == "a�b\\nc"


def test_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.txt").write_text("no")
    (tmp_path / "a.env").write_text("token = 1")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    (tmp_path / "c.log").write_text("skip me")
    got = tables.from_files(spark, [str(tmp_path)], exclude=["*.log"]).collect()
    assert [(r["ext"], r["text"]) for r in got] == [("env", "token = 1")]


def test_sarif_and_writers(spark, tmp_path):
    found = detect.enrich(detect.detect(tables.from_text(spark, 'token = "' + "0a" * 20 + '"', "dir x/f.txt"), rules.load_custom('[{"name":"T","keywords":["token"],"regex":"token = \\"([0-9a-f]{40})\\"","severity":"high"}]')))
    log = render.sarif(spark, found)
    assert log["version"] == "2.1.0" and log["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "dir%20x/f.txt"
    assert log["runs"][0]["tool"]["driver"]["rules"] == [{"id": "T", "properties": {"security-severity": "9.0"}}]
    for kind in ("json", "sarif", "table", "parquet"):
        render.write(found, str(tmp_path / kind), kind)
    assert "0a" * 20 not in "".join(p.read_text() for p in (tmp_path / "json").glob("part*"))
    assert render.audit(found, "2024-01-01T00:00:00Z").count() == 1
    with pytest.raises(ValueError):
        render.write(found, str(tmp_path / "x"), "xml")


def test_incremental(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "1")], "resource_key string, fingerprint string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "resource_key string, fingerprint string")
    assert sorted(r[0] for r in incremental.changed(now, state).collect()) == ["b", "c"]
    gap = spark.createDataFrame([("gap",)], "severity string")
    assert incremental.next_state(state, now, gap).count() == 2 and incremental.next_state(state, now).count() == 3


def test_stream_scan_is_exactly_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rule = rules.load_custom('[{"name":"T","keywords":["token"],"regex":"token=(\\\\w+)"}]')
    scan = lambda df: detect.detect(df, rule).select("path", "raw")
    for k in range(2):
        (folder / f"{k}.txt").write_text(f"token=v{k}")
        incremental.stream_scan(incremental.stream_files(spark, str(folder)), scan, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["raw"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["token=v0", "token=v1"]


def test_history_and_diffs(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    run("init", "-q")
    for k in range(2):
        (tmp_path / "f.txt").write_text(f"line\nvalue{k}\n")
        run("add", ".")
        run("commit", "-q", "-m", f"c{k}")
    commits = history.read(spark, str(tmp_path))
    added = diffs.added_lines(commits.withColumnRenamed("commit_seq", "diff_id").withColumnRenamed("patch", "text"))
    assert [(r["path"], r["line"], r["content"]) for r in added.orderBy("diff_id", "line").collect()] == [("f.txt", 1, "line"), ("f.txt", 2, "value0"), ("f.txt", 2, "value1")]
