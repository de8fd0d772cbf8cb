"""Spelling variants, multiset fingerprints and the alignment of tokenizers, against brute force and the libraries."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakloom.llm import multiset_fingerprint as M
from leakloom.llm import spelling_variants as V
from leakloom.llm import token_alignment as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n int, key string, fingerprint string, row int, pair int, next string"
WORDS = "the of and to in river stone light garden window summer bread paper silver road music winter letter market morning".split()


def _text(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 60)) * (r.random() < 0.3) + "\n" * (r.random() < 0.05) for _ in range(n))


def _docs(spark, rows):
    """Rows of (doc_id, text) among columns with the names that operators use."""
    return spark.createDataFrame([(d, t, None, None, None, "w", 1, "k", "f", 1, 1, "x") for d, t in rows], SCHEMA)


AWKWARD = [(1, None), (2, ""), (3, "   \n\t"), (None, _text(3)), (None, None), (5, _text(5, 30_000)), (6, _text(6)), (6, _text(6)), (6, _text(7)), (7, _text(6)), (8, "x"), (9, "a😀 <|endoftext|> ▁é'll  " * 5), (10, "ﬁ　 \x00\r\n x ")]


# 11
def _brute_words(rows):
    found = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{low}".encode())
            found[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 97 == 0 else low] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def _brute_groups(words):
    letters = sorted(set("".join(words)))
    out = {}
    for w, n in words.items():
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near = [x for x in edits if x != w and x in words]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        good = best is not None and words[best] >= 2 * n
        out[w] = (best if good else None, n, len(near), words[best] if good else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {(w, form, root(w), n, k, fn) for w, (form, n, k, fn) in out.items()}


def _rows(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


@pytest.mark.parametrize("compared", [V.COMPARED, 4])
def test_variants_against_brute_force(spark, compared):
    r = random.Random(1)
    stems = ["inter" + "".join(r.choice("aeinrst") for _ in range(r.randint(1, 4))) for _ in range(250)] + ["".join(r.choice("abÀé") for _ in range(r.randint(5, 8))) for _ in range(250)]
    rows = [(k, " ".join(r.choice(stems).title() if r.random() < 0.1 else r.choice(stems) for _ in range(120))) for k in range(60)]
    words = _brute_words(rows)
    assert {(x.word, x.n) for x in V.words(_docs(spark, rows)).collect()} == set(words.items()) and len(words) > 300
    found = _rows(V.grouped(V.words(_docs(spark, rows)), compared, shard=50))
    assert len(found) == len(words) and set(found) == _brute_groups(words)
    assert any(x[2] != x[0] and x[1] != x[2] for x in found)  # forms of forms


def test_variants_with_one_common_beginning(spark):
    """A third of all words and more begin alike; halves are cut until little is compared."""
    r = random.Random(2)
    words = {"wonderful" + "".join(r.choice("abcde") for _ in range(9)): r.randint(3, 40) for _ in range(3000)} | {"wonderful" + x + y: 5 for x in "abcde" for y in "abcde"}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    sizes = V.records(table, 64).groupBy("key").agg(F.sum(F.col("holds").cast("int")).alias("h"), F.sum((~F.col("holds")).cast("int")).alias("s"), F.max(F.when(F.col("holds"), F.char_length("word") - F.col("pre") - F.col("post"))).alias("rest"))
    assert sizes.filter("h * s > 64 and rest > 2").isEmpty()
    assert set(_rows(V.grouped(table, 64))) == _brute_groups(words)


def test_variants_of_awkward_tables(spark):
    rows = AWKWARD * 2 + [(20, "l" * 100_000 + " " + "l" * 99_999)] * 3
    words = _brute_words(rows)
    found = {x.word: (x.form, x.n_near) for x in V.grouped(V.words(_docs(spark, rows))).collect()}
    assert set(found) == set(words) and sum(len(w) > 99_000 for w in found) == len([w for w in words if len(w) > 99_000])
    assert V.grouped(V.words(_docs(spark, []))).collect() == []


def test_near_is_one_edit():
    assert V.one_apart("abcde", "abxde") and V.one_apart("abcde", "abcd") and V.one_apart("bcde", "abcde")
    assert not V.one_apart("abcde", "abcde") and not V.one_apart("abcde", "bacde") and not V.one_apart("abc", "abcde")


# 12
def test_fingerprints_are_homomorphic(spark):
    r = random.Random(3)
    parts = ["".join(_text(k, 30).split("\n")) for k in range(12)] + ["", "same", "same"]
    mixed = r.sample(parts, len(parts))
    text = lambda p: F.lit("\n".join(p))
    own = M.fingerprint(M.paragraphs(text(parts)))
    one = lambda p: M.fingerprint(F.array(*map(F.lit, p)))
    row = spark.range(1).select(
        own.alias("own"), M.fingerprint(M.paragraphs(text(mixed))).alias("mixed"), M.fingerprint(M.paragraphs(text([*parts, "new"]))).alias("more"), M.inserted(own, one(["new"])).alias("inserted"),
        M.fingerprint(M.paragraphs(text(parts[3:]))).alias("less"), M.deleted(own, one(parts[:3])).alias("deleted"), M.deleted(own, own).alias("none"), M.fingerprint(M.paragraphs(text(parts[:-1]))).alias("other"),
    ).first()
    assert row.own == row.mixed and row.inserted == row.more and row.deleted == row.less
    assert not any(row.none) and row.own != row.other and len(row.own) == M.EXACT + M.LANES


def test_likeness_against_brute_force(spark):
    """Twice the common units over both, within the error of so many lanes."""
    lines = [[f"{w} {k}" for w in _text(k, 8).split()] for k in range(200)]
    texts = [("\n".join(" ".join(x) for x in lines[:100]), "\n".join(" ".join(x) for x in lines[a : a + 100])) for a in range(0, 101, 10)]
    df = spark.createDataFrame(texts, "a string, b string")
    print_ = lambda c: M.fingerprint(M.paragraphs(F.col(c)))
    units = lambda c: F.flatten(F.transform(M.paragraphs(F.col(c)), M._units))
    for r in df.select(M.likeness(print_("a"), print_("b")).alias("near"), units("a").alias("a"), units("b").alias("b")).collect():
        a, b = collections.Counter(r.a), collections.Counter(r.b)
        exact = 1 - sum((a[k] - b[k]) ** 2 for k in a | b) / (sum(n * n for n in a.values()) + sum(n * n for n in b.values()))
        assert abs(r.near - exact) < 4 * (1 - exact + 0.02) / np.sqrt(M.LANES / 2), (r.near, exact)


def test_edits_against_brute_force(spark):
    rows = AWKWARD + [(20 + k, _text(50 + k)) for k in range(40)]
    distinct = {(d, t or "") for d, t in rows}
    key = lambda d, t: hashlib.sha256(f"{'null' if d is None else d}:{t}".encode()).digest()[:16]
    order = sorted(distinct, key=lambda x: (x[0] is None, -(x[0] or 0), key(*x)))
    want = []
    for k, (d, t) in enumerate(order):
        cut, after = len(t) // 3, order[(k + 1) % len(order)][1]
        edited = t[: len(t) - cut] + after[:cut]
        want += [(d, t, len(t), edited)] * sum((x, y or "") == (d, t) for x, y in rows)
    out = M.edits(_docs(spark, rows))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, r.n_chars, r.edited)) for r in out.collect())
    assert out.filter(F.col("edited_fingerprint") != M.fingerprint(M.paragraphs(F.col("edited")))).isEmpty()
    assert M.edits(_docs(spark, [])).collect() == []
    only = M.edits(_docs(spark, [(1, "abcdef")])).first()
    assert only.edited == "abcdab" and only.next_doc_id == 1


def test_fingerprint_query(spark, tmp_path):
    _docs(spark, AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    out = M.op12_multiset_fingerprint(spark, str(tmp_path)).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    prints = {(r.doc_id, r.n_chars): r.fingerprint for r in out}
    assert prints[6, len(_text(6))] == prints[7, len(_text(6))] and prints[1, 0] == prints[2, 0]
    long = next(r for r in out if r.doc_id == 5)
    assert 0.55 < long.near_edited <= 1 and len(long.edited_sha256) == 64


# 13
@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(T.A))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path(T.B))


def _brute_alignment(text, libraries):
    """Ids of both and groups, by sets of byte offsets; None without tokens."""
    if not text:
        return None
    a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    ta, tb = T.tokenizers(T.A, T.B)
    whole = (" " + text).encode()
    spelt = [[t.bytes_of[i] for i in ids] for t, ids in ((ta, a), (tb, b))]
    if any(b"".join(s) != whole for s in spelt):
        return None
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


def test_alignment_against_brute_force(spark, libraries, tmp_path):
    rows = AWKWARD + [(20 + k, _text(k % 12)) for k in range(30)] + [(70, "naïve  coöperation 東京 " * 3), (71, "tail  "), (72, " "), (73, "<s> </s> <0x41> <unk>")]
    whole = {t: _brute_alignment(t, libraries) for _, t in rows}
    counts = collections.Counter((a[-1], b[-1]) for _, t in rows for a, b in (whole[t] or ((), (), ()))[2])
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = []
    for d, t in rows:
        a, b, groups = whole[t] or ((), (), ())
        form = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        links = [(x[-1], y[-1]) for x, y in groups]
        want.append((d, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(form.encode()).hexdigest() if groups else ""))
    assert sum(x[1] == 0 for x in want) >= 4 and sum(x[1] > 0 for x in want) > 30
    docs = _docs(spark, rows)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for few in (T.FEW_PAIRS, 1):  # pairs that are broadcast, and pairs joined by a shuffle
        assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in T.measured(docs, few=few).collect())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in T.op13_byte_owner_alignment(spark, str(tmp_path)).collect())
    for r in T.aligned(docs).collect():
        i, j, groups = 0, 0, []
        for g in r.groups:
            groups.append((r.a[i : i + g.a], r.b[j : j + g.b]))
            i, j = i + g.a, j + g.b
        known = [whole[t] for d, t in rows if d == r.doc_id]
        assert any((groups == w[2] and r.a == w[0]) if w else not r.a for w in known)
    assert T.measured(_docs(spark, [])).collect() == []


def test_overlaps_are_what_tokens_share():
    a, b = T.owners(np.array([3, 2, 1])), T.owners(np.array([1, 4, 1]))
    assert [x.tolist() for x in T.overlaps(a, b)] == [[0, 0, 1, 2], [0, 1, 1, 2], [1, 2, 2, 1]]
    assert np.flatnonzero(T.changes(a) & T.changes(b)).tolist() == [4, 5]


def test_pieces_are_the_library(libraries):
    texts = [" " + t for _, t in AWKWARD if t] + ["  two  blanks   ", " \n\n a\tb", "  ", " " + "x" * 500 + " y"]
    _, pieces = T.tokenizers(T.A, T.B)
    for _ in range(2):
        assert [x.tolist() for x in pieces.encode(texts)] == libraries[1].encode([t[1:] for t in texts])
