"""Quality rules with a distribution test (operator 9).

Besides fixed base rules, a document's histograms of character classes and of common words are
held against references for its language by Jensen-Shannon distance. The references are exact
totals over all documents. A word is common if it is at least ``COMMON_SHARE`` of its language's
words; such a word has that share in at least one task's rows, so tasks first name candidates and
a second pass counts these everywhere. The references are the only thing sent to the driver: a
language needs ``LANGUAGE_SHARE`` of the documents for its own (others take the pooled one), and
shares of at least COMMON_SHARE are at most 1 / COMMON_SHARE words a language.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import _shared as S

COMMON_SHARE = 0.002
LANGUAGE_SHARE = 0.001
#: Largest distances a document may have; shorter documents than these words skip the test.
CLASS_DISTANCE, CLASS_WORDS = 0.18, 50
WORD_DISTANCE, WORD_WORDS = 0.70, 100
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: References are kept under this language too, for documents of languages without their own.
POOLED = "*"

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_FINE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def _classes() -> np.ndarray:
    """Class of each byte of UTF-8: lower or digit, upper, (free), space, sentence mark, symbol, other ASCII, beyond ASCII, bar or bracket."""
    of = np.full(256, 6)
    of[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
    of[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
    of[list(b"0123456789")] = 0
    of[list(_SPACES)] = 3
    of[list(b".,;:!?'\"()-")] = 4
    of[list(b"#*$%&")] = 5
    of[list(b"|<>")] = 8
    of[128:] = 7
    return of


N_CLASSES = 9
_CLASS_OF = _classes()


def class_counts(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS_OF, np.bincount(np.frombuffer(data, np.uint8), minlength=256), N_CLASSES)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two histograms, 0 for equal shares and 1 for disjoint ones; empty ones are at distance 0."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, parts / 2)))


def repeated_words(words: list[bytes]) -> int:
    """How many words are in a window of three that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = dict(zip(words, range(n)))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * n + ids[1:]
    if n > 1_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def measure(text: str | None) -> tuple[dict, bytes, list[bytes]]:
    """The base counts of a text, its bytes and its words; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, repeats = len(words), repeated_words(words)
    spaces = len(data) - len(data.translate(None, _SPACES))
    row = {"n_words": n, "word_chars": len(text or "") - spaces, "n_symbols": len(data) - len(data.translate(None, _SYMBOLS)), "n_dup_lines": repeated_lines(data), "n_repeat_words": repeats}
    return row | {"base_failed": n < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * n}, data, words


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """By language: class totals, the places of its common words, and their counts with all other words last."""

    def first(batches):
        classes, words, total = defaultdict(lambda: np.zeros(N_CLASSES)), defaultdict(Counter), Counter()
        for part in parts(batches):
            for text, lang in zip(*part):
                data = (text or "").encode("utf-8", "surrogatepass")
                split = data.split()
                for key in (POOLED,) if lang is None else (POOLED, "=" + lang):
                    total[key, "documents"] += 1
                    classes[key] += class_counts(data)
                key = POOLED if lang is None else "=" + lang
                words[key].update(split)
        pooled = Counter()
        for key, counts in words.items():
            pooled.update(counts)
            if key != POOLED:
                yield from _rows(key, counts)
        yield from _rows(POOLED, pooled)
        for key, counts in classes.items():
            yield _batch([(key, "class", str(i).encode(), int(n)) for i, n in enumerate(counts)] + [(key, "documents", b"", total[key, "documents"])])

    def parts(batches):
        for batch in batches:
            for part in S.parts([batch["text"], batch["lang"]]):
                yield [c.to_pylist() for c in part]

    def _rows(key, counts):
        n = sum(counts.values())
        if n:
            yield _batch([(key, "candidate", w, 1) for w, k in counts.items() if k >= COMMON_SHARE * n] + [(key, "words", b"", n)])

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.int64()))], ["lang", "kind", "key", "n"])

    columns = docs.select("text", "lang")
    found = columns.mapInArrow(first, "lang string, kind string, key binary, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    found = S.checkpointed(found)
    sizes = {r["lang"]: r["n"] for r in found.filter("kind = 'documents'").orderBy(F.desc("n"), "lang").limit(int(2 / LANGUAGE_SHARE) + 1).collect()}
    own = [k for k, n in sizes.items() if n >= LANGUAGE_SHARE * sizes.get(POOLED, 0)]
    rows = found.filter(F.col("lang").isin(own) & F.col("kind").isin("class", "words", "candidate")).collect()
    totals = {r["lang"]: r["n"] for r in rows if r["kind"] == "words"}
    candidates = defaultdict(set)
    for r in rows:
        if r["kind"] == "candidate":
            candidates[r["lang"]].add(bytes(r["key"]))
    watched = set().union(*candidates.values())

    def second(batches):
        counts = defaultdict(Counter)
        for part in parts(batches):
            for text, lang in zip(*part):
                counts[POOLED if lang is None else "=" + lang].update((text or "").encode("utf-8", "surrogatepass").split())
        for key, c in counts.items():
            for into in {POOLED, key}:
                if into in candidates and (rows := [(into, "count", w, c[w]) for w in watched & c.keys() if w in candidates[into]]):
                    yield _batch(rows)

    exact = columns.mapInArrow(second, "lang string, kind string, key binary, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).collect() if watched else []
    out = {}
    for lang in own:
        classes = np.zeros(N_CLASSES)
        for r in rows:
            if r["lang"] == lang and r["kind"] == "class":
                classes[int(bytes(r["key"]))] = r["n"]
        common = sorted((bytes(r["key"]), r["n"]) for r in exact if r["lang"] == lang and r["n"] >= COMMON_SHARE * totals[lang])
        counts = np.array([n for _, n in common] + [totals.get(lang, 0) - sum(n for _, n in common)], float)
        out[lang] = classes, {w: i for i, (w, _) in enumerate(common)}, counts
    return out


def judge(docs: DataFrame, into: str, known: dict | None = None) -> DataFrame:
    """Add a struct column ``into`` with the counts, both distances, base_failed and kept.

    Null texts count as empty and fail for their length; a null or rare language takes the pooled
    reference; an empty table gives an empty table. Columns other than text and lang pass through.
    """
    known = references(docs) if known is None else known

    def rows(texts, langs):
        out = []
        for text, lang in zip(texts, langs):
            row, data, words = measure(text)
            classes, places, counts = known.get(POOLED if lang is None else "=" + lang) or known.get(POOLED) or (np.zeros(N_CLASSES), {}, np.zeros(1))
            seen = np.zeros(len(counts))
            for word, n in Counter(words).items():
                seen[places.get(word, -1)] += n
            row |= {"class_distance": jensen_shannon(class_counts(data), classes), "word_distance": jensen_shannon(seen, counts)}
            far = row["n_words"] >= CLASS_WORDS and row["class_distance"] > CLASS_DISTANCE or row["n_words"] >= WORD_WORDS and row["word_distance"] > WORD_DISTANCE
            out.append(row | {"kept": not row["base_failed"] and not far})
        return out

    return docs.withColumn(into, S.text_udf(_FINE, rows, 2)("text", "lang"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    verdict = S.fresh("verdict")
    return judge(docs, verdict).filter(F.col(verdict)["kept"]).drop(verdict)


def op9_distribution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all whole texts; null has no words and fails, repeated rows give repeated results, an empty table gives no rows."""
    judged = judge(S.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "r")
    return judged.select("doc_id", *(f"r.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")))
