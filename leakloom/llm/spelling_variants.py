"""Grouping of spelling variants by Aho-Corasick halves (operator 11).

Two words are near if one inserted, deleted or replaced code point makes one the other. One of a word's two halves then
stands unchanged in each near word, at its beginning or its end. Shards of an automaton hold every word's two halves
("holders"); all words are scanned ("scanners"), each in those shards that can hold a half of a near word: the
lengths of such halves follow from its own length. A match counts if the half begins or ends the word, as it does
its own, if lengths differ by one at most, and if the distance is right.

A half that very many words have would make its shard compare all of them. Such groups, told by the product of their
holders and scanners, aren't compared but cut again: what is left of their words is halved in its turn, under the part
that is common, until groups are small. A group whose holders differ in two code points at most has a bounded
number of words, as words are distinct, and is compared as it is. No pairs are written: a shard gives for each word that
it has scanned the number of near words and the best of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import _shared as S
from leakloom.llm.mixing import small

#: Fixed by the contract: runs of letters, length and number of what counts as a word, the modulus of deletions.
LETTERS, LEAST_LENGTH, LEAST_COUNT, MODULUS = "[A-Za-z\\u00C0-\\u00FF]+", 5, 3, 97
#: Comparisons that a half may cause before it is cut again, and words for each shard of the automaton; a word has about 15 records.
COMPARED, SHARD = 4_096, 1_024


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all whole texts, with the planted deletions of the contract, that are long and frequent enough.

    Null texts have none; a null doc_id counts as the word null; repeated rows count as often as they occur.
    """
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    low = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(low)  # most runs have no capitals
    runs = runs.withColumn("low", low).withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "low").cast("binary")))
    at = (F.col("h") % F.char_length("low")).cast("int")
    cut = F.concat(F.substring("low", F.lit(1), at), F.substring("low", at + 2, F.lit(2147483647)))
    found = runs.select(F.when(F.col("h") % MODULUS == 0, cut).otherwise(F.col("low")).alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _rest() -> Column:
    return F.char_length("word") - F.col("pre") - F.col("post")


def _halves(rows: DataFrame) -> DataFrame:
    """The next records of each record: keys of a half of what is left of a word, for its holder, or those that its scanner may meet."""
    left = _rest()
    entry = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("half"))
    own = F.array(entry("<", F.floor(left / 2)), entry(">", F.ceil(left / 2)))
    near = F.array(*(entry(kind, f((left + d) / 2)) for kind, f in (("<", F.floor), (">", F.ceil)) for d in (-1, 0, 1)))
    near = F.array_distinct(F.filter(near, lambda e: (e["half"] >= 0) & (e["half"] <= left)))
    out = rows.withColumn("e", F.explode(F.when(F.col("holds"), own).otherwise(near)))
    out = out.withColumn("path", F.concat("path", "e.kind"))
    out = out.withColumn("pre", F.col("pre") + F.when(F.col("e.kind") == "<", F.col("e.half")).otherwise(0)).withColumn("post", F.col("post") + F.when(F.col("e.kind") == ">", F.col("e.half")).otherwise(0))
    same = F.concat_ws("\n", "path", F.substring("word", F.lit(1), F.col("pre")), F.substring("word", F.char_length("word") - F.col("post") + 1, F.col("post")))
    return out.withColumn("key", same).drop("e")


def records(vocabulary: DataFrame, compared: int = COMPARED) -> DataFrame:
    """Holders and scanners of all words under keys with few comparisons: (word, n, path, pre, post, holds, key).

    They follow from the words, which must lie fast, by narrow steps; only the numbers by key are shuffled, and the
    keys that are cut again are kept.
    """
    both = F.explode(F.array(F.lit(True), F.lit(False)))
    rows = vocabulary.select("word", "n", F.lit("").alias("path"), F.lit(0).alias("pre"), F.lit(0).alias("post"), both.alias("holds"))
    done = []
    while True:
        rows = _halves(rows)
        n = lambda c: F.sum(F.when(c, 1).otherwise(0))
        keys = rows.groupBy("key").agg(n(F.col("holds")).alias("h"), n(~F.col("holds")).alias("s"), F.max(F.when(F.col("holds"), _rest())).alias("rest"))
        again = S.checkpointed(keys.filter((F.col("h") * F.col("s") > compared) & (F.col("rest") > 2)).select("key"))
        if again.isEmpty():
            return S.union_all([*done, rows])
        again = small(again)
        done.append(rows.join(again, "key", "left_anti"))
        rows = rows.join(again, "key", "left_semi").drop("key")


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one string the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def met_at(holder: str, scanner: str, path: str) -> bool:
    """Whether a path is the one by which a holder's halves meet a near word: at each step the first half, if it can."""
    a, b = holder, scanner
    for kind in path:
        k = len(a) // 2
        first = b.startswith(a[:k])
        if first != (kind == "<"):
            return False
        a, b = (a[k:], b[k:]) if first else (a[:k], b[: len(b) - (len(a) - k)])
    return True


class Halves:
    """A shard of the automaton: the halves of its holders, by key, with the words that have them."""

    def __init__(self, holders: Iterator[tuple[str, int, str, str, int, int]]):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        self._of: dict[str, dict[str, list[tuple[str, int, str]]]] = {}
        for word, n, key, path, pre, post in holders:
            half = word[:pre] if path[-1] == "<" else word[len(word) - post :]
            self._of.setdefault(half, {}).setdefault(key, []).append((word, n, word[pre : len(word) - post]))
        for half in self._of:
            if half:
                self._automaton.add_word(half, half)
        if len(self._automaton):
            self._automaton.make_automaton()

    def near(self, word: str, keys: dict[str, tuple[str, int, int]]) -> Iterator[tuple[str, int]]:
        """The near words under some keys (to path, pre, post) of a scanned word, with their numbers."""
        size = len(word)
        at = {(i - len(half) + 1, i + 1) for i, half in self._automaton.iter(word)} if len(self._automaton) else set()
        for key, (path, pre, post) in keys.items():
            first = path[-1] == "<"
            span = (0, pre) if first else (size - post, size)
            if span[0] < span[1] and span not in at:
                continue
            rest, plain = word[pre : size - post], ">" not in path  # first halves all along: there is no other way to meet
            for other, n, its in self._of.get(word[span[0] : span[1]], {}).get(key, ()):
                if -1 <= len(its) - len(rest) <= 1 and one_apart(rest, its) and (plain or met_at(other, word, path)):
                    yield other, n


_SCANNED = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])


def _scan(rows: pa.Table) -> pa.Table:
    """One shard: its automaton, and what the words that are scanned meet there."""
    holders, scanners = rows.filter(rows["holds"]), rows.filter(pc.invert(rows["holds"]))
    shard = Halves(zip(*(holders[c].to_pylist() for c in ("word", "n", "key", "path", "pre", "post"))))
    asked: dict[str, dict[str, tuple[str, int, int]]] = {}
    for word, key, path, pre, post in zip(*(scanners[c].to_pylist() for c in ("word", "key", "path", "pre", "post"))):
        asked.setdefault(word, {})[key] = (path, pre, post)
    out = []
    for word, keys in asked.items():
        n_near, best = 0, None
        for other, n in shard.near(word, keys):
            n_near += 1
            if best is None or (-n, other) < best:
                best = (-n, other)
        if best:
            out.append({"word": word, "n_near": n_near, "form": best[1], "form_n": -best[0]})
    return pa.Table.from_pylist(out, _SCANNED)


def near_words(vocabulary: DataFrame, compared: int = COMPARED, shard: int = SHARD) -> DataFrame:
    """(word, n_near, form, form_n) from distinct (word, n): for words that have near words how many, and the most frequent of them, the first by code point among equals."""
    rows, shards = records(vocabulary, compared), max(1, -(-vocabulary.count() // shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    found = rows.groupBy("shard").applyInArrow(_scan, "word string, n_near long, form string, form_n long")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form"))).alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def grouped(vocabulary: DataFrame, compared: int = COMPARED, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) from distinct (word, n).

    A word's form is its most frequent near word (the first by code point among equals), if that has at least twice its
    number; ``root`` is where the forms of forms end, found by doubling steps, at most log2 of the longest chain, which
    is at most log2 of the largest number. An empty table gives no rows.
    """
    vocabulary = S.checkpointed(vocabulary)
    near = near_words(vocabulary, compared, shard)
    rows = vocabulary.join(near, "word", "left")
    good = F.col("form_n") >= 2 * F.col("n")
    rows = S.checkpointed(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    steps = rows.filter("form is not null").select("word", F.col("form").alias("to"))
    while True:
        after = steps.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        steps = S.checkpointed(steps.join(after, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")))
        if steps.filter("moved").isEmpty():
            break
        steps = steps.drop("moved")
    roots = steps.select("word", F.col("to").alias("root"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_half_automaton_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents; ``words`` and ``grouped`` say what becomes of nulls and repeated rows."""
    return grouped(words(S.table(spark, sf_dir, "documents")))
