"""Near-duplicates by ProbMinHash signatures, banding and exact verification (operator 1).

A document's elements are its distinct runs of five words, each with a weight. An element is a Poisson process of
that rate, whose arrivals fall into random registers; a register keeps its earliest element, and an element stops
as soon as its next arrival is later than every register's (early termination). Two signatures agree in a
register with the probability Jaccard similarity of the weighted sets. ``WEIGHTS`` says what a run weighs: one,
so that the measure is the plain Jaccard similarity of the sets, which is what the query asks for, or as often as
it stands in the text. Bands, registers and the exact check all go by the same weights.

Texts are nodes, so exact copies are one node. Texts that agree in a band meet in a bucket; each is
compared with one of it only, the one that meets most others over all its buckets, exactly, on the
sets of five-word runs. Connected components of these links join what the buckets share. Where a bucket
still holds several components, its texts outside the largest one are compared with all others there that they
are not yet connected to, so that no link within a bucket is lost and no group is paired out that is linked
already. There is no bound on a bucket's pairs beyond which they are compared otherwise: large buckets are more blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import _shared as S
from leakloom.llm.components import components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Texts compared with one text in one group.
GROUP = 1024
#: Texts of a bucket that are held against as many others of it in one group.
BLOCK = 256
#: A pair that is similar enough fails to meet in a bucket, or to agree in as many registers as are asked for, no more often than this.
MISSED = 5e-8
#: What a run weighs: "one", or "count" for as often as it stands in the text.
WEIGHTS = ("one", "count")
_CACHE_WORDS = 150_000
_SLICE = 1 << 17


class _Words(dict):
    """Word to a 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            self[word] = value
        return value


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; neighbouring inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of all runs of five words of a text, of all its words if it has fewer, none if it has none."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x8CB92BA72F3D8DD7) + h[k : len(h) - width + 1 + k]
    return _mixed(out + np.uint64(width))


def weighted(text: str | None, weights: str = "one") -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct runs in ascending order, and their weights."""
    runs, n = np.unique(shingles(text), return_counts=True)
    return runs, n.astype(float) if weights == "count" else np.ones(len(runs))


def similarity_of(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard similarity of two weighted sets, exactly.

    Each shared element adds 1 / (sum over all elements c of the larger of its weights' ratios to the shared
    one's). Ordered by the ratio of their weights, elements fall into those whose first and those whose second
    ratio is the larger, so that running sums give all of these.
    """
    every = np.union1d(x[0], y[0])
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, x[0])], b[np.searchsorted(every, y[0])] = x[1], y[1]
    order = np.argsort(np.divide(a, b, out=np.full(len(a), np.inf), where=b > 0), kind="stable")
    a, b = a[order], b[order]
    from_here = np.cumsum(a[::-1])[::-1]
    before = np.cumsum(b) - b
    both = (a > 0) & (b > 0)
    return float((1 / (from_here[both] / a[both] + before[both] / b[both])).sum())


def _similar(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], similarity: float) -> bool:
    if len(x[0]) == x[1].sum() and len(y[0]) == y[1].sum():  # all weights are one
        shared = len(x[0]) + len(y[0]) - len(np.union1d(x[0], y[0]))
        return shared >= similarity * (len(x[0]) + len(y[0]) - shared)
    return similarity_of(x, y) >= similarity - 1e-12


@lru_cache(maxsize=8)
def least_share(similarity: float) -> float:
    """The share of equal registers that a pair of this similarity falls short of with probability MISSED at most."""
    chance, below = (1 - similarity) ** REGISTERS, 0.0
    for k in range(REGISTERS + 1):
        below += chance
        if below > MISSED:
            return k / REGISTERS
        chance *= (REGISTERS - k) / (k + 1) * similarity / (1 - similarity) if similarity < 1 else 1.0
    return 1.0


def signatures(texts: list, weights: str = "one") -> tuple[np.ndarray, np.ndarray]:
    """The registers of each text (a row each), and how many distinct elements it has."""
    sizes, elements, rates = np.zeros(len(texts), np.int64), [], []
    for i, text in enumerate(texts):
        runs, rate = weighted(text, weights)
        elements.append(runs)
        rates.append(rate)
        sizes[i] = len(runs)
    first = np.full(len(texts) * REGISTERS, np.inf)
    who = np.zeros(len(texts) * REGISTERS, np.uint64)
    if sizes.sum():
        flat, rate, owner = np.concatenate(elements), np.concatenate(rates), np.repeat(np.arange(len(texts)), sizes)
        for at in range(0, len(flat), _SLICE):
            _arrive(flat[at : at + _SLICE], rate[at : at + _SLICE], owner[at : at + _SLICE], first, who)
    return who.reshape(-1, REGISTERS), sizes


def _arrive(element, rate, owner, first, who) -> None:
    """Let the arrivals of some elements into their owners' registers."""
    time, turn = np.zeros(len(element)), 0
    while len(element):
        turn += 1
        draw = _mixed(element + np.uint64(turn * 0xA24BAED4963EE407 % (1 << 64)))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        time = time - np.log(uniform) / rate
        slot = owner * REGISTERS + (_mixed(draw) >> np.uint64(40)).astype(np.int64) % REGISTERS
        np.minimum.at(first, slot, time)
        won = time == first[slot]
        who[slot[won]] = element[won]
        rows = np.unique(owner)
        latest = np.zeros(rows[-1] - rows[0] + 1)
        latest[rows - rows[0]] = first.reshape(-1, REGISTERS)[rows].max(1)
        still = time < latest[owner - rows[0]]
        element, rate, owner, time = element[still], rate[still], owner[still], time[still]


def bands(who: np.ndarray) -> np.ndarray:
    """A key for each band, different from band to band."""
    rows = who.reshape(len(who), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xE7037ED1A0B428DB)
    for k in range(ROWS):
        key = _mixed(key * np.uint64(0x8CB92BA72F3D8DD7) + rows[:, :, k])
    return key.view(np.int64)


def _node() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _banded(docs: DataFrame, weights: str) -> DataFrame:
    """(doc_id, node, keys, marks): a text's band keys, none for a text without words, and a byte of each register."""

    def rows(texts):
        out = []
        for at in range(0, len(texts), 256):
            who, sizes = signatures(texts[at : at + 256], weights)
            marks = (_mixed(who) >> np.uint64(56)).astype(np.uint8)
            out += [{"keys": k if n else [], "marks": m.tobytes()} for k, n, m in zip(bands(who), sizes, marks)]
        return out

    made = docs.select("doc_id", _node().alias("node"), S.text_udf("keys array<long>, marks binary", rows)("text").alias("r"))
    return made.select("doc_id", "node", "r.keys", "r.marks")


def _shared_keys(rows: DataFrame) -> DataFrame:
    """(key, id, band, n): the band keys that several texts have, n being how many.

    Most keys are of one text and end here. Rows meet one row of sizes each, so the join makes no more rows than it
    reads. A key is of one band and holds one of BANDS of all rows at most. Sizes are checkpointed, so that both
    sides come from a shuffle and Spark splits the partition of a large key by itself.
    """
    sizes = S.checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    return rows.join(sizes, "key")


def _likely(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose registers allow the similarity, with both nodes and the number of a's pairs.

    A text may have any number of partners; one with many is broadcast, so that its pairs stay spread.
    """

    def rows(a, b):
        if not a:
            return []
        pairs = [np.frombuffer(b"".join(x), np.uint8).reshape(-1, REGISTERS) for x in (a, b)]
        return [{"v": bool(v)} for v in (pairs[0] == pairs[1]).mean(1) >= least_share(similarity)]

    ends = [texts.select(F.col("id").alias(x), F.col("node").alias(f"{x}_node"), F.col("marks").alias(f"{x}_marks")) for x in "ab"]
    counted = ends[0].join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a")
    marked = S.join_counted(pairs, counted, "a", "n", pairs.count()).join(ends[1], "b")
    return marked.withColumn("v", S.text_udf("v boolean", rows, 2)("a_marks", "b_marks")).filter("v.v").select("a", "b", "a_node", "b_node", "n")


def _verified(docs: DataFrame, pairs: DataFrame, similarity: float, weights: str) -> DataFrame:
    """Of likely pairs those whose texts are similar, as (a, b); each text is read once.

    Texts meet in groups of one a and at most about GROUP of its partners, so that a node with any number
    of partners is spread over many groups.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / GROUP)))
    wanted = salted.select("a", "salt", "b", F.col("b_node").alias("node")).unionByName(salted.select("a", "salt", F.col("a").alias("b"), F.col("a_node").alias("node")).distinct())
    texts = _texts(docs, wanted.select("node").distinct())

    def compare(batches):
        """Groups come one after another, each with its a first."""
        key = own = None
        for batch in batches:
            a_out, b_out = [], []
            for part in S.parts([batch[x] for x in ("a", "salt", "b", "text")]):
                for a, salt, b, text in zip(*(c.to_pylist() for c in part)):
                    other = weighted(text, weights)
                    if (a, salt) != key:
                        assert a == b
                        key, own = (a, salt), other
                        continue
                    if _similar(own, other, similarity):
                        a_out.append(a)
                        b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    rows = wanted.join(texts, "node").select("a", "salt", "b", "text")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b") != F.col("a")).mapInArrow(compare, "a long, b long")


def _mixed_buckets(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(key, band, id, component, outside, n, k) of buckets with several components, outside being all but the largest one."""
    of = found.select(F.col("node").alias("id"), "component")
    level = S.checkpointed(shared.select("key", "band", "id").join(of, "id", "left").withColumn("component", F.coalesce("component", "id")))
    parts = level.groupBy("key", "component").agg(F.count("*").alias("size"))
    sizes = parts.groupBy("key").agg(F.sum("size").alias("n"), F.max(F.struct("size", "component")).alias("main")).withColumn("k", F.col("n") - F.col("main.size")).filter("k > 0")
    return S.join_counted(level, sizes, "key", "n", level.count()).withColumn("outside", F.col("component") != F.col("main.component")).drop("main")


def _late(docs: DataFrame, shared: DataFrame, texts: DataFrame, found: DataFrame, similarity: float, weights: str) -> DataFrame:
    """Links (a, b) between different components that share a bucket.

    ``shared``: (key, band, id) of the buckets with several texts. Blocks of BLOCK texts of a bucket are held against
    each other: first by their registers, which leaves those that may have a partner, then by their
    sets, likeliest partners first, until a text is linked to the other component or has been compared with
    all of it. A pair is looked at in one bucket only, that of the first band that it shares. No pairs are
    emitted, only texts and links. A bucket of n texts, k of them outside its largest component, takes n k comparisons
    of registers, spread over n k / BLOCK^2 groups, for which its texts are written n / BLOCK times.
    """
    inside = _mixed_buckets(shared, found)
    inside = inside.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("rare", F.ceil(F.col("k") / BLOCK))
    inside = S.checkpointed(inside.join(texts.select("id", "node", "keys", "marks"), "id").select("key", F.col("band").cast("int").alias("band"), "id", "component", "outside", "blocks", "rare", "node", "keys", "marks"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = inside.filter("outside").withColumn("i", F.pmod(F.xxhash64("id"), F.col("rare"))).withColumn("j", each("blocks")).withColumn("side", F.lit(0))
    right = inside.withColumn("j", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("i", each("rare")).withColumn("side", F.lit(1))
    columns = ("key", "band", "i", "j", "side", "id", "component", "node", "keys", "marks")
    both = left.select(*columns).unionByName(right.select(*columns))

    def likely(t: pa.Table) -> pa.Table:
        met = np.zeros(t.num_rows, bool)
        for i, at, _ in _partners(t, similarity):
            met[at] = True
            met[i] |= bool(len(at))
        return t.filter(pa.array(met))

    def link(t: pa.Table) -> pa.Table:
        texts, parts, ids = t["text"].to_pylist(), t["component"].to_pylist(), t["id"].to_pylist()
        sets: dict[int, tuple] = {}
        above: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := above.get(c, c)) != c:
                above[c] = c = above.get(up, up)
            return c

        a, b = [], []
        for i, at, share in _partners(t, similarity):
            for j in at[np.argsort(-share, kind="stable")].tolist():
                if top(parts[i]) == top(parts[j]):
                    continue
                x, y = (sets[k] if k in sets else sets.setdefault(k, weighted(texts[k], weights)) for k in (i, j))
                if _similar(x, y, similarity):
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
                    above[top(parts[i])] = top(parts[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    kept = S.checkpointed(both.groupBy("key", "i", "j").applyInArrow(likely, "key long, band int, i long, j long, side int, id long, component long, node binary, keys array<long>, marks binary"))
    whole = _texts(docs, kept.select("node").distinct())
    return kept.join(whole, "node").groupBy("key", "i", "j").applyInArrow(link, "a long, b long").distinct()


def _partners(t: pa.Table, similarity: float):
    """For each row of side 0: its row, the rows of side 1 that it has to be held against, and their share of equal registers."""
    t = t.combine_chunks()
    part, side = np.asarray(t["component"]), np.asarray(t["side"])
    keys = np.asarray(t["keys"].combine_chunks().flatten()).reshape(-1, BANDS)
    marks = np.frombuffer(b"".join(t["marks"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
    right, band = np.flatnonzero(side == 1), t["band"][0].as_py() if t.num_rows else 0
    for i in np.flatnonzero(side == 0):
        at = right[part[right] != part[i]]
        share = (marks[at] == marks[i]).mean(1)
        good = share >= least_share(similarity)
        at, share = at[good], share[good]
        first = ~(keys[at][:, :band] == keys[i][:band]).any(1)  # they share no band before this one
        yield i, at[first], share[first]


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of some nodes, once each."""
    all_ = docs.select(_node().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    return all_.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, weights: str = "one") -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row, and (node, class_id, keeper, least, n_links, copies) of each text.

    A class is a connected component of texts that are alike; its id is its least doc_id, of which
    keeper is the text. Links count the verified links of a text with others; least is a text's least doc_id,
    copies its number of rows. Null texts count as empty; texts without words are alike only if they are equal.
    Rows with a null doc_id take part; a class of only such rows has a null id. An empty table has no classes.
    """
    if weights not in WEIGHTS:
        raise ValueError(f"weights are one of {WEIGHTS}")
    spark = docs.sparkSession
    banded = S.checkpointed(_banded(docs, weights))
    texts = banded.groupBy("node").agg(F.first("keys").alias("keys"), F.first("marks").alias("marks"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    texts = S.checkpointed(texts.withColumn("id", F.monotonically_increasing_id()))
    rows = texts.select("id", F.posexplode("keys").alias("band", "key"))
    met = S.checkpointed(_shared_keys(rows))
    central = met.join(met.groupBy("id").agg(F.sum("n").alias("met")), "id").groupBy("key").agg(F.max(F.struct("met", "id"))["id"].alias("root"), F.count("*").alias("n"))
    shared = S.checkpointed(S.join_counted(met.drop("n"), central, "key", "n", met.count()).select("key", "band", "root", "id"))
    S.release(spark)
    met_root = S.checkpointed(shared.filter("root <> id").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct())
    pairs = S.checkpointed(_likely(met_root, texts, similarity))
    links = S.checkpointed(_verified(docs, pairs, similarity, weights))
    S.release(spark)
    found = S.checkpointed(components(links))
    late = S.checkpointed(_late(docs, shared, texts, found, similarity, weights))
    S.release(spark)
    if not late.isEmpty():
        links = links.unionByName(late)
        found = S.checkpointed(components(links))
    S.release(spark)
    degree = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    named = texts.select("id", "node", "least", "copies").join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id")).join(degree, "id", "left")
    named = S.checkpointed(named)
    heads = named.groupBy("component").agg(F.min("least").alias("class_id"), F.coalesce(F.min_by("node", "least"), F.min("node")).alias("keeper"), F.count("*").alias("n"))
    out = S.join_counted(named, heads, "component", "n", named.count())
    return banded.select("doc_id", "node"), out.select("node", "class_id", "keeper", "least", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies")


def report(docs: DataFrame, similarity: float = SIMILARITY, weights: str = "one") -> DataFrame:
    """doc_id, class_id and n_links for each row of the table."""
    ids, texts = classes(docs, similarity, weights)
    known = S.checkpointed(texts.select("node", "class_id", "n_links", "copies"))
    return S.join_counted(ids, known, "node", "copies", ids.count()).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, weights: str = "one") -> DataFrame:
    """One row of each class, that of the least doc_id, with the columns it came with."""
    _, texts = classes(docs, similarity, weights)
    keys = [S.fresh(x) for x in ("node", "doc", "null")]
    key = lambda node, doc: (node.alias(keys[0]), F.coalesce(doc, F.lit(0)).alias(keys[1]), doc.isNull().alias(keys[2]))
    kept = texts.filter("node = keeper").select(*key(F.col("node"), F.col("least")))
    # The join and what drops repeated rows need the same partitioning, so texts are shuffled once.
    return docs.select("*", *key(_node(), F.col("doc_id"))).join(kept, keys).dropDuplicates(keys).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates among all documents; ``classes`` says what becomes of nulls, empty texts and repeated rows, an empty table gives no rows."""
    return report(S.table(spark, sf_dir, "documents"))
