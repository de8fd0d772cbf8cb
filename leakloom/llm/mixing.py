"""Mixing sources to target weights (operator 2), with DataFrame functions only.

Each source's documents fall by hash into blocks of about ``BLOCK_WORDS`` words. A source whose
target is ``w`` times its size and a rest is drawn ``w`` times whole and once more in part, each
time in another permutation of its blocks; the block in which the rest ends is drawn document by
document. The exact numbers of drawn blocks are then divided among the output shards by a binary
tree: each node splits its quotas between its halves by a multivariate hypergeometric draw, source
after source. A shard takes the next blocks of each source's permutation, as many as its quota, so
that shards are disjoint, and orders its documents by hash.

Only what has a row a source, block or shard is ever arranged in order, by range over many tasks;
a hot source is many blocks. Quotas are one array a tree node, with an entry a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakloom.llm import _shared as S

#: Weights of sources in order, repeated; the share of all sizes to take; how often a source may be taken.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK_WORDS = 131_072
BLOCKS_PER_SHARD = 64
#: Tables of at most so many rows are broadcast; they are counted first.
SMALL_ROWS = 200_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(S.WORD)), F.lit(0)).cast("long")


def small(df: DataFrame) -> DataFrame:
    """The table, broadcast if it has been counted to be small."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, source_size): index in code-point order with null last, weight, and target.

    What exceeds ``most`` times a source's size is shared out again by weight until nothing does:
    the uncapped sources then share one level of target per weight, which is found in the order
    of their caps per weight. All targets are 0 if all sizes are.
    """
    ranked = S.global_offsets(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"idx": "one"})
    cycle = F.array(*map(F.lit, weights))
    ranked = ranked.select("source", "source_size", F.col("idx").cast("long").alias("idx"), F.element_at(cycle, (F.col("idx") % len(weights) + 1).cast("int")).cast("double").alias("weight"))
    ranked = S.checkpointed(ranked.withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight")))
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    wanted, weight = share * (whole["words"] or 0), whole["weight"] or 0
    filled = S.global_offsets(ranked, ["level", "idx"], {"capped": "cap", "used": "weight"})
    fits = filled.withColumn("at", (F.lit(wanted) - F.col("capped")) / (F.lit(weight) - F.col("used"))).filter("at <= level")
    level = fits.agg(F.min_by("at", F.struct("level", "idx")).alias("at")).first()["at"]
    reached = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(float(level)) * F.col("weight"))
    return ranked.select("idx", "source", "source_size", F.when(F.lit(wanted > 0), reached).otherwise(0.0).cast("double").alias("target"))


def _let(value: Column, body) -> Column:
    """Bind a value to a name inside an expression, so that it is computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(population: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` out of ``population`` are among the ``marked``, by inversion of one uniform number.

    Terms are summed from the mode upwards and then downwards, relative to the mode's; those
    beyond 12 standard deviations are below the precision of doubles.
    """
    n, q, c = population.cast("double"), marked.cast("double"), drawn.cast("double")
    deviation = F.sqrt(F.greatest(c * q / n * (1 - q / n) * (n - c) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    bounds = F.struct(
        F.floor((c + 1) * (q + 1) / (n + 2)).alias("mode"),
        F.greatest(F.lit(0.0), c - (n - q)).cast("long").alias("least"),
        F.least(q, c).cast("long").alias("most"),
        F.ceil(12 * deviation + 12).alias("reach"),
        n.alias("n"), q.alias("q"), c.alias("c"), uniform.alias("u"),
    )

    def inside(b):
        mode = F.greatest(b["least"], F.least(b["most"], b["mode"]))
        return F.struct(mode.alias("m"), F.greatest(b["least"], mode - b["reach"]).alias("lo"), F.least(b["most"], mode + b["reach"]).alias("hi"), b["n"].alias("n"), b["q"].alias("q"), b["c"].alias("c"), b["u"].alias("u"))

    none = F.expr("array_remove(array(0L), 0L)")

    def walk(b):
        up = F.when(b["hi"] > b["m"], F.sequence(b["m"] + 1, b["hi"])).otherwise(none)
        down = F.when(b["lo"] < b["m"], F.sequence(b["m"] - 1, b["lo"], F.lit(-1))).otherwise(none)
        rise = lambda k: (b["q"] - k + 1) * (b["c"] - k + 1) / (k * (b["n"] - b["q"] - b["c"] + k))
        fall = lambda k: (k + 1) * (b["n"] - b["q"] - b["c"] + k + 1) / ((b["q"] - k) * (b["c"] - k))
        start = lambda total: F.struct(F.lit(1.0).alias("w"), total.cast("double").alias("t"))
        add = lambda ratio: lambda a, k: _let(a["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (a["t"] + w).alias("t")))
        total = F.aggregate(down, start(F.aggregate(up, start(F.lit(1.0)), add(rise))["t"]), add(fall))["t"]

        def pick(mass):
            begin = lambda left, k: F.struct(F.lit(1.0).alias("w"), left.alias("t"), k.alias("k"))
            take = lambda ratio: lambda a, k: _let(a["w"] * ratio(k), lambda w: F.struct(w.alias("w"), F.when(a["t"] < 0, a["t"]).otherwise(a["t"] - w).alias("t"), F.when(a["t"] < 0, a["k"]).otherwise(k).alias("k")))
            upward = F.aggregate(up, begin(mass - 1.0, b["m"]), take(rise))
            return _let(upward, lambda a: F.aggregate(down, begin(a["t"], a["k"]), take(fall))["k"])

        return _let(total * b["u"], pick)

    return F.when((population <= 0) | (marked <= 0) | (drawn <= 0), F.lit(0).cast("long")).when(drawn >= population, marked.cast("long")).otherwise(_let(_let(bounds, inside), walk))


def _uniform(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)


def quotas(draws: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """From (idx, n) exact quotas (idx, shard, first): the place in a source's order where each shard's blocks begin.

    ``shards`` is a power of two; the tree has a level for each doubling.
    """
    node = draws.agg(F.array_sort(F.collect_list(F.struct("idx", F.col("n").cast("long").alias("n")))).alias("parts")).withColumn("node", F.lit(0).cast("long"))
    total = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["n"])
    level, width = 0, shards
    while width > 1:
        node = node.withColumn("all", total(F.col("parts"))).withColumn("half", F.floor(F.col("all") / 2))
        start = F.struct(F.col("all").alias("n"), F.col("half").alias("c"), F.expr("cast(array() as array<struct<idx:bigint,n:bigint>>)").alias("out"))

        at = F.lit(level)

        def split(a, p):
            got = hypergeometric(a["n"], p["n"], a["c"], _uniform(F.lit(seed), at, F.col("node"), p["idx"]))  # noqa: B023
            return _let(got, lambda k: F.struct((a["n"] - p["n"]).alias("n"), (a["c"] - k).alias("c"), F.concat(a["out"], F.array(F.struct(p["idx"].alias("idx"), k.alias("n")))).alias("out")))

        node = node.withColumn("left", F.aggregate("parts", start, split, lambda a: a["out"]))
        right = F.zip_with("parts", "left", lambda p, k: F.struct(p["idx"].alias("idx"), (p["n"] - k["n"]).alias("n")))
        node = S.checkpointed(node.select(F.explode(F.array(F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("parts")), F.struct((2 * F.col("node") + 1).alias("node"), right.alias("parts")))).alias("x")).select("x.node", "x.parts"))
        level, width = level + 1, width // 2
    each = node.select(F.col("node").alias("shard"), F.explode("parts").alias("p")).select("shard", "p.idx", "p.n")
    placed = S.global_offsets(each, ["idx", "shard"], {"first": "n"})
    base = placed.groupBy("idx").agg(F.min("first").alias("base"))
    return placed.join(base, "idx").select("idx", "shard", (F.col("first") - F.col("base")).alias("first"), "n")


class Plan:
    """What each block gives to the mix, for one table of documents."""

    def __init__(self, docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, blocks_per_shard: int = BLOCKS_PER_SHARD, weights=WEIGHTS, share: float = SHARE, most: float = MOST):
        self.seed, self.block_words = seed, block_words
        sized = S.checkpointed(docs.select(F.col("source"), self._key(docs).alias("key"), size_of(docs["text"]).alias("size")))
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        sources = targets(sizes, weights, share, most)
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
        sources = sources.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
        self.sources = S.checkpointed(sources.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))))
        placed = self._placed(sized.select("source", "key", "size"))
        blocks = S.checkpointed(placed.groupBy("idx", "block").agg(F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("rest").alias("rest")))
        turns = F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") + F.when(F.col("rest") > 0, 0).otherwise(-1)))
        drawn = blocks.filter("whole > 0 or rest > 0").withColumn("turn", turns).withColumn("one", F.lit(1)).withColumn("mix", F.xxhash64(F.lit(seed), "idx", "turn", "block"))
        placed_blocks = S.checkpointed(S.global_offsets(drawn, ["idx", "turn", "mix", "block"], {"before": "words", "rank": "one"}))
        turn_base = placed_blocks.groupBy("idx", "turn").agg(F.min("before").alias("turn_base"))
        source_base = placed_blocks.groupBy("idx").agg(F.min("rank").alias("source_base"))
        ordered = placed_blocks.join(small(turn_base), ["idx", "turn"]).join(small(source_base), "idx")
        ordered = ordered.withColumn("before", F.col("before") - F.col("turn_base")).withColumn("rank", F.col("rank") - F.col("source_base"))
        last = F.col("turn") == F.col("whole")
        ordered = ordered.filter(~last | (F.col("before") < F.col("rest"))).withColumn("left", F.when(last & (F.col("before") + F.col("words") > F.col("rest")), F.col("rest") - F.col("before")))
        ordered = S.checkpointed(ordered.select("idx", "block", "turn", "rank", "left"))
        n = ordered.count()
        self.shards = 1 << max(0, (max(1, -(-n // blocks_per_shard)) - 1).bit_length())
        cut = quotas(ordered.groupBy("idx").agg(F.count("*").alias("n")), self.shards, seed).filter("n > 0")
        # Each drawn block lies in the shard whose places hold its rank: shards' first places and ranks, in one order.
        # A shard's run of ranks is spread over buckets of fixed width, so that the look-back never crosses more than one bucket.
        width = 4096
        cut = cut.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("n") - 1) / width))))
        marks = cut.select("idx", F.greatest(F.col("first"), F.col("bucket") * width).alias("rank"), F.lit(0).alias("is_block"), "shard", F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("double").alias("left"), "bucket")
        rows = ordered.select("idx", "rank", F.lit(1).alias("is_block"), F.lit(None).cast("long").alias("shard"), "block", "turn", "left")
        back = Window.partitionBy("idx", "bucket").orderBy("rank", "is_block").rowsBetween(Window.unboundedPreceding, 0)
        dealt = marks.unionByName(rows.withColumn("bucket", F.floor(F.col("rank") / width))).withColumn("shard", F.last("shard", True).over(back)).filter("is_block = 1")
        # The block in which a source's rest ends gives documents up to a key: the last of which half or more still fits.
        ends = ordered.filter("left is not null").select("idx", "block", "left")
        inside = placed.select("idx", "block", "key", "size").join(small(ends), ["idx", "block"])
        so_far = F.sum("size").over(Window.partitionBy("idx", "block").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
        until = inside.withColumn("so_far", so_far).filter("so_far - size / 2 <= left").groupBy("idx", "block").agg(F.max("key").alias("until"))
        draws = F.array_sort(F.collect_list(F.struct("turn", "shard", F.col("left").isNotNull().alias("part"))))
        self.blocks = S.checkpointed(dealt.groupBy("idx", "block").agg(draws.alias("draws")).join(small(until), ["idx", "block"], "left"))

    def _key(self, docs: DataFrame) -> Column:
        """Rows that agree in id and text share a key, and so their fate."""
        return F.xxhash64(F.lit(self.seed), docs["doc_id"], docs["text"])

    def _placed(self, keyed: DataFrame, key: str = "key", source: str = "source", into: dict | None = None) -> DataFrame:
        """Add each row's source index, block and its source's figures."""
        into = into or {x: x for x in ("idx", "whole", "rest", "source_size", "target", "n_blocks", "block")}
        of = S.fresh("source")
        known = self.sources.select(F.col("source").alias(of), *(F.col(x).alias(into[x]) for x in ("idx", "whole", "rest", "source_size", "target", "n_blocks")))
        joined = keyed.join(small(known), F.col(source).eqNullSafe(F.col(of)))
        return joined.withColumn(into["block"], F.pmod(F.xxhash64(F.col(key)), F.col(into["n_blocks"]))).drop(of)

    def drawn(self, docs: DataFrame, into: str) -> DataFrame:
        """Add a struct: size, source_size, target, and shards, one entry for each time the row is taken."""
        key, draws, until = S.fresh("key"), S.fresh("draws"), S.fresh("until")
        names = {x: S.fresh(x) for x in ("idx", "whole", "rest", "source_size", "target", "n_blocks", "block")}
        placed = self._placed(docs.withColumn(key, self._key(docs)), key, "source", names)
        blocks = self.blocks.select(F.col("idx").alias(names["idx"]), F.col("block").alias(names["block"]), F.col("draws").alias(draws), F.col("until").alias(until))
        joined = placed.join(small(blocks), [names["idx"], names["block"]], "left")
        taken = F.filter(draws, lambda d: ~d["part"] | F.coalesce(F.col(key) <= F.col(until), F.lit(False)))
        found = F.struct(size_of(docs["text"]).alias("size"), F.col(names["source_size"]).alias("source_size"), F.col(names["target"]).alias("target"), F.coalesce(F.transform(taken, lambda d: d["shard"]), F.expr("cast(array() as array<bigint>)")).alias("shards"), F.col(key).alias("key"))
        return joined.withColumn(into, found).drop(key, draws, until, *names.values())


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents, each as often as it is drawn, shard after shard in shuffled order.

    The columns are those of the input, whatever they are called. Null texts and texts without
    words have size 0 and are taken as often as their block is. An empty table gives an empty one.
    """
    plan, drawn, shard, turn = Plan(docs, **settings), S.fresh("drawn"), S.fresh("shard"), S.fresh("turn")
    rows = plan.drawn(docs, drawn).select(*(F.col(f"`{c}`") for c in docs.columns), F.posexplode(F.col(drawn)["shards"]).alias(turn, shard), F.xxhash64(F.col(drawn)["key"], F.lit("order")).alias(drawn))
    return rows.repartition(shard).sortWithinPartitions(shard, drawn, turn).drop(shard, turn, drawn)


def amounts(docs: DataFrame, **settings) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words, repeats counted) and its shards."""
    r = Plan(docs, **settings).drawn(docs.select("doc_id", "text", "source"), "r")
    return r.select("doc_id", "r.size", "r.source_size", "r.target", (F.col("r.size") * F.size("r.shards")).cast("long").alias("taken"), F.col("r.shards").alias("shards"))


def op2_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: null texts have size 0, null sources come last, repeated rows are documents of their own; an empty table gives no rows."""
    return amounts(S.table(spark, sf_dir, "documents"))
