"""Document fingerprints by a homomorphic multiset hash (operator 12), with DataFrame functions only.

A document is the multiset of its paragraphs (what lies between line feeds). Each paragraph is hashed to a wide
vector, and a document's fingerprint is the sum of its paragraphs' vectors modulo 2^32, so that their order doesn't
matter and a paragraph is put in or taken out by one addition or subtraction (``inserted``, ``deleted``). The vector
has two parts:

* ``EXACT`` lanes of hashes of the paragraph's SHA-256: fingerprints of different multisets differ;
* ``LANES`` lanes for its units: a unit is the whole paragraph, or a run of ``SPAN`` words that begins at a word whose
  hash is a multiple of ``SAMPLE``. It adds one to a lane or takes one from it, both by its hash. The squared
  length of the difference of two fingerprints, over that of both, then estimates the part of their units that isn't
  common: one less that is the likeness (2 common / both, with a standard error of at most 1 / sqrt(LANES / 2)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakloom.llm import _shared as S
from leakloom.llm.mixing import _let

EXACT, LANES = 8, 128
SPAN, SAMPLE = 5, 4
_MODULUS = 1 << 32
#: A character for each lane and sign, of the same length in UTF-8.
_SIGNS = "".join(map(chr, range(0x100, 0x100 + 2 * LANES)))


def paragraphs(text: Column) -> Column:
    """What lies between line feeds; an empty text is one empty paragraph, null is null."""
    return F.split(text, "\n", -1)


def _units(paragraph: Column) -> Column:
    """Hashes of the whole paragraph and of its runs of words, which end at single blanks; runs at its end are shorter."""
    run = lambda w: lambda h, i: F.when(h.bitwiseAND(F.lit(SAMPLE - 1)) == 0, F.xxhash64(h, *(F.get(w, i + k) for k in range(1, SPAN))))
    runs = _let(F.transform(F.split(paragraph, " "), lambda w: F.xxhash64(w)), lambda w: F.filter(F.transform(w, run(w)), lambda u: u.isNotNull()))
    return F.concat(F.array(F.xxhash64(paragraph)), runs)


def _wrapped(x: Column) -> Column:
    """Modulo 2^32, from -2^31 up."""
    return (x + F.lit(_MODULUS // 2)).bitwiseAND(F.lit(_MODULUS - 1)) - F.lit(_MODULUS // 2)


def fingerprint(parts: Column) -> Column:
    """An array of integers: the sum of the vectors of an array of paragraphs. Null for null, all 0 for no paragraph.

    A unit is written as the character of its lane and sign, and a lane is the difference of two characters' numbers.
    """
    zero = F.lit(0).cast("long")
    lane = lambda j: lambda a, d: _wrapped(a + F.xxhash64(d, F.lit(j)).bitwiseAND(F.lit(_MODULUS - 1)))
    exact = _let(F.transform(parts, lambda p: F.sha2(p, 256)), lambda d: F.array(*(F.aggregate(d, zero, lane(j)) for j in range(EXACT))))
    marks = F.array(*map(F.lit, _SIGNS))
    written = F.array_join(F.transform(F.flatten(F.transform(parts, _units)), lambda u: F.get(marks, F.shiftrightunsigned(u, 40).bitwiseAND(F.lit(2 * LANES - 1)).cast("int"))), "")
    rest = lambda s, c: F.octet_length(F.replace(s, c, F.lit(""))).cast("long")
    ups, downs = F.array(*map(F.lit, _SIGNS[:LANES])), F.array(*map(F.lit, _SIGNS[LANES:]))
    wide = _let(written, lambda s: F.zip_with(ups, downs, lambda up, down: F.shiftright(rest(s, down) - rest(s, up), 1)))
    return F.concat(exact, wide)


def inserted(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.zip_with(a, b, lambda x, y: _wrapped(x + y))


def deleted(a: Column, b: Column) -> Column:
    """The fingerprint of the first multiset without the paragraphs of the second."""
    return F.zip_with(a, b, lambda x, y: _wrapped(x - y))


def shown(a: Column) -> Column:
    """A fingerprint in hexadecimal, 8 digits a lane."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(_MODULUS - 1))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated part of two fingerprints' units that they have in common, from 0 to 1; 1 if they are equal."""
    lanes = lambda v: F.slice(v, EXACT + 1, LANES)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    squares = lambda v: F.aggregate(lanes(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    shared = 2 * total(F.zip_with(lanes(a), lanes(b), lambda x, y: x.cast("double") * y))
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(shared, squares(a) + squares(b)))), F.lit(0.0)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``fingerprint`` (an array of integers) of their whole texts; null counts as empty.

    Other columns stay; one of that name is replaced.
    """
    return docs.withColumn("fingerprint", fingerprint(paragraphs(F.coalesce("text", F.lit("")))))


def following(keys: DataFrame, order: list, key: str) -> DataFrame:
    """Each key with the key after it in a total order (``next``), the first after the last.

    Keys are dealt out by range and written to the checkpoint folder with the number of their range; only the first
    key of each range is ever seen together with other ranges' ones.
    """
    part = S.fresh("range")
    dealt = S.checkpointed(keys.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    within = Window.partitionBy(part).orderBy(*order)
    heads = dealt.withColumn("_n", F.row_number().over(within)).filter("_n = 1").select(part, F.col(key).alias("_head"))
    ranges = Window.orderBy(part)
    whole = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("_next", F.coalesce(F.lead("_head").over(ranges), F.first("_head").over(whole))).drop("_head")
    after = F.lead(key).over(within)
    return dealt.withColumn("_after", after).join(F.broadcast(heads), part).withColumn("next", F.coalesce("_after", "_next")).drop("_after", "_next", part)


def edits(docs: DataFrame) -> DataFrame:
    """Each text, its end replaced by the beginning of the next document, and the fingerprints of both and of that document.

    The last third of a text's code points, rounded down, gives way to as many of the next document's first ones, or
    all if it has fewer. Documents follow each other by descending doc_id, null last, then by a digest; the first
    follows the last. Null texts are empty; rows of equal doc_id and text are one document, returned as often as they
    occur; an only document is its own next one. An empty table gives no rows. Other columns are not read.

    Texts are shuffled once and a third of them again; nothing is ordered but (doc_id, digest, length).
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"))
    own = own.withColumn("key", F.unhex(F.substring(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "text"), 256), 1, 32)))
    keys = own.select("doc_id", "key", F.char_length("text").cast("long").alias("n")).distinct()
    chain = following(keys, [F.col("doc_id").desc_nulls_last(), F.col("key")], "key").select("key", "next", F.floor(F.col("n") / 3).alias("cut"))
    asked = chain.select(F.col("next").alias("key"), F.col("key").alias("of"), F.col("cut").alias("wanted"))
    chain = S.checkpointed(chain.select("key", "cut").join(asked, "key"))
    rows = fingerprints(own).join(chain, "key")
    # both sides take the same columns from the texts, so that Spark shuffles them once
    came = rows.select(F.col("of").alias("key"), F.col("doc_id").alias("next_doc_id"), F.substring("text", F.lit(1), F.col("wanted").cast("int")).alias("beginning"), F.col("fingerprint").alias("next_fingerprint"))
    both = rows.drop("of", "wanted").join(came.dropDuplicates(["key"]), "key")
    n = F.char_length("text").cast("long")
    both = both.withColumn("n_chars", n).withColumn("kept", F.substring("text", F.lit(1), (n - F.col("cut")).cast("int"))).withColumn("edited", F.concat("kept", "beginning"))
    return both.withColumn("edited_fingerprint", fingerprint(paragraphs(F.col("edited")))).select("doc_id", "text", "n_chars", "edited", "next_doc_id", "fingerprint", "edited_fingerprint", "next_fingerprint")


def op12_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how like they and the next documents are; ``edits`` says what becomes of nulls and repeated rows."""
    pairs = edits(S.table(spark, sf_dir, "documents"))
    near = lambda c: likeness(F.col("fingerprint"), F.col(c))
    pairs = pairs.withColumn("near_edited", near("edited_fingerprint")).withColumn("near_next", near("next_fingerprint")).withColumn("edited_sha256", F.sha2("edited", 256))
    pairs = pairs.withColumn("fingerprint", shown(F.col("fingerprint"))).withColumn("edited_fingerprint", shown(F.col("edited_fingerprint")))
    return pairs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_doc_id")
