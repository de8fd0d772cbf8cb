"""Token ids in a content-addressed store (operator 7).

A rolling hash over the last few ids cuts each document's stream into chunks, so that edited copies
share all chunks but those they differ in. A chunk is stored once under the digest of its bytes; a
document is a recipe, the list of its chunks' digests with its place in the whole stream; recipes lie
in ascending doc_id order in shards, whose Merkle roots a manifest keeps, over them one root.

The folder holds Parquet tables, written and read by Spark so that any store will do:
``kind=chunk`` (key, data), ``recipes`` (shard, start, doc_id, n, digests), ``manifest`` (shard,
rows, root). Ids of a chunk are little-endian, of two bytes if all fit, else of four.

What follows from the whole stream of a document without having it in one place, such as its CRC, is
put together from its chunks' values; ``read`` puts together the ids themselves.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import _shared as S
from leakloom.llm.pieces import PieceTable

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Ids in a chunk: the least, the mean distance of cuts after that, the most; ids that a cut depends on.
LEAST, MEAN, MOST, WINDOW = 64, 512, 4096, 8


class LibraryEncoder:
    """Whole texts to ids by the tokenizers library, as its ``encode`` without added special tokens gives them.

    The library encodes each match of the splitting pattern by itself; a worker asks its model once for each
    different match, and puts texts together from the answers. Special tokens that stand in a text are one id
    each, and what is between them is split by itself, as the library does.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word for t in library.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that take blanks or whole words aren't supported")
        self._special = special
        self._cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(special, key=len, reverse=True))) if special else None
        tokenize, form = library.model.tokenize, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        shown = {b: form(chr(b))[0][0] for b in range(128)} | {b: form(chr(b))[0][0][1] for b in range(0x80, 0xC0)} | {0xC0 + k: form(chr(0x40 * k))[0][0][0] for k in range(2, 32)}
        shown |= {0xE0 + k: form(chr(max(0x800, k << 12)))[0][0][0] for k in range(16)} | {0xF0 + k: form(chr(max(0x10000, k << 18)))[0][0][0] for k in range(5)}
        self._pieces = PieceTable(lambda pieces: [[t.id for t in tokenize(p.encode().decode("latin-1").translate(shown))] for p in pieces])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self._cut is None or not any(t in text for text in texts for t in self._special):
            return self._pieces.encode(texts)
        parts = [[p for p in self._cut.split(t) if p] for t in texts]
        plain = iter(self._pieces.encode([p for ps in parts for p in ps if p not in self._special]))
        one = lambda p: np.array([self._special[p]], np.uint32) if p in self._special else next(plain)
        return [np.concatenate([np.zeros(0, np.uint32), *map(one, ps)]) for ps in parts]


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> LibraryEncoder:
    return LibraryEncoder(vocabulary)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream; whether an id ends one depends on the ids shortly before it."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolling = np.zeros(len(ids), np.uint64)
    for k in range(min(WINDOW, len(ids))):
        rolling[k:] += mixed[: len(ids) - k] << np.uint64(k)
    rolling ^= rolling >> np.uint64(32)
    ends, last = [], 0
    for at in (np.flatnonzero(rolling % np.uint64(MEAN) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while len(ids) - last > MOST:
        last += MOST
        ends.append(last)
    return ends + [len(ids)] if last < len(ids) else ends


def packed(ids: np.ndarray) -> bytes:
    """A chunk's bytes: the width of its ids, then the ids."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


_STORED = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digests", pa.list_(pa.binary())), ("data", pa.binary())])


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> None:
    """Encode each whole text, append END_ID and store the ids in a new folder.

    Null texts count as empty and are END_ID alone; repeated rows are repeated streams of shared
    chunks; rows of equal doc_id, null first, follow each other in the order in which they were
    read. Other columns are not read.
    """
    spark = docs.sparkSession

    def chunked(batches):
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
            for at in range(0, len(texts), 256):
                rows, seen = [], set()
                for doc_id, stream in zip(ids[at : at + 256], encoder(vocabulary).encode(texts[at : at + 256])):
                    stream, recipe, start = np.append(stream, np.uint32(END_ID)), [], 0
                    for end in cuts(stream):
                        data = packed(stream[start:end])
                        recipe.append(digest(data))
                        if recipe[-1] not in seen:
                            seen.add(recipe[-1])
                            rows.append(("chunk", recipe[-1], None, None, None, data))
                        start = end
                    rows.append(("recipe", task.to_bytes(4, "big") + row.to_bytes(8, "big"), doc_id, len(stream), recipe, None))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _STORED)], schema=_STORED)

    stored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(chunked, "kind string, key binary, doc_id long, n long, digests array<binary>, data binary")
    stored.dropDuplicates(["kind", "key"]).write.partitionBy("kind").parquet(f"{folder}/store")
    recipes = _part(spark, folder, "recipe").select("key", "doc_id", "n", "digests")
    placed = S.global_offsets(recipes, ["doc_id", "key"], {"start": "n"})
    ordered = placed.repartitionByRange("start").sortWithinPartitions("start").withColumn("shard", F.spark_partition_id())
    ordered.select("shard", F.col("start").cast("long").alias("start"), "doc_id", "n", "digests").write.parquet(f"{folder}/recipes")
    _roots(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def _part(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    schema = "key binary, doc_id long, n long, digests array<binary>, data binary, kind string"
    return spark.read.schema(schema).parquet(f"{folder}/store").filter(F.col("kind") == kind)


def merkle(leaves) -> tuple[int, bytes]:
    """Number and root of a run of leaf hashes; only one hash a level is held."""
    levels: list[bytes | None] = []
    n = 0
    for node in leaves:
        n += 1
        for k in range(len(levels)):
            if levels[k] is None:
                levels[k], node = node, None
                break
            node, levels[k] = hashlib.sha256(b"\1" + levels[k] + node).digest(), None
        if node is not None:
            levels.append(node)
    root = None
    for node in levels:
        if node is not None:
            root = node if root is None else hashlib.sha256(b"\1" + node + root).digest()
    return n, root or hashlib.sha256(b"").digest()


def _leaf(start: int, doc_id: int | None, n: int, digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"\0" + repr((start, doc_id, n)).encode() + b"".join(digests)).digest()


def _roots(recipes: DataFrame) -> DataFrame:
    def run(batches):
        shard, leaves = None, []

        def rows():
            for b in batches:
                yield from zip(*(b[c].to_pylist() for c in ("shard", "start", "doc_id", "n", "digests")))

        from itertools import groupby

        for shard, group in groupby(rows(), key=lambda r: r[0]):
            n, root = merkle(_leaf(*r[1:]) for r in group)
            leaves.append((shard, n, root))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in leaves], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["shard", "rows", "root"])

    return recipes.repartition("shard").sortWithinPartitions("shard", "start").mapInArrow(run, "shard int, rows long, root binary")


def root(spark: SparkSession, folder: str) -> bytes:
    """The root over all shards' roots."""
    return merkle(bytes(r["root"]) for r in spark.read.parquet(f"{folder}/manifest").orderBy("shard").select("root").toLocalIterator())[1]


def _changed(spark: SparkSession, folder: str) -> bool:
    """Whether the recipes don't agree with the manifest."""
    now, manifest = _roots(spark.read.parquet(f"{folder}/recipes")), spark.read.parquet(f"{folder}/manifest")
    both = now.withColumn("side", F.lit(1)).unionByName(manifest.withColumn("side", F.lit(-1)))
    return bool(both.groupBy("shard", "rows", "root").agg(F.sum("side").alias("more")).filter("more <> 0").limit(1).count())


def verify(spark: SparkSession, folder: str) -> bool:
    """Recipes agree with the manifest, chunks with their digests, and no chunk lacks."""
    if _changed(spark, folder):
        return False
    recipes = spark.read.parquet(f"{folder}/recipes")
    chunks = _part(spark, folder, "chunk")
    if chunks.filter(~_chunk_values("data", "key")["valid"]).limit(1).count():
        return False
    return not recipes.select(F.explode("digests").alias("key")).join(chunks.select("key"), "key", "left_anti").limit(1).count()


def _chunk_values(data: str, key: str) -> F.Column:
    """Of each stored chunk: whether it has its digest, its number of ids and the CRC of them as 32-bit integers."""

    def rows(datas, keys):
        out = []
        for d, k in zip(datas, keys):
            ids = unpacked(d)
            out.append({"valid": digest(d) == k, "n": len(ids), "crc": zlib.crc32(ids.tobytes())})
        return out

    return S.text_udf("valid boolean, n long, crc long", rows, 2)(data, key)


_POLYNOMIAL = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo CRC-32's, in its bit order, where the highest bit is the constant term."""
    out, a = np.zeros_like(a), a.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(b >> np.uint64(bit) & np.uint64(1), a, np.uint64(0))
        a = (a >> np.uint64(1)) ^ np.where(a & np.uint64(1), _POLYNOMIAL, np.uint64(0))
    return out


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What CRCs give to that of a text in which so many bytes follow; the text's is the exclusive or of all parts'."""
    out, zeros = crc.astype(np.uint64), zeros.astype(np.int64)
    power = np.full(1, 1 << 23, np.uint64)  # x^8
    while zeros.any():
        odd = (zeros & 1).astype(bool)
        if odd.any():
            out[odd] = _times(out[odd], np.broadcast_to(power, odd.sum()).copy())
        power, zeros = _times(power, power), zeros >> 1
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n and ids (little-endian, 32 bits) of each document, put together from its chunks."""
    chunks = _part(spark, folder, "chunk").select("key", "data")

    def rows(parts):
        return [{"v": b"".join(unpacked(d).tobytes() for d in p)} for p in parts]

    placed = spark.read.parquet(f"{folder}/recipes").select("start", "doc_id", "n", F.posexplode("digests").alias("pos", "key"))
    whole = placed.join(chunks, "key").groupBy("start", "doc_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "data"))), lambda x: x["data"]).alias("parts"))
    return whole.select("doc_id", "start", "n", S.text_udf("v binary", rows)("parts")["v"].alias("ids"))


def report(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    Each chunk is read once, held against its digest, and gives its CRC; a document's is put
    together from its chunks'. Recipes that differ from the manifest, a chunk that lacks or doesn't
    have its digest, and a document without the number of ids in its recipe make the query fail.
    """
    if _changed(spark, folder):
        raise ValueError("the recipes' tree differs from the manifest")
    values = _part(spark, folder, "chunk").select("key", _chunk_values("data", "key").alias("v"))
    right = F.when(F.col("v.valid"), F.col("v.crc")).otherwise(F.raise_error(F.lit("a chunk differs from its digest")))
    chunks = values.select("key", F.col("v.n").alias("ids"), right.alias("crc"))
    recipes = spark.read.parquet(f"{folder}/recipes")
    parts = recipes.select("start", F.posexplode("digests").alias("pos", "key")).join(chunks, "key", "left").withColumn("ids", F.coalesce("ids", F.raise_error(F.lit("a chunk lacks")).cast("long")))
    parts = parts.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("pos", "ids", "crc"))).alias("parts"))

    def rows(lists):
        crc, after, owner = [], [], []
        for i, p in enumerate(lists):
            left = sum(x["ids"] for x in p)
            for x in p:
                left -= x["ids"]
                crc.append(x["crc"])
                after.append(4 * left)
                owner.append(i)
        out = np.zeros(len(lists), np.uint64)
        np.bitwise_xor.at(out, np.array(owner, int), shifted(np.array(crc, np.uint64), np.array(after, np.int64)))
        return [{"crc": int(c), "n": sum(x["ids"] for x in p)} for c, p in zip(out, lists)]

    found = parts.select("start", S.text_udf("crc long, n long", rows)("parts").alias("r"))
    whole = F.when(F.col("r.n") == F.col("n"), F.col("r.n")).otherwise(F.raise_error(F.lit("a document's number of ids differs from its recipe")).cast("long"))
    return recipes.select("start", "doc_id", "n").join(found, "start", "left").select("doc_id", "start", whole.alias("n_tokens"), F.col("r.crc").alias("ids_crc32"))


def op7_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of all documents' ids, read back from the store; ``write`` says what becomes of nulls, ties and repeated rows, an empty table gives no rows."""
    folder = f"{S.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(S.table(spark, sf_dir, "documents"), folder)
    return report(spark, folder)
