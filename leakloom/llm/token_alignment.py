"""Alignment of two tokenizers by byte owners (operator 13).

Both tokenizers encode a blank and the text. Over the bytes of that string ``np.repeat`` lays the index of the token
that owns each byte, once for A and once for B. Runs of equal owner pairs are the overlaps of tokens; where both owners
change at once, both tokenizers have a boundary: these cuts divide the tokens into the smallest groups that stand for
the same bytes, and the tokens of A and B that end at a cut are linked.

A is a byte-level BPE of the tokenizers library, looked up piece by piece in a table of arrays (``pieces``), B a
sentencepiece model with byte fallback. No piece of B has a blank after another character, which is checked, so runs of
a blank and what follows it up to the next blank are encoded by themselves, each distinct one once a worker.

Link counts over the whole corpus are a sum by id pair; there are at most as many pairs as the product of the
vocabularies, and they are broadcast only if they have been counted to be few, else pairs are joined by a shuffle with
the hot ones apart.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import _shared as S
from leakloom.llm.token_store import LibraryEncoder

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Id pairs that are broadcast at most; bytes of text whose owners are laid out at once, unless one text has more.
FEW_PAIRS, SLICE = 1_000_000, 1 << 21
#: Runs of B that a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 300_000, 64
_RUN = re.compile(r" +[^ ]+(?: +\Z)?| +")


class ByteLevel:
    """Texts to ids of a byte-level BPE; special tokens' strings in a text are plain text."""

    def __init__(self, vocabulary: str = A):
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel as Form

        library = LibraryEncoder(vocabulary)
        self.encode = library._pieces.encode  # noqa: SLF001
        entries = Tokenizer.from_file(public_tokenizers.path(vocabulary)).get_vocab()
        form = Form(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # every byte's character, met in the one or two bytes of the first code points and in longer ones' lead bytes
        byte_of: dict[str, int] = {}
        for c in map(chr, [*range(0x800), *range(0x800, 0xD800, 64), *range(0xE000, 0x110000, 4096)]):
            byte_of.update(zip(form(c)[0][0], c.encode()))
        self.bytes_of: list[bytes] = [b""] * (1 + max(entries.values()))
        for entry, i in entries.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()


class Pieces:
    """Texts, which begin with a blank, to ids of a sentencepiece model that adds this blank itself."""

    def __init__(self, vocabulary: str = B):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        self._library = model = SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        shown = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self._runs = not any(re.search("[^▁]▁", p) for p in shown)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)]
        self._known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without the blank that the model adds."""
        return [np.array(ids, "<u4").tobytes() for ids in self._library.encode(texts, num_threads=1)] if texts else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = [k for k, t in enumerate(texts) if not self._runs or "▁" in t]  # that character is a blank to the model
        if odd:
            whole = dict(zip(odd, self._whole([texts[k][1:] for k in odd])))
            plain = iter(self.encode([t for k, t in enumerate(texts) if k not in whole]) if len(odd) < len(texts) else [])
            return [np.frombuffer(whole[k], "<u4") if k in whole else next(plain) for k in range(len(texts))]
        if len(self._known) > REMEMBERED:
            self._known.clear()
        known = self._known
        runs = [[r[1:] for r in _RUN.findall(t)] if "  " in t or t[-1] == " " else t[1:].split(" ") for t in texts]
        fresh = list({r for rs in runs for r in rs} - known.keys())
        known.update(zip(fresh, self._whole(fresh)))
        out = [np.frombuffer(b"".join(map(known.__getitem__, rs)), "<u4") for rs in runs]
        for r in fresh:
            if len(r) > LONGEST:
                del known[r]
        return out


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


@lru_cache(maxsize=4)
def _tables(a: str, b: str):
    """Per tokenizer: sizes of its tokens in bytes, where they begin in all their bytes, those, and their decimal ids as characters with a place left for what follows."""
    out = []
    for t in tokenizers(a, b):
        n = len(t.bytes_of)
        digits = np.zeros((n, 8), np.uint8)
        for i in range(n):
            s = str(i).encode()
            digits[i, : len(s)] = np.frombuffer(s, np.uint8)
        sizes = np.fromiter(map(len, t.bytes_of), np.int64, n)
        out.append((sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(t.bytes_of), np.uint8), digits))
    return out


def spelt(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, letters: np.ndarray, *_) -> np.ndarray:
    """The bytes of some tokens, from the sizes, places and bytes of all."""
    n = sizes[ids]
    ends = np.cumsum(n)
    return letters[np.repeat(starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def owners(sizes: np.ndarray) -> np.ndarray:
    """For each byte the index of the token that it belongs to."""
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def changes(owner: np.ndarray) -> np.ndarray:
    """Whether each byte is the last of its token."""
    out = np.ones(len(owner), bool)
    out[:-1] = owner[1:] != owner[:-1]
    return out


def overlaps(owner_a: np.ndarray, owner_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal owner pairs: token of A, token of B, bytes that both have."""
    ends = np.flatnonzero(changes(owner_a) | changes(owner_b))
    return owner_a[ends], owner_b[ends], np.diff(ends, prepend=-1)


class Aligned:
    """Some texts, aligned: ids of both, and for every token its group; texts that a tokenizer changes have none."""

    def __init__(self, texts: list[str | None], a: str = A, b: str = B):
        ta, tb = tokenizers(a, b)
        self.sizes = [x for x, *_ in _tables(a, b)]
        spaced = [" " + t for t in texts if t]
        coded = zip(spaced, ta.encode(spaced), tb.encode(spaced))
        none = np.zeros(0, np.int64)
        kept = []
        for s, x, y in coded:
            x, y, data = x.astype(np.int64), y.astype(np.int64), np.frombuffer(s.encode(), np.uint8)
            same = all(np.array_equal(spelt(ids, *t), data) for ids, t in zip((x, y), _tables(a, b)))
            kept.append((x, y) if same else (none, none))
        found = iter(kept)
        self.docs = [next(found) if t else (none, none) for t in texts]
        self.a, self.b = (np.concatenate([none, *(d[k] for d in self.docs)]) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(d[k]) for d in self.docs], np.int64) for k in (0, 1))
        self.owner_a, self.owner_b = owners(self.sizes[0][self.a]), owners(self.sizes[1][self.b])
        self.cuts = np.flatnonzero(changes(self.owner_a) & changes(self.owner_b))  # ends of texts are among them
        #: Tokens that end at each cut.
        self.last_a, self.last_b = self.owner_a[self.cuts], self.owner_b[self.cuts]
        self.groups = np.diff(np.searchsorted(self.last_a, np.concatenate([[0], np.cumsum(self.n_a)])))

    def digests(self, a: str = A, b: str = B) -> list[str]:
        """SHA-256 of each text's groups, written ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        (*_, da), (*_, db) = _tables(a, b)
        ends_a, ends_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        ends_a[self.last_a], ends_b[self.last_b] = True, True
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b  # of each token
        at_a = np.arange(len(self.a)) + np.concatenate([[0], self.last_b + 1])[group_a]  # after the tokens of B in earlier groups
        at_b = np.arange(len(self.b)) + (self.last_a + 1)[group_b] if len(self.b) else np.zeros(0, np.int64)
        form = np.zeros((len(self.a) + len(self.b), 8), np.uint8)
        form[at_a], form[at_b] = da[self.a], db[self.b]
        n = (form != 0).sum(axis=1)
        mark = np.empty(len(form), np.uint8)
        mark[at_a], mark[at_b] = np.where(ends_a, ord("|"), ord(",")), np.where(ends_b, ord(";"), ord(","))
        form[np.arange(len(form)), n] = mark
        written = form[form != 0].tobytes()
        to = np.concatenate([[0], np.cumsum(n + 1)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return [hashlib.sha256(written[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(to[:-1], to[1:])]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of linked ids, A's in the upper half, and where each text's ones end."""
        return self.a[self.last_a] << 32 | self.b[self.last_b], np.cumsum(self.groups)


def _slices(texts: list[str | None]):
    """Ranges of texts of at most SLICE characters, at least one text each."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end] or "") <= SLICE):
            n += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def aligned(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """(doc_id, a, b, groups, overlaps): ids, the numbers of tokens of A and B in each group, and the tokens that overlap.

    ``overlaps`` are (a, b, bytes) with tokens' indices from 0. A null doc_id stays null; texts that are null or empty
    or that a tokenizer changes have empty arrays; repeated rows stay; other columns are not read.
    """
    kind = "array<int>"
    ddl = f"doc_id long, a {kind}, b {kind}, groups array<struct<a:int,b:int>>, overlaps array<struct<a:int,b:int,bytes:int>>"
    schema = _schema(ddl)

    def rows(batches):
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for i, j in _slices(texts):
                for doc_id, text in zip(ids[i:j], texts[i:j]):
                    x = Aligned([text], a, b)
                    groups = np.stack([np.diff(x.last_a, prepend=-1), np.diff(x.last_b, prepend=-1)], 1).tolist()
                    over = np.stack(overlaps(x.owner_a, x.owner_b), 1).tolist()
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "a": x.a.tolist(), "b": x.b.tolist(), "groups": [{"a": p, "b": q} for p, q in groups], "overlaps": [{"a": p, "b": q, "bytes": n} for p, q, n in over]}], schema)

    return docs.select("doc_id", "text").mapInArrow(rows, ddl)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))  # noqa: SLF001


def linked(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links): per row its numbers, digest and linked id pairs with how often each.

    Nulls and the like as in ``aligned``.
    """
    ddl = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<struct<pair:bigint,n:bigint>>"
    pair, schema = pa.struct([("pair", pa.int64()), ("n", pa.int64())]), _schema(ddl)

    def rows(batches):
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            for i, j in _slices(texts):
                x = Aligned(texts[i:j], a, b)
                pairs, ends = x.links()
                doc = np.repeat(np.arange(j - i), x.groups)
                order = np.lexsort((pairs, doc))
                pairs, doc = pairs[order], doc[order]
                fresh = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (doc[1:] != doc[:-1])])) if len(pairs) else np.zeros(0, np.int64)
                counted = pa.StructArray.from_arrays([pa.array(pairs[fresh]), pa.array(np.diff(fresh, append=len(pairs)))], fields=list(pair))
                offsets = np.searchsorted(doc[fresh], np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(x.n_a), pa.array(x.n_b), pa.array(x.groups), pa.array(x.digests(a, b)), pa.ListArray.from_arrays(offsets, counted)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(rows, ddl)


def measured(docs: DataFrame, a: str = A, b: str = B, few: int = FEW_PAIRS) -> DataFrame:
    """``linked`` with what its links count corpus-wide: n_links, n_best, count_sum.

    ``n_best`` are the links whose pair counts most among those of their token of B, ties included. Rows are written
    once to the checkpoint folder, with a number each, and read for the sums and for what is joined with them.
    """
    spark = docs.sparkSession
    folder = f"{S.shared_folder(spark)}/links-{uuid.uuid4().hex}"
    linked(docs, a, b).withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    links = rows.select("row", F.explode("links").alias("l")).select("row", "l.pair", "l.n")
    counts = S.checkpointed(links.groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("docs")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row a token of B: at most a vocabulary
    counts = counts.join(F.broadcast(most), "b").select("pair", "count", "docs", (F.col("count") == F.col("most")).alias("best"))
    if counts.limit(few + 1).count() <= few:
        found = links.join(F.broadcast(counts.drop("docs")), "pair")
    else:
        total = counts.agg(F.sum("docs")).first()[0]
        found = S.join_counted(links, S.checkpointed(counts), "pair", "docs", total)
    sums = found.groupBy("row").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = rows.drop("links").join(sums, "row", "left").drop("row")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_links", "n_best", "count_sum")})


def op13_byte_owner_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over all documents; texts that are null, empty or changed by one have zeros."""
    rows = measured(S.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
