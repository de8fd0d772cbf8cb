"""Byte-level BPE by a dynamic programme over prefixes (operator 4).

For any byte string, the last token of the encoding of each of its prefixes is unique: a
token ``t`` that ends at ``i`` is it exactly if ``t`` encodes to itself and forms a valid pair
with the last token of the prefix before it, a pair being valid if its joined bytes encode to
just these two tokens. One left-to-right pass over the prefixes therefore encodes without a
merge loop, the array of last tokens serves any prefix, appending continues the pass, and after
an edit the pass restarts at the first changed byte and ends where the old last tokens come back: once as many
in a row as the longest token has bytes are what they were, so are all after them.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from leakloom.llm import _shared as S
from leakloom.llm.pieces import PieceTable

#: Vocabulary of the default encoding, a file name that public_tokenizers resolves.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pairs of tokens whose validity an encoder remembers.
PAIRS = 100_000
#: Above every rank.
NEVER = 1 << 60


class PrefixEncoder:
    """Encodes byte strings with one set of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        #: Byte to node; at -1 the token that ends here, if it encodes to itself.
        self.trie: dict = {}
        for token, rank in ranks.items():
            if len(token) == 1 or len(self._merge(token)) == 1:
                node = self.trie
                for byte in token:
                    node = node.setdefault(byte, {})
                node[-1] = rank

    def _merge(self, data: bytes, left: int = 1) -> list[bytes]:
        """Merge a token's bytes by the pair of lowest rank until ``left`` parts are left or no pair has a rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > left:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if best == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at one end of ``token`` while it is being merged: each part and the rank that uses it up."""
        known = self._edges[side].get(token)
        if known is None:
            part = self.bytes_of[token]
            known, until = [(part, NEVER)], token
            while len(part) > 1 and len(halves := self._merge(part, 2)) == 2:
                part = halves[side]
                known.append((part, until))
                until = self.ranks[part]
            self._edges[side][token] = known
        return known

    def valid_pair(self, left: int, right: int) -> bool:
        """No part at the end of ``left`` joins one at the start of ``right`` before either is used up.

        Of two equal ranks the one further left is merged first, hence < on the left and <= on the right.
        """
        key = left << 32 | right
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            rank = self.ranks.get
            known = self._pairs[key] = not any(rank(a + b, NEVER) < until_a and rank(a + b) <= until_b for a, until_a in self._edge(left, 1) for b, until_b in self._edge(right, 0))
        return known

    def extend(self, data: bytes, last: list[int], size: int | None = None) -> list[int]:
        """Fill ``last[i]``, the last token of ``data[:i]``, from ``len(last)`` to ``size``, by default the end; ``last[0]`` is -1.

        Every prefix has a last token, so a pass over the starts, each walking the trie as far as
        tokens reach, settles each end before it becomes a start.
        """
        pairs, done, size = self._pairs, len(last), len(data) if size is None else size
        last += [NEVER] * (size + 1 - done)
        for start in range(max(0, done - self.longest), size):
            left, node = last[start], self.trie
            if left == NEVER:
                raise ValueError("a byte has no token")
            for end in range(start + 1, size + 1):
                node = node.get(data[end - 1])
                if node is None:
                    break
                if end >= done and last[end] == NEVER and (token := node.get(-1)) is not None:
                    fits = start == 0 or pairs.get(left << 32 | token)
                    if fits is None:
                        fits = self.valid_pair(left, token)
                    if fits:
                        last[end] = token
        return last

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding of ``data``, read back from the last tokens of its prefixes."""
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """Encode one match of the splitting pattern; a piece that is itself a token is that token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self.tokens(data, self.extend(data, [-1])) if data else []


class PrefixBuffer:
    """A byte string under appends and edits, encoded as one piece."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.encoder.extend(self.data, self.last)

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of ``[start, end)``; returns how many last tokens had to be found again.

        Prefixes up to ``start`` keep theirs. Beyond the edit the pass goes on until the last tokens of as many
        prefixes in a row as the longest token is long are those of before; the others keep theirs as well.
        """
        old, longest = self.last[end:], self.encoder.longest
        self.data = self.data[:start] + data + self.data[end:]
        del self.last[start + 1 :]
        edge, same = start + len(data), 0
        while len(self.last) <= len(self.data):
            done = len(self.last)
            self.encoder.extend(self.data, self.last, min(len(self.data), max(done, edge) + longest))
            for at in range(max(done, edge + 1), len(self.last)):
                same = same + 1 if self.last[at] == old[at - edge] else 0
            if same >= longest:
                found = len(self.last)
                self.last += old[found - edge :]
                return found - start - 1
        return len(self.last) - start - 1

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, of all by default."""
        return self.encoder.tokens(self.data[:end], self.last)


class TextCodec:
    """Whole texts to ids and back, many at once."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoder = PrefixEncoder(ranks)
        one = self.encoder.encode_piece
        self._pieces = PieceTable(lambda pieces: [one(p.encode()) for p in pieces])
        last = max(ranks.values(), default=-1)
        tokens = [self.encoder.bytes_of.get(i, b"") for i in range(last + 1)]
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self._starts = np.cumsum(self._sizes) - self._sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        return self._pieces.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; an id without a token is an error."""
        sizes = self._sizes[ids]
        if len(ids) and not sizes.all():
            raise ValueError("an id has no token")
        ends = np.cumsum(sizes)
        return self._bytes[np.repeat(self._starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@lru_cache(maxsize=4)
def codec(vocabulary: str = VOCABULARY) -> TextCodec:
    """One codec a Python worker; it is built where it is used, never shipped."""
    return TextCodec(vocabulary)


def encode(docs: DataFrame, text: str = "text", into: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``into``, the ids of each text as little-endian unsigned 32-bit integers; a column of that name is replaced.

    One row per input row, repeated rows included; null counts as empty; an empty table stays empty.
    """

    def rows(texts):
        return [{"v": ids.astype("<u4").tobytes()} for ids in codec(vocabulary).encode([t or "" for t in texts])]

    return docs.withColumn(into, S.text_udf("v binary", rows)(text)["v"])


def decode(docs: DataFrame, ids: str = "ids", into: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``into``, the text that ids stand for; a column of that name is replaced. Null ids give null; bytes that aren't UTF-8 become U+FFFD."""

    def rows(values):
        known = codec(vocabulary)
        return [{"v": None if v is None else known.decode(np.frombuffer(v, "<u4")).decode("utf-8", "replace")} for v in values]

    return docs.withColumn(into, S.text_udf("v string", rows)(ids)["v"])


def digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encode and decode each text and return doc_id, n_tokens, ids_sha256 and decoded_sha256.

    One row per input row, repeated rows included; a null text counts as empty and has the
    digests of nothing; other columns are not read. Nothing is shuffled.
    """

    def rows(texts):
        known, out = codec(vocabulary), []
        for ids in known.encode([t or "" for t in texts]):
            out.append({"n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(known.decode(ids)).hexdigest()})
        return out

    coded = S.text_udf("n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
    return docs.select("doc_id", coded("text").alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all whole texts; null counts as empty, repeated rows give repeated results, an empty table gives no rows."""
    return digest(S.table(spark, sf_dir, "documents"))
