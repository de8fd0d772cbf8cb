"""Splitting many texts into pieces at once, and looking their encodings up in a table.

Both BPE operators encode each match of the public splitting pattern by itself, and most pieces come again
and again. Texts are cut here by array operations on character classes, and pieces of up to sixteen bytes are
looked up by their very bytes in an open table of arrays; only pieces that a worker hasn't met go to the
encoder. The table is emptied when it is full, so that memory is bounded whatever the texts hold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Slots of the table as a power of two; it is emptied when more than half of them are used, or the pool is full.
SLOT_BITS = 21
POOL = 1 << 22
#: Characters that are split by one round of array operations, unless one text has more.
BATCH_CHARS = 1 << 18
#: Longest piece that is looked up by its bytes; others are looked up as strings.
SHORT = 16

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def character_classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other, as the splitting pattern tells them apart.

    Code points that not every version of Unicode assigns are told apart by the tokenizers library's own splitter.
    """
    import unicodedata

    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    planes = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.full(0x110000, _OTHER, np.uint8)
    for k, name in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        for m in regex.finditer(f"{name}+", planes):
            a, b = (p if p < 0xD800 else p + 0x800 for p in (m.start(), m.end() - 1))
            classes[a : b + 1] = k
    classes[0xD800:0xE000] = _OTHER
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in np.flatnonzero(classes != _OTHER).tolist():
        if unicodedata.category(chr(c)) == "Cn":
            classes[c] = _LETTER if len(split("a" + chr(c))) == 1 else _NUMBER if len(split("1" + chr(c))) == 1 else _OTHER
    return classes


def piece_starts(chars: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether each character begins a match of the splitting pattern; ``first``: whether it begins a text.

    The pattern: a contraction, else letters, numbers or other characters after at most one blank, else
    white space, of which the last character before anything else is left to what follows.
    """
    n = len(chars)
    if not n:
        return np.zeros(0, bool)
    kind = classes[chars]
    space = kind == _SPACE
    changes = np.ones(n, bool)
    changes[1:] = kind[1:] != kind[:-1]
    changes |= first
    ends = np.ones(n, bool)  # the last character of a run of one class
    ends[:-1] = changes[1:]
    final = np.ones(n, bool)  # the last character of a text
    final[:-1] = first[1:]
    last_space = space & ends & ~final
    starts = changes | last_space
    joined = last_space & (chars == 32)
    starts[1:] &= ~joined[:-1]
    marks = np.flatnonzero((chars == 39) & starts & ~final)
    if len(marks):
        padded = np.concatenate([chars, np.zeros(2, chars.dtype)])
        one, two = padded[marks + 1], padded[marks + 2]
        two = np.where(final[marks + 1], 0, two)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)
        for at, size in ((marks[short], 2), (marks[long], 3)):
            for k in range(1, size):
                starts[at + k] = False
            after = at + size
            starts[after[after < n]] = True
    return starts


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


class PieceTable:
    """Encodes texts piece by piece; ``encode`` gives the ids of each of some distinct pieces."""

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], slot_bits: int = SLOT_BITS, pool: int = POOL):
        self._encode, self._bits, self._most = encode, slot_bits, pool
        self.classes = character_classes()
        self._clear()

    def _clear(self) -> None:
        slots = 1 << self._bits
        self._low, self._high = np.zeros((2, slots), np.uint64)
        self._size = np.zeros(slots, np.uint8)  # of the piece in bytes; 0 is a free slot
        self._at, self._n = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self._pool, self._end, self._used = np.zeros(1 << 16, np.uint32), 0, 0
        self._long: dict[bytes, tuple[int, int]] = {}

    def _stored(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces into the pool; where each one's ids are and how many."""
        coded = self._encode([p.decode() for p in pieces])
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = self._end + np.cumsum(sizes)
        if ends[-1] > len(self._pool):
            self._pool = np.concatenate([self._pool[: self._end], np.zeros(max(int(ends[-1]) - self._end, self._end), np.uint32)])
        self._pool[self._end : ends[-1]] = np.fromiter((i for ids in coded for i in ids), np.uint32, int(sizes.sum()))
        self._end = int(ends[-1])
        return ends - sizes, sizes

    def _find(self, low, high, size, slot) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, or the free slot at which its search ended, and whether it is there."""
        slot, mask = slot.copy(), np.int64((1 << self._bits) - 1)
        there = (self._low[slot] == low) & (self._high[slot] == high) & (self._size[slot] == size)
        open_ = np.flatnonzero(~there & (self._size[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            s = slot[open_]
            good = (self._low[s] == low[open_]) & (self._high[s] == high[open_]) & (self._size[s] == size[open_])
            there[open_[good]] = True
            open_ = open_[~good & (self._size[s] != 0)]
        return slot, there

    def _short(self, data: bytes, begin, size) -> tuple[np.ndarray, np.ndarray]:
        words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
        low = words[begin] & _MASKS[np.minimum(size, 8)]
        high = words[begin + 8] & _MASKS[np.clip(size - 8, 0, 8)]
        size = size.astype(np.uint8)
        mixed = _spread(low ^ _spread(high + size.astype(np.uint64)))
        home = (mixed >> np.uint64(64 - self._bits)).astype(np.int64)
        slot, there = self._find(low, high, size, home)
        lost = np.flatnonzero(~there)
        while len(lost):
            _, one = np.unique(mixed[lost], return_index=True)
            new = lost[one]
            at, n = self._stored([data[b : b + s] for b, s in zip(begin[new].tolist(), size[new].tolist())])
            while len(new):
                free, _ = self._find(low[new], high[new], size[new], home[new])
                _, won = np.unique(free, return_index=True)
                w, s = new[won], free[won]
                self._low[s], self._high[s], self._size[s], self._at[s], self._n[s] = low[w], high[w], size[w], at[won], n[won]
                self._used += len(won)
                rest = np.ones(len(new), bool)
                rest[won] = False
                new, at, n = new[rest], at[rest], n[rest]
            slot[lost], there[lost] = self._find(low[lost], high[lost], size[lost], home[lost])
            lost = lost[~there[lost]]
        return self._at[slot].astype(np.int64), self._n[slot].astype(np.int64)

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        if 2 * self._used > 1 << self._bits or self._end > self._most:
            self._clear()
        whole = "".join(texts)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        first = np.zeros(len(chars) + 1, bool)
        first[offsets[:-1]] = True
        starts = np.flatnonzero(piece_starts(chars, first[:-1], self.classes))
        data = whole.encode()
        if len(data) == len(chars):
            edges = np.append(starts, len(data))
        else:
            width = np.ones(len(chars), np.int64)
            for limit in (0x80, 0x800, 0x10000):
                width += chars >= limit
            edges = np.append((np.cumsum(width) - width)[starts], len(data))
        begin, size = edges[:-1], np.diff(edges)
        slots = (1 << self._bits) // 4
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        padded, short, long = data + bytes(SHORT), np.flatnonzero(size <= SHORT), np.flatnonzero(size > SHORT)
        for k in range(0, len(short), slots):  # so many new pieces as the table surely has room for
            if 2 * self._used > 1 << self._bits:
                return self._halved(texts, whole)
            part = short[k : k + slots]
            at[part], n[part] = self._short(padded, begin[part], size[part])
        if len(long):
            pieces = [data[b : b + s] for b, s in zip(begin[long].tolist(), size[long].tolist())]
            fresh = [p for p in dict.fromkeys(pieces) if p not in self._long]
            if fresh:
                self._long.update(zip(fresh, zip(*(x.tolist() for x in self._stored(fresh)))))
            at[long], n[long] = np.array([self._long[p] for p in pieces], np.int64).T
        ends = np.cumsum(n)
        ids = self._pool[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def _halved(self, texts: list[str], whole: str) -> list[np.ndarray]:
        """What a table too small for the pieces of some texts does: take them in parts, a long text piece by piece."""
        self._clear()
        if len(texts) > 1:
            half = len(texts) // 2
            return self._some(texts[:half]) + self._some(texts[half:])
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(chars), bool)
        first[:1] = True
        starts = np.flatnonzero(piece_starts(chars, first, self.classes)).tolist()
        pieces = [whole[a:b] for a, b in zip(starts, [*starts[1:], len(whole)])]
        known: dict[str, np.ndarray] = {}
        out = []
        for k in range(0, len(pieces), 1 << 16):
            fresh = list(dict.fromkeys(p for p in pieces[k : k + (1 << 16)] if p not in known))
            known.update(zip(fresh, (np.array(x, np.uint32) for x in self._encode(fresh))))
            out += [known[p] for p in pieces[k : k + (1 << 16)]]
            if len(known) > 1 << (self._bits - 1):
                known = {}
        return [np.concatenate(out)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            out += self._some(texts[at:end])
            at = end
        return out
