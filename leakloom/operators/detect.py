"""Detection: rules over texts.

An automaton over all keywords picks the rules for a text in one pass, and only these rules' patterns are tried, near
their keywords. This is one Arrow stage, narrow and without a shuffle, for one rule as for hundreds: the
built-in functions give matches but not where a group of them lies, and try each pattern once for every thing asked
of it, which makes them several times slower even for four rules.

A catalog rule tells a value, with its partner, once for each part of a text that it is tried on; a custom rule tells
every match, and the whole match is the secret. Places and lines are those of a value's first occurrence in the whole
text, so copies differ in nothing and de-duplication leaves one. Distances are in bytes of UTF-8, positions in
characters (from 1) and bytes (from 0).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.functions import findings as K
from leakloom.functions import text as X
from leakloom.functions.regex import to_python
from leakloom.operators import spans as P
from leakloom.operators.running import spread
from leakloom.plans.rules import Rule

#: What marks a value as a template.
TEMPLATE = frozenset("{}<>$%")
_FOUND = "detector string, verifier_backed boolean, raw string, raw_v2 string, start long, end long, start_byte long, end_byte long, line long, severity_override int, shown int"
_KIND = pa.list_(pa.struct([
    ("detector", pa.string()), ("verifier_backed", pa.bool_()), ("raw", pa.string()), ("raw_v2", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64()),
    ("line", pa.int64()), ("severity_override", pa.int32()), ("shown", pa.int32()),
]))
_ASCII = {c: c + 32 for c in range(65, 91)}
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def ascii_lowered(text: str) -> str:
    """A to Z in lower case, all else as it is."""
    return text.translate(_ASCII)


class _Places:
    """Bytes and lines of a text's characters."""

    def __init__(self, text: str):
        self.size = len(text)
        self._text, self._bytes, self._lines = text, None, None
        if not text.isascii():
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            self._bytes = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])
            self.size = int(self._bytes[-1])

    def byte(self, char: int) -> int:
        return char if self._bytes is None else int(self._bytes[char])

    def char(self, byte: int) -> int:
        """The first character that begins at a byte or after it."""
        byte = min(max(byte, 0), self.size)
        return byte if self._bytes is None else int(np.searchsorted(self._bytes, byte))

    def line(self, char: int) -> int:
        """Line ends before a character."""
        if self._lines is None:
            self._lines = [m.start() for m in re.finditer("\n", self._text)]
        return bisect_left(self._lines, char)


class _Compiled:
    """Rules for Python workers: the keyword automaton, and patterns compiled when first met."""

    def __init__(self, rules: tuple[Rule, ...]):
        import ahocorasick

        self.rules, words = rules, {}
        for k, rule in enumerate(rules):
            for word in rule.keywords:
                words.setdefault(word.lower(), []).append(k)
        self.always = words.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for word, owners in words.items():
            self.automaton.add_word(word, (len(word), owners))
        if words:
            self.automaton.make_automaton()
        self.any = bool(words)
        self.pattern = lru_cache(maxsize=None)(lambda p: re.compile(to_python(p)))
        self.only = lru_cache(maxsize=None)(lambda k: _Compiled((self.rules[k],)))

    def hits(self, lowered: str) -> dict[int, list[tuple[int, int]]]:
        """Rule to its keywords' occurrences, first and last character."""
        out: dict[int, list[tuple[int, int]]] = {k: [] for k in self.always}
        if self.any:
            for end, (size, owners) in self.automaton.iter(lowered):
                for k in owners:
                    out.setdefault(k, []).append((end - size + 1, end))
        return out

    def values(self, rule: Rule, text: str) -> Iterator[tuple[str, int, int, str | None]]:
        """The values of a rule's token forms in a text, with their places and partners of the same match."""
        for form in rule.patterns:
            pattern = self.pattern(form)
            groups = rule.groups or ((1,) if pattern.groups else (0,))
            for m in pattern.finditer(text):
                g = next((g for g in groups if m[g]), None)
                if g is not None and not (rule.left_boundary and m.start() and text[m.start() - 1] in _WORD):
                    yield m[g], m.start(g), m.end(g), m[rule.partner_group] if rule.partner_group else None

    def parts(self, rule: Rule, hits: list[tuple[int, int]], at: _Places, vicinity: int | None) -> list[tuple[int, int]]:
        """The parts of a text, from and to in bytes, that a rule is tried on: neighbourhoods of its keywords within each window, or all of it."""
        if vicinity is None or rule.whole_text or not hits:
            return [(0, at.size)]
        ends = [(at.byte(a), at.byte(b + 1)) for a, b in hits]
        out = []
        for low in range(0, max(at.size - P.OVERLAP, 1), P.WINDOW - P.OVERLAP):
            high = min(low + P.WINDOW, at.size)
            inside = [b - 1 - low for a, b in ends if low <= a and b <= high]
            out += [(a + low, b + low) for a, b in merged_spans(inside, vicinity, high - low)]
        return out

    def find(self, text: str, vicinity: int | None):
        """(rule, value, partner) as each part tells it, rules with a verifier first."""
        lowered, at = text.translate(_ASCII), _Places(text)
        for k, hits in sorted(self.hits(lowered).items(), key=lambda x: (not self.rules[x[0]].verifier_backed, x[0])):
            rule = self.rules[k]
            for low, high in ((at.char(a), at.char(b)) for a, b in self.parts(rule, hits, at, vicinity)):
                part, partners, seen = text[low:high], None, set()
                for raw, start, end, partner in self.values(rule, part):
                    start, end = start + low, end + low
                    if rule.min_entropy and measured_entropy(raw, rule.family == "CUSTOM") < rule.min_entropy:
                        continue
                    if rule.stop and (raw.lower() in rule.stop or TEMPLATE.intersection(raw)):
                        continue
                    if rule.radius and (rule.context or rule.arms):
                        around = lowered[at.char(at.byte(start) - rule.radius) : at.char(at.byte(end) + rule.radius)]
                        if not any(w in around for w in rule.context) and not any(self.pattern("(?i)" + a.removeprefix("(?i)")).search(around) for a in rule.arms):
                            continue
                    if rule.partner:
                        if partners is None:
                            pattern = self.pattern(rule.partner)
                            group = 1 if pattern.groups else 0
                            partners = [(at.byte(m.start(group) + low), m[group]) for m in pattern.finditer(part) if m[group]]
                        partner = nearest(partners, at.byte(start), raw, rule.partner_radius)
                    if rule.family == "CUSTOM" or (raw, partner) not in seen:
                        seen.add((raw, partner))
                        yield rule, raw, partner


def first_places(text: str, values) -> dict[str, int]:
    """Where each value first stands in a text, for those that do; one pass over the text, whatever their number."""
    values = set(values) - {""}
    if len(values) < 8:
        return {v: k for v in values if (k := text.find(v)) >= 0}
    import ahocorasick

    automaton, out = ahocorasick.Automaton(), {}
    for v in values:
        automaton.add_word(v, v)
    automaton.make_automaton()
    for end, v in automaton.iter(text):
        if v not in out:
            out[v] = end - len(v) + 1
            if len(out) == len(values):
                break
    return out


def nearest(partners: list[tuple[int, str]], start: int, raw: str, radius: int) -> str | None:
    """Of values by ascending place the one nearest to a place, within a radius and not the value itself; the first of equally near ones."""
    right = bisect_left(partners, (start,))
    left = right - 1
    while True:
        before = start - partners[left][0] if left >= 0 else radius + 1
        after = partners[right][0] - start if right < len(partners) else radius + 1
        if min(before, after) > radius:
            return None
        k = left if before <= after else right
        if partners[k][1] != raw:
            return partners[k][1]
        left, right = (left - 1, right) if k == left else (left, right + 1)


def measured_entropy(s: str, by_character: bool = False) -> float:
    """Shannon entropy in bits a byte; by character, characters are counted but still held against the bytes' number."""
    data = s.encode()
    n = len(data)
    return -sum(k / n * math.log2(k / n) for k in Counter(s if by_character else data).values()) if n else 0.0


def merged_spans(ends: list[int], radius: int, size: int) -> list[tuple[int, int]]:
    """Neighbourhoods of keyword ends, clipped to the text, merged where they overlap or touch."""
    out: list[list[int]] = []
    for end in sorted(ends):
        low, high = max(0, end - radius), min(size, end + 1 + radius)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


@lru_cache(maxsize=4)
def compiled_rules(rules: tuple[Rule, ...]) -> _Compiled:
    """One set of compiled rules a Python worker."""
    return _Compiled(rules)


def told(text: str, found: list) -> list[dict]:
    """Rows of findings, with the places of their values' first occurrences, null where a value isn't in the text."""
    at, first = _Places(text), first_places(text, (raw for _, raw, _ in found))
    out = []
    for rule, raw, partner in found:
        row = {"detector": rule.name, "verifier_backed": rule.verifier_backed, "raw": raw, "raw_v2": partner, "severity_override": rule.severity, "shown": rule.shown}
        if (a := first.get(raw)) is not None:
            b = a + len(raw)
            row |= {"start": a + 1, "end": b + 1, "start_byte": at.byte(a), "end_byte": at.byte(b), "line": at.line(a)}
        out.append(row)
    return out


def detect(chunks: DataFrame, rules: Sequence[Rule], text: str = "text", vicinity: int | None = P.RADIUS) -> DataFrame:
    """One row per value that a rule tells, with the columns of the input.

    ``vicinity``: patterns are tried only so near to a keyword, in bytes, and in windows of 32 KiB; None tries whole
    texts. A pattern that fits only past the end of its neighbourhood isn't found, unless its rule asks for whole texts.
    ``line`` counts the line ends before a value's first occurrence. Null texts have no findings.
    """
    fixed = tuple(rules)

    @F.arrow_udf(f"array<struct<{_FOUND}>>")
    def found(texts: pa.Array) -> pa.Array:
        compiled = compiled_rules(fixed)
        return pa.array([told(t, list(compiled.find(t, vicinity))) if t else [] for t in texts.to_pylist()], _KIND)

    return spread(chunks).withColumn("f", F.explode(found(text))).select("*", "f.*").drop("f")


def enrich(found: DataFrame, base_line: str | None = None) -> DataFrame:
    """Add severity, digest and a redacted rendering, and count lines from ``base_line``, or from 1."""
    rank = K.default_severity("detector", F.lit(False), "severity_override")
    out = found.withColumn("severity_rank", rank.cast("int")).withColumn("severity", K.severity_name("severity_rank"))
    out = out.withColumn("line", (F.col("line") + (F.col(base_line) if base_line else F.lit(1))).cast("long"))
    return out.withColumn("secret_hash", X.secret_hash("raw")).withColumn("redacted", X.redacted("raw", F.col("shown"))).drop("severity_override", "shown")


def hits_of(chunks: DataFrame, keyword: str, text: str = "text") -> DataFrame:
    """(columns, hit_end): the 0-based character at which each occurrence of a keyword ends."""
    found = P.matches(X.ascii_lower(text), re.escape(keyword.lower()))
    return chunks.withColumn("hit", F.explode(found)).withColumn("hit_end", F.col("hit")["end"] - 2).drop("hit")
