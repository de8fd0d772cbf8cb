"""Personal data: base patterns, and a skip-chain conditional random field (operator 5).

Four fixed patterns give the base spans. The field then labels every candidate: a token that holds a digit or
an at sign, a run of two or three capitalised words, a house number with its street. A chain joins neighbours of a
document, and each candidate is also joined to the one before it, however far away, that has the same letters
and digits, or that is like it: the same last seven digits, the same mailbox, the same last name. A number
written out plainly so takes the label of its formatted twin, and a name the label that a cue gave it once.
Weights come from pseudo-likelihood on generated, labelled token lists; labels come from loopy message
passing. Spans the field finds are added where they don't overlap base spans; base spans always stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import _shared as S

#: Kinds in the order in which spans of one start are listed; the base patterns know the first four.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "birth", "name", "address")
OUTSIDE = len(KINDS)
#: Least bound on the rounds of message passing, examples to train on, and the belief a span needs.
ROUNDS, EXAMPLES, BELIEF = 8, 1_000, 0.7
#: Messages of a text have settled when none changed by more in a round.
SETTLED = 1e-6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: As the contract's pattern: a match can start anywhere in a run of digits only if it can at its start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str):
    """Leftmost matches of the e-mail pattern, found from each at sign so that long runs cost one pass."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        floor = max(floor, at)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and kind; offsets are code points."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


_DIGIT = re.compile("[0-9]")
_HOT = re.compile(r"[0-9@]\S*")
_EDGES = "\"'`.,;:!?()[]{}<>|#*$%&"
_CUES = {
    "secret": re.compile(r"token|passw|pwd|secret|api.?key|credential|bearer", re.I),
    "phone": re.compile(r"phone|\btel\b|mobile|call|fax", re.I),
    "card": re.compile(r"card|visa|credit", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr", re.I),
    "email": re.compile(r"mail|contact", re.I),
    "ssn": re.compile(r"\bssn\b|social security", re.I),
    "birth": re.compile(r"\bborn\b|birth|\bdob\b", re.I),
    "name": re.compile(r"\b(?:mr|mrs|ms|dr|prof|sir|dear|call|ask|name(?: is)?|named|patient|customer|contact|signed|regards|sincerely|attn)[.,:]?\s*$", re.I),
    "address": re.compile(r"\b(?:at|lives|address|street|ship to|deliver to|resides)\b", re.I),
}
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_HEX = re.compile(r"[0-9a-fA-F]{16,}")
_KEY = re.compile(r"[A-Z0-9]{16,}")
_MAIL = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+")
_SOCIAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)?[0-9]{2}")
#: Runs of two or three different capitalised words within a line, after any word that announces a name.
_NAME = re.compile(r"\b(?!(?:Mr|Mrs|Ms|Dr|Prof|Sir|Dear|Call|Ask|Name|Named|Patient|Customer|Contact|Signed|Regards|Sincerely|Attn|The|And|For|From)\b)[A-Z][a-z]{1,20}(?: [A-Z]\.)?(?: [A-Z][a-z]{1,20}){1,2}\b(?! [A-Z][a-z])")
#: A capitalised word just before, but for one that announces a name.
_CAPITAL = re.compile(r"\b(?!(?:Mr|Mrs|Ms|Dr|Prof|Sir|Dear|Call|Ask|Name|Named|Patient|Customer|Contact|Signed|Attn)\b)[A-Z][a-z]+ $")
_STREET = re.compile(r"\b[0-9]{1,5}[A-Za-z]? (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Way|Place|Terrace)\b")


#: Characters of texts that are gone through at once, and edges or candidates whose numbers are laid out at once.
SLICE, EDGES = 1 << 18, 1 << 12


class Token:
    """A candidate: its place without the marks around it, its text, the text before it, the base kind it lies in, and its form: token, name or address."""

    __slots__ = ("start", "end", "core", "before", "base", "form")

    def __init__(self, start, end, core, before, base, form=0):
        self.start, self.end, self.core, self.before, self.base, self.form = start, end, core, before, base, form

    def keys(self) -> list[tuple[str, str]]:
        """What makes candidates the same or like each other."""
        core = self.core.lower()
        plain = "".join(c for c in core if c.isalnum())
        out = [("same", plain)] if len(plain) >= 5 else []
        if self.form == 1:
            return [*out, ("name", core.rsplit(" ", 1)[1])]
        digits = _NOT_DIGIT.sub("", core)
        if 7 <= len(digits) < 12 and len(digits) >= len(plain) - 2:
            out.append(("digits", digits[-7:]))
        if "@" in core[1:]:
            out.append(("mailbox", core.split("@", 1)[0]))
        return out

    def features(self) -> list[float]:
        core = self.core
        digits = len(_NOT_DIGIT.sub("", core))
        letters = sum(map(str.isalpha, core))
        sizes = (0, 1, 4, 7, 10, 12, 20)
        plain = self.form == 0
        return [
            1.0, "@" in core, bool(_MAIL.fullmatch(core)), bool(_QUAD.fullmatch(core)), bool(_HEX.fullmatch(core)), bool(_KEY.fullmatch(core)) and letters > 3,
            letters == 0, plain and 0 < letters and digits > 0 and len(core) >= 16, core[:1] == "+" or self.before[-1:] == "+", self.before[-1:] in "=\"'" and self.before != "", core.startswith("AK" "IA"),
            bool(re.fullmatch(r"[0-9]{3}[-. ]?[0-9]{4}", core)), bool(re.fullmatch(r"(?:[0-9]{3}[-.]?){2}[0-9]{4}", core)), bool(re.fullmatch(r"[0-9]{3}", core)) and self.before[-1:] == "(",
            12 <= digits <= 19 and letters == 0 and luhn(_NOT_DIGIT.sub("", core)), "." in core, len(core) <= 4, self.form == 1, self.form == 2,
            bool(_SOCIAL.fullmatch(core)), bool(_DATE.fullmatch(core)), self.form == 1 and bool(_CUES["name"].search(self.before)),
            bool(_DATE.fullmatch(core)) and bool(_CUES["birth"].search(self.before)),
            *(plain and low <= digits < high for low, high in zip(sizes, (*sizes[1:], 10**9))),
            *(bool(cue.search(self.before)) for cue in _CUES.values()),
            *(self.base == k for k in range(4)),
        ]


def _hot(text: str):
    """Places of the tokens with a digit or an at sign, without the marks around them."""
    done = 0
    for m in _HOT.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = end = m.end()
        cut = max(text.rfind("=", start, end), text.rfind(":", start, end))
        if cut >= 0 and cut + 1 < end and "@" not in text[start:end] and "://" not in text[start:end]:
            start = cut + 1
        while start < end and text[start] in _EDGES:
            start += 1
        while start < end and text[end - 1] in _EDGES:
            end -= 1
        if start < end:
            yield start, end


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[Token]:
    """Streets with their numbers, names, and tokens with a digit or an at sign, each with the base kind it lies in, if any."""
    places = [(m.start(), m.end(), 2) for m in _STREET.finditer(text)] if _DIGIT.search(text) else []
    taken = [(a, b) for a, b, _ in places]
    names = (m.span() for m in _NAME.finditer(text) if len(set(m[0].split(" "))) == m[0].count(" ") + 1 and not _CAPITAL.search(text, max(0, m.start() - 24), m.start()))
    for found, form in ((names, 1), (_hot(text), 0)):
        k = 0
        for a, b in found:
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k == len(taken) or taken[k][0] >= b:
                places.append((a, b, form))
    out, k = [], 0
    for start, end, form in sorted(places):
        while k < len(spans) and spans[k][2] <= start:
            k += 1
        base = next((kind for a, kind, b in spans[k : k + 4] if a < end and start < b), OUTSIDE)
        out.append(Token(start, end, text[start:end], text[max(0, start - 24) : start], base, form))
    return out


def links(tokens: list[Token]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of neighbours, and of each candidate with the last one before it that is the same or like it."""
    chain = [(i, i + 1) for i in range(len(tokens) - 1) if tokens[i + 1].start - tokens[i].end <= 40]
    seen: dict[tuple[str, str], int] = {}
    skip = []
    for i, token in enumerate(tokens):
        mine = token.keys()
        skip += [(j, i) for j in sorted({seen[k] for k in mine if k in seen})]
        seen.update((k, i) for k in mine)
    return chain, skip


def _example(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated text with its labelled spans."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card():
        body = r.choice("3456") + digits(14)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def sample(kind):
        if kind == 0:
            return r.choice(("", "", "mail ", "contact: ")), f"{word()}.{digits(2)}@{word()}.{r.choice(('com', 'org', 'example.net'))}"
        if kind == 1:
            return r.choice(("", "", "host ", "ip ")), ".".join(str(r.randint(1, 255)) for _ in range(4))
        if kind == 2:
            number = card()
            return r.choice(("", "", "card ", "visa ")), number if r.random() < 0.6 else "-".join(number[i : i + 4] for i in range(0, 16, 4))
        if kind == 3:
            return r.choice(("", "", "phone ", "call ", "tel ")), r.choice(("+1 ({}) {}-{}", "({}) {}-{}", "+1 {}-{}-{}", "{}-{}-{}")).format(digits(3), digits(3), digits(4))
        if kind == 5:
            return r.choice(("SSN ", "ssn: ", "social security ", "", "")), f"{digits(3)}-{digits(2)}-{digits(4)}"
        if kind == 6:
            return r.choice(("born ", "born on ", "date of birth ", "DOB: ", "birthday ")), r.choice((f"19{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"0{r.randint(1, 9)}/1{r.randint(0, 9)}/19{digits(2)}"))
        if kind == 7:
            return r.choice(("Mr. ", "Dr. ", "call ", "Call ", "name is ", "Dear ", "contact ", "Name: ", "ask ")), " ".join(word().capitalize() for _ in range(r.choice((2, 2, 2, 3))))
        if kind == 8:
            return r.choice(("at ", "lives at ", "Address: ", "", "ship to ")), f"{r.randint(1, 999)} {word().capitalize()} {r.choice(('Street', 'Road', 'Avenue', 'Lane', 'Drive'))}"
        value = r.choice((lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((17, 24, 32, 40, 64)))), lambda: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(20)), lambda: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(r.randint(20, 40)))))()
        return r.choice(('token = "', "password=", "secret: ", "api_key=", "", "bearer ")), value

    def other():
        return r.choice((f"{r.randint(1, 9)}.{r.randint(0, 9)}", str(r.randint(1900, 2030)), digits(r.randint(1, 3)), f"{r.randint(1, 99)}.{digits(2)}", f"20{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"{r.randint(1, 12)}:{digits(2)}", f"{word()}{digits(1)}", f"v{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", digits(r.randint(4, 9)), f"{r.randint(1, 9)},{digits(3)}", f"@{word()}", digits(16), *[f"{word().capitalize()} {word().capitalize()}"] * 6, f"20{digits(2)}/{r.randint(1, 12)}/{r.randint(1, 28)}", f"in {r.randint(1900, 2030)} {word().capitalize()}"))

    text, spans, said = "", [], []
    for _ in range(r.randint(2, 7)):
        text += " ".join(word() for _ in range(r.randint(0, 6))) + " "
        if said and r.random() < 0.35:  # the same thing again, without what told its kind
            kind, value = r.choice(said)
            value = value if r.random() < 0.5 or kind > 5 else re.sub(r"[-() +]", "", value)
            lead = ""
        elif r.random() < 0.5:
            text += other() + r.choice((" ", ". ", ", "))
            continue
        else:
            kind = r.randrange(len(KINDS))
            lead, value = sample(kind)
            said.append((kind, value))
        text += lead
        spans.append((len(text), kind, len(text) + len(value)))
        text += value + ('"' if lead.endswith('"') else "") + r.choice((" ", ". ", ", "))
    return text, spans


@lru_cache(maxsize=1)
def model(seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of a token's features, of neighbours' labels and of linked tokens' labels.

    Softmax regression of each label on the features and on its neighbours' true labels
    maximises the pseudo-likelihood; examples are generated, so nothing is read or collected.
    """
    r, n = random.Random(seed), OUTSIDE + 1
    x, before, after, twin, y = [], [], [], [], []
    for _ in range(EXAMPLES):
        text, spans = _example(r)
        tokens = candidates(text, base_spans(text))
        gold = [next((k for a, k, b in spans if a < t.end and t.start < b), OUTSIDE) for t in tokens]
        chain, skip = links(tokens)
        sides = np.zeros((3, len(tokens), n))
        for a, b in chain:
            sides[0, b, gold[a]] += 1
            sides[1, a, gold[b]] += 1
        for a, b in skip:
            sides[2, b, gold[a]] += 1
            sides[2, a, gold[b]] += 1
        x += [t.features() for t in tokens]
        y += gold
        for into, side in zip((before, after, twin), sides):
            into.extend(side)
    x, y = np.array(x, float), np.eye(n)[y]
    before, after, twin = map(np.array, (before, after, twin))
    w, c, s = np.zeros((x.shape[1], n)), np.zeros((n, n)), np.zeros((n, n))
    for _ in range(500):
        z = x @ w + before @ c + after @ c.T + twin @ s
        p = np.exp(z - z.max(1, keepdims=True))
        e = y - p / p.sum(1, keepdims=True)
        rate = 4 / len(y)
        w += rate * (x.T @ e) - 0.0005 * w
        c += rate * (before.T @ e + (after.T @ e).T) / 2 - 0.0005 * c
        g = twin.T @ e
        s += rate * (g + g.T) / 2 - 0.0005 * s
    return w, c, s


def infer(unary: np.ndarray, edges: np.ndarray, scores: np.ndarray | Tied, of: np.ndarray | None = None) -> np.ndarray:
    """Marginals by loopy sum-product: all messages of a round are sent at once, until they settle.

    ``of``: the text of each edge; without it all are one's. A text's messages stop on their own, so what
    else is in the batch makes no difference; at most it has as many rounds as edges (ROUNDS at least),
    which lets a label travel along its longest chain.
    """
    n, k = unary.shape
    of = np.zeros(len(edges), int) if of is None else of
    bound = np.maximum(ROUNDS, np.bincount(of)) if len(edges) else of
    to_right, to_left = np.zeros((len(edges), k)), np.zeros((len(edges), k))
    belief, live, turn = unary.copy(), np.arange(len(edges)), 0
    while len(live):
        turn += 1
        change = np.zeros(len(bound))
        for at in range(0, len(live), EDGES):  # all messages of a round go by the beliefs before it
            some = live[at : at + EDGES]
            first, second = edges[some].T
            right = _log_sum((belief[first] - to_left[some])[:, :, None] + scores[some])
            left = _log_sum((belief[second] - to_right[some])[:, :, None] + scores[some].transpose(0, 2, 1))
            right, left = right - right.max(1, keepdims=True), left - left.max(1, keepdims=True)
            np.maximum.at(change, of[some], np.maximum(abs(right - to_right[some]).max(1), abs(left - to_left[some]).max(1)))
            to_right[some], to_left[some] = right, left
        nodes = np.unique(edges[live])
        belief[nodes] = unary[nodes]
        np.add.at(belief, edges[live, 1], to_right[live])
        np.add.at(belief, edges[live, 0], to_left[live])
        live = live[((change > SETTLED) & (turn < bound))[of[live]]]
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Tied:
    """Scores of edges that share a few matrices: which one each has."""

    def __init__(self, matrices: np.ndarray, which: np.ndarray):
        self._matrices, self._which = matrices, which

    def __getitem__(self, edges: np.ndarray) -> np.ndarray:
        return self._matrices[self._which[edges]]


def _log_sum(v: np.ndarray) -> np.ndarray:
    top = v.max(1)
    return top + np.log(np.exp(v - top[:, None]).sum(1))


def find(texts: list[str], weights=None) -> list[tuple[list, list]]:
    """For each text its base spans and all its spans, as (start, kind, end); ``weights`` are the model's, trained here if not given.

    Texts are taken in slices of about SLICE characters, a long one by itself: texts don't depend on each other, and
    a slice needs about a kilobyte for each of its candidates.
    """
    weights, out, at = weights or model(), [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
            size += len(texts[end])
            end += 1
        out += _find(texts[at:end], weights)
        at = end
    return out


def _find(texts: list[str], weights) -> list[tuple[list, list]]:
    bases = [base_spans(t) for t in texts]
    tokens = [candidates(t, b) for t, b in zip(texts, bases)]
    alls = [list(b) for b in bases]
    flat = [t for ts in tokens for t in ts]
    if not flat:
        return list(zip(bases, alls))
    w, c, s = weights
    chains, skips, of, at = [], [], ([], []), 0
    for text, ts in enumerate(tokens):
        chain, skip = links(ts)
        of[0].extend([text] * len(chain))
        of[1].extend([text] * len(skip))
        chains += [(a + at, b + at) for a, b in chain]
        skips += [(a + at, b + at) for a, b in skip]
        at += len(ts)
    unary = np.concatenate([np.array([t.features() for t in flat[k : k + EDGES]], float) @ w for k in range(0, len(flat), EDGES)])
    edges = np.array(chains + skips, int).reshape(-1, 2)
    scores = Tied(np.stack([c, s]), np.repeat([0, 1], [len(chains), len(skips)]))
    beliefs = infer(unary, edges, scores, np.array(of[0] + of[1], int))
    labels, sure, at = beliefs.argmax(1), beliefs.max(1) >= BELIEF, 0
    for text, ts, base, found in zip(texts, tokens, bases, alls):
        runs: list[list[int]] = []
        for i, t in enumerate(ts, at):
            kind = int(labels[i])
            if t.base != OUTSIDE or kind == OUTSIDE or not sure[i]:
                continue
            if runs and runs[-1][1] == kind and kind in (2, 3) and t.start - runs[-1][2] <= 2:
                runs[-1][2] = t.end
            else:
                runs.append([t.start, kind, t.end])
        at += len(ts)
        found += [(a, k, b) for a, k, b in runs]
        found.sort()
    return list(zip(bases, alls))


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def report(docs: DataFrame) -> DataFrame:
    """Return doc_id, the base counts, base_sha256 and all spans of each whole text.

    One row per input row; null counts as empty, which has no spans and the digest of nothing;
    repeated rows give repeated results; other columns are not read. Nothing is shuffled.
    """

    weights = model()

    def rows(texts):
        out = []
        for base, spans in find([t or "" for t in texts], weights):
            counts = [sum(k == i for _, k, _ in base) for i in range(4)]
            out.append({f"n_{KINDS[i]}": counts[i] for i in range(4)} | {"base_sha256": hashlib.sha256(_told(base).encode()).hexdigest(), "spans": _told(spans)})
        return out

    found = S.text_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", rows)
    return docs.select("doc_id", found("text").alias("r")).select("doc_id", "r.*")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets and n_chars brought up to date.

    Overlapping spans are replaced together by the kind of the first. Null texts stay null, repeated rows are
    treated alike, an empty table stays empty; ``n_chars`` is set anew only if there is such a column.
    """
    weights = model()

    def rows(texts):
        out = []
        for text, (_, spans) in zip(texts, find([t or "" for t in texts], weights)):
            parts, done = [], 0
            for start, kind, end in spans:
                if start >= done:
                    parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
                done = max(done, end)
            out.append({"v": text if not spans else "".join(parts) + text[done:]})
        return out

    clean = docs.withColumn("text", S.text_udf("v string", rows)("text")["v"])
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def op5_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all whole texts; ``report`` says what becomes of nulls and repeated rows, an empty table gives no rows."""
    return report(S.table(spark, sf_dir, "documents"))
