"""A quality classifier by co-training (operator 6).

One logistic model sees the text: its words and pairs of words, hashed, whose log-odds by naive Bayes are
summed up, and shares of character classes and repeats. The other sees the metadata: source, language, length.
Round after round each labels the documents it is surest of by odds calibrated on labelled rows kept for that, a larger part of all unlabelled ones each time, and hands
them to the other, which is fitted again on the labelled rows and on these, which weigh at most as much as those in all. Both are
then calibrated on labelled rows held out from all of that, and their calibrated odds are added, less the prior's.

At most ``LABELLED`` labelled rows, those of least hash, come to the driver; all other documents are the pool,
without a bound. What a fit needs of the pool are sums over it: histograms of the odds, which give the thresholds,
and the models' gradients and curvatures. They are added up in the tasks and by a shuffle,
and their size does not depend on the number of documents. Every document is scored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import _shared as S
from leakloom.llm.minhash_dedup import _mixed, _words
from leakloom.llm.quality_rules import class_counts, repeated_lines

LABELLED = 6_000
#: Rounds, the part of the pool that each view hands over in the first of them, and the least odds for that.
ROUNDS, HANDED, SURE = 3, 0.05, 1.5
#: Steps of each fit over the pool, bins of the odds' histograms, which reach from -LIMIT to LIMIT.
STEPS, BINS, LIMIT = 2, 4096, 30.0
#: Added to each row's curvature, so that steps stay small where a model is sure of everything.
FLAT = 0.02
#: A document is kept from this score on.
KEEP = 0.5
SOURCES, LANGUAGES = 64, 16
#: Hashed words and pairs, as a power of two, and what each count starts from.
WORD_BITS, SMOOTH, FOLDS = 14, 0.5, 8


def text_view(text: str | None) -> tuple[list[float], np.ndarray]:
    """Shares of character classes, how varied and how long words and lines are; and the distinct hashed words and pairs."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    shouted = sum(w.isupper() and len(w) > 1 for w in words)
    shares = [
        *(class_counts(data) / max(1, len(data))), sum(map(len, words)) / n / 10, len(counts) / n, max(counts.values(), default=0) / n,
        sum(k * k for k in counts.values()) / n / n, repeated_lines(data) / max(1, len(lines)), shouted / n, data.count(b"!") / n, data.count(b"|") / n,
        np.log1p(len(words)) / 10, np.log1p(len(data) / max(1, len(lines))) / 10, float(len(words) < 50), np.log(max(len(counts), 1)) / max(np.log(n), 1),
    ]
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    pairs = _mixed(h[:-1] * np.uint64(0x8CB92BA72F3D8DD7) + h[1:])
    hashed = np.unique(np.concatenate([_mixed(h), pairs]) >> np.uint64(64 - WORD_BITS)).astype(np.uint16)
    return shares, hashed


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """Hashed source and language, and the length on several scales; nulls have places of their own."""
    out = [0.0] * (SOURCES + LANGUAGES + 12)
    out[zlib.crc32(("" if source is None else "=" + source).encode()) % SOURCES] = 1.0
    out[SOURCES + zlib.crc32(("" if lang is None else "=" + lang).encode()) % LANGUAGES] = 1.0
    size = np.log1p(max(0, n_chars or 0))
    out[SOURCES + LANGUAGES] = size / 10
    out[SOURCES + LANGUAGES + 1 + min(10, int(size))] = 1.0
    return out


N_SHARES, N_META = len(text_view("")[0]), len(meta_view(None, None, 0))


class Rows:
    """Some documents' views: shares, hashed words of all one after another with their ends, metadata."""

    def __init__(self, shares, words, metas):
        self.shares = np.array([np.frombuffer(x, np.float32) for x in shares], float).reshape(-1, N_SHARES)
        self.metas = np.array([np.frombuffer(x, np.float32) for x in metas], float).reshape(-1, N_META)
        parts = [np.frombuffer(x, np.uint16) for x in words]
        self.n = np.array([len(p) for p in parts], int)
        self.words = np.concatenate(parts).astype(int) if parts else np.zeros(0, int)

    def __len__(self):
        return len(self.shares)

    def take(self, keep: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        out.shares, out.metas, out.n = self.shares[keep], self.metas[keep], self.n[keep]
        out.words = self.words[np.repeat(keep, self.n)]
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of one value a word, each document's sum."""
        ends = np.concatenate([[0], np.cumsum(values)])
        at = np.concatenate([[0], np.cumsum(self.n)])
        return ends[at[1:]] - ends[at[:-1]]


def word_odds(rows: Rows, y: np.ndarray) -> np.ndarray:
    """Log-odds of each hashed word by naive Bayes over documents that hold it."""
    out = np.zeros(1 << WORD_BITS)
    for k in (0, 1):
        keep = y == k
        held = np.bincount(rows.words, np.repeat(keep, rows.n), 1 << WORD_BITS)
        out += (1, -1)[k == 0] * (np.log(held + SMOOTH) - np.log(keep.sum() + 2 * SMOOTH))
    return out


class Model:
    """A logistic model; the text's has two more inputs, the words' log-odds by naive Bayes, mean and scaled sum.

    The words' odds come from the labelled rows, whose own inputs have them from the other folds only, so
    that a row's label isn't told by its own words.
    """

    def __init__(self, view: int):
        self.view = view  # 0 text, 1 metadata
        self.words = np.zeros(1 << WORD_BITS)
        self.w = np.zeros((N_SHARES + 3 if view == 0 else N_META + 1))
        self.mean, self.scale = np.zeros(len(self.w) - 1), np.ones(len(self.w) - 1)

    @staticmethod
    def told_by_words(rows: Rows, odds: np.ndarray) -> np.ndarray:
        s, n = rows.sums(odds[rows.words]), np.maximum(rows.n, 1)
        return np.stack([s / n, s / np.sqrt(n) / 10], 1)

    def learn_words(self, rows: Rows, y: np.ndarray) -> None:
        """The odds of words from labelled rows, and these rows' inputs by folds."""
        self.words = word_odds(rows, y)
        fold = np.arange(len(y)) % FOLDS
        self.by_folds = np.zeros((len(y), 2))
        for f in range(FOLDS):
            self.by_folds[fold == f] = self.told_by_words(rows.take(fold == f), word_odds(rows.take(fold != f), y[fold != f]))

    def raw(self, rows: Rows, labelled: bool = False) -> np.ndarray:
        if self.view:
            return rows.metas
        return np.hstack([rows.shares, self.by_folds if labelled else self.told_by_words(rows, self.words)])

    def inputs(self, rows: Rows, labelled: bool = False) -> np.ndarray:
        x = self.raw(rows, labelled)
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def odds(self, rows: Rows) -> np.ndarray:
        return np.clip(self.inputs(rows) @ self.w, -LIMIT, LIMIT)

    def standardise(self, rows: Rows) -> None:
        x = self.raw(rows, True)
        self.mean, spread = x.mean(0), x.std(0)
        self.scale = np.where(spread < 1e-9, 1.0, spread + 1e-9)

    def newton(self, rows: Rows, y: np.ndarray, weight: float = 1.0, labelled: bool = False) -> np.ndarray:
        """Gradient and curvature of the weighted log-likelihood, in one matrix."""
        z = self.inputs(rows, labelled)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -LIMIT, LIMIT)))
        return weight * np.hstack([(z.T @ (y - p))[:, None], (z * (p * (1 - p) + FLAT)[:, None]).T @ z])

    def step(self, sums: np.ndarray, ridge: float = 1.0) -> None:
        self.w = self.w + np.linalg.solve(sums[:, 1:] + ridge * np.eye(len(self.w)), sums[:, 0] - ridge * self.w)


class Calibration:
    """Odds to calibrated odds, by logistic regression on held-out rows."""

    def __init__(self, odds: np.ndarray, y: np.ndarray):
        self.a, self.b = 1.0, 0.0
        if len(set(y.tolist())) < 2:
            return
        x, w = np.stack([odds, np.ones(len(odds))], 1), np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -LIMIT, LIMIT)))
            w = w + np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (y - p) - 0.1 * (w - [1.0, 0.0]))
        self.a, self.b = w.tolist()

    def __call__(self, odds: np.ndarray) -> np.ndarray:
        return np.clip(self.a * odds + self.b, -LIMIT, LIMIT)


class CoTrained:
    """Two models, their calibrations and the prior."""

    def __init__(self, models: list[Model], calibrations: list[Calibration], prior: float):
        self.models, self.calibrations, self.prior = models, calibrations, prior

    def score(self, rows: Rows) -> list[np.ndarray]:
        """Probabilities by text, by metadata, and by both."""
        odds = [c(m.odds(rows)) for m, c in zip(self.models, self.calibrations)]
        return [1 / (1 + np.exp(-np.clip(o, -LIMIT, LIMIT))) for o in (*odds, odds[0] + odds[1] - self.prior)]


def _made(texts, sources, rest) -> Rows:
    views = [text_view(t) for t in texts]
    metas = [np.array(meta_view(s, r["lang"], r["n_chars"]), np.float32).tobytes() for s, r in zip(sources, rest)]
    return Rows([np.array(v[0], np.float32).tobytes() for v in views], [v[1].tobytes() for v in views], metas)


def _views(docs: DataFrame) -> DataFrame:
    """doc_id and the three views, as bytes: a few hundred a document."""

    def rows(texts, sources, rest):
        out = []
        for t, s, r in zip(texts, sources, rest):
            shares, words = text_view(t)
            out.append({"shares": np.array(shares, np.float32).tobytes(), "words": words.tobytes(), "meta": np.array(meta_view(s, r["lang"], r["n_chars"]), np.float32).tobytes()})
        return out

    rest = F.struct("lang", F.col("n_chars").cast("long").alias("n_chars"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), S.text_udf("shares binary, words binary, meta binary", rows, 3)("text", "source", rest).alias("v")).select("doc_id", "v.*")


def _summed(pool: DataFrame, of) -> tuple[np.ndarray, np.ndarray]:
    """The sum of ``of(rows)``, an array of fixed size, over all rows of the pool: places and values that aren't zero."""

    def tasks(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(Rows(*(batch[c].to_pylist() for c in ("shares", "words", "meta"))))
                total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at].astype(float), pa.float64())], ["at", "value"])

    out = {r["at"]: r["value"] for r in pool.mapInArrow(tasks, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    return np.array(list(out)), np.array(list(out.values()))


def _filled(found: tuple[np.ndarray, np.ndarray], shape: tuple) -> np.ndarray:
    out = np.zeros(int(np.prod(shape)))
    if len(found[0]):
        out[found[0].astype(int)] = found[1]
    return out.reshape(shape)


def _bins(odds: np.ndarray) -> np.ndarray:
    return np.bincount(np.clip(((odds + LIMIT) / (2 * LIMIT) * BINS).astype(int), 0, BINS - 1), minlength=BINS)


def _threshold(bins: np.ndarray, wanted: float, above: bool, prior: float) -> float:
    """The odds beyond which at most ``wanted`` rows lie, by whole bins; never nearer than SURE to even nor to the prior, which a view that knows nothing would give to all."""
    beyond = np.cumsum(bins[::-1])[::-1] if above else np.cumsum(bins)
    edges = np.linspace(-LIMIT, LIMIT, BINS + 1)
    good = np.flatnonzero(beyond <= wanted)
    if above:
        return max(SURE, prior + SURE, edges[good[0]] if len(good) else np.inf)
    return min(-SURE, prior - SURE, edges[good[-1] + 1] if len(good) else -np.inf)


def fit(docs: DataFrame, labels: DataFrame, views: DataFrame, seed: int = 3) -> CoTrained | None:
    """Fit on the labelled rows and the pool; rows with a null id or label are no labelled ones, of several labels the mean counts from a half on."""
    spark = docs.sparkSession
    clear = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    sample = [(r["doc_id"], r["y"]) for r in clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).collect()]
    if len({y for _, y in sample}) < 2:
        return None
    known = F.broadcast(spark.createDataFrame(sample, "doc_id long, y double"))
    got = sorted(views.join(known, "doc_id").dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    rows = Rows(*([bytes(r[c]) for r in got] for c in ("shares", "words", "meta")))
    part = np.random.default_rng(seed).permutation(len(y)) % 8
    held, judging = part == 0, part == 1  # for the last calibration, and for that of what is handed over
    seen, told = rows.take(part > 1), y[part > 1]
    if len(set(told.tolist())) < 2:
        return None
    prior = float(np.log(told.mean() / (1 - told.mean())))
    models = [Model(0), Model(1)]
    models[0].learn_words(seen, told)
    for m in models:
        m.standardise(seen)
        for _ in range(10):
            m.step(m.newton(seen, told, labelled=True))
    judges = rows.take(judging)
    pool = views.join(known, "doc_id", "left_anti")
    for turn in range(ROUNDS):
        now = [(_copy(m), Calibration(m.odds(judges), y[judging])) for m in models]
        bins = _filled(_summed(pool, lambda r, now=now: np.concatenate([_bins(c(m.odds(r))) for m, c in now])), (2, BINS))
        n = bins[0].sum()
        if not n:
            break
        wanted, edges = HANDED * (turn + 1) * n, np.linspace(-LIMIT, LIMIT, BINS + 1)
        cut = [(_threshold(b, wanted * told.mean(), True, prior), _threshold(b, wanted * (1 - told.mean()), False, prior)) for b in bins]
        handed = [b[edges[:-1] >= high].sum() + b[edges[1:] <= low].sum() for b, (high, low) in zip(bins, cut)]
        weight = [min(1.0, len(told) / h) if h else 0.0 for h in handed]
        for _ in range(STEPS):
            at = [_copy(m) for m in models]

            def steps(r: Rows, at=at, now=now, cut=cut, weight=weight) -> np.ndarray:
                """What each model learns from what the other hands to it."""
                out = []
                for m in at:
                    (other, calibrated), (high, low) = now[1 - m.view], cut[1 - m.view]
                    odds = calibrated(other.odds(r))
                    sure = (odds >= high) | (odds <= low)
                    out.append(m.newton(r.take(sure), (odds[sure] >= high).astype(float), weight[1 - m.view]).ravel())
                return np.concatenate(out)

            sizes = [len(m.w) * (len(m.w) + 1) for m in models]
            sums = _filled(_summed(pool, steps), (sum(sizes),))
            for m, part in zip(models, np.split(sums, [sizes[0]])):
                m.step(part.reshape(len(m.w), -1) + m.newton(seen, told, labelled=True))
    kept = rows.take(held)
    calibrations = [Calibration(m.odds(kept), y[held]) for m in models]
    return CoTrained([_copy(m) for m in models], calibrations, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))


def _copy(m: Model) -> Model:
    out = Model(m.view)
    out.__dict__.update({k: v.copy() if isinstance(v, np.ndarray) else v for k, v in m.__dict__.items() if k != "by_folds"})
    return out


def classify(docs: DataFrame, labels: DataFrame, into: str = "quality_score") -> DataFrame:
    """Add ``into``, a struct (text_score, meta_score, score, kept), to every document; a column of that name is replaced.

    Null texts count as empty, null metadata as a value of its own. Repeated rows are scored alike, a score of
    exactly KEEP is kept, an empty table stays empty. Without labels of both kinds nothing can be learnt: scores
    are null and all documents are kept.
    """
    fields = "text_score double, meta_score double, score double, kept boolean"
    trained = fit(docs, labels, S.checkpointed(_views(docs)))
    if trained is None:
        return docs.withColumn(into, F.from_json(F.lit('{"kept": true}'), fields))

    def rows(texts, sources, rest):
        if not texts:
            return []
        scores = trained.score(_made(texts, sources, rest))
        return [{"text_score": float(a), "meta_score": float(b), "score": float(c), "kept": bool(c >= KEEP)} for a, b, c in zip(*scores)]

    rest = F.struct("lang", F.col("n_chars").cast("long").alias("n_chars"))
    return docs.withColumn(into, S.text_udf(fields, rows, 3)("text", "source", rest))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, meta_score, score and kept of each row, as ``classify`` gives them; texts are read once."""
    views = S.checkpointed(_views(docs))
    trained = fit(docs, labels, views)
    fields = "text_score double, meta_score double, score double, kept boolean"
    if trained is None:
        return views.select("doc_id", F.from_json(F.lit('{"kept": true}'), fields).alias("r")).select("doc_id", "r.*")

    def rows(shares, words, metas):
        if not shares:
            return []
        found = trained.score(Rows(shares, words, metas))
        return [{"text_score": float(a), "meta_score": float(b), "score": float(c), "kept": bool(c >= KEEP)} for a, b, c in zip(*found)]

    return views.select("doc_id", S.text_udf(fields, rows, 3)("shares", "words", "meta").alias("r")).select("doc_id", "r.*")


def op6_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by two views; null texts count as empty, nulls in other columns as a value of their own, repeated rows are scored alike; without labels to learn from scores are null and all documents are kept."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return scores(docs, S.table(spark, sf_dir, "labels"))
