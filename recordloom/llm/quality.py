"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled documents are described by bounded statistics
of the whole text (kinds of characters, repetition, word shapes), cut into
bins. A linear model minimises the non-negative unbiased risk

    p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))

with the logistic loss, p being the share of positives among the unlabelled. p
is estimated from two samples too: the smallest ratio of what a first model
accepts of the unlabelled to what it accepts of the positives. Each part of the
samples is judged by a model of the other parts. Such cross-fitted values also
calibrate the scores: slope and shift of the model's values minimise the same
risk, so the mean score of the unlabelled is p.

The model is fitted on bounded samples (``positives`` and ``unlabelled`` rows
with the smallest hashes of their ids); every document is scored where it is
read, in one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.text import texts_of

BINS = 10
FOLDS, HELD = 4, 2
PARTS = 5
CUTS = np.linspace(0.02, 0.25, 24)

#: Kinds of bytes: lower case, upper case, digit, blank, line end, sentence marks, brackets and quotes, other ASCII marks, above ASCII.
_KIND = np.full(256, 8, np.uint8)
_KIND[:128] = 7
for _k, _chars in enumerate(
    ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "()[]{}\"'")
):
    _KIND[[ord(c) for c in _chars]] = _k

FEATURES = (
    "lower", "upper", "digit", "blank", "line", "stop", "bracket", "mark", "high", "bang", "words", "word_length",
    "distinct", "top_word", "same_again", "period_again", "upper_words", "marked_words", "long_words", "short_words",
    "lines_again", "line_words", "triples_again", "worst_upper", "worst_mark", "worst_again",
)


def describe(text: str | None) -> list[float]:
    """The statistics of one whole text; a null or empty one has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    data = text.encode()
    kinds = _KIND[np.frombuffer(data, np.uint8)]
    counts = np.bincount(kinds, minlength=9) / len(data)
    words = text.split()
    n = max(1, len(words))
    many = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(map(str.__eq__, words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2)
    upper = marked = long = short = 0
    for word, times in many.items():
        size = len(word)
        upper += times * (size > 1 and word.isupper())
        marked += times * (not word[-1].isalnum() and word[-1] not in ".,;:)\"'")
        long += times * (size > 20)
        short += times * (size < 4)
    # The worst of 16 equal parts tells of junk in an else sound text.
    edges = np.linspace(0, len(kinds), min(16, 1 + len(kinds) // 200) + 1).astype(int)
    parts = [np.bincount(kinds[a:b], minlength=9) / max(1, b - a) for a, b in zip(edges[:-1], edges[1:])]
    steps = np.linspace(0, len(words), min(16, 1 + len(words) // 40) + 1).astype(int)
    worst_again = max(1 - len(set(words[a:b])) / max(1, b - a) for a, b in zip(steps[:-1], steps[1:]))
    return [
        *counts.tolist(), data.count(b"!") / len(data), np.log1p(len(words)), sum(map(len, words)) / n, len(many) / n,
        max(many.values(), default=0) / n, again / n, sum(w[-1] in ".!?" for w in words) / n, upper / n, marked / n,
        long / n, short / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), 1 - triples,
        max(p[1] for p in parts), max(p[7] for p in parts), worst_again,
    ]


class Model:
    """Binned statistics and one weight a bin."""

    def __init__(self, table: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in table.T] if len(table) else []
        self.starts = np.cumsum([0] + [len(e) + 1 for e in self.edges])
        self.weights = np.zeros(self.starts[-1])
        self.offset = 0.0
        self.slope, self.shift = 1.0, 0.0

    def bins(self, table: np.ndarray) -> np.ndarray:
        return np.stack(
            [s + np.searchsorted(e, c, side="right") for s, e, c in zip(self.starts, self.edges, table.T)], axis=1
        )

    def raw(self, table: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(table), self.offset)
        return self.weights[self.bins(table)].sum(axis=1) + self.offset

    def scores(self, column: pa.Array) -> np.ndarray:
        table = np.array([describe(t) for t in texts_of(column)], float).reshape(len(column), len(FEATURES))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(table) + self.shift, -30, 30)))

    def gradient(self, places: np.ndarray, n: int, prior: float) -> np.ndarray:
        """Of the non-negative risk by weights and offset; the first ``n`` rows are the positives.

        Where the second term is negative, it is the gradient that raises that term.
        """
        raw = np.clip(self.weights[places].sum(axis=1) + self.offset, -30, 30)
        high, slope = np.logaddexp(0, raw), 1 / (1 + np.exp(-raw))  # loss as a negative and its derivative
        pull = np.concatenate([-prior * slope[:n], slope[n:]])
        if high[n:].mean() >= prior * high[:n].mean():
            pull[:n] += prior * (slope[:n] - 1)
        else:
            pull = -pull
        pull[:n] /= n
        pull[n:] /= len(raw) - n
        return np.append(np.bincount(places.ravel(), np.repeat(pull, places.shape[1]), len(self.weights)), pull.sum())

    def fit(self, good: np.ndarray, mixed: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.05, keep: float = 1e-4):
        """Minimise the non-negative risk by Adam; where its second term is negative, step back on it."""
        places = np.concatenate([self.bins(good), self.bins(mixed)])
        first, second = np.zeros(len(self.weights) + 1), np.zeros(len(self.weights) + 1)
        for t in range(1, rounds + 1):
            step = self.gradient(places, len(good), prior)
            step[:-1] += keep * self.weights
            first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
            move = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            self.weights -= move[:-1]
            self.offset -= move[-1]
        return self


def ratios(model: Model, good: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """What share of the unlabelled lies above a cut for each positive's share that does, by cuts.

    Cuts accept at least three quarters of the positives: the fewer are accepted, the noisier is a ratio.
    A cut is one of ``n`` positives itself, so of ``k`` from it on the expected share is k / (n + 1).
    """
    p, u = np.sort(model.raw(good)), np.sort(model.raw(mixed))
    cuts = [p[int(share * (len(p) - 1))] for share in CUTS]
    return np.array([(u >= cut).mean() * (len(p) + 1) / (p >= cut).sum() for cut in cuts])


def estimate_prior(model: Model, good: np.ndarray, mixed: np.ndarray) -> float:
    """The smallest ratio, which is the share of positives where some cut accepts nothing else."""
    return prior_of([ratios(model, good, mixed)])


def prior_of(parts: list[np.ndarray]) -> float:
    """The smallest of the parts' mean ratios; each part's own smallest would be too small by chance."""
    return float(np.clip(np.mean(parts, axis=0).min(), 0.05, 0.98))


def calibration(good: np.ndarray, mixed: np.ndarray, prior: float, keep: float = 0.01) -> tuple[float, float]:
    """Slope and shift of values of positives and unlabelled with the least risk, by Newton's steps.

    With the logistic loss the unbiased risk is mean(log(1 + e^x)) of the
    unlabelled less ``prior`` times the mean of the positives' x: convex, and least
    by the shift where the unlabelled's mean score is ``prior``. ``keep`` holds the
    slope near 1, for values that part the classes perfectly would let it grow for ever.
    """
    slope, shift = 1.0, 0.0
    for _ in range(200):
        share = 1 / (1 + np.exp(-np.clip(slope * mixed + shift, -30, 30)))
        curve = share * (1 - share)
        pull = np.array([(share * mixed).mean() - prior * good.mean() + keep * (slope - 1), share.mean() - prior])
        cross = (curve * mixed).mean()
        bend = np.array([[(curve * mixed**2).mean() + keep, cross], [cross, curve.mean() + 1e-6]])
        move = np.linalg.solve(bend, pull)
        longest = np.abs(move).max()
        slope, shift = np.array([slope, shift]) - move * min(1.0, 1 / max(longest, 1e-12))
        if longest < 1e-9:
            break
    return float(max(slope, 0.0)), float(shift)


def learn(good: np.ndarray, mixed: np.ndarray, good_ids: np.ndarray, mixed_ids: np.ndarray) -> Model:
    """A model of two samples' statistics, its prior and its calibration cross-fitted.

    A document that is in both samples is in the same part of both. Without rows
    on a side every value is 1; where some part leaves a side empty, the prior is
    0.5 and nothing is calibrated.
    """
    table = np.concatenate([good, mixed])
    model = Model(table)
    if not len(good) or not len(mixed):
        model.offset = 1.0
        return model
    ids, at = np.unique(np.concatenate([good_ids, mixed_ids]), return_inverse=True)
    part = (np.random.default_rng(9).permutation(len(ids)) % PARTS)[at]  # shuffled: ids may follow a pattern
    p, u = part[: len(good)], part[len(good) :]
    if any(not side.any() or side.all() for k in range(PARTS) for side in (p == k, u == k)):
        return model.fit(good, mixed, 0.5)
    first = [Model(table).fit(good[p != k], mixed[u != k], 0.5) for k in range(PARTS)]
    prior = prior_of([ratios(m, good[p == k], mixed[u == k]) for k, m in enumerate(first)])
    of_good, of_mixed = np.zeros(len(good)), np.zeros(len(mixed))
    for k in range(PARTS):
        other = Model(table).fit(good[p != k], mixed[u != k], prior)
        of_good[p == k], of_mixed[u == k] = other.raw(good[p == k]), other.raw(mixed[u == k])
    model.fit(good, mixed, prior)
    model.slope, model.shift = calibration(of_good, of_mixed, prior)
    return model


def _described(docs: DataFrame, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(t) for t in texts_of(batch.column(batch.num_columns - 1))]
            table = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], table], [*batch.schema.names[:-1], "features"])

    return docs.mapInArrow(run, f"{schema}, features array<double>")


def held_out(folds: int, held: int):
    """Rows whose labels are never learned from: crc32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int = 6_000, unlabelled: int = 12_000) -> Model:
    """Fit on at most ``positives`` and ``unlabelled`` documents.

    Positives are labelled good and not held out. The unlabelled sample is drawn
    from all documents, their labels unseen, so it is what the corpus is, however
    many of them have labels. Of the rows of one id the least text counts.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    ids = docs.select("doc_id").dropna().distinct()
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    good = known.filter((F.col("quality") == 1) & ~held_out(FOLDS, HELD)).select("doc_id").distinct()
    good = ids.join(good, "doc_id", "left_semi").orderBy(*by_hash).limit(positives)
    # Another order than the positives', of whom a fixed share would else come again.
    free = ids.orderBy(F.xxhash64(F.lit("unlabelled"), "doc_id"), "doc_id").limit(unlabelled)
    chosen = good.withColumn("good", F.lit(True)).union(free.withColumn("good", F.lit(False)))
    # One row of each chosen id, however often it is repeated: what the driver gets is bounded by the two limits.
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    found = _described(rows, "doc_id long, good boolean").orderBy("doc_id", "good", "features").toArrow()
    table = np.array(found.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
    mark = np.array(found.column("good").to_pylist(), bool)
    ids = np.array(found.column("doc_id").to_pylist(), np.int64)
    return learn(table[mark], table[~mark], ids[mark], ids[~mark])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, positives: int = 6_000, unlabelled: int = 12_000) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    ``score`` estimates the probability of label 1, calibrated to the estimated
    prior; ``predicted`` is 1 from ``threshold`` on. Texts alone are scored: no label, language, source or id.
    Whole texts are described, however long. Null and empty texts get the score of a text whose statistics are all 0.
    Null ids, repeated rows and ties keep their rows. With no positives or no
    documents to compare with, every score is the same, 0.73. Labels that are
    null, or of unknown documents, are ignored; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(train(docs, labels, positives, unlabelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores)], ["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), "text")
    scored = scored.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, positives: int = 6_000, unlabelled: int = 12_000
) -> DataFrame:
    """The rows of ``docs`` that :func:`score` predicts as 1, with all columns; no shuffle.

    Every row is judged by its own text: null ids and repeated rows stay or go
    like any other, null and empty texts like a text whose statistics are all 0,
    very long ones as a whole. Clashing columns are only passed on. An empty table
    gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, positives, unlabelled)
    )
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.scores(batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
