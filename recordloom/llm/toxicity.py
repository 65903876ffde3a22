"""Toxicity scores by nearest labelled examples.

The examples are a bounded sample of labelled documents; every word that any of
them holds is a term. Every document is compared with them by the exact cosine of
TF-IDF vectors over these terms (document frequencies are counted over all
documents; words that no example holds can't meet any). A term's weight is also
scaled by how clearly the examples' labels differ on it, never below 1, so that
telling words count more; no term is left out. The ``neighbours`` nearest
examples vote with weights that fall with distance. Logistic calibration, fitted
on the examples' votes without themselves, makes the weighted vote a probability;
the nearest examples are the evidence.

The index is inverted and cut into blocks of examples. The terms that most
examples hold lie in one small table a block, with the block's largest weight of
each; all others are posting lists. A query adds up its posting lists, which
gives each block a largest possible cosine: its best sum so far and the maxima of
the common terms. It visits blocks from the largest bound down and stops where no
block can improve its neighbours, which changes no result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import stored
from recordloom.llm.quality import held_out
from recordloom.llm.text import texts_of

FOLDS, HELD = 5, 0
BLOCK = 16
#: Terms with a column in the blocks' tables; the rest have posting lists.
COMMON = 256
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def tally(text: str | None, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Known terms of a whole text in ascending order, and how often each occurs."""
    found = {number[w]: n for w, n in Counter(words_of(text)).items() if w in number}
    terms = np.fromiter(found, np.int64, len(found))
    times = np.fromiter(found.values(), float, len(found))
    order = np.argsort(terms)
    return terms[order], times[order]


def telling(seen: np.ndarray, toxic: np.ndarray, examples: int, positives: int) -> np.ndarray:
    """Factor of each term: the deviations by which its count of toxic examples departs from chance, at least 1.

    ``seen`` and ``toxic`` count examples with the term, all and toxic ones. One
    is added to the variance, so that a rare term tells nothing by itself.
    """
    share = positives / max(1, examples)
    return np.maximum(1, np.abs(toxic - seen * share) / np.sqrt(seen * share * (1 - share) + 1))


class Index:
    """Blocks of examples: posting lists, and tables with maxima for the common terms.

    Terms are numbered by falling count of examples; ``scale`` is what a term
    weighs before its frequency in the text and the vector's length.
    """

    def __init__(self, ids: list[int], labels: list[int], tallies: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray):
        self.scale, self.common = scale, min(COMMON, len(scale))
        vectors = [self.vector(*t) for t in tallies]
        order = sorted(range(len(ids)), key=lambda k: (self._leading(*vectors[k]), labels[k], ids[k]))
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.labels = np.array([labels[k] for k in order], np.int64)
        self.vectors = [vectors[k] for k in order]
        self.blocks = -(-len(order) // BLOCK)
        self.tables = np.zeros((self.common, self.blocks, BLOCK))
        sizes = [len(t) for t, _ in self.vectors]
        terms = np.concatenate([t for t, _ in self.vectors] or [np.zeros(0, np.int64)])
        weights = np.concatenate([w for _, w in self.vectors] or [np.zeros(0)])
        who = np.repeat(np.arange(len(order)), sizes)
        head = terms < self.common
        self.tables[terms[head], who[head] // BLOCK, who[head] % BLOCK] = weights[head]
        self.most = self.tables.max(axis=2, initial=0)
        by_term = np.argsort(terms[~head], kind="stable")
        self.who, self.weights = who[~head][by_term].astype(np.int32), weights[~head][by_term]
        self.start = np.searchsorted(terms[~head][by_term], np.arange(len(scale) + 1))

    def _leading(self, terms: np.ndarray, weights: np.ndarray) -> int:
        """The common term of the largest weight: examples that share it lie together."""
        head = int(np.searchsorted(terms, self.common))
        return int(terms[np.argmax(weights[:head])]) if head else -1

    def vector(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their weights, of length 1."""
        weights = (1 + np.log(times)) * self.scale[terms]
        return terms, weights / np.sqrt((weights**2).sum()) if len(terms) else weights

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest positive cosine, ties to the first in index order, and the cosines."""
        if not len(terms) or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        head = int(np.searchsorted(terms, self.common))
        rare, start = terms[head:], self.start
        sizes = start[rare + 1] - start[rare]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[rare] - (ends - sizes), sizes)
        sums = np.bincount(self.who[at], self.weights[at] * np.repeat(weights[head:], sizes), self.blocks * BLOCK)
        sums = sums.astype(float).reshape(self.blocks, BLOCK)
        bound, common, weights = sums.max(axis=1), terms[:head], weights[:head]
        if head:
            bound += weights @ self.most[common]
        order = np.argsort(-bound, kind="stable")
        bound, done, until, least = bound[order], 0, -(-k // BLOCK) + 3, 0.0
        cosines: list[np.ndarray] = []
        while done < until:
            here = order[done:until]
            more = weights @ self.tables[common[:, None], here].reshape(head, len(here) * BLOCK) if head else 0.0
            cosines.append(sums[here].ravel() + more)
            # Most blocks are settled by the first look; what the next one brings only raises the bar.
            done, every = min(until, len(order)), np.concatenate(cosines)
            least = max(1e-12, float(np.partition(every, -k)[-k]) - 1e-12) if len(every) >= k else 1e-12
            hopeful = int(np.searchsorted(-bound, -least, side="right"))
            until = min(hopeful, done + max(8, (hopeful - done) // 2)) if hopeful > done else done
        places = (order[:done, None] * BLOCK + np.arange(BLOCK)).ravel()
        near = np.nonzero(every >= least)[0]
        near = near[np.lexsort((places[near], -np.round(every[near], 12)))][:k]
        return places[near], every[near]


class Scorer:
    """Distance-weighted votes over the index, calibrated."""

    def __init__(self, index: Index, neighbours: int, shares: tuple[float, float], without_terms: float):
        self.index, self.neighbours, self.without_terms = index, neighbours, without_terms
        self.base = shares[1] / max(1e-9, sum(shares))
        self.slope, self.shift = 4.0, -2.0

    def vote_without(self, k: int) -> float:
        """The vote on example ``k`` of all others."""
        found, cosines = self.index.nearest(*self.index.vectors[k], self.neighbours + 1)
        return self._vote(found[found != k], cosines[found != k])

    def _vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        found, cosines = found[: self.neighbours], cosines[: self.neighbours]
        # Falls with distance, finite for equal texts; the base rate has the say of a faint likeness.
        pull = cosines / (1.05 - np.minimum(cosines, 1))
        return float(((pull * self.index.labels[found]).sum() + 0.1 * self.base) / (pull.sum() + 0.1))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, shares: tuple[float, float]) -> None:
        """Logistic fit of labels on votes, classes weighted as among all labelled rows; Newton's steps."""
        sizes = np.bincount(labels, minlength=2)
        if not sizes.all():
            return
        weight = np.array([shares[k] / sizes[k] for k in (0, 1)])[labels]
        weight = weight / weight.mean()
        table = np.stack([votes, np.ones(len(votes))], axis=1)
        theta = np.array([self.slope, self.shift])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(table @ theta, -30, 30)))
            slope = table.T @ (weight * (p - labels)) + 0.01 * theta
            curve = (table * (weight * p * (1 - p))[:, None]).T @ table + 0.01 * np.eye(2)
            theta = theta - np.clip(np.linalg.solve(curve, slope), -4, 4)
        if theta[0] > 0:
            self.slope, self.shift = theta.tolist()

    def score(self, terms: np.ndarray, times: np.ndarray) -> tuple[float, list[int]]:
        found, cosines = self.index.nearest(*self.index.vector(terms, times), self.neighbours)
        if not len(found):
            return self.without_terms, []
        raw = self.slope * self._vote(found, cosines) + self.shift
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30)))), self.index.ids[found[:3]].tolist()


def _examples(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """At most ``per_label`` distinct texts of either label, none of them held out."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(FOLDS, HELD))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    present = docs.select("doc_id").dropna().distinct()
    known = stored(known.join(present, "doc_id", "left_semi"), "toxic-known")
    picked = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for k in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_label rows
    rows = docs.join(chosen, "doc_id").filter("text is not null")
    rows = rows.groupBy("text").agg(F.min_by(F.struct("doc_id", "label"), "doc_id").alias("e"))
    return stored(rows.select("e.doc_id", "e.label", "text"), "toxic-examples"), known


def fit(docs: DataFrame, labels: DataFrame, per_label: int, neighbours: int) -> tuple[list[str], Scorer]:
    """Terms and scorer; the driver receives the words of at most ``2 * per_label`` examples.

    The examples' votes without themselves, for the calibration, are taken in tasks.
    """
    examples, known = _examples(docs, labels, per_label)
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                found = list(set(words_of(text)))
                marks = pa.array(np.full(len(found), label, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), marks], ["term", "label"])

    seen = examples.select("label", "text").mapInArrow(each, "term string, label int").groupBy("term")
    seen = seen.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("a")).orderBy(F.desc("n"), "term").toArrow()
    terms = seen.column("term").to_pylist()
    factor = telling(
        *(seen.column(c).to_numpy().astype(float) for c in ("n", "a")), sum(sizes.values()), sizes.get(1, 0)
    )
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = shared.value, 0
        sums = np.zeros(len(number), np.int64)
        for batch in batches:
            rows += batch.num_rows
            for text in texts_of(batch.column(0)):
                found = [k for k in map(number.get, set(words_of(text))) if k is not None]
                sums[found] += 1
        here = np.append(np.nonzero(sums)[0], -1)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(np.append(sums[here[:-1]], rows))], ["term", "n"])

    counted = docs.select("text").mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    number, times = (counted.column(c).to_numpy() for c in ("term", "n"))  # one row a term of the examples
    every = int(times[number < 0].sum())
    df = np.ones(len(terms))
    df[number[number >= 0]] = times[number >= 0]
    scale = np.log((1 + every) / df) * factor

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tally(t, shared.value) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.list_(pa.int64())),
                 pa.array([n for _, n in found], pa.list_(pa.float64()))],
                ["doc_id", "label", "terms", "times"],
            )

    rows = examples.select("doc_id", "label", "text").mapInArrow(
        tallied, "doc_id long, label int, terms array<long>, times array<double>"
    ).orderBy("doc_id", "label").toArrow().combine_chunks()
    ids, marks = rows.column("doc_id").to_pylist(), rows.column("label").to_pylist()
    tallies = [(t.values.to_numpy(), n.values.to_numpy()) for t, n in zip(rows.column("terms"), rows.column("times"))]
    index = Index(ids, marks, tallies, scale)
    shares = (float(totals.get(0, 0)), float(totals.get(1, 0)))
    bare = [sum(not len(t) and m == k for (t, _), m in zip(tallies, marks)) * shares[k] / max(1, sizes.get(k, 0)) for k in (0, 1)]
    scorer = Scorer(index, neighbours, shares, (bare[1] + 0.5) / (sum(bare) + 2))
    raw = docs.sparkSession.sparkContext.broadcast(scorer)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [raw.value.vote_without(k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["k", "vote"])

    spread = docs.sparkSession.range(0, len(index.ids), 1, -(-len(index.ids) // 256) or 1)
    cast = spread.mapInArrow(votes, "k long, vote double").orderBy("k").toArrow()  # one number an example
    scorer.calibrate(cast.column("vote").to_numpy(), index.labels, shares)
    raw.unpersist()
    shared.unpersist()
    return terms, scorer


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_label: int = 2_000, neighbours: int = 15) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``, ``evidence``.

    ``score`` estimates the probability of label 1, ``predicted`` is 1 from
    ``threshold`` on and ``evidence`` lists the ids of up to three nearest
    examples. Only texts are compared. Whole texts are used, however long. A
    document that shares no word with any example, null and empty ones included,
    gets the share of label 1 among such examples and no evidence. Null ids,
    repeated rows and ties keep their rows; equally near examples count in
    index order. Examples of equal texts count once. Null labels and labels of
    unknown documents are ignored. Without labels every score is the same. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms, scorer = fit(docs, labels, per_label, neighbours)
    model = spark.sparkContext.broadcast(({t: k for k, t in enumerate(terms)}, scorer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, scorer = model.value
        for batch in batches:
            found = [scorer.score(*tally(t, number)) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))],
                ["doc_id", "held_out", "score", "evidence"],
            )

    scored = docs.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), "text")
    scored = scored.mapInArrow(run, "doc_id long, held_out boolean, score double, evidence array<long>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_label: int = 2_000, neighbours: int = 15) -> DataFrame:
    """The rows of ``docs`` that :func:`score` predicts as 0, with all columns; no shuffle.

    Every row is judged by its own text: null ids and repeated rows stay or go
    like any other, null and empty texts by the share above. A clashing column
    of ``docs`` is only passed on. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms, scorer = fit(texts, labels, per_label, neighbours)
    model = docs.sparkSession.sparkContext.broadcast(({t: k for k, t in enumerate(terms)}, scorer))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, scorer = model.value
        for batch in batches:
            keep = [scorer.score(*tally(t, number))[0] < threshold for t in texts_of(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
