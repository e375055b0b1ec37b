"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary documents, discount their counts and back off to unigrams of the class and
these to continuation counts that both classes share, so that rare expressions weigh the same in both. A document's
features are differences of log-likelihoods, normalised by length: over all its words, over the square root of their
number, and over its TOP most telling words. A logistic curve, fitted on labelled documents that the models have not
seen, turns them into a probability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, for_python, label_sample, slices, table
from .words import coded_words, emitted, word_hashes

#: Labelled documents that the models are fitted on, about half of each class (chosen by a hash of the id); a documented
#: bound, as the models are broadcast. Of a class with fewer all are taken.
TRAIN_DOCS = 10_000
DISCOUNT, TOP, THRESHOLD = 0.75, 3, 0.3
START = 0


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def blocks() -> Iterator:
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = word_hashes(text)
                ones = np.full(len(w), y, np.int64)
                yield [np.concatenate([[START], w[:-1]]).astype(np.int64)[: len(w)], w], [ones, 1 - ones]

    return emitted(blocks(), ["h", "w", "toxic", "ordinary"])


class Model:
    """Arrays of both classes (row 0 ordinary, row 1 toxic), for look-ups by sorted hashes."""

    def __init__(self, pairs: pa.Table, contexts: pa.Table, words: pa.Table, totals: dict):
        self.contexts = contexts.column("h").to_numpy()
        order = np.argsort(self.contexts)
        self.contexts = self.contexts[order]
        each = lambda t, a, b: np.array([t.column(b).to_numpy(), t.column(a).to_numpy()], np.float32)
        self.seen = each(contexts, "toxic", "ordinary")[:, order]
        self.kept = each(contexts, "toxic_mass", "ordinary_mass")[:, order]
        self.words = words.column("w").to_numpy()
        order = np.argsort(self.words)
        self.words, self.counts, self.after = self.words[order], each(words, "toxic", "ordinary")[:, order], words.column("after").to_numpy()[order]
        code = self._code(*[pairs.column(c).to_numpy() for c in ("h", "w")])
        order = np.argsort(code)
        self.pairs, self.both = code[order], each(pairs, "toxic", "ordinary")[:, order]
        self.total = np.array([totals["ordinary"], totals["toxic"]], np.float64)
        self.mass = np.maximum(self.counts - DISCOUNT, 0).sum(axis=1, dtype=np.float64)
        self.types, self.follow = max(1, totals["types"]), max(1, totals["follow"])

    @staticmethod
    def _code(h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ w.view(np.uint64)).view(np.int64)

    @staticmethod
    def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
        return at, sorted_[at] == x

    def ratios(self, hashes: np.ndarray, codes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each word hashes[codes] as toxic, less that as ordinary: after the word `before` it, and alone."""
        if not len(codes):
            return np.zeros(0), np.zeros(0)
        at, known = self._find(self.words, hashes)
        count = np.where(known, self.counts[:, at], 0.0) if len(self.words) else np.zeros((2, len(hashes)))
        after = np.where(known, self.after[at], 0) if len(self.words) else np.zeros(len(hashes))
        shared = 0.9 * after / self.follow + 0.1 / self.types
        alone = (np.maximum(count - DISCOUNT, 0) + (self.total - self.mass)[:, None] * shared) / self.total[:, None]
        ratio = np.log(alone[1] / alone[0])[codes]
        alone = alone[:, codes]
        at, known = self._find(self.contexts, before)
        if len(self.contexts):
            seen, kept = np.where(known, self.seen[:, at], 0.0), np.where(known, self.kept[:, at], 0.0)
            pair, has = self._find(self.pairs, self._code(before, hashes[codes]))
            both = np.where(has, self.both[:, pair], 0.0)
            inside = (np.maximum(both - DISCOUNT, 0) + (seen - kept) * alone) / np.maximum(seen, 1)
            inside = np.where(seen > 0, inside, alone)
        else:
            inside = alone
        return np.log(inside[1] / inside[0]), ratio

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row of three for each text; zeros for one without words."""
        offsets, codes, hashes = coded_words(texts)
        words = hashes[codes]
        before = np.concatenate([[START], words[:-1]]).astype(np.int64)[: len(words)]
        sizes = np.diff(offsets)
        before[offsets[:-1][sizes > 0]] = START
        inside, alone = self.ratios(hashes, codes, before)
        text = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.bincount(text, weights=inside, minlength=len(sizes)).astype(float)
        top = np.zeros(len(sizes))
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            x = alone[a:b]
            top[i] = (np.partition(x, len(x) - TOP)[-TOP:] if len(x) > TOP else x).sum()
        n = np.maximum(1, sizes)
        return np.column_stack([sums / n, sums / np.sqrt(n), top / TOP])


def probability(x: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ curve, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (bias first) of a ridge logistic regression of rows that count n times, by Newton's method on scaled columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), ridge * np.diag([1e-6, *np.ones(x.shape[1])])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (n * p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (n * (p - y)) + penalty @ w)
    return np.concatenate([[w[0] - (w[1:] * mean / scale).sum()], w[1:] / scale])


def held_out(id_: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = model.value.features(batch.column(0))
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in found.T], batch.column(1)], names=["a", "b", "c", "y"])


def fit(rows: DataFrame, known: DataFrame, train_docs: int = TRAIN_DOCS):
    """(A broadcast Model, its curve) from `rows` (id, text) with a label among `known` (label_id, toxic); None if either class is missing.

    Three quarters of the sample are counted, the rest fits the curve; there each document counts as many as its class
    has labels for one in the sample."""
    spark = rows.sparkSession
    few, weights = label_sample(known, "label_id", "toxic", train_docs // 2)
    sample = rows.join(F.broadcast(few), F.col("id") == F.col("_label_id")).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)))
    sample = durable(sample.select("text", F.col("y").cast("long").alias("toxic"), "part"))
    by_class = {r.toxic for r in sample.where("part <> 0").select("toxic").distinct().collect()}
    if by_class != {0, 1}:
        return None
    counted = sample.where("part <> 0").select("text", "toxic").mapInArrow(_pairs, "h long, w long, toxic long, ordinary long")
    pairs = durable(counted.groupBy("h", "w").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    mass = lambda c: F.sum(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)))
    contexts = pairs.groupBy("h").agg(mass("toxic").alias("toxic_mass"), mass("ordinary").alias("ordinary_mass"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    words = durable(pairs.groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.count("*").alias("after")))
    totals = words.agg(*[F.sum(c).alias(c) for c in ("toxic", "ordinary")], F.count("*").alias("types"), F.sum("after").alias("follow")).first().asDict()
    if not totals["toxic"] or not totals["ordinary"]:
        return None
    model = Model(pairs.toArrow(), contexts.toArrow(), words.toArrow(), totals)  # bounded by train_docs
    first = spark.sparkContext.broadcast(model)
    seen = lambda part: sample.where(part).select("text", "toxic").mapInArrow(lambda b: _features(b, first), "a double, b double, c double, y long").toArrow()  # noqa: E731  bounded by train_docs
    data = seen("part = 0")
    if set(data.column("y").to_pylist()) != {0, 1}:
        data = seen("part <> 0")
    y = data.column("y").to_numpy()
    curve = logistic(np.column_stack([data.column(c).to_numpy() for c in "abc"]), y.astype(float), np.where(y == 1, weights[1], weights[0]))
    return first, curve


def _scored(batches: Iterator[pa.RecordBatch], fitted, prior: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2000):
        if fitted is None:
            scores = np.full(batch.num_rows, prior)
        else:
            scores = probability(fitted[0].value.features(batch.column(0)), fitted[1])
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], names=[*batch.schema.names[1:], "score"])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of `docs`: id, held_out, score (0 to 1), predicted.

    `labels` has `id_col` and toxic (0 or 1); ids that repeat count once, with their largest label; null ids and labels
    are not learned from, nor are held-out rows. A null text counts as empty, and scores as the curve does without
    evidence. If either class has no documents, every score is 0 (or 1, if all are toxic). Only `id_col` (an integer) and
    `text_col` are read; an empty table gives an empty result. Texts are read whole, however long; rows that repeat a text
    score alike; a score equal to `threshold` is predicted 1. Labels are bounded to about TRAIN_DOCS before they meet the
    documents, so that no text is shuffled; no word or bigram of those documents is left out."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("long").alias("id"))
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("label_id")).agg(F.max("toxic").alias("toxic"))
    known = durable(known.where(~held_out(F.col("label_id").cast("long"))))
    fitted = fit(for_python(rows), known)
    share = 0.0 if fitted is not None else known.agg(F.coalesce(F.min("toxic"), F.lit(0))).first()[0]
    scored = rows.withColumn("held_out", held_out(F.col("id"))).mapInArrow(lambda b: _scored(b, fitted, float(share)), "id long, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
