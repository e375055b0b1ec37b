"""Quality classifier by co-training of two views (after Blum and Mitchell, 1998).

One view reads the text (hashed words and shares of symbols, repeats, short words), the other the metadata (language,
source, length, lines). Each is a naive Bayes model over feature counts of labelled documents. In every round a view
labels the unlabelled documents that it is most confident of, in both classes in proportion to their labels, and the
other view counts those that it does not hold to be of the other class itself. Labelled documents of one fold in HOLD calibrate the views; the sum of the calibrated log-odds
scores all documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, for_python, label_sample, slices, stored, table
from .words import coded_words

#: Features of each view after hashing; the models are that large whatever the corpus.
SLOTS = {"text": 1 << 16, "meta": 1 << 10}
#: The first slots of the text view are for the shares; they are summed apart from the many words.
SHARES = 1 << 10
ROUNDS, HOLD = 2, 5
#: Labels that the views learn from, about half of each class (chosen by a hash of the id); a documented bound, as they are broadcast.
TRAIN_LABELS = 400_000
#: In each round a view may label so many more documents of each class, as a share of the labels the class has, and only
#: documents whose calibrated probability of that class is SURE or more.
GROWTH, SURE = 1.0, {1: 0.97, 0: 0.8}
#: Steps of the histogram of raw scores on which a view is calibrated.
STEPS, LIMIT = 400, 20.0
SMOOTH = 1.0


def _slot(name: str, slots: int) -> int:
    return xxhash.xxh64_intdigest(name, 7) % slots


def text_features(text: str, hashes: np.ndarray) -> list[int]:
    """Slots of the shares and of the words, whose hashes are given."""
    n = SLOTS["text"] - SHARES
    words = text.split()
    total = max(1, len(words))
    shares = {
        "symbols": sum(map(text.count, "#*$%&|<>")) / total,
        "repeats": 1 - len(set(words)) / total,
        "short": sum(len(w) <= 2 for w in words) / total,
        "marks": sum(map(text.count, ".,;:!?")) / total,
        "digits": sum(map(text.count, "0123456789")) / total,
        "upper": sum(w[:1].isupper() for w in words) / total,
    }
    found = {_slot(f"{k}:{math.ceil(3 * math.log2(1 + 255 * min(1.0, v)))}", SHARES) for k, v in shares.items()}
    found.add(_slot(f"letters:{min(80, int(4 * len(text) / total))}", SHARES))
    return sorted(found | set((SHARES + hashes % n).tolist()))


def meta_features(lang: str | None, source: str | None, text: str) -> list[int]:
    n = SHARES
    length, lines = int(2 * math.log2(1 + len(text))), int(math.log2(1 + text.count("\n")))
    names = (f"lang:{lang}", f"source:{source}", f"length:{length}", f"lines:{lines}", f"lang, length:{lang},{length}", f"lines, length:{lines},{length}")
    return sorted({_slot(x, n) for x in names})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        id_, text, lang, source, good = (batch.column(k) for k in range(5))
        texts = [t or "" for t in text.to_pylist()]
        offsets, codes, hashes = coded_words(text)
        views = [text_features(t, hashes[np.unique(codes[a:b])]) for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)], [meta_features(a, b, t) for a, b, t in zip(lang.to_pylist(), source.to_pylist(), texts, strict=True)]
        yield pa.RecordBatch.from_arrays([id_, good, *[pa.array(v, pa.list_(pa.int32())) for v in views]], names=["id", "good", "text", "meta"])


class View:
    """Naive Bayes weights of one view, and the curve that calibrates its scores."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, docs: tuple[float, float]):
        rate = lambda n, total: np.log((n + SMOOTH) / (total + 2 * SMOOTH))
        self.weights = np.where(good + bad > 1, rate(good, docs[0]) - rate(bad, docs[1]), 0.0)
        self.curve = (0.0, 1.0)
        self.prior = 0.0
        self.sure = (-np.inf, np.inf)  # raw scores at or below, and at or above which it labels documents

    def raw(self, lists: pa.ListArray) -> np.ndarray:
        """For each list the sum of the weights of its first SHARES slots, and that of the others over the root of their number."""
        offsets = lists.offsets.to_numpy().astype(np.int64)
        slots = lists.values.to_numpy()
        words = slots >= SHARES
        values = self.weights[slots]
        total = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[offsets])
        return np.clip(total(np.where(words, 0.0, values)) + total(np.where(words, values, 0.0)) / np.sqrt(np.maximum(1, total(words))), -LIMIT, LIMIT)

    def logit(self, lists: pa.ListArray) -> np.ndarray:
        return np.clip(self.curve[0] + self.curve[1] * self.raw(lists), -30, 30)


def _whole(lists: pa.Array) -> pa.ListArray:
    """The list array of a sliced batch, with offsets from 0."""
    return pa.concat_arrays([lists.slice(0)]) if lists.offset == 0 else pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32)), lists.flatten())


def _sure(view: View | None, lists: pa.ListArray) -> np.ndarray:
    """1 where the view is sure of good quality, 0 of bad, else -1."""
    if view is None:
        return np.full(len(lists), -1)
    raw = view.raw(lists)
    return np.where(raw >= view.sure[1], 1, np.where(raw <= view.sure[0], 0, -1))


def _taught(teacher: View | None, seen: pa.ListArray, pupil: View | None, own: pa.ListArray) -> np.ndarray:
    """The teacher's labels of documents, but for those that the pupil itself would rather give the other label: -1 there."""
    if teacher is None or pupil is None:
        return np.full(len(seen), -1)
    y, logit = _sure(teacher, seen), pupil.logit(own)
    return np.where(((y == 1) & (logit >= pupil.prior)) | ((y == 0) & (logit <= pupil.prior)), y, -1)


def certain(view: View, steps: np.ndarray, counts: np.ndarray, quota: tuple[float, float]) -> tuple[float, float]:
    """Raw scores between which a view labels nothing: outside it is SURE of the class, and at most `quota` (bad, good) unlabelled documents are.

    `counts` are the unlabelled documents by step of the raw score; documents of one step go together."""
    seen = np.bincount(steps, weights=counts, minlength=STEPS + 1)
    value = np.arange(STEPS + 1) / STEPS * 2 * LIMIT - LIMIT
    p = 1 / (1 + np.exp(-np.clip(view.curve[0] + view.curve[1] * value, -30, 30)))
    low = np.flatnonzero((np.cumsum(seen) <= quota[0]) & (1 - p >= SURE[0]))
    high = np.flatnonzero((np.cumsum(seen[::-1])[::-1] <= quota[1]) & (p >= SURE[1]))
    half = LIMIT / STEPS
    return (value[low[-1]] + half if len(low) else -np.inf, value[high[0]] - half if len(high) else np.inf)


def _counts(batches: Iterator[pa.RecordBatch], views) -> Iterator[pa.RecordBatch]:
    """(view, slot, good, bad): documents by feature; slot -1 counts the documents themselves."""
    current = views.value
    sums = {k: np.zeros((2, n + 1), np.int64) for k, n in SLOTS.items()}
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        lists = {"text": _whole(batch.column(1)), "meta": _whole(batch.column(2))}
        for name, other in (("text", "meta"), ("meta", "text")):
            y = np.where(label >= 0, label, np.where(label == -1, _taught(current.get(other), lists[other], current.get(name), lists[name]), -1))
            each = np.repeat(y, np.diff(lists[name].offsets.to_numpy()))
            slots = lists[name].values.to_numpy()
            for k, row in ((1, 0), (0, 1)):
                sums[name][row, :-1] += np.bincount(slots[each == k], minlength=SLOTS[name])
                sums[name][row, -1] += int((y == k).sum())
    for name, s in sums.items():
        at = np.flatnonzero(s.sum(axis=0))
        slot = np.where(at == SLOTS[name], -1, at).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(slot), pa.array(s[0, at]), pa.array(s[1, at])], names=["view", "slot", "good", "bad"])


def _histogram(batches: Iterator[pa.RecordBatch], views) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for k, name in ((1, "text"), (2, "meta")):
            step = np.round((views.value[name].raw(_whole(batch.column(k))) + LIMIT) / (2 * LIMIT) * STEPS).astype(np.int32)
            pairs = Counter(zip(step.tolist(), y.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(pairs), pa.string()), pa.array([a for a, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.int32()), pa.array(list(pairs.values()), pa.int64())], names=["view", "step", "y", "n"])


def _scores(batches: Iterator[pa.RecordBatch], views, prior: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [views.value[name].logit(_whole(batch.column(k))) for k, name in ((1, "text"), (2, "meta"))]
        p = lambda z: pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        yield pa.RecordBatch.from_arrays([batch.column(0), p(each[0]), p(each[1]), p(each[0] + each[1] - prior)], names=["id", "text_score", "meta_score", "score"])


def co_train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rounds: int = ROUNDS, train_labels: int = TRAIN_LABELS) -> DataFrame:
    """One row for each row of `docs`: id, labelled, text_score, meta_score, score (0 to 1, of good quality), predicted.

    `labels` has `id_col` and quality (1 good, 0 bad); ids that repeat count once, with their lowest label; null ids and
    labels don't count. About `train_labels` of them are learned from (`labelled` tells which documents have one); they are
    bounded before they meet the documents, so that no text is shuffled. Null texts count as empty; a null language or
    source is a value of its own. Texts are read whole, however long; rows that repeat count each. If a class has no
    labels, every score is 0.5. A score of 0.5 is predicted 1. Only the four columns are read; an empty table gives an
    empty result.

    All documents are counted in each round: a task sums its own rows by feature, and the sums (at most SLOTS a task) are
    shuffled. Models and histograms have a fixed size."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("label_id")).agg(F.min("quality").alias("good"))
    few, weights = label_sample(known, "label_id", "good", train_labels // 2)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    rows = rows.join(F.broadcast(few), F.col("id") == F.col("_label_id"), "left").select("id", "text", "lang", "source", F.coalesce("y", F.lit(-1)).cast("int").alias("good"))
    data = stored(for_python(rows).mapInArrow(_features, "id long, good int, text array<int>, meta array<int>"))
    held = (F.col("good") >= 0) & (F.pmod(F.xxhash64("id"), F.lit(HOLD)) == 0)
    marked = data.select(F.when(held, F.lit(-2)).otherwise(F.col("good")).alias("y"), "text", "meta")  # -2: neither counted nor given a label
    numbers = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    views: dict[str, View] = {}
    for at in range(rounds + 1):
        current = spark.sparkContext.broadcast(views)
        sums = marked.mapInArrow(lambda b, v=current: _counts(b, v), "view string, slot int, good long, bad long").groupBy("view", "slot").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas()
        views = {}
        for name, n in SLOTS.items():
            own = sums[sums["view"] == name]
            total = own[own.slot == -1]
            good, bad = np.zeros(n), np.zeros(n)
            own = own[own.slot >= 0]
            good[own.slot], bad[own.slot] = own.good, own.bad
            views[name] = View(good, bad, (float(total.good.sum()), float(total.bad.sum())))
        new = spark.sparkContext.broadcast(views)
        shown = data.select(F.when(held, F.col("good")).when(F.col("good") < 0, -1).otherwise(-2).alias("y"), "text", "meta").where("y > -2").mapInArrow(lambda b, v=new: _histogram(b, v), "view string, step int, y int, n long").groupBy("view", "step", "y").agg(F.sum("n").alias("n")).toPandas()
        if not {0, 1} <= set(shown.y):
            views = {}
            break
        prior = None
        for name, view in views.items():
            own = shown[(shown["view"] == name) & (shown.y >= 0)]
            n = own.n.to_numpy() * np.where(own.y == 1, weights[1], weights[0])
            x = (own.step.to_numpy() / STEPS * 2 * LIMIT - LIMIT)[:, None]
            view.curve = tuple(calibrated(x, own.y.to_numpy().astype(float), n))
            share = float((own.y * n).sum() / n.sum())
            view.prior = prior = math.log(share / (1 - share))
            rest = shown[(shown["view"] == name) & (shown.y == -1)]
            view.sure = certain(view, rest.step.to_numpy(), rest.n.to_numpy(), tuple((at + 1) * GROWTH * numbers.get(y, 0) for y in (0, 1)))
    out = [F.col("id").alias(id_col), (F.col("good") >= 0).alias("labelled")]
    if not views:
        half = F.lit(0.5)
        return data.select(*out, half.alias("text_score"), half.alias("meta_score"), half.alias("score"), F.lit(1).alias("predicted"))
    final = spark.sparkContext.broadcast(views)
    ids = data.select(F.struct("id", "good").alias("row"), "text", "meta")
    scored = ids.mapInArrow(lambda b: _scores(b, final, prior), "row struct<id:long,good:int>, text_score double, meta_score double, score double")
    return scored.select("row.*", "text_score", "meta_score", "score").select(*out, "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def calibrated(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Bias and slope of a weighted logistic curve."""
    w = np.zeros(2)
    z = np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = np.diag([1e-6, ridge])
        w = w - np.linalg.solve((z * (n * p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (n * (p - y)) + penalty @ w)
    return w


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_train(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLES: dict[str, str] = {}
