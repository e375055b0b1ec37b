"""Quality rules whose thresholds are chosen under a proven limit on false rejection.

A rule rejects a document if its signal reaches a cutoff. In each stratum (a language) all rules climb one ladder
together, lax cutoffs first; a step rejects a document if any of its rules does. Its design never looks at a good label:
cutoffs are upper shares of the signals of documents not labelled good, and a step gives each rule the largest share that
holds labelled bad documents at least `lift` times as often as others, so that rules without use stay out. The good
labels are the holdout: step by step an exact binomial test over the stratum's distinct good texts rejects "the step
loses at least RISK of the good documents" at level DELTA / strata, until the first step that fails (fixed-sequence
testing, as in Learn-then-Test), so steps cost no correction. Strata are corrected by Bonferroni; those with too few
labels to certify anything are left untested, by their number of labels alone, and cost none. With probability
1 - DELTA no stratum loses more than RISK of its good documents. Where nothing is certified only the base rules reject."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, durable, for_python, fresh, sized, slices, stored, table

#: At most this share of a stratum's good documents may be rejected by the certified rules together, but for probability DELTA.
RISK, DELTA = 0.02, 0.05
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Signals are cut on a grid of so many steps; upper shares that cutoffs are taken at; lifts of the joint ladder, lax steps first.
GRID = 1000
SHARES = tuple(round(0.001 * 1.25**k, 5) for k in range(28))
LIFTS = tuple(round(8 * 0.93**k, 3) for k in range(26))
#: Fewer labelled bad documents than this say nothing of a rule's use; the ladder then gives all rules the same share.
LEAST_BAD = 30
RULES = ("symbols", "repeats", "dup_lines", "long_words", "short")
_SYMBOLS = bytes(b for b in range(256) if chr(b) not in "#*$%&|<>")
_BLANKS = bytes(b for b in range(256) if not (b == 32 or 9 <= b <= 13))
_CONTINUED = bytes(range(0x80, 0xC0))
_STATS = pa.struct([(c, pa.int64()) for c in COUNTS])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many of `words` stand in a run of `window` words that occurs twice or more (the first time included)."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    width, grams = 1, ids
    while width < window:  # names of runs of twice the length, from pairs of names
        step = min(width, window - width)
        pairs = grams[: len(grams) - step] * (n + 1) + grams[step:]
        _, grams = np.unique(pairs, return_inverse=True)
        width += step
    starts = np.flatnonzero(np.bincount(grams)[grams] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def counts_of(text: bytes) -> tuple[int, int, int, int, int]:
    """COUNTS of one text in UTF-8."""
    words = text.split()
    points = len(text.translate(None, _CONTINUED))
    blanks = len(text.translate(None, _BLANKS))
    lines = Counter(line for line in text.split(b"\n") if line and not line.isspace())
    symbols = len(text.translate(None, _SYMBOLS))
    return len(words), points - blanks, symbols, sum(lines.values()) - len(lines), repeated_words(words)


def _counted(batches: Iterator[pa.RecordBatch], at: int, keep: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [counts_of(t or b"") for t in batch.column(at).cast(pa.binary()).to_pylist()]
        columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(len(COUNTS))]
        stats = pa.StructArray.from_arrays(columns, fields=list(_STATS))
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], stats], names=names)


def with_counts(docs: DataFrame, text_col: str, name: str, keep_text: bool = True) -> DataFrame:
    """`docs` with a last struct column `name` of COUNTS; all other columns, but for the text if unwanted, pass through as they are."""
    rows, at = docs, docs.columns.index(text_col)
    if not isinstance(docs.schema[at].dataType, T.StringType):
        rows, at = docs.select("*", F.col(f"`{text_col}`").cast("string").alias(fresh(docs, "_text"))), len(docs.columns)
    keep = [k for k, c in enumerate(docs.columns) if keep_text or c != text_col]
    stats = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*[docs.schema.fields[k] for k in keep], T.StructField(name, stats)])
    return for_python(rows).mapInArrow(lambda batches: _counted(batches, at, keep, schema.names), schema)


def signals(stats: Column) -> dict[str, Column]:
    """Signals in 0..1 of the counts, higher for worse text."""
    words = F.greatest(stats["n_words"], F.lit(1))
    per_word = stats["word_chars"] / words
    return {
        "symbols": F.least(F.lit(1.0), stats["n_symbols"] / words),
        "repeats": stats["n_repeat_words"] / words,
        "dup_lines": F.least(F.lit(1.0), 5 * stats["n_dup_lines"] / words),
        "long_words": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (per_word - 8) / 16)),
        "short": F.least(F.lit(1.0), 20 / words),
    }


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed exactly in the log domain."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson upper bound at 1 - `level` for the rate of which k of n are seen."""
    low, high = k / n if n else 1.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if k < n and binomial_tail(k, n, mid) > level else (low, mid)
    return high if k < n else 1.0


def steps_of(stats: Column) -> Column:
    """Array of the signals on the grid, in the order of RULES."""
    kinds = signals(stats)
    return F.array(*[F.ceil(F.round(kinds[k] * GRID, 6)).cast("int") for k in RULES])


def _cuts(key: tuple, rows: pa.Table) -> pa.Table:
    """For each rule of a stratum, and each of SHARES, the least step that no larger share of its documents reaches (GRID + 1: none)."""
    rule, step, n = (rows.column(c).to_numpy() for c in ("rule", "step", "n"))
    out = []
    for k in range(len(RULES)):
        counts = np.bincount(step[rule == k], weights=n[rule == k], minlength=GRID + 2)
        reach = np.cumsum(counts[::-1])[::-1] / max(1.0, counts.sum())  # share of documents at a step or over
        out.append([max(1, int(np.argmax(reach <= share))) for share in SHARES])
    return pa.table({"stratum": [key[0].as_py()], "cuts": [out]}, schema=pa.schema([("stratum", pa.string()), ("cuts", pa.list_(pa.list_(pa.int32())))]))


def design(bad: dict[tuple[int, int], int], n_bad: int) -> list[list[int]]:
    """The joint ladder: for each step the index into SHARES that each rule rejects at, -1 for a rule left out.

    `bad` counts the labelled bad documents by (rule, least index that rejects them). A share's lift is the share of bad
    documents it holds, less one standard error, over the share itself."""
    if n_bad < LEAST_BAD:
        return [[k] * len(RULES) for k in range(len(SHARES))]
    held = np.array([[bad.get((r, k), 0) for k in range(len(SHARES))] for r in range(len(RULES))]).cumsum(axis=1)
    lift = np.maximum(0, held - np.sqrt(held)) / n_bad / np.array(SHARES)
    return [[int(np.flatnonzero(row >= least)[-1]) if (row >= least).any() else -1 for row in lift] for least in LIFTS]


def labels_needed(level: float, risk: float) -> int:
    """Good labels without which not even a step that loses none of them is certified."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def _climb(key: tuple, rows: pa.Table, risk: float, level: float, steps: int) -> pa.Table:
    """The last certified step of one stratum, from how many good texts each step is the first to reject."""
    first = np.bincount(rows.column("first").to_numpy(), weights=rows.column("n").to_numpy(), minlength=steps + 1).astype(int)
    good, rejected, best = int(first.sum()), 0, None
    for step in range(steps):
        rejected += int(first[step])
        if rejected >= risk * good or binomial_tail(rejected, good, risk) > level:
            break
        best = (step, rejected)
    found = [] if best is None else [(key[0].as_py(), best[0], best[1], good, upper_bound(best[1], good, level))]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, _CERTIFIED.types, strict=True)], schema=_CERTIFIED)


_CERTIFIED = pa.schema([("stratum", pa.string()), ("step", pa.int32()), ("rejected", pa.int64()), ("good", pa.int64()), ("bound", pa.float64())])


def certified_cutoffs(rows: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, step, rejected, good, bound, cutoffs): for each stratum with a certified step its cutoffs on the grid, by rule.

    `rows`: stratum, stats (COUNTS), digest (a hash of the text), good (1, 0 or null, not labelled); base failures don't
    count. The rows are a narrow table; only sums by (stratum, rule, step) are shuffled, and the distinct labelled texts."""
    spark = rows.sparkSession
    passed = durable(rows.where(~base_failed(F.col("stats"))).select("stratum", "digest", "good", steps_of(F.col("stats")).alias("steps")))
    each = passed.where("good IS NULL OR good <> 1").select("stratum", F.posexplode("steps").alias("rule", "step"))
    sums = each.groupBy("stratum", "rule", "step").agg(F.count("*").alias("n"))
    cuts = durable(sums.groupBy("stratum").applyInArrow(_cuts, "stratum string, cuts array<array<int>>"))
    labelled = passed.where("good IS NOT NULL").groupBy("stratum", "digest").agg(F.min("good").alias("good"), F.min("steps").alias("steps")).join(sized(cuts), "stratum")
    share = F.transform("steps", lambda x, r: F.size(F.filter(F.get("cuts", r), lambda c: x < c)))  # per rule, the least index that rejects
    labelled = durable(labelled.select("stratum", "good", share.alias("share")))
    bad = labelled.where("good = 0").select(F.posexplode("share").alias("rule", "k")).groupBy("rule", "k").agg(F.count("*").alias("n")).collect()  # at most rules x shares
    ladder = design({(r.rule, r.k): r.n for r in bad}, sum(r.n for r in bad) // len(RULES))
    numbers = labelled.where("good = 1").groupBy("stratum").agg(F.count("*").alias("n")).where(F.col("n") >= labels_needed(delta, risk)).groupBy("n").agg(F.count("*").alias("strata")).collect()
    possible = sum(r.strata for r in numbers)
    tested = sum(r.strata for r in numbers if r.n >= labels_needed(delta / max(1, possible), risk))
    level = delta / max(1, tested)
    least = labels_needed(delta / max(1, possible), risk)
    first = F.array_min(F.transform("share", lambda k, r: F.size(F.filter(F.lit(ladder), lambda step: F.get(step, r) < k))))
    good = labelled.where("good = 1").groupBy("stratum", first.alias("first")).agg(F.count("*").alias("n"))
    enough = good.groupBy("stratum").agg(F.sum("n").alias("_n")).where(F.col("_n") >= least).drop("_n")
    steps = len(ladder)
    certified = good.join(enough, "stratum").groupBy("stratum").applyInArrow(lambda key, t: _climb(key, t, risk, level, steps), "stratum string, step int, rejected long, good long, bound double")
    at = lambda r: F.get(F.get(F.lit(ladder), F.col("step")), F.lit(r))
    cutoff = lambda r: F.when(at(r) >= 0, F.get(F.get("cuts", F.lit(r)), at(r))).otherwise(GRID + 1)
    return certified.join(cuts, "stratum").select(*_CERTIFIED.names, F.struct(*[cutoff(r).alias(k) for r, k in enumerate(RULES)]).alias("cutoffs"))


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def narrow_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """(id, stratum, digest, stats, good) of every document, from files: what labels are joined to. No text is shuffled, at any size."""
    few = docs.select(F.col(f"`{id_col}`").alias("id"), _stratum(stratum_col).alias("stratum"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("digest"), F.col(f"`{text_col}`").cast("string").alias("_words"))
    counted = stored(with_counts(few, "_words", "stats", keep_text=False))
    good = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg((F.min("quality") == 1).cast("int").alias("good"))
    return counted.join(sized(durable(good)), F.col("id") == F.col("_label_id"), "left").drop("_label_id")


def _judged(rows: DataFrame, stats: str, stratum: Column, cutoffs: DataFrame, names: tuple[str, str]) -> tuple[DataFrame, Column]:
    """`rows` with the cutoffs of their stratum, and the struct COUNTS, base_failed, kept, rules_failed."""
    key, limits = names
    side = sized(durable(cutoffs.select(F.col("stratum").alias(key), F.col("cutoffs").alias(limits))))
    s = F.col(f"`{stats}`")
    at = steps_of(s)
    failed = F.array_compact(F.array(*[F.when(F.get(at, F.lit(r)) >= F.col(f"`{limits}`.{k}"), F.lit(k)) for r, k in enumerate(RULES)]))
    out = F.struct(*[s[c].alias(c) for c in COUNTS], base_failed(s).alias("base_failed"), (~base_failed(s) & (F.size(failed) == 0)).alias("kept"), failed.alias("rules_failed"))
    return rows.join(side, stratum == F.col(key), "left"), out


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> tuple[DataFrame, DataFrame]:
    """(id, COUNTS, base_failed, kept, rules_failed) of every row of `docs`, and the certified cutoffs.

    `labels` has `id_col` and a quality of 1 for good documents; an id that repeats has its lowest label; labels without
    id or quality don't count. A null text counts as empty and fails the base rules; a null stratum is the stratum ''. A
    signal equal to its cutoff rejects. Copies of one text are one observation in every test. Texts are read whole,
    however long. An empty table gives an empty result, and without labels only the base rules reject. Only the three
    columns are read."""
    rows = narrow_counts(docs, labels, id_col, text_col, stratum_col)
    cutoffs = durable(certified_cutoffs(rows, risk, delta))
    joined, out = _judged(rows, "stats", F.col("stratum"), cutoffs, ("_key", "_cutoffs"))
    return joined.select(F.col("id").alias(id_col), out.alias("_out")).select(id_col, "_out.*"), cutoffs


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """`docs` without the rows that a base rule or a certified rule rejects, as in verdicts(); same columns, whatever their names.

    Texts are counted twice, once for the cutoffs and once as they pass: a second scan is cheaper than a shuffle of texts."""
    cutoffs = durable(certified_cutoffs(narrow_counts(docs, labels, id_col, text_col, stratum_col), risk, delta))
    name = fresh(docs, "_quality")
    rows, out = _judged(with_counts(docs, text_col, name), name, _stratum(stratum_col), cutoffs, (fresh(docs, "_stratum_key"), fresh(docs, "_cutoffs")))
    return rows.where(out["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = verdicts(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return rows.drop("rules_failed")


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES: dict[str, str] = {}
