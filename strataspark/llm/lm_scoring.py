"""Cross-entropy difference: how much likelier a document is in a target model than in a background model.

Both are bigram models of the same order, vocabulary and smoothing (after Moore and Lewis, 2010). The target is counted
over the documents marked as target, the background over other documents, chosen by a hash so that they hold about as
many tokens. The vocabulary is every word that occurs twice or more in the whole corpus, so it grows with it; the others
are one unknown word. The score is the mean over a document's tokens of log P(target) - log P(background); higher is more
like the target. A document's own counts are taken out of the bigrams of the model that it was counted in.

Texts are turned into numbers once. Bigrams of two of the HOT most frequent words are counted and scored in the tasks; the
other distinct bigrams of each document are shuffled once, to a place where all occurrences are summed and scored.

Tasks know the LISTED most frequent words as arrays. In a longer vocabulary the others are rare: only the few bigrams that
have one of them meet their words' numbers and counts in shuffled joins, and no text does."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, durable, for_python, slices, stored, table
from .words import coded_words, emitted

#: So many most frequent words, or ids of targets, tasks get as sorted arrays; the others meet bigrams, or texts, in shuffled joins.
LISTED = 1 << 22
#: Words that occur so often, or oftener, are ranked as equals where the LISTED are chosen.
LEVELS = 1 << 20
#: So many most frequent words: a bigram without two of them makes less than about 1 / HOT of all tokens.
HOT = 1000
#: Weight of the bigrams against the unigrams, and of the unigrams against equal shares.
BIGRAM, UNIGRAM = 0.6, 0.95
#: Numbers of the unknown word, a text's start and its end; words follow.
UNKNOWN, START, END, FIRST = 0, 1, 2, 3
#: Sides: neither model, target, background.
NEITHER, TARGET, BACKGROUND = 0, 1, 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def blocks() -> Iterator:
        for batch in slices(batches, 2000):
            _, codes, hashes = coded_words(batch.column(0))
            if len(codes):
                counts = np.bincount(codes, minlength=len(hashes))
                yield [hashes[counts > 0]], [counts[counts > 0]]

    return emitted(blocks(), ["h", "n"])


def _numbered(batches: Iterator[pa.RecordBatch], vocabulary, given) -> Iterator[pa.RecordBatch]:
    """The words of each text as numbers, by a sorted vocabulary, and the hashes of those it lacks where they aren't UNKNOWN."""
    known, lacking = vocabulary.value
    for batch in slices(batches, 2000):
        offsets, codes, hashes = coded_words(batch.column(1))
        numbers = np.full(len(hashes), lacking, np.int32)
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            numbers = np.where(known[at] == hashes, at + FIRST, lacking).astype(np.int32)
        ids, rare = numbers[codes], pa.nulls(batch.num_rows, pa.list_(pa.int64()))
        if lacking != UNKNOWN:
            out = ids == lacking
            rare = _lists(np.concatenate([[0], np.cumsum(out)])[offsets], hashes[codes[out]])
        target = batch.column(2) if given is None else _among(batch.column(0), given.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), target, _lists(offsets, ids), rare], names=["id", "target", "ids", "rare"])


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _among(ids: pa.Array, known: np.ndarray) -> pa.Array:
    """Which ids, none of the nulls, are in a sorted array."""
    x = ids.fill_null(0).to_numpy()
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return pa.array((known[at] == x if len(known) else np.zeros(len(x), bool)) & ids.is_valid().to_numpy(zero_copy_only=False))


def _divided(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """About LISTED most frequent words of a longer vocabulary, and the others. Of equally frequent ones a hash decides."""
    level, room = F.least("n", F.lit(LEVELS)), LISTED
    for r in sorted(known.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if r.n > room:
            break
        room -= r.n
    inside = (level > r.level) | ((level == r.level) & (F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.lit(room * (1 << 30) // r.n)))
    return known.where(inside), known.where(~inside)


def numbered(words: DataFrame, first: int) -> DataFrame:
    """`words` with a number each from `first` on, without a gap."""
    rows = durable(words.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = np.cumsum([first, *[r.n for r in sizes]]).tolist()
    starts = words.sparkSession.createDataFrame([(r.part, at) for r, at in zip(sizes, starts[:-1], strict=True)], "part long, start long")
    return durable(rows.join(F.broadcast(starts), part == F.col("part")).withColumn("number", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "start"))


_SUMS = "id long, n long, t double, b double"
_TEXTS = "id long, target boolean, ids array<int>, rare array<long>"


def _tokens(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, document): the tokens of all documents of a batch, each with START before and END after them."""
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes + 2)
    out = np.zeros(len(doc), np.int64)
    ends = np.cumsum(sizes + 2)
    inner = np.ones(len(doc), bool)
    inner[ends - 1] = inner[ends - sizes - 2] = False
    out[inner] = lists.flatten().to_numpy()
    out[ends - sizes - 2], out[ends - 1] = START, END
    return out, doc


def _pairs(numbers: np.ndarray, doc: np.ndarray, hot: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, second, place): bigrams; place is that of two hot words in a square of counts, else -1."""
    first, second, doc = numbers[:-1], numbers[1:], doc[1:]
    inside = first != END
    first, second, doc = first[inside], second[inside], doc[inside]
    rank = ranks[numbers]
    a, b = rank[:-1][inside].astype(np.int64), rank[1:][inside]
    return doc, first, second, np.where((a >= 0) & (b >= 0), a * len(hot) + b, -1)


def _tallied(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    """(key, target, background): counts of a task's hot bigrams (key is their place) and of its words (key is -1 - number) but those that aren't listed."""
    h, ranks = hot.value
    square, words = np.zeros((2, len(h) ** 2), np.int64), np.zeros((2, len(ranks)), np.int64)

    def blocks() -> Iterator:
        for batch in batches:
            side = batch.column(0).to_numpy(zero_copy_only=False)
            numbers, doc = _tokens(batch.column(1))
            pair_doc, _, _, place = _pairs(numbers, doc, h, ranks)
            for k, model in enumerate((TARGET, BACKGROUND)):
                np.add.at(square[k], place[(place >= 0) & (side[pair_doc] == model)], 1)
                np.add.at(words[k], numbers[side[doc] == model], 1)
        words[:, -1] = 0
        for table_, key in ((square, lambda x: x), (words, lambda x: -1 - x)):
            if len(at := np.flatnonzero(table_.sum(axis=0))):
                yield [key(at)], [table_[0, at], table_[1, at]]

    return emitted(blocks(), ["key", "target", "background"])


def _losses(alone: list[np.ndarray], inside: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    """Losses in both models of bigrams that occur n times, from the chance of the word alone and after its context."""
    return [n * -np.log(BIGRAM * x + (1 - BIGRAM) * a) for a, x in zip(alone, inside, strict=True)]


def _alone(token: np.ndarray, total: int, size: float) -> np.ndarray:
    return UNIGRAM * token / max(1, total) + (1 - UNIGRAM) / size


def _square_losses(m: dict, length: int, at: np.ndarray, n: np.ndarray, side: np.ndarray) -> list[np.ndarray]:
    """Losses in both models of bigrams of two hot words that documents of these sides have n times."""
    own = [np.where(side == k, n, 0) for k in (TARGET, BACKGROUND)]
    alone = [m["hot_alone"][k][at % length] for k in (0, 1)]
    inside = [np.maximum(m["square"][k][at] - own[k], 0) / np.maximum(1, m["hot_count"][k][at // length]) for k in (0, 1)]
    return _losses(alone, inside, n)


def _hot_losses(batches: Iterator[pa.RecordBatch], hot_words, model) -> Iterator[pa.RecordBatch]:
    """(id, n, t, b): for each document the number of its bigrams of two hot words, and their losses in both models."""
    m, (h, ranks) = model.value, hot_words.value
    size = len(h) ** 2
    for batch in batches:
        numbers, doc = _tokens(batch.column(2))
        side = batch.column(1).to_numpy(zero_copy_only=False)
        pair_doc, _, _, place = _pairs(numbers, doc, h, ranks)
        hot = place >= 0
        found, n = np.unique(pair_doc[hot] * size + place[hot], return_counts=True)
        d, at = found // size, found % size
        sums = [np.bincount(d, weights=x, minlength=batch.num_rows) for x in (n, *_square_losses(m, len(h), at, n, side[d]))]
        rows = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sums[0][rows].astype(np.int64)), pa.array(sums[1][rows]), pa.array(sums[2][rows])], names=["id", "n", "t", "b"])


def _placed_losses(batches: Iterator[pa.RecordBatch], hot_words, model) -> Iterator[pa.RecordBatch]:
    """(id, n, t, b): the same of rows (id, c, place)."""
    m, length = model.value, len(hot_words.value[0])
    for batch in batches:
        c, at = (batch.column(k).to_numpy() for k in (1, 2))
        n = (c >> 2).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *[pa.array(x) for x in _square_losses(m, length, at, n, c & 3)]], names=["id", "n", "t", "b"])


def _distinct(d: np.ndarray, first: np.ndarray, second: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, key, n): the distinct bigrams of each d, and how often it has them. `bits` over 0: d and both words fit in one number."""
    if bits:
        packed, n = np.unique(d << 2 * bits | first << bits | second, return_counts=True)
        low = (1 << bits) - 1
        return packed >> 2 * bits, (packed >> bits & low) << 32 | packed & low, n
    key = first << 32 | second
    order = np.lexsort((key, d))
    d, key = d[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (key[1:] != key[:-1])])) if len(d) else np.zeros(0, np.int64)
    return d[new], key[new], np.diff(np.append(new, len(d)))


def _cold(batch: pa.RecordBatch, at: int, hot_words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, second) of all bigrams of a batch but those of two hot words and those with a word that isn't listed."""
    h, ranks = hot_words.value
    numbers, doc = _tokens(batch.column(at))
    d, first, second, place = _pairs(numbers, doc, h, ranks)
    cold = (place < 0) & (first < len(ranks) - 1) & (second < len(ranks) - 1)
    return d[cold], first[cold], second[cold]


def _bigrams(batches: Iterator[pa.RecordBatch], hot_words, bits: int) -> Iterator[pa.RecordBatch]:
    """(id, key, c): the distinct bigrams, but those of two hot words or with one not listed, of each document; c is 4 times how often it has them, and its side."""
    for batch in slices(batches, 1000):
        d, key, n = _distinct(*_cold(batch, 2, hot_words), bits)
        side = batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(key), pa.array((4 * n + side[d]).astype(np.int32))], names=["id", "key", "c"])


def _unlisted(batches: Iterator[pa.RecordBatch], hot_words) -> Iterator[pa.RecordBatch]:
    """(row, id, side, v, v_h, w, w_h) of each bigram with a word that isn't listed: both words' numbers, and the hashes of those that aren't."""
    lacking = len(hot_words.value[1]) - 1
    for batch in slices(batches, 1000):
        numbers, doc = _tokens(batch.column(3))
        hashes = np.zeros(len(numbers), np.int64)
        hashes[numbers == lacking] = batch.column(4).flatten().to_numpy()
        at = np.flatnonzero((numbers[:-1] != END) & ((numbers[:-1] == lacking) | (numbers[1:] == lacking)))
        words = [c for x in (at, at + 1) for c in (pa.array(numbers[x]), pa.array(hashes[x], mask=numbers[x] != lacking))]
        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(doc[at])) for k in range(3)], *words], names=["row", "id", "side", "v", "v_h", "w", "w_h"])


def _placed(batches: Iterator[pa.RecordBatch], hot_words) -> Iterator[pa.RecordBatch]:
    """Rows whose second column is a bigram, with its place in the square of hot words, or -1."""
    h = hot_words.value[0]
    for batch in batches:
        key = batch.column(1).to_numpy()
        a, b = (np.where(h[at := np.minimum(np.searchsorted(h, x), len(h) - 1)] == x, at, -1) for x in (key >> 32, key & 0xFFFFFFFF))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where((a >= 0) & (b >= 0), a * len(h) + b, -1))], names=[*batch.schema.names, "place"])


def rare_bigrams(texts: DataFrame, rest: DataFrame, hot, first: int) -> tuple[DataFrame, list[int], list[int]]:
    """((id, key, c, v_t, v_b, w_t, w_b, place), unknown, others): the distinct bigrams of each text that have a word not listed.

    Such a word is one of `rest`, numbered from `first` on, or unknown. v_t to w_b are the counts in both models of those of
    `rest`; place is that of two hot words, of which one is unknown. `unknown` are the counts of the unknown word,
    `others` those of all words of `rest`. A word that isn't listed is rarer than those that are, so no key of the joins is hot."""
    each = texts.select(F.monotonically_increasing_id().alias("row"), "id", "side", "ids", "rare").mapInArrow(lambda b: _unlisted(b, hot), "row long, id long, side int, v long, v_h long, w long, w_h long")
    each = stored(each)
    tokens = each.where("w_h IS NOT NULL")  # a word is the second one of one bigram each time it occurs
    counts = [F.count_if(F.col("side") == TARGET).alias("t"), F.count_if(F.col("side") == BACKGROUND).alias("b")]
    here = tokens.groupBy(F.col("w_h").alias("h")).agg(*counts)
    lexicon = durable(numbered(rest.select("h"), first).join(here, "h", "left").select("h", "number", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("t", "b")]))
    every, others = (x if x.t is not None else {"t": 0, "b": 0} for x in (tokens.agg(*counts).first(), lexicon.agg(F.sum("t").alias("t"), F.sum("b").alias("b")).first()))
    for name in ("v", "w"):
        one = lexicon.select(F.col("h").alias("_h"), F.col("number").alias("_number"), F.col("t").alias(f"{name}_t"), F.col("b").alias(f"{name}_b"))
        missing = F.col(f"{name}_h").isNull()
        apart = F.coalesce(f"{name}_h", F.xxhash64("row", "v", "w"))  # listed words are spread, and none of them is looked up
        number = F.when(missing, F.col(name)).otherwise(F.coalesce("_number", F.lit(UNKNOWN)))
        each = each.join(one, apart == F.col("_h"), "left").withColumn(name, number.cast("long")).drop("_h", "_number", f"{name}_h")
    columns = ["v_t", "v_b", "w_t", "w_b"]
    key = F.shiftleft("v", 32).bitwiseOR(F.col("w")).alias("key")
    sums = each.groupBy("row", "id", "side", key).agg(F.count("*").alias("n"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in columns])
    sums = sums.select("id", "key", (4 * F.col("n") + F.col("side")).cast("int").alias("c"), *columns)
    found = stored(sums.mapInArrow(lambda b: _placed(b, hot), f"id long, key long, c int, {', '.join(f'{c} long' for c in columns)}, place long"))
    return found, [every["t"] - others["t"], every["b"] - others["b"]], [others["t"], others["b"]]


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(id, n, t, b): losses of rows (id, key, c, counts of the bigram, 32 bits each); further columns are the counts of its words that are not listed."""
    m = model.value
    for batch in batches:
        key, c, both, *counts = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, batch.num_columns)]
        n, side, both = c >> 2, c & 3, (both & 0xFFFFFFFF, both >> 32)
        contexts, tokens = ([m["words"][k][np.minimum(at, len(m["words"][k]) - 1)] for k in (0, 1)] for at in (key >> 32, key & 0xFFFFFFFF))
        if counts:
            contexts = [np.where(key >> 32 < len(x), y, z) for x, y, z in zip(m["words"], contexts, counts[:2], strict=True)]
            tokens = [np.where(key & 0xFFFFFFFF < len(x), y, z) for x, y, z in zip(m["words"], tokens, counts[2:], strict=True)]
        alone = [_alone(x, m["totals"][k], m["size"]) for k, x in enumerate(tokens)]
        own = [np.where(side == k, n, 0) for k in (TARGET, BACKGROUND)]
        inside = [np.where(v > 0, (x - mine) / np.maximum(1, v), 0.0) for x, mine, v in zip(both, own, contexts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *[pa.array(x) for x in _losses(alone, inside, n)]], names=["id", "n", "t", "b"])


def _marked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """`texts` with `target` where `ids` (one distinct column `_id`) has their id; numbers, not texts, are shuffled once."""
    apart = F.coalesce("id", F.xxhash64("ids"))  # rows without id are spread, and none of them is a target
    side = ids.withColumn("_found", F.lit(True))
    return texts.join(side, (apart == F.col("_id")) & F.col("id").isNotNull(), "left").select("id", F.col("_found").isNotNull().alias("target"), "ids", "rare")


def cross_entropy_difference(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str | None = "target", vocab_share: float = 0.0, targets: DataFrame | None = None) -> DataFrame:
    """One row for each id of `docs`: id, n_tokens, target_loss, background_loss (nats a token), score (background less target).

    Target documents are those with a true `target_col` (null is false), or those whose id is among `targets`, a table of
    ids. Rows of one id (null ids too) are one document. A null text counts as empty: it is the one token END. Texts are
    read whole, however long. An empty table gives an empty result. Only the named columns are read. The vocabulary is
    every word that occurs twice, and makes `vocab_share` of all tokens. The LISTED most frequent go to the tasks as arrays; if
    there are more, bigrams with one of the others meet its number and counts in shuffled joins. Up to LISTED targets are
    marked in the tasks too; of more, numbered texts meet them in one shuffled join. Without target documents, or without
    others, a model without counts gives every word the same chance.

    A bigram that is not of two hot words makes less than about 1 / HOT of the rows that are dealt by bigram."""
    spark = docs.sparkSession
    target = F.lit(False) if targets is not None or target_col is None else F.coalesce(F.col(f"`{target_col}`").cast("boolean"), F.lit(False))
    rows = for_python(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), target.alias("target")))
    words = durable(rows.select("text").mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    every = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    known = words.where((F.col("n") >= 2) & (F.col("n") >= vocab_share * every))
    count = known.count()
    listed, rest = (known, None) if count <= LISTED else _divided(known)
    found = listed.select("h", "n").toArrow().sort_by("h")
    size = found.num_rows + FIRST  # so many numbers are listed; the next one is that of any word that isn't
    often = np.argsort(-found.column("n").to_numpy(), kind="stable")[:HOT] + FIRST
    vocabulary, given = spark.sparkContext.broadcast((found.column("h").to_numpy(), UNKNOWN if rest is None else size)), None
    ids = None if targets is None else durable(targets.select(F.col(targets.columns[0]).cast("long").alias("_id")).where("_id IS NOT NULL").distinct())
    marked = ids is not None and ids.count() <= LISTED
    if marked:
        given = spark.sparkContext.broadcast(np.sort(ids.toArrow().column("_id").to_numpy()))
    texts = rows.mapInArrow(lambda b: _numbered(b, vocabulary, given), _TEXTS)
    texts = for_python(stored(texts if ids is None or marked else _marked(texts, ids)))
    sizes = {r.target: r.n for r in texts.groupBy("target").agg(F.sum(F.size("ids") + 1).alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "id long, n_tokens long, target_loss double, background_loss double, score double").withColumnRenamed("id", id_col)
    share = min(1.0, sizes.get(True, 0) / max(1, sizes.get(False, 0)))
    texts = texts.select("id", F.when(F.col("target"), TARGET).when(matched(F.col("id"), F.col("ids"), share), BACKGROUND).otherwise(NEITHER).alias("side"), "ids", "rare")
    often = np.sort(np.concatenate([[UNKNOWN, START, END], often]))
    ranks = np.full(size + 1, -1, np.int16)
    ranks[often] = np.arange(len(often))
    hot = spark.sparkContext.broadcast((often, ranks))
    n, side = F.shiftright("c", 2).cast("long"), F.col("c").bitwiseAND(F.lit(3))
    tallies = texts.where(F.col("side") != NEITHER).select("side", "ids").mapInArrow(lambda b: _tallied(b, hot), "key long, target long, background long")
    if rest is not None:
        rare, unknown, others = rare_bigrams(texts, rest, hot, size + 1)
        tallies = tallies.unionByName(rare.where("place >= 0").select(F.col("place").alias("key"), *[F.when(side == k, n).otherwise(0).alias(c) for k, c in ((TARGET, "target"), (BACKGROUND, "background"))]))
    tallies = durable(tallies.groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background")))
    bits = size.bit_length() if size.bit_length() <= 26 else 0
    model = {"size": float(count + FIRST)}
    model["square"] = _arrays(tallies.where("key >= 0"), len(often) ** 2)
    model["words"] = _arrays(tallies.where("key < 0").select((-1 - F.col("key")).alias("key"), "target", "background"), size)
    if rest is not None:
        for x, more in zip(model["words"], unknown, strict=True):
            x[UNKNOWN] += more
    model["hot_count"] = [x[often] for x in model["words"]]
    model["totals"] = [int(x.sum()) - int(x[START]) for x in model["words"]]
    if rest is not None:
        model["totals"] = [x + more for x, more in zip(model["totals"], others, strict=True)]
    model["hot_alone"] = [_alone(x, model["totals"][k], model["size"]) for k, x in enumerate(model["hot_count"])]
    shared = spark.sparkContext.broadcast(model)
    grams = texts.select("id", "side", "ids").mapInArrow(lambda b: _bigrams(b, hot, bits), "id long, key long, c int")
    both = F.sum(F.when(side == TARGET, n).when(side == BACKGROUND, F.shiftleft(n, 32)).otherwise(F.lit(0))).over(Window.partitionBy("key")).alias("both")
    each = grams.select("id", "key", "c", both).mapInArrow(lambda b: _scored(b, shared), _SUMS).unionByName(texts.select("id", "side", "ids").mapInArrow(lambda b: _hot_losses(b, hot, shared), _SUMS))
    if rest is not None:
        each = each.unionByName(rare.where("place < 0").select("id", "key", "c", both, "v_t", "v_b", "w_t", "w_b").mapInArrow(lambda b: _scored(b, shared), _SUMS))
        each = each.unionByName(rare.where("place >= 0").select("id", "c", "place").mapInArrow(lambda b: _placed_losses(b, hot, shared), _SUMS))
    each = each.groupBy("id").agg(F.sum("n").alias("n_tokens"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    t, b = F.col("t") / F.col("n_tokens"), F.col("b") / F.col("n_tokens")
    return each.select(F.col("id").alias(id_col), "n_tokens", t.alias("target_loss"), b.alias("background_loss"), (b - t).alias("score"))


def matched(id_: Column, ids: Column, share: float) -> Column:
    """Whether a document that is not a target is drawn for the background: about `share` of them, by a hash of id and length."""
    return F.pmod(F.xxhash64(id_, F.size(ids)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def _arrays(counts: DataFrame, size: int) -> list[np.ndarray]:
    """Counts of both models by key, from at most `size` rows."""
    found = counts.select("key", "target", "background").toArrow()
    out = [np.zeros(size, np.int64), np.zeros(size, np.int64)]
    for x, name in zip(out, ("target", "background"), strict=True):
        x[found.column("key").to_numpy()] = found.column(name).to_numpy()
    return out


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(documents(spark, sf_dir).select("doc_id", "text"), target_col=None, targets=good)


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
ORACLES: dict[str, str] = {}
