"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most RADIUS bits have a word in common among the words within RADIUS / 2 bits of
each; and fingerprints with such a word in common differ in at most RADIUS bits. So the groups of equal words
("variants") give exactly the links. With 64 bits and half a radius of 2 a fingerprint has 2,081 variants. To keep
them out of the shuffle, it is the fingerprint that is sent to every cell (variants with the same leading bits) in
which it has variants; the cell makes the variants there, in blocks of bounded size. Cells with many fingerprints are
divided by further bits first, so that a crowded region is many tasks. A fingerprint is sent to 37 cells of 8 bits, and to
more as the corpus grows (277 of 23 bits for 10^11 documents): about the square of the logarithm."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, connected_components, documents, durable, for_python, fresh, lookup, sized, slices, small

WORDS, RADIUS, SEED = 4, 4, 42
#: Variants that a cell makes at once.
BLOCK = 1 << 21
#: Fingerprints that a task takes for one cell; a cell with more is divided by its next SPLIT bits, up to LAST bits in all.
CELL_ROWS, SPLIT, LAST = 1 << 18, 8, 56
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits, each 1 if set in over half the XXH64 (seed 42) of the shingles of `words` words; 0 if there is no word.

    A-Z count as a-z; words are runs of other than ASCII white space; shingles repeat as often as the text has them; a
    text of fewer words is one shingle."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(blanks) < words:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *(blanks[: len(blanks) - words + 2] + 1).tolist()]
    ends = [*blanks[words - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(ends))
    spread = hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int32) << 8)
    ones = (np.bincount(spread.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        prints = np.array([fingerprint(t or b"", words) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp long) of every row of `docs`; the text is read whole, a null one counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return for_python(rows).mapInArrow(lambda batches: _fingerprints(batches, words), "id long, fp long")


def _masks(bits: int, flips: int) -> np.ndarray:
    """All words with exactly `flips` (at most 2) of the lowest `bits` bits set."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    if flips < 2:
        return one if flips else np.zeros(1, np.uint64)
    first, second = np.triu_indices(bits, 1)
    return one[first] | one[second]


def _balls(left: np.ndarray, bits: int, half: int) -> int:
    """Variants that words with `left` flips left (by count) make over `bits` bits."""
    sizes = [1, 1 + bits, 1 + bits + bits * (bits - 1) // 2]
    return sum(int((left == k).sum()) * sizes[k] for k in range(half + 1))


def _links(fps: np.ndarray, left: np.ndarray, bits: int, labels: np.ndarray, index: np.ndarray, half: int) -> None:
    """Lowers `labels` (by position) to the least label among words with a common variant in this cell."""
    if len(index) < 2:
        return
    if _balls(left, bits, half) > BLOCK and bits > 1:
        top = (fps >> np.uint64(bits - 1)) & np.uint64(1)
        for side in (0, 1):
            rest = left - (top != side)
            keep = rest >= 0
            _links(fps[keep], rest[keep], bits - 1, labels, index[keep], half)
        return
    low = np.uint64((1 << bits) - 1)
    each = [_masks(bits, k) for k in range(half + 1)]
    masks, counts = np.concatenate(each), np.cumsum([len(m) for m in each])
    words, owners = [], []
    for k in range(half + 1):
        at = np.flatnonzero(left == k)
        words.append(((fps[at] & low)[:, None] ^ masks[None, : counts[k]]).ravel())
        owners.append(np.repeat(at, counts[k]))
    word, owner = np.concatenate(words), np.concatenate(owners)
    ordered = np.sort(word)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    mark = np.zeros(1 << 16, bool)
    mix = lambda w: ((w * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    mark[mix(twice)] = True
    maybe = np.flatnonzero(mark[mix(word)])
    place = np.minimum(np.searchsorted(twice, word[maybe]), len(twice) - 1)
    hit = twice[place] == word[maybe]
    group, member = place[hit], index[owner[maybe[hit]]]
    while True:
        least = np.full(len(twice), np.iinfo(np.int64).max)
        np.minimum.at(least, group, labels[member])
        before = labels[member]
        np.minimum.at(labels, member, least[group])
        if (labels[member] == before).all():
            return


def _cell_links(table: pa.Table, half: int) -> pa.Table:
    """Edges (a, b) from each fingerprint of one cell to the smallest it is linked to there, by their smallest ids."""
    cell, width = np.uint64(table.column("cell")[0].as_py()), table.column("width")[0].as_py()
    fps = table.column("fp").to_numpy().view(np.uint64)
    ids = table.column("id").to_numpy().astype(np.int64)
    left = half - np.bitwise_count((fps >> np.uint64(64 - width)) ^ cell).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, fps, left = ids[order], fps[order], left[order]
    labels = np.arange(len(ids))
    _links(fps, left, 64 - width, labels, np.arange(len(ids)), half)
    linked = labels < np.arange(len(ids))
    return pa.table({"a": ids[labels[linked]], "b": ids[linked]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def links(prints: DataFrame, total: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect exactly those rows of `prints` (id, distinct fp) that links of at most `radius` bits do."""
    half = radius // 2
    wanted = 2081 * max(1, total) // (1 << 25)
    width = min(32, max(8, wanted.bit_length()))
    masks = lambda bits, flips: F.lit(np.concatenate([_masks(bits, k) for k in range(flips + 1)]).astype(np.int64).tolist())
    lead = lambda bits: F.shiftrightunsigned(F.col("fp"), 64 - bits)
    around = lambda prefix: F.explode(F.transform(masks(width, half), lambda m: prefix.bitwiseXOR(m))).alias("cell")
    sent = prints.select("id", "fp", around(lead(width)))
    counts = prints.groupBy(lead(width).alias("prefix")).agg(F.count("*").alias("n")).select("n", around(F.col("prefix")))
    dealt = []
    while True:
        heavy = durable(counts.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > CELL_ROWS).select("cell"))
        if width + SPLIT > LAST or heavy.isEmpty():
            dealt.append(sent.withColumn("width", F.lit(width)))
            break
        side = sized(heavy)
        dealt.append(sent.join(side, "cell", "left_anti").withColumn("width", F.lit(width)))
        used = F.bit_count(lead(width).bitwiseXOR(F.col("cell")))
        rest = F.lit(None)
        for k in range(half, -1, -1):
            rest = F.when(used == k, masks(SPLIT, half - k)).otherwise(rest)
        low = lead(width + SPLIT).bitwiseAND(F.lit((1 << SPLIT) - 1))
        divided = F.transform(rest, lambda m: F.shiftleft("cell", SPLIT).bitwiseOR(low.bitwiseXOR(m)))
        sent = sent.join(side, "cell", "left_semi").select("id", "fp", F.explode(divided).alias("cell"))
        width += SPLIT
        counts = sent.select("cell", F.lit(1).alias("n"))
    every = reduce(DataFrame.unionByName, dealt)
    return every.groupBy("width", "cell").applyInArrow(lambda t: _cell_links(t, half), "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row for each row of `docs`: id, fp, component_id (the smallest id that links of at most `radius` bits reach).

    `radius` is an even number up to 4. Texts without a word (null, empty, blank) have fingerprint 0 and link like any other. Rows that repeat a
    text share its fingerprint; rows with a null id get the component of their fingerprint (null if all ids are). An
    empty table gives an empty result. Only `id_col` (an integer) and `text_col` are read."""
    if radius not in (0, 2, 4):
        raise ValueError("radius must be 0, 2 or 4")
    rows = durable(fingerprints(docs, id_col, text_col, words))
    total = rows.count()
    prints = durable(rows.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    edges = links(prints.where("id IS NOT NULL").select("id", "fp"), prints.count(), radius)
    parts = connected_components(edges, total).withColumnRenamed("node", "id")
    classes = durable(prints.join(parts, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"), "n"))
    return lookup(rows, classes, "fp", F.col("n") >= max(1000, int(total * HOT_SHARE))).select(
        F.col("id").alias(id_col), "fp", "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """`docs` with one document of each component, the one with the smallest id; rows that repeat an id stay or go together.

    The ids to drop are few where few documents have near copies: they are broadcast if they prove few, else joined by
    a shuffle. Rows with a null id stay."""
    found = near_components(docs, id_col, text_col, words, radius)
    name = fresh(docs, "_gone")
    gone = durable(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct())
    side = F.broadcast(gone) if small(gone) else gone
    return docs.join(side, F.col(id_col) == F.col(name), "left_anti")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}
ORACLES: dict[str, str] = {}
