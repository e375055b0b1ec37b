"""Alignment of two tokenizers' tokens over the same bytes.

The tokens of B form a static index of intervals; two bisections for each token of A list the B tokens that overlap it.
Places that no token of either side spans cut the text into groups. The corpus decides which B tokens are an A token's
usual partners: a pair counts the documents that hold it linked."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, for_python, slices, stored
from .packing import _LONG_BLANK, LONG_BLANK, _encoding, tokenizer_folder
from .sentencepiece import MARK

#: Pairs that are broadcast with their counts (17 bytes each); links of the others meet their counts in a shuffled join.
HOT_PAIRS = 1 << 20
#: Links that a task gathers before it hands on their counts.
GATHER = 1 << 21
#: Characters of new words that are aligned at once, and words that a Python worker remembers (about 150 bytes each, and
#: at most 8 links for each on average), but for those of one batch beyond.
CHUNK, WORDS = 1 << 16, 400_000


class Index:
    """Static index of intervals [start, end) whose starts and ends don't fall: tokens in order, gaps and overlaps allowed."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query [start, end) the run [low, high) of intervals that overlap it."""
        low = np.searchsorted(self.ends, starts, side="right")
        return low, np.maximum(low, np.searchsorted(self.starts, ends, side="left"))

    def spanned(self, places: np.ndarray) -> np.ndarray:
        """Whether an interval begins before the place and ends behind it."""
        return np.searchsorted(self.starts, places, side="left") > np.searchsorted(self.ends, places, side="right")


def align(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of every link, then the group of each A token and of each B token; a and b: starts, ends."""
    index = Index(*b)
    low, high = index.stab(*a)
    count = high - low
    of_a = np.repeat(np.arange(len(low)), count)
    of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(count) - count - low, count)
    ends = np.union1d(a[1], b[1])
    cuts = ends[~(index.spanned(ends) | Index(*a).spanned(ends))]
    return of_a, of_b, np.searchsorted(cuts, a[1], side="left"), np.searchsorted(cuts, b[1], side="left")


class Tokens:
    """One side: ids of a text and the bytes of each id."""

    def __init__(self, surfaces: list[bytes]):
        self.surfaces = surfaces
        self.lengths = np.array([len(x) for x in surfaces], np.int64)
        decimal = [str(i).encode() for i in range(len(surfaces))]
        # Decimal ids with what may follow them, so that a text's groups are one join.
        self.written = np.array([x + s for s in (b",", b"|", b";") for x in decimal], object)

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(self.lengths[ids])
        return ends - self.lengths[ids], ends

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.surfaces.__getitem__, ids))


class ByteLevel(Tokens):
    """byte_bpe_50k: special tokens' strings are plain text. Long blanks go to the library of the JSON file."""

    def __init__(self, folder: str):
        self.folder, self.encoding = folder, _encoding(folder)
        super().__init__([self.encoding.decode_single_token_bytes(i) for i in range(self.encoding.n_vocab)])

    def ids(self, text: str) -> np.ndarray:
        if len(text) >= LONG_BLANK and _LONG_BLANK.search(text):
            return np.array(_literal_encoding(self.folder).encode(text, add_special_tokens=False).ids, np.int64)
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)


@cache
def _literal_encoding(folder: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    found.encode_special_tokens = True
    return found


class PieceLevel(Tokens):
    """piece_bpe_32k.model, which puts a blank before the text."""

    def __init__(self, folder: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])
        # Whether no piece has a mark after another character, so that a text may be cut before a blank.
        self.apart = not any(MARK in p.lstrip(MARK) for i, p in enumerate(pieces) if not self.model.is_byte(i))

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int64)


@cache
def tokenizers(folder: str) -> tuple[Tokens, Tokens]:
    return ByteLevel(folder), PieceLevel(folder)


def written_groups(a: Tokens, b: Tokens, a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> np.ndarray:
    """The ids of all groups in order, each with its separator: a1,a2|b1;a3|b2,b3; as bytes objects."""
    a_last = np.append(a_group[1:] != a_group[:-1], True)
    b_last = np.append(b_group[1:] != b_group[:-1], True)
    out = np.empty(len(a_ids) + len(b_ids), object)
    out[np.arange(len(a_ids)) + np.searchsorted(b_group, a_group, side="left")] = a.written[a_ids + np.where(a_last, len(a.lengths), 0)]
    out[np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, side="right")] = b.written[b_ids + np.where(b_last, 2 * len(b.lengths), 0)]
    return out


#: Before a blank that follows no white space both tokenizers end a token: no pattern of A has a blank after another
#: character, and no piece of B has one (`apart`).
_CUT = re.compile(r"(?<=\S)(?= )")


class Words:
    """Words (each with the blank before it) of a Python worker's texts and their alignment, WORDS of them at most.

    Texts are cut where both tokenizers end a token whatever stands around, so a word's tokens, groups and links are the
    same in every text."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.written: list[bytes | None] = []
        # Of each word: tokens of A and B, groups, links, and where its pairs begin among all.
        self.numbers, self.pairs = [np.zeros((0, 4), np.int64)], [np.zeros(0, np.int64)]
        self.sizes = 0

    def cut(self, text: str) -> list[str]:
        return _CUT.split(" " + text) if self.b.apart else [" " + text]

    def add(self, words: list[str]) -> None:
        """Solves new words, up to CHUNK characters of them as one text."""
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= CHUNK and not words[end - 1][-1].isspace()):
                size += len(words[end])
                end += 1
            if not self._solve(words[at:end]):
                for word in words[at:end]:
                    if end - at == 1 or not self._solve([word]):
                        self._put([word], [None], np.zeros((1, 4), np.int64), np.zeros(0, np.int64))
            at = end

    def _put(self, words: list[str], written: list[bytes | None], numbers: np.ndarray, pairs: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.written), len(self.written) + len(words)), strict=True))
        self.written += written
        self.numbers.append(numbers)
        self.pairs.append(pairs)
        self.sizes += len(pairs)

    def _solve(self, words: list[str]) -> bool:
        """False where the bytes of the tokens are not those of the words."""
        a, b, text = self.a, self.b, "".join(words)
        a_ids, b_ids, whole = a.ids(text), b.ids(text[1:]), text.encode()
        if a.joined(a_ids.tolist()) != whole or b.joined(b_ids.tolist()) != whole:
            return False
        of_a, of_b, a_group, b_group = align(a.spans(a_ids), b.spans(b_ids))
        ends = np.cumsum([len(w.encode()) for w in words])
        a_end, b_end = a.spans(a_ids)[1], b.spans(b_ids)[1]
        a_at, b_at = (np.concatenate([[0], np.searchsorted(x, ends, side="right")]) for x in (a_end, b_end))
        if len(words) > 1 and not (np.array_equal(a_end[a_at[1:] - 1], ends) and np.array_equal(b_end[b_at[1:] - 1], ends)):
            return False
        groups = np.concatenate([[0], a_group[a_at[1:] - 1] + 1])
        links = np.searchsorted(of_a, a_at)
        parts = written_groups(a, b, a_ids, b_ids, a_group, b_group).tolist()
        cuts = (a_at + b_at).tolist()
        numbers = np.stack([np.diff(x) for x in (a_at, b_at, groups, links)], axis=1)
        self._put(words, [b"".join(parts[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], numbers, a_ids[of_a] * len(b.lengths) + b_ids[of_b])
        return True

    def aligned(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """Of each text: (n_a, n_b, n_groups, n_links), sha256 of its groups, distinct pairs, links of each pair."""
        cut = [self.cut(t) if t else [] for t in texts]
        new = list({w: None for words in cut for w in words if w not in self.known})
        if len(self.written) + len(new) > WORDS or self.sizes > 8 * WORDS:
            self.clear()
            new = list({w: None for words in cut for w in words})
        self.add(new)
        self.numbers, self.pairs = [np.concatenate(self.numbers)], [np.concatenate(self.pairs)]
        numbers, pairs = self.numbers[0], self.pairs[0]
        at = [[self.known[w] for w in words] for words in cut]
        digests, good = [], []
        for k, own in enumerate(at):
            parts = [self.written[i] for i in own]
            if not own or None in parts:
                digests.append("")
            else:
                good.append(k)
                digests.append(hashlib.sha256(b"".join(parts)[:-1]).hexdigest())
        totals = np.zeros((len(texts), 4), np.int64)
        distinct, links = ([np.zeros(0, np.int64)] * len(texts) for _ in range(2))
        if good:
            own = np.array([i for k in good for i in at[k]], np.int64)
            doc = np.repeat(np.arange(len(good)), [len(at[k]) for k in good])
            begins = np.concatenate([[0], np.cumsum([len(at[k]) for k in good])[:-1]])
            totals[good] = np.add.reduceat(numbers[own], begins, axis=0)
            count = numbers[own, 3]
            first = (np.cumsum(numbers[:, 3]) - numbers[:, 3])[own]
            place = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
            size = len(self.a.lengths) * len(self.b.lengths)
            found, n = np.unique(np.repeat(doc, count) * size + pairs[place], return_counts=True)
            bounds = np.searchsorted(found, np.arange(1, len(good)) * size)
            for k, x, y in zip(good, np.split(found % size, bounds), np.split(n, bounds), strict=True):
                distinct[k], links[k] = x, y
        return totals, digests, distinct, links


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_SHARED = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _tokens(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    words = _words(folder)
    for batch in slices(batches):
        totals, digests, pairs, links = words.aligned(batch.column(2).to_pylist())
        columns = [batch.column(0), batch.column(1), *(pa.array(totals[:, k]) for k in range(4)), pa.array(digests, pa.string())]
        blobs = [pa.array([x.astype(kind).tobytes() for x in found], pa.binary()) for found, kind in ((pairs, np.int64), (links, np.uint32))]
        yield pa.RecordBatch.from_arrays([*columns, *blobs], names=["row", "id", *_NUMBERS, "groups_sha256", "pairs", "links"])


@cache
def _words(folder: str) -> Words:
    return Words(*tokenizers(folder))


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): how many rows hold it, gathered GATHER links at a time."""
    held: list[np.ndarray] = []

    def handed() -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    size = 0
    for batch in batches:
        for blob in batch.column(0):
            held.append(np.frombuffer(blob.as_buffer(), np.int64))
            size += len(held[-1])
            if size >= GATHER:
                size = 0
                yield handed()
    if held:
        yield handed()


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether no partner of its A token has more. Durable.

    Counts are gathered within tasks; what is shuffled is a row for each pair and task. An A token has at most as many
    pairs as B has entries, and there is one highest count for each A entry, so that side is bounded by the vocabulary."""
    counts = for_python(rows.select("pairs")).mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = durable(counts.withColumn("a", F.floor(F.col("pair") / b_size)))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return durable(counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def hot_floor(counts: DataFrame, most: int) -> int:
    """The least n that at most `most` pairs reach; from a histogram of a few hundred steps."""
    step = F.floor(F.log2("n") * 16)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    floor, total = (steps[0].least + 1 if steps else 1), 0
    if steps and steps[0].pairs > most:  # more equals than fit: none is broadcast
        return 1 << 62
    for r in steps:
        total += r.pairs
        if total > most:
            break
        floor = r.least
    return floor


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row for each row of `docs`: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    Null and empty texts, and texts that either tokenizer doesn't give back byte by byte (B takes U+2581 for a blank),
    have no tokens: zeros and an empty digest. Whole texts are encoded, however long, word by word. Rows that repeat an id or a text are documents of
    their own; a null id stays null. An empty table gives an empty result. Only the two columns are read.

    Texts are encoded once; each row's distinct pairs are kept (written). The `hot_pairs` most frequent pairs are
    broadcast with their counts; links of other pairs are shuffled to theirs, and none is left out."""
    spark, folder = docs.sparkSession, folder or tokenizer_folder()
    b_size = len(tokenizers(folder)[1].lengths)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = stored(for_python(texts).mapInArrow(lambda x: _tokens(x, folder), f"row long, {_SHARED}, pairs binary, links binary"))
    counts = pair_counts(rows, b_size)
    floor = hot_floor(counts, hot_pairs)
    hot = counts.where(F.col("n") >= floor).orderBy("pair").toArrow()
    known = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))
    cold = counts.where(F.col("n") < floor)

    def split(blobs: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        pairs, links = np.frombuffer(blobs[0].as_buffer(), np.int64), np.frombuffer(blobs[1].as_buffer(), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(known.value[0], pairs), max(0, len(known.value[0]) - 1))
        return pairs, links, at, known.value[0][at] == pairs if len(known.value[0]) else np.zeros(len(pairs), bool)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for blobs in zip(batch.column("pairs"), batch.column("links"), strict=True):
                _, links, at, ok = split(blobs)
                sums.append((int(links[ok][known.value[2][at[ok]]].sum()), int((links[ok] * known.value[1][at[ok]]).sum())))
            kept = batch.select(["row", "id", *_NUMBERS, "groups_sha256"])
            more = [pa.array([x[k] for x in sums], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*kept.schema.names, "n_best", "count_sum"])

    def unscored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [split(x) for x in zip(batch.column("pairs"), batch.column("links"), strict=True)]
            own = np.repeat(batch.column("row").to_numpy(), [int((~x[3]).sum()) for x in parts])
            others = [np.concatenate([x[k][~x[3]] for x in parts]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, others)], names=["row", "pair", "links"])

    found = rows.mapInArrow(scored, f"row long, {_SHARED}, n_best long, count_sum long")
    if cold.limit(1).count():
        rest = rows.select("row", "pairs", "links").mapInArrow(unscored, "row long, pair long, links long").join(cold, "pair")
        rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("b"), F.sum(F.col("links") * F.col("n")).alias("c"))
        found = found.join(rest, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("c", F.lit(0))}).drop("b", "c")
    return found.drop("row").withColumnRenamed("id", id_col)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir))


QUERIES = {"op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment}
ORACLES: dict[str, str] = {}
