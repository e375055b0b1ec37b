"""SentencePiece unigram encoding and decoding: Viterbi over a double-array trie of pieces with log scores.

White space is marked in the text, characters that no piece covers fall back to bytes. All distinct words of a batch
are walked through the trie and solved at once, position by position."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, for_python, slices

MARK = "▁"
#: How much worse than the worst piece a character without piece is.
UNKNOWN_PENALTY = 10.0
#: Words whose pieces a Python worker remembers (about 200 bytes each), but for those of one batch beyond.
CACHE = 500_000


def vocabulary(path: str | None = None) -> list[tuple[str, float, str]]:
    """(piece, log score, kind) of a SentencePiece file, in the order of ids; kinds: piece, byte, control.

    The public file ranks its pieces but has no log probabilities; each gets that of its rank under Zipf's law."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    n = model.get_piece_size()
    total = float(np.log(np.sum(1 / (np.arange(n) + 2.7))))
    kind = lambda i: "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece"
    return [(model.id_to_piece(i), float(-np.log(i + 2.7) - total), kind(i)) for i in range(n)]


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie: from node s, byte c leads to t = base[s] + c if check[t] == s; value[t] is an id or -1."""
    root: dict = {}
    for key, value in keys:
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = value
    count = sum(len(key) for key, _ in keys) + 2
    size = 2 * count + 1024
    base, check, values = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
    check[0] = -2
    used = np.zeros(size, bool)
    used[0] = True
    first = {1: 1, 2: 1}  # where a node with one child, and one with more, looks first
    queue = [(0, root)]
    for at, node in queue:
        values[at] = node.pop(-1, -1)
        if not node:
            continue
        codes = sorted(node)
        start = max(1, first[min(2, len(codes))] - codes[0])
        while True:  # a window of places at once
            taken = np.zeros(512, bool)
            for c in codes:
                taken |= used[start + c : start + c + 512]
            if not taken.all():
                start += int(taken.argmin())
                break
            start += 512
        base[at] = start
        first[min(2, len(codes))] = start + codes[0] if len(codes) == 1 else max(first[2], start + codes[0] - 32)
        for c in codes:
            check[start + c], used[start + c] = at, True
            queue.append((start + c, node[c]))
    end = int(base.max()) + 256
    return base[:end], check[:end], values[:end]


class Pieces:
    """A vocabulary ready for use."""

    def __init__(self, entries: list[tuple[str, float, str]]):
        usable = [(p, i) for i, (p, _, kind) in enumerate(entries) if kind == "piece" and p]
        self.base, self.check, self.value = double_array([(p.encode(), i) for p, i in usable])
        self.score = np.array([s for _, s, _ in entries])
        self.bytes = np.full(256, -1, np.int64)
        self.surface: list[bytes] = []
        for i, (p, _, kind) in enumerate(entries):
            if kind == "byte":
                self.bytes[int(p[3:5], 16)] = i
            self.surface.append(bytes([int(p[3:5], 16)]) if kind == "byte" else b"" if kind == "control" else p.replace(MARK, " ").encode())
        self.worst = float(min((self.score[i] for _, i in usable), default=0.0)) - UNKNOWN_PENALTY
        # Where no piece has a mark after another character, words can be solved apart.
        self.apart = not any(MARK in p.lstrip(MARK) for p, _ in usable)
        self.known = Store()
        self.flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _edges(self, data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of all pieces that stand in the text; `ends` bounds each start."""
        found = [[], [], []]
        at, node, length = starts, np.zeros(len(starts), np.int64), 0
        limit = ends
        while len(at):
            inside = at + length < limit
            at, node, limit = at[inside], node[inside], limit[inside]
            to = self.base[node] + data[at + length]
            ok = (self.base[node] > 0) & (self.check[to] == node)
            at, node, limit = at[ok], to[ok], limit[ok]
            length += 1
            hit = self.value[node] >= 0
            for column, x in zip(found, (at[hit], at[hit] + length, self.value[node[hit]]), strict=True):
                column.append(x)
        return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, their number, score, bytes by fallback) of the best segmentation of each word; of equal ones, that with the longer last pieces."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        word_of = np.repeat(np.arange(len(raw)), sizes)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        ends = (first + sizes)[word_of[starts]]
        begin, end, piece = self._edges(data, ends, starts)
        after = np.append(starts[1:], len(data))  # the next character, also of the next word
        single = np.zeros(len(data) + 1, np.int64)
        single[starts] = after
        covered = np.zeros(len(data) + 1, bool)
        covered[begin[single[begin] == end]] = True
        bare = starts[~covered[starts]]
        begin = np.concatenate([begin, bare])
        end = np.concatenate([end, single[bare]])
        piece = np.concatenate([piece, np.full(len(bare), -1)])
        weight = np.where(piece >= 0, self.score[piece], self.worst)
        word = word_of[begin]
        # Places: one more than bytes for each word, so that the end of a word isn't the start of the next.
        source, target = begin + word, end + word
        order = _order(end - first[word], target, source)
        source, target, piece, weight, word, begin, end = (x[order] for x in (source, target, piece, weight, word, begin, end))
        best = np.full(len(data) + len(raw), -np.inf)
        best[first + np.arange(len(raw))] = 0
        back = np.full(len(best), -1)
        reach = end - first[word]
        cuts = np.flatnonzero(np.diff(reach)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(reach)], strict=True):
            value, t = best[source[a:b]] + weight[a:b], target[a:b]
            heads = np.concatenate([[0], np.flatnonzero(np.diff(t)) + 1]) if b > a else np.zeros(0, np.int64)
            if not len(heads):
                continue
            top = np.maximum.reduceat(value, heads)
            hit = np.flatnonzero(value == np.repeat(top, np.diff(np.append(heads, b - a))))
            _, keep = np.unique(t[hit], return_index=True)
            back[t[hit[keep]]] = a + hit[keep]
            best[t[heads]] = top
        at = first + sizes + np.arange(len(raw))
        live = np.flatnonzero(sizes > 0)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            edge = back[at[live]]
            steps.append((live, edge))
            at[live] = source[edge]
            live = live[at[live] > first[live] + live]
        final = np.where(sizes > 0, best[first + sizes + np.arange(len(raw))], 0.0)
        none = np.zeros(len(raw), np.int64)
        if not steps:
            return np.zeros(0, np.int32), none, final, none
        owner, edge = (np.concatenate(c[::-1]) for c in zip(*steps, strict=True))
        order = np.argsort(owner, kind="stable")
        owner, edge = owner[order], edge[order]
        known = piece[edge] >= 0
        width = np.where(known, 1, end[edge] - begin[edge])  # a character without piece gives its bytes
        ids = np.repeat(piece[edge], width)
        ids[np.repeat(~known, width)] = self.bytes[data[ragged(begin[edge[~known]], width[~known])]]
        number = np.bincount(owner, weights=width, minlength=len(raw)).astype(np.int64)
        fallback = np.bincount(owner, weights=np.where(known, 0, width), minlength=len(raw)).astype(np.int64)
        return ids.astype(np.int32), number, final, fallback

    def _remember(self, words: list[str]) -> None:
        """Solves `words` into the store."""
        known = self.known
        for at in range(0, len(words), 20_000):
            block = words[at : at + 20_000]
            known.add(block, *self.solve([MARK + w.replace(" ", MARK) for w in block]))

    def words(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text that are solved apart. Blanks part them, and each has a mark before it; runs of blanks stay with the next word."""
        if not self.apart:
            return pa.array([[t] if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))
        lists = pc.split_pattern(texts, " ")
        odd = pc.or_(pc.match_substring_regex(texts, "^( |$)"), pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)))
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(at):
            return lists
        runs = re.compile(f"[ {MARK}]+[^ {MARK}]*")
        others = pa.array([[w[1:] for w in runs.findall(" " + t)] if t else [] for t in texts.take(pa.array(at)).to_pylist()], lists.type)
        place = np.arange(len(texts))
        place[at] = len(texts) + np.arange(len(at))
        return pa.concat_arrays([lists, others]).take(pa.array(place))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, ids, scores, bytes by fallback): text i, whole, has the ids from offsets[i] to offsets[i + 1]; an empty one has none."""
        lists = self.words(texts)
        coded = lists.flatten().dictionary_encode()
        flat = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.number.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            if len(self.known.number) + len(missing) > CACHE:
                self.known.forget()
            self._remember([w for w in flat if w not in self.known.number])
            at = np.fromiter(map(self.known.number.get, flat), np.int64, len(flat))
        return self.known.gather(at[coded.indices.to_numpy()], lists.value_lengths().to_numpy().astype(np.int64))

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of the ids: marks become blanks, bytes are joined to characters (ill-formed ones become U+FFFD); the first blank goes."""
        if self.flat is None:
            sizes = np.array([len(x) for x in self.surface], np.int64)
            self.flat = np.frombuffer(b"".join(self.surface), np.uint8), np.cumsum(sizes) - sizes, sizes
        data, starts, sizes = self.flat
        raw = data[ragged(starts[ids], sizes[ids])].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes[ids])])[offsets].tolist()
        return [raw[a + (raw[a : a + 1] == b" " and b > a) : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def _order(reach: np.ndarray, target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Order by reach, then target, then source; by one number where they fit in it."""
    length = target - source
    if len(reach) and reach.max() < 1 << 22 and target.max() < 1 << 31 and length.max() < 1 << 10:
        return np.argsort(reach << 41 | target << 10 | ((1 << 10) - 1 - length))
    return np.lexsort((source, target, reach))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the slices that begin at `starts` and have `sizes` elements, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Store:
    """Solved words, in arrays: their ids lie end to end."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = self.sizes = self.fallback = self.uses = np.zeros(0, np.int64)
        self.score = np.zeros(0)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray, score: np.ndarray, fallback: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.sizes, self.score = np.concatenate([self.sizes, sizes]), np.concatenate([self.score, score])
        self.fallback, self.uses = np.concatenate([self.fallback, fallback]), np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))

    def forget(self) -> None:
        """Keeps the words used most, half of CACHE at most."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE // 2])
        at = ragged(self.starts[keep], self.sizes[keep])
        words = list(self.number)
        self.number = {words[i]: k for k, i in enumerate(keep.tolist())}
        self.ids, self.sizes, self.score, self.fallback, self.uses = self.ids[at], self.sizes[keep], self.score[keep], self.fallback[keep], self.uses[keep] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes

    def gather(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As Pieces.encode, for texts of `counts` each of the words with the numbers `at`."""
        self.uses += np.bincount(at, minlength=len(self.uses))
        text = np.repeat(np.arange(len(counts)), counts)
        sums = [np.bincount(text, weights=x[at], minlength=len(counts)) for x in (self.sizes, self.score, self.fallback)]
        offsets = np.concatenate([[0], np.cumsum(sums[0].astype(np.int64))])
        return offsets, self.ids[ragged(self.starts[at], self.sizes[at])], sums[1].astype(float), sums[2].astype(np.int64)


@cache
def _default_pieces() -> Pieces:
    return Pieces(vocabulary())


def _shared(spark: SparkSession, entries: list[tuple[str, float, str]] | None):
    return spark.sparkContext.broadcast(Pieces(entries) if entries else _default_pieces())


def _encoded(batches: Iterator[pa.RecordBatch], pieces) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2000):
        offsets, ids, score, fallback = pieces.value.encode(pc.fill_null(batch.column(1), ""))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(score), pa.array(fallback)], names=["id", "ids", "score", "n_fallback"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", entries: list[tuple[str, float, str]] | None = None) -> DataFrame:
    """One row for each row of `docs`: id, ids array, score (sum of log scores), n_fallback (bytes that no piece covers).

    A null or empty text has no ids. Each text is read whole, however long; it takes memory in proportion, with those of
    up to 2,000 rows. Rows that repeat an id or a text are encoded alike. Of segmentations that tie, the one with the longer
    last pieces is taken. An empty table gives an empty result; only `id_col` and `text_col` are read, whatever the other
    columns are called. `entries`: a vocabulary as vocabulary() gives it."""
    pieces = _shared(docs.sparkSession, entries)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return for_python(rows).mapInArrow(lambda b: _encoded(b, pieces), "id long, ids array<int>, score double, n_fallback long").withColumnRenamed("id", id_col)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values) of a list array; null lists are empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), lists.flatten().to_numpy(zero_copy_only=False)


def _decoded(batches: Iterator[pa.RecordBatch], at: int, keep: list[int], names: list[str], pieces) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lists = batch.column(at)
        texts = pa.array(pieces.value.decode(*_flat(lists)), pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], texts], names=names)


def decode(rows: DataFrame, ids_col: str = "ids", name: str = "decoded", entries: list[tuple[str, float, str]] | None = None) -> DataFrame:
    """`rows` with the text of `ids_col` in the last column `name`, which replaces one of that name; null ids give a null text."""
    pieces = _shared(rows.sparkSession, entries)
    at = rows.columns.index(ids_col)
    keep = [k for k, c in enumerate(rows.columns) if c.lower() != name.lower()]
    schema = T.StructType([*[rows.schema.fields[k] for k in keep], T.StructField(name, T.StringType())])
    return rows.mapInArrow(lambda b: _decoded(b, at, keep, schema.names, pieces), schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of encode() with their decoded text."""
    for batch in batches:
        offsets, ids = _flat(batch.column(1))
        raw, at = memoryview(ids.astype("<u4").tobytes()), (4 * offsets).tolist()
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column(4).to_pylist()]
        columns = [pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), batch.column(2), batch.column(3), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_pieces", "ids_crc32", "score", "n_fallback", "decoded_sha256"])


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and the digest of the text that they decode to; encode(), decode() and digests in one pass over the batches."""
    pieces = _shared(spark, None)
    each = lambda b: _digests(_decoded(_encoded(b, pieces), 1, [0, 1, 2, 3], ["id", "ids", "score", "n_fallback", "decoded"], pieces))
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return for_python(rows).mapInArrow(each, "doc_id long, n_pieces long, ids_crc32 long, score double, n_fallback long, decoded_sha256 string")


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLES: dict[str, str] = {}
