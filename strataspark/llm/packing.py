"""Packing along a space-filling curve.

Every document gets a vector of DIMS numbers, a random projection of its hashed token counts, and its place on the
Hilbert curve through that space. Documents are laid end to end in the order of the curve and cut every CAPACITY
tokens, so that neighbours share sequences and only the last sequence has padding."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, for_python, slices, stored

CAPACITY, END = 1024, 0
DIMS, BITS = 4, 8
#: Bits of a row's place: its key on the curve, then its digest, so that copies lie side by side. The leading CELL_BITS
#: name a cell; cells over a group's tokens are divided by further bits, into at most about MAX_CELLS at a time.
PLACE_BITS, CELL_BITS, MAX_CELLS = 63, 16, 1 << 21
#: Tokens that one group packs, and the most groups there are: the driver holds three numbers for each (24 MB). Beyond
#: 4 * 10^12 tokens groups grow instead; at 3 * 10^13, some 100 TB of text, one has 2^25 tokens, 64 MB.
GROUP_TOKENS, MAX_GROUPS = 1 << 22, 1 << 20
SPECIAL = "<|endoftext|>"
#: White space of this length, which the faster library cannot split, goes to the library of the JSON file.
LONG_BLANK = 100_000
_LONG_BLANK = re.compile(r"\s{%d}" % LONG_BLANK)


def tokenizer_folder() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@cache
def _encoding(folder: str):
    """The vocabulary of byte_bpe_50k.json from its ranks: the same ids, several times as fast."""
    import public_tokenizers
    import tiktoken

    with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


@cache
def _plain_encoding(folder: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(os.path.join(folder, "byte_bpe_50k.json"))


def encode(text: str, folder: str) -> np.ndarray:
    """Ids of the whole text, then END."""
    if len(text) >= LONG_BLANK and _LONG_BLANK.search(text):
        ids = np.array(_plain_encoding(folder).encode(text, add_special_tokens=False).ids, np.uint32)
    else:
        ids = _encoding(folder).encode_to_numpy(text, allowed_special="all" if SPECIAL in text else _NONE, disallowed_special=())
    return np.append(ids, np.uint32(END))


_NONE: frozenset[str] = frozenset()


@cache
def _directions(dims: int) -> np.ndarray:
    """A fixed random sign in every dimension for each hashed token."""
    return (np.random.default_rng(20).integers(0, 2, (1 << 16, dims)) * 2 - 1).astype(np.float32)


def vector(ids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """About normal in every dimension whatever the text's length: signed sums of square roots of the token counts."""
    if len(ids) < 4096:
        used, counts = np.unique(ids, return_counts=True)
    else:
        counts = np.bincount(ids)
        used = np.flatnonzero(counts)
        counts = counts[used]
    return np.sqrt(counts).astype(np.float32) @ _directions(dims)[used] / np.sqrt(float(len(ids)))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of integer points (rows, `bits` bits a coordinate) on the Hilbert curve, by Skilling's transform (2004)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def keys(vectors: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of vectors; each coordinate is cut at quantiles of about a normal distribution."""
    share = 1 / (1 + np.exp(-1.702 * vectors))
    return hilbert(np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def _encoded(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column(1).to_pylist()
        ids = [encode(t or "", folder) for t in texts]
        at = keys(np.array([vector(x) for x in ids]).reshape(-1, DIMS))
        digests = [zlib.crc32(x.tobytes()) for x in ids]
        packed = pa.array([x.astype(np.uint16).tobytes() for x in ids], pa.binary())
        columns = [batch.column(0), pa.array(at), pa.array(digests, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), packed]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "digest", "n", "ids"])


def encoded(docs: DataFrame, id_col: str, text_col: str, folder: str | None = None) -> DataFrame:
    """(id, key, digest, n, ids): tokens of every row as 16-bit numbers, and its place on the curve."""
    folder = folder or tokenizer_folder()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return for_python(rows).mapInArrow(lambda batches: _encoded(batches, folder), "id long, key long, digest long, n long, ids binary")


def _packed(rows: pa.Table, capacity: int, with_ids: bool) -> pa.Table:
    """Pieces of one group of neighbouring documents; its first token has the place `origin` among all tokens."""
    id_ = np.array(rows.column("id").to_pylist(), object)
    order = np.lexsort((rows.column("digest").to_numpy(), rows.column("tie").to_numpy(), rows.column("place").to_numpy()))
    place = rows.column("origin")[0].as_py()
    blobs = rows.column("ids")
    out: dict[str, list] = {k: [] for k in _PIECES.names}
    for i in order.tolist():
        ids = np.frombuffer(blobs[i].as_buffer(), np.uint16).astype(np.uint32)
        start = 0
        while start < len(ids):
            offset = place % capacity
            part = ids[start : start + capacity - offset]
            found = (id_[i], start, len(part), zlib.crc32(part.tobytes()), len(ids), place // capacity, offset, part.astype(np.int32) if with_ids else None)
            for values, x in zip(out.values(), found, strict=True):
                values.append(x)
            start += len(part)
            place += len(part)
    return pa.table(out, schema=_PIECES)


_PIECES = pa.schema([(n, pa.int64()) for n in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int32()))])
_SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all rows of `docs` in sequences of `capacity` tokens: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Every sequence but the last is full. A null or empty text is the one token END; rows that repeat an id or a text are
    documents of their own, side by side; an empty table gives an empty result. Only `id_col` (an integer, may be null)
    and `text_col` are read. `with_ids` false leaves the ids themselves out.

    Tokens are counted by cell of the curve (at most 2 ** CELL_BITS). Cells that hold more than a group are divided by the
    next bits of the key and then of the digest; only rows of one full key and digest (copies) are divided by a hash of
    the row. Runs of smaller cells are joined, so that no group grows with the data, and the order is the same however
    the groups are cut. Their totals (at most about MAX_GROUPS numbers) give each group's first place in the stream."""
    spark = docs.sparkSession
    rows = stored(encoded(docs, id_col, text_col, folder))
    place = F.shiftleft("key", PLACE_BITS - DIMS * BITS) + F.shiftright("digest", 32 - PLACE_BITS + DIMS * BITS)
    tie = F.pmod(F.xxhash64("id", "digest"), F.lit(1 << 30))
    light = rows.select(place.alias("place"), tie.alias("tie"), "n")
    total = light.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], _SCHEMA).withColumnRenamed("id", id_col)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = max(total // MAX_GROUPS, min(GROUP_TOKENS, max(capacity, total // (8 * tasks))))
    found = leaves(light, target)
    splits = np.where(found.bits.to_numpy() == PLACE_BITS, np.maximum(1, -(-found.n.to_numpy() // target)), 1)
    first, used = np.zeros(len(found), np.int64), 0
    run = 0
    for i, (n, parts) in enumerate(zip(found.n.tolist(), splits.tolist(), strict=True)):
        if parts > 1 or run + n > target:  # a new group
            used += run > 0
            run = 0
        first[i] = used
        if parts > 1:
            used += parts
        else:
            run += n
    new = np.concatenate([[True], first[1:] != first[:-1]])  # leaves of one group are neighbours
    begins = (found.cell.to_numpy() << (PLACE_BITS - found.bits.to_numpy()))[new]
    cuts = spark.sparkContext.broadcast((begins, first[new], splits[new]))

    @F.pandas_udf("long")
    def group_of(place: pd.Series, tie: pd.Series) -> pd.Series:
        begins, first, parts = cuts.value
        at = np.searchsorted(begins, place.to_numpy(), side="right") - 1
        return pd.Series(first[at] + (tie.to_numpy() * parts[at] >> 30))

    def grouped(df: DataFrame) -> DataFrame:
        return df.withColumn("part", group_of("place", "tie"))

    sums = durable(grouped(light).groupBy("part").agg(F.sum("n").alias("n"))).orderBy("part").toPandas()
    origins = np.cumsum(sums.n.to_numpy()) - sums.n.to_numpy()
    starts = spark.createDataFrame([*zip(sums.part.tolist(), origins.tolist(), strict=True)], "group long, origin long")
    ready = grouped(rows.select("id", "digest", "ids", place.alias("place"), tie.alias("tie")))
    ready = ready.join(F.broadcast(starts), F.col("part") == F.col("group")).drop("group")
    return ready.groupBy("part").applyInArrow(lambda t: _packed(t, capacity, with_ids), _SCHEMA).withColumnRenamed("id", id_col)


def leaves(light: DataFrame, target: int) -> pd.DataFrame:
    """(cell, bits, n) in order of the curve: cells of at most `target` tokens, or of one whole place (bits = PLACE_BITS).

    Each round counts only rows in cells over the target, by as many more bits as keep the counts under MAX_CELLS."""
    done, bits = [], CELL_BITS
    cell = lambda b: F.shiftright("place", PLACE_BITS - b)
    while True:
        now = light.groupBy(cell(bits).alias("cell")).agg(F.sum("n").alias("n")).toPandas().assign(bits=bits)
        over = (now.n > target) & (bits < PLACE_BITS)
        done.append(now[~over])
        hot = now.cell[over].tolist()
        if not hot:
            break
        few = light.sparkSession.createDataFrame([(x,) for x in hot], "hot long")
        light = light.join(F.broadcast(few), cell(bits) == F.col("hot"), "left_semi")
        bits = min(PLACE_BITS, bits + max(4, int(np.log2(MAX_CELLS / len(hot)))))
    found = pd.concat(done, ignore_index=True)
    return found.iloc[np.argsort(found.cell.to_numpy() << (PLACE_BITS - found.bits.to_numpy()))].reset_index(drop=True)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), with_ids=False).drop("ids")


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
