"""Compression of vectors to short codes: a codebook for each part of the vector, fitted by Lloyd's rounds with Elkan's bounds.

Components become integers first, so that distances, ties and means are exact. Between rounds each row keeps, for each
part, its entry, an upper bound of the distance to it and a lower bound of the distance to every entry; all are shifted
by how far the entries have moved, and only entries that the triangle inequality can't exclude are measured."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_SHARE, for_python, lookup, remove_folder, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Steps in which lower bounds are kept (four bits each), between the least and the largest of a row's part.
STEPS = 15
#: Distances measured at once.
BLOCK = 1 << 18
#: What float arithmetic may be off by, with much to spare; bounds are widened by it.
SLACK = 1e-6


def up(x: np.ndarray) -> np.ndarray:
    return (x * (1 + SLACK)).astype(np.float32) * np.float32(1 + SLACK)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * (1 - SLACK)).astype(np.float32) * np.float32(1 - SLACK))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries; exact, see `number_kind`."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def number_kind(top: int, width: int) -> type:
    """The numbers in which squared distances of `width` components up to `top` are exact."""
    most = width * (2 * top) ** 2 * 2
    if most >= 1 << 62:
        raise ValueError(f"components of {top} are too large for exact distances")
    return np.float64 if most < 1 << 53 else np.int64


@dataclass
class Bounds:
    """What a batch of rows keeps of one part: entry, upper bound, and lower bounds in STEPS from `low`."""

    code: np.ndarray
    upper: np.ndarray
    low: np.ndarray
    step: np.ndarray
    marks: np.ndarray

    @classmethod
    def of(cls, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> Bounds:
        low = down(lower.min(axis=1))
        step = down((lower.max(axis=1) - low) / STEPS)
        marks = np.floor((lower - low[:, None]) / np.where(step > 0, step, np.inf)[:, None])
        return cls(code, upper, low, step, np.clip(marks, 0, STEPS).astype(np.uint8))

    def lower(self) -> np.ndarray:
        return down(self.low[:, None] + self.marks * self.step[:, None])


def first_bounds(x: np.ndarray, c: np.ndarray) -> Bounds:
    """All distances; ties go to the lower index."""
    far = squared(x, c)
    code = far.argmin(axis=1)
    far = np.sqrt(far)
    return Bounds.of(code, up(far[np.arange(len(x)), code]), down(far))


def next_bounds(x: np.ndarray, c: np.ndarray, last: Bounds, moved: np.ndarray) -> tuple[Bounds, int]:
    """Bounds for entries `c` that have moved by `moved` since `last`, and how many distances were measured.

    An entry is passed over only if a bound says strictly that it is farther than the row's own; the others are measured
    in integers, the row's own among them, and of equal ones the lower index wins."""
    rows, code, upper = np.arange(len(x)), last.code.copy(), up(last.upper + moved[last.code])
    lower = down(last.lower() - moved)
    half = down(np.sqrt(squared(c, c).astype(float)) / 2)
    near = np.where(np.eye(len(c), dtype=bool), np.inf, half).min(axis=1)
    open_ = (lower <= upper[:, None]) & (half[code] <= upper[:, None])
    open_[rows, code] = False
    doubt = np.flatnonzero((upper >= near[code]) & open_.any(axis=1))
    own = ((x[doubt] - c[code[doubt]]) ** 2).sum(axis=1)
    upper[doubt] = up(np.sqrt(own.astype(float)))
    lower[doubt, code[doubt]] = down(np.sqrt(own.astype(float)))
    left = open_[doubt] & (lower[doubt] <= upper[doubt, None]) & (half[code[doubt]] <= upper[doubt, None])
    at, entry = np.nonzero(left)
    far = np.zeros(len(at), x.dtype)
    for k in range(0, len(at), BLOCK):
        part = slice(k, k + BLOCK)
        far[part] = ((x[doubt[at[part]]] - c[entry[part]]) ** 2).sum(axis=1)
    lower[doubt[at], entry] = down(np.sqrt(far.astype(float)))
    # The row's own entry among the measured ones, then the best of each row by distance and index.
    at, entry, far = np.concatenate([at, np.arange(len(doubt))]), np.concatenate([entry, code[doubt]]), np.concatenate([far, own])
    order = np.lexsort((entry, far, at))
    best = order[np.unique(at[order], return_index=True)[1]]
    code[doubt], upper[doubt] = entry[best], up(np.sqrt(far[best].astype(float)))
    return Bounds.of(code, upper, lower), len(far)


def _matrix(column: pa.Array, kind: type, rows: int) -> np.ndarray:
    """Rows of equally long binaries as a matrix."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if rows else np.zeros(0, np.uint8)
    return data.view(kind).reshape(rows, -1) if rows else np.zeros((0, 0), kind)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    width = x.itemsize * x.shape[1]
    ends = pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(x.tobytes())])


class Codebooks:
    """Entries of every part, (parts, entries, width), as integers."""

    def __init__(self, entries: np.ndarray, kind: type):
        self.entries, self.kind = entries.astype(kind), kind

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.ravel()).encode()).hexdigest()

    def moved(self, before: Codebooks) -> np.ndarray:
        return up(np.sqrt(((self.entries - before.entries).astype(float) ** 2).sum(axis=2)))


#: What a row keeps between rounds: its integers; entries and bounds of all parts.
_KEPT = "v binary, code binary, bounds binary, marks binary"


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * SCALE).reshape(len(column), dims)


def _kept(batch: pa.RecordBatch, v: np.ndarray, found: list[Bounds]) -> pa.RecordBatch:
    bounds = np.stack([np.stack([b.upper, b.low, b.step], axis=1) for b in found], axis=1).reshape(len(v), -1).astype(np.float32)
    marks = np.concatenate([b.marks for b in found], axis=1)
    if marks.shape[1] % 2:
        marks = np.pad(marks, ((0, 0), (0, 1)))
    columns = [v.astype(np.int32), np.stack([b.code for b in found], axis=1).astype(np.uint16), bounds, marks[:, ::2] << 4 | marks[:, 1::2]]
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *map(_binary, columns)], names=["id", "label", "v", "code", "bounds", "marks"])


def _read(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, list[Bounds]]:
    """(integers by part, bounds by part) of a batch."""
    parts, entries, _ = books.entries.shape
    n = batch.num_rows
    v = _matrix(batch.column("v"), np.int32, n).astype(books.kind).reshape(n, parts, -1)
    code, bounds = _matrix(batch.column("code"), np.uint16, n).astype(np.int64), _matrix(batch.column("bounds"), np.float32, n).reshape(n, parts, 3)
    packed = _matrix(batch.column("marks"), np.uint8, n)
    marks = np.stack([packed >> 4, packed & 15], axis=2).reshape(n, -1)[:, : parts * entries].reshape(n, parts, entries)
    return v, [Bounds(code[:, p], *bounds[:, p].T, marks[:, p]) for p in range(parts)]


def vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, vec, label) of the rows whose vector is whole: neither null nor with null, NaN or infinite components."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"), F.col(f"`{label_col}`").alias("label"))
    return rows.where(F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(one row for each whole vector: id, code, error, label, label_error; the final codebooks as integers).

    Rows whose vector is null, or has null or non-finite components, are dropped. Components become floor(SCALE * x); an
    empty table gives an empty result and no codebooks. The codebooks begin as the parts of the `entries` smallest ids
    (nulls last; of equal ids the smaller vector first), fewer where there are fewer rows. Rows that repeat an id are
    vectors of their own. Vectors of different lengths, of lengths that `parts` doesn't divide, and components so large
    that distances would not be exact, are errors. Other columns, whatever their names, are not read.

    Rows are kept between rounds in the shared folder, one round's at a time besides the one being written, with four
    bits for each lower bound. The driver holds the codebooks alone: sums by entry are gathered within tasks."""
    spark = df.sparkSession
    rows = vectors(df, id_col, vec_col, label_col)
    size = F.size("vec")
    top = F.aggregate("vec", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    least, most, top = rows.agg(F.min(size), F.max(size), F.max(top)).first()
    kind_of_label = rows.schema["label"].dataType
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label", kind_of_label)])
    if most is None:
        return spark.createDataFrame([], T.StructType([*out.fields, T.StructField("label_error", T.LongType())])).withColumnRenamed("id", id_col), np.zeros((parts, 0, 0), np.int64)
    if least != most or most % parts or not most:
        raise ValueError(f"vectors of {least} to {most} components: one length that {parts} divides is needed")
    number = number_kind(int(top * SCALE) + 1, most // parts)
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "vec").select("vec").limit(entries).toArrow()
    start = _integers(seeds.column("vec").combine_chunks(), most)
    books = Codebooks(start.reshape(len(start), parts, -1).transpose(1, 0, 2), number)
    schema = T.StructType([out["id"], T.StructField("label", kind_of_label), *T._parse_datatype_string(_KEPT).fields])

    def first(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _integers(batch.column("vec"), most)
            yield _kept(batch, v, [first_bounds(x, c) for x, c in zip(v.astype(number).reshape(len(v), parts, -1).transpose(1, 0, 2), books.entries, strict=True)])

    state, path = written(for_python(rows).mapInArrow(first, schema), "codes")
    for _ in range(rounds):
        now = Codebooks(_means(state, books), number)

        def again(batches: Iterator[pa.RecordBatch], books: Codebooks = now, moved: np.ndarray = now.moved(books)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v, last = _read(batch, books)
                found = [next_bounds(v[:, p], books.entries[p], last[p], moved[p])[0] for p in range(len(last))]
                yield _kept(batch, v.reshape(len(v), -1), found)

        state, old, books = written(state.mapInArrow(again, schema), "codes"), path, now
        state, path = state
        remove_folder(spark, old)

    def coded(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
        digits = max(2, len(f"{books.entries.shape[1] - 1:x}"))
        names = np.array([f"{i:0{digits}x}" for i in range(books.entries.shape[1])])
        for batch in batches:
            v, last = _read(batch, books)
            error, code = np.zeros(len(v), np.int64), np.full(len(v), "", dtype=f"U{digits * len(last)}")
            for p, b in enumerate(last):
                error += ((v[:, p] - books.entries[p][b.code]) ** 2).sum(axis=1).astype(np.int64)
                code = np.char.add(code, names[b.code])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(code.tolist(), pa.string()), pa.array(error), batch.column("label")], names=["id", "code", "error", "label"])

    found, narrow = written(state.mapInArrow(coded, out), "coded")[0], path
    remove_folder(spark, narrow)
    return with_label_errors(found).withColumnRenamed("id", id_col), books.entries.astype(np.int64)


def _means(state: DataFrame, books: Codebooks) -> np.ndarray:
    """Entries replaced by their parts' componentwise floor(sum / count); unused ones stay. Sums are gathered by task."""
    parts, entries, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), np.int32, batch.num_rows).astype(np.int64).reshape(-1, width)
            cell = (_matrix(batch.column("code"), np.uint16, batch.num_rows).astype(np.int64) + np.arange(parts) * entries).ravel()
            order = np.argsort(cell, kind="stable")
            used, begins = np.unique(cell[order], return_index=True)
            if len(used):
                total[used] += np.add.reduceat(v[order], begins, axis=0)
                n += np.bincount(cell, minlength=len(n))
        used = np.flatnonzero(n)
        place = (used[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[used].ravel()), pa.array(np.repeat(n[used], width))], names=["place", "total", "n"])

    rows = state.select("v", "code").mapInArrow(sums, "place long, total long, n long").groupBy("place")
    now = books.entries.astype(np.int64).ravel().copy()
    for place, total, n in rows.agg(F.sum(F.col("total").cast("decimal(38,0)")), F.sum("n")).collect():
        now[place] = int(total) // n
    return now.reshape(books.entries.shape)


def with_label_errors(found: DataFrame) -> DataFrame:
    """`found` with label_error: error summed over the rows of its label, nulls together. Hot labels are broadcast."""
    keyed = found.withColumn("_key", F.struct("label"))
    sums = keyed.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    floor = max(1000, int(found.count() * HOT_SHARE))
    return lookup(keyed, sums, "_key", F.col("_n") >= floor).select("id", "code", "error", "label", "label_error")


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return codes.drop("label").withColumn("codebooks_sha256", F.lit(Codebooks(books, np.int64).digest()))


QUERIES = {"op12_vector_code_compression": op12_vector_code_compression}
ORACLES: dict[str, str] = {}
