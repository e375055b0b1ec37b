"""SEGY cubes: a reader that splits a file over tasks by its traces, and a writer of one file by many tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from .ranges import Layout, RangeReader, durable, head_of, write_one_file

#: Bytes (from 1) of x, y, inline, crossline in the trace header, by the software that wrote the file; the
#: coordinates' scale is at 71 in all of them.
FORMATS = {"seisworks": (73, 77, 9, 21), "charisma": (73, 77, 5, 21), "iesx": (73, 77, 221, 21), "sip": (181, 185, 189, 193)}
SCALE = 71
#: Bytes of the text header, of both file headers, of a further text header, and of a trace header.
TEXT, HEAD, EXTENDED, TRACE = 3200, 3600, 3200, 240
#: Sample formats that are read, IBM and IEEE floats, 32-bit and 16-bit integers, and their kinds.
KINDS = {1: ">u4", 2: ">i4", 3: ">i2", 5: ">f4"}


def ibm_to_float(words: np.ndarray) -> np.ndarray:
    """IBM 32-bit floats: sign, power of 16 (excess 64), 24 bits of fraction."""
    words = words.astype(np.uint32)
    value = (words & 0xFFFFFF).astype(float) * 2.0 ** -24 * 16.0 ** ((words >> 24 & 0x7F).astype(float) - 64)
    return np.where(words >> 31, -value, value).astype(np.float32)


def float_to_ibm(values: np.ndarray) -> np.ndarray:
    """IBM 32-bit floats nearest to `values`; fractions of the last hexadecimal digit are rounded."""
    x = np.abs(values.astype(float))
    power = np.ceil(np.log2(np.where(x > 0, x, 1)) / 4)
    power = np.where(x >= 16.0**power, power + 1, power)
    fraction = np.rint(x / 16.0**power * 2**24)
    power, fraction = np.where(fraction >= 2**24, power + 1, power), np.where(fraction >= 2**24, 2**20, fraction)
    found = (power + 64).astype(np.uint32) << 24 | fraction.astype(np.uint32)
    return np.where(x > 0, found | np.where(np.signbit(values), np.uint32(1 << 31), 0), 0).astype(np.uint32)


def _integers(traces: np.ndarray, place: int, kind: str = ">i4") -> np.ndarray:
    size = int(kind[2])
    return np.ascontiguousarray(traces[:, place - 1 : place - 1 + size]).view(kind)[:, 0].astype(np.int64)


class SegyReader(RangeReader):
    """Conditions on il and xl are met here: the samples of other traces are not decoded."""

    block = 1 << 20

    def __init__(self, options: dict):
        super().__init__(options)
        self.places = [int(options.get(f"location-{c}", p)) for c, p in zip(("x", "y", "il", "xl"), FORMATS[options.get("header", "seisworks").lower()], strict=True)]
        self.scaled = options.get("bypass-coordinate-scaling", "no") != "yes"
        self.asked: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", In: "in"}
        for f in filters:
            if type(f) in known and f.attribute in (("il",), ("xl",)):
                self.asked.append((f.attribute[0], known[type(f)], f.value))
            else:
                yield f

    def layout(self, path: str, size: int) -> Layout:
        head = np.frombuffer(head_of(path, HEAD), np.uint8)
        if len(head) < HEAD:
            raise ValueError(f"{path}: no SEGY file")
        word = lambda place: int(head[place - 1 : place + 1].view(">i2")[0])
        dt, n, kind, more = word(3217), word(3221) & 0xFFFF, word(3225), max(0, word(3505))
        if kind not in KINDS or not n:
            raise ValueError(f"{path}: sample format {kind} with {n} samples can't be read")
        start, width = HEAD + EXTENDED * more, TRACE + n * int(KINDS[kind][2])
        if (size - start) % width:
            raise ValueError(f"{path}: the last trace is cut short")
        return Layout(start, width, (size - start) // width, {"dz": dt / 1000, "kind": kind, "n": n})

    def wanted(self, found: dict[str, np.ndarray]) -> np.ndarray:
        keep = np.ones(len(found["il"]), bool)
        for column, how, value in self.asked:
            x = found[column]
            keep &= np.isin(x, list(value)) if how == "in" else getattr(np, {"eq": "equal", "gt": "greater", "ge": "greater_equal", "lt": "less", "le": "less_equal"}[how])(x, value)
        return keep

    def decode(self, path: str, layout: Layout, first: int, data: bytes) -> pa.RecordBatch:
        traces = np.frombuffer(data, np.uint8).reshape(-1, layout.width)
        x, y, il, xl = (_integers(traces, p) for p in self.places)
        keep = self.wanted({"il": il, "xl": xl})
        samples = self.options.get("samples", "yes") == "yes"
        traces, n, kind = traces[keep], layout.header["n"], layout.header["kind"]
        scale = _integers(traces, SCALE, ">i2").astype(float)
        factor = np.where(scale < 0, -1 / np.where(scale < 0, scale, 1), np.where(scale > 0, scale, 1)) if self.scaled else np.ones(len(traces))
        z0 = _integers(traces, 109, ">i2").astype(float)
        columns = [pa.repeat(path, len(traces)), pa.array(np.arange(first, first + len(keep))[keep]), *(pa.array(v[keep], pa.int32()) for v in (il, xl)), *(pa.array(v[keep] * factor) for v in (x, y))]
        columns += [pa.array(z0), pa.array(np.full(len(traces), layout.header["dz"]))]
        if samples:
            words = np.ascontiguousarray(traces[:, TRACE:]).view(KINDS[kind])
            values = (ibm_to_float(words) if kind == 1 else words.astype(np.float32)).ravel()
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(traces) + 1) * n, pa.int32()), pa.array(values, pa.float32())))
        return pa.RecordBatch.from_arrays(columns, names=["path", "trace", "il", "xl", "x", "y", "z0", "dz", "amp"][: len(columns)])


class Segy(DataSource):
    """(path, trace, il, xl, x, y, z0, dz, amp) of the traces of SEGY files, in steps of milliseconds."""

    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> str:
        return "path string, trace long, il int, xl int, x double, y double, z0 double, dz double" + (", amp array<float>" if self.options.get("samples", "yes") == "yes" else "")

    def reader(self, schema) -> DataSourceReader:
        return SegyReader(self.options)


def read_segy(spark: SparkSession, path: str, header: str = "seisworks", **options: object) -> DataFrame:
    """Traces of the SEGY files at `path`. `header` names the trace header's format; location_x, location_y, location_il,
    location_xl and bypass_coordinate_scaling change it; samples="no" leaves amp out, and decodes no samples; `split` is the bytes a task reads. A file of another kind or size is an error."""
    spark.dataSource.register(Segy)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("segy").options(header=header, **{k.replace("_", "-"): v for k, v in options.items()}).load(path)


def write_segy(traces: DataFrame, path: str, z0: float, dz: float, samples: int, kind: int = 5, header: str = "seisworks", text: str = "", scale: int = -100) -> None:
    """Writes (il, xl, x, y, amp) as one SEGY file, traces in order of il, then xl; a null sample, and those that a trace lacks, are zero.

    Samples are IEEE (`kind` 5) or IBM floats (1); coordinates are whole multiples of 1 / -scale. Two traces of one place
    and traces of more than `samples` samples are errors. Traces are numbered by ranges of (il, xl): counts of the ranges
    go to the driver, the traces do not. The file appears when all tasks have written."""
    spark = traces.sparkSession
    px, py, pil, pxl = FORMATS[header]
    rows = traces.select(F.col("il").cast("int").alias("il"), F.col("xl").cast("int").alias("xl"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("amp").cast("array<float>").alias("amp"))
    rows = rows.repartitionByRange("il", "xl").sortWithinPartitions("il", "xl").withColumn("part", F.spark_partition_id())
    rows = durable(rows)
    found = rows.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("il", "xl").alias("places"), F.max(F.size("amp")).alias("most")).orderBy("part").collect()
    if any(r.n != r.places for r in found) or any((r.most or 0) > samples for r in found):
        raise ValueError("two traces of one place, or one of too many samples")
    first, total = {}, 0
    for r in found:
        first[r.part], total = total, total + r.n
    width = TRACE + 4 * samples

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            part = batch.column("part")[0].as_py()
            number = at.get(part, first[part]) + np.arange(n)
            at[part] = int(number[-1]) + 1
            out = np.zeros((n, width), np.uint8)

            def put(place: int, values: np.ndarray, kind: str, out: np.ndarray = out) -> None:
                out[:, place - 1 : place - 1 + int(kind[2])] = np.ascontiguousarray(values, kind)[:, None].view(np.uint8)

            factor = -scale if scale < 0 else 1 / scale
            for place, values in ((1, number + 1), (pil, batch.column("il").to_numpy()), (pxl, batch.column("xl").to_numpy()), (px, np.rint(batch.column("x").to_numpy() * factor)), (py, np.rint(batch.column("y").to_numpy() * factor))):
                put(place, values, ">i4")
            for place, value in ((29, 1), (SCALE, scale), (109, round(z0)), (115, samples), (117, round(dz * 1000))):
                put(place, np.full(n, value), ">i2")
            column = batch.column("amp")
            lengths = np.diff(column.offsets.to_numpy())
            values = np.zeros((n, samples), np.float32)
            values[np.arange(samples) < lengths[:, None]] = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False), nan=0.0)
            words = float_to_ibm(values).astype(">u4") if kind == 1 else values.astype(">f4")
            out[:, TRACE:] = words.view(np.uint8).reshape(n, -1)
            yield pa.RecordBatch.from_arrays([pa.array([HEAD + int(number[0]) * width], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["place", "data"])

    head = np.zeros(HEAD, np.uint8)
    head[:TEXT] = np.frombuffer(f"{text or 'C 1 SEGY cube':<{TEXT}.{TEXT}}".encode("cp037"), np.uint8)
    for place, value in ((3213, 1), (3217, round(dz * 1000)), (3221, samples), (3225, kind), (3229, 1), (3501, 256), (3503, 1)):
        head[place - 1 : place + 1] = np.array([value], ">i2").view(np.uint8)
    start = spark.createDataFrame([(0, bytearray(head.tobytes()))], "place long, data binary")
    write_one_file(start.unionByName(rows.mapInArrow(packed, "place long, data binary")), path, HEAD + total * width)
