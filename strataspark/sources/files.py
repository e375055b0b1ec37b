"""Readers of the domain's small files as DataFrames, by Spark's own file sources (any file system it knows, globs, many files).

Wells and wavelets are read whole, one a row, as their headers say how to read the rest; a survey has many of them, and
these are what Spark deals out. Surfaces are split by lines, cubes by ranges: see `grids` and `segy`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Codes of a missing value in grids and wells, and in surfaces.
MISSING, MISSING_SURFACE = (-999.0, -999.25, -99999.0), 9999900.0
#: Numbers of a surface that go from Python to Spark in one row.
PIECE = 1024


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _header(content: bytes, lines: int) -> tuple[list[str], int]:
    """The first `lines` lines that are not blank, and the place after them."""
    found, at = [], 0
    while len(found) < lines:
        end = content.index(b"\n", at)
        if line := content[at:end].decode("latin-1").strip():
            found.append(line)
        at = end + 1
    return found, at


def _irap_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes], list[bytes]]]:
    """(path, block, header, words) of Irap lines (path, block, value) in the order of their files, words in pieces; the file's first block holds the header."""
    heads: dict[str, list[bytes]] = {}
    for batch in batches:
        paths, blocks = batch.column("path").dictionary_encode(), batch.column("block").to_numpy()
        codes = paths.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True):
            if a == b:
                continue
            path, block, lines = paths.dictionary[codes[a]].as_py(), int(blocks[a]), batch.column("value").slice(a, b - a).to_pylist()
            head = heads.setdefault(path, []) if block == 0 else []
            at = 0
            while block == 0 and len(head) < 4 and at < len(lines):
                if line := lines[at].strip():
                    head.append(line)
                at += 1
            yield path, block, head, b" ".join(lines[at:]).split()


def _irap_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], tuple[int, list[bytes]]] = {}
    for path, block, head, words in _irap_words(batches):
        found[path, block] = found.get((path, block), (0, head))[0] + len(words), head
    columns = [k[0] for k in found], [k[1] for k in found], [n for n, _ in found.values()], [[x.decode("latin-1") for x in h] for _, h in found.values()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["path", "block", "n", "head"])


def _irap_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: dict[tuple[str, int], int] = {}
    for path, block, _, words in _irap_words(batches):
        at = done.get((path, block), 0)
        done[path, block] = at + len(words)
        starts = np.arange(0, len(words), PIECE)
        values = pa.ListArray.from_arrays(pa.array([*starts, len(words)], pa.int32()), pa.array(np.array(words, float)))
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(np.full(len(starts), block)), pa.array(at + starts), values], names=["path", "block", "at", "z"])


def irap_surface(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, j, x, y, z) of Irap classic ASCII surfaces, i fastest; missing nodes have a null z.

    Spark's text source splits the files. They are read twice: the numbers of each split are counted first, which gives the
    place of every number in its file; a task holds some thousand lines. What is broadcast is a row a file and split."""
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(path).select(name.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    splits = lines.mapInArrow(_irap_counts, "path string, block long, n long, head array<string>")
    file = Window.partitionBy("path")
    splits = splits.select("path", "block", F.coalesce(F.sum("n").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.sum("n").over(file).alias("n"), F.first("head").over(file.orderBy("block")).alias("head"))
    word = lambda line, k: F.get(F.split(F.get("head", F.lit(line)), r"\s+"), F.lit(k))
    fail = lambda *text: F.raise_error(F.concat(F.col("path"), *(F.lit(t) if isinstance(t, str) else t.cast("string") for t in text)))
    splits = splits.where(F.when((F.size("head") == 4) & (word(0, 0) == "-996"), True).otherwise(fail(": not an Irap classic surface").cast("boolean")))
    number, turned = {"ny": word(0, 1), "dx": word(0, 2), "dy": word(0, 3), "x0": word(1, 0), "y0": word(1, 2), "nx": word(2, 0)}, F.radians(word(2, 1).cast("double"))
    splits = splits.select("path", "block", "first", "n", *[v.cast("int" if c in ("nx", "ny") else "double").alias(c) for c, v in number.items()], F.cos(turned).alias("cos"), F.sin(turned).alias("sin"))
    whole = F.col("nx").cast("long") * F.col("ny")
    splits = splits.where(F.when(F.col("n") == whole, True).otherwise(fail(": ", F.col("nx"), " x ", F.col("ny"), " values expected, ", F.col("n"), " found").cast("boolean")))
    rows = lines.mapInArrow(_irap_values, "path string, block long, at long, z array<double>").join(F.broadcast(splits), ["path", "block"])
    rows = rows.select("*", F.posexplode("z").alias("p", "value")).withColumn("node", F.col("first") + F.col("at") + F.col("p"))
    rows = rows.withColumns({"i": (F.col("node") % F.col("nx")).cast("int"), "j": F.expr("node div nx").cast("int")})
    u, v = F.col("i") * F.col("dx"), F.col("j") * F.col("dy")
    x, y = F.col("x0") + u * F.col("cos") - v * F.col("sin"), F.col("y0") + u * F.col("sin") + v * F.col("cos")
    return rows.select("path", "i", "j", x.alias("x"), y.alias("y"), F.when(F.col("value") < MISSING_SURFACE, F.col("value")).alias("z"))


def rms_wells(spark: SparkSession, path: str, logs: list[str]) -> DataFrame:
    """(well, seq, x, y, z, one column for each of `logs`) of RMS wells; missing values, and logs that a file lacks, are null."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                lines, at = _header(content, 4)
                count = int(lines[3])
                lines, at = _header(content, 4 + count)
                names = [line.split()[0].lower() for line in lines[4:]]
                data = np.array(content[at:].split(), float).reshape(-1, 3 + count)
                data = np.where(np.isin(data, MISSING), np.nan, data)
                out = {"well": lines[2].split()[0], "seq": np.arange(len(data))} | {c: data[:, k] for k, c in enumerate("xyz")}
                yield pd.DataFrame(out | {c: data[:, 3 + names.index(c.lower())] if c.lower() in names else np.nan for c in logs})

    schema = "well string, seq int, x double, y double, z double" + "".join(f", `{c}` double" for c in logs)
    rows = _files(spark, path).mapInPandas(parse, schema)
    return rows.select(*[F.col(f"`{c}`") if t != "double" else F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")).alias(c) for c, t in rows.dtypes])


def facies_names(spark: SparkSession, path: str, log: str = "facies") -> DataFrame:
    """(code, name) of the discrete log `log` of RMS wells, each once; a code with two names is an error. Other discrete logs don't count."""
    header = F.split(F.decode("content", "ISO-8859-1"), r"\r?\n")
    lines = F.filter(header, lambda x: x.rlike(rf"(?i)^\s*\Q{log}\E\s+DISC\s"))
    pairs = _files(spark, path).select(F.explode(lines).alias("line")).select(F.split(F.trim("line"), r"\s+").alias("w")).select(F.explode(F.sequence(F.lit(2), F.size("w") - 2, F.lit(2))).alias("k"), "w")
    pairs = pairs.select(F.get("w", F.col("k")).cast("int").alias("code"), F.get("w", F.col("k") + 1).alias("name")).groupBy("code").agg(F.collect_set("name").alias("names"))
    return pairs.select("code", F.when(F.size("names") > 1, F.raise_error(F.concat(F.lit("two names of facies "), F.col("code")))).otherwise(F.get("names", F.lit(0))).alias("name"))


def jason_wavelet(spark: SparkSession, path: str) -> DataFrame:
    """(path, k, shift, dz, centre, amp) of JASON wavelets: lines that begin with * or " are comments, then shift, step, count, samples.

    Samples are given turned in time, as convolution needs them: the first is the file's last. `centre` is the sample of
    time zero of the turned wavelet. A file with fewer samples than it promises is an error."""
    lines = F.filter(F.split(F.decode("content", "ISO-8859-1"), r"\r?\n"), lambda x: ~x.rlike(r"^\s*([*\"].*)?$"))
    first = F.transform(F.slice(lines, 1, 3), lambda x: F.regexp_extract(x, r"\S+", 0).cast("double"))
    samples = F.filter(F.split(F.array_join(F.slice(lines, 4, F.greatest(F.size(lines) - 3, F.lit(0))), " "), r"\s+"), lambda x: x != "")
    rows = _files(spark, path).select("path", first.alias("h"), samples.alias("s"))
    count = F.get("h", F.lit(2)).cast("int")
    amps = F.when(F.size("s") < count, F.raise_error(F.concat(F.col("path"), F.lit(": fewer samples than promised")))).otherwise(F.reverse(F.slice("s", 1, count)))
    shift, dz = F.get("h", F.lit(0)), F.get("h", F.lit(1))
    # Time zero is abs(shift / dz) samples behind the file's first (rounded half up), and as far from the turned wavelet's last.
    centre = count - 1 - F.floor(F.abs(shift / dz) + 0.5).cast("int")
    return rows.select("path", shift.alias("shift"), dz.alias("dz"), centre.alias("centre"), F.posexplode(amps).alias("k", "amp")).select("path", "k", "shift", "dz", "centre", F.col("amp").cast("double").alias("amp"))
