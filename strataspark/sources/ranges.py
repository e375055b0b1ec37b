"""Large binary files by byte ranges: a file is split over tasks, and tasks write their ranges of one file.

Python data sources. Files are opened by pyarrow.fs (local and mounted folders, HDFS, S3 and others); a path may be a
file, a folder or, in a folder, a pattern. Writing needs a file system with random writes, as mounted ones have."""

from __future__ import annotations

import fnmatch
import os
import posixpath
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes that a task reads of a file, and that are decoded at once.
SPLIT, BLOCK = 32 << 20, 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; `file:` with any number of slashes, other schemes, and plain paths."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+://", path) else (fs.LocalFileSystem(), path)


def reachable(path: str) -> bool:
    """Whether pyarrow.fs reaches the path's file system; patterns are left to Spark where `files_of` doesn't know them."""
    try:
        return opened(path) is not None and not re.search(r"\{|[*?\[].*/", path)
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        return False


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, of the folder's files, or of those that a pattern in the last part fits; hidden ones are left out."""
    system, inner = opened(path)
    folder, last = posixpath.split(inner)
    scheme = path[: len(path) - len(inner)] if re.match(r"[a-z0-9]+://", path) else ""
    if re.search(r"[*?\[]", last):
        found = [x for x in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(x.base_name, last)]
    else:
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    return sorted((scheme + x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))


def head_of(path: str, size: int) -> bytes:
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        return f.read(size)


@dataclass
class Layout:
    """How a file is laid out: `count` records of `width` bytes from byte `start`; `header` is what decoding needs besides."""

    start: int
    width: int
    count: int
    header: dict


@dataclass
class Span(InputPartition):
    """Records [first, last) of a file."""

    path: str
    layout: Layout
    first: int
    last: int


class RangeReader(DataSourceReader):
    """Reads files of records of equal width; a subclass knows the layout and decodes records, `block` bytes at once."""

    block = BLOCK

    def __init__(self, options: dict):
        self.options = options

    def layout(self, path: str, size: int) -> Layout:
        raise NotImplementedError

    def decode(self, path: str, layout: Layout, first: int, data: bytes) -> pa.RecordBatch:
        """Rows of whole records from record `first` on."""
        raise NotImplementedError

    def partitions(self) -> Sequence[Span]:
        split, found = int(self.options.get("split", SPLIT)), []
        for path, size in files_of(self.options["path"]):
            at = self.layout(path, size)
            if at.start + at.width * at.count > size:
                raise ValueError(f"{path}: {at.count} records of {at.width} bytes expected")
            each = max(1, split // at.width)
            found += [Span(path, at, k, min(k + each, at.count)) for k in range(0, at.count, each)]
        return found

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not isinstance(partition, Span):
            return
        at, each = partition.layout, max(1, self.block // partition.layout.width)
        system, inner = opened(partition.path)
        with system.open_input_file(inner) as f:
            for k in range(partition.first, partition.last, each):
                size = min(each, partition.last - k) * at.width
                data = f.read_at(size, at.start + k * at.width)
                if len(data) < size:
                    raise ValueError(f"{partition.path}: cut short")
                yield self.decode(partition.path, at, k, data)


class OneFile(DataSource):
    """Rows (place, data) written at their places of one file of `size` bytes, which appears when all bytes are written."""

    @classmethod
    def name(cls) -> str:
        return "one_file"

    def schema(self) -> str:
        return "place long, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return OneFileWriter(self.options)


@dataclass
class Written(WriterCommitMessage):
    size: int


class OneFileWriter(DataSourceArrowWriter):
    """Tasks write into a hidden file beside the final one; the commit renames it, a failure removes it. A task that runs twice writes the same."""

    def __init__(self, options: dict):
        self.path, self.size = re.sub(r"^file:/+", "/", options["path"]), int(options["size"])
        folder, name = os.path.split(self.path)
        self.hidden = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        os.makedirs(folder, exist_ok=True)
        with open(self.hidden, "wb") as f:
            f.truncate(self.size)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        size = 0
        with open(self.hidden, "r+b") as f:
            for batch in iterator:
                for place, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    f.seek(place)
                    size += f.write(data.as_buffer())
            f.flush()
            os.fsync(f.fileno())
        return Written(size)

    def commit(self, messages: list) -> None:
        size = sum(m.size for m in messages if m is not None)
        if size != self.size:
            os.remove(self.hidden)
            raise ValueError(f"{self.path}: {self.size} bytes expected, {size} written")
        os.replace(self.hidden, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


def write_one_file(rows: DataFrame, path: str, size: int) -> None:
    """Writes rows (place, data), whose places don't overlap and cover the file, as one file of `size` bytes."""
    rows.sparkSession.dataSource.register(OneFile)
    rows.select("place", "data").write.format("one_file").mode("append").option("size", size).save(path)


class ManyFiles(DataSource):
    """Rows (name, place, data) written at their places of the files `name` of a folder, which appear when all are whole."""

    @classmethod
    def name(cls) -> str:
        return "many_files"

    def schema(self) -> str:
        return "name string, place long, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ManyFilesWriter(self.options)


@dataclass
class WrittenFiles(WriterCommitMessage):
    #: name -> (bytes written, end of the last of them)
    files: dict[str, tuple[int, int]]


class ManyFilesWriter(DataSourceArrowWriter):
    """As OneFileWriter, in a hidden folder; a file whose bytes don't reach from its start to its end without a hole is an error, and then none appears."""

    def __init__(self, options: dict):
        self.folder = re.sub(r"^file:/+", "/", options["path"])
        self.hidden = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        os.makedirs(self.hidden)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        found: dict[str, tuple[int, int]] = {}
        name, f = None, None
        try:
            for batch in iterator:
                for n, place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if n != name:
                        if f is not None:
                            f.close()
                        if not re.fullmatch(r"[^/\0.][^/\0]*", n):
                            raise ValueError(f"{n!r} can't be a file's name")
                        name, f = n, open(os.open(os.path.join(self.hidden, n), os.O_RDWR | os.O_CREAT, 0o644), "r+b")
                    f.seek(place)
                    size = f.write(data.as_buffer())
                    held = found.get(n, (0, 0))
                    found[n] = held[0] + size, max(held[1], place + size)
        finally:
            if f is not None:
                f.close()
        return WrittenFiles(found)

    def commit(self, messages: list) -> None:
        total: dict[str, tuple[int, int]] = {}
        for m in messages:
            for n, (size, end) in (m.files if m is not None else {}).items():
                held = total.get(n, (0, 0))
                total[n] = held[0] + size, max(held[1], end)
        if broken := sorted(n for n, (size, end) in total.items() if size != end):
            self.abort(messages)
            raise ValueError(f"{self.folder}: rows are missing or twice there in {', '.join(broken[:5])}")
        for n in total:
            os.replace(os.path.join(self.hidden, n), os.path.join(self.folder, n))
        shutil.rmtree(self.hidden)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


def write_files(rows: DataFrame, folder: str) -> None:
    """Writes rows (name, place, data), whose places cover each file without overlap, as the files `name` of `folder`."""
    rows.sparkSession.dataSource.register(ManyFiles)
    rows.select("name", F.col("place").cast("long").alias("place"), "data").sortWithinPartitions("name", "place").write.format("many_files").mode("append").save(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; in a session of one process without it, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """`df` from files in the shared folder, partitions and order as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_file(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the file goes when the driver ends."""
    path = posixpath.join(shared_folder(spark), f"{uuid.uuid4().hex}-{name}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
