"""What several operators share: durable intermediate tables, size-checked broadcasts, connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contracts' white space, as a character class for Java and Python patterns.
WS = r"[\x20\x09-\x0D]+"
#: Most rows a broadcast side may have; wider or longer tables are joined by shuffles.
BROADCAST_ROWS = 200_000
#: A key with at least this share of all rows (and 1,000 rows) is joined by broadcast; there are at most 1 / share such keys.
HOT_SHARE = 1 / 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session of one process (tests) gets one of its own where it has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove_folder(spark: SparkSession, path: str) -> None:
    files, at = _hadoop(spark, path)
    files.delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """`df` from files in the shared folder, so that later reads survive lost executors and don't recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """`df` from Parquet files in a new folder of the shared one, and that folder; it is removed when the driver ends, if not before."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    files, at = _hadoop(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """As `durable`, but compressed and by columns: for wide tables of which later steps read few columns."""
    return written(df)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def for_python(df: DataFrame) -> DataFrame:
    """`df`, whose session from now on sends Python its rows in batches of bounded count and size: long texts make large ones."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """The same rows in shorter batches, so that what Python makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a durable table has at most `rows` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A durable table, marked for broadcast if it is proven small; else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


def label_sample(labels: DataFrame, id_col: str, y_col: str, each: int) -> tuple[DataFrame, dict[int, float]]:
    """((_label_id, y), {class: weight}): about `each` labels of each class, chosen by a hash of the id, to be broadcast.

    `labels` is one row an id with y 0 or 1. A label of a class stands for `weight` of them. The sample is bounded before
    it meets any document, so that no document is shuffled to meet a label."""
    known = durable(labels.select(F.col(id_col).alias("_label_id"), F.col(y_col).cast("int").alias("y")))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rates = {y: min(1.0, each / n) for y, n in totals.items()}
    place = F.pmod(F.xxhash64("_label_id", F.lit(11)), F.lit(1 << 30))
    limit = F.when(F.col("y") == 1, int((1 << 30) * rates.get(1, 1.0))).otherwise(int((1 << 30) * rates.get(0, 1.0)))
    return known.where(place < limit), {y: 1 / r for y, r in rates.items()}


def lookup(rows: DataFrame, table: DataFrame, key: str, hot: Column) -> DataFrame:
    """Inner join of `rows` with `table` (one row for each key) that no frequent key can overload.

    `hot` marks the rows of `table` whose key has at least HOT_SHARE of `rows`; there can be at most 1 / HOT_SHARE of
    them, so they are broadcast. The other keys meet in a shuffled join, where each is a small group."""
    columns = [c for c in table.columns if c != key]
    few = table.where(hot).select(F.col(key).alias("_hot_key"), F.struct(*columns).alias("_hot"))
    marked = rows.join(F.broadcast(few), F.col(key) == F.col("_hot_key"), "left").drop("_hot_key")
    found = marked.where(F.col("_hot").isNotNull()).select(*rows.columns, "_hot.*")
    others = marked.where(F.col("_hot").isNull()).drop("_hot").join(table.where(~hot), key)
    return found.unionByName(others.select(found.columns))


def connected_components(edges: DataFrame, total: int) -> DataFrame:
    """(node, component): for every node of the edges (a, b) the smallest node it is linked to, itself included.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges no longer change, each
    round written to the shared folder. `total` bounds the count of edges and sets which nodes count as hot."""
    floor = max(1000, int(total * HOT_SHARE))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = durable(edges.where("a <> b").select(low.alias("a"), high.alias("b")).distinct())
    last = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if last == state:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        last = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        large = lookup(both, least, "a", F.col("n") >= floor).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        across = lookup(large, least, "a", F.col("n") >= floor).where("b <> m").select(F.col("m").alias("a"), "b")
        now = durable(across.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
