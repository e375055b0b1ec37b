"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, WS, documents, durable, lookup

#: Bits of the filter: FILTER_LOAD for each repeated hash, a power of two within these bounds. At the upper one (128 MB
#: of bitmaps) 67 million different repeated texts have a bit in 16 each; up to 500 million the filter still clears half the rows.
FILTER_LOAD, FILTER_MIN_BITS, FILTER_MAX_BITS = 16, 1 << 15, 1 << 30


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def repeat_filter(hashes: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, bits): the Bloom filter of the hashes that two or more rows of `hashes` (h long) have, and its size.

    First pass over the hashes: rows are counted by hash (a partial sum in each task, then 16 bytes a hash are
    shuffled). Only the repeated ones set a bit, so the filter's size and load depend on them alone. A hash that occurs
    twice always has its bit set; of the others about 1 / FILTER_LOAD do. Beyond FILTER_MAX_BITS more rows get through;
    the results stay exact."""
    return key_filter(durable(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")))


def key_filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, bits) of the distinct hashes `keys` (h long; durable), and the filter's size."""
    bits = min(FILTER_MAX_BITS, max(FILTER_MIN_BITS, 1 << (FILTER_LOAD * max(1, keys.count()) - 1).bit_length()))
    slots = keys.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("slot"))
    return slots.groupBy(F.shiftright("slot", 15).alias("bucket")).agg(F.expr("bitmap_construct_agg(slot & 32767)").alias("bits")), bits


def maybe_repeated(rows: DataFrame, flag: str, filters: tuple[DataFrame, int]) -> DataFrame:
    """`rows` (with a hash _h) with a boolean `flag`: false only where no other row has that hash. Second pass; shuffles no row."""
    bitmaps, bits = filters
    bitmaps = bitmaps.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    slot = F.col("_h").bitwiseAND(F.lit(bits - 1))
    inner = slot.bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(inner, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return (
        rows.join(F.broadcast(bitmaps), F.shiftright(slot, 15) == F.col("_bucket"), "left")
        .withColumn("_byte", byte).withColumn("_at", inner.bitwiseAND(F.lit(7)))
        .withColumn(flag, F.expr("coalesce(shiftright(_byte, _at) & 1, 0) = 1"))
        .drop("_bucket", "_bits", "_byte", "_at")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, text_sha256. Main path: DataFrame operations only.

    Texts are equal if identical once each run of ASCII white space is one space; a null text counts as empty. Of
    equal texts the row with the smallest id stays (nulls last). Rows that repeat an id and its text are one
    document: they are counted in group_size and share `kept`. An empty table gives an empty result; other columns,
    whatever their names, are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha"))
    rows = durable(rows.withColumn("_h", F.xxhash64("sha")))
    total = rows.count()
    bitmaps, bits = repeat_filter(rows.select(F.col("_h").alias("h")))
    marked = maybe_repeated(rows, "maybe", (durable(bitmaps), bits)).drop("_h")
    single = marked.where("not maybe").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    again = marked.where("maybe").drop("maybe")
    groups = durable(again.groupBy("sha").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")))
    hot = F.col("n") >= max(1000, int(total * HOT_SHARE))
    found = lookup(again, groups, "sha", hot).select(single.columns)
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return single.unionByName(found).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, the one with the smallest id (of rows that repeat it, any one).
    Columns keep their order and names, whatever these are.

    Rows the filter clears pass straight through with all their columns. Only the possibly repeated ones are grouped:
    each task first keeps its own smallest row of every text, so that one row a task and text is shuffled."""
    sha = F.sha2(normalised(F.col(f"`{text_col}`")), 256)
    hashes = docs.select(F.xxhash64(sha).alias("h"))
    bitmaps, bits = repeat_filter(hashes)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col(f"`{id_col}`").alias("_id"), sha.alias("_sha")).withColumn("_h", F.xxhash64("_sha"))
    marked = maybe_repeated(rows, "_maybe", (durable(bitmaps), bits))
    single = marked.where("not _maybe").select("_row")
    first = F.min_by("_row", F.struct(F.col("_id").isNull(), F.col("_id"))).alias("_row")
    return single.unionByName(marked.where("_maybe").groupBy("_sha").agg(first).select("_row")).select("_row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {
    "op3_exact_dedup": r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """
}
