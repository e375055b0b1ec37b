"""Queries that write wells and surfaces into files and read them again, over the driver's tables, with DuckDB SQL.

Wells are users of `events`; surfaces are its days, with a node for each hour and user."""

from __future__ import annotations

import posixpath

from pyspark.sql import functions as F

from strataspark.operators import intervals as V
from strataspark.sources import files, texts
from strataspark.sources.ranges import shared_file

from .cube_queries import CELLS, _cube
from .reference_queries import ORACLES, QUERIES, query, read, rounded

__all__ = ["ORACLES", "QUERIES"]
FACIES = {0: "sand", 1: "shale", 2: "coal"}


@query("""WITH n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events)
SELECT 'W_' || user_id AS well, CAST(seq AS INT) AS seq, CAST(100 + user_id % 10 AS DOUBLE) AS x, CAST(200 + user_id // 10 AS DOUBLE) AS y, CAST(4 * seq AS DOUBLE) AS z,
  CASE WHEN event_id % 7 <> 0 THEN round(1300 + 12 * value, 2) END AS vp, CAST(event_id % 3 AS DOUBLE) AS facies FROM n""")
def rms_round_trip(spark, sf_dir):
    number = F.col("user_id")
    rows = V.numbered(read(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id")
    wells = rows.select(F.concat(F.lit("W "), number).alias("well"), "seq", (100 + number % 10).alias("x"), (200 + F.floor(number / 10)).alias("y"), (4 * F.col("seq")).alias("z"), F.when(F.col("event_id") % 7 != 0, 1300 + 12 * F.col("value")).alias("vp"), (F.col("event_id") % 3).cast("int").alias("facies"))
    folder = shared_file(spark, "wells")
    texts.write_rms_wells(wells, folder, ["vp"], FACIES)
    return rounded(files.rms_wells(spark, posixpath.join(folder, "*.rms"), ["vp", "facies"]), 2)


NODES = f"WITH c AS ({CELLS}) SELECT '{{kind}}' AS kind, k AS day, i, j, round(value, 3) AS z FROM c"


def _nodes(spark, sf_dir, kind: str):
    """All days' surfaces written in files of one kind, and read again by their kind."""
    cells, grid = _cube(spark, sf_dir)
    name = lambda k: F.concat(F.lit("day"), F.format_string("%02d", k.cast("int")))
    grids = spark.range(grid.nz).select(name(F.col("id")).alias("name"), F.lit(grid.nx).alias("nx"), F.lit(grid.ny).alias("ny"), *[F.lit(1.0).alias(c) for c in ("dx", "dy")], *[F.lit(0.0).alias(c) for c in ("x0", "y0", "angle")])
    folder = shared_file(spark, f"surfaces-{kind}")
    writer, reader = {"irap": (texts.write_irap_surfaces, files.irap_surface), "storm": (texts.write_storm_surfaces, texts.storm_surface)}[kind]
    writer(cells.select(name(F.col("k")).alias("name"), "i", "j", F.col("value").cast("float").cast("double").alias("z")), grids, folder)
    kinds = texts.surface_kinds(spark, folder)
    rows = reader(spark, folder).join(kinds, "path")
    return rounded(rows.select("kind", F.regexp_extract("path", r"day(\d+)\.[a-z]+$", 1).cast("int").alias("day"), "i", "j", "z"), 3)


@query(NODES.format(kind="irap"))
def irap_round_trip(spark, sf_dir):
    return _nodes(spark, sf_dir, "irap")


@query(NODES.format(kind="storm"))
def storm_surface_round_trip(spark, sf_dir):
    return _nodes(spark, sf_dir, "storm")
