"""Queries of interval grids and of wells blocked in them, over the driver's tables, with DuckDB SQL.

A place is a part with four surfaces, a to d from the top down, of which b is missing where the number divides by 11;
wells are users of `events`, whose samples lie at three places each and are ordered by event_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.operators import intervals as V

from .reference_queries import ORACLES, QUERIES, query, read, rounded

__all__ = ["ORACLES", "QUERIES"]
SURFACES, PRIORITIES, LAYERS, NAMES = ["a", "b", "c", "d"], [2, 3, 1, 4], [10, 8, 12], ["upper", "middle", "lower"]
PLACES = """raw AS (SELECT p_partkey AS place, CAST(p_size AS DOUBLE) AS a, CASE WHEN p_partkey % 11 <> 0 THEN 15 + p_partkey % 29 + p_size / 4.0 END AS b, CAST(20 + p_partkey % 37 AS DOUBLE) AS c, 50 + p_size / 2.0 AS d FROM part),
top AS (SELECT *, c AS ce, CASE WHEN a > c THEN c ELSE a END AS ae FROM raw), cut AS (SELECT *, CASE WHEN b > ce THEN ce ELSE b END AS b1 FROM top),
eroded AS (SELECT *, CASE WHEN b1 < ae THEN ae ELSE b1 END AS be, CASE WHEN d < ce THEN ce ELSE d END AS de FROM cut),
spans AS (SELECT place, 0 AS k, 10 AS n, 0 AS f, a AS ra, b AS rb, ae AS ta, be AS tb FROM eroded UNION ALL SELECT place, 1, 8, 10, b, c, be, ce FROM eroded UNION ALL SELECT place, 2, 12, 18, c, d, ce, de FROM eroded),
seen AS (SELECT place, k, n, f, CASE WHEN ta < ra THEN ra WHEN ta > rb THEN rb ELSE ta END AS t, CASE WHEN tb < ra THEN ra WHEN tb > rb THEN rb ELSE tb END AS u FROM spans)"""
PATHS = f"""{PLACES}, m AS (SELECT user_id AS well, event_id, value / 7 AS z, CASE WHEN event_id % 5 <> 0 THEN value / 1000 END AS porosity, 1 + (user_id + hour(ts) // 8) % 200 AS place FROM events),
held AS (SELECT m.*, s.k, s.f, CAST(least(floor(s.n * (z - t) / (u - t)), s.n - 1) AS INT) AS layer FROM m LEFT JOIN seen s ON s.place = m.place AND t <= z AND z < u QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY s.k) = 1),
met AS (SELECT *, layer + f AS total, row_number() OVER (PARTITION BY well, place, layer + f ORDER BY event_id) = 1 AS o FROM held WHERE k IS NOT NULL),
path AS (SELECT *, first_value(total) OVER w + sum(CAST(o AS INT)) OVER w - 1 AS block FROM met WINDOW w AS (PARTITION BY well ORDER BY event_id))"""


def _places(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    rows = read(spark, sf_dir, "part").select(key.alias("place"), size.alias("a"), F.when(key % 11 != 0, 15 + key % 29 + size / 4).alias("b"), (20 + key % 37).cast("double").alias("c"), (50 + size / 2).alias("d"))
    return V.eroded_in_order(rows, SURFACES, PRIORITIES)


@query(f"WITH {PLACES} SELECT place, CAST(k AS INT) AS k, round(ta, 6) AS top_eroded, round(tb, 6) AS base_eroded, round(t, 6) AS top, round(u, 6) AS base FROM spans JOIN seen USING (place, k)")
def visible_surfaces(spark, sf_dir):
    each = [F.struct(F.lit(k).alias("k"), F.col(f"{SURFACES[k]}_eroded").alias("top_eroded"), F.col(f"{SURFACES[k + 1]}_eroded").alias("base_eroded"), top.alias("top"), base.alias("base")) for k, (top, base) in enumerate(V.visible(SURFACES))]
    return rounded(_places(spark, sf_dir).select("place", F.inline(F.array(*each))))


@query(f"""WITH {PLACES}, h AS (SELECT k, n, f, count(u - t) AS n_places, max(u - t) AS lz, min(u - t) AS lo FROM seen GROUP BY ALL),
s AS (SELECT *, lo / nullif(lz, 0) AS r, lz / n AS dz, CASE WHEN lz IS NULL THEN 'empty' WHEN lo < 0 THEN 'crossing' WHEN lz = 0 THEN 'empty' WHEN lo / nullif(lz, 0) < 0.01 THEN 'thin' ELSE 'ok' END AS status FROM h)
SELECT CAST(k AS INT) AS number, ['upper', 'middle', 'lower'][CAST(k + 1 AS INT)] AS interval, CAST(n AS INT) AS n_layers, CAST(f AS INT) AS first_layer, n_places, round(lz, 6) AS lz, round(r, 6) AS min_relative, round(dz, 6) AS dz,
  round(CASE WHEN status = 'ok' THEN dz / min(dz) FILTER (status = 'ok') OVER () END, 6) AS dz_relative, round(dz / [2.0, 4.0, 5.0][CAST(k + 1 AS INT)], 6) AS resolution, status FROM s""")
def interval_boxes(spark, sf_dir):
    return rounded(V.interval_boxes(_places(spark, sf_dir), NAMES, V.visible(SURFACES), LAYERS, 0.01, [2.0, 4.0, 5.0]))


@query(f"WITH {PLACES}, e AS (SELECT place, a, d, c FROM raw) SELECT place, round(c + min(a - c) OVER (), 6) AS top_extended, round(c + max(d - c) OVER (), 6) AS base_extended FROM e")
def extended_interval(spark, sf_dir):
    return rounded(V.extended(_places(spark, sf_dir), "a", "d", "c").select("place", "top_extended", "base_extended"))


def _paths(spark, sf_dir):
    """Samples of wells with their interval, layer and block; a sample outside all intervals has none."""
    value = F.col("value")
    samples = read(spark, sf_dir, "events").select(F.col("user_id").alias("well"), "event_id", (value / 7).alias("z"), F.when(F.col("event_id") % 5 != 0, value / 1000).alias("porosity"), (1 + (F.col("user_id") + F.floor(F.hour("ts") / 8)) % 200).alias("place"))
    at = samples.join(_places(spark, sf_dir), "place").withColumn("at", V.layer_of(F.col("z"), V.visible(SURFACES), LAYERS))
    found = at.select("well", "event_id", "z", "porosity", "place", F.col("at.interval").alias("interval"), F.col("at.layer").alias("layer"), F.col("at.total").alias("total"))
    return V.blocks_along(found, "well", "event_id", ["place", "total"], "total")


@query(f"""WITH {PATHS} SELECT well, CAST(block AS BIGINT) AS block, count(*) AS n, arg_min(place, event_id) AS place, CAST(arg_min(total, event_id) AS INT) AS total, round(avg(z), 6) AS z, round(avg(porosity), 6) AS porosity, round(avg(ln(z)), 6) + 0.0 AS ln_z FROM path GROUP BY well, block""")
def interval_blocked_wells(spark, sf_dir):
    rows = _paths(spark, sf_dir).withColumn("z_log", F.col("z"))
    return rounded(V.interval_blocks(rows, "well", "event_id", ["place", "total"], ["z"], ["porosity"], ["z_log"]).withColumnRenamed("ln_z_log", "ln_z"))


@query(f"""WITH {PATHS}, e AS (SELECT well, arg_min(k, event_id) AS s, arg_max(k, event_id) AS t, arg_min(layer, event_id) AS a, arg_max(layer, event_id) AS b, arg_min(total, event_id) AS fa, arg_max(total, event_id) AS fb, max(block) - min(block) + 1 AS n FROM path GROUP BY well)
SELECT well, CAST(s AS INT) AS first_interval, CAST(t AS INT) AS last_interval, CAST(a AS INT) AS first_layer, CAST(b AS INT) AS last_layer, CAST(n AS BIGINT) AS n_defined, CAST(fa + n + 30 - fb - 1 AS BIGINT) AS n_blocks FROM e""")
def well_extents(spark, sf_dir):
    return V.well_extents(_paths(spark, sf_dir), "well", "event_id", "interval", "layer", LAYERS)
