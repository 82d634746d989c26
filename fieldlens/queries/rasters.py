"""Queries over pixel tables: a part's ordered lines play a raster of 20 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.operators import raster as R
from fieldlens.plans.tables import table
from fieldlens.registry import query

PIXELS = "(SELECT l_suppkey % 50 AS tile, CAST(l_partkey % 20 AS INTEGER) AS row, CAST(l_orderkey % 20 AS INTEGER) AS col, CAST(year(l_shipdate) AS INTEGER) AS y, l_discount AS v, l_quantity AS q FROM lineitem)"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_suppkey") % 50).alias("tile"), (F.col("l_partkey") % 20).cast("int").alias("row"), (F.col("l_orderkey") % 20).cast("int").alias("col"), F.year("l_shipdate").alias("y"), F.col("l_discount").alias("v"), F.col("l_quantity").alias("q"))


COMPOSITE = f"SELECT tile, row, col, quantile_cont(v, {{share}}) AS v FROM {PIXELS} WHERE {{when}} GROUP BY ALL"


@query("q_raster_difference", f"WITH pre AS ({COMPOSITE.format(share=0.75, when='y <= 1997')}), post AS ({COMPOSITE.format(share=0.25, when='y > 1997')}) SELECT tile, row, col, round(post.v - pre.v, 6) + 0 AS v FROM post JOIN pre USING (tile, row, col)")
def raster_difference(spark: SparkSession, d: str) -> DataFrame:
    """Quantile composites of two periods and their difference."""
    p, keys = pixels(spark, d), ["tile", "row", "col"]
    out = R.difference(R.composite(p.filter("y > 1997"), keys, "v", 0.25), R.composite(p.filter("y <= 1997"), keys, "v", 0.75), keys, "v")
    return out.select(*keys, F.round("v", 6).alias("v"))


@query("q_raster_background", f"WITH p AS (SELECT tile, row, col, max(q) AS v FROM {PIXELS} GROUP BY ALL), b AS (SELECT tile, coalesce(quantile_cont(v, 0.5) FILTER (NOT (row BETWEEN 5 AND 14 AND col BETWEEN 5 AND 14)), 0) AS base FROM p GROUP BY tile) SELECT tile, row, col, round(v - base, 6) AS v FROM p JOIN b USING (tile)")
def raster_background(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d).groupBy("tile", "row", "col").agg(F.max("q").alias("v")).withColumn("inside", F.col("row").between(5, 14) & F.col("col").between(5, 14))
    return R.minus_background(p, "tile", "v", "inside").select("tile", "row", "col", F.round("v", 6).alias("v"))


MASK = f"(SELECT DISTINCT tile, row, col FROM {PIXELS} WHERE q >= 44)"


def mask(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).filter("q >= 44").select("tile", "row", "col").distinct()


@query("q_raster_edges", f"WITH m AS {MASK}, n AS (SELECT a.tile, a.row, a.col, count(*) AS n FROM m a JOIN m b ON a.tile = b.tile AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL) SELECT tile, count(*) AS pixels, count(*) FILTER (n < 9) AS edge FROM n GROUP BY tile")
def raster_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.edge_pixels(mask(spark, d), "tile")


@query("q_raster_components", f"""
    WITH RECURSIVE m AS {MASK}, p AS (SELECT tile, row, col, row * 20 + col AS id FROM m), e AS (SELECT a.tile, a.id AS a, b.id AS b FROM p a JOIN p b ON a.tile = b.tile AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
    c AS (SELECT tile, id, id AS root FROM p UNION SELECT c.tile, e.b, c.root FROM c JOIN e ON e.tile = c.tile AND e.a = c.id WHERE c.root < e.b), r AS (SELECT tile, id, min(root) AS root FROM c GROUP BY ALL)
    SELECT tile, count(DISTINCT root) AS components, count(*) AS pixels FROM r GROUP BY tile""")  # fmt: skip
def raster_components(spark: SparkSession, d: str) -> DataFrame:
    """8-connected components of each tile's mask."""
    return R.components(mask(spark, d), "tile").groupBy("tile").agg(F.count_distinct("component").alias("components"), F.count(F.lit(1)).alias("pixels"))


@query("q_raster_shapes")
def raster_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shape features of each tile's mask. Held against hand-made grids in tests."""
    return R.shape_features(mask(spark, d), "tile")


@query("q_year_pairs", f"""
    WITH p AS (SELECT DISTINCT tile, row, col, CAST(q AS INTEGER) % 4 AS year FROM {PIXELS} WHERE q > 20), c AS (SELECT tile, year, avg(row) AS r, avg(col) AS c FROM p GROUP BY ALL),
    m AS (SELECT a.tile, a.year, round(sqrt(min((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col))), 6) AS distance, min(greatest(abs(a.row - b.row), abs(a.col - b.col))) AS reach FROM p a JOIN p b ON a.tile = b.tile AND b.year = a.year + 1 GROUP BY ALL)
    SELECT m.tile, m.year, distance, round(sqrt((x.r - y.r) * (x.r - y.r) + (x.c - y.c) * (x.c - y.c)), 6) AS centre_distance, reach <= 1 AS touch_1, reach <= 2 AS touch_2
    FROM m JOIN c x ON x.tile = m.tile AND x.year = m.year JOIN c y ON y.tile = m.tile AND y.year = m.year + 1""")  # fmt: skip
def year_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How far apart the masks of neighbouring years of a tile are."""
    p = pixels(spark, d).filter("q > 20").select("tile", "row", "col", (F.col("q").cast("int") % 4).alias("year"))
    return R.year_pairs(p, "tile")


@query("q_raster_smooth", f"WITH p AS (SELECT tile, row, col, max(q) AS v FROM {PIXELS} GROUP BY ALL) SELECT a.tile, a.row, a.col, round(avg(b.v), 6) AS v FROM p a JOIN p b ON a.tile = b.tile AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL")
def raster_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each pixel's 3 x 3 square."""
    p = pixels(spark, d).groupBy("tile", "row", "col").agg(F.max("q").alias("v"))
    return R.box_smooth(p, "tile", "v", 1).select("tile", "row", "col", F.round("v", 6).alias("v"))


@query("q_spectral_features", f"""
    WITH s AS (SELECT tile, CASE WHEN y <= 1997 THEN 'pre' ELSE 'post' END AS period, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_pop(v) AS std, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM {PIXELS} GROUP BY ALL)
    SELECT tile, round(max(mean) FILTER (period = 'pre'), 6) AS mean_pre, round(max(mean) FILTER (period = 'post'), 6) AS mean_post, round(max(mean) FILTER (period = 'post') - max(mean) FILTER (period = 'pre'), 6) AS delta,
           round((max(mean) FILTER (period = 'post') - max(mean) FILTER (period = 'pre')) / (abs(max(mean) FILTER (period = 'pre')) + 1e-6), 6) AS rel, round(max(std) FILTER (period = 'pre'), 6) AS std_pre, round(max(p90) FILTER (period = 'post') - max(p10) FILTER (period = 'post'), 6) AS range_post FROM s GROUP BY tile""")  # fmt: skip
def spectral_features(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a band before and after, wide, with absolute and relative change."""
    g = pixels(spark, d).withColumn("period", F.when(F.col("y") <= 1997, "pre").otherwise("post")).groupBy("tile").pivot("period", ["pre", "post"])
    w = g.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", 0.1).alias("p10"), F.percentile("v", 0.9).alias("p90"))
    delta = F.col("post_mean") - F.col("pre_mean")
    return w.select("tile", F.round("pre_mean", 6).alias("mean_pre"), F.round("post_mean", 6).alias("mean_post"), F.round(delta, 6).alias("delta"), F.round(delta / (F.abs("pre_mean") + 1e-6), 6).alias("rel"), F.round("pre_std", 6).alias("std_pre"), F.round(F.col("post_p90") - F.col("post_p10"), 6).alias("range_post"))
