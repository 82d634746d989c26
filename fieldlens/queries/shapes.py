"""Queries over masks as shapes: centre lines, localised changes, clipped mosaics, nearest resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.operators import centreline, localise, mosaic
from fieldlens.queries.designs import STEPS, paths
from fieldlens.queries.rasters import PIXELS, mask, pixels
from fieldlens.registry import query


@query("q_centre_lines")
def centre_lines(spark: SparkSession, d: str) -> DataFrame:
    """The pixels along the centre line of each tile's mask. Held against a loop over pixels in tests."""
    return centreline.centre_lines(mask(spark, d), "tile")


@query("q_smooth_lines")
def smooth_lines(spark: SparkSession, d: str) -> DataFrame:
    """These lines smoothed inside their masks. Held against a loop in tests."""
    m = mask(spark, d)
    return centreline.smooth_lines(centreline.centre_lines(m, "tile"), m, "tile")


@query("q_segment_squares", f"""
    WITH {STEPS}, l AS (SELECT subject, max(d1) AS total FROM t GROUP BY subject HAVING max(d1) > 0),
    c AS (SELECT subject AS s, segment, segment * 500.0 AS a, least((segment + 1) * 500.0, total) AS b FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(total / 500.0) AS BIGINT)))) AS segment FROM l))
    SELECT subject, segment, round(x0 + (x - x0) * (((a + b) / 2 - d0) / (d1 - d0)), 5) AS x, round(y0 + (y - y0) * (((a + b) / 2 - d0) / (d1 - d0)), 5) AS y, round(b - a + 200, 5) AS side
    FROM c JOIN t ON subject = s AND d1 > d0 AND (a + b) / 2 >= d0 AND (a + b) / 2 < d1""")  # fmt: skip
def segment_squares(spark: SparkSession, d: str) -> DataFrame:
    found = centreline.segment_squares(paths(spark, d), "subject", "record_id", 500.0, 100.0)
    return found.select("subject", "segment", *(F.round(c, 5).alias(c) for c in ("x", "y", "side")))


def change_map(spark: SparkSession, d: str) -> DataFrame:
    """A full raster of 20 x 20 pixels for each tile: the mean quantity of a pixel's lines as a change around -0.07."""
    known = pixels(spark, d).groupBy("tile", "row", "col").agg(F.avg("q").alias("q"))
    full = known.select("tile").distinct().select("tile", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("row")).select("tile", "row", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("col"))
    return full.join(known, ["tile", "row", "col"], "left").select("tile", "row", "col", F.coalesce((21.5 - F.col("q")) / 50, F.lit(-0.07)).alias("v"))


MAP = f"grid AS (SELECT tile, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM (SELECT DISTINCT tile FROM {PIXELS}), (SELECT unnest(range(20)) AS row), (SELECT unnest(range(20)) AS col)), map AS (SELECT tile, row, col, coalesce((21.5 - q) / 50, -0.07) AS v FROM grid LEFT JOIN (SELECT tile, row, col, avg(q) AS q FROM {PIXELS} GROUP BY ALL) USING (tile, row, col))"


@query("q_raster_gauss", f"""
    WITH {MAP}, d AS (SELECT unnest(range(-6, 7)) AS k), w AS (SELECT k, exp(-0.5 * pow(k / 1.5, 2)) / (SELECT sum(exp(-0.5 * pow(k / 1.5, 2))) FROM d) AS w FROM d),
    t AS (SELECT a.k AS p, b.k AS q, a.w * b.w AS w FROM w AS a, w AS b),
    spot AS (SELECT tile, row, col, w, CASE WHEN row + p < 0 THEN -1 - row - p WHEN row + p > 19 THEN 39 - row - p ELSE row + p END AS r, CASE WHEN col + q < 0 THEN -1 - col - q WHEN col + q > 19 THEN 39 - col - q ELSE col + q END AS c FROM grid, t)
    SELECT spot.tile, spot.row, spot.col, round(sum(w * v), 6) AS v FROM spot JOIN map ON map.tile = spot.tile AND map.row = spot.r AND map.col = spot.c GROUP BY spot.tile, spot.row, spot.col""")  # fmt: skip
def raster_gauss(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian filter of each tile's map, mirrored at its edges."""
    return localise.gaussian_smooth(change_map(spark, d), "tile", "v", 1.5).withColumn("v", F.round("v", 6))


@query("q_localised_changes")
def localised_changes(spark: SparkSession, d: str) -> DataFrame:
    """Components of change of each tile with their overlap with the tile's mask. Held against a loop in tests."""
    return localise.changes(change_map(spark, d), mask(spark, d), "tile", "v")


@query("q_change_summary")
def change_summary(spark: SparkSession, d: str) -> DataFrame:
    """Changed hectares of each tile, inside the mask and outside. Held against a loop in tests."""
    return localise.change_summary(localise.changes(change_map(spark, d), mask(spark, d), "tile", "v"), "tile")


def tiled(spark: SparkSession, d: str) -> DataFrame:
    """The tiles as parts of one grid, ten side by side with two shared columns; codes are years after 1990."""
    codes = pixels(spark, d).groupBy("tile", "row", "col").agg(F.max(F.col("y") - 1990).alias("code"))
    shown = F.when(F.col("row") % 5 != F.col("tile") % 5, F.col("code")).otherwise(0)
    return codes.select("tile", (F.col("row") + F.floor(F.col("tile") / 10) * 20).cast("int").alias("row"), (F.col("col") + F.col("tile") % 10 * 18).cast("int").alias("col"), shown.alias("code"))


#: A concave ring and a hole, as steps from a polygon's corner.
RING, HOLE = [(0, 0), (6, 0), (6, 8), (3, 2.5), (0, 8)], [(1, 0.5), (2, 0.5), (2, 1.75), (1, 1.75)]


def polygons(spark: SparkSession, d: str) -> DataFrame:
    """A concave polygon for each sample, some with a hole."""
    from fieldlens.sources import standins as T

    rings = F.array(*(F.struct(F.lit(ring).alias("ring"), F.lit(k).alias("k"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for ring, points in enumerate((RING, HOLE)) for k, (x, y) in enumerate(points)))
    s = T.samples(spark, d).select("sample_id", F.explode(rings).alias("p")).filter("p.ring = 0 or sample_id % 3 = 0")
    return s.select("sample_id", "p.ring", "p.k", ((F.col("sample_id") * 37 % 1700) / 10.0 + F.col("p.x")).alias("x"), ((F.col("sample_id") * 53 % 900) / 10.0 + F.col("p.y")).alias("y"))


def _edges() -> str:
    out = []
    for points in (RING, HOLE):
        closed = [*points, points[0]]
        out.append([f"({a}, {b}, {c}, {e}, {int(points is HOLE)})" for (a, b), (c, e) in zip(closed[:-1], closed[1:], strict=True)])
    return ", ".join(out[0] + out[1])


@query("q_clipped_mosaic", f"""
    WITH t AS (SELECT tile, CAST(row + (tile // 10) * 20 AS INTEGER) AS row, CAST(col + (tile % 10) * 18 AS INTEGER) AS col, CASE WHEN row % 5 <> tile % 5 THEN max(y) - 1990 ELSE 0 END AS code FROM {PIXELS} GROUP BY tile, row, col),
    m AS (SELECT row, col, coalesce(min_by(code, tile) FILTER (code <> 0), 0) AS code FROM t GROUP BY ALL), e(ax, ay, zx, zy, hole) AS (VALUES {_edges()}),
    g AS (SELECT sample_id, (sample_id * 37 % 1700) / 10.0::DOUBLE AS x, (sample_id * 53 % 900) / 10.0::DOUBLE AS y FROM samples),
    c AS (SELECT sample_id, row, col, code, count(*) AS n FROM g JOIN m ON col BETWEEN x - 1 AND x + 7 AND row BETWEEN y - 1 AND y + 9 JOIN e ON (hole = 0 OR sample_id % 3 = 0)
          AND row + 0.5 >= y + least(ay, zy) AND row + 0.5 < y + greatest(ay, zy) AND (x + ax) + (row + 0.5 - (y + ay)) * ((x + zx) - (x + ax)) / ((y + zy) - (y + ay)) <= col + 0.5 GROUP BY ALL)
    SELECT sample_id, row, col, CASE WHEN code + 1990 >= 1995 THEN code ELSE 0 END AS code FROM c WHERE n % 2 = 1""")  # fmt: skip
def clipped_mosaic(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of each sample's polygon over the tiles it reaches, years before 1995 as 0."""
    return mosaic.clipped_mosaic(tiled(spark, d), polygons(spark, d), "sample_id", "tile", "code", 1995, 40, 1990)


#: Two grids: pixels of one unit, and coarser ones, turned a little.
FINE, TURNED = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1.5, 0.25, -1.0, -0.125, 1.25, 2.0)


@query("q_nearest_resample", f"""
    WITH p AS (SELECT tile, row, col, max(q) AS v FROM {PIXELS} GROUP BY ALL), c AS (SELECT tile, row, col, 1.5 * (col + 0.5) + 0.25 * (row + 0.5) - 1 AS x, -0.125 * (col + 0.5) + 1.25 * (row + 0.5) + 2 AS y FROM (SELECT DISTINCT tile FROM p), (SELECT CAST(unnest(range(14)) AS INTEGER) AS row), (SELECT CAST(unnest(range(13)) AS INTEGER) AS col))
    SELECT c.tile, c.row, c.col, p.v FROM c LEFT JOIN p ON p.tile = c.tile AND p.row = floor(y) AND p.col = floor(x)""")  # fmt: skip
def nearest_resample(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d).groupBy("tile", "row", "col").agg(F.max("q").alias("v"))
    return mosaic.nearest(p, "tile", "v", FINE, TURNED, (14, 13))


@query("q_band_statistics", f"""
    SELECT tile, y AS band, count(*) AS pixels, count(*) FILTER (v <> 0) AS valid, round(count(*) FILTER (v <> 0) / CAST(count(*) AS DOUBLE), 6) AS valid_share, round(avg(v) FILTER (v <> 0), 6) AS mean, round(stddev_pop(v) FILTER (v <> 0), 6) AS std, min(v) FILTER (v <> 0) AS min, max(v) FILTER (v <> 0) AS max,
           {", ".join(f"round(quantile_cont(v, {q}) FILTER (v <> 0), 6) AS p{int(q * 100)}" for q in (0.02, 0.1, 0.5, 0.9, 0.98))} FROM {PIXELS} GROUP BY ALL""")  # fmt: skip
def band_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each band of each tile; 0 stands for no data."""
    s = mosaic.band_statistics(pixels(spark, d).withColumnRenamed("y", "band"), ["tile", "band"], "v", 0.0)
    return s.select("tile", "band", "pixels", "valid", "min", "max", *(F.round(c, 6).alias(c) for c in ("valid_share", "mean", "std", "p2", "p10", "p50", "p90", "p98")))
