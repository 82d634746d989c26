"""Rasters of several tiles on one grid: polygons as runs of pixels, clipping, precedence of overlapping tiles, resampling.

Pixel (row, col) of the grid covers the square from (col, row) to (col + 1,
row + 1); it lies in a polygon if its centre does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of the grid that pixels and runs meet in.
CHUNK = 64


def row_runs(rings: DataFrame, key: str) -> DataFrame:
    """key, row, low, high: the pixels of polygons in runs of columns, both ends included.

    ``rings`` has (key, ring, k, x, y): the corners of each ring in order, holes
    and parts as further rings. A point is inside if a ray from it to the left
    meets an odd number of edges. Each edge tells the rows it crosses where;
    the crossings of a polygon in a row, sorted, begin and end its runs.
    """
    ring = Window.partitionBy(key, "ring").orderBy("k")
    whole = Window.partitionBy(key, "ring").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = rings.withColumns({"x2": F.coalesce(F.lead("x").over(ring), F.first("x").over(whole)), "y2": F.coalesce(F.lead("y").over(ring), F.first("y").over(whole))}).filter("y <> y2")
    first, last = F.ceil(F.least("y", "y2") - 0.5), F.ceil(F.greatest("y", "y2") - 0.5) - 1
    crossed = edges.filter(first <= last).select(key, "x", "y", "x2", "y2", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("row"))
    at = F.col("x") + (F.col("row") + 0.5 - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))
    in_row = Window.partitionBy(key, "row").orderBy("at")  # as many rows as a polygon has edges
    paired = crossed.select(key, "row", at.alias("at")).withColumns({"n": F.row_number().over(in_row), "end": F.lead("at").over(in_row)}).filter("n % 2 = 1")
    runs = paired.select(key, "row", F.ceil(F.col("at") - 0.5).cast("int").alias("low"), (F.ceil(F.col("end") - 0.5) - 1).cast("int").alias("high"))
    return runs.filter("low <= high")


def clip(pixels: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """The pixels (row, col, ...) that lie in a polygon, once for each, with its key. Runs and pixels meet by row and stretch of columns."""
    cut = runs.select(key, F.col("row").alias("__row"), "low", "high", F.explode(F.sequence(F.floor(F.col("low") / CHUNK), F.floor(F.col("high") / CHUNK))).alias("__chunk"))
    at = (F.col("row") == F.col("__row")) & (F.floor(F.col("col") / CHUNK) == F.col("__chunk")) & F.col("col").between(F.col("low"), F.col("high"))
    return pixels.join(cut, at).drop("__row", "__chunk", "low", "high")


def merge_tiles(pixels: DataFrame, order: str, value: str) -> DataFrame:
    """row, col, value: one value a pixel of the grid, of the first tile by ``order`` that has one; 0 and null are none, and 0 where no tile has any."""
    there = F.when(F.col(value) != 0, F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    return pixels.groupBy("row", "col").agg(F.coalesce(F.min(there)["v"], F.lit(0)).alias(value))


def recent(pixels: DataFrame, value: str, first_year: int, most: int, base: int = 2000) -> DataFrame:
    """Codes of years after ``base``: 0 where they aren't between 1 and ``most`` or lie before the first year."""
    code = F.col(value)
    return pixels.withColumn(value, F.when(code.between(1, most) & (code + base >= first_year), code).otherwise(0))


def clipped_mosaic(pixels: DataFrame, rings: DataFrame, key: str, order: str, value: str, first_year: int, most: int, base: int = 2000) -> DataFrame:
    """key, row, col, value: the pixels of each polygon over all tiles, with codes of recent years or 0."""
    merged = recent(merge_tiles(pixels, order, value), value, first_year, most, base)
    return clip(merged, row_runs(rings, key), key).select(key, "row", "col", value)


def nearest(pixels: DataFrame, key: str, value: str, source: tuple[float, ...], target: tuple[float, ...], shape: tuple[int, int]) -> DataFrame:
    """key, row, col, value: each raster on another grid of ``shape`` (rows, columns); every target cell takes the value of the source cell its centre lies in, null outside.

    A grid is (a, b, c, d, e, f): column and row (u, v) lie at x = a u + b v + c, y = d u + e v + f.
    """
    a, b, c, d, e, f = source
    det = a * e - b * d
    if not det:
        raise ValueError("the source grid has no area")
    cells = pixels.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(shape[0] - 1))).alias("row")).select(key, "row", F.explode(F.sequence(F.lit(0), F.lit(shape[1] - 1))).alias("col"))
    u, v = F.col("col") + 0.5, F.col("row") + 0.5
    x, y = target[0] * u + target[1] * v + target[2] - c, target[3] * u + target[4] * v + target[5] - f
    asked = cells.withColumns({"__c": F.floor((e * x - b * y) / det).cast("int"), "__r": F.floor((a * y - d * x) / det).cast("int")})
    known = pixels.select(F.col(key).alias("__key"), F.col("row").alias("__row"), F.col("col").alias("__col"), value)
    return asked.join(known, (F.col(key) == F.col("__key")) & (F.col("__r") == F.col("__row")) & (F.col("__c") == F.col("__col")), "left").select(key, "row", "col", value)


def band_statistics(pixels: DataFrame, keys: list[str], value: str, nodata: float | None = None) -> DataFrame:
    """Per band: pixels, valid ones and their share, mean, standard deviation, least, greatest and quantiles. Null, NaN and ``nodata`` are not valid."""
    v = F.col(value).cast("double")
    good = v.isNotNull() & ~F.isnan(v) & ((v != nodata) if nodata is not None else F.lit(True))
    seen = F.when(good, v)
    quantiles = [F.percentile(seen, q).alias(f"p{int(q * 100)}") for q in (0.02, 0.1, 0.5, 0.9, 0.98)]
    return pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixels"), F.count(seen).alias("valid"), (F.count(seen) / F.count(F.lit(1))).alias("valid_share"),
        F.avg(seen).alias("mean"), F.stddev_pop(seen).alias("std"), F.min(seen).alias("min"), F.max(seen).alias("max"), *quantiles,
    )
