"""Where a map of change agrees with a mask: smoothing, thresholds, components and their overlap, all on pixel tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.raster import components, perimeters
from fieldlens.plans.lineage import materialize


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights of a Gaussian filter at whole distances from -r to r, summing to 1."""
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_smooth(pixels: DataFrame, key: str, value: str, sigma: float) -> DataFrame:
    """Rasters (key, row, col, value) smoothed along columns, then along rows; beyond its edges a raster goes on as its mirror image, edge pixels twice.

    A raster's extent is that of its rows; a value is null where a pixel in
    reach is missing or null. Every pixel tells those in reach, and the images
    of itself in the mirrors do; sums by pixel combine before the shuffle.
    """
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    by_distance = F.array(*(F.lit(w) for w in weights))
    ends = pixels.groupBy(key).agg(*(f(c).cast("int").alias(f"__{n}_{c}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))))
    all_columns = pixels.select(key, F.col("row").cast("int"), F.col("col").cast("int"), F.col(value).cast("double").alias("__v")).join(ends, key)

    def along(df: DataFrame, axis: str) -> DataFrame:
        low, high = F.col(f"__lo_{axis}"), F.col(f"__hi_{axis}")
        size = high - low + 1
        turns = F.sequence(F.floor(-r / size / 2).cast("int") - 1, F.ceil(r / size / 2).cast("int") + 1)
        at = F.col(axis) - low
        images = F.flatten(F.transform(turns, lambda m: F.array(at + 2 * size * m, 2 * size * m - 1 - at)))
        seen = df.withColumn("__image", F.explode(images)).filter((F.col("__image") >= -r) & (F.col("__image") < size + r))
        reach = F.sequence(F.greatest(F.col("__image") - r, F.lit(0)), F.least(F.col("__image") + r, size - 1))
        told = seen.withColumn("__to", F.explode(F.filter(reach, lambda t: (t >= 0) & (t < size))))
        w = F.element_at(by_distance, (F.col("__to") - F.col("__image") + r + 1).cast("int"))
        keys = [key, "row", "col", *(f"__{n}_{c}" for c in ("row", "col") for n in ("lo", "hi"))]
        moved = told.withColumns({axis: F.col("__to") + low, "__w": F.when(F.col("__v").isNotNull(), w), "__v": F.col("__v") * w})
        sums = moved.groupBy(*keys).agg(F.sum("__v").alias("__v"), F.sum("__w").alias("__w"))
        return sums.withColumn("__v", F.when(F.col("__w") > 1 - 1e-9, F.col("__v"))).drop("__w")

    return along(along(all_columns, "col"), "row").select(key, "row", "col", F.col("__v").alias(value))


def grown(mask: DataFrame, key: str, steps: int) -> DataFrame:
    """A mask (key, row, col) and all pixels within so many steps up, down, left or right."""
    places = [(a, b) for a in range(-steps, steps + 1) for b in range(-steps, steps + 1) if abs(a) + abs(b) <= steps]
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in places)))
    return mask.select(key, "row", "col", near.alias("s")).select(key, (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col")).distinct()


def changes(pixels: DataFrame, mask: DataFrame, key: str, value: str, threshold: float = -0.10, sigma: float = 1.5, least_pixels: int = 20, overlap: float = 0.3, grow: int = 2, kind: str = "long") -> DataFrame:
    """A row for each component of change: pixels, hectares, median value, share in the grown mask, whether that is a match, compactness and rectangularity.

    Change is where the smoothed value is below the threshold; parts of fewer
    than ``least_pixels`` pixels are left out. A pixel is 10 m by 10 m.
    """
    smooth = gaussian_smooth(pixels, key, value, sigma).filter(F.col(value) < threshold)
    found = materialize(components(smooth, key, kind))
    wanted = grown(mask, key, grow).withColumn("__in", F.lit(1))
    both = found.join(wanted, [key, "row", "col"], "left").join(pixels.select(key, F.col("row").cast("int"), F.col("col").cast("int"), F.col(value).alias("__v")), [key, "row", "col"])
    box = (F.max("row") - F.min("row") + 1) * (F.max("col") - F.min("col") + 1)
    per = both.groupBy(key, "component").agg(F.count(F.lit(1)).alias("pixels"), F.percentile("__v", 0.5).alias("median_value"), (F.count("__in") / F.count(F.lit(1))).alias("overlap"), (F.count(F.lit(1)) / box).alias("rectangularity"))
    per = per.filter(F.col("pixels") >= least_pixels).join(perimeters(found, [key, "component"]), [key, "component"])
    round_ = 4 * math.pi * F.col("pixels") / F.pow(F.greatest("perimeter", F.lit(1e-6)), 2)
    return per.select(
        key, "component", "pixels", (F.col("pixels") / 100).alias("hectares"), F.round("median_value", 6).alias("median_value"), F.round("overlap", 3).alias("overlap"),
        (F.col("overlap") >= overlap).alias("matched"), F.round(round_, 3).alias("compactness"), F.round("rectangularity", 3).alias("rectangularity"),
    )


def change_summary(found: DataFrame, key: str) -> DataFrame:
    """Per raster: components and hectares, matched and not."""
    matched = F.col("matched")
    n = lambda c: F.sum(c.cast("long"))
    area = lambda c: F.round(F.sum(F.when(c, F.col("hectares")).otherwise(0.0)), 3)
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("components"), n(matched).alias("matched"), n(~matched).alias("unmatched"), area(F.lit(True)).alias("hectares"), area(matched).alias("matched_hectares"), area(~matched).alias("unmatched_hectares"))
