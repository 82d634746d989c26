"""Rasters as pixel tables (scene, row, col, value): map algebra, shapes and components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def composite(pixels: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Per pixel, a quantile over all scenes; nulls don't count."""
    return pixels.groupBy(*keys).agg(F.percentile(value, share).alias(value))


def difference(post: DataFrame, pre: DataFrame, keys: list[str], value: str) -> DataFrame:
    """post - pre where both have a value."""
    b = pre.select(*keys, F.col(value).alias("__pre"))
    return post.join(b, keys).withColumn(value, F.col(value) - F.col("__pre")).drop("__pre").filter(F.col(value).isNotNull())


def minus_background(pixels: DataFrame, key: str, value: str, inside: str) -> DataFrame:
    """Values less the median of the pixels outside the mask."""
    base = pixels.groupBy(key).agg(F.coalesce(F.percentile(F.when(~F.col(inside), F.col(value)), 0.5), F.lit(0.0)).alias("__base"))
    return pixels.join(base, key).withColumn(value, F.col(value) - F.col("__base")).drop("__base")


def edge_pixels(mask: DataFrame, key: str) -> DataFrame:
    """Per mask, its pixels and those with fewer than eight neighbours in it: each pixel tells its nine places that it is there."""
    spread = mask.select(key, "row", "col", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("s"))
    seen = spread.groupBy(key, (F.col("row") + F.col("s.a")).alias("r"), (F.col("col") + F.col("s.b")).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.max((F.col("s.a") == 0) & (F.col("s.b") == 0)).alias("own"))
    return seen.filter("own").groupBy(key).agg(F.count(F.lit(1)).alias("pixels"), F.sum((F.col("n") < 9).cast("long")).alias("edge"))


def label_components(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """8-connected component of each pixel, numbered in row order of their first pixels."""
    order = np.lexsort((cols, rows))
    r, c = rows[order].astype(np.int64), cols[order].astype(np.int64)
    width = int(c.max() - c.min()) + 3 if len(c) else 1
    code = (r - r.min()) * width + (c - c.min()) + 1 if len(r) else r
    parent = np.arange(len(code))
    links = []
    for step in (1, width - 1, width, width + 1):  # the neighbours behind: right, and the three below
        at = np.searchsorted(code, code + step)
        hit = (at < len(code)) & (code[np.minimum(at, len(code) - 1)] == code + step) if len(code) else np.zeros(0, bool)
        links.append((np.flatnonzero(hit), at[hit]))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    while True:  # the smaller label wins along every link, then labels of labels
        before = parent.copy()
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        parent = parent[parent]
        if (parent == before).all():
            break
    _, label = np.unique(parent, return_inverse=True)
    out = np.empty(len(code), np.int64)
    out[order] = label
    return out


def components(mask: DataFrame, key: str, kind: str = "long") -> DataFrame:
    """component of every pixel (key, row, col) of a mask; a mask must fit a task, as one tile does."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(component=label_components(pdf["row"].to_numpy(), pdf["col"].to_numpy()))[[key, "row", "col", "component"]]

    return mask.select(key, F.col("row").cast("int"), F.col("col").cast("int")).groupBy(key).applyInPandas(run, f"{key} {kind}, row int, col int, component long")


#: What a border pixel adds to a perimeter, by 1 + 2 x its border neighbours at the sides + 10 x those at the corners.
PERIMETER = dict.fromkeys((5, 7, 15, 17, 25, 27), 1.0) | dict.fromkeys((21, 33), 2**0.5) | dict.fromkeys((13, 23), (1 + 2**0.5) / 2)


def _around(pixels: DataFrame, keys: list[str], weights: dict[tuple[int, int], int]) -> DataFrame:
    """For each pixel, the sum of the weights of the places around it that are pixels of its keys: each pixel tells the places that it is there."""
    places = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(w).alias("w")) for (r, c), w in weights.items()))
    told = pixels.select(*keys, "row", "col", F.explode(places).alias("s"))
    at = told.groupBy(*keys, (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    return at.agg(F.sum("s.w").alias("near"), F.max((F.col("s.r") == 0) & (F.col("s.c") == 0)).alias("own")).filter("own").drop("own")


def perimeters(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Perimeter of each component, by the kinds of its border pixels (those with a side that is not of it)."""
    sides = {(0, 0): 1, (0, 1): 1, (1, 0): 1, (0, -1): 1, (-1, 0): 1}
    border = _around(parts, keys, sides).filter("near < 5").select(*keys, "row", "col")
    weights = {(r, c): 1 if not r and not c else 10 if r and c else 2 for r in (-1, 0, 1) for c in (-1, 0, 1)}
    adds = F.create_map(*(x for k, v in PERIMETER.items() for x in (F.lit(k), F.lit(v))))
    return _around(border, keys, weights).groupBy(*keys).agg(F.sum(F.coalesce(F.try_element_at(adds, F.col("near").cast("int")), F.lit(0.0))).alias("perimeter"))


def shape_features(mask: DataFrame, key: str, kind: str = "long") -> DataFrame:
    """Per mask: components, share of the largest, compactness, rectangularity (filled share of component boxes) and perimeter by area, the three weighted by area, and edge density."""
    found = components(mask, key, kind)
    boxes = found.groupBy(key, "component").agg(F.count(F.lit(1)).alias("area"), ((F.max("row") - F.min("row") + 1) * (F.max("col") - F.min("col") + 1)).alias("box"))
    parts = boxes.join(perimeters(found, [key, "component"]), [key, "component"]).withColumn("p", F.greatest("perimeter", F.lit(1e-6)))
    mean = lambda c: F.sum(F.col("area") * c) / F.sum("area")
    per = parts.groupBy(key).agg(
        F.count(F.lit(1)).alias("components"), F.sum("area").alias("pixels"), (F.max("area") / F.sum("area")).alias("largest_share"), mean(4 * math.pi * F.col("area") / (F.col("p") * F.col("p"))).alias("compactness"),
        mean(F.col("area") / F.col("box")).alias("rectangularity"), mean(F.col("p") / F.col("area")).alias("perimeter_area"),
    )
    shapes = ("largest_share", "compactness", "rectangularity", "perimeter_area")
    return per.join(edge_pixels(mask, key).select(key, "edge"), key).select(key, "components", "pixels", *(F.round(c, 6).alias(c) for c in shapes), F.round(F.col("edge") / F.col("pixels"), 6).alias("edge_density"))


def year_pairs(pixels: DataFrame, key: str) -> DataFrame:
    """For masks (key, year, row, col) of one point and neighbouring years: least distance and distance of the centres, in pixels, and whether they touch when the first grows by one or two.

    Pixels of the two years meet in cells as wide as the reach of a dilation;
    the least distance takes the masks of one tile in blocks.
    """
    one = pixels.select(key, "year", "row", "col").distinct()
    later = one.withColumn("year", F.col("year") - 1)
    sums = one.groupBy(key, "year").agg(F.avg("row").alias("r"), F.avg("col").alias("c"))
    after = sums.select(F.col(key).alias("__k"), (F.col("year") - 1).alias("__y"), F.col("r").alias("r2"), F.col("c").alias("c2"))
    pairs = sums.join(after, (F.col(key) == F.col("__k")) & (F.col("year") == F.col("__y"))).drop("__k", "__y")
    out = pairs.select(key, "year", F.sqrt((F.col("r") - F.col("r2")) ** 2 + (F.col("c") - F.col("c2")) ** 2).alias("centre_distance"))
    for reach in (1, 2):
        steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)))
        grown = one.select(key, "year", F.explode(steps).alias("s"), "row", "col").select(F.col(key).alias("__k"), F.col("year").alias("__y"), (F.col("row") + F.col("s.a")).alias("__r"), (F.col("col") + F.col("s.b")).alias("__c")).distinct()
        hits = later.join(grown, (F.col(key) == F.col("__k")) & (F.col("year") == F.col("__y")) & (F.col("row") == F.col("__r")) & (F.col("col") == F.col("__c")))
        touching = hits.select(F.col(key).alias("__k"), F.col("year").alias("__y")).distinct().withColumn("__t", F.lit(True))
        out = out.join(touching, (F.col(key) == F.col("__k")) & (F.col("year") == F.col("__y")), "left").withColumn(f"touch_{reach}", F.coalesce("__t", F.lit(False))).drop("__k", "__y", "__t")
    code = F.xxhash64(key, "year")
    near = min_distance(one.withColumn("__id", code).select("__id", "row", "col"), later.withColumn("__id", code).select("__id", "row", "col"), "__id")
    return out.withColumn("__m", F.xxhash64(key, "year")).join(near, F.col("__m") == F.col("__id")).select(key, "year", F.round("distance", 6).alias("distance"), F.round("centre_distance", 6).alias("centre_distance"), "touch_1", "touch_2")


def box_smooth(pixels: DataFrame, key: str, value: str, radius: int) -> DataFrame:
    """Mean over the square of pixels around each one, of those that are there: sums are spread along columns, then along rows."""

    def spread(df: DataFrame, along: str) -> DataFrame:
        steps = df.select(key, "row", "col", "__s", "__n", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("__d"))
        moved = steps.withColumn(along, F.col(along) + F.col("__d"))
        return moved.groupBy(key, "row", "col").agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"))

    sums = spread(spread(pixels.select(key, "row", "col", F.col(value).alias("__s"), F.lit(1).alias("__n")), "col"), "row")
    return pixels.drop(value).join(sums, [key, "row", "col"]).withColumn(value, F.col("__s") / F.col("__n")).drop("__s", "__n")


def min_distance(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Smallest pixel distance between two masks of one key (each at most a tile's pixels), in blocks inside a task."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({key: [], "distance": []})
        x, y = left[["row", "col"]].to_numpy(float), right[["row", "col"]].to_numpy(float)
        best = min(float(((x[i : i + 512, None] - y[None]) ** 2).sum(2).min()) for i in range(0, len(x), 512))
        return pd.DataFrame({key: [left[key].iloc[0]], "distance": [best**0.5]})

    return a.groupBy(key).cogroup(b.groupBy(key)).applyInPandas(run, f"{key} long, distance double")

