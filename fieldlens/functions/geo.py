"""Geometry on the sphere and on small planes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda x: F.sin(F.radians(x) / 2.0)
    h = half(lat_b - lat_a) * half(lat_b - lat_a) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lon_b - lon_a) * half(lon_b - lon_a)
    return 2.0 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1.0 - h, F.lit(0.0))))


def utm_epsg(lat: Column, lon: Column) -> Column:
    """EPSG code of the UTM zone."""
    zone = F.least(F.floor((lon + 180.0) / 6.0) + 1, F.lit(60))
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def tile_id(lat: Column, lon: Column, step: int = 10) -> Column:
    """Name of a tile by its top left corner, such as 60N_030E."""
    top, left = F.floor(lat / step) * step + step, F.floor(lon / step) * step
    name = lambda v, width, pos, neg: F.concat(F.lpad(F.abs(v).cast("string"), width, "0"), F.when(v >= 0, pos).otherwise(neg))
    return F.concat(name(top, 2, "N", "S"), F.lit("_"), name(left, 3, "E", "W"))


def pixel_area_ha(lat: Column, degrees: float) -> Column:
    """Area of a square pixel of so many degrees at a latitude."""
    return 111_320.0 * F.cos(F.radians(lat)) * degrees * 110_574.0 * degrees / 10_000.0


def square_bbox(lat: Column, lon: Column, side_m: Column | float) -> Column:
    """struct(west, south, east, north) of a square of so many metres around a point."""
    half = (F.lit(float(side_m)) if isinstance(side_m, int | float) else side_m) / 2.0
    dy, dx = half / 110_574.0, half / (111_320.0 * F.cos(F.radians(lat)))
    return F.struct((lon - dx).alias("west"), (lat - dy).alias("south"), (lon + dx).alias("east"), (lat + dy).alias("north"))


def pixel_size(metres: Column, resolution: float = 10.0) -> Column:
    """Pixels of a side, from 128 to 1024."""
    return F.least(F.greatest(F.round(metres / resolution), F.lit(128.0)), F.lit(1024.0)).cast("int")


def normalized_index(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0."""
    return F.when((a + b) == 0, 0.0).otherwise((a - b) / (a + b))


def candidate_score(dominant_percent: Column, loss_percent: Column, area: Column) -> Column:
    """Score of a mined candidate."""
    return F.round(10.0 * dominant_percent + loss_percent + F.log1p(area), 6)


def entropy(p: Column) -> Column:
    """Binary entropy in bits, with the probability held off 0 and 1 by 1e-12."""
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def inside(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Point in polygon by ray casting; the ring is (lon, lat) corners."""
    hits = F.lit(0)
    for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ya != yb:
            crosses = ((F.lit(ya) > lat) != (F.lit(yb) > lat)) & (lon < (lat - ya) * (xb - xa) / (yb - ya) + xa)
            hits = hits + crosses.cast("int")
    return hits % 2 == 1


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector is null."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def stretch(value: Column, low: Column, high: Column) -> Column:
    """A band's value on the scale 0 to 255 between two of its percentiles, as a whole number."""
    return F.floor(F.least(F.greatest((value - low) / F.greatest(high - low, F.lit(1.0)) * 255.0, F.lit(0.0)), F.lit(255.0))).cast("int")


def palette_color(value: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """array(red, green, blue) of a value between colour stops, whole numbers; values beyond the stops have the last colour, the upper of two stretches wins on a stop."""
    v = F.least(F.greatest(value.cast("double"), F.lit(stops[0][0])), F.lit(stops[-1][0]))
    out = None
    for (a, left), (b, right) in reversed(list(zip(stops, stops[1:], strict=False))):
        t = (v - a) / max(b - a, 1e-6)
        color = F.array(*(F.floor(F.lit(float(x)) + (y - x) * t).cast("int") for x, y in zip(left, right, strict=True)))
        out = F.when((v >= a) & (v <= b), color) if out is None else out.when((v >= a) & (v <= b), color)
    return out


def required_tiles(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Names of the tiles that a box touches, sorted, by nine points of it: a hair inside its corners, and the middles of its sides and of itself. A box is smaller than a tile."""
    hair = 1e-9
    lons, lats = (left + hair, right - hair, (left + right) / 2), (bottom + hair, top - hair, (bottom + top) / 2)
    return F.array_sort(F.array_distinct(F.array(*(tile_id(lat, lon) for lat in lats for lon in lons))))
