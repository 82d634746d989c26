"""Reading points from CSV, GeoJSON and KML into one schema, with rejects kept apart."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions import text
from fieldlens.operators.reconcile import split_valid

#: Accepted column names of each field, first one wins.
ALIASES = {
    "source_id": ("id", "sample_id", "plotid", "fid"), "lat": ("lat", "latitude", "y"), "lon": ("lon", "lng", "long", "longitude", "x"), "driver": ("driver", "driver_primary", "class", "label"),
    "confidence": ("confidence", "driver_confidence"), "region": ("region", "country"), "event_year": ("event_year", "year", "loss_year"), "display_name": ("name", "display_name", "title"),
}


def normalize_key(name: str) -> str:
    """Lower-case letters and digits only."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def lookup(columns: list[str], *names: str) -> str | None:
    """The column whose normalised name equals the first candidate that has one."""
    known = {}
    for c in columns:
        known.setdefault(normalize_key(c), c)
    return next((known[normalize_key(n)] for n in names if normalize_key(n) in known), None)


def detect_format(filename: str, head: str = "") -> str:
    """geojson, kml or csv by suffix, else by the first character."""
    name = filename.lower()
    for suffix, kind in ((".geojson", "geojson"), (".json", "geojson"), (".kml", "kml"), (".csv", "csv")):
        if name.endswith(suffix):
            return kind
    return "geojson" if head.lstrip().startswith("{") else "kml" if head.lstrip().startswith("<") else "csv"


def normalize(rows: DataFrame, source_file: str, source_format: str, lat: Column | None = None, lon: Column | None = None) -> DataFrame:
    """The common columns of points: aliases resolved, numbers parsed, the raw row kept as JSON. A given lat and lon win over columns."""
    fields = [c for c in rows.columns if not c.startswith("__")]
    pick = lambda f: F.col(f"`{c}`").cast("string") if (c := lookup(fields, *ALIASES[f])) else F.lit(None).cast("string")
    out = {
        "source_id": F.coalesce(text.clean_text(pick("source_id")), F.col("__row").cast("string")) if "__row" in rows.columns else text.clean_text(pick("source_id")),
        "lat": F.coalesce(lat, text.parse_float(pick("lat"))) if lat is not None else text.parse_float(pick("lat")),
        "lon": F.coalesce(lon, text.parse_float(pick("lon"))) if lon is not None else text.parse_float(pick("lon")),
        "driver": text.clean_text(pick("driver")), "confidence": text.clean_text(pick("confidence")), "region": text.clean_text(pick("region")),
        "event_year": text.parse_event_year(pick("event_year")), "display_name": text.clean_text(pick("display_name")), "raw": F.to_json(F.struct(*(F.col(f"`{c}`") for c in fields))),
    }
    named = rows.select(*(v.alias(k) for k, v in out.items()), F.lit(source_file).alias("source_file"), F.lit(source_format).alias("source_format"))
    key = F.format_string("%.8f", "lat"), F.format_string("%.8f", "lon")
    return named.withColumn("sample_id", text.stable_id(F.col("source_file"), F.coalesce("source_id", F.lit("")), *key))


def valid_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with usable coordinates, and the rest with a reason."""
    return split_valid(points, {"missing_coordinates": F.col("lat").isNull() | F.col("lon").isNull(), "latitude_out_of_range": ~F.col("lat").between(-90, 90), "longitude_out_of_range": ~F.col("lon").between(-180, 180)})


def read_csv(spark: SparkSession, path: str, source_file: str | None = None) -> DataFrame:
    """Points of a CSV file with a header; a byte order mark is dropped. Rows without an id take a number unique in the file."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", mode="PERMISSIVE", multiLine=True, escape='"')
    rows = raw.toDF(*(c.lstrip("﻿").strip() or f"column_{i}" for i, c in enumerate(raw.columns))).withColumn("__row", F.monotonically_increasing_id() + 1)
    return normalize(rows, source_file or path.rsplit("/", 1)[-1], "csv")


def read_geojson(spark: SparkSession, path: str, source_file: str | None = None) -> DataFrame:
    """Points of a Feature or FeatureCollection; a Point geometry wins over lat and lon properties. Other documents raise."""
    doc = spark.read.json(path, multiLine=True)
    kinds = {r[0] for r in doc.select("type").distinct().limit(3).collect()} if "type" in doc.columns else {None}
    if not kinds <= {"Feature", "FeatureCollection"}:
        raise ValueError(f"not a Feature or FeatureCollection: {sorted(map(str, kinds))}")
    features = doc.select(F.explode("features").alias("f")).select("f.*") if "features" in doc.columns else doc
    point = F.when(F.col("geometry.type") == "Point", F.col("geometry.coordinates")) if "geometry" in features.columns else F.lit(None)
    rows = features.select("properties.*", point.alias("__point"))
    return normalize(rows, source_file or path.rsplit("/", 1)[-1], "geojson", F.try_element_at("__point", F.lit(2)).cast("double"), F.try_element_at("__point", F.lit(1)).cast("double"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """name, kind, points (array of lon, lat) and the box of every Placemark."""
    schema = "_id string, name string, Point struct<coordinates:string>, LineString struct<coordinates:string>, Polygon struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>"
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    raw = F.coalesce("Point.coordinates", "LineString.coordinates", "Polygon.outerBoundaryIs.LinearRing.coordinates")
    kind = F.when(F.col("Point").isNotNull(), "Point").when(F.col("LineString").isNotNull(), "LineString").when(F.col("Polygon").isNotNull(), "Polygon")
    number = lambda p, i: F.split(p, ",")[i].cast("double")
    points = F.transform(F.filter(F.split(F.trim(raw), r"\s+"), lambda p: p != ""), lambda p: F.struct(number(p, 0).alias("lon"), number(p, 1).alias("lat")))
    out = marks.select(F.col("_id").alias("id"), "name", kind.alias("kind"), points.alias("points"))
    box = F.struct(F.array_min("points.lon").alias("west"), F.array_min("points.lat").alias("south"), F.array_max("points.lon").alias("east"), F.array_max("points.lat").alias("north"))
    return out.withColumn("box", box)


def normalize_item(item: Column) -> list[Column]:
    """Flat columns of a catalogue item's JSON."""
    get = lambda p: F.get_json_object(item, p)
    return [get("$.id").alias("item_id"), get("$.collection").alias("collection"), F.try_to_timestamp(F.regexp_replace(F.substring(get("$.properties.datetime"), 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).alias("taken"), get("$.properties['eo:cloud_cover']").cast("double").alias("cloud"), F.from_json(get("$.bbox"), "array<double>").alias("box")]


def search_items(items: DataFrame, west: float, south: float, east: float, north: float, first: str, last: str, most_cloud: float, limit: int) -> DataFrame:
    """Items whose box meets the given one, taken between two days, least cloud first; unknown cloud sorts last."""
    b = F.col("box")
    meets = (b[0] <= east) & (b[2] >= west) & (b[1] <= north) & (b[3] >= south)
    return items.filter(meets & F.col("taken").between(first, last) & (F.coalesce("cloud", F.lit(0.0)) <= most_cloud)).orderBy(F.coalesce("cloud", F.lit(10000.0)), "item_id").limit(limit)
