"""Writing results: CSV with nested values as JSON, JSON lines and GeoJSON features."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.plans.lineage import materialize


def union_of_columns(frames: list[DataFrame]) -> DataFrame:
    """All rows with all columns, in the order first seen; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text with their keys in order."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    as_json = lambda f: F.to_json(F.map_from_entries(F.sort_array(F.map_entries(f.name))) if isinstance(f.dataType, T.MapType) else F.col(f.name)).alias(f.name)
    return df.select(*(as_json(f) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header; an existing folder is an error."""
    flat(df).write.mode("errorifexists").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines with columns by name."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)


def as_features(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One GeoJSON Feature a row, as text in column value."""
    properties = F.struct(*(F.col(c) for c in df.columns if c not in (lat, lon)))
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))


def write_geojson_lines(df: DataFrame, path: str) -> None:
    """A folder of newline-delimited features: many writers, no file that one task has to hold."""
    as_features(df).write.mode("errorifexists").text(path)


def export_tables(frames: dict[str, DataFrame], root: str, note: str = "") -> DataFrame:
    """Writes every result table as CSV below ``root/tables``, and ``root/manifest`` with a row for each: name, rows, columns, fields, note. Returns the manifest as read back.

    Each table is computed once, into a checkpoint that is counted and written. A root that holds tables is an error.
    """
    spark, made = next(iter(frames.values())).sparkSession, []
    for name, frame in frames.items():
        if not re.fullmatch(r"[A-Za-z0-9_]+", name):
            raise ValueError(f"{name!r} is no name of a table")
        done = materialize(frame)
        write_csv(done, f"{root.rstrip('/')}/tables/{name}")
        made.append((name, done.count(), len(frame.columns), ", ".join(f"{c} {t}" for c, t in frame.dtypes), note))
    manifest = spark.createDataFrame(made, "name string, rows long, columns int, fields string, note string")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{root.rstrip('/')}/manifest")
    return read_manifest(spark, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("name string, rows long, columns int, fields string, note string").json(f"{root.rstrip('/')}/manifest")


def unlike_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Tables of an export whose files don't hold the rows that its manifest states: name, rows, found."""
    out = None
    for r in read_manifest(spark, root).collect():  # a row a table
        found = spark.read.csv(f"{root.rstrip('/')}/tables/{r['name']}", header=True, escape='"', multiLine=True).agg(F.count(F.lit(1)).alias("found"))
        row = found.select(F.lit(r["name"]).alias("name"), F.lit(r["rows"]).alias("rows"), "found")
        out = row if out is None else out.unionByName(row)
    return out.filter("rows <> found")


def save_model(model: PipelineModel, root: str, sample: DataFrame, metrics: dict[str, float], features: list[str]) -> None:
    """Writes a fitted model below ``root/model``, with its metrics, features and the probabilities of a few sample rows below ``root/card``."""
    model.write().save(f"{root.rstrip('/')}/model")
    smoke = model.transform(sample).select(F.to_json(F.struct(*features)).alias("row"), vector_to_array("probability").alias("probability"))
    rows = smoke.withColumns({"features": F.array(*(F.lit(f) for f in features)), "metrics": F.create_map(*(F.lit(x) for kv in metrics.items() for x in kv))})
    rows.write.mode("errorifexists").json(f"{root.rstrip('/')}/card")


def load_model(spark: SparkSession, root: str, types: str, tolerance: float = 1e-9) -> PipelineModel:
    """The model of a folder, once it gives its sample rows the probabilities that it was saved with. ``types`` is the schema of its features."""
    model = PipelineModel.load(f"{root.rstrip('/')}/model")
    card = spark.read.schema("row string, probability array<double>").json(f"{root.rstrip('/')}/card")
    again = model.transform(card.select(F.from_json("row", types).alias("r"), F.col("probability").alias("was")).select("r.*", "was"))
    off = F.array_max(F.zip_with(vector_to_array("probability"), "was", lambda a, b: F.abs(a - b)))
    worst = again.agg(F.max(off).alias("w"), F.count(F.lit(1)).alias("n")).first()
    if not worst["n"] or worst["w"] > tolerance:
        raise ValueError("the model does not repeat its sample rows")
    return model
