"""Files as tables: what is registered against what is there, the latest finished run, a bundle's manifest.

Paths, lengths and times come from Spark's reader of binary files, which lists a
folder of any store in parallel; contents are read only where a header is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How files of the raster format begin.
RASTER_HEADERS = (b"II*\x00", b"MM\x00*", b"II+\x00", b"MM\x00+")


def files(spark: SparkSession, folder: str, pattern: str | None = None, header: bool = False) -> DataFrame:
    """path, name, length, modified (and header, the first four bytes) of every file below a folder; hidden and empty ones are not listed."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(folder)
    columns = [F.col("path"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified")]
    return found.select(*columns, *([F.substring("content", 1, 4).alias("header")] if header else []))


def below(path: Column, root: str) -> Column:
    """The path of a file as it is written after the root's."""
    return F.regexp_replace(path, "^.*" + "".join(f"\\{c}" if not c.isalnum() else c for c in root.rstrip("/")) + "/", "")


def tile_states(tiles: DataFrame, found: DataFrame, wrong: str = "treecover2000") -> DataFrame:
    """A row for each registered tile: tile_id, version, path, status and error; usable ones are ok or recovered.

    ``tiles`` has (tile_id, version, path, at): of several registrations of a tile the
    latest counts, of equal times the later path. ``found`` has (path, length, header). A tile
    registered below a folder ``wrong`` (in any case) is recovered from the place ``version/lossyear/tile_id.tif``
    if a file is there, and invalid otherwise. Files that are not there are
    missing, and so are empty ones, which Spark does not list; those that do not
    begin like a raster are invalid.
    """
    latest = tiles.groupBy("tile_id").agg(F.max_by(F.struct("version", "path"), F.struct("at", "path")).alias("t")).select("tile_id", "t.version", F.col("t.path").alias("registered"))
    misplaced = F.exists(F.split(F.lower("registered"), "/"), lambda part: part == wrong.lower())
    place = F.concat_ws("/", "version", F.lit("lossyear"), F.concat("tile_id", F.lit(".tif")))
    asked = latest.withColumns({"misplaced": F.coalesce(misplaced, F.lit(False))}).withColumn("path", F.when(F.col("misplaced"), place).otherwise(F.col("registered")))
    there = found.select(F.col("path").alias("__path"), "length", "header")
    met = asked.join(there, F.col("path") == F.col("__path"), "left")
    sound = (F.col("length") > 0) & F.coalesce(F.col("header").isin(*(F.lit(h) for h in RASTER_HEADERS)), F.lit(False))
    gone = F.col("__path").isNull()
    status = F.when(gone & F.col("misplaced"), "invalid").when(gone, "missing").when(~sound, "invalid").when(F.col("misplaced"), "recovered").otherwise("ok")
    error = F.when(gone & F.col("misplaced"), F.lit(f"registered below {wrong}, and no file at its own place")).when(gone, "no file").when(~sound, "not a raster").when(F.col("misplaced"), F.lit(f"registered below {wrong}; its own place is used"))
    return met.select("tile_id", "version", "path", F.when(F.col("misplaced"), F.col("registered")).alias("registered_path"), status.alias("status"), error.alias("error"))


def latest_run(found: DataFrame, marker: str) -> DataFrame:
    """One row, or none: run, modified of the folder whose marker file is the latest, of equal times the last by name."""
    runs = found.filter(F.col("name") == marker).select(F.regexp_replace("path", "/[^/]*$", "").alias("run"), "modified")
    return runs.agg(F.max(F.struct("modified", "run")).alias("r")).filter("r is not null").select("r.run", "r.modified")


def safe_relative(path: Column) -> Column:
    """Whether a path of a bundle stays inside it: relative, without drive, backslash, empty or dotted parts."""
    parts = F.split(path, "/")
    return F.coalesce((path != "") & ~path.contains("\\") & ~path.rlike("^[A-Za-z]:") & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


def bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, listed, length, status of a bundle's folder: what its ``manifest.json`` lists under ``files`` (objects with a ``path``) against the files there.

    unsafe paths are not looked for; the others are ok, missing, or, where only the file is there, unlisted.
    """
    manifest = spark.read.json(f"{folder.rstrip('/')}/manifest.json", multiLine=True, schema="files array<struct<path: string>>")
    listed = manifest.select(F.explode("files").alias("f")).select(F.col("f.path").alias("listed")).distinct()
    name = [p for p in folder.split("/") if p][-1]
    there = files(spark, folder).select(below(F.col("path"), name).alias("found"), "length").filter("found <> 'manifest.json'")
    met = listed.join(there, (F.col("listed") == F.col("found")) & safe_relative(F.col("listed")), "full")
    status = F.when(F.col("listed").isNull(), "unlisted").when(~safe_relative(F.col("listed")), "unsafe").when(F.col("found").isNull(), "missing").otherwise("ok")
    return met.select(F.coalesce("listed", "found").alias("path"), F.col("listed").isNotNull().alias("listed"), "length", status.alias("status"))
