"""States of files in folders that the tests write."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fieldlens.operators import learn
from fieldlens.sources import files as X
from fieldlens.sources import writers as W


def put(path, content=b"II*\x00abc", at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    if at:
        os.utime(path, (at, at))


def test_tile_states(spark, tmp_path):
    root = tmp_path / "cache"
    put(root / "v1/lossyear/A.tif")
    put(root / "v1/lossyear/B.tif", b"")
    put(root / "v1/lossyear/C.tif", b"<html>")
    put(root / "v1/lossyear/D.tif", b"MM\x00*x")
    put(root / "v1/TreeCover2000/D.tif")
    put(root / "v1/treecover2000/E.tif")
    put(root / "v2/lossyear/A.tif", b"II*\x00new")
    found = X.files(spark, str(root), "*.tif", header=True)
    found = found.withColumn("path", X.below(found["path"], "cache"))
    rows = [("A", "v1", "v1/lossyear/A.tif", 1), ("A", "v2", "v2/lossyear/A.tif", 2), ("B", "v1", "v1/lossyear/B.tif", 1), ("C", "v1", "v1/lossyear/C.tif", 1), ("D", "v1", "v1/TreeCover2000/D.tif", 1), ("E", "v1", "v1/treecover2000/E.tif", 1), ("F", "v1", "v1/lossyear/F.tif", 1), ("G", "v1", None, 1)]
    got = {r["tile_id"]: (r["status"], r["path"], r["registered_path"]) for r in X.tile_states(spark.createDataFrame(rows, "tile_id string, version string, path string, at int"), found).collect()}
    assert {k: v[0] for k, v in got.items()} == {"A": "ok", "B": "missing", "C": "invalid", "D": "recovered", "E": "invalid", "F": "missing", "G": "missing"}
    assert got["A"][1] == "v2/lossyear/A.tif" and got["D"][1:] == ("v1/lossyear/D.tif", "v1/TreeCover2000/D.tif")


def test_latest_run(spark, tmp_path):
    root = tmp_path / "runs"
    put(root / "a/table.csv", b"x", 1_000_000)
    put(root / "b/table.csv", b"x", 2_000_000)
    put(root / "c/table.csv", b"x", 2_000_000)
    put(root / "d/other.csv", b"x", 3_000_000)
    assert X.latest_run(X.files(spark, str(root)), "table.csv").first()["run"].endswith("runs/c")
    assert X.latest_run(X.files(spark, str(root)), "none.csv").collect() == []


def test_bundle_files(spark, tmp_path):
    root = tmp_path / "bundle"
    put(root / "data/a.csv", b"12345")
    put(root / "data/extra.csv", b"1")
    listed = ["data/a.csv", "data/b.csv", "../a.csv", "/data/a.csv", "C:/a.csv", "data//a.csv", "data\\a.csv", ""]
    put(root / "manifest.json", json.dumps({"version": 1, "files": [{"path": p, "kind": "x"} for p in listed]}, indent=1).encode())
    got = {r["path"]: (r["status"], r["length"]) for r in X.bundle_files(spark, str(root)).collect()}
    assert got.pop("data/a.csv") == ("ok", 5) and got.pop("data/b.csv") == ("missing", None) and got.pop("data/extra.csv") == ("unlisted", 1)
    assert {s for s, _ in got.values()} == {"unsafe"} and set(got) == set(listed[2:])


def test_export_and_its_manifest(spark, tmp_path):
    root = str(tmp_path / "run")
    frames = {"a": spark.range(7).withColumn("text", F.lit('two\nlines, "quoted"')), "empty": spark.range(0), "nested": spark.range(2).withColumn("x", F.array("id"))}
    got = {r["name"]: (r["rows"], r["columns"], r["fields"], r["note"]) for r in W.export_tables(frames, root, "n").collect()}
    assert got == {"a": (7, 2, "id bigint, text string", "n"), "empty": (0, 1, "id bigint", "n"), "nested": (2, 2, "id bigint, x array<bigint>", "n")}
    assert W.unlike_manifest(spark, root).collect() == []
    spark.range(3).withColumn("text", F.lit("x")).write.mode("append").csv(f"{root}/tables/a", header=True)
    assert [tuple(r) for r in W.unlike_manifest(spark, root).collect()] == [("a", 7, 10)]
    with pytest.raises(Exception, match="(?i)exist"):
        W.export_tables(frames, root)
    with pytest.raises(ValueError, match="name"):
        W.export_tables({"../a": spark.range(1)}, root)


def test_model_folder_repeats_its_rows(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, (F.col("id") % 11).cast("double")).alias("b"), ((F.col("id") % 7 + F.col("id") % 11) > 7).cast("int").alias("y"))
    model = learn.logistic(["a", "b"], "y").fit(df)
    W.save_model(model, str(tmp_path / "m"), df.limit(3), {"accuracy": 0.5}, ["a", "b"])
    again = W.load_model(spark, str(tmp_path / "m"), "a double, b double")
    assert [r["prediction"] for r in again.transform(df).collect()] == [r["prediction"] for r in model.transform(df).collect()]
    other = learn.logistic(["a", "b"], "y", ridge=5.0).fit(df)
    other.write().overwrite().save(str(tmp_path / "m/model"))
    with pytest.raises(ValueError, match="repeat"):
        W.load_model(spark, str(tmp_path / "m"), "a double, b double")
