import json

import pytest

from fieldlens.sources import readers, writers


def test_csv_with_aliases_rejects_and_row_numbers(spark, tmp_path):
    path = tmp_path / "points.csv"
    path.write_bytes("﻿ID,Latitude,LONG,Driver Primary,Year\na,\"1,5\",2,Logging,2019\n,91,0,,1900\nc,x,5,,\n".encode())
    points = readers.read_csv(spark, str(path))
    good, bad = readers.valid_points(points)
    row = good.first()
    assert good.count() == 1 and (row["source_id"], row["lat"], row["lon"], row["driver"], row["event_year"]) == ("a", 1.5, 2.0, "Logging", 2019)
    assert sorted(r["reason"] for r in bad.collect()) == ["latitude_out_of_range", "missing_coordinates"]
    assert all(r["source_id"] for r in points.collect()) and points.select("sample_id").distinct().count() == 3
    assert json.loads(row["raw"])["ID"] == "a"


def test_geojson_geometry_wins(spark, tmp_path):
    feature = lambda i, p, g: {"type": "Feature", "properties": {"id": i, **p}, "geometry": g}
    path = tmp_path / "p.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature("a", {"lat": 1.0, "lon": 2.0}, {"type": "Point", "coordinates": [30.0, 50.0]}), feature("b", {"lat": 1.0, "lon": 2.0}, None)]}))
    got = {r["source_id"]: (r["lat"], r["lon"]) for r in readers.read_geojson(spark, str(path)).collect()}
    assert got == {"a": (50.0, 30.0), "b": (1.0, 2.0)}
    path.write_text(json.dumps({"type": "Topology"}))
    with pytest.raises(ValueError):
        readers.read_geojson(spark, str(path))


def test_kml_placemarks(spark, tmp_path):
    path = tmp_path / "a.kml"
    path.write_text("<kml><Document><Placemark id='1'><name>A</name><Point><coordinates>10,20,0</coordinates></Point></Placemark><Placemark><name>L</name><LineString><coordinates> 1,2 3,4\n 5,0 </coordinates></LineString></Placemark></Document></kml>")
    got = {r["name"]: r for r in readers.read_kml(spark, str(path)).collect()}
    assert got["A"]["kind"] == "Point" and tuple(got["A"]["points"][0]) == (10.0, 20.0)
    assert tuple(got["L"]["box"]) == (1.0, 0.0, 5.0, 4.0)


def test_formats_and_lookup():
    assert [readers.detect_format(*x) for x in (("a.CSV",), ("b.json",), ("c", " {"), ("d", "<k"), ("e",))] == ["csv", "geojson", "geojson", "kml", "csv"]
    assert readers.lookup(["Plot ID", "LAT "], "plot_id", "id") == "Plot ID" and readers.lookup(["x"], "lat") is None


def test_catalogue_items(spark):
    item = lambda i, day, cloud: json.dumps({"id": i, "properties": {"datetime": f"{day}T10:00:00Z", "eo:cloud_cover": cloud}, "bbox": [0, 0, 1, 1]})
    raw = spark.createDataFrame([(item("a", "2020-06-01", 5),), (item("b", "2020-06-02", None),), (item("c", "2020-06-03", 1),), (item("d", "2021-06-03", 1),), (item("e", "2020-06-03", 80),)], "j string")
    items = raw.select(*readers.normalize_item(raw["j"]))
    got = readers.search_items(items, 0.5, 0.5, 2, 2, "2020-05-01", "2020-07-01", 50, 10).collect()
    assert [r["item_id"] for r in got] == ["c", "a", "b"]


def test_written_tables_read_back(spark, tmp_path):
    a = spark.createDataFrame([(1, {"y": 1, "x": 2}, 3.0, 4.0)], "id int, m map<string,int>, lat double, lon double")
    both = writers.union_of_columns([a, spark.createDataFrame([(2, "n")], "id int, note string")])
    writers.write_csv(both, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').orderBy("id").collect()
    assert back[0].asDict() == {"id": "1", "m": '{"x":2,"y":1}', "lat": "3.0", "lon": "4.0", "note": None} and back[1]["note"] == "n"
    writers.write_geojson_lines(a.drop("m"), str(tmp_path / "geo"))
    feature = json.loads(spark.read.text(str(tmp_path / "geo")).first()["value"])
    assert feature["geometry"] == {"type": "Point", "coordinates": [4.0, 3.0]} and feature["properties"] == {"id": 1}
    writers.write_json(a, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    with pytest.raises(Exception, match="exist"):
        writers.write_json(a, str(tmp_path / "json"))
