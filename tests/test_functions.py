import datetime as dt
import math

from pyspark.sql import functions as F

from fieldlens.functions import dates, geo, text


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


def test_reasons(spark):
    texts = ["No PRE-images", "Последствия пожара прошлого года", "Маленькое событие по маске", "Изменений не видно", "Невозможно определить тип", "fire of 1998", "order 120190", " ", None, "Нет валидных изображений", "Ёлки: нет снимков"]
    assert column(spark, texts, "string", text.reason_group) == ["NO_PRE", "YEAR_MISMATCH", "EVENT_TOO_SMALL", "NO_VISIBLE_CHANGE", "TYPE_UNCLEAR", "YEAR_MISMATCH", "OTHER_INVALID", "OTHER_INVALID", "OTHER_INVALID", "QC_FAILED", "OTHER_INVALID"]
    texts = ["A small event for recognizing the type.", "No valid PRE-images", "The consequences of the fire next year.", "Между изоюражениями не видно рвзницы", "Явно не пожар, но может и не вырубка - слишком маленькое событие", "unknown custom text", "no pre, no post", "no preview", "the year’s fire", "ｎｏ　ｐｒｅ", "low vegetation", "невалидный снимок", None]
    codes = column(spark, texts, "string", text.reason_codes)
    assert codes == [["EVENT_TOO_SMALL"], ["QC_FAILED"], ["YEAR_MISMATCH"], ["NO_VISIBLE_CHANGE"], ["EVENT_TOO_SMALL", "OTHER_INVALID"], [], ["NO_PRE", "NO_POST"], [], ["YEAR_MISMATCH"], ["NO_PRE"], ["QC_FAILED"], ["QC_FAILED"], []]
    assert column(spark, codes, "array<string>", text.mapping_status) == [("UNMAPPED", "MAPPED", "MAPPED_MULTI")[len(c)] for c in codes]
    years = column(spark, ["Последствия пожара прошлого года", "Пожар другого года", "in 2019 or 2020", "x12019", "next year", None], "string", lambda c: text.inferred_year(c, F.lit(2022)))
    assert [tuple(y) for y in years] == [(2021, -1, "relative_year_in_free_text"), (None, None, "different_year_without_direction"), (2019, -3, "explicit_year_in_free_text"), (None, None, "expert_year_not_structured"), (2023, 1, "relative_year_in_free_text"), (None, None, "expert_year_not_structured")]
    assert column(spark, [["other_invalid", " qc_failed ", "X", "NO_PRE", "no_pre"]], "array<string>", text.normalize_codes) == [["NO_PRE", "QC_FAILED", "OTHER_INVALID"]]


def test_tolerant_numbers(spark):
    assert column(spark, ["1,5", " 2 ", "nan", "None", "x", None, "-inf"], "string", text.parse_float) == [1.5, 2.0, None, None, None, None, None]
    assert column(spark, ["2019.7", "1979", "2101", "1980"], "string", text.parse_event_year) == [2019, None, None, 1980]
    assert column(spark, ["Yes", "0", "maybe", None], "string", text.parse_bool) == [True, False, None, None]


def test_notes_and_paths(spark):
    rows = spark.createDataFrame([(None, "b"), ("", "b"), ("a", "b"), ("ab", "b"), ("a", " "), (None, None)], "x string, y string")
    assert [r[0] for r in rows.select(text.append_note(F.col("x"), F.col("y"))).collect()] == ["b", "b", "a | b", "ab", "a", None]
    assert column(spark, ["/u/Cache/x.png", "x/y", "/z", "C:\\data\\q", None], "string", text.relative_path) == ["Cache/x.png", "x/y", None, "data/q", None]


def test_seasons_wrap_and_leave_gaps(spark):
    days = [dt.date(2020, 5, 1), dt.date(2020, 7, 20), dt.date(2020, 12, 31), dt.date(2020, 1, 5), None]
    assert column(spark, days, "date", lambda c: dates.season(c)) == ["spring", None, None, None, None]
    winter = (("winter", "12-01", "02-28"),)
    assert column(spark, days, "date", lambda c: dates.season(c, winter, "outside")) == ["outside", "outside", "winter", "winter", None]
    assert column(spark, days, "date", dates.calendar_season) == ["spring", "summer", "winter", "winter", None]


def test_spacing_lets_nulls_pass(spark):
    rows = spark.createDataFrame([(dt.date(2020, 1, 10), [dt.date(2020, 1, 1), None]), (dt.date(2020, 1, 5), [dt.date(2020, 1, 1)]), (None, [dt.date(2020, 1, 1)])], "d date, c array<date>")
    assert [r[0] for r in rows.select(dates.spacing_ok(F.col("d"), F.col("c"), 5)).collect()] == [True, False, True]


def test_scene_times(spark):
    rows = spark.createDataFrame([('{"item": {"datetime": "2020-05-06T07:08:09Z"}}', None), ("{}", "S2_20190102T030405_x"), ("bad", "none")], "m string, s string")
    got = [r[0] for r in rows.select(dates.parse_scene_time(F.col("m"), F.col("s"))).collect()]
    assert [g and g.isoformat() for g in got] == ["2020-05-06T07:08:09", "2019-01-02T03:04:05", None]


def test_geometry(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 90.0), (10.0, 20.0, 10.0, 20.0)], "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(geo.haversine_m(*map(F.col, "abcd"))).collect()]
    assert math.isclose(got[0], geo.EARTH_M * math.pi / 2) and got[1] == 0
    tiles = spark.createDataFrame([(55.5, 35.2), (-0.5, -0.5), (10.0, 10.0)], "lat double, lon double").select(geo.tile_id(F.col("lat"), F.col("lon")), geo.utm_epsg(F.col("lat"), F.col("lon"))).collect()
    assert [tuple(t) for t in tiles] == [("60N_030E", 32636), ("00N_010W", 32730), ("20N_010E", 32632)]
    inside = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (0.5, -0.1)], "lat double, lon double").select(geo.inside(F.col("lat"), F.col("lon"), [(0, 0), (1, 0), (1, 1), (0, 1)])).collect()
    assert [r[0] for r in inside] == [True, False, False]
    assert column(spark, [[3.0, 4.0], [0.0, 0.0]], "array<double>", geo.unit) == [[0.6, 0.8], None]
