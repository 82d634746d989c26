"""Queries over per-row functions, filters and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions import dates, geo, text
from fieldlens.operators import select as S
from fieldlens.plans.tables import table
from fieldlens.registry import query
from fieldlens.sources import standins as T


@query("q_search_samples", "SELECT sample_id, source_id, driver, region FROM samples WHERE (source_id ILIKE '%ation$_1%' ESCAPE '$' OR country ILIKE '%ation$_1%' ESCAPE '$' OR CAST(sample_id AS VARCHAR) ILIKE '%3%') AND driver = 'BUILDING'")
def search_samples(spark: SparkSession, d: str) -> DataFrame:
    """Text in any of several columns, taken literally, and an equality. Two texts of one search box are joined by OR here."""
    s = T.samples(spark, d)
    hits = S.search(s, "ation_1", ["source_id", "country"], {"driver": "BUILDING"}).unionByName(S.search(s, " 3 ", ["sample_id"], {"driver": "BUILDING"})).distinct()
    return hits.select("sample_id", "source_id", "driver", "region")


@query("q_search_count", "SELECT count(*) AS n FROM samples WHERE country ILIKE '%ation$_2%' ESCAPE '$' AND driver = 'MACHINERY'")
def search_count(spark: SparkSession, d: str) -> DataFrame:
    return S.search(T.samples(spark, d), "ATION_2", ["country"], {"driver": "MACHINERY"}).agg(F.count(F.lit(1)).alias("n"))


@query("q_page", "SELECT sample_id, source_id FROM samples ORDER BY driver, source_id, sample_id LIMIT 50 OFFSET 100")
def page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of fifty: a listing feature, so a limit."""
    return S.page(T.samples(spark, d), ["driver", "source_id", "sample_id"], 50, 100).select("sample_id", "source_id")


@query("q_sample_summary", "SELECT sample_id, substr(source_id, 10) AS short_id, round(lat, 3) AS lat, round(lon, 3) AS lon, coalesce(CAST(l.q AS VARCHAR), 'none') AS validation FROM samples LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON doc_id = sample_id")
def sample_summary(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "labels").groupBy(F.col("doc_id").alias("sample_id")).agg(F.max("quality").cast("string").alias("q"))
    return T.samples(spark, d).join(v, "sample_id", "left").select("sample_id", F.substring("source_id", 10, 1000).alias("short_id"), F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), F.coalesce("q", F.lit("none")).alias("validation"))


@query("q_batch_samples", """
    SELECT sample_id FROM samples WHERE sample_id IN (SELECT subject FROM status_log WHERE kind = 'purchase') AND driver IN ('BUILDING', 'MACHINERY') AND sample_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")  # fmt: skip
def batch_samples(spark: SparkSession, d: str) -> DataFrame:
    """Members of a run, restricted by driver, without those already labelled."""
    run = T.status_log(spark, d).filter("kind = 'purchase'").select(F.col("subject").alias("sample_id"))
    rows = S.with_or_without(T.samples(spark, d).filter(F.col("driver").isin("BUILDING", "MACHINERY")), run, ["sample_id"], True)
    return S.with_or_without(rows, table(spark, d, "labels").select(F.col("doc_id").alias("sample_id")), ["sample_id"], False).select("sample_id")


@query("q_scene_usable", """
    SELECT scene_id, NOT excluded AND cloud <= 0.06 AND brightness >= 2000 AS usable, concat_ws(',', CASE WHEN excluded THEN 'excluded' END, CASE WHEN cloud > 0.06 THEN 'cloud' END, CASE WHEN brightness < 2000 THEN 'dark' END) AS why FROM scenes""")  # fmt: skip
def scene_usable(spark: SparkSession, d: str) -> DataFrame:
    why = S.reasons(excluded=F.col("excluded"), cloud=F.col("cloud") > 0.06, dark=F.col("brightness") < 2000)
    return T.scenes(spark, d).select("scene_id", (F.size(why) == 0).alias("usable"), F.concat_ws(",", why).alias("why"))


@query("q_quality_action", """
    SELECT scene_id, CASE WHEN array_length(f) IS NULL OR len(f) = 0 THEN 'keep' WHEN flag = 'R' AND list_contains(f, 'cloud') THEN 'already_excluded' WHEN len(f) = 1 THEN 'exclude:' || f[1] ELSE 'exclude_multi' END AS action
    FROM (SELECT scene_id, flag, list_filter([CASE WHEN cloud > 0.08 THEN 'cloud' END, CASE WHEN shadow > 0.06 THEN 'shadow' END], lambda x: x IS NOT NULL) AS f FROM scenes)""")  # fmt: skip
def quality_action(spark: SparkSession, d: str) -> DataFrame:
    """Decision table over a set of flags and what is recorded already; the first flag is the primary one."""
    f = S.reasons(cloud=F.col("cloud") > 0.08, shadow=F.col("shadow") > 0.06)
    action = F.when(F.size(f) == 0, "keep").when((F.col("flag") == "R") & F.array_contains(f, "cloud"), "already_excluded").when(F.size(f) == 1, F.concat(F.lit("exclude:"), F.element_at(f, 1))).otherwise("exclude_multi")
    return T.scenes(spark, d).select("scene_id", action.alias("action"))


#: Free-text reasons with what they mean: one group, all codes, and how another year is stated.
REASONS = (
    ("No PRE-images", "NO_PRE", "NO_PRE", "expert_year_not_structured"),
    ("No valid PRE-images", "NO_PRE", "QC_FAILED", "expert_year_not_structured"),
    ("Последствия пожара прошлого года", "YEAR_MISMATCH", "YEAR_MISMATCH", "relative_year_in_free_text"),
    ("Пожар другого года", "YEAR_MISMATCH", "YEAR_MISMATCH", "different_year_without_direction"),
    ("The consequences of the fire next year.", "YEAR_MISMATCH", "YEAR_MISMATCH", "relative_year_in_free_text"),
    ("Post image of 2019, wrong year", "YEAR_MISMATCH", "YEAR_MISMATCH", "explicit_year_in_free_text"),
    ("fire of 1998", "YEAR_MISMATCH", "", "expert_year_not_structured"),
    ("order 120190", "OTHER_INVALID", "", "expert_year_not_structured"),
    ("Маленькое событие по маске", "EVENT_TOO_SMALL", "EVENT_TOO_SMALL", "expert_year_not_structured"),
    ("A small event for recognizing the type.", "EVENT_TOO_SMALL", "EVENT_TOO_SMALL", "expert_year_not_structured"),
    ("Изменений не видно", "NO_VISIBLE_CHANGE", "NO_VISIBLE_CHANGE", "expert_year_not_structured"),
    ("Между изоюражениями не видно рвзницы", "NO_VISIBLE_CHANGE", "NO_VISIBLE_CHANGE", "expert_year_not_structured"),
    ("Невозможно определить тип", "TYPE_UNCLEAR", "", "expert_year_not_structured"),
    ("Явно не пожар, но может и не вырубка - слишком маленькое событие", "EVENT_TOO_SMALL", "EVENT_TOO_SMALL,OTHER_INVALID", "expert_year_not_structured"),
    ("Нет  POST и облака", "QC_FAILED", "NO_POST", "expert_year_not_structured"),
    ("ｎｏ ｐｏｓｔ image", "OTHER_INVALID", "NO_POST", "expert_year_not_structured"),
    ("  ", "OTHER_INVALID", "", "expert_year_not_structured"),
    ("unknown custom text", "OTHER_INVALID", "", "expert_year_not_structured"),
)
REASON_TABLE = "(VALUES " + ", ".join(f"({i}, '{group}', '{codes}', '{source}')" for i, (_, group, codes, source) in enumerate(REASONS)) + ") AS r(k, grp, codes, reading)"


@query("q_reason_groups", f"SELECT grp AS reason_group, codes, reading AS source, CASE WHEN codes = '' THEN 'UNMAPPED' WHEN contains(codes, ',') THEN 'MAPPED_MULTI' ELSE 'MAPPED' END AS status, count(*) AS n FROM documents JOIN {REASON_TABLE} ON doc_id % {len(REASONS)} = k GROUP BY ALL")
def reason_groups(spark: SparkSession, d: str) -> DataFrame:
    """Single-label, multi-label and year readings of free-text reasons, against a table of what each text means."""
    r = F.element_at(F.array(*(F.lit(x[0]) for x in REASONS)), (F.col("doc_id") % len(REASONS) + 1).cast("int"))
    codes = text.reason_codes(r)
    rows = table(spark, d, "documents").select(text.reason_group(r).alias("reason_group"), F.concat_ws(",", codes).alias("codes"), text.inferred_year(r, F.lit(2018))["source"].alias("source"), text.mapping_status(codes).alias("status"))
    return rows.groupBy("reason_group", "codes", "source", "status").agg(F.count(F.lit(1)).alias("n"))


@query("q_parse_numbers", """
    WITH t AS (SELECT doc_id, ['1.5', ' 2,25 ', 'nan', 'None', '', 'abc', '1e3', '2019', '1975', 'inf'][doc_id % 10 + 1] AS raw FROM documents)
    SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 1.5 WHEN 1 THEN 2.25 WHEN 6 THEN 1000 WHEN 7 THEN 2019 WHEN 8 THEN 1975 END::DOUBLE AS number, CASE doc_id % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 6 THEN 1000 WHEN 7 THEN 2019 WHEN 8 THEN 1975 END::BIGINT AS whole, CASE doc_id % 10 WHEN 7 THEN 2019 END::INTEGER AS year FROM t""")  # fmt: skip
def parse_numbers(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*(F.lit(x) for x in ("1.5", " 2,25 ", "nan", "None", "", "abc", "1e3", "2019", "1975", "inf"))), (F.col("doc_id") % 10 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", text.parse_float(raw).alias("number"), text.parse_int(raw).alias("whole"), text.parse_event_year(raw).alias("year"))


@query("q_stable_ids", "SELECT event_id, sha1(sample_id || '|' || event_year || '|' || review_class) AS id, substr(sha1(review_class), 1, 12) AS short FROM obs")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).select("event_id", text.stable_id(F.col("sample_id"), F.col("event_year"), F.col("review_class")).alias("id"), text.row_hash(F.col("review_class")).alias("short"))


@query("q_row_fingerprint", "SELECT driver, sha256(string_agg(sha256(source_id || '|' || country), ',' ORDER BY sample_id)) AS fingerprint FROM samples GROUP BY driver")
def row_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Content fingerprint of each group's rows in order of their ids."""
    one = F.sha2(F.concat_ws("|", "source_id", "country").cast("binary"), 256)
    g = T.samples(spark, d).groupBy("driver").agg(F.sort_array(F.collect_list(F.struct("sample_id", one.alias("h")))).alias("rows"))
    return g.select("driver", F.sha2(F.concat_ws(",", F.transform("rows", lambda r: r["h"])).cast("binary"), 256).alias("fingerprint"))


@query("q_safe_names", r"SELECT doc_id, regexp_replace(source || ' / ' || coalesce(lang, '?') || '.tif', '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM documents")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.safe_name(F.concat(F.col("source"), F.lit(" / "), F.coalesce("lang", F.lit("?")), F.lit(".tif"))).alias("name"))


@query("q_append_notes", """
    SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN 'seen' WHEN sample_id % 3 = 1 THEN 'checked' ELSE 'seen | checked' END AS note FROM samples""")  # fmt: skip
def append_notes(spark: SparkSession, d: str) -> DataFrame:
    local = F.when(F.col("sample_id") % 3 == 1, "  ").otherwise("seen")
    incoming = F.when(F.col("sample_id") % 3 == 0, "see").otherwise("checked")
    return T.samples(spark, d).select("sample_id", text.append_note(local, incoming).alias("note"))


@query("q_agreement", """
    SELECT event_id, CASE WHEN human_label IS NULL THEN 'INCOMPLETE' WHEN greatest(p_a, 1 - p_a) < 0.5 OR p_b < 0.5 THEN 'UNCERTAIN' WHEN human_label = label_a THEN 'AGREE_' || upper(human_label) ELSE 'A_' || upper(human_label) || '_B_' || upper(label_a) END AS kind FROM obs""")  # fmt: skip
def agreement(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    return e.select("event_id", text.agreement(F.col("human_label"), F.col("label_a"), F.greatest(F.col("p_a"), 1 - F.col("p_a")), F.col("p_b")).alias("kind"))


@query("q_paths", """
    WITH p AS (SELECT doc_id, ['/home/x/Data/a.tif', 'data/b.tif', '', '/elsewhere/c.tif', 'C:\\w\\cache\\d.png', NULL][doc_id % 6 + 1] AS path FROM documents)
    SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'would_update' WHEN 1 THEN 'skip' WHEN 2 THEN 'skip' WHEN 3 THEN 'report_only' WHEN 4 THEN 'would_update' ELSE 'skip' END AS action,
           CASE doc_id % 6 WHEN 0 THEN 'Data/a.tif' WHEN 1 THEN 'data/b.tif' WHEN 4 THEN 'cache/d.png' END AS relative FROM p""")  # fmt: skip
def paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.element_at(F.array(F.lit("/home/x/Data/a.tif"), F.lit("data/b.tif"), F.lit(""), F.lit("/elsewhere/c.tif"), F.lit("C:\\w\\cache\\d.png"), F.lit(None)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", text.path_action(path)["action"].alias("action"), text.relative_path(path).alias("relative"))


@query("q_seasons", """
    SELECT coalesce(CASE WHEN strftime(day, '%m-%d') BETWEEN '04-15' AND '05-31' THEN 'spring' WHEN strftime(day, '%m-%d') BETWEEN '06-01' AND '06-30' THEN 'early_summer' WHEN strftime(day, '%m-%d') BETWEEN '07-01' AND '07-15' THEN 'summer' WHEN strftime(day, '%m-%d') BETWEEN '08-01' AND '10-15' THEN 'autumn' END, 'outside') AS season,
           CASE WHEN month(day) IN (12, 1, 2) THEN 'winter' WHEN month(day) <= 5 THEN 'spring' WHEN month(day) <= 8 THEN 'summer' ELSE 'autumn' END AS calendar, count(*) AS n FROM scenes GROUP BY ALL""")  # fmt: skip
def seasons(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("day")
    return T.scenes(spark, d).groupBy(dates.season(day, outside="outside").alias("season"), dates.calendar_season(day).alias("calendar")).agg(F.count(F.lit(1)).alias("n"))


@query("q_target_days", "SELECT DISTINCT event_year, CAST(round_even((dayofyear(make_date(event_year, 4, 15)) + dayofyear(make_date(event_year, 5, 31))) / 2.0, 0) AS INTEGER) AS spring, CAST(last_day(make_date(event_year, 2, 1)) AS DATE) AS february_ends FROM obs")
def target_days(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("event_year")
    return T.events(spark, d).select(y).distinct().select(y, dates.target_day(y, "04-15", "05-31").alias("spring"), dates.month_bounds(y, F.lit(2))["last"].alias("february_ends"))


@query("q_scene_times", """
    SELECT record_id, CASE record_id % 3 WHEN 0 THEN TIMESTAMP '2020-05-06 07:08:09' WHEN 1 THEN TIMESTAMP '2019-01-02 03:04:05' END AS taken FROM status_log""")  # fmt: skip
def scene_times(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("record_id") % 3
    meta = F.when(n == 0, '{"item": {"datetime": "2020-05-06T07:08:09.123Z"}}').otherwise("{}")
    scene = F.when(n == 1, "S2A_MSIL2A_20190102T030405_N0213").otherwise("none")
    return T.status_log(spark, d).select("record_id", dates.parse_scene_time(meta, scene).cast("timestamp_ntz").alias("taken"))


@query("q_geo_columns", """
    SELECT sample_id, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(least(floor((lon + 180) / 6) + 1, 60) AS INTEGER) AS epsg, round(111320.0 * cos(radians(lat)) * 0.00025 * 110574.0 * 0.00025 / 10000.0, 6) AS pixel_ha,
           round(lat - 1500.0 / 110574.0, 6) AS south, round(lon + 1500.0 / (111320.0 * cos(radians(lat))), 6) AS east FROM samples""")  # fmt: skip
def geo_columns(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    box = geo.square_bbox(lat, lon, 3000.0)
    return T.samples(spark, d).select("sample_id", geo.utm_epsg(lat, lon).alias("epsg"), F.round(geo.pixel_area_ha(lat, 0.00025), 6).alias("pixel_ha"), F.round(box["south"], 6).alias("south"), F.round(box["east"], 6).alias("east"))


@query("q_inside_polygon", """
    WITH ring AS (SELECT * FROM (VALUES (-100.0, -20.0, 60.0, -30.0), (60.0, -30.0, 120.0, 25.0), (120.0, 25.0, -20.0, 45.0), (-20.0, 45.0, -100.0, -20.0)) AS r(xa, ya, xb, yb))
    SELECT sample_id FROM samples, ring GROUP BY sample_id, lat, lon HAVING count(*) FILTER (((ya > lat) <> (yb > lat)) AND lon < (lat - ya) * (xb - xa) / (yb - ya) + xa) % 2 = 1""")  # fmt: skip
def inside_polygon(spark: SparkSession, d: str) -> DataFrame:
    ring = [(-100.0, -20.0), (60.0, -30.0), (120.0, 25.0), (-20.0, 45.0)]
    return T.samples(spark, d).filter(geo.inside(F.col("lat"), F.col("lon"), ring)).select("sample_id")


@query("q_candidate_scores", "SELECT event_id, round(10.0 * (share * 100) + p_a * 100 + ln(1 + area_ha), 6) AS score, round(CASE WHEN p_a + p_b = 0 THEN 0 ELSE (p_a - p_b) / (p_a + p_b) END, 6) AS contrast FROM obs")
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).select("event_id", geo.candidate_score(F.col("share") * 100, F.col("p_a") * 100, F.col("area_ha")).alias("score"), F.round(geo.normalized_index(F.col("p_a"), F.col("p_b")), 6).alias("contrast"))


@query("q_json_props", "SELECT kind, CAST(json_extract(note, '$.k') AS BIGINT) AS k, count(*) AS n FROM status_log GROUP BY ALL")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return T.status_log(spark, d).groupBy("kind", F.get_json_object("note", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("q_cohorts", """
    SELECT CASE doc_id % 6 WHEN 0 THEN 'MANUAL_VALID' WHEN 1 THEN 'MANUAL_WRONG' WHEN 2 THEN 'NO_MANUAL_WEAK' WHEN 3 THEN 'MANUAL_TOO_OLD' WHEN 4 THEN 'MANUAL_OTHER:maybe' ELSE 'NO_MANUAL_WEAK' END AS cohort, count(*) AS n FROM documents GROUP BY 1""")  # fmt: skip
def cohorts(spark: SparkSession, d: str) -> DataFrame:
    word = F.element_at(F.array(F.lit("Valid"), F.lit(" wrong"), F.lit(""), F.lit("Too old"), F.lit("maybe"), F.lit(None)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").groupBy(text.cohort(word).alias("cohort")).agg(F.count(F.lit(1)).alias("n"))


@query("q_timeline_cells", "SELECT event_id, event_year || ': ' || coalesce(human_label, 'n/a') || ' (' || printf('%.2f', p_a) || ')' AS cell FROM obs")
def timeline_cells(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).select("event_id", F.format_string("%d: %s (%.2f)", "event_year", F.coalesce("human_label", F.lit("n/a")), "p_a").alias("cell"))
