"""Queries that join and reconcile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.operators import joins as J
from fieldlens.operators import select as S
from fieldlens.plans.tables import table
from fieldlens.registry import query
from fieldlens.sources import standins as T

LATEST_LOG = "(SELECT * FROM status_log QUALIFY row_number() OVER (PARTITION BY subject, kind ORDER BY logged_at DESC, record_id DESC) = 1)"


def latest_log(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(T.status_log(spark, d), ["subject", "kind"], [F.desc("logged_at"), F.desc("record_id")])


@query("q_reviewer_validation", f"""
    SELECT e.event_id, e.human_label, s.driver, max(l.value) FILTER (l.kind = 'click') AS click, max(l.value) FILTER (l.kind = 'view') AS view FROM obs e
    JOIN samples s ON s.sample_id = e.sample_id LEFT JOIN {LATEST_LOG} l ON l.subject = e.sample_id WHERE e.review_status = 'VALID' GROUP BY ALL""")  # fmt: skip
def reviewer_validation(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed events with their sample and the latest value of each kind, one column a kind."""
    wide = latest_log(spark, d).groupBy("subject").pivot("kind", ["click", "view"]).agg(F.max("value"))
    e = T.events(spark, d).filter("review_status = 'VALID'").join(T.samples(spark, d).select("sample_id", "driver"), "sample_id")
    return e.join(wide, F.col("sample_id") == F.col("subject"), "left").select("event_id", "human_label", "driver", "click", "view")


@query("q_ground_truth_union", """
    SELECT event_id, human_label AS label, 'review' AS source FROM obs WHERE sample_id % 2 = 0 AND human_label IS NOT NULL
    UNION ALL SELECT event_id, label_a, 'legacy' FROM obs WHERE event_year < 1998 AND NOT (sample_id % 2 = 0 AND human_label IS NOT NULL)""")  # fmt: skip
def ground_truth_union(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    reviewed = e.filter("sample_id % 2 = 0 and human_label is not null").select("event_id", F.col("human_label").alias("label"), F.lit("review").alias("source"))
    legacy = e.filter("event_year < 1998").select("event_id", F.col("label_a").alias("label"), F.lit("legacy").alias("source"))
    return J.precedence_union(reviewed, legacy, ["event_id"])


PERIODS = {-1: "PRE", 0: "EVENT", 1: "POST"}
LINKS = "SELECT e.event_id, e.event_year, s.*, CASE CAST(year(s.day) AS INTEGER) - e.event_year WHEN -1 THEN 'PRE' WHEN 0 THEN 'EVENT' ELSE 'POST' END AS period FROM obs e JOIN scenes s ON s.sample_id = e.sample_id AND year(s.day) - e.event_year BETWEEN -1 AND 1 WHERE e.dominant"


def links(spark: SparkSession, d: str) -> DataFrame:
    """Dominant events with the scenes of their year and the years next to it."""
    e = T.events(spark, d).filter("dominant").select("sample_id", "event_id", "event_year")
    return J.by_offset(e, T.scenes(spark, d).withColumn("scene_year", F.year("day")), "sample_id", "event_year", "scene_year", PERIODS)


@query("q_event_scene_links", f"SELECT period, count(*) AS n, count(DISTINCT event_id) AS events FROM ({LINKS}) GROUP BY period")
def event_scene_links(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"))


@query("q_manifest", f"""
    SELECT event_id, scene_id, period, concat_ws(',', CASE WHEN excluded THEN 'EXCLUDED' END, CASE WHEN cloud > 0.08 THEN 'CLOUD' END, CASE WHEN shadow > 0.07 THEN 'SHADOW' END, CASE WHEN brightness < 2000 THEN 'DARK' END) AS exclusions,
           NOT (excluded OR cloud > 0.08 OR shadow > 0.07 OR brightness < 2000) AS usable FROM ({LINKS})""")  # fmt: skip
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every linked scene with all reasons that exclude it."""
    why = S.reasons(EXCLUDED=F.col("excluded"), CLOUD=F.col("cloud") > 0.08, SHADOW=F.col("shadow") > 0.07, DARK=F.col("brightness") < 2000)
    return links(spark, d).select("event_id", "scene_id", "period", why.alias("why")).select("event_id", "scene_id", "period", F.concat_ws(",", "why").alias("exclusions"), (F.size("why") == 0).alias("usable"))


@query("q_review_latent_merge", """
    SELECT e.event_id, e.review_status, coalesce(CAST(r.quality AS BIGINT), e.pixels) AS pixels, e.p_a, CAST(r.toxic AS INTEGER) AS knownness FROM obs e LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) r ON r.doc_id = e.sample_id""")  # fmt: skip
def review_latent_merge(spark: SparkSession, d: str) -> DataFrame:
    """Left join whose right columns replace the left's, but for those to keep."""
    left = T.events(spark, d).select("sample_id", "event_id", "review_status", "pixels", "p_a")
    right = table(spark, d, "labels").groupBy(F.col("doc_id").alias("sample_id")).agg(F.max("quality").cast("long").alias("pixels"), F.max("toxic").alias("knownness"), F.lit("overwritten").alias("review_status"))
    return J.overwrite_join(left, right, "sample_id", keep=["review_status"]).select("event_id", "review_status", "pixels", "p_a", "knownness")


@query("q_event_features", f"""
    WITH links AS ({LINKS}), l AS (SELECT event_id, count(*) FILTER (period = 'PRE') AS pre_scenes, count(*) FILTER (period = 'POST') AS post_scenes, count(*) FILTER (cloud > 0.08) AS bad_scenes, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM links GROUP BY event_id),
    n AS (SELECT sample_id, count(*) AS siblings, sum(area_ha) AS total FROM obs GROUP BY sample_id)
    SELECT e.event_id, n.siblings, round(e.area_ha / n.total, 6) AS share, coalesce(l.pre_scenes, 0) AS pre_scenes, coalesce(l.post_scenes, 0) AS post_scenes, coalesce(l.bad_scenes, 0) AS bad_scenes, coalesce(l.flags, '') AS flags
    FROM obs e JOIN n USING (sample_id) LEFT JOIN l USING (event_id) WHERE e.dominant""")  # fmt: skip
def event_features(spark: SparkSession, d: str) -> DataFrame:
    period = lambda p: F.sum((F.col("period") == p).cast("long"))
    per = links(spark, d).groupBy("event_id").agg(period("PRE").alias("pre_scenes"), period("POST").alias("post_scenes"), F.sum((F.col("cloud") > 0.08).cast("long")).alias("bad_scenes"), F.concat_ws(",", F.sort_array(F.collect_set("flag"))).alias("flags"))
    w = Window.partitionBy("sample_id")
    e = T.events(spark, d).withColumns({"siblings": F.count(F.lit(1)).over(w), "share": F.round(F.col("area_ha") / F.sum("area_ha").over(w), 6)}).filter("dominant")
    return e.join(per, "event_id", "left").select("event_id", "siblings", "share", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pre_scenes", "post_scenes", "bad_scenes")), F.coalesce("flags", F.lit("")).alias("flags"))


@query("q_needs_review", """
    SELECT s.sample_id, s.driver FROM samples s WHERE EXISTS (SELECT 1 FROM obs e WHERE e.sample_id = s.sample_id AND e.review_class = 'OTHER_INVALID')
       OR (EXISTS (SELECT 1 FROM obs e WHERE e.sample_id = s.sample_id) AND NOT EXISTS (SELECT 1 FROM obs e WHERE e.sample_id = s.sample_id AND e.review_status = 'VALID'))""")  # fmt: skip
def needs_review(spark: SparkSession, d: str) -> DataFrame:
    """Samples with a draft event, or with events of which none is valid: semi joins to one pre-aggregated table."""
    state = T.events(spark, d).groupBy("sample_id").agg(F.bool_or(F.col("review_class") == "OTHER_INVALID").alias("draft"), F.bool_or(F.col("review_status") == "VALID").alias("valid"))
    return S.with_or_without(T.samples(spark, d), state.filter("draft or not valid"), ["sample_id"], True).select("sample_id", "driver")


@query("q_source_contexts", """
    SELECT context, count(*) AS events, count(DISTINCT sample_id) AS points FROM (
        SELECT CAST(n_regionkey AS VARCHAR) AS context, e.* FROM obs e JOIN customer ON c_custkey = e.sample_id JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3
        UNION ALL SELECT 'unassigned', e.* FROM obs e WHERE e.sample_id NOT IN (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3)) GROUP BY context""")  # fmt: skip
def source_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Events by run; those of no run go to one of their own."""
    runs = table(spark, d, "nation").filter("n_regionkey < 3").select("n_nationkey", F.col("n_regionkey").cast("string").alias("context"))
    member = table(spark, d, "customer").join(F.broadcast(runs), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("sample_id"), "context")
    e = T.events(spark, d).select("sample_id")
    both = e.join(member, "sample_id").unionByName(e.join(member, "sample_id", "left_anti").withColumn("context", F.lit("unassigned")))
    return both.groupBy("context").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("sample_id").alias("points"))


HAVERSINE = "2.0 * 6371000.0 * atan2(sqrt(h), sqrt(greatest(1.0 - h, 0.0)))"


def h_sql(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    return f"(power(sin(radians({b_lat} - {a_lat}) / 2.0), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) * power(sin(radians({b_lon} - {a_lon}) / 2.0), 2))"


SUPPLIERS = "(SELECT s_suppkey AS id, (s_suppkey * 41 % 12000) / CAST(100 AS DOUBLE) - 60 AS lat, (s_suppkey * 59 % 36000) / CAST(100 AS DOUBLE) - 180 AS lon FROM supplier)"


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 41 % 12000) / F.lit(100.0) - 60).alias("lat"), ((F.col("s_suppkey") * 59 % 36000) / F.lit(100.0) - 180).alias("lon"))


@query("q_points_within", f"""
    SELECT a_id, b_id, round(distance, 2) AS distance FROM (SELECT a.sample_id AS a_id, b.id AS b_id, {HAVERSINE.replace('h)', h_sql('a.lat', 'a.lon', 'b.lat', 'b.lon') + ')').replace('1.0 - h', '1.0 - ' + h_sql('a.lat', 'a.lon', 'b.lat', 'b.lon'))} AS distance
    FROM samples a, {SUPPLIERS} b WHERE abs(a.lat - b.lat) < 4) WHERE distance <= 300000""")  # fmt: skip
def points_within(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of points of two tables at most 300 km apart."""
    near = J.pairs_within(T.samples(spark, d).select(F.col("sample_id").alias("id"), "lat", "lon"), suppliers(spark, d), 300_000)
    return near.select("a_id", "b_id", F.round("distance_m", 2).alias("distance"))


@query("q_nearest_points", f"""
    SELECT sample_id, round({HAVERSINE}, 2) AS distance FROM (SELECT sample_id, {h_sql('lat', 'lon', 'CAST(12.5 AS DOUBLE)', 'CAST(-40.25 AS DOUBLE)')} AS h FROM samples WHERE sample_id <> 7) ORDER BY {HAVERSINE}, sample_id LIMIT 25""")  # fmt: skip
def nearest_points(spark: SparkSession, d: str) -> DataFrame:
    return J.nearest(T.samples(spark, d), 12.5, -40.25, 25, exclude=7).select("sample_id", F.round("distance_m", 2).alias("distance"))


@query("q_matched_pairs")
def matched_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Greedy one-to-one matching of nearby points of two tables, nearest first. Held against a sequential version in tests."""
    return J.matched_within(T.samples(spark, d).select(F.col("sample_id").alias("id"), "lat", "lon"), suppliers(spark, d), 300_000)


@query("q_portable_diff", """
    WITH a AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM customer WHERE c_custkey % 5 <> 0),
    b AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 11 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 13 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 6 <> 0)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN a.name IS NOT DISTINCT FROM b.name AND a.segment IS NOT DISTINCT FROM b.segment AND a.balance IS NOT DISTINCT FROM b.balance THEN 'same' ELSE 'different' END AS state,
           CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.segment IS DISTINCT FROM b.segment THEN 'segment' END, CASE WHEN a.balance IS DISTINCT FROM b.balance THEN 'balance' END) END AS changed
    FROM a FULL OUTER JOIN b ON a.k = b.k""")  # fmt: skip
def portable_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two states of one table compared by key."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    a = c.filter("k % 5 <> 0").withColumn("segment", F.when(F.col("k") % 7 != 0, F.col("segment")))
    b = c.filter("k % 6 <> 0").withColumns({"segment": F.when(F.col("k") % 11 == 0, "CHANGED").otherwise(F.col("segment")), "balance": F.when(F.col("k") % 13 == 0, F.col("balance") + 1).otherwise(F.col("balance"))})
    return J.diff(a, b, "k", ["name", "segment", "balance"])


@query("q_changed_baseline", """
    WITH a AS (SELECT event_id, review_class, pixels FROM obs WHERE sample_id % 4 <> 1), b AS (SELECT event_id, CASE WHEN sample_id % 9 = 0 THEN 'VALID_LOGGING' ELSE review_class END AS review_class, pixels FROM obs WHERE sample_id % 4 <> 2)
    SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN a.event_id IS NULL THEN 'ADDED' WHEN b.event_id IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change
    FROM a FULL OUTER JOIN b ON a.event_id = b.event_id WHERE a.event_id IS NULL OR b.event_id IS NULL OR a.review_class <> b.review_class OR a.pixels <> b.pixels""")  # fmt: skip
def changed_baseline(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    a = e.filter("sample_id % 4 <> 1")
    b = e.filter("sample_id % 4 <> 2").withColumn("review_class", F.when(F.col("sample_id") % 9 == 0, "VALID_LOGGING").otherwise(F.col("review_class")))
    state = J.diff(a, b, "event_id", ["review_class", "pixels"]).filter("state <> 'same'")
    return state.select("event_id", F.when(F.col("state") == "only_right", "ADDED").when(F.col("state") == "only_left", "REMOVED").otherwise("CHANGED").alias("change"))


@query("q_cohort_reconcile", """
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN c.event_id IS NULL THEN 'NOT_CURRENT_VALID' WHEN c.human_label = b.label_b THEN 'MATCHED' ELSE 'LABEL_CHANGED' END AS status
    FROM (SELECT event_id, label_b FROM obs WHERE sample_id % 3 = 0) b LEFT JOIN (SELECT event_id, human_label FROM obs WHERE human_label IS NOT NULL) c USING (event_id)) GROUP BY status""")  # fmt: skip
def cohort_reconcile(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    base = e.filter("sample_id % 3 = 0").select("event_id", "label_b")
    now = e.filter("human_label is not null").select("event_id", "human_label")
    status = F.when(F.col("human_label").isNull(), "NOT_CURRENT_VALID").when(F.col("human_label") == F.col("label_b"), "MATCHED").otherwise("LABEL_CHANGED")
    return base.join(now, "event_id", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("q_legacy_lookup", """
    WITH t AS (SELECT o_custkey AS sample_id, CAST(year(o_orderdate) AS INTEGER) AS event_year, count(*) AS n, min(o_orderkey) AS orderkey FROM orders GROUP BY ALL), w AS (SELECT DISTINCT o_custkey AS sample_id, CAST(year(o_orderdate) + 1 AS INTEGER) AS event_year FROM orders)
    SELECT sample_id, event_year, CASE WHEN n IS NULL THEN 'MISSING' WHEN n = 1 THEN 'EXACT' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN orderkey END AS o_orderkey FROM w LEFT JOIN t USING (sample_id, event_year)""")  # fmt: skip
def legacy_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("sample_id"), F.year("o_orderdate").alias("event_year"), "o_orderkey")
    wanted = o.select("sample_id", (F.col("event_year") + 1).alias("event_year")).distinct()
    return J.lookup_status(wanted, o, ["sample_id", "event_year"], "o_orderkey")


@query("q_link_backfill", """
    WITH n AS (SELECT sample_id, count(*) FILTER (share >= 0.4) AS dominants FROM obs GROUP BY sample_id)
    SELECT action, count(*) AS n FROM (SELECT CASE WHEN s.flag = 'A' THEN 'already_linked' WHEN s.status IS NULL THEN 'unknown_period' WHEN coalesce(n.dominants, 0) = 0 THEN 'missing_dominant' WHEN n.dominants > 1 THEN 'multiple_dominant' ELSE 'would_link' END AS action FROM scenes s LEFT JOIN n USING (sample_id)) GROUP BY action""")  # fmt: skip
def link_backfill(spark: SparkSession, d: str) -> DataFrame:
    n = T.events(spark, d).groupBy("sample_id").agg(F.sum((F.col("share") >= 0.4).cast("long")).alias("dominants"))
    action = F.when(F.col("flag") == "A", "already_linked").when(F.col("status").isNull(), "unknown_period").when(F.coalesce("dominants", F.lit(0)) == 0, "missing_dominant").when(F.col("dominants") > 1, "multiple_dominant").otherwise("would_link")
    return T.scenes(spark, d).join(n, "sample_id", "left").groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("q_unambiguous_links", "SELECT s.scene_id, e.event_id FROM scenes s JOIN (SELECT sample_id, min(event_id) AS event_id FROM obs GROUP BY sample_id HAVING count(*) = 1) e USING (sample_id)")
def unambiguous_links(spark: SparkSession, d: str) -> DataFrame:
    only = T.events(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("event_id")).filter("n = 1")
    return T.scenes(spark, d).join(only, "sample_id").select("scene_id", "event_id")


@query("q_nearest_scenes", """
    WITH x AS (SELECT e.event_id, s.scene_id, date_diff('day', make_date(e.event_year, 7, 1), s.day) AS gap_days FROM obs e JOIN scenes s USING (sample_id) WHERE e.dominant)
    SELECT event_id, scene_id, CAST(gap_days AS INTEGER) AS gap_days, CAST(row_number() OVER (PARTITION BY event_id ORDER BY abs(gap_days), scene_id) AS INTEGER) AS rank FROM x WHERE gap_days BETWEEN -730 AND -90 QUALIFY rank <= 5""")  # fmt: skip
def nearest_scenes(spark: SparkSession, d: str) -> DataFrame:
    """The five scenes nearest to 1 July of the event's year, from 24 to 3 months before it."""
    e = T.events(spark, d).filter("dominant").select("sample_id", "event_id", F.make_date("event_year", F.lit(7), F.lit(1)).alias("middle"))
    near = J.nearest_in_window(e, T.scenes(spark, d), "sample_id", "middle", "day", -730, -90, 5, "event_id", "scene_id")
    return near.select("event_id", "scene_id", "gap_days", "rank")


@query("q_training_table", """
    SELECT s.sample_id, s.driver, e.event_year, round(e.area_ha, 4) AS area_ha, m.n AS scenes, l.events AS log_events FROM samples s LEFT JOIN (SELECT * FROM obs WHERE dominant) e USING (sample_id)
    LEFT JOIN (SELECT sample_id, count(*) AS n FROM scenes GROUP BY sample_id) m USING (sample_id) LEFT JOIN (SELECT subject AS sample_id, count(*) AS events FROM status_log GROUP BY subject) l USING (sample_id)""")  # fmt: skip
def training_table(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).filter("dominant").select("sample_id", "event_year", F.round("area_ha", 4).alias("area_ha"))
    m = T.scenes(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("scenes"))
    log = T.status_log(spark, d).groupBy(F.col("subject").alias("sample_id")).agg(F.count(F.lit(1)).alias("log_events"))
    return T.samples(spark, d).select("sample_id", "driver").join(e, "sample_id", "left").join(m, "sample_id", "left").join(log, "sample_id", "left")


@query("q_labeling_plan", f"""
    WITH links AS ({LINKS}), l AS (SELECT event_id, count(*) FILTER (period = 'PRE' AND NOT excluded AND cloud <= 0.08) AS pre, count(*) FILTER (period = 'POST' AND NOT excluded AND cloud <= 0.08) AS post FROM links GROUP BY event_id)
    SELECT e.event_id, coalesce(pre, 0) AS pre, coalesce(post, 0) AS post, CASE WHEN e.human_label IS NOT NULL THEN 'LABELLED' WHEN coalesce(pre, 0) = 0 THEN 'NO_PRE' WHEN coalesce(post, 0) = 0 THEN 'NO_POST' ELSE 'READY' END AS readiness FROM obs e LEFT JOIN l USING (event_id) WHERE e.dominant""")  # fmt: skip
def labeling_plan(spark: SparkSession, d: str) -> DataFrame:
    fine = ~F.col("excluded") & (F.col("cloud") <= 0.08)
    n = lambda p: F.sum((fine & (F.col("period") == p)).cast("long"))
    per = links(spark, d).groupBy("event_id").agg(n("PRE").alias("pre"), n("POST").alias("post"))
    e = T.events(spark, d).filter("dominant").select("event_id", "human_label").join(per, "event_id", "left").fillna(0, ["pre", "post"])
    return e.select("event_id", "pre", "post", F.when(F.col("human_label").isNotNull(), "LABELLED").when(F.col("pre") == 0, "NO_PRE").when(F.col("post") == 0, "NO_POST").otherwise("READY").alias("readiness"))


@query("q_import_plan", """
    SELECT m.k, CASE WHEN c.c_custkey IS NULL THEN 'create' WHEN c.c_name <> m.name THEN 'identity_conflict' WHEN sha1(c.c_mktsegment) <> m.digest THEN 'checksum_mismatch' ELSE 'exists' END AS action
    FROM (SELECT c_custkey + 100 AS k, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'Customer#' || lpad(CAST(c_custkey + 100 AS VARCHAR), 9, '0') END AS name, sha1(c_mktsegment) AS digest FROM customer) m LEFT JOIN customer c ON c.c_custkey = m.k""")  # fmt: skip
def import_plan(spark: SparkSession, d: str) -> DataFrame:
    """A manifest against the table: what is new, clashes, differs or is there already."""
    c = table(spark, d, "customer")
    sha = lambda x: F.sha1(F.col(x).cast("binary"))
    own = F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") + 100).cast("string"), 9, "0"))
    m = c.select((F.col("c_custkey") + 100).alias("k"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(own).alias("name"), sha("c_mktsegment").alias("digest"))
    now = c.select("c_custkey", "c_name", sha("c_mktsegment").alias("now"))
    action = F.when(F.col("c_custkey").isNull(), "create").when(F.col("c_name") != F.col("name"), "identity_conflict").when(F.col("now") != F.col("digest"), "checksum_mismatch").otherwise("exists")
    return m.join(now, F.col("k") == F.col("c_custkey"), "left").select("k", action.alias("action"))


@query("q_unvalidated_samples", "SELECT DISTINCT s.sample_id FROM samples s LEFT JOIN labels l ON l.doc_id = s.sample_id WHERE l.doc_id IS NULL")
def unvalidated_samples(spark: SparkSession, d: str) -> DataFrame:
    return S.with_or_without(T.samples(spark, d), table(spark, d, "labels").withColumnRenamed("doc_id", "sample_id"), ["sample_id"], False).select("sample_id").distinct()


@query("q_mismatch_timeline", """
    SELECT m.event_id, max(CASE WHEN x.event_year - m.event_year = -2 THEN x.review_class END) AS y_minus_2, max(CASE WHEN x.event_year - m.event_year = -1 THEN x.review_class END) AS y_minus_1, max(CASE WHEN x.event_year - m.event_year = 1 THEN x.review_class END) AS y_plus_1,
           count(*) FILTER (x.event_year - m.event_year IN (-2, -1, 1)) AS neighbours FROM obs m LEFT JOIN obs x ON x.sample_id = m.sample_id AND x.event_year - m.event_year BETWEEN -2 AND 1 WHERE m.review_class = 'YEAR_MISMATCH' GROUP BY m.event_id""")  # fmt: skip
def mismatch_timeline(spark: SparkSession, d: str) -> DataFrame:
    """What the same point shows in the years around each mismatch."""
    e = T.events(spark, d)
    m = e.filter("review_class = 'YEAR_MISMATCH'").select("sample_id", "event_id", "event_year")
    around = J.by_offset(m, e.select("sample_id", "event_year", F.col("review_class").alias("seen")), "sample_id", "event_year", "event_year", {-2: "y_minus_2", -1: "y_minus_1", 1: "y_plus_1"})
    wide = around.groupBy("event_id").pivot("period", ["y_minus_2", "y_minus_1", "y_plus_1"]).agg(F.max("seen"))
    out = m.select("event_id").join(wide, "event_id", "left")
    return out.withColumn("neighbours", sum((F.col(c).isNotNull().cast("long") for c in ("y_minus_2", "y_minus_1", "y_plus_1")), F.lit(0).cast("long")))


@query("q_status_as_of", """
    SELECT b.record_id, a.value AS last_view FROM (SELECT * FROM status_log WHERE kind = 'click') b
    LEFT JOIN LATERAL (SELECT value FROM status_log v WHERE v.kind = 'view' AND v.subject = b.subject AND v.logged_at <= b.logged_at ORDER BY v.logged_at DESC LIMIT 1) a ON true""")  # fmt: skip
def status_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each click with the subject's last view at or before it."""
    log = T.status_log(spark, d)
    return J.as_of(log.filter("kind = 'click'").select("subject", "logged_at", "record_id"), log.filter("kind = 'view'"), "subject", "logged_at", "value", "last_view").select("record_id", "last_view")


@query("q_event_history", """
    SELECT e.event_id, s.driver, s.region, e.event_year, e.area_ha, lag(e.review_class) OVER w AS before, lead(e.review_class) OVER w AS after, CAST(lead(e.event_year) OVER w - e.event_year AS INTEGER) AS years_to_next
    FROM obs e JOIN samples s USING (sample_id) WINDOW w AS (PARTITION BY e.sample_id ORDER BY e.event_year)""")  # fmt: skip
def event_history(spark: SparkSession, d: str) -> DataFrame:
    """Every event with its sample and the classes of the events around it."""
    w = Window.partitionBy("sample_id").orderBy("event_year")
    e = T.events(spark, d).withColumns({"before": F.lag("review_class").over(w), "after": F.lead("review_class").over(w), "years_to_next": F.lead("event_year").over(w) - F.col("event_year")})
    return e.join(T.samples(spark, d).select("sample_id", "driver", "region"), "sample_id").select("event_id", "driver", "region", "event_year", "area_ha", "before", "after", "years_to_next")
