"""Queries that import, merge and migrate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.operators import evaluation as E
from fieldlens.operators import reconcile as R
from fieldlens.operators import select as S
from fieldlens.plans.tables import table
from fieldlens.registry import query
from fieldlens.sources import standins as T


@query("q_import_outcomes", """
    WITH i AS (SELECT l_orderkey AS k, l_linenumber, l_shipdate, l_extendedprice FROM lineitem WHERE l_linenumber <= 2), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_shipdate, l_extendedprice) AS nth FROM i)
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN nth > 1 THEN 'DUPLICATE_IN_BATCH' WHEN o.o_orderkey IS NOT NULL THEN 'EXISTS' ELSE 'NEW' END AS outcome FROM n LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) o ON o.o_orderkey = n.k) GROUP BY outcome""")  # fmt: skip
def import_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A batch with repeated keys against a table that has some of them."""
    batch = table(spark, d, "lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_shipdate", "l_extendedprice")
    have = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"))
    return R.import_rows(batch, have, ["k"], [F.col("l_linenumber"), F.col("l_shipdate"), F.col("l_extendedprice")]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("q_import_rejects", """
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN length(text) < 100 THEN 'short' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason""")  # fmt: skip
def import_rejects(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n = F.length("text")
    _, bad = R.split_valid(docs, {"empty": F.col("text").isNull() | (n == 0), "short": n < 100, "language": ~F.col("lang").isin("en", "de", "fr")})
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


SYNC_SQL = """a AS (SELECT sample_id, event_year, pixels FROM obs WHERE event_year <= 2000 AND sample_id % 5 <> 0), b AS (SELECT sample_id, event_year, CASE WHEN sample_id % 7 = 0 THEN pixels + 1 ELSE pixels END AS pixels FROM obs WHERE event_year >= 1996)"""


def sync_plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = T.events(spark, d).select("sample_id", "event_year", "pixels")
    a = e.filter("event_year <= 2000 and sample_id % 5 <> 0")
    b = e.filter("event_year >= 1996").withColumn("pixels", F.when(F.col("sample_id") % 7 == 0, F.col("pixels") + 1).otherwise(F.col("pixels")))
    return a, b, R.sync(a, b, ["sample_id", "event_year"], ["pixels"])


@query("q_event_sync", f"""
    WITH {SYNC_SQL} SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.event_year, b.event_year) AS event_year, CASE WHEN a.sample_id IS NULL THEN 'INSERT' WHEN b.sample_id IS NULL THEN 'DELETE' WHEN a.pixels = b.pixels THEN 'KEEP' ELSE 'UPDATE' END AS action, b.pixels AS pixels
    FROM a FULL OUTER JOIN b ON a.sample_id = b.sample_id AND a.event_year = b.event_year""")  # fmt: skip
def event_sync(spark: SparkSession, d: str) -> DataFrame:
    """What to insert, update, delete and keep."""
    return sync_plan(spark, d)[2]


@query("q_event_sync_applied", f"WITH {SYNC_SQL} SELECT sample_id, event_year, pixels FROM b")
def event_sync_applied(spark: SparkSession, d: str) -> DataFrame:
    """Applying the operations gives the wanted table."""
    a, _, plan = sync_plan(spark, d)
    keys = ["sample_id", "event_year"]
    kept = a.join(plan.filter("action = 'DELETE'").select(*keys), keys, "left_anti")
    return R.upsert(kept, plan.filter("action in ('INSERT', 'UPDATE')").drop("action"), keys)


@query("q_label_insert", """
    WITH l AS (SELECT event_id, 'a' AS source, 1 AS version, sha1(event_id || '|' || label_a) AS fingerprint FROM obs), h AS (SELECT * FROM l WHERE event_id LIKE '%-1996' OR event_id LIKE '%-1997')
    SELECT event_id, source, version, fingerprint FROM l WHERE (event_id, source, version, fingerprint) NOT IN (SELECT (event_id, source, version, fingerprint) FROM h)""")  # fmt: skip
def label_insert(spark: SparkSession, d: str) -> DataFrame:
    """Labels still to be written, by their four-part key."""
    labels = T.events(spark, d).select("event_id", F.lit("a").alias("source"), F.lit(1).alias("version"), F.sha1(F.concat_ws("|", "event_id", "label_a").cast("binary")).alias("fingerprint"))
    have = labels.filter(F.col("event_id").like("%-1996") | F.col("event_id").like("%-1997"))
    return R.insert_missing(have, labels, ["event_id", "source", "version", "fingerprint"])


@query("q_metadata_merge", """
    SELECT k, CASE WHEN trim(coalesce(b, '')) = '' OR trim(a) = trim(b) THEN 'keep' WHEN trim(coalesce(a, '')) = '' THEN 'fill' ELSE 'conflict' END AS action,
           CASE WHEN trim(coalesce(b, '')) = '' OR trim(a) = trim(b) THEN a WHEN trim(coalesce(a, '')) = '' THEN b ELSE a END AS value
    FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE ' ' END AS a, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'OTHER' ELSE c_mktsegment END AS b FROM customer)""")  # fmt: skip
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("k"), F.when(k % 3 == 1, F.col("c_mktsegment")).when(k % 3 == 2, " ").alias("a"), F.when(k % 4 == 0, "").when(k % 4 == 1, "OTHER").otherwise(F.col("c_mktsegment")).alias("b"))
    m = R.merge_text(F.col("a"), F.col("b"))
    return rows.select("k", m["action"].alias("action"), m["value"].alias("value"))


@query("q_tolerant_scan", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, CAST(NULL AS DOUBLE) AS area FROM region")
def tolerant_scan(spark: SparkSession, d: str) -> DataFrame:
    return R.schema_tolerant(table(spark, d, "region"), {"r_regionkey": "long", "r_name": "string", "area": "double"})


@query("q_candidate_states", """
    SELECT sample_id, CASE WHEN bool_or(review_class = 'OTHER_INVALID') THEN 'EXCLUDED' WHEN bool_or(review_status = 'VALID') THEN 'MATERIALIZED' ELSE 'OPEN' END AS state FROM obs GROUP BY sample_id""")  # fmt: skip
def candidate_states(spark: SparkSession, d: str) -> DataFrame:
    """The strongest state of each candidate's events."""
    state = F.when(F.col("review_class") == "OTHER_INVALID", "EXCLUDED").when(F.col("review_status") == "VALID", "MATERIALIZED").otherwise("OPEN")
    return R.exclusive_state(T.events(spark, d).withColumn("state", state), "sample_id", "state", ["EXCLUDED", "MATERIALIZED", "OPEN"])


@query("q_review_revisions", """
    SELECT subject, count(*) AS revisions, max(value) FILTER (nth = 1) AS current, max(value) FILTER (nth = 2) AS previous FROM (
        SELECT *, row_number() OVER (PARTITION BY subject ORDER BY logged_at DESC, record_id DESC) AS nth FROM status_log WHERE kind = 'purchase') GROUP BY subject""")  # fmt: skip
def review_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Current and previous state of an append-only history."""
    log = T.status_log(spark, d).filter("kind = 'purchase'")
    two = S.top_per_group(log, ["subject"], [F.desc("logged_at"), F.desc("record_id")], 2)
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("value")))
    n = log.groupBy("subject").agg(F.count(F.lit(1)).alias("revisions"))
    return two.groupBy("subject").agg(at(1).alias("current"), at(2).alias("previous")).join(n, "subject").select("subject", "revisions", "current", "previous")


@query("q_tile_actions", """
    WITH t AS (SELECT lpad(CAST(abs(CAST(floor(lat / 10) * 10 + 10 AS BIGINT)) AS VARCHAR), 2, '0') || CASE WHEN floor(lat / 10) * 10 + 10 >= 0 THEN 'N' ELSE 'S' END || '_' || lpad(CAST(abs(CAST(floor(lon / 10) * 10 AS BIGINT)) AS VARCHAR), 3, '0') || CASE WHEN floor(lon / 10) * 10 >= 0 THEN 'E' ELSE 'W' END AS tile, count(*) AS n FROM samples GROUP BY 1),
    g AS (SELECT tile, n, layer FROM t, (SELECT unnest(['lossyear', 'treecover']) AS layer)),
    h AS (SELECT DISTINCT tile, 'lossyear' AS layer FROM t WHERE n > 2)
    SELECT g.tile, g.layer, g.n AS samples, CASE WHEN h.tile IS NULL THEN 'would_download' ELSE 'cached' END AS action FROM g LEFT JOIN h USING (tile, layer)""")  # fmt: skip
def tile_actions(spark: SparkSession, d: str) -> DataFrame:
    """Grid of tiles and layers against what is stored."""
    from fieldlens.functions import geo

    t = T.samples(spark, d).groupBy(geo.tile_id(F.col("lat"), F.col("lon")).alias("tile")).agg(F.count(F.lit(1)).alias("samples"))
    grid = t.select("tile", "samples", F.explode(F.array(F.lit("lossyear"), F.lit("treecover"))).alias("layer"))
    have = t.filter("samples > 2").select("tile", F.lit("lossyear").alias("layer"), F.lit(True).alias("here"))
    return grid.join(have, ["tile", "layer"], "left").select("tile", "layer", "samples", F.when(F.col("here"), "cached").otherwise("would_download").alias("action"))


@query("q_preview_check", """
    WITH g AS (SELECT page_id, view FROM pages, (SELECT unnest(['rgb', 'nbr', 'ndvi']) AS view)), h AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'rgb' WHEN 1 THEN 'nbr' ELSE 'ndvi' END AS view, page_id % 5 = 0 AS lost FROM pages)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN h.page_id IS NULL THEN 'missing_db_preview' WHEN h.lost THEN 'missing_file' ELSE 'ok' END AS status FROM g LEFT JOIN h USING (page_id, view)) GROUP BY status""")  # fmt: skip
def preview_check(spark: SparkSession, d: str) -> DataFrame:
    """Expected views of every item against the stored ones."""
    p = table(spark, d, "pages").select("page_id")
    grid = p.select("page_id", F.explode(F.array(*(F.lit(v) for v in ("rgb", "nbr", "ndvi")))).alias("view"))
    have = p.select("page_id", F.element_at(F.array(F.lit("rgb"), F.lit("nbr"), F.lit("ndvi")), (F.col("page_id") % 3 + 1).cast("int")).alias("view"), (F.col("page_id") % 5 == 0).alias("lost"))
    status = F.when(F.col("lost").isNull(), "missing_db_preview").when(F.col("lost"), "missing_file").otherwise("ok")
    return grid.join(have, ["page_id", "view"], "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("q_manual_history", "SELECT sample_id, count(*) AS events, string_agg(CAST(event_year AS VARCHAR), ',' ORDER BY event_year) AS years, round(sum(area_ha), 4) AS total_ha FROM obs GROUP BY sample_id")
def manual_history(spark: SparkSession, d: str) -> DataFrame:
    g = T.events(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("events"), F.sort_array(F.collect_list("event_year")).alias("y"), F.round(F.sum("area_ha"), 4).alias("total_ha"))
    return g.select("sample_id", "events", F.concat_ws(",", F.col("y").cast("array<string>")).alias("years"), "total_ha")


@query("q_target_year", """
    WITH t AS (SELECT sample_id, list(DISTINCT event_year + 1) FILTER (review_class = 'YEAR_MISMATCH') AS stated, list(DISTINCT event_year) AS years, list(DISTINCT event_year) FILTER (review_class = 'VALID_WILDFIRE') AS fires FROM obs GROUP BY sample_id)
    SELECT sample_id, CASE WHEN stated IS NOT NULL AND len(stated) = 1 AND list_contains(years, stated[1]) THEN 'STATED' WHEN stated IS NOT NULL AND len(stated) = 1 THEN 'STATED_NOT_A_CANDIDATE' WHEN stated IS NOT NULL THEN 'CONFLICTING' WHEN fires IS NOT NULL AND len(fires) = 1 THEN 'UNIQUE_FIRE' WHEN fires IS NOT NULL THEN 'SEVERAL_FIRES' ELSE 'NONE' END AS status FROM t""")  # fmt: skip
def target_year(spark: SparkSession, d: str) -> DataFrame:
    """Which year a point's reviews point to."""
    c, y = F.col("review_class"), F.col("event_year")
    g = T.events(spark, d).groupBy("sample_id").agg(F.collect_set(F.when(c == "YEAR_MISMATCH", y + 1)).alias("s"), F.collect_set(y).alias("y"), F.collect_set(F.when(c == "VALID_WILDFIRE", y)).alias("f"))
    n = F.size("s")
    status = F.when((n == 1) & F.exists("s", lambda v: F.array_contains(F.col("y"), v)), "STATED").when(n == 1, "STATED_NOT_A_CANDIDATE").when(n > 1, "CONFLICTING").when(F.size("f") == 1, "UNIQUE_FIRE").when(F.size("f") > 1, "SEVERAL_FIRES").otherwise("NONE")
    return g.select("sample_id", status.alias("status"))


@query("q_scene_nested", "SELECT sample_id, count(*) AS scenes, string_agg(scene_id || ':' || flag, ';' ORDER BY day, scene_id) AS listing FROM scenes GROUP BY sample_id")
def scene_nested(spark: SparkSession, d: str) -> DataFrame:
    """A sample's scenes as one nested, ordered list."""
    g = T.scenes(spark, d).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("day", "scene_id", "flag"))).alias("s"))
    return g.select("sample_id", F.size("s").cast("long").alias("scenes"), F.concat_ws(";", F.transform("s", lambda x: F.concat_ws(":", x["scene_id"], x["flag"]))).alias("listing"))


@query("q_merge_candidates", """
    WITH RECURSIVE e AS (SELECT a.sample_id, a.event_year AS x, b.event_year AS y FROM obs a JOIN obs b ON a.sample_id = b.sample_id AND b.event_year = a.event_year + 1 AND abs(a.area_ha - b.area_ha) <= 0.5 * greatest(a.area_ha, b.area_ha)),
    c AS (SELECT sample_id, event_year AS root, event_year AS at FROM obs o WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.sample_id = o.sample_id AND e.y = o.event_year) UNION ALL SELECT c.sample_id, c.root, e.y FROM c JOIN e ON e.sample_id = c.sample_id AND e.x = c.at)
    SELECT sample_id, CAST(root AS INTEGER) AS root, count(*) AS events FROM c GROUP BY ALL""")  # fmt: skip
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Chains of neighbouring years with areas that differ by at most half: a running count of breaks instead of a graph walk."""
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id").orderBy("event_year")
    e = T.events(spark, d).select("sample_id", "event_year", "area_ha")
    joined = (F.col("event_year") - F.lag("event_year").over(w) == 1) & (F.abs(F.col("area_ha") - F.lag("area_ha").over(w)) <= 0.5 * F.greatest(F.col("area_ha"), F.lag("area_ha").over(w)))
    runs = e.withColumn("break", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("break").over(w))
    return runs.groupBy("sample_id", "run").agg(F.min("event_year").alias("root"), F.count(F.lit(1)).alias("events")).drop("run")


@query("q_merge_simulation", """
    WITH p AS (SELECT a.review_status = 'VALID' AS va, b.review_status = 'VALID' AS vb, least(a.area_ha, b.area_ha) / greatest(a.area_ha, b.area_ha) <= 0.5 AS proposed,
                      (a.review_status = 'VALID') <> (b.review_status = 'VALID') AND (a.review_class IN ('YEAR_MISMATCH', 'EVENT_TOO_SMALL') OR b.review_class IN ('YEAR_MISMATCH', 'EVENT_TOO_SMALL')) AS tail
               FROM obs a JOIN obs b ON a.sample_id = b.sample_id AND b.event_year = a.event_year + 1 WHERE greatest(a.area_ha, b.area_ha) > 0),
    s AS (SELECT count(*) AS pairs, count(*) FILTER (proposed) AS proposed, count(*) FILTER (proposed AND tail) AS good, count(*) FILTER (proposed AND va AND vb) AS bad, count(*) FILTER (tail) AS tails FROM p),
    m AS (SELECT count(*) AS points, CAST(sum(n) AS BIGINT) AS events FROM (SELECT count(*) AS n FROM obs GROUP BY sample_id) WHERE n > 1)
    SELECT points AS multi_event_points, pairs AS adjacent_pairs, proposed AS proposed_merges, good AS good_merges, bad AS bad_merges, proposed - good - bad AS unresolved_merges,
           round(good / CAST(nullif(good + bad, 0) AS DOUBLE), 6) AS merge_precision_resolved, round(good / CAST(nullif(tails, 0) AS DOUBLE), 6) AS merge_recall_identifiable_tails,
           events AS physical_events_before, events - proposed AS event_groups_after_all_proposals, events - good AS event_groups_after_good_only FROM s, m""")  # fmt: skip
def merge_simulation(spark: SparkSession, d: str) -> DataFrame:
    """What merging events of neighbouring years by relative area would do. A point has one event a year here, so its pairs form paths, and the SQL needs no components."""
    return E.merge_simulation(T.events(spark, d), threshold=0.5)
