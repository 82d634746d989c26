"""Queries that plan: quotas over seasons and periods, batches with reasons, candidate pools, bundle parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.operators import joins as J
from fieldlens.operators import planning as P
from fieldlens.plans.tables import table
from fieldlens.registry import query
from fieldlens.sources import standins as T

#: Valid scenes wanted and scenes checked at most, by season; the latter by period too.
TARGETS = {"spring": 2, "early_summer": 3, "summer": 3, "autumn": 2}
CAPS = {("PRE", "spring"): 5, ("POST", "spring"): 5, ("PRE", "early_summer"): 8, ("POST", "early_summer"): 7, ("PRE", "summer"): 7, ("POST", "summer"): 8, ("PRE", "autumn"): 5, ("POST", "autumn"): 5}

GRID_SQL = f"""
    rel AS (SELECT sample_id, event_id, event_year, period, event_year + step AS year FROM obs, (VALUES ('PRE', -1), ('POST', 1)) AS p(period, step)),
    seen AS (SELECT sample_id, scene_id, day, quantity >= 10 AS checked, NOT excluded AND cloud <= 0.06 AS valid,
                    CASE WHEN strftime(day, '%m-%d') BETWEEN '04-15' AND '05-31' THEN 'spring' WHEN strftime(day, '%m-%d') BETWEEN '06-01' AND '06-30' THEN 'early_summer'
                         WHEN strftime(day, '%m-%d') BETWEEN '07-01' AND '07-15' THEN 'summer' WHEN strftime(day, '%m-%d') BETWEEN '08-01' AND '10-15' THEN 'autumn' END AS season FROM scenes),
    met AS (SELECT r.event_id, r.period, s.* FROM rel r JOIN seen s ON s.sample_id = r.sample_id AND year(s.day) = r.year WHERE season IS NOT NULL),
    qc AS (SELECT event_id, period, season, count(DISTINCT scene_id) AS qc FROM met WHERE checked GROUP BY ALL),
    days AS (SELECT event_id, period, day, season, row_number() OVER (PARTITION BY event_id, period ORDER BY day) AS i FROM (SELECT DISTINCT event_id, period, day, season FROM met WHERE valid)),
    fold AS (SELECT event_id, period, i, CAST('1900-01-01' AS DATE) AS last, 0 AS spring, 0 AS early_summer, 0 AS summer, 0 AS autumn FROM (SELECT DISTINCT event_id, period, 0 AS i FROM days)
             UNION ALL SELECT event_id, period, i, CASE WHEN take THEN day ELSE last END, spring + CAST(take AND season = 'spring' AS INTEGER), early_summer + CAST(take AND season = 'early_summer' AS INTEGER), summer + CAST(take AND season = 'summer' AS INTEGER), autumn + CAST(take AND season = 'autumn' AS INTEGER)
             FROM (SELECT f.event_id, f.period, d.i, d.day, d.season, f.last, f.spring, f.early_summer, f.summer, f.autumn,
                          date_diff('day', f.last, d.day) >= 10 AND CASE d.season WHEN 'spring' THEN f.spring < 2 WHEN 'early_summer' THEN f.early_summer < 3 WHEN 'summer' THEN f.summer < 3 ELSE f.autumn < 2 END AS take
                   FROM fold f JOIN days d ON d.event_id = f.event_id AND d.period = f.period AND d.i = f.i + 1)),
    done AS (SELECT event_id, period, unnest([{{'season': 'spring', 'n': spring}}, {{'season': 'early_summer', 'n': early_summer}}, {{'season': 'summer', 'n': summer}}, {{'season': 'autumn', 'n': autumn}}], recursive := true) FROM (SELECT * FROM fold QUALIFY i = max(i) OVER (PARTITION BY event_id, period))),
    goal AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{s}', {TARGETS[s]}, {n})" for (p, s), n in CAPS.items())}) AS g(period, season, target_valid, max_qc_scenes)),
    held AS (SELECT e.sample_id, e.event_id, e.event_year, g.period, g.season, CAST(coalesce(d.n, 0) AS INTEGER) AS valid_count, g.target_valid, CAST(coalesce(q.qc, 0) AS INTEGER) AS qc_checked_count, g.max_qc_scenes
             FROM obs e CROSS JOIN goal g LEFT JOIN done d ON d.event_id = e.event_id AND d.period = g.period AND d.season = g.season LEFT JOIN qc q ON q.event_id = e.event_id AND q.period = g.period AND q.season = g.season),
    grid AS (SELECT sample_id, event_id, event_year, period, season, valid_count, target_valid, greatest(target_valid - valid_count, 0) AS deficit, qc_checked_count, max_qc_scenes,
                    CASE WHEN valid_count >= target_valid THEN 'target_reached' WHEN qc_checked_count >= max_qc_scenes THEN 'qc_cap_reached' END AS stop_reason FROM held)"""


def scenes(spark: SparkSession, d: str) -> DataFrame:
    s = T.scenes(spark, d)
    return s.select("sample_id", "scene_id", F.col("day").alias("at"), (F.col("quantity") >= 10).alias("checked"), (~F.col("excluded") & (F.col("cloud") <= 0.06)).alias("valid"))


@query("q_quota_grid", f"WITH RECURSIVE {GRID_SQL} SELECT * FROM grid")
def quota_grid(spark: SparkSession, d: str) -> DataFrame:
    """What each event has and lacks by period and season; one scene may fill targets of two events."""
    return P.quota_grid(T.events(spark, d).select("sample_id", "event_id", "event_year"), scenes(spark, d), TARGETS, CAPS, 10)


@query("q_batch_plan", f"""
    WITH RECURSIVE {GRID_SQL}, n AS (SELECT sample_id, count(*) AS event_count FROM obs GROUP BY sample_id),
    g AS (SELECT sample_id, sum(valid_count) AS v, sum(target_valid) AS t, sum(qc_checked_count) AS q, sum(max_qc_scenes) AS m, bool_and(coalesce(stop_reason = 'target_reached', false)) AS whole, bool_and(stop_reason IS NOT NULL) AS stopped FROM grid GROUP BY sample_id),
    r AS (SELECT s.sample_id, CASE WHEN s.balance < 0 THEN 'too_old' WHEN s.sample_id % 7 = 0 THEN 'has_manual_validation' WHEN s.sample_id IN (SELECT sample_id FROM scenes WHERE sample_id % 3 = 0) THEN 'already_has_downloads' WHEN n.event_count IS NULL THEN 'no_sample_events' END AS skip_reason, n.event_count, g.* EXCLUDE (sample_id)
          FROM samples s LEFT JOIN n ON n.sample_id = s.sample_id LEFT JOIN g ON g.sample_id = s.sample_id)
    SELECT sample_id, skip_reason, CASE WHEN skip_reason IS NULL THEN event_count END AS event_count, CASE WHEN skip_reason IS NULL THEN v END AS valid_count, CASE WHEN skip_reason IS NULL THEN t END AS target_valid, CASE WHEN skip_reason IS NULL THEN q END AS qc_checked_count,
           CASE WHEN skip_reason IS NULL THEN m END AS max_qc_scenes, CASE WHEN skip_reason IS NULL THEN greatest(t - v, 0) END AS deficit, CASE WHEN skip_reason IS NULL THEN CASE WHEN whole THEN 'target_reached' WHEN stopped THEN 'qc_cap_reached' END END AS stop_reason FROM r""")  # fmt: skip
def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every sample's place in the next batch, or why it is skipped. Every third sample's scenes count as downloaded before."""
    events = T.events(spark, d).select("sample_id", "event_id", "event_year")
    s = scenes(spark, d)
    samples = T.samples(spark, d).select("sample_id", (F.col("balance") < 0).alias("too_old"), (F.col("sample_id") % 7 == 0).alias("validated"))
    return P.batch_plan(samples, events, s.filter("sample_id % 3 = 0"), P.quota_grid(events, s, TARGETS, CAPS, 10), empty_only=True)


@query("q_candidate_pool")
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    """Samples as candidates, dealt by region; those within 900 km of an accepted one are passed over. Held against a sequential version in tests."""
    c = T.samples(spark, d).select(F.col("sample_id").alias("id"), F.col("region").alias("tile"), F.col("balance").alias("score"), "lat", "lon")

    def near(few: DataFrame, many: DataFrame) -> DataFrame:
        return J.within_distance(many.select("id", "lat", "lon"), few.select("id", "lat", "lon"), 900_000).select(F.col("b_id").alias("a"), F.col("a_id").alias("b"))

    return P.deal_candidates(c, near, 20).select("id", "tile", "score", "decision", "turn")


@query("q_zip_parts", f"""
    WITH RECURSIVE f AS (SELECT doc_id, coalesce(greatest(n_chars, 0), 0) * 100 AS size, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE doc_id IS NOT NULL),
    g AS (SELECT doc_id, size, i, 0 AS part, size AS used FROM f WHERE i = 1
          UNION ALL SELECT f.doc_id, f.size, f.i, CASE WHEN g.used + f.size > {P.payload_limit(4)} THEN g.part + 1 ELSE g.part END, CASE WHEN g.used + f.size > {P.payload_limit(4)} THEN f.size ELSE g.used + f.size END FROM g JOIN f ON f.i = g.i + 1)
    SELECT CAST(part AS INTEGER) AS part, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, sum(size) > {P.payload_limit(4)} AS oversized FROM g GROUP BY part""")  # fmt: skip
def zip_parts(spark: SparkSession, d: str) -> DataFrame:
    """All files as one list in order, in bundle parts of 4 MiB less what manifests and headers take."""
    files = table(spark, d, "documents").filter("doc_id is not null").select(F.lit(0).alias("bundle"), "doc_id", (F.coalesce(F.greatest("n_chars", F.lit(0)), F.lit(0)) * 100).alias("size"))
    parts = P.next_fit(files, "bundle", ["doc_id"], "size", P.payload_limit(4))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).withColumn("oversized", F.col("bytes") > P.payload_limit(4))
