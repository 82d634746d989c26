"""Queries over plans of migrations and backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.operators import migrate as M
from fieldlens.registry import query
from fieldlens.sources import standins as T

#: Classes whose review has a code; others stay unmapped.
CODED = ("YEAR_MISMATCH", "EVENT_TOO_SMALL")


def reviews_plan(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    reviews = e.select("event_id", "review_status", "review_class", F.col("event_year").alias("updated_at"))
    known, done = e.filter("sample_id % 31 <> 0").select("event_id"), e.filter("event_year = 1993").select("event_id", F.lit("LEGACY_MIGRATION").alias("source"))
    reasons = e.filter("event_year = 1995 and review_class = 'YEAR_MISMATCH'").select("event_id", F.lit("YEAR_MISMATCH").alias("code"))
    coded = F.col("review_class").isin(*CODED)
    return M.reason_plan(reviews, known, reasons, done, F.when(coded, F.array("review_class")), F.when(coded, "MAPPED").otherwise("UNMAPPED"))


PLAN = """plan AS (SELECT event_id, review_status, CASE WHEN event_year <> 1993 AND review_status = 'REJECTED' AND review_class IN ('YEAR_MISMATCH', 'EVENT_TOO_SMALL') THEN review_class ELSE '' END AS proposed,
        CASE WHEN event_year = 1995 AND review_class = 'YEAR_MISMATCH' THEN 'YEAR_MISMATCH' ELSE '' END AS existing, CASE WHEN event_year = 1993 THEN 'ALREADY_MIGRATED' WHEN review_status <> 'REJECTED' THEN 'NOT_APPLICABLE' WHEN review_class IN ('YEAR_MISMATCH', 'EVENT_TOO_SMALL') THEN 'MAPPED' ELSE 'UNMAPPED' END AS mapping_status,
        CASE WHEN sample_id % 31 = 0 THEN 'MISSING_EVENT' ELSE 'OK' END AS identity_status, event_year = 1993 AS revision_exists FROM obs)"""


@query("q_reason_plan", f"WITH {PLAN} SELECT * FROM plan")
def reason_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a migration of old reasons would do with each review."""
    joined = lambda c: F.concat_ws("|", c)
    return reviews_plan(spark, d).select("event_id", "review_status", joined("proposed_codes").alias("proposed"), joined("existing_codes").alias("existing"), "mapping_status", "identity_status", "revision_exists")


@query("q_reason_plan_summary", f"""
    WITH {PLAN} SELECT count(*) AS reviews, count(*) FILTER (review_status = 'REJECTED') AS rejected, count(*) FILTER (proposed <> '') AS proposed, count(*) FILTER (mapping_status = 'UNMAPPED') AS unmapped, count(*) FILTER (mapping_status = 'AMBIGUOUS') AS ambiguous,
    count(*) FILTER (identity_status <> 'OK') AS identity_errors, count(*) FILTER (NOT revision_exists) AS new_revisions FROM plan""")  # fmt: skip
def reason_plan_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.reason_summary(reviews_plan(spark, d))


@query("q_backfill_plan", """
    SELECT driver AS run, event_id, obs.sample_id, event_year AS year, CASE WHEN event_year = 1994 THEN CASE WHEN obs.sample_id % 7 = 0 THEN 'conflict' ELSE 'reuse' END ELSE 'create' END AS event_action, CASE WHEN event_year = 1994 AND obs.sample_id % 2 = 0 THEN 'reuse' ELSE 'create' END AS member_action,
           CASE WHEN event_year <> 1994 THEN 'create' WHEN obs.sample_id % 7 = 0 THEN 'conflict' WHEN obs.sample_id % 2 = 0 THEN 'reuse' ELSE 'repair' END AS action FROM obs JOIN samples ON samples.sample_id = obs.sample_id""")  # fmt: skip
def backfill_plan(spark: SparkSession, d: str) -> DataFrame:
    """Events by the segment they came with, against those of 1994 that an earlier backfill left, a part of them changed since."""
    events = T.events(spark, d).select("event_id", "sample_id", F.col("event_year").alias("year"))
    contexts = events.join(T.samples(spark, d).select("sample_id", F.col("driver").alias("run")), "sample_id").select("run", "event_id")
    none = spark.createDataFrame([], "prepared_id string, run_id string, sample_id long, year int, version string"), spark.createDataFrame([], "member_id string, prepared_id string, run_id string, event_id string")
    first = M.backfill_plan(contexts, events.filter("year = 1994"), *none, "v1")
    prepared, members = M.apply_backfill(first, *none, "v1")
    prepared = prepared.withColumn("year", F.when(F.col("sample_id") % 7 == 0, F.col("year") + 1).otherwise(F.col("year")))
    kept = first.filter("sample_id % 2 = 0").select("member_id")
    plan = M.backfill_plan(contexts, events, prepared, members.join(kept, "member_id", "left_semi"), "v1")
    return plan.select("run", "event_id", "sample_id", "year", "event_action", "member_action", "action")
