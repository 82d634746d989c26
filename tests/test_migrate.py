"""Plans of migrations: states, gates, and that applying twice changes nothing."""

import pytest
from pyspark.sql import functions as F

from fieldlens.operators import migrate as M

REASONS, REVISIONS = "event_id string, code string, created_at int", "revision_id string, event_id string, source string, codes array<string>, created_at int"


def tables(spark, rows):
    reviews = spark.createDataFrame(rows, "event_id string, review_status string, text string, updated_at int")
    codes = F.when(F.col("text").isin("small", "late"), F.array(F.upper("text"))).when(F.col("text") == "both", F.array(F.lit("SMALL"), F.lit("LATE")))
    mapping = F.when(F.col("text") == "unclear", "AMBIGUOUS").when(codes.isNull(), "UNMAPPED").otherwise("MAPPED")
    return reviews, codes, mapping


def test_reason_plan_applied_twice(spark):
    reviews, codes, mapping = tables(spark, [("a", "REJECTED", "small", 1), ("b", "REJECTED", "both", 2), ("c", "VALID", "odd", 3), ("d", "REJECTED", "odd", 4), ("e", None, None, 5)])
    events = reviews.select("event_id")
    reasons = spark.createDataFrame([("b", "LATE", 0)], REASONS)
    revisions = spark.createDataFrame([("r", "d", "LEGACY_MIGRATION", ["X"], 0), ("s", "a", "MANUAL", ["X"], 0)], REVISIONS)
    plan = M.reason_plan(reviews, events, reasons, revisions, codes, mapping)
    got = {r["event_id"]: (r["proposed_codes"], r["existing_codes"], r["mapping_status"], r["revision_exists"]) for r in plan.collect()}
    assert got == {"a": (["SMALL"], [], "MAPPED", False), "b": (["SMALL", "LATE"], ["LATE"], "MAPPED", False), "c": ([], [], "NOT_APPLICABLE", False), "d": ([], [], "ALREADY_MIGRATED", True), "e": ([], [], "NOT_APPLICABLE", False)}
    new_reasons, new_revisions = M.apply_reasons(plan, reasons, revisions)
    assert sorted((r["event_id"], r["code"]) for r in new_reasons.collect()) == [("a", "SMALL"), ("b", "SMALL")]
    assert sorted(r["event_id"] for r in new_revisions.collect()) == ["a", "b", "c", "e"]
    reasons, revisions = reasons.unionByName(new_reasons), revisions.unionByName(new_revisions)
    again = M.reason_plan(reviews, events, reasons, revisions, codes, mapping)
    assert M.reason_summary(again).first()["new_revisions"] == 0
    assert [df.count() for df in M.apply_reasons(again, reasons, revisions)] == [0, 0]


def test_reason_plan_is_refused(spark):
    reviews, codes, mapping = tables(spark, [("a", "REJECTED", "odd", 1), ("b", "REJECTED", "unclear", 1), ("c", "VALID", None, 1)])
    reasons, revisions = spark.createDataFrame([], REASONS), spark.createDataFrame([], REVISIONS)
    plan = M.reason_plan(reviews, reviews.filter("event_id <> 'c'").select("event_id"), reasons, revisions, codes, mapping)
    with pytest.raises(ValueError, match="unmapped=1, ambiguous=1, identity_errors=1"):
        M.apply_reasons(plan, reasons, revisions)


def test_backfill_creates_repairs_and_then_reuses(spark):
    contexts = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a"), ("r2", "a"), ("r2", "gone")], "run string, event_id string")
    events = spark.createDataFrame([("a", 1, 2001), ("b", 2, 2002)], "event_id string, sample_id long, year int")
    prepared = spark.createDataFrame([], "prepared_id string, run_id string, sample_id long, year int, version string")
    members = spark.createDataFrame([], "member_id string, prepared_id string, run_id string, event_id string")
    plan = M.backfill_plan(contexts, events, prepared, members, "v1")
    assert sorted((r["run"], r["event_id"], r["action"]) for r in plan.collect()) == [("r1", "a", "create"), ("r1", "b", "create"), ("r2", "a", "create")]
    new_prepared, new_members = M.apply_backfill(plan, prepared, members, "v1")
    lost = new_members.filter("event_id <> 'b'")
    plan = M.backfill_plan(contexts, events, new_prepared, lost, "v1")
    assert sorted(r["action"] for r in plan.collect()) == ["repair", "reuse", "reuse"]
    more = M.apply_backfill(plan, new_prepared, lost, "v1")
    assert [df.count() for df in more] == [0, 1]
    plan = M.backfill_plan(contexts, events, new_prepared, lost.unionByName(more[1]), "v1")
    assert {r["action"] for r in plan.collect()} == {"reuse"} and [df.count() for df in M.apply_backfill(plan, new_prepared, new_members, "v1")] == [0, 0]
    moved = events.withColumn("year", F.col("year") + 1)
    plan = M.backfill_plan(contexts, moved, new_prepared, new_members, "v1")
    with pytest.raises(ValueError, match="conflicts=3"):
        M.apply_backfill(plan, new_prepared, new_members, "v1")


def test_merged_plans_and_their_safe_part(spark):
    samples = spark.createDataFrame([(1, "insert", "new"), (2, "update", "conflict"), (2, "fill", "new"), (3, "keep", "same")], "key long, action string, status string")
    notes = spark.createDataFrame([("2", "append", "new"), ("9", "append", "report-only"), ("8", "append", None)], "key string, action string, status string")
    operations = M.merged_plan({"sample": samples, "note": notes})
    assert {r["entity"]: tuple(r)[1:] for r in M.plan_totals(operations).collect()} == {"sample": (4, 2, 1, 0), "note": (3, 1, 0, 1)}
    found = lambda *e: sorted((r["entity"], r["key"]) for r in M.safe_operations(operations, *e).collect())
    assert found() == [("note", "2"), ("sample", "1")] and found(["note"]) == [("note", "2")]
