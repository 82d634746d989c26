"""Plans of migrations and backfills: what each row would become, gates that refuse a plan, and their application.

A plan is a table. Applying one inserts what is not there yet, so that applying
it twice changes nothing; a new plan over the result finds nothing to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.reconcile import insert_missing


def refuse(plan: DataFrame, faults: dict[str, Column]) -> None:
    """Raises ValueError with the count of each fault that rows of a plan have."""
    row = plan.agg(*(F.count(F.when(c, 1)).alias(name) for name, c in faults.items())).first()
    found = [f"{name}={row[name]}" for name in faults if row[name]]
    if found:
        raise ValueError("the plan is refused: " + ", ".join(found))


def reason_plan(reviews: DataFrame, events: DataFrame, reasons: DataFrame, revisions: DataFrame, codes: Column, mapping: Column, source: str = "LEGACY_MIGRATION") -> DataFrame:
    """A row for each review: proposed and existing codes, mapping_status, identity_status, revision_id and whether it exists.

    ``reviews`` has (event_id, review_status, updated_at, ...); ``codes`` and
    ``mapping`` say what a rejected review's text stands for. Reviews that have
    a revision from ``source`` are ALREADY_MIGRATED, others that are not
    rejected NOT_APPLICABLE; both propose nothing.
    """
    known = events.select(F.col("event_id").alias("__event")).distinct()
    had = revisions.filter(F.col("source") == source).select(F.col("event_id").alias("__migrated")).distinct()
    existing = reasons.groupBy(F.col("event_id").alias("__coded")).agg(F.sort_array(F.collect_set("code")).alias("existing_codes"))
    r = reviews.join(known, F.col("event_id") == F.col("__event"), "left").join(had, F.col("event_id") == F.col("__migrated"), "left").join(existing, F.col("event_id") == F.col("__coded"), "left")
    migrated, rejected = F.col("__migrated").isNotNull(), F.coalesce(F.col("review_status") == "REJECTED", F.lit(False))
    none = F.array().cast("array<string>")
    return r.select(
        "event_id", "review_status", F.when(~migrated & rejected, F.coalesce(codes, none)).otherwise(none).alias("proposed_codes"), F.coalesce("existing_codes", none).alias("existing_codes"),
        F.when(migrated, "ALREADY_MIGRATED").when(rejected, mapping).otherwise("NOT_APPLICABLE").alias("mapping_status"), F.when(F.col("__event").isNull(), "MISSING_EVENT").otherwise("OK").alias("identity_status"),
        F.sha1(F.concat_ws("|", F.lit(source), "event_id", F.col("updated_at").cast("string")).cast("binary")).alias("revision_id"), migrated.alias("revision_exists"), "updated_at",
    )


def reason_summary(plan: DataFrame) -> DataFrame:
    """One row: reviews, rejected ones, proposed codes, unmapped, ambiguous, identity errors and revisions to create."""
    n = lambda c: F.count(F.when(c, 1))
    status = F.col("mapping_status")
    return plan.agg(
        F.count(F.lit(1)).alias("reviews"), n(F.col("review_status") == "REJECTED").alias("rejected"), F.coalesce(F.sum(F.size("proposed_codes").cast("long")), F.lit(0)).alias("proposed"), n(status == "UNMAPPED").alias("unmapped"),
        n(status == "AMBIGUOUS").alias("ambiguous"), n(F.col("identity_status") != "OK").alias("identity_errors"), n(~F.col("revision_exists")).alias("new_revisions"),
    )


def apply_reasons(plan: DataFrame, reasons: DataFrame, revisions: DataFrame, source: str = "LEGACY_MIGRATION") -> tuple[DataFrame, DataFrame]:
    """(reasons, revisions) to insert. A plan with unmapped or ambiguous texts, or with reviews of unknown events, is refused as a whole."""
    status = F.col("mapping_status")
    refuse(plan, {"unmapped": status == "UNMAPPED", "ambiguous": status == "AMBIGUOUS", "identity_errors": F.col("identity_status") != "OK"})
    proposed = plan.select("event_id", F.explode("proposed_codes").alias("code"), F.col("updated_at").alias("created_at"))
    new = plan.filter(~F.col("revision_exists")).select("revision_id", "event_id", F.lit(source).alias("source"), F.col("proposed_codes").alias("codes"), F.col("updated_at").alias("created_at"))
    return insert_missing(reasons, proposed, ["event_id", "code"]), insert_missing(revisions, new, ["revision_id"])


def identifier(version: str, kind: str, *parts: str) -> Column:
    """A stable id of a backfilled row."""
    return F.sha1(F.concat_ws("|", F.lit(version), F.lit(kind), *(F.col(p).cast("string") for p in parts)).cast("binary"))


def backfill_plan(contexts: DataFrame, events: DataFrame, prepared: DataFrame, members: DataFrame, version: str) -> DataFrame:
    """A row for each event in each run it is in: ids of its prepared event and member, what is to be done with each, and with both: create, reuse, repair or conflict.

    ``contexts`` has (run, event_id), ``events`` (event_id, sample_id, year),
    ``prepared`` (prepared_id, run_id, sample_id, year, version), ``members``
    (member_id, prepared_id, run_id, event_id). A row that is there as expected is
    reused; one of the same id with other values is a conflict; where only one
    of the two is there, the pair is repaired. Contexts of unknown events are left out.
    """
    rows = contexts.distinct().join(events.select("event_id", "sample_id", "year"), "event_id")
    rows = rows.withColumns({"run_id": identifier(version, "run", "run"), "prepared_id": identifier(version, "event", "run", "event_id"), "member_id": identifier(version, "member", "run", "event_id")})
    old = prepared.select(F.col("prepared_id").alias("__p"), F.struct("run_id", "sample_id", "year", "version").alias("__had"))
    part = members.select(F.col("member_id").alias("__m"), F.struct("prepared_id", "run_id", "event_id").alias("__in"))
    met = rows.join(old, F.col("prepared_id") == F.col("__p"), "left").join(part, F.col("member_id") == F.col("__m"), "left")
    as_wanted = lambda c, *names: F.struct(*names, *([F.lit(version).alias("version")] if c == "__had" else [])).eqNullSafe(F.col(c))
    event = F.when(F.col("__p").isNull(), "create").when(as_wanted("__had", "run_id", "sample_id", "year"), "reuse").otherwise("conflict")
    member = F.when(F.col("__m").isNull(), "create").when(as_wanted("__in", "prepared_id", "run_id", "event_id"), "reuse").otherwise("conflict")
    planned = met.withColumns({"event_action": event, "member_action": member})
    a, b = F.col("event_action"), F.col("member_action")
    action = F.when((a == "conflict") | (b == "conflict"), "conflict").when(a == b, a).otherwise("repair")
    return planned.select("run", "event_id", "sample_id", "year", "run_id", "prepared_id", "member_id", "event_action", "member_action", action.alias("action"))


def apply_backfill(plan: DataFrame, prepared: DataFrame, members: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(prepared, members) to insert; a plan with a conflict is refused as a whole."""
    refuse(plan, {"conflicts": F.col("action") == "conflict"})
    events = plan.filter("event_action = 'create'").select("prepared_id", "run_id", "sample_id", "year", F.lit(version).alias("version"))
    parts = plan.filter("member_action = 'create'").select("member_id", "prepared_id", "run_id", "event_id")
    return insert_missing(prepared, events, ["prepared_id"]), insert_missing(members, parts, ["member_id"])


def merged_plan(plans: dict[str, DataFrame]) -> DataFrame:
    """One table of operations of several entities: entity, key, action, status, safe. ``plans`` have (key, action, status); an operation is safe unless it conflicts, is only reported, or keeps."""
    out = None
    for entity, plan in plans.items():
        safe = ~F.col("status").isin("conflict", "report-only") & (F.col("action") != "keep")
        rows = plan.select(F.lit(entity).alias("entity"), F.col("key").cast("string").alias("key"), "action", "status", F.coalesce(safe, F.lit(False)).alias("safe"))
        out = rows if out is None else out.unionByName(rows)
    return out


def safe_operations(operations: DataFrame, entities: list[str] | None = None) -> DataFrame:
    """The operations that may be applied: safe ones of the entities asked for, of those keys of an entity with no operation in conflict."""
    wanted = operations if entities is None else operations.filter(F.col("entity").isin(*entities))
    bad = operations.filter("status = 'conflict'").select(F.col("entity").alias("__e"), F.col("key").alias("__k")).distinct()
    return wanted.filter("safe").join(bad, (F.col("entity") == F.col("__e")) & (F.col("key") == F.col("__k")), "left_anti")


def plan_totals(operations: DataFrame) -> DataFrame:
    """Per entity: operations, safe ones, conflicts and those only reported."""
    n = lambda c: F.count(F.when(c, 1))
    return operations.groupBy("entity").agg(F.count(F.lit(1)).alias("operations"), n(F.col("safe")).alias("safe"), n(F.col("status") == "conflict").alias("conflicts"), n(F.col("status") == "report-only").alias("report_only"))
