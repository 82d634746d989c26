"""Queries over studies of reviewed events: rankings of years by method, events relative to the selected year, all tables of a study."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.operators import evaluation as E
from fieldlens.operators import research as R
from fieldlens.plans.lineage import checkpoint_dir, materialize
from fieldlens.registry import query
from fieldlens.sources import standins as T
from fieldlens.sources import writers as W

#: Resamplings of an interval.
RUNS = 100


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Events with the scenes of their year: how many can be used, and how good they are."""
    s = T.scenes(spark, d).groupBy(F.col("sample_id").alias("__s"), F.year("day").alias("__y")).agg(F.count_if(F.col("cloud") < 0.05).alias("usable"), F.count_if("excluded").alias("excluded"), F.count(F.lit(1)).alias("scenes"))
    e = T.events(spark, d).join(s, (F.col("sample_id") == F.col("__s")) & (F.col("event_year") == F.col("__y")), "left")
    quality = 1.0 - 0.5 * (F.col("scenes") - F.col("usable")) / F.col("scenes") - 0.5 * F.col("excluded") / F.col("scenes")
    return e.select(*T.events(spark, d).columns, F.coalesce("usable", F.lit(0)).alias("usable"), F.coalesce(F.round(quality, 9), F.lit(1.0)).alias("quality"))


def _fraction(c: str) -> str:
    """SQL of a value's rank fraction in its point; the values are never null here."""
    return f"CASE WHEN count(DISTINCT {c}) OVER p <= 1 THEN 1.0::DOUBLE ELSE (dense_rank() OVER (PARTITION BY sample_id ORDER BY {c}) - 1) / CAST(count(DISTINCT {c}) OVER p - 1 AS DOUBLE) END"


RANKED = f"""
    sc AS (SELECT sample_id, year(day) AS y, count(*) FILTER (cloud < 0.05) AS usable, count(*) FILTER (excluded) AS excluded, count(*) AS n FROM scenes GROUP BY ALL),
    e0 AS (SELECT obs.*, coalesce(usable, 0) AS usable, coalesce(round(1.0::DOUBLE - 0.5::DOUBLE * (n - usable) / n - 0.5::DOUBLE * excluded / n, 9), 1.0) AS quality, (p_a + p_b) / 2 AS p, human_label IS NOT NULL AS is_target FROM obs LEFT JOIN sc ON sc.sample_id = obs.sample_id AND sc.y = obs.event_year),
    e AS (SELECT * FROM e0 QUALIFY count(*) OVER (PARTITION BY sample_id) >= 2 AND bool_or(is_target) OVER (PARTITION BY sample_id)),
    f AS (SELECT *, {_fraction("area_ha")} AS f1, {_fraction("p")} AS f2, {_fraction("usable")} AS f3, {_fraction("quality")} AS f4 FROM e WINDOW p AS (PARTITION BY sample_id)),
    m AS (SELECT *, unnest(['HISTORICAL_DOMINANT', 'MAX_HANSEN_AREA', 'MAX_MODEL_MEAN_P_WILDFIRE', 'HAND_BUILT_COMPOSITE']) AS method,
          unnest([CAST(dominant AS DOUBLE), round(area_ha, 9), round(p, 9), round(f1 * 0.45::DOUBLE + f2 * 0.30::DOUBLE + f3 * 0.15::DOUBLE + f4 * 0.10::DOUBLE, 9)]) AS score FROM f),
    r AS (SELECT *, row_number() OVER w AS rank, first(event_year) OVER w AS selected_year, first(area_ha) OVER w AS selected_area FROM m WINDOW w AS (PARTITION BY sample_id, method ORDER BY score DESC, area_ha DESC, event_year)),
    rel AS (SELECT *, event_year - selected_year AS delta_year, round(area_ha / selected_area, 6) AS relative_area FROM r)"""


@query("q_year_methods", f"""WITH {RANKED},
    pt AS (SELECT method, sample_id, min(rank) FILTER (is_target) AS tr, min(abs(event_year - selected_year)) FILTER (is_target) AS err FROM r GROUP BY ALL)
    SELECT method, count(*) AS eligible_points, round(avg(CAST(err = 0 AS INTEGER)), 6) AS hit_at_1, round(avg(CAST(tr <= 2 AS INTEGER)), 6) AS hit_at_2, round(avg(1.0::DOUBLE / tr), 6) AS mean_reciprocal_rank, quantile_cont(tr, 0.5) AS median_target_rank, round(avg(err), 6) AS mean_year_error FROM pt GROUP BY method""")  # fmt: skip
def year_methods(spark: SparkSession, d: str) -> DataFrame:
    """How well each method finds a valid year of a point."""
    return R.method_metrics(R.point_predictions(R.year_rankings(reviewed(spark, d))))


@query("q_method_relative", f"""WITH {RANKED}
    SELECT method, delta_year, count(*) AS events, count(*) AS points, {", ".join(f"round(avg(CAST({c} AS INTEGER)), 6) AS {n}" for n, c in (("valid_share", "review_class LIKE 'VALID@_%' ESCAPE '@'"), ("rejected_share", "review_class NOT LIKE 'VALID@_%' ESCAPE '@'"), ("year_mismatch_share", "review_class = 'YEAR_MISMATCH'"), ("event_too_small_share", "review_class = 'EVENT_TOO_SMALL'"), ("logging_share", "review_class = 'VALID_LOGGING'"), ("wildfire_share", "review_class = 'VALID_WILDFIRE'"), ("model_disagreement_share", "label_a <> label_b")))},
           round(quantile_cont(relative_area, 0.5), 6) AS median_relative_area, round(avg(p_a), 6) AS mean_p_a, round(avg(p_b), 6) AS mean_p_b FROM rel GROUP BY method, delta_year""")  # fmt: skip
def method_relative(spark: SparkSession, d: str) -> DataFrame:
    """Events by their years from the one that a method selects."""
    return R.relative_summary(R.relative_events(R.year_rankings(reviewed(spark, d))))


@query("q_outcome_intervals", f"""WITH {RANKED},
    s AS (SELECT method, CASE WHEN delta_year = 0 THEN 'delta_0' ELSE 'abs_delta_1' END AS stratum, sample_id, count(*) AS n, count(*) FILTER (review_class LIKE 'VALID@_%' ESCAPE '@') AS h0, count(*) FILTER (review_class = 'YEAR_MISMATCH') AS h1, count(*) FILTER (review_class = 'EVENT_TOO_SMALL') AS h2 FROM rel WHERE abs(delta_year) <= 1 GROUP BY ALL),
    w AS (SELECT method, stratum, count(*) AS points, sum(n) AS events, sum(h0) AS h0, sum(h1) AS h1, sum(h2) AS h2 FROM s GROUP BY ALL)
    SELECT method, stratum, CAST(events AS BIGINT) AS events, points, unnest(['VALID', 'YEAR_MISMATCH', 'EVENT_TOO_SMALL']) AS outcome, round(unnest([h0 / events, h1 / events, h2 / events]), 6) AS estimate FROM w""")  # fmt: skip
def outcome_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Shares of outcomes at and beside the selected year. The intervals are drawn by another numbering of points than SQL has, so they are left to the tests."""
    return R.outcome_intervals(R.relative_events(R.year_rankings(reviewed(spark, d))), RUNS).drop("ci_low", "ci_high")


def untrained(spark: SparkSession, d: str) -> DataFrame:
    """Points that the frozen thresholds were not chosen on are all others."""
    return T.samples(spark, d).filter("sample_id % 10 = 0").select("sample_id")


THRESHOLDS = {"area_ha": 10.0, "pixels": 1.0, "share": 0.1}
HITS = [(f, f"'{f} <= {t}'", t, f"{f} <= {t}") for f, t in THRESHOLDS.items()] + [("combined_or", "'ANY_FIXED_THRESHOLD'", "CAST(NULL AS DOUBLE)", " OR ".join(f"{f} <= {t}" for f, t in THRESHOLDS.items()))]


@query("q_frozen_rules", f"""
    WITH v AS (SELECT * FROM obs WHERE sample_id % 10 <> 0), u AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {n} AS rule, CAST({t} AS DOUBLE) AS threshold, {c} AS hit, review_class = 'EVENT_TOO_SMALL' AS small, review_status = 'VALID' AS valid FROM v" for f, n, t, c in HITS)}),
    g AS (SELECT feature, rule, threshold, count(*) AS events, count(*) FILTER (hit IS NULL) AS missing_events, count(*) FILTER (small) AS event_too_small_events, count(*) FILTER (hit) AS predicted_small_events, count(*) FILTER (hit AND small) AS true_positive, count(*) FILTER (hit AND NOT small) AS false_positive,
          count(*) FILTER (NOT hit AND small) AS false_negative, count(*) FILTER (NOT hit AND NOT small) AS true_negative, count(*) FILTER (valid) AS valid_events, count(*) FILTER (hit AND valid) AS valid_events_lost FROM u GROUP BY ALL)
    SELECT *, round(true_positive / nullif(true_positive + false_positive, 0), 6) AS precision, round(true_positive / nullif(true_positive + false_negative, 0), 6) AS recall, round(true_negative / nullif(true_negative + false_positive, 0), 6) AS specificity,
           round(valid_events_lost / nullif(valid_events, 0), 6) AS valid_lost_rate, CASE WHEN true_positive > 0 THEN round(2.0::DOUBLE * true_positive / (2 * true_positive + false_positive + false_negative), 6) END AS f1 FROM g""")  # fmt: skip
def frozen_rules(spark: SparkSession, d: str) -> DataFrame:
    """Frozen thresholds of three measures of size, alone and joined by OR, on points they were not chosen on."""
    return R.fixed_rules(T.events(spark, d), untrained(spark, d), THRESHOLDS)


def full_study(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return R.study(reviewed(spark, d), untrained(spark, d), THRESHOLDS, ["area_ha", "pixels", "p_a", "p_b", "usable"], RUNS)


@query("q_study_summary", f"""WITH {RANKED},
    o AS (SELECT sample_id, count(*) AS n FROM obs GROUP BY sample_id), c AS (SELECT sample_id, min(selected_year) <> max(selected_year) AS differs FROM r GROUP BY sample_id)
    SELECT (SELECT count(*) FROM obs) AS reviewed_events, (SELECT count(*) FROM obs WHERE review_status = 'VALID') AS valid_events, (SELECT count(*) FROM obs WHERE review_status = 'REJECTED') AS rejected_events, (SELECT count(*) FROM o) AS reviewed_points, (SELECT count(*) FROM o WHERE n > 1) AS multi_event_points, (SELECT count(*) FROM c) AS evaluable_points, (SELECT count(*) FROM c WHERE differs) AS points_where_methods_differ""")  # fmt: skip
def study_summary(spark: SparkSession, d: str) -> DataFrame:
    """The head of a study without fitted models; its other tables are not begun."""
    e = materialize(reviewed(spark, d))
    return R.summary(e, R.point_predictions(R.year_rankings(e)), E.point_taxonomy(e))


@query("q_study_tables")
def study_tables(spark: SparkSession, d: str) -> DataFrame:
    """All tables of a study with fitted models, written with a manifest that is checked. Tables are held against loops in tests."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/exports/{uuid4().hex}"
    manifest = W.export_tables(full_study(spark, d), root)
    if not W.unlike_manifest(spark, root).isEmpty():
        raise ValueError("the export differs from its manifest")
    return manifest.select("name", "rows", "columns")
