"""Queries that count, summarise and measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.operators import aggregate as A
from fieldlens.operators import evaluation as E
from fieldlens.operators import select as S
from fieldlens.plans.tables import table
from fieldlens.registry import query
from fieldlens.sources import standins as T

METRICS_SQL = """
    count(*) AS n,
    round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy,
    round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_pos, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall_pos,
    round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS precision_neg, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS recall_neg"""
CELLS_SQL = """CAST(count(*) FILTER (t AND p) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT t AND p) AS DOUBLE) AS fp, CAST(count(*) FILTER (t AND NOT p) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT t AND NOT p) AS DOUBLE) AS tn"""


def metrics_sql(source: str, keys: str = "") -> str:
    by = f"GROUP BY {keys}" if keys else ""
    pre = f"{keys}, " if keys else ""
    return f"SELECT {pre}{METRICS_SQL.replace('count(*) AS n', 'CAST(any_value(n) AS BIGINT) AS n')} FROM (SELECT {pre}count(*) AS n, {CELLS_SQL} FROM ({source}) {by}) {'GROUP BY ALL' if False else ''}".replace("CAST(any_value(n) AS BIGINT) AS n", "n")


@query("q_point_taxonomy", """
    SELECT point_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM (
        SELECT CASE
            WHEN count(*) = 1 THEN 'SINGLE_HANSEN_EVENT'
            WHEN bool_or(review_class = 'VALID_LOGGING') AND bool_or(review_class = 'VALID_WILDFIRE') THEN 'TRUE_CLASS_CHANGE'
            WHEN count(*) FILTER (review_class = 'VALID_LOGGING') >= 2 OR count(*) FILTER (review_class = 'VALID_WILDFIRE') >= 2 THEN 'REPEATED_SAME_CLASS'
            WHEN bool_or(review_status = 'VALID') AND bool_or(review_class = 'YEAR_MISMATCH') THEN 'SINGLE_PHYSICAL_EVENT_WITH_TEMPORAL_TAILS'
            WHEN bool_or(review_status = 'VALID') AND bool_or(review_class = 'EVENT_TOO_SMALL') THEN 'DOMINANT_EVENT_WITH_SMALL_COMPONENTS' ELSE 'UNRESOLVED' END AS point_type
        FROM obs GROUP BY sample_id) GROUP BY point_type""")  # fmt: skip
def point_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return A.counts(E.point_taxonomy(T.events(spark, d)), ["point_type"])


@query("q_small_event_rules", """
    WITH c AS (SELECT review_class = 'EVENT_TOO_SMALL' AS small, unnest([{'feature': 'area_ha', 'value': area_ha}, {'feature': 'pixels', 'value': CAST(pixels AS DOUBLE)}, {'feature': 'share', 'value': share}], recursive := true) FROM obs WHERE review_status = 'VALID' OR review_class = 'EVENT_TOO_SMALL'),
    n AS (SELECT feature, value, count(*) FILTER (small) AS p, count(*) FILTER (NOT small) AS q FROM c GROUP BY ALL),
    t AS (SELECT feature, value, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER (PARTITION BY feature) AS BIGINT) AS all_p, CAST(sum(q) OVER (PARTITION BY feature) AS BIGINT) AS all_q FROM n WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS prec, tp / CAST(all_p AS DOUBLE) AS rec, 2 * tp / CAST(tp + fp + all_p AS DOUBLE) AS f1, tp + fp >= 5 AND tp / CAST(tp + fp AS DOUBLE) >= 0.7 AS fine FROM t)
    SELECT feature, CASE WHEN fine THEN 'candidate_rule_at_least_70_percent_precision' ELSE 'best_exploratory_f1_below_70_percent_precision' END AS recommendation_status, value AS threshold,
           round(prec, 6) AS precision, round(rec, 6) AS recall, tp + fp AS events_below, fp AS valid_events_below, all_p AS too_small_events, all_q AS valid_events
    FROM m QUALIFY row_number() OVER (PARTITION BY feature ORDER BY fine DESC, CASE WHEN fine THEN rec ELSE f1 END DESC, prec DESC, CASE WHEN fine THEN value ELSE -value END DESC) = 1""")  # fmt: skip
def small_event_rules(spark: SparkSession, d: str) -> DataFrame:
    """The recommended threshold below which an event is too small, for three measures of size."""
    return E.small_event_rules(T.events(spark, d), ["area_ha", "pixels", "share"])


@query("q_event_histogram", "SELECT sample_id, event_year, area_ha, pixels, round(share, 6) AS share, dominant FROM obs")
def event_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Area and pixels per sample and year, the year's share and the dominant year (ties to the earliest)."""
    return T.events(spark, d).select("sample_id", "event_year", "area_ha", "pixels", F.round("share", 6).alias("share"), "dominant")


@query("q_sample_loss_status", """
    SELECT sample_id, round(total, 4) AS total_ha, dominant_year, round(dominant_ha, 4) AS dominant_ha,
           CASE WHEN total <= 0 THEN 'NO_LOSS' WHEN dominant_ha / total >= 0.60 AND dominant_ha >= 1.0 THEN 'GOOD' ELSE 'AMBIGUOUS' END AS status
    FROM (SELECT sample_id, sum(area_ha) AS total, max(event_year) FILTER (dominant) AS dominant_year, max(area_ha) FILTER (dominant) AS dominant_ha FROM obs GROUP BY sample_id)""")  # fmt: skip
def sample_loss_status(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).groupBy("sample_id").agg(F.sum("area_ha").alias("total"), F.max(F.when(F.col("dominant"), F.col("event_year"))).alias("dominant_year"), F.max(F.when(F.col("dominant"), F.col("area_ha"))).alias("dominant_ha"))
    return e.select("sample_id", F.round("total", 4).alias("total_ha"), "dominant_year", F.round("dominant_ha", 4).alias("dominant_ha"), S.loss_status(F.col("total"), F.col("dominant_ha"), F.col("dominant_ha") / F.col("total")).alias("status"))


@query("q_event_specs", """
    WITH h AS (SELECT sample_id, list({'year': event_year, 'cents': CAST(round(area_ha * 10000) AS BIGINT)} ORDER BY event_year) AS hist FROM obs GROUP BY sample_id),
    x AS (SELECT sample_id, unnest(hist) AS s FROM h)
    SELECT sample_id, s.year AS event_year, s.cents AS cents, round(s.cents / CAST(sum(s.cents) OVER (PARTITION BY sample_id) AS DOUBLE), 6) AS loss_share FROM x WHERE s.year >= 1996 AND s.cents > 0""")  # fmt: skip
def event_specs(spark: SparkSession, d: str) -> DataFrame:
    """Histograms stored as JSON are parsed, exploded and filtered; the share is of what is left."""
    hist = T.events(spark, d).groupBy("sample_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("event_year").alias("year"), F.round(F.col("area_ha") * 10000).cast("long").alias("cents"))))).alias("histogram"))
    rows = hist.select("sample_id", F.inline(F.from_json("histogram", "array<struct<year:int,cents:bigint>>"))).filter("year >= 1996 and cents > 0")
    return rows.select("sample_id", F.col("year").alias("event_year"), "cents", F.round(F.col("cents") / F.sum("cents").over(Window.partitionBy("sample_id")), 6).alias("loss_share"))


@query("q_multiple_event_flag", "SELECT sample_id, count(DISTINCT event_year) FILTER (event_year >= 1997) AS recent_years, count(DISTINCT event_year) FILTER (event_year >= 1997) >= 3 AS is_multiple FROM obs GROUP BY sample_id")
def multiple_event_flag(spark: SparkSession, d: str) -> DataFrame:
    years = T.events(spark, d).groupBy("sample_id").agg(F.count_distinct(F.when(F.col("event_year") >= 1997, F.col("event_year"))).alias("recent_years"))
    return years.withColumn("is_multiple", F.col("recent_years") >= 3)


@query("q_recent_loss_share", """
    SELECT sample_id, round(sum(area_ha) FILTER (event_year > top - 3) / sum(area_ha), 6) AS recent_share FROM (SELECT *, max(event_year) OVER (PARTITION BY sample_id) AS top FROM obs) GROUP BY sample_id""")  # fmt: skip
def recent_loss_share(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).withColumn("top", F.max("event_year").over(Window.partitionBy("sample_id")))
    return e.groupBy("sample_id").agg(F.round(F.sum(F.when(F.col("event_year") > F.col("top") - 3, F.col("area_ha"))) / F.sum("area_ha"), 6).alias("recent_share"))


@query("q_scene_quality", """
    SELECT flag, status, count(*) AS n, round(avg(cloud), 6) AS cloud, round(avg(shadow), 6) AS shadow, round(quantile_cont(brightness, 0.05), 4) AS p05, round(quantile_cont(brightness, 0.5), 4) AS p50,
           round(quantile_cont(brightness, 0.95), 4) AS p95, round(avg(CASE WHEN brightness < 3500 THEN 1.0 ELSE 0.0 END), 6) AS dark_fraction, count(*) FILTER (cloud > 0.08 OR shadow >= 0.07) AS flagged FROM scenes GROUP BY ALL""")  # fmt: skip
def scene_quality(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("brightness", [0.05, 0.5, 0.95])
    g = T.scenes(spark, d).groupBy("flag", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cloud"), 6).alias("cloud"), F.round(F.avg("shadow"), 6).alias("shadow"), q.alias("q"), F.round(F.avg((F.col("brightness") < 3500).cast("double")), 6).alias("dark_fraction"), A.count_if((F.col("cloud") > 0.08) | (F.col("shadow") >= 0.07)).alias("flagged"))
    return g.select("flag", "status", "n", "cloud", "shadow", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p05", "p50", "p95"))), "dark_fraction", "flagged")


@query("q_darkness_thresholds", """
    SELECT t.threshold, count(*) FILTER (brightness < t.threshold) AS dark, round(avg(CASE WHEN brightness < t.threshold THEN 1.0 ELSE 0.0 END), 6) AS share
    FROM scenes, (SELECT unnest([CAST(1000 AS DOUBLE), 2000, 5000, 10000, 20000, 40000]) AS threshold) t GROUP BY t.threshold""")  # fmt: skip
def darkness_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """One pass over the scenes for all thresholds; the short row of results is turned afterwards."""
    bars = [1000.0, 2000.0, 5000.0, 10000.0, 20000.0, 40000.0]
    row = T.scenes(spark, d).agg(*(A.count_if(F.col("brightness") < b).alias(f"t{i}") for i, b in enumerate(bars)), F.count(F.lit(1)).alias("n"))
    return row.select(F.inline(F.array(*(F.struct(F.lit(b).alias("threshold"), F.col(f"t{i}").alias("dark"), F.round(F.col(f"t{i}") / F.col("n"), 6).alias("share")) for i, b in enumerate(bars)))))


@query("q_brightness_bins", """
    WITH b AS (SELECT CASE WHEN brightness >= 50000 THEN 4 WHEN brightness >= 20000 THEN 3 WHEN brightness >= 10000 THEN 2 WHEN brightness >= 5000 THEN 1 WHEN brightness >= 1000 THEN 0 END AS bin FROM scenes WHERE brightness IS NOT NULL),
    c AS (SELECT bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM b GROUP BY bin) SELECT CAST(bin AS INTEGER) AS bin, n, percent FROM c WHERE bin IS NOT NULL""")  # fmt: skip
def brightness_bins(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(T.scenes(spark, d), "brightness", [1000, 5000, 10000, 20000, 50000])


@query("q_qc_overlap", """
    SELECT count(*) FILTER (c AND NOT s) AS cloud_only, count(*) FILTER (s AND NOT c) AS shadow_only, count(*) FILTER (c AND s) AS both, round(count(*) FILTER (c AND s) / CAST(nullif(count(*) FILTER (c OR s), 0) AS DOUBLE), 6) AS overlap
    FROM (SELECT cloud > 0.07 AS c, shadow > 0.06 AS s FROM scenes)""")  # fmt: skip
def qc_overlap(spark: SparkSession, d: str) -> DataFrame:
    c, s = F.col("cloud") > 0.07, F.col("shadow") > 0.06
    return T.scenes(spark, d).agg(A.count_if(c & ~s).alias("cloud_only"), A.count_if(s & ~c).alias("shadow_only"), A.count_if(c & s).alias("both"), F.round(A.ratio(A.count_if(c & s).cast("double"), A.count_if(c | s)), 6).alias("overlap"))


@query("q_qc_sweep", """
    WITH p AS (SELECT * FROM (SELECT unnest([CAST(0.02 AS DOUBLE), 0.05, 0.08]) AS max_cloud), (SELECT unnest([CAST(0.02 AS DOUBLE), 0.05]) AS max_shadow)),
    s AS (SELECT flag, cloud, shadow, count(*) AS m FROM scenes GROUP BY ALL)
    SELECT max_cloud, max_shadow, flag, CAST(sum(CASE WHEN cloud <= max_cloud AND shadow <= max_shadow THEN m ELSE 0 END) AS BIGINT) AS kept, CAST(sum(m) AS BIGINT) AS n FROM s, p GROUP BY ALL""")  # fmt: skip
def qc_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Grid of limits over pre-aggregated values; the grid is attached as an array, not joined."""
    grid = [(c, s) for c in (0.02, 0.05, 0.08) for s in (0.02, 0.05)]
    few = T.scenes(spark, d).groupBy("flag", "cloud", "shadow").agg(F.count(F.lit(1)).alias("m"))
    each = few.select("*", F.inline(F.array(*(F.struct(F.lit(c).alias("max_cloud"), F.lit(s).alias("max_shadow")) for c, s in grid))))
    return each.groupBy("max_cloud", "max_shadow", "flag").agg(F.sum(F.when((F.col("cloud") <= F.col("max_cloud")) & (F.col("shadow") <= F.col("max_shadow")), F.col("m")).otherwise(0)).alias("kept"), F.sum("m").alias("n"))


@query("q_review_counts", "SELECT review_class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM obs GROUP BY review_class")
def review_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.counts(T.events(spark, d), ["review_class"])


DISTRIBUTION_SQL = "count(*) AS n, round(avg({v}), 6) AS mean, round(coalesce(stddev_samp({v}), 0), 6) AS std, round(quantile_cont({v}, 0.05), 6) AS q05, round(quantile_cont({v}, 0.25), 6) AS q25, round(quantile_cont({v}, 0.5), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS q75, round(quantile_cont({v}, 0.95), 6) AS q95"


@query("q_probability_distribution", f"SELECT review_class, {DISTRIBUTION_SQL.format(v='p_a')} FROM obs GROUP BY review_class")
def probability_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(T.events(spark, d), ["review_class"], "p_a")


@query("q_three_state_table", """
    WITH g AS (SELECT * FROM (SELECT unnest(['Logging', 'Wildfire']) AS label_a), (SELECT unnest(['VALID_LOGGING', 'VALID_WILDFIRE', 'YEAR_MISMATCH', 'EVENT_TOO_SMALL', 'OTHER_INVALID', 'DRAFT']) AS review_class)),
    c AS (SELECT g.label_a, g.review_class, count(o.event_id) AS n FROM g LEFT JOIN obs o USING (label_a, review_class) GROUP BY ALL)
    SELECT label_a, review_class, n, round(CASE WHEN sum(n) OVER (PARTITION BY review_class) > 0 THEN 100.0 * n / sum(n) OVER (PARTITION BY review_class) ELSE 0 END, 4) AS percent FROM c""")  # fmt: skip
def three_state_table(spark: SparkSession, d: str) -> DataFrame:
    return A.contingency(T.events(spark, d), "label_a", "review_class", ["Logging", "Wildfire"], [*T.CLASSES, "DRAFT"])


@query("q_probability_summary", """
    SELECT review_class, count(*) AS n, round(avg(-(q * log2(q) + (1 - q) * log2(1 - q))), 6) AS mean_entropy, round(avg(CASE WHEN p_a <= 0.1 OR p_a >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS share_confident, count(DISTINCT p_a) AS distinct_values
    FROM (SELECT *, least(greatest(p_a, 1e-12), 1 - 1e-12) AS q FROM obs) GROUP BY review_class""")  # fmt: skip
def probability_summary(spark: SparkSession, d: str) -> DataFrame:
    from fieldlens.functions import geo

    return T.events(spark, d).groupBy("review_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(geo.entropy(F.col("p_a"))), 6).alias("mean_entropy"), F.round(F.avg(((F.col("p_a") <= 0.1) | (F.col("p_a") >= 0.9)).cast("double")), 6).alias("share_confident"), F.count_distinct("p_a").alias("distinct_values"))


@query("q_odds_ratio", """
    SELECT n11, n10, n01, n00, round((n11 + 0.5) * (n00 + 0.5) / CAST((n10 + 0.5) * (n01 + 0.5) AS DOUBLE), 6) AS odds_ratio FROM (
        SELECT count(*) FILTER (a AND b) AS n11, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (NOT a AND NOT b) AS n00 FROM (SELECT p_b < 0.2 AS a, review_status = 'REJECTED' AS b FROM obs))""")  # fmt: skip
def odds_ratio(spark: SparkSession, d: str) -> DataFrame:
    return A.odds_table(T.events(spark, d), F.col("p_b") < 0.2, F.col("review_status") == "REJECTED")


@query("q_model_disagreement", "SELECT label_a, label_b, count(*) AS n, round(avg(CASE WHEN review_status = 'REJECTED' THEN 1.0 ELSE 0.0 END), 6) AS share_rejected, round(avg(abs(p_a - p_b)), 6) AS mean_gap FROM obs GROUP BY ALL")
def model_disagreement(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("review_status") == "REJECTED").cast("double")), 6).alias("share_rejected"), F.round(F.avg(F.abs(F.col("p_a") - F.col("p_b"))), 6).alias("mean_gap"))


@query("q_error_rows", "SELECT event_id, human_label, label_a, p_a FROM obs WHERE human_label IS NOT NULL AND human_label <> label_a")
def error_rows(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).filter("human_label is not null and human_label <> label_a").select("event_id", "human_label", "label_a", "p_a")


@query("q_point_level", """
    SELECT sample_id, count(*) AS events, CASE WHEN bool_and(review_status = 'VALID') THEN 'ALL_VALID' WHEN bool_or(review_status = 'VALID') THEN 'MIXED' ELSE 'ALL_REJECTED' END AS state,
           list_sort(list_distinct(list(human_label) FILTER (human_label IS NOT NULL))) IS NOT NULL AND len(list_distinct(list(human_label) FILTER (human_label IS NOT NULL))) > 1 AS both_labels,
           CASE WHEN bool_and(human_label IS NOT NULL) THEN bool_and(human_label = label_a) END AS all_correct FROM obs GROUP BY sample_id""")  # fmt: skip
def point_level(spark: SparkSession, d: str) -> DataFrame:
    valid = F.col("review_status") == "VALID"
    g = T.events(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("events"), F.bool_and(valid).alias("a"), F.bool_or(valid).alias("o"), F.collect_set("human_label").alias("labels"), F.bool_and(F.col("human_label").isNotNull()).alias("full"), F.bool_and(F.col("human_label") == F.col("label_a")).alias("right"))
    return g.select("sample_id", "events", F.when(F.col("a"), "ALL_VALID").when(F.col("o"), "MIXED").otherwise("ALL_REJECTED").alias("state"), (F.size("labels") > 1).alias("both_labels"), F.when(F.col("full"), F.col("right")).alias("all_correct"))


@query("q_reason_features", " UNION ALL ".join(f"SELECT review_class, '{v}' AS feature, {DISTRIBUTION_SQL.format(v=f'CAST({v} AS DOUBLE)')} FROM obs GROUP BY review_class" for v in ("area_ha", "pixels", "p_a")))
def reason_features(spark: SparkSession, d: str) -> DataFrame:
    """Long table of features, one distribution per class and feature."""
    e = T.events(spark, d).select("review_class", *(F.col(c).cast("double").alias(c) for c in ("area_ha", "pixels", "p_a")))
    return A.distribution(e.unpivot(["review_class"], ["area_ha", "pixels", "p_a"], "feature", "v"), ["review_class", "feature"], "v")


@query("q_class_by_year", "SELECT review_class, event_year, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY review_class) AS DOUBLE), 6) AS share_of_row, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY event_year) AS DOUBLE), 6) AS share_of_column FROM obs GROUP BY review_class, event_year")
def class_by_year(spark: SparkSession, d: str) -> DataFrame:
    return A.two_shares(T.events(spark, d), "review_class", "event_year")


@query("q_threshold_sweep", """
    WITH v AS (SELECT pixels AS threshold, count(*) FILTER (review_class = 'EVENT_TOO_SMALL') AS p, count(*) FILTER (review_class <> 'EVENT_TOO_SMALL') AS q FROM obs GROUP BY pixels),
    c AS (SELECT threshold, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS all_p FROM v WINDOW w AS (ORDER BY threshold ROWS UNBOUNDED PRECEDING))
    SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(all_p AS DOUBLE), 6) AS recall, round(2 * tp / CAST(tp + fp + all_p AS DOUBLE), 6) AS f1 FROM c""")  # fmt: skip
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return A.threshold_sweep(T.events(spark, d).withColumn("small", F.col("review_class") == "EVENT_TOO_SMALL"), "pixels", "small")


@query("q_roc_auc", """
    WITH v AS (SELECT p_a, count(*) FILTER (human_label = 'Wildfire') AS p, count(*) FILTER (human_label = 'Logging') AS q FROM obs WHERE human_label IS NOT NULL GROUP BY p_a),
    c AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY p_a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS w FROM v)
    SELECT round(sum(w) / CAST(sum(p) * sum(q) AS DOUBLE), 6) AS auc, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg FROM c""")  # fmt: skip
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return A.roc_auc(T.events(spark, d).filter("human_label is not null").withColumn("y", F.col("human_label") == "Wildfire"), "p_a", "y")


@query("q_quintile_bins", """
    WITH b AS (SELECT quantile_cont(area_ha, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM obs),
    x AS (SELECT CASE WHEN area_ha <= e[2] THEN 1 WHEN area_ha <= e[3] THEN 2 WHEN area_ha <= e[4] THEN 3 WHEN area_ha <= e[5] THEN 4 ELSE 5 END AS bin, review_status FROM obs, b)
    SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(CASE WHEN review_status = 'VALID' THEN 1.0 ELSE 0.0 END), 6) AS share_valid FROM x GROUP BY bin""")  # fmt: skip
def quintile_bins(spark: SparkSession, d: str) -> DataFrame:
    """Quantile edges are one row, attached to every event; the first bin is closed on both sides."""
    e = T.events(spark, d)
    edges = e.agg(F.percentile("area_ha", [0.2, 0.4, 0.6, 0.8]).alias("e"))
    v = F.col("area_ha")
    at = F.when(v <= F.col("e")[0], 1).when(v <= F.col("e")[1], 2).when(v <= F.col("e")[2], 3).when(v <= F.col("e")[3], 4).otherwise(5)
    return e.join(F.broadcast(edges)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("review_status") == "VALID").cast("double")), 6).alias("share_valid"))


@query("q_label_pairs", """
    WITH s AS (SELECT DISTINCT sample_id, review_class FROM obs), m AS (SELECT sample_id, review_class FROM obs GROUP BY ALL HAVING count(*) > 1)
    SELECT a.review_class AS first, b.review_class AS second, count(*) AS points FROM s a JOIN s b ON a.sample_id = b.sample_id AND a.review_class < b.review_class GROUP BY ALL
    UNION ALL SELECT review_class, review_class, count(*) FROM m GROUP BY ALL""")  # fmt: skip
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes seen at one point; a class seen twice pairs with itself. Five classes bound the pairs of a point."""
    n = T.events(spark, d).groupBy("sample_id", "review_class").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("review_class", "n"))).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: (a["review_class"] < b["review_class"]) | ((a["review_class"] == b["review_class"]) & (a["n"] > 1))), lambda b: F.struct(a["review_class"].alias("first"), b["review_class"].alias("second")))))
    return per.select(F.inline(pairs)).groupBy("first", "second").agg(F.count(F.lit(1)).alias("points"))


@query("q_coverage", """
    WITH t AS (SELECT unnest([0.05, 0.1, 0.25]) AS q, unnest(quantile_cont(p_b, [0.05, 0.1, 0.25])) AS bar FROM obs WHERE review_status = 'VALID')
    SELECT CAST(q AS DOUBLE) AS q, round(bar, 6) AS bar, round(avg(CASE WHEN p_b >= bar THEN 1.0 ELSE 0.0 END), 6) AS coverage,
           round(count(*) FILTER (p_b < bar AND review_status = 'REJECTED') / CAST(nullif(count(*) FILTER (p_b < bar), 0) AS DOUBLE), 6) AS reject_precision,
           round(count(*) FILTER (p_b < bar AND review_status = 'REJECTED') / CAST(nullif(count(*) FILTER (review_status = 'REJECTED'), 0) AS DOUBLE), 6) AS reject_recall
    FROM obs, t GROUP BY q, bar""")  # fmt: skip
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Rejecting what lies below a reference quantile: coverage and the quality of the rejections."""
    e = T.events(spark, d)
    qs = [0.05, 0.1, 0.25]
    bars = e.filter("review_status = 'VALID'").agg(F.percentile("p_b", qs).alias("b")).select(F.array(*(F.struct(F.lit(q).alias("q"), F.col("b")[i].alias("bar")) for i, q in enumerate(qs))).alias("bars"))
    few = e.groupBy("p_b", "review_status").agg(F.count(F.lit(1)).alias("m"))
    x = few.join(F.broadcast(bars)).select("*", F.inline("bars"))
    low, bad, m = F.col("p_b") < F.col("bar"), F.col("review_status") == "REJECTED", F.col("m")
    s = lambda c: F.sum(F.when(c, m).otherwise(0)).cast("double")
    return x.groupBy("q", "bar").agg(F.round(s(~low) / F.sum("m"), 6).alias("coverage"), F.round(A.ratio(s(low & bad), s(low)), 6).alias("reject_precision"), F.round(A.ratio(s(low & bad), s(bad)), 6).alias("reject_recall")).withColumn("bar", F.round("bar", 6))


@query("q_model_metrics", metrics_sql("SELECT 'a' AS model, human_label = 'Wildfire' AS t, label_a = 'Wildfire' AS p FROM obs WHERE human_label IS NOT NULL UNION ALL SELECT 'b', human_label = 'Wildfire', label_b = 'Wildfire' FROM obs WHERE human_label IS NOT NULL", "model"))
def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).filter("human_label is not null")
    each = e.select("human_label", F.inline(F.array(F.struct(F.lit("a").alias("model"), F.col("label_a").alias("label")), F.struct(F.lit("b").alias("model"), F.col("label_b").alias("label")))))
    return each.groupBy("model").agg(*A.binary_metrics(F.col("human_label") == "Wildfire", F.col("label") == "Wildfire"))


@query("q_confusion", """
    SELECT human_label, count(*) FILTER (label_a = 'Logging') AS logging, count(*) FILTER (label_a = 'Wildfire') AS wildfire FROM obs WHERE human_label IS NOT NULL GROUP BY human_label""")  # fmt: skip
def confusion(spark: SparkSession, d: str) -> DataFrame:
    wide = T.events(spark, d).filter("human_label is not null").groupBy("human_label").pivot("label_a", ["Logging", "Wildfire"]).count().fillna(0)
    return wide.select("human_label", F.col("Logging").alias("logging"), F.col("Wildfire").alias("wildfire"))


@query("q_review_tables", """
    SELECT CAST(grouping_id(review_status, human_label, event_year) AS BIGINT) AS grouping, review_status, human_label, event_year, count(*) AS n FROM obs
    GROUP BY GROUPING SETS ((review_status), (human_label), (event_year), (review_status, event_year), ())""")  # fmt: skip
def review_tables(spark: SparkSession, d: str) -> DataFrame:
    """Several count tables in one pass."""
    T.events(spark, d).createOrReplaceTempView("fieldlens_events")
    return spark.sql("""SELECT grouping_id(review_status, human_label, event_year) AS grouping, review_status, human_label, event_year, count(*) AS n FROM fieldlens_events
        GROUP BY GROUPING SETS ((review_status), (human_label), (event_year), (review_status, event_year), ())""")


@query("q_fixed_rules", " UNION ALL ".join(f"SELECT '{n}' AS rule, * FROM ({metrics_sql(f'SELECT review_class = {chr(39)}EVENT_TOO_SMALL{chr(39)} AS t, {c} AS p FROM obs WHERE sample_id % 10 <> 0')})" for n, c in (("area", "area_ha < 10"), ("pixels", "pixels < 2"), ("either", "area_ha < 10 OR pixels < 2"))))
def fixed_rules(spark: SparkSession, d: str) -> DataFrame:
    """Frozen thresholds, alone and joined by OR, on points outside the baseline set."""
    baseline = T.samples(spark, d).filter("sample_id % 10 = 0").select("sample_id")
    e = T.events(spark, d).join(baseline, "sample_id", "left_anti")
    rules = {"area": F.col("area_ha") < 10, "pixels": F.col("pixels") < 2, "either": (F.col("area_ha") < 10) | (F.col("pixels") < 2)}
    each = e.select("review_class", F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), c.alias("hit")) for n, c in rules.items()))))
    return each.groupBy("rule").agg(*A.binary_metrics(F.col("review_class") == "EVENT_TOO_SMALL", F.col("hit")))


@query("q_relative_to_dominant", """
    WITH x AS (SELECT e.sample_id, e.event_year - m.event_year AS delta, e.area_ha / m.area_ha AS relative FROM obs e JOIN obs m ON e.sample_id = m.sample_id AND m.dominant WHERE NOT e.dominant)
    SELECT CAST(delta AS INTEGER) AS delta, count(*) AS n, round(quantile_cont(relative, 0.25), 6) AS q25, round(quantile_cont(relative, 0.5), 6) AS median, round(quantile_cont(relative, 0.75), 6) AS q75 FROM x GROUP BY delta""")  # fmt: skip
def relative_to_dominant(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("sample_id")
    e = T.events(spark, d).withColumns({"top_year": F.max(F.when(F.col("dominant"), F.col("event_year"))).over(w), "top_area": F.max(F.when(F.col("dominant"), F.col("area_ha"))).over(w)}).filter(~F.col("dominant"))
    g = e.groupBy((F.col("event_year") - F.col("top_year")).alias("delta")).agg(F.count(F.lit(1)).alias("n"), F.percentile(F.col("area_ha") / F.col("top_area"), [0.25, 0.5, 0.75]).alias("q"))
    return g.select("delta", "n", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "median", "q75"))))


@query("q_review_rollup", """
    SELECT sample_id, CASE WHEN bool_or(review_status = 'VALID') THEN 'Valid' WHEN bool_and(review_status = 'REJECTED') THEN 'Wrong' END AS verdict, count(*) AS events,
           CASE WHEN count(human_label) = 0 THEN 'NOT_STARTED' WHEN count(human_label) < count(*) THEN 'PARTIAL' ELSE 'COMPLETE' END AS completion FROM obs GROUP BY sample_id""")  # fmt: skip
def review_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("review_status")
    g = T.events(spark, d).groupBy("sample_id").agg(F.when(F.bool_or(s == "VALID"), "Valid").when(F.bool_and(s == "REJECTED"), "Wrong").alias("verdict"), F.count(F.lit(1)).alias("events"), F.count("human_label").alias("done"))
    return g.select("sample_id", "verdict", "events", F.when(F.col("done") == 0, "NOT_STARTED").when(F.col("done") < F.col("events"), "PARTIAL").otherwise("COMPLETE").alias("completion"))


@query("q_cohort_metrics", """
    WITH x AS (SELECT unnest(CASE WHEN sample_id % 3 = 0 THEN ['baseline', 'current'] ELSE ['added', 'current'] END) AS cohort, review_status, p_a FROM obs),
    m AS (SELECT cohort, count(*) AS n, avg(CASE WHEN review_status = 'VALID' THEN 1.0 ELSE 0.0 END) AS share_valid FROM x GROUP BY cohort)
    SELECT cohort, n, round(share_valid, 6) AS share_valid, round(share_valid - (SELECT share_valid FROM m WHERE cohort = 'baseline'), 6) AS delta FROM m""")  # fmt: skip
def cohort_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Baseline, added and current cohorts with differences from the baseline."""
    in_base = F.col("sample_id") % 3 == 0
    x = T.events(spark, d).select("review_status", F.explode(F.when(in_base, F.array(F.lit("baseline"), F.lit("current"))).otherwise(F.array(F.lit("added"), F.lit("current")))).alias("cohort"))
    m = x.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("review_status") == "VALID").cast("double")).alias("s"))
    base = F.max(F.when(F.col("cohort") == "baseline", F.col("s"))).over(Window.partitionBy())
    return m.select("cohort", "n", F.round("s", 6).alias("share_valid"), F.round(F.col("s") - base, 6).alias("delta"))


@query("q_fold_summary", "SELECT CAST(event_year AS INTEGER) AS event_year, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std FROM (SELECT event_year, sample_id % 5 AS fold, avg(CASE WHEN human_label = label_a THEN 1.0 ELSE 0.0 END) AS acc FROM obs WHERE human_label IS NOT NULL GROUP BY ALL) GROUP BY event_year")
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    folds = T.events(spark, d).filter("human_label is not null").groupBy("event_year", (F.col("sample_id") % 5).alias("fold")).agg(F.avg((F.col("human_label") == F.col("label_a")).cast("double")).alias("acc"))
    return folds.groupBy("event_year").agg(F.round(F.avg("acc"), 6).alias("mean"), F.round(F.stddev_pop("acc"), 6).alias("std"))


@query("q_tile_counts", "SELECT lpad(CAST(abs(t) AS VARCHAR), 2, '0') || CASE WHEN t >= 0 THEN 'N' ELSE 'S' END || '_' || lpad(CAST(abs(l) AS VARCHAR), 3, '0') || CASE WHEN l >= 0 THEN 'E' ELSE 'W' END AS tile, count(*) AS n FROM (SELECT CAST(floor(lat / 10) * 10 + 10 AS BIGINT) AS t, CAST(floor(lon / 10) * 10 AS BIGINT) AS l FROM samples) GROUP BY ALL")
def tile_counts(spark: SparkSession, d: str) -> DataFrame:
    from fieldlens.functions import geo

    return T.samples(spark, d).groupBy(geo.tile_id(F.col("lat"), F.col("lon")).alias("tile")).agg(F.count(F.lit(1)).alias("n"))


@query("q_fold_rare_classes", "SELECT CASE WHEN n < 60 THEN 'Other' ELSE nation END AS nation, CAST(sum(n) AS BIGINT) AS n FROM (SELECT country AS nation, count(*) AS n FROM samples GROUP BY country) GROUP BY 1")
def fold_rare_classes(spark: SparkSession, d: str) -> DataFrame:
    return S.fold_rare(T.samples(spark, d).select(F.col("country").alias("nation")), "nation", 60).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@query("q_manifest_audit", """
    SELECT cohort, count(*) AS rows, count(DISTINCT sample_id) AS points, count(DISTINCT event_year) AS years, round(sum(w), 6) AS weight FROM (
        SELECT *, CASE WHEN sample_id % 3 = 0 THEN 'baseline' ELSE 'added' END AS cohort, 1.0 / count(*) OVER (PARTITION BY sample_id) AS w FROM obs) GROUP BY cohort""")  # fmt: skip
def manifest_audit(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).withColumns({"cohort": F.when(F.col("sample_id") % 3 == 0, "baseline").otherwise("added"), "w": 1.0 / F.count(F.lit(1)).over(Window.partitionBy("sample_id"))})
    return e.groupBy("cohort").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sample_id").alias("points"), F.count_distinct("event_year").alias("years"), F.round(F.sum("w"), 6).alias("weight"))


@query("q_table_inventory", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "orders", "events", "documents", "labels")))
def table_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of several tables."""
    out = None
    for t in ("customer", "orders", "events", "documents", "labels"):
        one = table(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
