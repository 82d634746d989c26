"""Queries that resample, split, fit and compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.operators import aggregate as A
from fieldlens.operators import learn as L
from fieldlens.plans.tables import table
from fieldlens.registry import query
from fieldlens.sources import standins as T

DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


@query("q_cluster_bootstrap", f"""
    WITH c AS (SELECT row_number() OVER (ORDER BY sample_id) - 1 AS i, CAST(count(*) FILTER (review_status = 'VALID') AS DOUBLE) AS h, count(*) AS n FROM obs GROUP BY sample_id), k AS (SELECT count(*) AS k FROM c),
    d AS (SELECT run, {DRAW.format("run || '-' || t")} % k AS i FROM k, (SELECT unnest(range(200)) AS run), (SELECT unnest(range((SELECT k FROM k))) AS t)),
    s AS (SELECT run, sum(h) / sum(n) AS share FROM d JOIN c USING (i) GROUP BY run)
    SELECT (SELECT round(sum(h) / sum(n), 6) FROM c) AS share, round(quantile_cont(share, 0.025), 6) AS low, round(quantile_cont(share, 0.975), 6) AS high FROM s""")  # fmt: skip
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Share of valid events with its interval over resampled points."""
    return L.cluster_bootstrap(T.events(spark, d), "sample_id", F.col("review_status") == "VALID", 200)


@query("q_average_precision", """
    WITH v AS (SELECT p_a, count(*) FILTER (human_label = 'Wildfire') AS p, count(*) AS n FROM obs WHERE human_label IS NOT NULL GROUP BY p_a), c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS upto FROM v WINDOW w AS (ORDER BY p_a DESC ROWS UNBOUNDED PRECEDING))
    SELECT round(sum(p * tp / CAST(upto AS DOUBLE)) / sum(p), 6) AS average_precision, CAST(sum(p) AS BIGINT) AS positives FROM c""")  # fmt: skip
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).filter("human_label is not null").withColumn("y", F.col("human_label") == "Wildfire")
    return L.average_precision(e, "p_a", "y")


@query("q_grouped_folds", """
    WITH g AS (SELECT sample_id, min(review_class) AS stratum FROM obs GROUP BY sample_id) SELECT stratum, count(*) AS n FROM g GROUP BY stratum""")  # fmt: skip
def grouped_folds(spark: SparkSession, d: str) -> DataFrame:
    """Points per stratum over all folds; folds differ by one at most and don't leak, or the query fails."""
    s = L.stratified_folds(T.events(spark, d), "sample_id", "review_class", 5, 11)
    per = s.groupBy("stratum", "fold").agg(F.count(F.lit(1)).alias("n"))
    even = per.groupBy("stratum").agg(F.sum("n").alias("n"), (F.max("n") - F.min("n")).alias("gap"), F.count(F.lit(1)).alias("folds"))
    fine = (F.col("gap") <= 1) | (F.col("folds") < 5)
    return even.select("stratum", F.when(fine, F.col("n")).otherwise(F.raise_error(F.lit("folds are uneven"))).cast("long").alias("n"))


def cohort(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).filter("human_label is not null")
    return e.select("event_id", "sample_id", "area_ha", F.col("pixels").cast("double").alias("pixels"), F.when(F.col("p_b") > 0.05, F.col("p_b")).alias("p_b"), (F.col("human_label") == "Wildfire").cast("int").alias("y"))


@query("q_logistic_out_of_fold")
def logistic_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    """Grouped cross-validation of a class-balanced logistic regression: metrics of the out-of-fold predictions. Held against a Newton fit in tests."""
    c = cohort(spark, d)
    splits = L.stratified_folds(c, "sample_id", "y", 3, 3)
    scored = L.out_of_fold(c, splits, "sample_id", "y", L.logistic(["area_ha", "pixels", "p_b"], "y", weight="__w"), 3, balanced=True)
    return scored.agg(*A.binary_metrics(F.col("y") == 1, F.col("p") >= 0.5))


@query("q_boosted_out_of_fold")
def boosted_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d)
    splits = L.stratified_folds(c, "sample_id", "y", 2, 3)
    scored = L.out_of_fold(c, splits, "sample_id", "y", L.boosted(["area_ha", "pixels", "p_b"], "y"), 2)
    return scored.agg(*A.binary_metrics(F.col("y") == 1, F.col("p") >= 0.5))


@query("q_cluster_scores")
def cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    """Measures of k-means and Gaussian mixtures for 2 to 10 clusters. Held against numpy in tests."""
    return L.cluster_scores(table(spark, d, "embeddings"), "embedding", list(range(2, 11)))


@query("q_cluster_stability")
def cluster_stability(spark: SparkSession, d: str) -> DataFrame:
    """How far clusterings of drawn parts agree with the whole's. Held against planted clusters in tests."""
    return L.cluster_stability(table(spark, d, "embeddings"), "vec_id", "embedding", [2, 5], 3)


@query("q_linear_probe")
def linear_probe(spark: SparkSession, d: str) -> DataFrame:
    """Repeated grouped cross-validation of a linear model."""
    return L.repeated_probe(cohort(spark, d), "sample_id", "y", ["area_ha", "pixels", "p_b"], 2, 3)


@query("q_pca")
def pca(spark: SparkSession, d: str) -> DataFrame:
    """Variance of the principal components, and which of them reach half of it. Held against numpy in tests."""
    k, variance = L.principal_components(table(spark, d, "embeddings"), "embedding", 20, 0.5)
    return spark.createDataFrame([(i, v, i <= k) for i, v in enumerate(variance, 1)], "component int, variance double, needed boolean")


@query("q_adjusted_rand", """
    WITH n AS (SELECT label_a, label_b, count(*) AS n FROM obs GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS m FROM n), a AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM n GROUP BY label_a)), b AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM n GROUP BY label_b))
    SELECT round((s.s - a.s * b.s / (m * (m - 1) / 2)) / ((a.s + b.s) / 2 - a.s * b.s / (m * (m - 1) / 2)), 6) AS ari FROM s, a, b""")  # fmt: skip
def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return L.adjusted_rand(T.events(spark, d), "label_a", "label_b")


@query("q_reject_bands", """
    SELECT CAST(width AS DOUBLE) AS width, round(avg(CASE WHEN abs(p_a - 0.5) >= width THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN (p_a >= 0.5) = (human_label = 'Wildfire') THEN 1.0 ELSE 0.0 END) FILTER (abs(p_a - 0.5) >= width), 6) AS accuracy
    FROM obs, (SELECT unnest([CAST(0.05 AS DOUBLE), 0.15, 0.3]) AS width) WHERE human_label IS NOT NULL GROUP BY width""")  # fmt: skip
def reject_bands(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).filter("human_label is not null").withColumn("t", F.col("human_label") == "Wildfire")
    return L.reject_bands(e, "p_a", "t", [0.05, 0.15, 0.3])


@query("q_best_candidate", "SELECT sample_id, driver, balance FROM samples ORDER BY balance DESC, lat DESC, lon DESC, sample_id DESC LIMIT 1")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    s = T.samples(spark, d).select("sample_id", "driver", "balance", "lat", "lon")
    return L.best_row(s, [F.col("balance"), F.col("lat"), F.col("lon"), F.col("sample_id")]).select("sample_id", "driver", "balance")


@query("q_cluster_composition", "SELECT region, driver, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY region) AS DOUBLE), 6) AS share FROM samples GROUP BY region, driver")
def cluster_composition(spark: SparkSession, d: str) -> DataFrame:
    return L.shares_within(T.samples(spark, d), "region", "driver")
