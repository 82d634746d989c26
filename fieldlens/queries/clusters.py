"""Queries over density clusters, aligned clusterings and fits that leave points out."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.operators import agreement, density, leave_out
from fieldlens.operators import learn as L
from fieldlens.operators import ordered as O
from fieldlens.plans.tables import table
from fieldlens.registry import query
from fieldlens.sources import standins as T

#: (least cluster size, neighbours) that are tried.
DENSITY_GRID: list[tuple[int, int | None]] = [(3, None), (3, 1), (5, None), (5, 2), (15, 3)]


def coordinates(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    """The vectors of the table by their first principal components."""
    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("x"))


@query("q_density_clusters")
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Cluster and membership of every vector by several settings, with their scores and the one that is selected. Held against a whole-matrix version in tests."""
    scores, labels = density.density_grid(coordinates(spark, d), "vec_id", "x", DENSITY_GRID)
    settings = scores.select("combo", "min_cluster_size", "min_samples", "clusters", F.round("score", 6).alias("score"), "selected")
    return labels.join(F.broadcast(settings), "combo")  # one row a setting


@query("q_leave_one_out")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """Every event of a point with several events and a target, scored by a model of all other points, with its rank in the point. Held against a loop of single fits in tests."""
    target = (F.col("review_status") == "VALID") & F.col("human_label").isNotNull()
    point = Window.partitionBy("sample_id")
    e = T.events(spark, d).withColumn("target", F.coalesce(target, F.lit(False)).cast("int"))
    e = e.withColumns({"events": F.count(F.lit(1)).over(point), "targets": F.sum("target").over(point), "mean_p": (F.col("p_a") + F.col("p_b")) / 2, "log_area": F.log1p("area_ha")}).filter("events >= 2 and targets > 0")
    found = leave_out.leave_one_out(e, "sample_id", "target", ["log_area", "pixels", "share", "mean_p"])
    rank = F.row_number().over(point.orderBy(F.desc("p"), F.desc("area_ha"), "event_year"))
    return found.select("sample_id", "event_id", "target", F.round("p", 6).alias("p"), rank.alias("rank"))


@query("q_leave_one_out_metrics")
def leave_one_out_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How often these models put a target year first. Held against a loop of single fits in tests."""
    return O.ranking_metrics(leave_one_out(spark, d).withColumn("hit", F.col("target") == 1), ["sample_id"], "rank", "hit")


CLUSTERED = "(SELECT vec_id, label % 5 AS a, CAST((label * 3 + vec_id % 2) % 5 AS INTEGER) AS b FROM embeddings)"


@query("q_aligned_labels", f"""
    WITH RECURSIVE n AS (SELECT a, b, count(*) AS n FROM {CLUSTERED} GROUP BY ALL), names AS (SELECT CAST(row_number() OVER (ORDER BY a) AS INTEGER) AS i, a FROM (SELECT DISTINCT a FROM n)), bs AS (SELECT DISTINCT b FROM n),
    p(i, used, total) AS (SELECT 0, CAST([] AS INTEGER[]), CAST(0 AS BIGINT) UNION ALL SELECT p.i + 1, list_append(p.used, bs.b), p.total + coalesce((SELECT n.n FROM n JOIN names ON names.a = n.a WHERE names.i = p.i + 1 AND n.b = bs.b), 0) FROM p, bs WHERE NOT list_contains(p.used, bs.b)),
    best AS (SELECT used FROM p WHERE i = (SELECT count(*) FROM names) ORDER BY total DESC, used LIMIT 1), m AS (SELECT a, used[i] AS b FROM names, best)
    SELECT vec_id, c.a, c.b, m.a AS aligned, c.a = m.a AS agrees FROM {CLUSTERED} AS c LEFT JOIN m ON m.b = c.b""")  # fmt: skip
def aligned_labels(spark: SparkSession, d: str) -> DataFrame:
    """A second labelling of the vectors in the names of the first that fit it best."""
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 5).alias("a"), ((F.col("label") * 3 + F.col("vec_id") % 2) % 5).cast("int").alias("b"))
    out = agreement.align(rows, "a", "b")
    return out.select("vec_id", "a", "b", "aligned", (F.col("a") == F.col("aligned")).alias("agrees"))


@query("q_membership_stability")
def membership_stability(spark: SparkSession, d: str) -> DataFrame:
    """How often each vector stays in its cluster when the clusters are fitted on parts of the vectors. Alignment is held against all permutations in tests."""
    return agreement.membership_stability(coordinates(spark, d), "vec_id", "x", 3, 5)


@query("q_rank_tests", """
    WITH RECURSIVE r AS (SELECT event_year, avg(i) OVER (PARTITION BY event_year, area_ha) AS ra, avg(j) OVER (PARTITION BY event_year, p_a) AS rp FROM (SELECT *, row_number() OVER (PARTITION BY event_year ORDER BY area_ha) AS i, row_number() OVER (PARTITION BY event_year ORDER BY p_a) AS j FROM obs)),
    s AS (SELECT event_year, count(*) AS n, corr(ra, rp) AS rho FROM r GROUP BY event_year), t AS (SELECT *, (n - 2) / 2.0::DOUBLE AS h, 1 - rho * rho AS x FROM s),
    -- for whole df the two-sided p-value is 1 minus a finite series in the angle atan(t / sqrt(df))
    a AS (SELECT event_year, n, rho, n - 2 AS df, atan(abs(rho) / sqrt(x)) AS angle FROM t),
    k(event_year, j, term, total) AS (SELECT event_year, CASE WHEN df % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN df % 2 = 0 THEN 1.0::DOUBLE ELSE cos(angle) END, CASE WHEN df = 1 THEN 0.0::DOUBLE WHEN df % 2 = 0 THEN 1.0::DOUBLE ELSE cos(angle) END FROM a
        UNION ALL SELECT k.event_year, j + 2, term * (j + 1) / (j + 2) * cos(angle) * cos(angle), total + term * (j + 1) / (j + 2) * cos(angle) * cos(angle) FROM k JOIN a ON a.event_year = k.event_year WHERE j + 2 <= df - 2),
    c AS (SELECT event_year, max_by(total, j) AS total FROM k GROUP BY event_year)
    SELECT event_year, n, round(rho, 6) AS spearman, round(1 - CASE WHEN df % 2 = 0 THEN sin(angle) * total ELSE 2 / pi() * (angle + sin(angle) * total) END, 6) AS p_value FROM a JOIN c USING (event_year)""")  # fmt: skip
def rank_tests(spark: SparkSession, d: str) -> DataFrame:
    """Spearman correlation of area and score in each year, with its two-sided p-value."""
    return agreement.rank_tests(T.events(spark, d), "event_year", "area_ha", "p_a").select("event_year", "n", F.round("spearman", 6).alias("spearman"), F.round("p_value", 6).alias("p_value"))


@query("q_clustering_winners")
def clustering_winners(spark: SparkSession, d: str) -> DataFrame:
    """Which number of clusters each measure prefers, and the one between them. The choice is held against a loop in tests."""
    rows = coordinates(spark, d)
    ks = [2, 3, 4]
    return L.clustering_winners(L.cluster_scores(rows, "x", ks), L.cluster_stability(rows, "vec_id", "x", ks, 2))


@query("q_effective_folds", """
    SELECT review_status, least(7, min(n)) AS folds, min(n) AS rarest FROM (SELECT review_status, review_class, count(DISTINCT event_year) AS n FROM obs WHERE p_a > 0.9 GROUP BY ALL) GROUP BY review_status""")  # fmt: skip
def effective_folds(spark: SparkSession, d: str) -> DataFrame:
    """How many folds by year the classes of each status allow."""
    e, out = T.events(spark, d).filter("p_a > 0.9"), None
    for status in ("VALID", "REJECTED"):
        row = L.effective_folds(e.filter(F.col("review_status") == status), "review_class", "event_year", 7).select(F.lit(status).alias("review_status"), "folds", "rarest")
        out = row if out is None else out.unionByName(row)
    return out
