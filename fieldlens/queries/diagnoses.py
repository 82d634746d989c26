"""Queries over the diagnosis of scores in a feature space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.operators import diagnostics as D
from fieldlens.operators.vectors import blocked_similarity
from fieldlens.plans.lineage import materialize
from fieldlens.queries.ordered import UNIT_SQL, references
from fieldlens.registry import query

#: The query set: every 25th vector; those whose id 50 divides are the reference, all vectors are looked at.
ROWS = f"""{UNIT_SQL}, pr AS (SELECT q.vec_id, r.label % 2 AS side, q.label % 2 AS own, list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) AS s, r.vec_id AS other FROM u q JOIN u r ON q.vec_id <> r.vec_id AND q.vec_id % 25 = 0),
    nr AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS k FROM pr),
    kn AS (SELECT vec_id AS id, any_value(own) AS own, avg(s) FILTER (k <= 3) AS known_3, avg(s) FILTER (k <= 5) AS known_5, avg(s) FILTER (k <= 10) AS known_10, max(s) FILTER (side = 0) AS sim_logging, max(s) FILTER (side = 1) AS sim_wildfire FROM nr GROUP BY vec_id),
    rw AS (SELECT *, CASE WHEN id % 50 = 0 THEN 'REFERENCE' ELSE 'MINED' END AS source, (id * 13 % 101) / CAST(100 AS DOUBLE) AS p, CASE WHEN p >= 0.5 THEN 'Wildfire' ELSE 'Logging' END AS first, CASE WHEN id % 3 = 0 THEN 'Logging' ELSE 'Wildfire' END AS second, CASE WHEN own = 0 THEN 'Logging' ELSE 'Wildfire' END AS truth FROM kn),
    ed AS (SELECT quantile_cont(round(known_3, 6), [0.01, 0.05]) AS t_3, quantile_cont(round(known_5, 6), [0.01, 0.05]) AS t_5, quantile_cont(round(known_10, 6), [0.01, 0.05]) AS t_10 FROM rw WHERE source = 'REFERENCE'),
    fl0 AS (SELECT rw.*, coalesce(round(known_5, 6) < t_5[2], false) AS unknown_flag FROM rw, ed), fl1 AS (SELECT *, NOT unknown_flag AND p BETWEEN 0.4 AND 0.6 AS ambiguous_flag, CASE WHEN first = second THEN 'AGREE_' || upper(first) ELSE 'RC_' || upper(first) || '_XGB_' || upper(second) END AS agreement_type FROM fl0),
    fl AS (SELECT *, CASE WHEN agreement_type <> 'RC_LOGGING_XGB_WILDFIRE' THEN NULL WHEN unknown_flag THEN 'OOD_BY_MANUAL_P05' WHEN ambiguous_flag THEN 'AMBIGUOUS_0_4_0_6' WHEN sim_logging >= sim_wildfire THEN 'IN_DISTRIBUTION_LOGGING_LIKE' ELSE 'WILDFIRE_LIKE_LATENT_CONFLICT' END AS diagnosis FROM fl1)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """The rows to be diagnosed: knownness and class similarities of the query vectors from one pass over all."""
    u = references(spark, d)
    met = materialize(blocked_similarity(u.filter("vec_id % 25 = 0"), u, "vec_id", "v", "label"))
    k = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("s"), "other"))
    near = met.filter("kind = 'near'").withColumn("k", k).groupBy("vec_id").agg(*(F.avg(F.when(F.col("k") <= n, F.col("s"))).alias(f"known_{n}") for n in D.NEIGHBOURS))
    side = met.filter("kind = 'class'").groupBy(F.col("vec_id").alias("__v")).agg(F.max(F.when(F.col("label") % 2 == 0, F.col("s"))).alias("sim_logging"), F.max(F.when(F.col("label") % 2 == 1, F.col("s"))).alias("sim_wildfire"))
    own = u.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "Logging").otherwise("Wildfire").alias("truth"))
    rows = own.join(near, F.col("id") == F.col("vec_id")).join(side, F.col("id") == F.col("__v"), "left").drop("vec_id", "__v")
    p = (F.col("id") * 13 % 101) / F.lit(100.0)
    return rows.withColumns({"source": F.when(F.col("id") % 50 == 0, D.REFERENCE).otherwise("MINED"), "p": p, "first": F.when(p >= 0.5, "Wildfire").otherwise("Logging"), "second": F.when(F.col("id") % 3 == 0, "Logging").otherwise("Wildfire")})


@query("q_diagnosis_rows", f"WITH {ROWS} SELECT id, source, unknown_flag, ambiguous_flag, agreement_type, diagnosis, round(abs(sim_logging - sim_wildfire), 6) AS margin FROM fl")
def diagnosis_rows(spark: SparkSession, d: str) -> DataFrame:
    """Flags and diagnosis of every query vector."""
    rows = materialize(scored(spark, d))
    return D.flagged(rows, D.thresholds(rows)).select("id", "source", "unknown_flag", "ambiguous_flag", "agreement_type", "diagnosis", F.round("similarity_margin", 6).alias("margin"))


@query("q_agreement_summary", f"""WITH {ROWS} SELECT agreement_type, count(*) AS events, round(avg(known_5), 6) AS knownness_k5_mean, round(quantile_cont(round(known_5, 6), 0.5), 6) AS knownness_k5_median, round(avg(abs(sim_logging - sim_wildfire)), 6) AS similarity_margin_mean,
    round(avg(p), 6) AS probability_wildfire_mean, round(avg(CAST(unknown_flag AS INTEGER)), 6) AS unknown_share, round(avg(CAST(ambiguous_flag AS INTEGER)), 6) AS ambiguous_share FROM fl WHERE source <> 'REFERENCE' GROUP BY agreement_type""")  # fmt: skip
def agreement_summary(spark: SparkSession, d: str) -> DataFrame:
    """The mined rows by how two models agree."""
    rows = materialize(scored(spark, d))
    return D.agreement_summary(D.flagged(rows, D.thresholds(rows)).filter(F.col("source") != D.REFERENCE))


@query("q_domain_shift", f"""WITH {ROWS}, c AS (SELECT unnest([3, 3, 5, 5, 10, 10]) AS k, unnest([1, 2, 1, 2, 1, 2]) AS i), v AS (SELECT k, i, CASE k WHEN 3 THEN known_3 WHEN 5 THEN known_5 ELSE known_10 END AS x, CASE k WHEN 3 THEN t_3[i] WHEN 5 THEN t_5[i] ELSE t_10[i] END AS t FROM rw, ed, c WHERE source <> 'REFERENCE')
    SELECT 'knownness_k' || k AS metric, CASE i WHEN 1 THEN 0.01::DOUBLE ELSE 0.05::DOUBLE END AS manual_quantile, round(any_value(t), 6) AS manual_threshold, count(*) FILTER (round(x, 6) < t) AS below_events, round(count(*) FILTER (round(x, 6) < t) / count(*), 6) AS below_share FROM v GROUP BY k, i""")  # fmt: skip
def domain_shift(spark: SparkSession, d: str) -> DataFrame:
    """How far the mined rows lie below the reference's low quantiles."""
    rows = materialize(scored(spark, d))
    return D.domain_shift(rows, materialize(D.thresholds(rows)))


@query("q_lowest_overlap", f"""WITH {ROWS}, k AS (SELECT id, row_number() OVER (ORDER BY known_3, id) AS r3, row_number() OVER (ORDER BY known_5, id) AS r5, row_number() OVER (ORDER BY known_10, id) AS r10, count(*) OVER () AS n FROM rw WHERE source = 'REFERENCE'),
    c AS (SELECT * FROM (VALUES (3, 5), (3, 10), (5, 10)) AS a(left_k, right_k), (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.10::DOUBLE)) AS b(bottom_fraction)),
    x AS (SELECT left_k, right_k, bottom_fraction, greatest(1, CAST(ceil(n * bottom_fraction) AS BIGINT)) AS events_per_set, CASE left_k WHEN 3 THEN r3 ELSE r5 END AS a, CASE right_k WHEN 5 THEN r5 ELSE r10 END AS b FROM k, c)
    SELECT left_k, right_k, bottom_fraction, any_value(events_per_set) AS events_per_set, count(*) FILTER (a <= events_per_set AND b <= events_per_set) AS intersection, round(count(*) FILTER (a <= events_per_set AND b <= events_per_set) / CAST(2 * any_value(events_per_set) - count(*) FILTER (a <= events_per_set AND b <= events_per_set) AS DOUBLE), 6) AS jaccard FROM x GROUP BY ALL""")  # fmt: skip
def lowest_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether the least known rows are the same for other numbers of neighbours."""
    return D.lowest_overlap(scored(spark, d))


@query("q_diagnosis_tables")
def diagnosis_tables(spark: SparkSession, d: str) -> DataFrame:
    """All tables of a diagnosis as names with their numbers of rows. Tables are held against SQL by the queries above and against loops in tests."""
    made = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, t in D.diagnose(scored(spark, d)).items()]
    out = made[0]
    for t in made[1:]:
        out = out.unionByName(t)
    return out
