"""Queries that rank, order, fold and compare vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.functions import geo
from fieldlens.operators import ordered as O
from fieldlens.operators import planning as P
from fieldlens.operators import select as S
from fieldlens.plans.prefix import running_totals
from fieldlens.plans.tables import table
from fieldlens.registry import query
from fieldlens.sources import standins as T


@query("q_latest_per_key", "SELECT subject, kind, record_id, value FROM status_log QUALIFY row_number() OVER (PARTITION BY subject, kind ORDER BY logged_at DESC, record_id DESC) = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(T.status_log(spark, d), ["subject", "kind"], [F.desc("logged_at"), F.desc("record_id")]).select("subject", "kind", "record_id", "value")


@query("q_latest_map", "SELECT subject, max(value) FILTER (kind = 'click') AS click, max(value) FILTER (kind = 'view') AS view, count(*) AS kinds FROM (SELECT * FROM status_log QUALIFY row_number() OVER (PARTITION BY subject, kind ORDER BY logged_at DESC, record_id DESC) = 1) GROUP BY subject")
def latest_map(spark: SparkSession, d: str) -> DataFrame:
    """Latest values as one map per subject, by a pre-aggregating arg-max."""
    best = T.status_log(spark, d).groupBy("subject", "kind").agg(F.max_by("value", F.struct("logged_at", "record_id")).alias("value"))
    m = best.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("kind", "value"))).alias("m"))
    return m.select("subject", F.col("m")["click"].alias("click"), F.col("m")["view"].alias("view"), F.size("m").cast("long").alias("kinds"))


RANK_SQL = """WITH f AS (SELECT *, CASE WHEN count(DISTINCT area_ha) OVER p <= 1 THEN 1.0 ELSE (dense_rank() OVER (PARTITION BY sample_id ORDER BY area_ha) - 1) / CAST(count(DISTINCT area_ha) OVER p - 1 AS DOUBLE) END AS fa,
        CASE WHEN count(DISTINCT p_a) OVER p <= 1 THEN 1.0 ELSE (dense_rank() OVER (PARTITION BY sample_id ORDER BY p_a) - 1) / CAST(count(DISTINCT p_a) OVER p - 1 AS DOUBLE) END AS fp FROM obs WINDOW p AS (PARTITION BY sample_id)),
    s AS (SELECT *, round(fa * 0.6 + fp * 0.4, 9) AS score FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, area_ha DESC, event_year) AS rank FROM s)"""


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return O.composite_rank(T.events(spark, d), ["sample_id"], {"area_ha": 0.6, "p_a": 0.4}, [F.desc("area_ha"), F.col("event_year")])


@query("q_composite_ranking", RANK_SQL + " SELECT event_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r")
def composite_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).select("event_id", F.round("score", 6).alias("score"), "rank")


@query("q_ranking_metrics", RANK_SQL + """, t AS (SELECT sample_id, min(rank) AS r FROM r WHERE human_label = 'Wildfire' GROUP BY sample_id)
    SELECT count(*) AS points, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN r <= 2 THEN 1.0 ELSE 0.0 END), 6) AS hit_2, round(avg(1.0 / r), 6) AS mrr, quantile_cont(r, 0.5) AS median_rank FROM t""")  # fmt: skip
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return O.ranking_metrics(ranked(spark, d).withColumn("target", F.coalesce(F.col("human_label") == "Wildfire", F.lit(False))), ["sample_id"], "rank", "target")


@query("q_top_scenes", "SELECT sample_id, scene_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY cloud, shadow, scene_id) AS INTEGER) AS rank FROM scenes QUALIFY rank <= 3")
def top_scenes(spark: SparkSession, d: str) -> DataFrame:
    return S.top_per_group(T.scenes(spark, d), ["sample_id"], [F.col("cloud"), F.col("shadow"), F.col("scene_id")], 3).select("sample_id", "scene_id", "rank")


@query("q_promote_reserves", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY balance DESC, sample_id) AS rank FROM samples)
    SELECT region, sample_id, CASE WHEN rank <= 10 THEN 'SELECTED' WHEN rank <= 15 THEN 'RESERVE' END AS decision FROM r WHERE rank <= 15""")  # fmt: skip
def promote_reserves(spark: SparkSession, d: str) -> DataFrame:
    top = S.top_per_group(T.samples(spark, d), ["region"], [F.desc("balance"), F.col("sample_id")], 15)
    return top.select("region", "sample_id", F.when(F.col("rank") <= 10, "SELECTED").otherwise("RESERVE").alias("decision"))


@query("q_record_weights", "SELECT event_id, round(1.0 / count(*) OVER (PARTITION BY sample_id), 6) AS weight FROM obs")
def record_weights(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).select("event_id", F.round(1.0 / F.count(F.lit(1)).over(Window.partitionBy("sample_id")), 6).alias("weight"))


@query("q_transitions", "SELECT state, next_state, CAST(gap AS INTEGER) AS gap, count(*) AS n FROM (SELECT review_class AS state, lead(review_class) OVER w AS next_state, lead(event_year) OVER w - event_year AS gap FROM obs WINDOW w AS (PARTITION BY sample_id ORDER BY event_year)) WHERE next_state IS NOT NULL GROUP BY ALL")
def transitions(spark: SparkSession, d: str) -> DataFrame:
    return O.transitions(T.events(spark, d), "sample_id", ["event_year"], "review_class", "event_year")


@query("q_moving_average", """
    SELECT subject, record_id, round(CASE WHEN lag(value) OVER w IS NULL OR lead(value) OVER w IS NULL THEN value ELSE avg(value) OVER (PARTITION BY subject ORDER BY record_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS smooth
    FROM status_log WINDOW w AS (PARTITION BY subject ORDER BY record_id)""")  # fmt: skip
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    out = O.moving_average(T.status_log(spark, d), "subject", "record_id", "value", 2, "smooth")
    return out.select("subject", "record_id", F.round("smooth", 6).alias("smooth"))


@query("q_budget_split", """
    WITH s AS (SELECT sample_id, count(*) AS total FROM scenes GROUP BY sample_id), w AS (SELECT unnest(['spring', 'early_summer', 'summer', 'autumn']) AS season, unnest([2, 3, 3, 2]) AS weight, unnest([0, 1, 2, 3]) AS idx),
    x AS (SELECT sample_id, season, idx, weight, total, total * weight / CAST(10 AS DOUBLE) AS exact FROM s, w),
    y AS (SELECT *, floor(exact) AS whole, total - sum(floor(exact)) OVER (PARTITION BY sample_id) AS rest FROM x)
    SELECT sample_id, season, CAST(whole + CASE WHEN row_number() OVER (PARTITION BY sample_id ORDER BY round(exact - whole, 9) DESC, weight DESC, idx) <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM y""")  # fmt: skip
def budget_split(spark: SparkSession, d: str) -> DataFrame:
    """Each sample's budget over the four seasons by largest remainder."""
    seasons = F.array(*(F.struct(F.lit(n).alias("season"), F.lit(w).alias("weight"), F.lit(i).alias("idx")) for i, (n, w) in enumerate((("spring", 2), ("early_summer", 3), ("summer", 3), ("autumn", 2)))))
    s = T.scenes(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("total")).select("sample_id", "total", F.inline(seasons))
    return O.apportion(s, ["sample_id"], "total", "weight", "idx", "quota").select("sample_id", "season", "quota")


@query("q_bundle_parts", """
    WITH RECURSIVE f AS (SELECT source, doc_id, greatest(n_chars, 0) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL),
    g AS (SELECT source, doc_id, size, i, 0 AS part, size AS used FROM f WHERE i = 1
          UNION ALL SELECT f.source, f.doc_id, f.size, f.i, CASE WHEN g.used + f.size > 20000 THEN g.part + 1 ELSE g.part END, CASE WHEN g.used + f.size > 20000 THEN f.size ELSE g.used + f.size END FROM g JOIN f ON f.source = g.source AND f.i = g.i + 1)
    SELECT source, doc_id, size, CAST(part AS INTEGER) AS part FROM g""")  # fmt: skip
def bundle_parts(spark: SparkSession, d: str) -> DataFrame:
    """Next-fit packing of each source's files in order."""
    files = table(spark, d, "documents").filter("n_chars is not null and source is not null").select("source", "doc_id", F.greatest("n_chars", F.lit(0)).alias("size"))
    return P.next_fit(files, "source", ["doc_id"], "size", 20000)


@query("q_spaced_scenes")
def spaced_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Up to four scenes of a sample, clearest first, at least 60 days apart. Held against a sequential version in tests."""
    return P.spaced_picks(T.scenes(spark, d).select("sample_id", "cloud", "scene_id", "day"), "sample_id", ["cloud", "scene_id"], "day", 60, 4)


@query("q_operation_grid", """
    WITH y AS (SELECT DISTINCT sample_id, event_year FROM obs WHERE dominant), g AS (SELECT * FROM y, (SELECT unnest(['PRE', 'EVENT', 'POST']) AS period, unnest([-1, 0, 1]) AS step)),
    s AS (SELECT sample_id, CAST(year(day) AS INTEGER) AS y, count(*) AS n FROM scenes WHERE NOT excluded GROUP BY ALL)
    SELECT g.sample_id, g.period, coalesce(s.n, 0) AS valid, greatest(3 - coalesce(s.n, 0), 0) AS deficit FROM g LEFT JOIN s ON s.sample_id = g.sample_id AND s.y = g.event_year + g.step""")  # fmt: skip
def operation_grid(spark: SparkSession, d: str) -> DataFrame:
    """Dense grid of events and periods with counts and what is missing to three."""
    steps = F.array(*(F.struct(F.lit(p).alias("period"), F.lit(s).alias("step")) for p, s in (("PRE", -1), ("EVENT", 0), ("POST", 1))))
    g = T.events(spark, d).filter("dominant").select("sample_id", "event_year", F.inline(steps)).withColumn("y", F.col("event_year") + F.col("step"))
    s = T.scenes(spark, d).filter("not excluded").groupBy("sample_id", F.year("day").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return g.join(s, ["sample_id", "y"], "left").select("sample_id", "period", F.coalesce("n", F.lit(0)).cast("long").alias("valid"), F.greatest(3 - F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("deficit"))


@query("q_round_robin", "SELECT region, sample_id, CAST(turn AS INTEGER) AS turn FROM (SELECT region, sample_id, row_number() OVER (PARTITION BY region ORDER BY balance DESC, sample_id) AS turn FROM samples) WHERE turn <= 4")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return O.round_robin(T.samples(spark, d), "region", [F.desc("balance"), F.col("sample_id")]).filter("turn <= 4").select("region", "sample_id", "turn")


@query("q_ordered_distinct", "SELECT user_id, event_type, min(event_id) AS first_seen FROM events GROUP BY ALL")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_seen"))


@query("q_set_algebra", """
    WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0)
    SELECT 'both' AS part, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'left', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'right', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")  # fmt: skip
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    a, b = k.filter("k % 2 = 0"), k.filter("k % 3 = 0")
    named = lambda n, x: x.select(F.lit(n).alias("part"), "k")
    return named("both", a.intersect(b)).unionByName(named("left", a.subtract(b))).unionByName(named("right", b.subtract(a)))


@query("q_required_kinds", """
    SELECT user_id, count(DISTINCT event_type) AS kinds, len(list_filter(['click', 'view', 'purchase'], lambda x: NOT list_contains(list(DISTINCT event_type), x))) = 0 AS ready FROM events GROUP BY user_id""")  # fmt: skip
def required_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Which subjects have all required kinds."""
    need = F.array(*(F.lit(x) for x in ("click", "view", "purchase")))
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return g.select("user_id", F.size("s").cast("long").alias("kinds"), (F.size(F.array_except(need, "s")) == 0).alias("ready"))


UNIT_SQL = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings)"


def references(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", geo.unit(F.col("embedding")).alias("v"))


@query("q_class_centroids", f"WITH {UNIT_SQL}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean FROM x GROUP BY ALL")
def class_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each class's unit vectors, one row per component."""
    x = references(spark, d).select("label", F.posexplode("v").alias("i", "x"))
    return x.groupBy("label", (F.col("i") + 1).alias("i")).agg(F.round(F.avg("x"), 6).alias("mean"))


@query("q_class_similarity", f"""
    WITH {UNIT_SQL}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), s AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM u GROUP BY label)
    SELECT s.label, round((sum(s * s) - sum(q)) / (any_value(n.n) * (any_value(n.n) - 1)), 6) AS mean_similarity FROM s JOIN n USING (label) GROUP BY s.label""")  # fmt: skip
def class_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine over all pairs of a class, from component sums: no pairs are made."""
    u = references(spark, d)
    x = u.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    n = u.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q")).join(n, "label").select("label", F.round((F.col("ss") - F.col("q")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_similarity"))


@query("q_embedding_consistency", f"""
    WITH {UNIT_SQL}, x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), s AS (SELECT label, i, sum(x) AS s FROM x GROUP BY ALL), o AS (SELECT x.vec_id, x.x, s.s - x.x AS rest FROM x JOIN s USING (label, i))
    SELECT vec_id, round(sum(x * rest) / sqrt(sum(rest * rest)), 6) AS consistency FROM o GROUP BY vec_id""")  # fmt: skip
def embedding_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector to the mean of the others of its class."""
    x = references(spark, d).select("vec_id", "label", F.posexplode("v").alias("i", "x"))
    s = x.groupBy("label", "i").agg(F.sum("x").alias("s"))
    o = x.join(F.broadcast(s), ["label", "i"]) if s.limit(100_001).count() <= 100_000 else x.join(s, ["label", "i"])
    rest = F.col("s") - F.col("x")
    return o.groupBy("vec_id").agg(F.round(F.sum(F.col("x") * rest) / F.sqrt(F.sum(rest * rest)), 6).alias("consistency"))


KNN_SQL = f"WITH {UNIT_SQL}, p AS (SELECT q.vec_id, r.label AS label, q.label AS own, list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) AS s, r.vec_id AS other FROM u q JOIN u r ON q.vec_id <> r.vec_id AND q.vec_id % 25 = 0)"


def similarities(spark: SparkSession, d: str) -> DataFrame:
    """A stated set of query vectors (every 25th) against all others, in blocks; ten nearest and the best of each class come from one pass."""
    from fieldlens.operators.vectors import blocked_similarity

    u = references(spark, d)
    return blocked_similarity(u.filter("vec_id % 25 = 0"), u, "vec_id", "v", "label")


@query("q_knn_scores", KNN_SQL + ", r AS (SELECT vec_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS k FROM p) SELECT vec_id, round(avg(s) FILTER (k <= 3), 6) AS mean_3, round(avg(s) FILTER (k <= 5), 6) AS mean_5, round(avg(s) FILTER (k <= 10), 6) AS mean_10, round(max(s), 6) AS nearest FROM r GROUP BY vec_id")
def knn_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean similarity to the 3, 5 and 10 nearest others."""
    near = similarities(spark, d).filter("kind = 'near'")
    k = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("s"), "other"))
    mean = lambda n: F.round(F.avg(F.when(F.col("k") <= n, F.col("s"))), 6).alias(f"mean_{n}")
    return near.withColumn("k", k).groupBy("vec_id").agg(mean(3), mean(5), mean(10), F.round(F.max("s"), 6).alias("nearest"))


@query("q_class_margin", KNN_SQL + ", b AS (SELECT vec_id, label, max(s) AS s FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM b) SELECT vec_id, max(label) FILTER (k = 1) AS predicted, round(max(s) FILTER (k = 1) - max(s) FILTER (k = 2), 6) AS margin FROM r GROUP BY vec_id")
def class_margin(spark: SparkSession, d: str) -> DataFrame:
    """Nearest class by best similarity, and its lead over the second; ties to the smaller label."""
    best = similarities(spark, d).filter("kind = 'class'").groupBy("vec_id", "label").agg(F.max("s").alias("s"))
    k = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("s"), "label"))
    top = lambda n, c: F.max(F.when(F.col("k") == n, F.col(c)))
    return best.withColumn("k", k).groupBy("vec_id").agg(top(1, "label").alias("predicted"), F.round(top(1, "s") - top(2, "s"), 6).alias("margin"))


@query("q_rank_correlation", "WITH r AS (SELECT avg(rank) OVER (PARTITION BY area_ha) AS ra, avg(rank2) OVER (PARTITION BY p_a) AS rp FROM (SELECT area_ha, p_a, row_number() OVER (ORDER BY area_ha) AS rank, row_number() OVER (ORDER BY p_a) AS rank2 FROM obs)) SELECT round(corr(ra, rp), 6) AS spearman FROM r")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Spearman correlation by average ranks, which come from counts per distinct value."""
    e = T.events(spark, d).select("area_ha", "p_a")

    def ranks(c: str) -> DataFrame:
        n = running_totals(e.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, {"upto": "n"})
        return n.select(F.col(c).alias(f"k_{c}"), (F.col("upto") - (F.col("n") - 1) / 2.0).alias(f"r_{c}"))

    a, p = ranks("area_ha"), ranks("p_a")
    return e.join(a, F.col("area_ha") == F.col("k_area_ha")).join(p, F.col("p_a") == F.col("k_p_a")).agg(F.round(F.corr("r_area_ha", "r_p_a"), 6).alias("spearman"))
