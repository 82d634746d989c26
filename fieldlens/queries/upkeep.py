"""Queries that keep an observation store in order: caches, masks, links, notes, imports and research cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.operators import ordered as O
from fieldlens.operators import reconcile as R
from fieldlens.operators import select as S
from fieldlens.plans.tables import table
from fieldlens.queries.joins import LINKS, links
from fieldlens.queries.learning import DRAW
from fieldlens.registry import query
from fieldlens.sources import standins as T


def counted() -> Column:
    return F.count(F.lit(1)).alias("n")


@query("q_enriched_events", """
    WITH b AS (SELECT event_id, count(*) AS n, count(*) FILTER (cloud > 0.08 OR excluded) AS bad FROM (SELECT e.event_id, s.cloud, s.excluded FROM obs e JOIN scenes s ON s.sample_id = e.sample_id AND year(s.day) = e.event_year) GROUP BY event_id)
    SELECT event_id, round(ln(1 + greatest(area_ha, 0)), 9) AS log_area, round(CASE WHEN pixels > 1 THEN (p_a + p_b) / 2 ELSE p_b END, 9) AS mean_probability, round(b.bad / CAST(b.n AS DOUBLE), 9) AS bad_share FROM obs LEFT JOIN b USING (event_id)""")  # fmt: skip
def enriched_events(spark: SparkSession, d: str) -> DataFrame:
    """Logarithm of the area, mean of the probabilities that are known, and the share of bad scenes (null without scenes)."""
    e = T.events(spark, d)
    bad = (F.col("cloud") > 0.08) | F.col("excluded")
    per = T.scenes(spark, d).groupBy("sample_id", F.year("day").alias("event_year")).agg(F.count(F.lit(1)).alias("scenes"), F.count_if(bad).alias("bad"))
    known = F.filter(F.array(F.when(F.col("pixels") > 1, F.col("p_a")), F.col("p_b")), lambda p: p.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, p: a + p) / F.size(known)
    return e.join(per, ["sample_id", "event_year"], "left").select("event_id", F.round(F.log1p(F.greatest("area_ha", F.lit(0.0))), 9).alias("log_area"), F.round(mean, 9).alias("mean_probability"), F.round(F.try_divide("bad", "scenes"), 9).alias("bad_share"))


@query("q_mismatch_research", """
    WITH m AS (SELECT DISTINCT sample_id FROM obs WHERE review_class = 'YEAR_MISMATCH'),
    r AS (SELECT sample_id, review_status, row_number() OVER (PARTITION BY sample_id ORDER BY area_ha DESC, event_year) AS k FROM obs SEMI JOIN m USING (sample_id)),
    f AS (SELECT sample_id, min(k) AS k FROM r WHERE review_status = 'VALID' GROUP BY sample_id),
    s AS (SELECT count(*) AS points, avg(CAST(k <= 1 AS INTEGER)) AS h, avg(1.0 / k) AS m FROM f)
    SELECT points, round(h, 6) AS hit_1, round(m, 6) AS mrr, CASE WHEN h >= 0.75 AND m >= 0.85 THEN 'SUPPORTED' WHEN h >= 0.4 THEN 'PARTIAL' ELSE 'NOT_SUPPORTED' END AS hypothesis FROM s""")  # fmt: skip
def mismatch_research(spark: SparkSession, d: str) -> DataFrame:
    """Of points with a mismatched year: does the largest event of a point hold its valid one?"""
    e = T.events(spark, d)
    concerned = e.filter("review_class = 'YEAR_MISMATCH'").select("sample_id").distinct()
    ranked = e.join(concerned, "sample_id", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("area_ha"), "event_year")))
    first = ranked.filter("review_status = 'VALID'").groupBy("sample_id").agg(F.min("k").alias("k"))
    s = first.agg(F.count(F.lit(1)).alias("points"), F.avg((F.col("k") <= 1).cast("int")).alias("h"), F.avg(1.0 / F.col("k")).alias("m"))
    verdict = F.when((F.col("h") >= 0.75) & (F.col("m") >= 0.85), "SUPPORTED").when(F.col("h") >= 0.4, "PARTIAL").otherwise("NOT_SUPPORTED")
    return s.select("points", F.round("h", 6).alias("hit_1"), F.round("m", 6).alias("mrr"), verdict.alias("hypothesis"))


@query("q_mismatch_offsets", """
    WITH m AS (SELECT sample_id, event_year, CASE sample_id % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS shift FROM obs WHERE review_class = 'YEAR_MISMATCH')
    SELECT coalesce(CAST(shift AS VARCHAR), 'unknown') AS shift, coalesce(o.review_class, 'ABSENT') AS found, count(*) AS n
    FROM m LEFT JOIN obs o ON o.sample_id = m.sample_id AND o.event_year = m.event_year + m.shift GROUP BY ALL""")  # fmt: skip
def mismatch_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where a mismatched event's inferred year leads: its offset (null as unknown) and the class of the point's event there."""
    e = T.events(spark, d)
    k = F.col("sample_id") % 4
    m = e.filter("review_class = 'YEAR_MISMATCH'").select("sample_id", "event_year", F.when(k == 0, -1).when(k == 1, 1).when(k == 2, 0).alias("shift"))
    there = e.select(F.col("sample_id").alias("s"), F.col("event_year").alias("y"), "review_class")
    joined = m.join(there, (F.col("sample_id") == F.col("s")) & (F.col("event_year") + F.col("shift") == F.col("y")), "left")
    return joined.groupBy(F.coalesce(F.col("shift").cast("string"), F.lit("unknown")).alias("shift"), F.coalesce("review_class", F.lit("ABSENT")).alias("found")).agg(counted())


def wildfire_probability(scores: Column, label: Column, confidence: Column) -> Column:
    """From a map of scores in any of three spellings, else from label and confidence, else null."""
    spelled = [F.try_element_at(scores, F.lit(k)) for k in ("Wildfire", "wildfire", "WILDFIRE")]
    return F.coalesce(*spelled, F.when(label == "Wildfire", confidence).when(label == "Logging", 1.0 - confidence))


@query("q_label_probability", "SELECT event_id, round(CASE WHEN sample_id % 5 < 3 THEN p_a WHEN sample_id % 5 = 3 THEN CASE label_b WHEN 'Wildfire' THEN p_b ELSE 1.0 - p_b END END, 9) AS p FROM obs")
def label_probability(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("sample_id") % 5
    scores = F.create_map(F.when(k == 0, "Wildfire").when(k == 1, "wildfire").when(k == 2, "WILDFIRE").otherwise("none"), F.col("p_a"))
    label = F.when(k == 3, F.col("label_b"))
    return T.events(spark, d).select("event_id", F.round(wildfire_probability(scores, label, F.col("p_b")), 9).alias("p"))


@query("q_latest_masks", "SELECT subject, record_id, value FROM status_log WHERE kind = 'view' AND value > 5 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY logged_at DESC, record_id DESC) = 1")
def latest_masks(spark: SparkSession, d: str) -> DataFrame:
    """The newest mask of each subject among those whose file exists (here: a value above 5)."""
    masks = T.status_log(spark, d).filter("kind = 'view' and value > 5")
    return masks.groupBy("subject").agg(F.max_by(F.struct("record_id", "value"), F.struct("logged_at", "record_id")).alias("m")).select("subject", "m.record_id", "m.value")


@query("q_matrix_report", """
    SELECT label, count(*) AS n, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim, count(*) FILTER (z = 0) AS zero_rows, round(min(sqrt(z)), 4) AS least_norm, round(max(sqrt(z)), 4) AS most_norm
    FROM (SELECT label, embedding, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS z FROM embeddings) GROUP BY label""")  # fmt: skip
def matrix_report(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a feature matrix before learning: sizes, zero rows and norms of each class."""
    z = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = table(spark, d, "embeddings").select("label", F.size("embedding").cast("long").alias("dim"), z.alias("z"))
    return v.groupBy("label").agg(counted(), F.min("dim").alias("least_dim"), F.max("dim").alias("most_dim"), F.count_if(F.col("z") == 0).alias("zero_rows"), F.round(F.min(F.sqrt("z")), 4).alias("least_norm"), F.round(F.max(F.sqrt("z")), 4).alias("most_norm"))


@query("q_event_spectra", f"""
    SELECT event_id, CASE WHEN pre = 0 AND post = 0 THEN 'NO_SCENES' WHEN pre = 0 THEN 'NO_PRE' WHEN post = 0 THEN 'NO_POST' ELSE 'COMPLETE' END AS status, a AS pre_median, b AS post_median, round(b - a, 6) AS delta
    FROM (SELECT event_id, count(*) FILTER (ok AND period = 'PRE') AS pre, count(*) FILTER (ok AND period = 'POST') AS post, quantile_cont(brightness, 0.5) FILTER (ok AND period = 'PRE') AS a, quantile_cont(brightness, 0.5) FILTER (ok AND period = 'POST') AS b
          FROM (SELECT *, NOT excluded AND cloud < 0.08 AS ok FROM ({LINKS})) GROUP BY event_id)""")  # fmt: skip
def event_spectra(spark: SparkSession, d: str) -> DataFrame:
    """Medians before and after of each event's usable scenes; events that lack a side say which."""
    ok = ~F.col("excluded") & (F.col("cloud") < 0.08)
    side = lambda p: F.when(ok & (F.col("period") == p), F.col("brightness"))
    g = links(spark, d).groupBy("event_id").agg(F.count(side("PRE")).alias("pre"), F.count(side("POST")).alias("post"), F.percentile(side("PRE"), 0.5).alias("pre_median"), F.percentile(side("POST"), 0.5).alias("post_median"))
    status = F.when((F.col("pre") == 0) & (F.col("post") == 0), "NO_SCENES").when(F.col("pre") == 0, "NO_PRE").when(F.col("post") == 0, "NO_POST").otherwise("COMPLETE")
    return g.select("event_id", status.alias("status"), "pre_median", "post_median", F.round(F.col("post_median") - F.col("pre_median"), 6).alias("delta"))


@query("q_migration_check", """
    WITH w AS (SELECT sample_id, CASE WHEN sample_id % 10 = 0 THEN 'migrated' ELSE driver END AS driver FROM samples WHERE sample_id % 7 <> 0)
    SELECT CAST(1 AS INTEGER) AS pass, (SELECT count(*) FROM samples s JOIN w USING (sample_id) WHERE s.driver <> w.driver) AS changes UNION ALL SELECT CAST(2 AS INTEGER), 0""")  # fmt: skip
def migration_check(spark: SparkSession, d: str) -> DataFrame:
    """A migration applied twice to a copy: the second pass must find nothing to change."""
    now = T.samples(spark, d).select("sample_id", "driver")
    wanted = now.filter("sample_id % 7 <> 0").withColumn("driver", F.when(F.col("sample_id") % 10 == 0, "migrated").otherwise(F.col("driver")))
    count = lambda current, n: R.sync(current, wanted, ["sample_id"], ["driver"]).agg(F.count_if(F.col("action").isin("INSERT", "UPDATE")).alias("changes")).select(F.lit(n).alias("pass"), "changes")
    return count(now, 1).unionByName(count(R.upsert(now, wanted, ["sample_id"]), 2))


@query("q_cohort_dynamics", """
    WITH b AS (SELECT event_id FROM obs WHERE event_year < 1996), c AS (SELECT * FROM obs WHERE event_year >= 1994)
    SELECT cohort, review_class, count(*) AS n FROM (
        SELECT 'BASELINE' AS cohort, review_class FROM obs SEMI JOIN b USING (event_id) UNION ALL SELECT 'CURRENT', review_class FROM c
        UNION ALL SELECT 'ADDED', review_class FROM c ANTI JOIN b USING (event_id) UNION ALL SELECT 'KEPT', review_class FROM c SEMI JOIN b USING (event_id)) GROUP BY ALL""")  # fmt: skip
def cohort_dynamics(spark: SparkSession, d: str) -> DataFrame:
    """Classes of the baseline, of what is there now, of what was added and of what stayed, told apart by event ids alone."""
    e = T.events(spark, d)
    base = e.filter("event_year < 1996").select("event_id")
    now = e.filter("event_year >= 1994")
    parts = {"BASELINE": e.join(base, "event_id", "left_semi"), "CURRENT": now, "ADDED": now.join(base, "event_id", "left_anti"), "KEPT": now.join(base, "event_id", "left_semi")}
    tables = [df.groupBy("review_class").agg(counted()).select(F.lit(name).alias("cohort"), "review_class", "n") for name, df in parts.items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3])


@query("q_sample_events", f"""
    WITH l AS (SELECT event_id, count(*) FILTER (period = 'PRE') AS pre, count(*) FILTER (period = 'EVENT') AS event, count(*) FILTER (period = 'POST') AS post FROM ({LINKS}) GROUP BY event_id)
    SELECT o.event_id, review_status, coalesce(pre, 0) AS pre, coalesce(event, 0) AS event, coalesce(post, 0) AS post FROM obs o LEFT JOIN l USING (event_id)""")  # fmt: skip
def sample_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event with its number of linked scenes in each period and its review state."""
    periods = {"PRE": "pre", "EVENT": "event", "POST": "post"}
    counts = links(spark, d).groupBy("event_id").pivot("period", list(periods)).count()
    joined = T.events(spark, d).select("event_id", "review_status").join(counts, "event_id", "left")
    return joined.select("event_id", "review_status", *(F.coalesce(p, F.lit(0)).cast("long").alias(c) for p, c in periods.items()))


@query("q_preferred_versions", """
    SELECT subject, record_id, kind FROM status_log WHERE value >= 1 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY kind <> 'click', logged_at DESC, record_id DESC) = 1""")  # fmt: skip
def preferred_versions(spark: SparkSession, d: str) -> DataFrame:
    """One source for each subject: the wanted version if there is one, else the newest, among those whose file exists."""
    there = T.status_log(spark, d).filter("value >= 1")
    best = F.max_by(F.struct("record_id", "kind"), F.struct(F.col("kind") == "click", "logged_at", "record_id"))
    return there.groupBy("subject").agg(best.alias("b")).select("subject", "b.record_id", "b.kind")


@query("q_fallback_source", """
    WITH t AS (SELECT subject, arg_max(record_id, (logged_at, record_id)) FILTER (kind = 'signup' AND value > 40) AS a, arg_max(record_id, (logged_at, record_id)) FILTER (kind = 'view') AS b, arg_max(record_id, (logged_at, record_id)) AS c FROM status_log GROUP BY subject)
    SELECT subject, coalesce(a, b, c) AS record_id, CASE WHEN a IS NOT NULL THEN 'canonical' WHEN b IS NOT NULL THEN 'registered' ELSE 'on_disk' END AS origin FROM t""")  # fmt: skip
def fallback_source(spark: SparkSession, d: str) -> DataFrame:
    """Three levels of fallback in one aggregation: the canonical file, the newest registered one, the newest of all."""
    newest = lambda cond: F.max_by(F.when(cond, F.col("record_id")), F.when(cond, F.struct("logged_at", "record_id")))
    levels = {"canonical": (F.col("kind") == "signup") & (F.col("value") > 40), "registered": F.col("kind") == "view", "on_disk": F.lit(True)}
    t = T.status_log(spark, d).groupBy("subject").agg(*(newest(c).alias(k) for k, c in levels.items()))
    origin = F.when(F.col("canonical").isNotNull(), "canonical").when(F.col("registered").isNotNull(), "registered").otherwise("on_disk")
    return t.select("subject", F.coalesce(*levels).alias("record_id"), origin.alias("origin"))


@query("q_masks_to_create", """
    WITH ready AS (SELECT subject FROM status_log WHERE kind IN ('view', 'click', 'signup') GROUP BY subject HAVING count(DISTINCT kind) = 3)
    SELECT CASE WHEN r.subject IS NULL THEN 'create' ELSE 'ready' END AS action, count(*) AS n FROM samples s LEFT JOIN ready r ON r.subject = s.sample_id GROUP BY ALL""")  # fmt: skip
def masks_to_create(spark: SparkSession, d: str) -> DataFrame:
    """Samples that lack a mask of any required kind are to be made, the others are ready."""
    required = F.array(*(F.lit(k) for k in ("view", "click", "signup")))
    kinds = T.status_log(spark, d).groupBy("subject").agg(F.collect_set("kind").alias("kinds"))  # few kinds by nature
    ready = kinds.filter(F.size(F.array_except(required, "kinds")) == 0).select(F.col("subject").alias("sample_id"))
    s = T.samples(spark, d).select("sample_id")
    todo, done = s.join(ready, "sample_id", "left_anti"), s.join(ready, "sample_id", "left_semi")
    both = todo.withColumn("action", F.lit("create")).unionByName(done.withColumn("action", F.lit("ready")))
    return both.groupBy("action").agg(counted())


@query("q_auto_exclusions", """
    WITH reviewed AS (SELECT scene_id, flag FROM scenes WHERE flag <> 'N'), auto AS (SELECT scene_id, 'A' AS flag FROM scenes WHERE cloud > 0.08)
    SELECT flag, count(*) AS n FROM (SELECT flag FROM reviewed UNION ALL SELECT flag FROM auto ANTI JOIN reviewed USING (scene_id)) GROUP BY flag""")  # fmt: skip
def auto_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Reviews after an automatic pass that adds exclusions above a threshold and never touches a review that is there."""
    s = T.scenes(spark, d)
    reviewed = s.filter("flag <> 'N'").select("scene_id", "flag")
    auto = s.filter("cloud > 0.08").select("scene_id", F.lit("A").alias("flag"))
    return reviewed.unionByName(R.insert_missing(reviewed, auto, ["scene_id"])).groupBy("flag").agg(counted())


PRIORITY = ("NODATA", "CLOUD", "SHADOW", "DARK")


@query("q_primary_reason", """
    SELECT coalesce(r[1], 'NONE') AS primary_reason, len(r) AS reasons, count(*) AS n FROM (
        SELECT list_filter([CASE WHEN quantity < 3 THEN 'NODATA' END, CASE WHEN cloud > 0.08 THEN 'CLOUD' END, CASE WHEN shadow > 0.06 THEN 'SHADOW' END, CASE WHEN brightness < 5000 THEN 'DARK' END], lambda x: x IS NOT NULL) AS r FROM scenes) GROUP BY ALL""")  # fmt: skip
def primary_reason(spark: SparkSession, d: str) -> DataFrame:
    """Automatic reasons in a fixed order, the first of which is the primary one."""
    found = S.reasons(DARK=F.col("brightness") < 5000, SHADOW=F.col("shadow") > 0.06, CLOUD=F.col("cloud") > 0.08, NODATA=F.col("quantity") < 3)
    ordered = F.array_intersect(F.array(*(F.lit(p) for p in PRIORITY)), found)
    rows = T.scenes(spark, d).select(ordered.alias("r"))
    return rows.groupBy(F.coalesce(F.try_element_at("r", F.lit(1)), F.lit("NONE")).alias("primary_reason"), F.size("r").cast("long").alias("reasons")).agg(counted())


@query("q_review_input_check", """
    SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN kind = 'error' AND value < 5 THEN 'CODES_REQUIRED' WHEN kind = 'view' AND value < 20 THEN 'TEXT_REQUIRED' WHEN kind IN ('click', 'signup') THEN 'CLEARED' ELSE 'OK' END AS verdict FROM status_log) GROUP BY verdict""")  # fmt: skip
def review_input_check(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a review before it is stored: an exclusion needs codes, OTHER needs a text, and a review that excludes nothing clears them."""
    log = T.status_log(spark, d)
    excluded = ~F.col("kind").isin("click", "signup")
    codes = F.when(F.col("kind") == "error", F.when(F.col("value") >= 5, F.array(F.lit("CLOUD"))).otherwise(F.array().cast("array<string>"))).when(F.col("kind") == "view", F.array(F.lit("OTHER"))).otherwise(F.array(F.lit("DARK")))
    text = F.when(F.col("value") >= 20, "seen")
    verdict = F.when(~excluded, "CLEARED").when(F.size(codes) == 0, "CODES_REQUIRED").when(F.array_contains(codes, "OTHER") & text.isNull(), "TEXT_REQUIRED").otherwise("OK")
    return log.groupBy(verdict.alias("verdict")).agg(counted())


@query("q_flag_upsert", """
    WITH last AS (SELECT subject AS sample_id, arg_max(kind, (logged_at, record_id)) AS driver FROM status_log GROUP BY subject)
    SELECT s.sample_id, coalesce(l.driver, s.driver) AS driver, CASE WHEN l.driver IS NULL THEN 'UNREVIEWED' ELSE 'MANUAL' END AS status FROM samples s LEFT JOIN last l USING (sample_id)""")  # fmt: skip
def flag_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The newest decision of each sample replaces its row and is mirrored in its status."""
    s = T.samples(spark, d).select("sample_id", "driver").withColumn("status", F.lit("UNREVIEWED"))
    last = T.status_log(spark, d).groupBy(F.col("subject").alias("sample_id")).agg(F.max_by("kind", F.struct("logged_at", "record_id")).alias("driver")).withColumn("status", F.lit("MANUAL"))
    return R.upsert(s, last.join(s.select("sample_id"), "sample_id", "left_semi"), ["sample_id"])


@query("q_period_search", """
    WITH p AS (SELECT * FROM (VALUES ('PRE', DATE '1994-04-01', DATE '1994-09-30'), ('EVENT', DATE '1995-04-01', DATE '1995-09-30'), ('POST', DATE '1996-04-01', DATE '1996-09-30')) AS p(period, low, high))
    SELECT sample_id, period, scene_id FROM scenes JOIN p ON day BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY sample_id, period ORDER BY cloud, scene_id) <= 2""")  # fmt: skip
def period_search(spark: SparkSession, d: str) -> DataFrame:
    """The clearest scenes of each sample in each of three search periods."""
    windows = (("PRE", "1994-04-01", "1994-09-30"), ("EVENT", "1995-04-01", "1995-09-30"), ("POST", "1996-04-01", "1996-09-30"))
    period = F.coalesce(*(F.when(F.col("day").between(F.to_date(F.lit(a)), F.to_date(F.lit(b))), F.lit(p)) for p, a, b in windows))
    found = T.scenes(spark, d).withColumn("period", period).filter("period is not null")
    return S.top_per_group(found, ["sample_id", "period"], [F.col("cloud"), F.col("scene_id")], 2).select("sample_id", "period", "scene_id")


#: What a store lists, and what the disk holds, of one bundle's files.
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """path, size as registered; null paths stand for rows that were never stored."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    path = F.when(k % 11 != 0, F.concat(F.when(k % 13 == 0, F.lit("old/")).when(k % 17 == 0, F.lit("/elsewhere/")).otherwise(F.lit("cache/")), k.cast("string"), F.lit(".tif")))
    return p.select(k.alias("id"), path.alias("path"), (k * 3 + 10).alias("size"))


def listing(spark: SparkSession, d: str) -> DataFrame:
    """file, bytes as found on disk: some files are missing, some have another size, some nobody registered."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    return p.filter(k % 5 != 0).select(F.concat(F.lit("cache/"), F.when(k % 19 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")), F.lit(".tif")).alias("file"), (k * 3 + F.when(k % 7 == 0, 11).otherwise(10)).alias("bytes"))


FILES = """man AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 13 = 0 THEN 'old/' WHEN p_partkey % 17 = 0 THEN '/elsewhere/' ELSE 'cache/' END || p_partkey || '.tif' END AS path, p_partkey * 3 + 10 AS size FROM part),
    disk AS (SELECT 'cache/' || CASE WHEN p_partkey % 19 = 0 THEN 'x' ELSE '' END || p_partkey || '.tif' AS file, p_partkey * 3 + CASE WHEN p_partkey % 7 = 0 THEN 11 ELSE 10 END AS bytes FROM part WHERE p_partkey % 5 <> 0)"""


@query("q_path_status", f"""
    WITH {FILES} SELECT status, count(*) AS n FROM (SELECT CASE WHEN path IS NULL THEN 'missing_path' WHEN path LIKE '/%' THEN 'path_outside_cache' WHEN d.file IS NOT NULL THEN 'ok' WHEN e.file IS NOT NULL THEN 'stored_path_mismatch' ELSE 'missing_file' END AS status
        FROM man m LEFT JOIN disk d ON d.file = m.path LEFT JOIN disk e ON e.file = 'cache/' || parse_filename(m.path)) GROUP BY status""")  # fmt: skip
def path_status(spark: SparkSession, d: str) -> DataFrame:
    """Every registered file: there, elsewhere in the cache, gone, never stored or outside."""
    disk = listing(spark, d).select("file")
    m = manifest(spark, d).withColumn("home", F.concat(F.lit("cache/"), F.substring_index("path", "/", -1)))
    found = m.join(disk.select(F.col("file").alias("f1")), F.col("path") == F.col("f1"), "left").join(disk.select(F.col("file").alias("f2")), F.col("home") == F.col("f2"), "left")
    status = F.when(F.col("path").isNull(), "missing_path").when(F.col("path").startswith("/"), "path_outside_cache").when(F.col("f1").isNotNull(), "ok").when(F.col("f2").isNotNull(), "stored_path_mismatch").otherwise("missing_file")
    return found.groupBy(status.alias("status")).agg(counted())


@query("q_bundle_check", f"""
    WITH {FILES} SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN path IS NULL THEN 'EXTRA' WHEN file IS NULL THEN 'MISSING' WHEN size <> bytes THEN 'SIZE_MISMATCH' ELSE 'OK' END AS verdict
        FROM (SELECT * FROM man WHERE path IS NOT NULL) FULL JOIN disk ON file = path) GROUP BY verdict""")  # fmt: skip
def bundle_check(spark: SparkSession, d: str) -> DataFrame:
    """A bundle's manifest against the files that came with it."""
    joined = manifest(spark, d).filter("path is not null").join(listing(spark, d), F.col("path") == F.col("file"), "full_outer")
    verdict = F.when(F.col("path").isNull(), "EXTRA").when(F.col("file").isNull(), "MISSING").when(F.col("size") != F.col("bytes"), "SIZE_MISMATCH").otherwise("OK")
    return joined.groupBy(verdict.alias("verdict")).agg(counted())


@query("q_prefetch_plan", """
    SELECT action, count(*) AS n FROM (SELECT 'would_' || CASE WHEN excluded THEN 'skip_excluded' WHEN quantity < 3 THEN 'skip_no_area' WHEN cloud > 0.09 THEN 'skip_cloudy' WHEN status = 'F' AND brightness < 5000 THEN 'refresh_preview' WHEN status = 'F' THEN 'keep' WHEN shadow > 0.07 THEN 'download_low_priority' ELSE 'download' END AS action FROM scenes) GROUP BY action""")  # fmt: skip
def prefetch_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a dry run would do with each scene: the first step of a ladder that applies."""
    here = F.col("status") == "F"
    ladder = F.when(F.col("excluded"), "skip_excluded").when(F.col("quantity") < 3, "skip_no_area").when(F.col("cloud") > 0.09, "skip_cloudy").when(here & (F.col("brightness") < 5000), "refresh_preview").when(here, "keep").when(F.col("shadow") > 0.07, "download_low_priority").otherwise("download")
    return T.scenes(spark, d).groupBy(F.concat(F.lit("would_"), ladder).alias("action")).agg(counted())


@query("q_rebuild_reasons", """
    WITH m AS (SELECT subject, count(*) AS masks, list_sort(list(record_id) FILTER (value < 10))[1:8] AS missing FROM status_log WHERE kind = 'view' GROUP BY subject), a AS (SELECT DISTINCT subject FROM status_log WHERE kind = 'purchase')
    SELECT sample_id, CASE WHEN a.subject IS NULL THEN 'no_analysis' WHEN masks IS NULL THEN 'no_masks' WHEN len(missing) > 0 THEN 'missing_tif' ELSE 'ok' END AS reason, coalesce(array_to_string(missing, ','), '') AS missing
    FROM samples LEFT JOIN a ON a.subject = sample_id LEFT JOIN m ON m.subject = sample_id""")  # fmt: skip
def rebuild_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a sample's masks must be made again, with up to eight of the files it lacks (the report's length)."""
    log = T.status_log(spark, d)
    # the eight smallest ids are found by rank, so no list grows with the log
    views = log.filter("kind = 'view'").withColumn("k", F.when(F.col("value") < 10, F.row_number().over(Window.partitionBy("subject", F.col("value") < 10).orderBy("record_id"))))
    masks = views.groupBy("subject").agg(F.count(F.lit(1)).alias("masks"), F.array_sort(F.collect_list(F.when(F.col("k") <= 8, F.col("record_id")))).alias("missing"))
    analysed = log.filter("kind = 'purchase'").select(F.col("subject").alias("a")).distinct()
    j = T.samples(spark, d).select("sample_id").join(analysed, F.col("sample_id") == F.col("a"), "left").join(masks, F.col("sample_id") == F.col("subject"), "left")
    reason = F.when(F.col("a").isNull(), "no_analysis").when(F.col("masks").isNull(), "no_masks").when(F.size("missing") > 0, "missing_tif").otherwise("ok")
    return j.select("sample_id", reason.alias("reason"), F.coalesce(F.array_join(F.col("missing").cast("array<string>"), ","), F.lit("")).alias("missing"))


@query("q_path_repairs", f"""
    WITH {FILES}, j AS (SELECT m.*, d.bytes FROM man m LEFT JOIN disk d ON parse_filename(d.file) = parse_filename(m.path)),
    a AS (SELECT unnest(list_filter([CASE WHEN path IS NOT NULL AND bytes IS NOT NULL AND path NOT LIKE 'cache/%' THEN 'repair_path' END, CASE WHEN bytes <> size THEN 'repair_size' END, CASE WHEN path IS NOT NULL AND bytes IS NULL THEN 'mark_missing' END, CASE WHEN path IS NULL THEN 'skip' END], lambda x: x IS NOT NULL)) AS action FROM j)
    SELECT action, count(*) AS n FROM a GROUP BY action""")  # fmt: skip
def path_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Files found again by name; a row may need several repairs, each of which counts."""
    disk = listing(spark, d).select(F.substring_index("file", "/", -1).alias("found"), "bytes")
    j = manifest(spark, d).withColumn("name", F.substring_index("path", "/", -1)).join(disk, F.col("name") == F.col("found"), "left")
    has, there = F.col("path").isNotNull(), F.col("bytes").isNotNull()
    actions = S.reasons(repair_path=has & there & ~F.col("path").startswith("cache/"), repair_size=F.col("bytes") != F.col("size"), mark_missing=has & ~there, skip=~has)
    return j.select(F.explode(actions).alias("action")).groupBy("action").agg(counted())


def operation(entity: str, key: Column, action: Column | str, detail: Column) -> list[Column]:
    """The common columns of every list of operations: op_id, entity, key, action, detail."""
    action = F.lit(action) if isinstance(action, str) else action
    return [F.concat_ws(":", F.lit(entity), key.cast("string"), action).alias("op_id"), F.lit(entity).alias("entity"), key.cast("string").alias("key"), action.alias("action"), detail.cast("string").alias("detail")]


@query("q_import_all_operations", """
    WITH j AS (SELECT o_orderkey, o_custkey, c_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = o_custkey)
    SELECT entity || ':' || key || ':' || action AS op_id, entity, key, action, detail FROM (
        SELECT 'scene' AS entity, o_orderkey::VARCHAR AS key, CASE WHEN c_custkey IS NULL THEN 'SKIP_NO_SAMPLE' ELSE 'INSERT' END AS action, o_custkey::VARCHAR AS detail FROM j
        UNION ALL SELECT 'preview', o_orderkey || '-' || v, 'INSERT', v FROM j, (SELECT unnest(['rgb', 'nbr']) AS v) WHERE c_custkey IS NOT NULL)""")  # fmt: skip
def import_all_operations(spark: SparkSession, d: str) -> DataFrame:
    """The operations of all orders."""
    return imported(spark, d, table(spark, d, "orders"))


def imported(spark: SparkSession, d: str, orders: DataFrame) -> DataFrame:
    """Scenes to import, each only if its sample is there, with their nested previews as operations of their own."""
    known = table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("c"))
    incoming = orders.join(known, F.col("o_custkey") == F.col("c"), "left")
    scene = incoming.select(*operation("scene", F.col("o_orderkey"), F.when(F.col("c").isNull(), "SKIP_NO_SAMPLE").otherwise("INSERT"), F.col("o_custkey")))
    previews = incoming.filter("c is not null").select("o_orderkey", F.explode(F.array(F.lit("rgb"), F.lit("nbr"))).alias("v"))
    return scene.unionByName(previews.select(*operation("preview", F.concat_ws("-", F.col("o_orderkey").cast("string"), "v"), "INSERT", F.col("v"))))


@query("q_cache_diagnostics", """
    WITH want AS (SELECT sample_id, v FROM samples, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS v))
    SELECT sample_id, string_agg(v, ',' ORDER BY v) AS missing_views, CAST(count(*) AS INTEGER) AS n FROM want ANTI JOIN (SELECT DISTINCT subject AS sample_id, kind AS v FROM status_log) USING (sample_id, v) GROUP BY sample_id""")  # fmt: skip
def cache_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Samples with the views their cache lacks."""
    views = ("click", "error", "purchase", "signup", "view")
    want = T.samples(spark, d).select("sample_id", F.explode(F.array(*(F.lit(v) for v in views))).alias("v"))
    have = T.status_log(spark, d).select(F.col("subject").alias("sample_id"), F.col("kind").alias("v")).distinct()
    missing = want.join(have, ["sample_id", "v"], "left_anti").groupBy("sample_id").agg(F.array_sort(F.collect_list("v")).alias("m"))
    return missing.select("sample_id", F.array_join("m", ",").alias("missing_views"), F.size("m").alias("n"))


@query("q_cached_views", """
    SELECT subject, CASE WHEN n = 5 THEN 'complete' WHEN n = 0 THEN 'empty' ELSE 'partial' END AS status, 5 - n AS missing FROM (SELECT subject, CAST(count(DISTINCT kind) FILTER (value > 2) AS INTEGER) AS n FROM status_log GROUP BY subject)""")  # fmt: skip
def cached_views(spark: SparkSession, d: str) -> DataFrame:
    """Expected against cached views of each subject."""
    expected = F.array(*(F.lit(v) for v in ("click", "error", "purchase", "signup", "view")))
    have = T.status_log(spark, d).groupBy("subject").agg(F.collect_set(F.when(F.col("value") > 2, F.col("kind"))).alias("have"))
    missing = F.size(F.array_except(expected, "have"))
    return have.select("subject", F.when(missing == 0, "complete").when(missing == 5, "empty").otherwise("partial").alias("status"), missing.alias("missing"))


@query("q_link_snapshot", "SELECT event_id, area_ha, review_status FROM obs SEMI JOIN (SELECT sample_id FROM samples WHERE driver = 'MACHINERY' AND balance > 0) USING (sample_id)")
def link_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Events of the samples that go into a bundle."""
    chosen = T.samples(spark, d).filter("driver = 'MACHINERY' and balance > 0").select("sample_id")
    return T.events(spark, d).join(chosen, "sample_id", "left_semi").select("event_id", "area_ha", "review_status")


@query("q_contrast", """
    SELECT flag, low, high, round(high - low, 4) AS spread, round((high - low) / high, 6) AS relative, high < 60000 AND (high - low < 40000 OR (high - low) / high < 0.3) AS dark FROM (SELECT flag || status AS flag, quantile_cont(brightness, 0.05) AS low, quantile_cont(brightness, 0.95) AS high FROM scenes GROUP BY ALL)""")  # fmt: skip
def contrast(spark: SparkSession, d: str) -> DataFrame:
    """Range and relative contrast from two percentiles, and the strict rule for dark pictures without contrast."""
    g = T.scenes(spark, d).groupBy(F.concat("flag", "status").alias("flag")).agg(F.percentile("brightness", [0.05, 0.95]).alias("q")).select("flag", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    spread = F.col("high") - F.col("low")
    relative = F.try_divide(spread, F.col("high"))
    return g.select("flag", "low", "high", F.round(spread, 4).alias("spread"), F.round(relative, 6).alias("relative"), ((F.col("high") < 60000) & ((spread < 40000) | (relative < 0.3))).alias("dark"))


@query("q_selected_scenes", f"SELECT DISTINCT scene_id, period FROM ({LINKS}) WHERE period IN ('PRE', 'POST') AND (scene_id LIKE '1%' OR scene_id LIKE '25%') ORDER BY scene_id, period LIMIT 500")
def selected_scenes(spark: SparkSession, d: str) -> DataFrame:
    """A selection by period and by any of some id prefixes, up to the asked number of rows."""
    chosen = links(spark, d).filter(F.col("period").isin("PRE", "POST") & (F.col("scene_id").startswith("1") | F.col("scene_id").startswith("25")))
    return chosen.select("scene_id", "period").distinct().orderBy("scene_id", "period").limit(500)


def prefixed_note(note: Column, prefix: str, text: Column) -> Column:
    """The note with a prefixed remark, unless a remark with this prefix is there already."""
    remark = F.concat(F.lit(prefix), text)
    blank = F.trim(F.coalesce(note, F.lit(""))) == ""
    return F.when(blank, remark).when(F.contains(note, F.lit(prefix)), note).otherwise(F.concat_ws("; ", note, remark))


@query("q_multiple_event_notes", """
    WITH m AS (SELECT sample_id, count(*) AS n FROM obs GROUP BY sample_id HAVING count(*) > 1), s AS (SELECT sample_id, CASE sample_id % 3 WHEN 1 THEN 'checked' WHEN 2 THEN '[multiple] 2 events' END AS note FROM samples)
    SELECT sample_id, CASE WHEN note IS NULL THEN '[multiple] ' || n || ' events' WHEN contains(note, '[multiple] ') THEN note ELSE note || '; [multiple] ' || n || ' events' END AS note FROM s JOIN m USING (sample_id)""")  # fmt: skip
def multiple_event_notes(spark: SparkSession, d: str) -> DataFrame:
    """A remark on samples with several events; running it again (as here) adds nothing."""
    many = T.events(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    k = F.col("sample_id") % 3
    s = T.samples(spark, d).select("sample_id", F.when(k == 1, "checked").when(k == 2, "[multiple] 2 events").alias("note")).join(many, "sample_id")
    text = F.concat(F.col("n").cast("string"), F.lit(" events"))
    once = s.withColumn("note", prefixed_note(F.col("note"), "[multiple] ", text))
    return once.select("sample_id", prefixed_note(F.col("note"), "[multiple] ", text).alias("note"))


@query("q_embedding_cache", f"""
    WITH want AS (SELECT DISTINCT scene_id, cloud FROM ({LINKS})), cached AS (SELECT scene_id FROM scenes WHERE quantity > 20)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN c.scene_id IS NOT NULL THEN 'hit' WHEN cloud > 0.09 THEN 'failed' ELSE 'computed' END AS status FROM want w LEFT JOIN cached c USING (scene_id)) GROUP BY status""")  # fmt: skip
def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pictures of a manifest against a cache of their vectors: hits, those to compute, those that can't be."""
    want = links(spark, d).select("scene_id", "cloud").distinct()
    cached = T.scenes(spark, d).filter("quantity > 20").select(F.col("scene_id").alias("c"))
    status = F.when(F.col("c").isNotNull(), "hit").when(F.col("cloud") > 0.09, "failed").otherwise("computed")
    return want.join(cached, F.col("scene_id") == F.col("c"), "left").groupBy(status.alias("status")).agg(counted())


@query("q_table_fingerprint", f"SELECT count(*) AS n, CAST(sum({DRAW.format('sample_id || chr(124) || driver || chr(124) || country')}) AS BIGINT) AS fingerprint FROM samples")
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint of a table's content, whatever its order: the sum of the rows' digests, so nothing is gathered."""
    row = F.concat_ws("|", F.col("sample_id").cast("string"), "driver", "country")
    digest = F.conv(F.substring(F.md5(row.cast("binary")), 1, 8), 16, 10).cast("long")
    return T.samples(spark, d).agg(counted(), F.sum(digest).alias("fingerprint"))


@query("q_schema_backfill", """
    SELECT sample_id, driver, note FROM (SELECT sample_id, driver, NULL AS note FROM samples WHERE sample_id % 3 <> 0 UNION ALL SELECT subject, first_kind, 'backfilled' FROM (SELECT subject, min(kind) AS first_kind FROM status_log GROUP BY subject) WHERE subject NOT IN (SELECT sample_id FROM samples WHERE sample_id % 3 <> 0))""")  # fmt: skip
def schema_backfill(spark: SparkSession, d: str) -> DataFrame:
    """A table that gained a column, and the rows of another source that it lacks."""
    old = T.samples(spark, d).filter("sample_id % 3 <> 0").select("sample_id", "driver")
    other = T.status_log(spark, d).groupBy(F.col("subject").alias("sample_id")).agg(F.min("kind").alias("driver")).withColumn("note", F.lit("backfilled"))
    return R.insert_missing(old, other, ["sample_id"]).unionByName(old, allowMissingColumns=True)


@query("q_event_scoped_scenes", f"""
    WITH l AS (SELECT scene_id, count(*) FILTER (period = 'PRE') AS pre FROM ({LINKS}) GROUP BY scene_id)
    SELECT CASE WHEN l.scene_id IS NULL THEN 'unlinked' WHEN pre > 0 THEN 'pre' ELSE 'other' END AS scope, count(*) AS n FROM scenes s LEFT JOIN l USING (scene_id) WHERE contains(s.scene_id, '7') GROUP BY ALL""")  # fmt: skip
def event_scoped_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes that match a text, by whether they are linked to an event and how."""
    linked = links(spark, d).groupBy(F.col("scene_id").alias("l")).agg(F.count_if(F.col("period") == "PRE").alias("pre"))
    s = T.scenes(spark, d).filter(F.contains("scene_id", F.lit("7"))).join(linked, F.col("scene_id") == F.col("l"), "left")
    scope = F.when(F.col("l").isNull(), "unlinked").when(F.col("pre") > 0, "pre").otherwise("other")
    return s.groupBy(scope.alias("scope")).agg(counted())


@query("q_spatial_pairs", """
    SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a.review_status = 'VALID' AND b.review_status = 'VALID' THEN 'VALID_VALID' WHEN a.review_class = 'YEAR_MISMATCH' OR b.review_class = 'YEAR_MISMATCH' THEN 'WITH_MISMATCH' WHEN a.review_status = b.review_status THEN 'REJECTED_REJECTED' ELSE 'MIXED' END AS kind
        FROM obs a JOIN obs b ON a.sample_id = b.sample_id AND b.event_year = a.event_year + 1) GROUP BY kind""")  # fmt: skip
def spatial_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Class of each pair of a point's events of neighbouring years. One pair an event: a lead, not a self-join."""
    w = Window.partitionBy("sample_id").orderBy("event_year")
    after = lambda c: F.lead(c).over(w).alias(f"next_{c}")
    e = T.events(spark, d).select("review_class", "review_status", "event_year", after("event_year"), after("review_class"), after("review_status")).filter("next_event_year = event_year + 1")
    classes, states = F.array("review_class", "next_review_class"), F.array("review_status", "next_review_status")
    kind = F.when(~F.array_contains(states, "REJECTED"), "VALID_VALID").when(F.array_contains(classes, "YEAR_MISMATCH"), "WITH_MISMATCH").when(~F.array_contains(states, "VALID"), "REJECTED_REJECTED").otherwise("MIXED")
    return e.groupBy(kind.alias("kind")).agg(counted())


@query("q_change_features", f"""
    SELECT event_id, count(*) AS parts, round(sum(brightness) FILTER (flag = 'A'), 2) AS loss, coalesce(round(avg(quantity) FILTER (flag <> 'A'), 6), -1) AS other_mean, arg_max(flag, (brightness, scene_id)) AS largest
    FROM ({LINKS}) WHERE period = 'EVENT' GROUP BY event_id""")  # fmt: skip
def change_features(spark: SparkSession, d: str) -> DataFrame:
    """Conditional aggregates of an event's parts, the kind of the largest one, and a default where nothing matches."""
    a = F.col("flag") == "A"
    g = links(spark, d).filter("period = 'EVENT'").groupBy("event_id")
    return g.agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum(F.when(a, F.col("brightness"))), 2).alias("loss"), F.coalesce(F.round(F.avg(F.when(~a, F.col("quantity"))), 6), F.lit(-1.0)).alias("other_mean"), F.max_by("flag", F.struct("brightness", "scene_id")).alias("largest"))


@query("q_acquisition_statistics", """
    WITH l AS (SELECT e.event_id, e.event_year, count(s.scene_id) AS scenes, count(*) FILTER (s.cloud > 0.08) AS cloudy FROM obs e LEFT JOIN scenes s ON s.sample_id = e.sample_id AND year(s.day) = e.event_year - 1 GROUP BY ALL)
    SELECT event_year, count(*) AS events, count(*) FILTER (scenes = 0) AS no_pre, count(*) FILTER (scenes > 0 AND cloudy = scenes) AS qc_failed, round(avg(scenes), 6) AS mean_scenes FROM l GROUP BY event_year""")  # fmt: skip
def acquisition_statistics(spark: SparkSession, d: str) -> DataFrame:
    """By year: events that lack earlier scenes, and those whose earlier scenes all fail."""
    s = T.scenes(spark, d).groupBy(F.col("sample_id").alias("s"), (F.year("day") + 1).alias("y")).agg(F.count(F.lit(1)).alias("scenes"), F.count_if(F.col("cloud") > 0.08).alias("cloudy"))
    e = T.events(spark, d).join(s, (F.col("sample_id") == F.col("s")) & (F.col("event_year") == F.col("y")), "left").na.fill(0, ["scenes", "cloudy"])
    fails = (F.col("scenes") > 0) & (F.col("cloudy") == F.col("scenes"))
    return e.groupBy("event_year").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("scenes") == 0).alias("no_pre"), F.count_if(fails).alias("qc_failed"), F.round(F.avg("scenes"), 6).alias("mean_scenes"))


@query("q_period_caps", """
    WITH c AS (SELECT n_nationkey AS k, 5 + n_nationkey % 4 AS spring, 8 + n_nationkey % 3 AS summer, 3 + n_nationkey % 5 AS autumn FROM nation)
    SELECT k, spring // 2 + CASE WHEN spring % 2 = 1 THEN 1 ELSE 0 END + summer // 2 + CASE WHEN summer % 2 = 1 AND spring % 2 = 0 THEN 1 ELSE 0 END + autumn // 2 + CASE WHEN autumn % 2 = 1 AND (spring + summer) % 2 = 0 THEN 1 ELSE 0 END AS pre,
           spring // 2 + summer // 2 + CASE WHEN summer % 2 = 1 AND spring % 2 = 1 THEN 1 ELSE 0 END + autumn // 2 + CASE WHEN autumn % 2 = 1 AND (spring + summer) % 2 = 1 THEN 1 ELSE 0 END AS post FROM c""")  # fmt: skip
def period_caps(spark: SparkSession, d: str) -> DataFrame:
    """Caps of seasons dealt to two periods; an odd one goes to the period that has less so far, the first of equals."""
    k = F.col("n_nationkey").cast("long")
    caps = F.array(5 + k % 4, 8 + k % 3, 3 + k % 5)
    zero = F.struct(F.lit(0).cast("long").alias("pre"), F.lit(0).cast("long").alias("post"))

    def deal(acc: Column, cap: Column) -> Column:
        half, odd = F.floor(cap / 2), cap % 2
        to_pre = F.when(acc["pre"] <= acc["post"], odd).otherwise(0)
        return F.struct((acc["pre"] + half + to_pre).cast("long").alias("pre"), (acc["post"] + half + odd - to_pre).cast("long").alias("post"))

    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.aggregate(caps, zero, deal).alias("p")).select("k", "p.pre", "p.post")


@query("q_operation_keys", "SELECT DISTINCT driver || ':' || region || ':' || CAST(floor(lat / 10) AS BIGINT) AS operation FROM samples")
def operation_keys(spark: SparkSession, d: str) -> DataFrame:
    return T.samples(spark, d).select(F.concat_ws(":", "driver", "region", F.floor(F.col("lat") / 10).cast("string")).alias("operation")).distinct()


@query("q_time_windows", """
    SELECT record_id, logged_at - INTERVAL 90 SECOND AS low, logged_at + INTERVAL 90 SECOND AS high, last_day(CAST(logged_at AS DATE)) AS month_end FROM status_log WHERE kind = 'error'""")  # fmt: skip
def time_windows(spark: SparkSession, d: str) -> DataFrame:
    """A window around each acquisition, and the end of its month."""
    at = F.col("logged_at")
    return T.status_log(spark, d).filter("kind = 'error'").select("record_id", (at - F.expr("INTERVAL 90 SECOND")).alias("low"), (at + F.expr("INTERVAL 90 SECOND")).alias("high"), F.last_day(at).alias("month_end"))


@query("q_composite_mismatch_ranks", """
    WITH f AS (SELECT sample_id, event_year, CASE WHEN count(DISTINCT area_ha) OVER w <= 1 THEN 1.0 ELSE (dense_rank() OVER (PARTITION BY sample_id ORDER BY area_ha) - 1) / CAST(count(DISTINCT area_ha) OVER w - 1 AS DOUBLE) END AS a FROM obs WINDOW w AS (PARTITION BY sample_id))
    SELECT sample_id, event_year, round(a, 9) AS score FROM f QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round(a, 9) DESC, event_year) = 1""")  # fmt: skip
def composite_mismatch_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The first of each point's events by the composite rank of one weight."""
    return O.composite_rank(T.events(spark, d).select("sample_id", "event_year", "area_ha"), ["sample_id"], {"area_ha": 1.0}, [F.col("event_year")]).filter("rank = 1").select("sample_id", "event_year", "score")
