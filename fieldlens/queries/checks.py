"""Queries that check inputs and outputs: required tables, quality flags, colours, rejections, stored artifacts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions import geo, text
from fieldlens.operators import evaluation as E
from fieldlens.plans.tables import table
from fieldlens.queries.joins import suppliers
from fieldlens.registry import query
from fieldlens.sources import standins as T

REQUIRED = ("customer", "documents", "event_labels", "event_reviews", "events", "lineitem", "nation", "orders", "supplier")


@query("q_schema_warnings", f"""
    SELECT name AS table_name, 'Incoming data has no table ' || name || '; this entity will be skipped.' AS warning FROM (SELECT unnest([{", ".join(f"'{t}'" for t in REQUIRED)}]) AS name)
    WHERE name NOT IN (SELECT table_name FROM information_schema.tables)""")  # fmt: skip
def schema_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Required tables that a data folder lacks."""

    def there(name: str) -> bool:
        try:
            table(spark, d, name)
        except AnalysisException:
            return False
        return True

    lacking = [(t, f"Incoming data has no table {t}; this entity will be skipped.") for t in REQUIRED if not there(t)]
    return spark.createDataFrame(lacking, "table_name string, warning string")


#: JSON values with the flags they hold.
FLAGS = (
    ('["cloud", "dark", " ", "cloud"]', "cloud,dark"), ('{"cloud": true, "snow": false, "dark": 0, "haze": "some"}', "cloud,haze"), ('{"codes": ["a", "b", ""], "none": null, "empty": "", "n": 2}', "a,b,n"),
    ('"cloud"', "cloud"), ("7", "7"), ("", ""), ("not json", ""), ('{"a": [], "b": true}', "b"), ("[]", ""), ('" "', ""),
)


@query("q_quality_flags", f"SELECT event_id, flags FROM events JOIN (VALUES {', '.join(f"({i}, '{f}')" for i, (_, f) in enumerate(FLAGS))}) AS f(k, flags) ON event_id % {len(FLAGS)} = k")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags from lists, objects and scalars, against a table of what each value holds."""
    value = F.element_at(F.array(*(F.lit(v) for v, _ in FLAGS)), (F.col("event_id") % len(FLAGS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.concat_ws(",", text.quality_flags(value)).alias("flags"))


@query("q_band_stretch", """
    WITH e AS (SELECT flag, round(quantile_cont(brightness, 0.02), 6) AS low, round(quantile_cont(brightness, 0.98), 6) AS high, max(brightness) AS top FROM scenes WHERE brightness > 0 GROUP BY flag),
    b AS (SELECT flag, CASE WHEN high <= low THEN 0 ELSE low END AS low, CASE WHEN high <= low THEN greatest(top, 1) ELSE high END AS high FROM e)
    SELECT s.flag, CAST(floor(least(greatest((brightness - low) / greatest(high - low, 1) * 255, 0), 255)) AS INTEGER) AS level, count(*) AS n FROM scenes s JOIN b ON s.flag = b.flag GROUP BY ALL""")  # fmt: skip
def band_stretch(spark: SparkSession, d: str) -> DataFrame:
    """Brightness between its 2nd and 98th percentile on the scale 0 to 255, as counts of levels."""
    s = T.scenes(spark, d)
    e = s.filter("brightness > 0").groupBy(F.col("flag").alias("f")).agg(F.percentile("brightness", [0.02, 0.98]).alias("q"), F.max("brightness").alias("top"))
    low, high = F.round(F.col("q")[0], 6), F.round(F.col("q")[1], 6)
    e = e.select("f", F.when(high <= low, 0.0).otherwise(low).alias("low"), F.when(high <= low, F.greatest("top", F.lit(1.0))).otherwise(high).alias("high"))
    rows = s.join(F.broadcast(e), F.col("flag") == F.col("f"))  # one row a flag
    return rows.select("flag", geo.stretch(F.col("brightness"), F.col("low"), F.col("high")).alias("level")).groupBy("flag", "level").agg(F.count(F.lit(1)).alias("n"))


STOPS = [(-1.0, (120, 60, 20)), (0.0, (250, 250, 190)), (0.5, (90, 170, 60)), (1.0, (0, 70, 20))]


def lerp_sql(channel: int) -> str:
    cases = [f"WHEN v >= {a} AND v <= {b} THEN floor({x[channel]} + {y[channel] - x[channel]} * ((v - {a}) / {b - a}))" for (a, x), (b, y) in zip(STOPS, STOPS[1:], strict=False)]
    return f"CAST(CASE {' '.join(reversed(cases))} END AS INTEGER)"


@query("q_index_colors", f"WITH x AS (SELECT event_id, least(greatest(CAST(p_a * 3 - 1.5 AS DOUBLE), -1), 1) AS v FROM obs) SELECT event_id, {lerp_sql(0)} AS red, {lerp_sql(1)} AS green, {lerp_sql(2)} AS blue FROM x")
def index_colors(spark: SparkSession, d: str) -> DataFrame:
    """An index as colours of a palette that is linear between its stops."""
    c = T.events(spark, d).select("event_id", geo.palette_color(F.col("p_a") * 3 - 1.5, STOPS).alias("c"))
    return c.select("event_id", *(F.col("c")[i].alias(n) for i, n in enumerate(("red", "green", "blue"))))


BANDS, FRACTIONS, COMBINED = [(0.45, 0.55), (0.4, 0.6), (0.3, 0.7)], [0.01, 0.05, 0.1, 0.2], [0.05, 0.1]


@query("q_reject_rules", f"""
    WITH o AS (SELECT p_a, p_b AS k, (p_a >= 0.5) = (human_label = 'Wildfire') AS hit FROM obs WHERE human_label IS NOT NULL),
    r AS (SELECT * FROM (VALUES {", ".join([f"('ambiguity', NULL, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in BANDS] + [f"('knownness', CAST({f} AS DOUBLE), NULL, NULL)" for f in FRACTIONS] + [f"('combined', CAST({f} AS DOUBLE), CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for f in COMBINED for a, b in BANDS])}) AS r(rule, fraction, lower, upper)),
    q AS (SELECT unnest({FRACTIONS}) AS at, unnest(quantile_cont(k, {FRACTIONS})) AS threshold FROM o),
    x AS (SELECT rule, fraction, lower, upper, threshold, hit, coalesce(k < threshold, false) AS unknown, NOT coalesce(k < threshold, false) AND coalesce(p_a BETWEEN lower AND upper, false) AS ambiguous FROM o, r LEFT JOIN q ON r.fraction = CAST(q.at AS DOUBLE))
    SELECT rule, fraction, lower, upper, round(any_value(threshold), 6) AS threshold, count(*) FILTER (unknown) AS unknown_events, count(*) FILTER (ambiguous) AS ambiguous_events, count(*) FILTER (NOT unknown AND NOT ambiguous) AS retained_events,
           round(count(*) FILTER (NOT unknown AND NOT ambiguous) / CAST(count(*) AS DOUBLE), 6) AS coverage, round(count(*) FILTER (NOT unknown AND NOT ambiguous AND hit) / CAST(nullif(count(*) FILTER (NOT unknown AND NOT ambiguous), 0) AS DOUBLE), 6) AS accuracy FROM x GROUP BY rule, fraction, lower, upper""")  # fmt: skip
def reject_rules(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and accuracy when ambiguous, unknown, or both kinds of events are rejected."""
    e = T.events(spark, d).filter("human_label is not null")
    return E.reject_rules(e, "p_a", F.col("human_label") == "Wildfire", "p_b", BANDS, FRACTIONS, COMBINED)


@query("q_artifact_status", """
    WITH w AS (SELECT sample_id AS artifact, driver AS producer, region AS cohort, CAST(balance AS VARCHAR) AS hash FROM samples), f AS (SELECT sample_id AS artifact, CASE WHEN sample_id % 5 = 0 THEN 'other' ELSE driver END AS producer, CASE WHEN sample_id % 7 = 0 THEN NULL ELSE region END AS cohort, CAST(balance AS VARCHAR) AS hash FROM samples WHERE sample_id % 4 <> 0),
    j AS (SELECT w.artifact, f.artifact IS NULL AS none, array_to_string(list_filter([CASE WHEN w.cohort IS DISTINCT FROM f.cohort THEN 'cohort' END, CASE WHEN w.hash IS DISTINCT FROM f.hash THEN 'hash' END, CASE WHEN w.producer IS DISTINCT FROM f.producer THEN 'producer' END], lambda x: x IS NOT NULL), ',') AS failed FROM w LEFT JOIN f ON w.artifact = f.artifact)
    SELECT artifact, CASE WHEN none THEN 'missing' WHEN failed = '' THEN 'reuse' ELSE 'incompatible' END AS status, CASE WHEN none THEN '' ELSE failed END AS failed_checks FROM j""")  # fmt: skip
def artifact_status(spark: SparkSession, d: str) -> DataFrame:
    """Which stored artifacts may be used again, and by which fields the others differ."""
    s = T.samples(spark, d).select(F.col("sample_id").alias("artifact"), F.col("driver").alias("producer"), F.col("region").alias("cohort"), F.col("balance").cast("string").alias("hash"))
    k = F.col("artifact")
    stored = s.filter(k % 4 != 0).withColumns({"producer": F.when(k % 5 == 0, "other").otherwise(F.col("producer")), "cohort": F.when(k % 7 == 0, None).otherwise(F.col("cohort"))})
    return E.artifact_status(s, stored, "artifact", ["producer", "cohort", "hash"])


@query("q_pair_sweep")
def pair_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of two kinds of points by distance and gap in years, all and one to one. Held against a sequential version in tests."""
    a = T.samples(spark, d).select(F.col("sample_id").alias("id"), "lat", "lon", (2010 + F.col("sample_id") % 11).alias("year"))
    b = suppliers(spark, d).select("id", "lat", "lon", (2010 + F.col("id") % 7).alias("year"))
    return E.pair_sweep(a, b, [50.0, 100.0, 200.0, 300.0, 500.0], [1, 3])
