"""The observation model's tables, played by the star-schema tables of a data folder.

samples are customers, events are a customer's orders by year, scenes are
shipped lines, reviews and model scores are fixed expressions of an event's
key. ``CTE`` states the same tables as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.plans.tables import table

#: Review classes by their number.
CLASSES = ("VALID_LOGGING", "VALID_WILDFIRE", "YEAR_MISMATCH", "EVENT_TOO_SMALL", "OTHER_INVALID")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """sample_id, source_id, driver, country, region, lat, lon, balance."""
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    places = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    return c.join(F.broadcast(places), c["c_nationkey"] == places["n_nationkey"]).select(
        F.col("c_custkey").alias("sample_id"),
        F.col("c_name").alias("source_id"),
        F.col("c_mktsegment").alias("driver"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        ((F.col("c_custkey") * 37 % 12000) / F.lit(100.0) - 60).alias("lat"),
        ((F.col("c_custkey") * 53 % 36000) / F.lit(100.0) - 180).alias("lon"),
        F.col("c_acctbal").alias("balance"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sample and year: event_id, area_ha, pixels, share of the sample's area, dominant, review and model columns."""
    o = table(spark, folder, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    by_year = o.groupBy(F.col("o_custkey").alias("sample_id"), F.year("o_orderdate").alias("event_year")).agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("pixels"))
    sample = Window.partitionBy("sample_id")
    key = F.col("sample_id") * 7 + F.col("event_year")
    klass = F.element_at(F.array(*(F.lit(c) for c in CLASSES)), (key % 5 + 1).cast("int"))
    e = by_year.withColumn("event_id", F.concat_ws("-", F.col("sample_id").cast("string"), F.col("event_year").cast("string")))
    e = e.withColumns({"area_ha": F.col("cents") / F.lit(10000.0), "share": F.col("cents") / F.sum("cents").over(sample), "dominant": F.row_number().over(sample.orderBy(F.desc("cents"), "event_year")) == 1})
    e = e.withColumns({"review_class": klass, "review_status": F.when(key % 5 < 2, "VALID").otherwise("REJECTED"), "human_label": F.when(key % 5 == 0, "Logging").when(key % 5 == 1, "Wildfire")})
    e = e.withColumns({"p_a": ((F.col("sample_id") * 13 + F.col("event_year") * 7) % 101) / F.lit(100.0), "p_b": ((F.col("sample_id") * 29 + F.col("event_year") * 3) % 101) / F.lit(100.0)})
    e = e.withColumns({"label_a": F.when(F.col("p_a") >= 0.5, "Wildfire").otherwise("Logging"), "label_b": F.when(F.col("p_b") >= 0.5, "Wildfire").otherwise("Logging")})
    return e.select("sample_id", "event_year", "event_id", "area_ha", "pixels", "share", "dominant", "review_class", "review_status", "human_label", "p_a", "p_b", "label_a", "label_b")


def scenes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per scene: scene_id, sample_id, day, cloud, shadow, brightness, quantity, excluded, flag."""
    li, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    one = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_shipdate").alias("day"), F.min("l_discount").alias("cloud"), F.min("l_tax").alias("shadow"), F.min("l_extendedprice").alias("brightness"),
        F.min("l_quantity").alias("quantity"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"),
    )
    return one.join(o.select("o_orderkey", F.col("o_custkey").alias("sample_id")), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("scene_id"),
        "sample_id", F.to_date("day").alias("day"), "cloud", "shadow", "brightness", "quantity", (F.col("flag") == "R").alias("excluded"), "flag", "status",
    )


def status_log(spark: SparkSession, folder: str) -> DataFrame:
    """Versioned records: subject, kind, logged_at, record_id, value, note (JSON)."""
    return table(spark, folder, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("kind"), F.col("ts").alias("logged_at"), F.col("event_id").alias("record_id"), "value", F.col("props").alias("note"))


CTE = {
    "samples": """samples AS (
        SELECT c_custkey AS sample_id, c_name AS source_id, c_mktsegment AS driver, n_name AS country, r_name AS region,
               (c_custkey * 37 % 12000) / CAST(100 AS DOUBLE) - 60 AS lat, (c_custkey * 53 % 36000) / CAST(100 AS DOUBLE) - 180 AS lon, c_acctbal AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "obs": """obs_years AS (
        SELECT o_custkey AS sample_id, CAST(year(o_orderdate) AS INTEGER) AS event_year, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS pixels
        FROM orders GROUP BY ALL),
    obs AS (
        SELECT sample_id, event_year, sample_id || '-' || event_year AS event_id, cents / CAST(10000 AS DOUBLE) AS area_ha, pixels,
               cents / CAST(sum(cents) OVER (PARTITION BY sample_id) AS DOUBLE) AS share,
               row_number() OVER (PARTITION BY sample_id ORDER BY cents DESC, event_year) = 1 AS dominant,
               ['VALID_LOGGING', 'VALID_WILDFIRE', 'YEAR_MISMATCH', 'EVENT_TOO_SMALL', 'OTHER_INVALID'][(sample_id * 7 + event_year) % 5 + 1] AS review_class,
               CASE WHEN (sample_id * 7 + event_year) % 5 < 2 THEN 'VALID' ELSE 'REJECTED' END AS review_status,
               CASE (sample_id * 7 + event_year) % 5 WHEN 0 THEN 'Logging' WHEN 1 THEN 'Wildfire' END AS human_label,
               ((sample_id * 13 + event_year * 7) % 101) / CAST(100 AS DOUBLE) AS p_a, ((sample_id * 29 + event_year * 3) % 101) / CAST(100 AS DOUBLE) AS p_b,
               CASE WHEN p_a >= 0.5 THEN 'Wildfire' ELSE 'Logging' END AS label_a, CASE WHEN p_b >= 0.5 THEN 'Wildfire' ELSE 'Logging' END AS label_b
        FROM obs_years)""",
    "scenes": """scenes AS (
        SELECT l_orderkey || '-' || l_linenumber AS scene_id, o_custkey AS sample_id, CAST(min(l_shipdate) AS DATE) AS day, min(l_discount) AS cloud, min(l_tax) AS shadow,
               min(l_extendedprice) AS brightness, min(l_quantity) AS quantity, min(l_returnflag) = 'R' AS excluded, min(l_returnflag) AS flag, min(l_linestatus) AS status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber, o_custkey)""",
    "status_log": """status_log AS (
        SELECT user_id AS subject, event_type AS kind, ts AS logged_at, event_id AS record_id, value, props AS note FROM events)""",
}


def with_tables(sql: str) -> str:
    """The statement with the tables of the model it names in front; a WITH of its own is joined to them."""
    import re

    used = [cte for name, cte in CTE.items() if re.search(rf"\b{name}\b", sql)]
    sql = sql.strip()
    if not used:
        return sql
    own = re.match(r"(?i)with\s+(recursive\s+)?", sql)
    return f"WITH {'RECURSIVE ' if own and own[1] else ''}" + ",\n".join(used) + (",\n" + sql[own.end() :] if own else "\n" + sql)
