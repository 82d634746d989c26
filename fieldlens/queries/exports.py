"""Queries over files that a query has written."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.plans.lineage import checkpoint_dir
from fieldlens.plans.tables import table
from fieldlens.registry import query
from fieldlens.sources import files as X
from fieldlens.sources import standins as T
from fieldlens.sources import writers as W


@query("q_export_inventory", """
    SELECT n_nationkey AS nation, CASE WHEN count(c_custkey) > 0 THEN 'ok' ELSE 'missing' END AS status FROM nation LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 8000) ON c_nationkey = n_nationkey GROUP BY n_nationkey""")  # fmt: skip
def export_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Samples of a high balance are exported by nation; which nations have files then."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/exports/{uuid4().hex}"
    rich = T.samples(spark, d).filter("balance > 8000").join(table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("nation")), "sample_id")
    rich.write.partitionBy("nation").csv(root, header=True)
    there = X.files(spark, root, "*.csv").filter("length > 0").select(F.regexp_extract("path", "nation=([0-9]+)", 1).cast("int").alias("at")).distinct()
    return table(spark, d, "nation").join(there, F.col("n_nationkey") == F.col("at"), "left").select(F.col("n_nationkey").alias("nation"), F.when(F.col("at").isNotNull(), "ok").otherwise("missing").alias("status"))


@query("q_export_tables", """
    SELECT 'events' AS name, count(*) AS rows, 14 AS columns FROM obs UNION ALL SELECT 'samples', count(*), 8 FROM samples UNION ALL SELECT 'classes', count(DISTINCT review_class), 2 FROM obs""")  # fmt: skip
def export_tables(spark: SparkSession, d: str) -> DataFrame:
    """Result tables written as CSV with a manifest, which is read back; fails if a file holds other rows than it states."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/exports/{uuid4().hex}"
    e = T.events(spark, d)
    manifest = W.export_tables({"events": e, "samples": T.samples(spark, d), "classes": e.groupBy("review_class").count()}, root)
    if not W.unlike_manifest(spark, root).isEmpty():
        raise ValueError("the export differs from its manifest")
    return manifest.select("name", "rows", "columns")
