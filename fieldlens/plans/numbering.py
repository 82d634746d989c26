"""Gapless row numbers within groups that may hold most of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, group: list[str], order: list[str], into: str, lanes: int | None = None, lane_rows: int = 1_000_000) -> DataFrame:
    """Adds ``into``: 0, 1, 2, ... within each ``group``, whatever its size.

    Rows are dealt to ``lanes`` lanes of their group by a hash of ``order``;
    they are numbered inside a lane, and lanes are shifted by the row counts of
    the lanes before them. No task holds a whole group, and the table of lane
    counts has at most groups x lanes rows. Unless given, lanes are so many that
    one of a group with all rows has about ``lane_rows``, 256 at least. Equal
    rows get different numbers. ``df`` is read two or three times, so it should be cheap to read or checkpointed. Groups
    and ``order`` may hold nulls.
    """
    if lanes is None:
        lanes = max(256, -(-df.count() // lane_rows))
    keys = [f"__g{i}" for i in range(len(group))]
    laned = df.withColumn("__lane", F.pmod(F.xxhash64(*order), F.lit(lanes)))
    counts = laned.groupBy(*(F.col(g).alias(k) for g, k in zip(group, keys, strict=True)), F.col("__lane").alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__l").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "__l", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*group, "__lane").orderBy(*order)
    numbered = laned.withColumn("__at", F.row_number().over(inside) - 1)
    same = F.col("__lane") == F.col("__l")
    for g, k in zip(group, keys, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(k))
    return numbered.join(counts, same).withColumn(into, (F.col("__at") + F.col("__base")).cast("long")).drop("__lane", "__at", "__l", "__base", *keys)
