"""Ranks, transitions, quotas and packings that depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_fraction(value: str, keys: list[str]) -> Column:
    """(dense rank - 1) / (distinct values - 1) within the group; 1 where there is one value, 0 for null. Values are counted by their ranks from the other end, without a set of them."""
    w = Window.partitionBy(*keys)
    ordered, reverse = F.dense_rank().over(w.orderBy(F.col(value).asc_nulls_last())), F.dense_rank().over(w.orderBy(F.col(value).desc_nulls_last()))
    distinct = ordered + reverse - 1  # nulls come last both ways, so they don't count
    return F.when(F.col(value).isNull(), 0.0).when(distinct <= 1, 1.0).otherwise((ordered - 1) / (distinct - 1))


def composite_rank(df: DataFrame, keys: list[str], weights: dict[str, float], ties: list[Column], score: str = "score", rank: str = "rank") -> DataFrame:
    """Weighted sum of rank fractions within a group, and the rank by it."""
    for c in weights:
        df = df.withColumn(f"__f_{c}", rank_fraction(c, keys))
    df = df.withColumn(score, F.round(sum((F.col(f"__f_{c}") * w for c, w in weights.items()), F.lit(0.0)), 9)).drop(*(f"__f_{c}" for c in weights))
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *ties)))


def ranking_metrics(df: DataFrame, keys: list[str], rank: str, target: str) -> DataFrame:
    """Of groups that hold a target row: hit at 1 and 2, mean reciprocal rank, median rank."""
    first = df.filter(F.col(target)).groupBy(*keys).agg(F.min(rank).alias("r"))
    hit = lambda k: F.round(F.avg((F.col("r") <= k).cast("double")), 6)
    return first.agg(F.count(F.lit(1)).alias("points"), hit(1).alias("hit_1"), hit(2).alias("hit_2"), F.round(F.avg(1.0 / F.col("r")), 6).alias("mrr"), F.percentile("r", 0.5).alias("median_rank"))


def transitions(df: DataFrame, key: str, order: list[str], state: str, at: str) -> DataFrame:
    """Counts of (state, next state, years between) over neighbouring rows of a key."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = df.select(F.col(state).alias("state"), F.lead(state).over(w).alias("next_state"), (F.lead(at).over(w) - F.col(at)).alias("gap"))
    return steps.filter("next_state is not null").groupBy("state", "next_state", "gap").agg(F.count(F.lit(1)).alias("n"))


def apportion(df: DataFrame, keys: list[str], total: str, weight: str, order: str, into: str) -> DataFrame:
    """Largest remainder: ``total`` is split in proportion to weights; ties go to the larger weight, then by order."""
    w = Window.partitionBy(*keys)
    exact = F.col(total) * F.col(weight) / F.sum(weight).over(w)
    df = df.withColumn("__exact", exact).withColumn("__whole", F.floor("__exact"))
    df = df.withColumn("__rest", F.col(total) - F.sum("__whole").over(w))
    nth = F.row_number().over(w.orderBy(F.round(F.col("__exact") - F.col("__whole"), 9).desc(), F.desc(weight), order))
    return df.withColumn(into, (F.col("__whole") + (nth <= F.col("__rest")).cast("int")).cast("long")).drop("__exact", "__whole", "__rest")


def moving_average(df: DataFrame, key: str, order: str, value: str, radius: int, into: str) -> DataFrame:
    """Mean of the rows up to ``radius`` before and after; the first and last row of a key stay as they are."""
    w = Window.partitionBy(key).orderBy(order)
    ends = F.lag(value).over(w).isNull() | F.lead(value).over(w).isNull()
    return df.withColumn(into, F.when(ends, F.col(value)).otherwise(F.avg(value).over(w.rowsBetween(-radius, radius))))


def round_robin(df: DataFrame, bucket: str, order: list[Column], into: str = "turn") -> DataFrame:
    """Turn of a row when buckets deal one row each in order of their names: all first rows, then all second ones."""
    nth = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return df.withColumn(into, nth)
