"""Filters, listings and per-row decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(df: DataFrame, text: str | None, columns: list[str], equal: dict[str, object] | None = None) -> DataFrame:
    """Rows with the text in any of the columns (any case) and all equalities; blanks and None don't filter."""
    out = F.lit(True)
    if text and text.strip():
        part = text.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.col(c).cast("string").ilike(f"%{part}%"), F.lit(False))
        out = out & hit
    for c, v in (equal or {}).items():
        if v is not None:
            out = out & (F.col(c) == v)
    return df.filter(out)


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of a totally ordered listing: at most 1000 rows."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit is 1 to 1000, offset is not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def with_or_without(df: DataFrame, other: DataFrame, keys: list[str], present: bool) -> DataFrame:
    """Rows with (EXISTS) or without (NOT EXISTS) a match in the other table."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi" if present else "left_anti")


def reasons(**checks: Column) -> Column:
    """The names of all checks that fail (are true), in the order given; null checks don't count."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items())))


def ordered_distinct(df: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys in the order of their first position."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def loss_status(total: Column, dominant: Column, share: Column) -> Column:
    """NO_LOSS, GOOD (dominant share at least 0.60 and at least 1 ha) or AMBIGUOUS."""
    return F.when(F.coalesce(total, F.lit(0)) <= 0, "NO_LOSS").when((share >= 0.60) & (dominant >= 1.0), "GOOD").otherwise("AMBIGUOUS")


def latest(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """One row per key: the first in the given order, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def fold_rare(df: DataFrame, column: str, least: int, other: str = "Other") -> DataFrame:
    """Values of fewer than ``least`` rows become ``other``."""
    rare = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < least).select(F.col(column).alias("__rare"))
    joined = df.join(F.broadcast(rare.limit(100_000)), F.col(column) == F.col("__rare"), "left") if rare.limit(100_001).count() <= 100_000 else df.join(rare, F.col(column) == F.col("__rare"), "left")
    return joined.withColumn(column, F.when(F.col("__rare").isNotNull(), other).otherwise(F.col(column))).drop("__rare")
