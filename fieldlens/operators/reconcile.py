"""Keeping tables in step: imports, merges, migrations and their plans.

Tables are values here: every operator returns the new state or the list of
operations that leads to it, and applying twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others with the name of the first rule they break."""
    why = F.lit(None).cast("string")
    for name, broken in reversed(rules.items()):
        why = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(why)
    marked = df.withColumn("reason", why)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def import_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows with outcome: NEW, DUPLICATE_IN_BATCH (not the first of its key) or EXISTS in the table."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    here = existing.select(*keys).distinct().withColumn("__here", F.lit(True))
    joined = incoming.withColumn("__nth", nth).join(here, keys, "left")
    return joined.withColumn("outcome", F.when(F.col("__nth") > 1, "DUPLICATE_IN_BATCH").when(F.col("__here"), "EXISTS").otherwise("NEW")).drop("__nth", "__here")


def sync(current: DataFrame, wanted: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Operations that turn current into wanted: INSERT, UPDATE, DELETE or KEEP, with the values to have afterwards (null for DELETE)."""
    a = current.select(*keys, *(F.col(v).alias(f"__a_{v}") for v in values), F.lit(True).alias("__a"))
    b = wanted.select(*keys, *(F.col(v).alias(f"__b_{v}") for v in values), F.lit(True).alias("__b"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"__a_{v}").eqNullSafe(F.col(f"__b_{v}"))
    action = F.when(F.col("__a").isNull(), "INSERT").when(F.col("__b").isNull(), "DELETE").when(same, "KEEP").otherwise("UPDATE")
    return a.join(b, keys, "full_outer").select(*keys, action.alias("action"), *(F.col(f"__b_{v}").alias(v) for v in values))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the changes: changed keys take the new row, others stay. Columns that one side lacks are null."""
    return changes.unionByName(current.join(changes.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def insert_missing(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table lacks, each key once: what an idempotent insert adds."""
    return rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")


def merge_text(local: Column, incoming: Column) -> Column:
    """struct(action, value) of a field of two copies: null and blank are equal; a blank local takes the incoming one; two texts conflict."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    s = lambda a, v: F.struct(F.lit(a).alias("action"), v.alias("value"))
    return F.when(blank(incoming) | F.coalesce(F.trim(local) == F.trim(incoming), F.lit(False)), s("keep", local)).when(blank(local), s("fill", incoming)).otherwise(s("conflict", local))


def schema_tolerant(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The wanted columns with their types; missing ones are null, others are dropped."""
    return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))


def exclusive_state(rows: DataFrame, key: str, state: str, precedence: list[str]) -> DataFrame:
    """One state a key: the first in precedence that any of its rows has."""
    at = F.array_position(F.array(*(F.lit(p) for p in precedence)), F.col(state))
    best = rows.filter(at > 0).groupBy(key).agg(F.min(at).alias("__at"))
    return best.select(key, F.element_at(F.array(*(F.lit(p) for p in precedence)), F.col("__at").cast("int")).alias(state))
