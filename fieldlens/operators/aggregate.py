"""Counts, distributions, contingency tables and rule metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.plans.prefix import running_totals


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b; ``empty`` (or null) where b is 0."""
    out = F.when(b != 0, a / b)
    return F.coalesce(out, F.lit(empty)) if empty is not None else out


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def counts(df: DataFrame, keys: list[str], denominator: int | None = None) -> DataFrame:
    """Rows per key with their percentage of all rows, or of the denominator."""
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    whole = F.lit(denominator) if denominator is not None else F.sum("n").over(Window.partitionBy())
    return grouped.withColumn("percent", F.round(100.0 * F.col("n") / whole, 4))


def distribution(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """count, mean, sample deviation (0 for one row) and quantiles 5, 25, 50, 75, 95 % of each group, nulls left out."""
    q = F.percentile(value, [0.05, 0.25, 0.5, 0.75, 0.95])
    out = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), q.alias("q"))
    names = ("q05", "q25", "median", "q75", "q95")
    return out.select(*keys, "n", F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"), *(F.round(F.col("q")[i], digits).alias(n) for i, n in enumerate(names)))


def contingency(df: DataFrame, row: str, column: str, rows: list[str], columns: list[str]) -> DataFrame:
    """Dense counts of row x column with percentages within a column; empty cells are kept as 0."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(r, c) for r in rows for c in columns], "r string, c string")  # rows x columns of two short lists
    found = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    full = grid.join(found, (F.col("r") == F.col(row)) & (F.col("c") == F.col(column)), "left").select(F.col("r").alias(row), F.col("c").alias(column), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = F.sum("n").over(Window.partitionBy(column))
    return full.withColumn("percent", F.round(F.when(total > 0, 100.0 * F.col("n") / total).otherwise(0.0), 4))


def binary_metrics(truth: Column, predicted: Column) -> list[Column]:
    """Aggregates n, accuracy, balanced accuracy, macro F1 and each side's precision and recall; undefined ratios are 0."""
    tp, fp = count_if(truth & predicted), count_if(~truth & predicted)
    fn, tn = count_if(truth & ~predicted), count_if(~truth & ~predicted)
    r = lambda a, b: ratio(a.cast("double"), b, 0.0)
    f1_pos, f1_neg = r(2 * tp, 2 * tp + fp + fn), r(2 * tn, 2 * tn + fp + fn)
    named = {
        "accuracy": r(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (r(tp, tp + fn) + r(tn, tn + fp)) / 2, "macro_f1": (f1_pos + f1_neg) / 2,
        "precision_pos": r(tp, tp + fp), "recall_pos": r(tp, tp + fn), "precision_neg": r(tn, tn + fn), "recall_neg": r(tn, tn + fp),
    }
    return [F.count(F.lit(1)).alias("n"), *(F.round(c, 6).alias(n) for n, c in named.items())]


def threshold_sweep(df: DataFrame, value: str, positive: str) -> DataFrame:
    """Every distinct value as a threshold of the rule "value is at or below it": covered rows, precision, recall, F1.

    Counts are pre-aggregated per value, then accumulated.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("threshold")).agg(count_if(F.col(positive)).alias("p"), count_if(~F.col(positive)).alias("q"))
    out = running_totals(per, "threshold", {"tp": "p", "fp": "q"})
    out = out.join(F.broadcast(out.agg(F.max("tp").alias("all_p"))))  # one row
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), ratio(F.col("tp").cast("double"), F.col("all_p"), 0.0)
    return out.select("threshold", "tp", "fp", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(ratio(2 * F.col("tp").cast("double"), F.col("tp") + F.col("fp") + F.col("all_p"), 0.0), 6).alias("f1"))


def roc_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: area under the ROC curve by average ranks, with rows pre-aggregated per score."""
    per = df.groupBy(F.col(score).alias("__s")).agg(count_if(F.col(positive)).alias("__p"), count_if(~F.col(positive)).alias("__q"))
    wins = F.col("__p") * (F.col("__upto") - F.col("__q") / 2.0)
    p, q = F.sum("__p"), F.sum("__q")
    return running_totals(per.filter("__s is not null"), "__s", {"__upto": "__q"}).select("__p", "__q", wins.alias("__w")).agg(F.round(ratio(F.sum("__w"), (p * q).cast("double")), 6).alias("auc"), p.alias("n_pos"), q.alias("n_neg"))


def odds_table(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: the 2 x 2 table of two conditions and its odds ratio with one half added to each cell."""
    cells = df.agg(count_if(a & b).alias("n11"), count_if(a & ~b).alias("n10"), count_if(~a & b).alias("n01"), count_if(~a & ~b).alias("n00"))
    c = lambda n: F.col(n) + 0.5
    return cells.withColumn("odds_ratio", F.round(c("n11") * c("n00") / (c("n10") * c("n01")), 6))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts in left-closed bins and one of all values from the last edge on, with percentages of the finite values; values below the first edge are left out of the bins."""
    v = F.col(value)
    at = F.lit(None).cast("int")
    for i, edge in enumerate(edges):
        at = F.when(v >= edge, F.lit(i)).otherwise(at)
    finite = df.filter(v.isNotNull() & ~F.isnan(v.cast("double")))
    grouped = finite.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))
    return grouped.filter("bin is not null")


def two_shares(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of row x column with shares within the row and within the column."""
    n = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    share = lambda k: F.round(F.col("n") / F.sum("n").over(Window.partitionBy(k)), 6)
    return n.select(row, column, "n", share(row).alias("share_of_row"), share(column).alias("share_of_column"))
