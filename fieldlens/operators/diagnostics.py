"""Diagnosis of a model's scores in a feature space: which rows are unlike the reference, which are undecided, and why two models disagree.

Rows have id, source (REFERENCE or another), known_3, known_5, known_10 (mean similarity to
so many nearest reference rows, their own left out), sim_logging, sim_wildfire (best
similarity to each class), p (probability of wildfire), first and second (what two
models predict) and truth (null where unknown).
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.operators import agreement
from fieldlens.operators import aggregate as A
from fieldlens.operators import evaluation as E
from fieldlens.plans.lineage import materialize
from fieldlens.plans.prefix import running_totals

#: Neighbours, quantiles, the undecided band, and the shares of rows that are rejected.
NEIGHBOURS = (3, 5, 10)
BAND = (0.4, 0.6)
BELOW = (0.01, 0.05)
FRACTIONS = (0.01, 0.05, 0.10)
REFERENCE = "REFERENCE"


def agreement_type(first: Column, second: Column) -> Column:
    """How two models' labels go together; an empty label is none."""
    a, b = F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))
    both = F.when(a == b, F.concat(F.lit("AGREE_"), F.upper(a))).otherwise(F.concat(F.lit("RC_"), F.upper(a), F.lit("_XGB_"), F.upper(b)))
    return F.when(a.isNull() & b.isNull(), "NO_MODEL_LABELS").when(b.isNull(), "REMOTECLIP_ONLY").when(a.isNull(), "XGBOOST_ONLY").otherwise(both)


def thresholds(rows: DataFrame) -> DataFrame:
    """One row: the reference's low quantiles of each knownness, as arrays t_3, t_5, t_10 in the order of ``BELOW``. Knownness is taken to six digits, so that the quantiles' counts stay bounded."""
    own = rows.filter(F.col("source") == REFERENCE)
    return own.agg(*(F.percentile(F.round(f"known_{k}", 6), list(BELOW)).alias(f"t_{k}") for k in NEIGHBOURS))


def flagged(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows with unknown_flag (knownness by 5 below the reference's 5 % quantile), ambiguous_flag (not unknown, p in the band), agreement_type, similarity_margin, nearest class, and, where the first model says logging and the second wildfire, a diagnosis."""
    edge = edges.select(F.element_at("t_5", BELOW.index(0.05) + 1).alias("__edge"))
    unknown = F.coalesce(F.round("known_5", 6) < F.col("__edge"), F.lit(False))
    like_logging = F.col("sim_logging") >= F.col("sim_wildfire")
    out = rows.join(F.broadcast(edge)).withColumn("unknown_flag", unknown).drop("__edge")  # one row
    out = out.withColumns({"ambiguous_flag": ~F.col("unknown_flag") & F.coalesce(F.col("p").between(*BAND), F.lit(False)), "agreement_type": agreement_type(F.col("first"), F.col("second")), "similarity_margin": F.abs(F.col("sim_logging") - F.col("sim_wildfire")), "nearest_class": F.when(like_logging, "Logging").otherwise("Wildfire")})
    why = F.when(F.col("unknown_flag"), "OOD_BY_MANUAL_P05").when(F.col("ambiguous_flag"), "AMBIGUOUS_0_4_0_6").when(like_logging, "IN_DISTRIBUTION_LOGGING_LIKE").otherwise("WILDFIRE_LIKE_LATENT_CONFLICT")
    return out.withColumn("diagnosis", F.when(F.col("agreement_type") == "RC_LOGGING_XGB_WILDFIRE", why))


def agreement_summary(rows: DataFrame) -> DataFrame:
    """One row per agreement type of flagged rows: knownness, margin, probability, shares of unknown and undecided ones."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return rows.groupBy("agreement_type").agg(
        F.count(F.lit(1)).alias("events"), mean("known_5").alias("knownness_k5_mean"), F.round(F.percentile(F.round("known_5", 6), 0.5), 6).alias("knownness_k5_median"), mean("similarity_margin").alias("similarity_margin_mean"),
        mean("p").alias("probability_wildfire_mean"), mean("unknown_flag").alias("unknown_share"), mean("ambiguous_flag").alias("ambiguous_share"),
    )


def domain_shift(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """How many of the other rows lie below the reference's low quantiles, by number of neighbours and quantile."""
    others = rows.filter(F.col("source") != REFERENCE).join(F.broadcast(edges))  # one row
    cells = [(k, i, q) for k in NEIGHBOURS for i, q in enumerate(BELOW)]
    below = lambda k, i: F.round(f"known_{k}", 6) < F.element_at(f"t_{k}", i + 1)
    sums = others.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(below(k, i)).alias(f"c_{k}_{i}") for k, i, _ in cells)).join(F.broadcast(edges))  # one row each
    each = F.array(*(F.struct(F.lit(f"knownness_k{k}").alias("metric"), F.lit(q).alias("manual_quantile"), F.round(F.element_at(f"t_{k}", i + 1), 6).alias("manual_threshold"), F.col(f"c_{k}_{i}").alias("below_events"), F.round(A.ratio(F.col(f"c_{k}_{i}").cast("double"), F.col("n")), 6).alias("below_share")) for k, i, q in cells))
    return sums.select(F.inline(each))


def lowest_overlap(rows: DataFrame) -> DataFrame:
    """For each two numbers of neighbours and each share: how many of the reference rows that are least known by one are so by the other. Ties go to the smaller id.

    Ranks come from running totals over range partitions, so no task sorts all rows.
    """
    own = materialize(rows.filter(F.col("source") == REFERENCE).select("id", *(f"known_{k}" for k in NEIGHBOURS)))
    n = own.count()
    ranks = None
    for k in NEIGHBOURS:
        r = running_totals(own.select(F.col("id").alias(f"id_{k}"), F.struct(f"known_{k}", "id").alias("o"), F.lit(1).alias("one")), "o", {f"r_{k}": "one"}).select(f"id_{k}", f"r_{k}")
        ranks = r if ranks is None else ranks.join(r, F.col(f"id_{NEIGHBOURS[0]}") == F.col(f"id_{k}"))
    sets = [(a, b, f, max(1, ceil(n * f))) for i, a in enumerate(NEIGHBOURS) for b in NEIGHBOURS[i + 1 :] for f in FRACTIONS]
    sums = ranks.agg(*(A.count_if((F.col(f"r_{a}") <= c) & (F.col(f"r_{b}") <= c)).cast("long").alias(f"x{i}") for i, (a, b, _, c) in enumerate(sets)))
    each = F.array(*(F.struct(F.lit(a).alias("left_k"), F.lit(b).alias("right_k"), F.lit(f).alias("bottom_fraction"), F.lit(c).cast("long").alias("events_per_set"), F.col(f"x{i}").alias("intersection"), F.round(F.col(f"x{i}") / (2.0 * c - F.col(f"x{i}")), 6).alias("jaccard")) for i, (a, b, f, c) in enumerate(sets)))
    return sums.select(F.inline(each)) if n else sums.select(F.inline(each)).limit(0)


def rank_agreement(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Rank correlation, with its p-value, of each named pair of columns over the reference rows."""
    own = rows.filter(F.col("source") == REFERENCE)
    long = own.select(F.inline(F.array(*(F.struct(F.lit(n).alias("pair"), F.round(F.col(a).cast("double"), 6).alias("a"), F.round(F.col(b).cast("double"), 6).alias("b")) for n, (a, b) in pairs.items()))))
    return agreement.rank_tests(long, "pair", "a", "b").select("pair", "n", F.round("spearman", 6).alias("spearman"), F.round("p_value", 6).alias("p_value"))


def diagnose(rows: DataFrame) -> dict[str, DataFrame]:
    """All tables of a diagnosis, by name; the rows are written once and every table reads them from there."""
    rows = materialize(rows)
    edges = materialize(thresholds(rows))
    marked = materialize(flagged(rows, edges))
    own, others = marked.filter(F.col("source") == REFERENCE), marked.filter(F.col("source") != REFERENCE)
    known = own.filter(F.col("truth").isNotNull())
    pairs = {f"knownness_k{a}/k{b}": (f"known_{a}", f"known_{b}") for i, a in enumerate(NEIGHBOURS) for b in NEIGHBOURS[i + 1 :]} | {f"p/{c}": ("p", c) for c in ("sim_logging", "sim_wildfire", "similarity_margin")}
    return {
        "rows": marked,
        "agreement_summary": agreement_summary(others),
        "disagreement_diagnosis": others.filter("diagnosis is not null").groupBy("diagnosis").agg(F.count(F.lit(1)).alias("events")),
        "domain_shift": domain_shift(marked, edges),
        "lowest_overlap": lowest_overlap(marked),
        "rank_agreement": rank_agreement(marked, pairs),
        "nearest_class": known.groupBy().agg(*A.binary_metrics(F.col("truth") == "Wildfire", F.col("nearest_class") == "Wildfire"), F.round(F.avg((F.col("nearest_class") == F.col("first")).cast("double")), 6).alias("agreement_with_first")),
        "reject_rules": E.reject_rules(known, "p", F.col("truth") == "Wildfire", "known_5", [BAND], list(FRACTIONS), list(FRACTIONS)),
    }
