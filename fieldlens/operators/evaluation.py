"""Evaluation of reviewed events: kinds of points, threshold rules, merges of neighbouring events, paired resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.operators import aggregate as A
from fieldlens.plans.components import connected_components
from fieldlens.plans.lineage import materialize
from fieldlens.plans.prefix import running_totals


def point_taxonomy(events: DataFrame) -> DataFrame:
    """One row per sample_id: its kind, counts of events and of valid ones, and the flags the kind is decided by.

    Points of one event are SINGLE_HANSEN_EVENT; the others go by the first
    flag that holds: both classes, a class repeated, a valid event beside one of
    another year, a valid event beside a small one; else UNRESOLVED.
    """
    n = lambda c: A.count_if(F.col("review_class") == c)
    per = events.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_events"), n("VALID_LOGGING").alias("n_valid_logging"), n("VALID_WILDFIRE").alias("n_valid_wildfire"),
        n("YEAR_MISMATCH").alias("n_year_mismatch"), n("EVENT_TOO_SMALL").alias("n_event_too_small"),
    )
    valid = F.col("n_valid_logging") + F.col("n_valid_wildfire")
    flags = {
        "has_true_class_change": (F.col("n_valid_logging") > 0) & (F.col("n_valid_wildfire") > 0),
        "has_repeated_same_class": (F.col("n_valid_logging") > 1) | (F.col("n_valid_wildfire") > 1),
        "has_temporal_tails": (valid > 0) & (F.col("n_year_mismatch") > 0),
        "has_small_components": (valid > 0) & (F.col("n_event_too_small") > 0),
    }
    kinds = ("TRUE_CLASS_CHANGE", "REPEATED_SAME_CLASS", "SINGLE_PHYSICAL_EVENT_WITH_TEMPORAL_TAILS", "DOMINANT_EVENT_WITH_SMALL_COMPONENTS")
    kind = F.when(F.col("n_events") < 2, "SINGLE_HANSEN_EVENT")
    for flag, name in zip(flags, kinds, strict=True):
        kind = kind.when(F.col(flag), name)
    return per.withColumns({"n_valid_events": valid, "n_rejected_events": F.col("n_events") - valid} | flags).withColumn("point_type", kind.otherwise("UNRESOLVED"))


def small_event_rules(events: DataFrame, features: list[str], least_rows: int = 5, least_precision: float = 0.7) -> DataFrame:
    """For each feature, the rule "at or below the threshold is too small" that is recommended.

    The cohort is valid events and those reviewed as too small. Among thresholds
    that cover ``least_rows`` rows with the least precision, the one of highest
    recall is taken (then precision, then threshold); if there is none, the one
    of highest F1 (then precision, then the smallest threshold).
    """
    cohort = events.filter((F.col("review_status") == "VALID") | (F.col("review_class") == "EVENT_TOO_SMALL")).withColumn("__small", F.col("review_class") == "EVENT_TOO_SMALL")
    long = cohort.select("__small", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))).alias("x")).select("__small", "x.*").filter("value is not null")
    per = materialize(long.groupBy("feature", "value").agg(A.count_if(F.col("__small")).alias("p"), A.count_if(~F.col("__small")).alias("q")))
    every = None
    for f in features:  # one running total a feature: features are few
        swept = running_totals(per.filter(F.col("feature") == f), "value", {"tp": "p", "fp": "q"})
        every = swept if every is None else every.unionByName(swept)
    every = every.join(F.broadcast(per.groupBy(F.col("feature").alias("f")).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))), F.col("feature") == F.col("f"))  # as many rows as features
    tp, covered = F.col("tp").cast("double"), F.col("tp") + F.col("fp")
    rules = every.filter("all_p > 0 and all_q > 0").withColumns({"precision": tp / covered, "recall": tp / F.col("all_p"), "f1": 2 * tp / (covered + F.col("all_p")), "rows": covered})
    fine = (F.col("rows") >= least_rows) & (F.col("precision") >= least_precision)
    rank = F.struct(fine.alias("fine"), F.when(fine, F.col("recall")).otherwise(F.col("f1")).alias("a"), F.col("precision").alias("b"), F.when(fine, F.col("value")).otherwise(-F.col("value")).alias("c"))
    best = rules.groupBy("feature").agg(F.max_by(F.struct("value", "precision", "recall", "rows", "fp", fine.alias("fine")), rank).alias("r"), F.any_value("all_p").alias("too_small_events"), F.any_value("all_q").alias("valid_events"))
    status = F.when(F.col("r.fine"), "candidate_rule_at_least_70_percent_precision" if least_precision == 0.7 else "candidate_rule").otherwise("best_exploratory_f1_below_70_percent_precision" if least_precision == 0.7 else "best_exploratory_f1")
    return best.select("feature", status.alias("recommendation_status"), F.col("r.value").alias("threshold"), F.round("r.precision", 6).alias("precision"), F.round("r.recall", 6).alias("recall"), F.col("r.rows").alias("events_below"), F.col("r.fp").alias("valid_events_below"), "too_small_events", "valid_events")


def merge_pairs(events: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one point's events at most a year apart, with relative area and outcome of the proposal to merge them.

    A pair is proposed if the smaller area is at most the threshold's share of
    the larger. Two valid events are a bad merge, a valid one with one of another
    year or a small one is good, everything else unresolved. An event meets the
    events of its own and the next year only.
    """
    e = events.select("sample_id", "event_id", "event_year", "area_ha", "review_class")
    a = e.select("sample_id", *(F.col(c).alias(f"{c}_a") for c in e.columns[1:]))
    b = e.select(F.col("sample_id").alias("__s"), *(F.col(c).alias(f"{c}_b") for c in e.columns[1:]), F.explode(F.array("event_year", F.col("event_year") - 1)).alias("__y"))
    once = (F.col("event_year_b") > F.col("event_year_a")) | (F.col("event_id_b") > F.col("event_id_a"))
    met = a.join(b, (F.col("sample_id") == F.col("__s")) & (F.col("event_year_a") == F.col("__y")) & once)
    valid = [F.col(f"review_class_{s}").startswith("VALID_") for s in "ab"]
    tail = F.col("review_class_a").isin("YEAR_MISMATCH", "EVENT_TOO_SMALL") | F.col("review_class_b").isin("YEAR_MISMATCH", "EVENT_TOO_SMALL")
    identifiable = (valid[0] != valid[1]) & tail
    relative = F.least("area_ha_a", "area_ha_b") / F.greatest("area_ha_a", "area_ha_b")
    known = met.filter(F.col("area_ha_a").isNotNull() & F.col("area_ha_b").isNotNull() & (F.greatest("area_ha_a", "area_ha_b") > 0))
    rows = known.withColumns({"relative_area": relative, "identifiable_tail_pair": identifiable, "proposed": relative <= threshold})
    outcome = F.when(~F.col("proposed"), "NOT_PROPOSED").when(valid[0] & valid[1], "BAD_MERGE").when(F.col("identifiable_tail_pair"), "GOOD_MERGE").otherwise("UNRESOLVED")
    return rows.select("sample_id", "event_id_a", "event_id_b", "event_year_a", "event_year_b", "review_class_a", "review_class_b", "relative_area", "proposed", "identifiable_tail_pair", outcome.alias("outcome"))


def merge_simulation(events: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: what merging all proposed pairs, or the good ones only, would do to the points of two events or more."""
    many = events.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = materialize(merge_pairs(events, threshold))

    def left(kept: Column) -> Column:
        """Events that a merge takes away: the members of the groups less one for each group."""
        roots = connected_components(pairs.filter(kept).select(F.col("event_id_a").alias("a"), F.col("event_id_b").alias("b")))
        return roots.agg((F.count(F.lit(1)) - F.count_distinct("root")).alias("n"))

    n = lambda c: A.count_if(c).cast("long")
    is_ = lambda x: F.col("outcome") == x
    sums = pairs.agg(F.count(F.lit(1)).alias("adjacent_pairs"), n(F.col("proposed")).alias("proposed_merges"), n(is_("GOOD_MERGE")).alias("good_merges"), n(is_("BAD_MERGE")).alias("bad_merges"), n(is_("UNRESOLVED")).alias("unresolved_merges"), n(F.col("identifiable_tail_pair")).alias("__tails"))
    before = many.agg(F.count(F.lit(1)).alias("multi_event_points"), F.coalesce(F.sum("n"), F.lit(0)).alias("physical_events_before"))
    row = before.join(F.broadcast(sums)).join(F.broadcast(left(F.col("proposed")).withColumnRenamed("n", "__all"))).join(F.broadcast(left(is_("GOOD_MERGE")).withColumnRenamed("n", "__good")))  # one row each
    good = F.col("good_merges").cast("double")
    return row.select(
        "multi_event_points", "adjacent_pairs", "proposed_merges", "good_merges", "bad_merges", "unresolved_merges",
        F.round(A.ratio(good, F.col("good_merges") + F.col("bad_merges")), 6).alias("merge_precision_resolved"), F.round(A.ratio(good, F.col("__tails")), 6).alias("merge_recall_identifiable_tails"),
        "physical_events_before", (F.col("physical_events_before") - F.col("__all")).alias("event_groups_after_all_proposals"), (F.col("physical_events_before") - F.col("__good")).alias("event_groups_after_good_only"),
    )


#: Cells of a paired comparison: a model's hits and misses on each class.
CELLS = ("tp", "tn", "fp", "fn")


def _measures(prefix: str) -> dict[str, Column]:
    """Measures from the cells of one model; undefined ratios are 0."""
    tp, tn, fp, fn = (F.col(f"{prefix}_{c}").cast("double") for c in CELLS)
    r = lambda a, b: A.ratio(a, b, 0.0)
    return {"accuracy": r(tp + tn, tp + tn + fp + fn), "balanced_accuracy": (r(tp, tp + fn) + r(tn, tn + fp)) / 2, "macro_f1": (r(2 * tp, 2 * tp + fp + fn) + r(2 * tn, 2 * tn + fp + fn)) / 2}


def paired_bootstrap(rows: DataFrame, cluster: str, truth: Column, first: Column, second: Column, runs: int = 200) -> DataFrame:
    """For each measure: both models' values, their difference, and its mean, median, interval and share above 0 over resamplings of whole clusters.

    Both models are measured on the same draw. Clusters are summed first; a run
    draws as many clusters as there are, with replacement, by hash, so runs x
    clusters narrow rows are spread over tasks of bounded size.
    """
    from fieldlens.operators.learn import resampled

    cells = [c for name, p in (("a", first), ("b", second)) for c in (A.count_if(truth & p).alias(f"{name}_tp"), A.count_if(~truth & ~p).alias(f"{name}_tn"), A.count_if(~truth & p).alias(f"{name}_fp"), A.count_if(truth & ~p).alias(f"{name}_fn"))]
    names = [f"{m}_{c}" for m in "ab" for c in CELLS]
    sums = materialize(rows.groupBy(F.col(cluster).alias("c")).agg(*cells))
    numbered = materialize(running_totals(sums.withColumn("one", F.lit(1)), "c", {"i": "one"}).select((F.col("i") - 1).alias("i"), *names))
    k = sums.count()
    each = resampled(numbered, k, runs).groupBy("run").agg(*(F.sum(n).alias(n) for n in names))
    pair = lambda: F.array(*(F.struct(F.lit(m).alias("metric"), x.alias("a"), y.alias("b")) for (m, x), y in zip(_measures("a").items(), _measures("b").values(), strict=True)))
    spread = each.select(F.explode(pair()).alias("x")).select("x.metric", (F.col("x.a") - F.col("x.b")).alias("delta"))
    spread = spread.groupBy(F.col("metric").alias("m")).agg(F.avg("delta").alias("mean"), F.percentile("delta", [0.5, 0.025, 0.975]).alias("q"), F.avg((F.col("delta") > 0).cast("double")).alias("above"), F.count(F.lit(1)).alias("n"))
    point = sums.agg(*(F.sum(n).alias(n) for n in names)).select(F.explode(pair()).alias("x")).select("x.*")
    joined = point.join(F.broadcast(spread), F.col("metric") == F.col("m"))  # three rows
    r = lambda c, n: F.round(c, 6).alias(n)
    return joined.select("metric", r(F.col("a"), "first"), r(F.col("b"), "second"), r(F.col("a") - F.col("b"), "point_delta"), F.col("n").alias("bootstrap_runs"), r(F.col("mean"), "mean_delta"), r(F.col("q")[0], "median_delta"), r(F.col("q")[1], "ci_low"), r(F.col("q")[2], "ci_high"), r(F.col("above"), "probability_delta_gt_zero"))


def reject_rules(rows: DataFrame, probability: str, truth: Column, known: str, bands: list[tuple[float, float]], fractions: list[float], combined: list[float]) -> DataFrame:
    """What is left, and how right it is, when events are rejected: by a band of the probability, by a quantile of the knownness, or by both.

    Events below the quantile are unknown; those in the band are ambiguous, in
    the combined rules only if they aren't unknown. ``known`` is in every row.
    """
    rules = [("ambiguity", None, *b) for b in bands] + [("knownness", f, None, None) for f in fractions] + [("combined", f, *b) for f in combined for b in bands]
    grid = rows.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rules)], "i int, rule string, fraction double, lower double, upper double")
    used = sorted({f for _, f, _, _ in rules if f is not None})
    edges = rows.agg(F.percentile(known, used).alias("e")).select(F.inline(F.arrays_zip(F.array(*(F.lit(f) for f in used)).alias("at"), F.col("e").alias("threshold"))))
    grid = grid.join(F.broadcast(edges), F.col("fraction") == F.col("at"), "left").drop("at")  # a few rows
    each = rows.select(F.col(probability).alias("__p"), truth.alias("__t"), F.col(known).alias("__k")).crossJoin(F.broadcast(grid))  # against a short list of rules
    unknown = F.coalesce(F.col("__k") < F.col("threshold"), F.lit(False))
    ambiguous = ~unknown & F.coalesce(F.col("__p").between(F.col("lower"), F.col("upper")), F.lit(False))
    kept = ~(unknown | ambiguous)
    right = (F.col("__p") >= 0.5) == F.col("__t")
    sums = each.groupBy("i", "rule", "fraction", "lower", "upper", "threshold").agg(A.count_if(unknown).alias("unknown_events"), A.count_if(ambiguous).alias("ambiguous_events"), A.count_if(kept).alias("retained_events"), F.count(F.lit(1)).alias("n"), A.count_if(kept & right).alias("hits"))
    return sums.select("rule", "fraction", "lower", "upper", F.round("threshold", 6).alias("threshold"), "unknown_events", "ambiguous_events", "retained_events", F.round(F.col("retained_events") / F.col("n"), 6).alias("coverage"), F.round(A.ratio(F.col("hits").cast("double"), F.col("retained_events")), 6).alias("accuracy"))


def pair_sweep(a: DataFrame, b: DataFrame, kilometres: list[float], years: list[int]) -> DataFrame:
    """For each distance and gap in years: pairs of points (id, lat, lon, year) of two tables, and how many a one-to-one matching by distance takes.

    Points at one place count together. A matching takes the nearest first, so
    those of smaller distances are the first pairs of that of the largest.
    """
    from fieldlens.operators import joins as J

    most = max(kilometres) * 1000.0
    sides = []
    for rows in (a, b):
        per = rows.groupBy("lat", "lon", "year").agg(F.count(F.lit(1)).alias("n")).groupBy("lat", "lon").agg(F.collect_list(F.struct("year", "n")).alias("id"))
        sides.append(per.select("id", "lat", "lon"))
    near = J.within_distance(*sides, most).select(F.explode("a_id").alias("a"), "b_id", "distance_m").select("a", F.explode("b_id").alias("b"), "distance_m")
    grid = [(float(k), g) for k in kilometres for g in years]
    fits = [(F.col("distance_m") <= k * 1000.0) & (F.abs(F.col("a.year") - F.col("b.year")) <= g) for k, g in grid]
    sums = near.agg(*(F.coalesce(F.sum(F.when(fit, F.col("a.n") * F.col("b.n"))), F.lit(0)).alias(f"n{i}") for i, fit in enumerate(fits)))
    counts = sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("max_km"), F.lit(g).alias("max_years"), F.col(f"n{i}").alias("pairs")) for i, (k, g) in enumerate(grid)))))
    unique = None
    for g in sorted(set(years)):
        taken = J.matched_within(a, b, most, g)
        row = taken.agg(*(F.count(F.when(F.col("distance_m") <= k * 1000.0, 1)).alias(f"n{i}") for i, k in enumerate(kilometres)))
        row = row.select(F.inline(F.array(*(F.struct(F.lit(float(k)).alias("km"), F.lit(g).alias("gap"), F.col(f"n{i}").alias("unique_pairs")) for i, k in enumerate(kilometres)))))
        unique = row if unique is None else unique.unionByName(row)
    return counts.join(F.broadcast(unique), (F.col("max_km") == F.col("km")) & (F.col("max_years") == F.col("gap"))).select("max_km", "max_years", "pairs", "unique_pairs")  # a row of each combination


def artifact_status(wanted: DataFrame, found: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Whether a stored artifact may be used again: missing, reuse, or incompatible with the names of all identity fields that differ. A null matches a null only."""
    there = found.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in identity), F.lit(True).alias("__there"))
    failed = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), c) for c in sorted(identity))))
    joined = wanted.join(there, F.col(key) == F.col("__k"), "left")
    status = F.when(F.col("__there").isNull(), "missing").when(F.size(failed) == 0, "reuse").otherwise("incompatible")
    return joined.select(key, status.alias("status"), F.when(status == "incompatible", F.concat_ws(",", failed)).otherwise("").alias("failed_checks"))
