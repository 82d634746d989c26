"""Reviewed events of points studied as a whole: rankings of a point's years by several methods, events relative to the chosen year, and all result tables of a study in one call.

Events have sample_id, event_id, event_year, area_ha, pixels, dominant, review_status,
review_class, human_label, the models' p_a, p_b, label_a, label_b, and for the composite
score usable (scenes that can be used) and quality (0 to 1). A point has at most an
event a year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.operators import aggregate as A
from fieldlens.operators import evaluation as E
from fieldlens.operators import leave_out
from fieldlens.operators.learn import draw, numbers
from fieldlens.operators.ordered import rank_fraction
from fieldlens.plans.lineage import materialize

#: Methods by the rank fractions and scores they use, weights of the composite, labels and outcomes.
LEFT_OUT = "LOPO_LOGISTIC_REGRESSION"
COMPOSITE = {"area_ha": 0.45, "__p": 0.30, "usable": 0.15, "quality": 0.10}
TARGETS = ("Logging", "Wildfire")
OUTCOMES = ("VALID", "YEAR_MISMATCH", "EVENT_TOO_SMALL")
#: Events that a task ranks.
TASK_ROWS = 50_000
CLASSES = ("VALID_LOGGING", "VALID_WILDFIRE", "YEAR_MISMATCH", "EVENT_TOO_SMALL")


def mean_probability(*columns: str) -> Column:
    """Mean of the probabilities that are there; null if none is."""
    known = sum(F.col(c).isNotNull().cast("int") for c in columns)
    return sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns) / F.when(known > 0, known)


def evaluable_events(events: DataFrame) -> DataFrame:
    """Events of points with two events or more, one of them valid with a target label; adds ``is_target``, whether the event's year is such a year."""
    point = Window.partitionBy("sample_id")
    target = F.coalesce((F.col("review_status") == "VALID") & F.col("human_label").isin(*TARGETS), F.lit(False))
    found = events.withColumns({"is_target": target, "__events": F.count(F.lit(1)).over(point)}).withColumn("__targets", F.max("is_target").over(point))
    return found.filter("__events >= 2 and __targets").drop("__events", "__targets")


def year_rankings(events: DataFrame, left_out: DataFrame | None = None) -> DataFrame:
    """The evaluable events once for each method, with ``score``, ``rank`` in the point, and year, area and pixels of the event that the method selects.

    Methods: the dominant flag, the area, the models' mean probability, a
    composite of rank fractions, and the models that leave the point out, where
    ``left_out`` (event_id, p) has one. Ties go to the larger area, then the
    earlier year. A missing value scores -1, or 0 in the composite.
    """
    e = materialize(evaluable_events(events).withColumn("__p", mean_probability("p_a", "p_b")))
    e = e.repartition(max(1, -(-e.count() // TASK_ROWS)), "sample_id")  # every window below stays in these parts
    for c in COMPOSITE:
        e = e.withColumn(f"__f{c}", rank_fraction(c, ["sample_id"]))
    composite = sum((F.col(f"__f{c}") * w for c, w in COMPOSITE.items()), F.lit(0.0))
    methods = {"HISTORICAL_DOMINANT": F.coalesce(F.col("dominant"), F.lit(False)).cast("double"), "MAX_HANSEN_AREA": F.coalesce("area_ha", F.lit(-1.0)), "MAX_MODEL_MEAN_P_WILDFIRE": F.coalesce("__p", F.lit(-1.0)), "HAND_BUILT_COMPOSITE": composite}
    if left_out is not None:
        e = e.join(left_out.select(F.col("event_id").alias("__id"), F.col("p").alias("__left")), F.col("event_id") == F.col("__id"), "left")
        methods[LEFT_OUT] = F.col("__left")
    kept = [c for c in e.columns if not c.startswith("__")]
    each = e.select(*kept, F.inline(F.array(*(F.struct(F.lit(m).alias("method"), F.round(s, 9).alias("score")) for m, s in methods.items())))).filter("score is not null")
    w = Window.partitionBy("sample_id", "method").orderBy(F.desc("score"), F.coalesce("area_ha", F.lit(-1.0)).desc(), "event_year")
    chosen = {f"selected_{n}": F.first(c).over(w) for n, c in (("year", "event_year"), ("area", "area_ha"), ("pixels", "pixels"), ("event_id", "event_id"))}
    return each.withColumns({"rank": F.row_number().over(w)} | chosen)


def point_predictions(rankings: DataFrame) -> DataFrame:
    """One row per method and point: the selected year, whether it is or is next to a target, the first target's rank, and the years to the nearest target."""
    is_target, chosen = F.col("is_target"), F.col("selected_year")
    g = rankings.groupBy("method", "sample_id", "selected_year", "selected_event_id").agg(
        F.count(F.lit(1)).alias("candidate_events"), F.min(F.when(is_target, F.col("rank"))).alias("target_rank"), F.min(F.when(is_target, F.abs(F.col("event_year") - chosen))).alias("year_error"), F.sort_array(F.collect_set(F.when(is_target, F.col("event_year")))).alias("target_years")
    )
    return g.withColumns({"hit_at_1": F.col("year_error") == 0, "hit_at_2": F.col("target_rank") <= 2, "reciprocal_rank": 1.0 / F.col("target_rank")})


def method_metrics(predictions: DataFrame) -> DataFrame:
    """One row per method over its points."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return predictions.groupBy("method").agg(
        F.count(F.lit(1)).alias("eligible_points"), mean("hit_at_1").alias("hit_at_1"), mean("hit_at_2").alias("hit_at_2"), mean("reciprocal_rank").alias("mean_reciprocal_rank"), F.percentile("target_rank", 0.5).alias("median_target_rank"), mean("year_error").alias("mean_year_error")
    )


def relative_events(rankings: DataFrame) -> DataFrame:
    """Each ranked event against its method's selected one: years between, and the shares of its area and pixels.

    Shares have six digits, so that a quantile's counts stay bounded in number.
    """
    share = lambda c, of: F.round(F.col(c) / F.when(F.col(of) != 0, F.col(of)), 6)
    delta = F.col("event_year") - F.col("selected_year")
    return rankings.withColumns({"delta_year": delta, "abs_delta_year": F.abs(delta), "relative_area": share("area_ha", "selected_area"), "relative_pixels": share("pixels", "selected_pixels"), "models_disagree": ~F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False))})


def relative_summary(relative: DataFrame) -> DataFrame:
    """One row per method and years from the selected event: shares of the review classes, median area, models' means."""
    k = F.col("review_class")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return relative.groupBy("method", "delta_year").agg(
        F.count(F.lit(1)).alias("events"), share(k.startswith("VALID_")).alias("valid_share"), share(k == "YEAR_MISMATCH").alias("year_mismatch_share"), share(k == "EVENT_TOO_SMALL").alias("event_too_small_share"),
        share(k == "VALID_LOGGING").alias("logging_share"), share(k == "VALID_WILDFIRE").alias("wildfire_share"), F.round(F.percentile("relative_area", 0.5), 6).alias("median_relative_area"),
        F.round(F.avg("p_a"), 6).alias("mean_p_a"), F.round(F.avg("p_b"), 6).alias("mean_p_b"), share(F.col("models_disagree")).alias("model_disagreement_share"),
    ).withColumns({"rejected_share": F.round(1 - F.col("valid_share"), 6), "points": F.col("events")})


def relative_area_by_class(relative: DataFrame) -> DataFrame:
    """Mean and quartiles of the area against the point's largest one, for each review class."""
    g = relative.filter((F.col("method") == "MAX_HANSEN_AREA") & F.col("review_class").isin(*CLASSES)).groupBy("review_class")
    rows = g.agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("relative_area"), 6).alias("mean"), F.percentile("relative_area", [0.25, 0.5, 0.75]).alias("q"))
    return rows.select("review_class", "events", F.col("mean").alias("mean_relative_area"), *(F.round(F.col("q")[i], 6).alias(f"{n}_relative_area") for i, n in enumerate(("p25", "median", "p75"))))


def outcome_intervals(relative: DataFrame, runs: int = 200) -> DataFrame:
    """Shares of valid, misdated and small events at the selected year and a year beside it, by method, with 2.5 and 97.5 % quantiles over resampled points.

    Points are summed first. Those of equal sums are alike to the shares, and few sums differ, as a
    point has at most an event a year: so points are numbered by their sums, and a run's draw, by hash and
    with replacement, of as many points of the method and stratum as there are, falls into one of a few stretches of numbers.
    Nothing but counts is shuffled. All methods and strata go by the same hashes.
    """
    outcome = F.when(F.col("review_class").startswith("VALID_"), "VALID").otherwise(F.col("review_class"))
    stratum = F.when(F.col("abs_delta_year") == 0, "delta_0").when(F.col("abs_delta_year") == 1, "abs_delta_1")
    hits = [f"h{i}" for i in range(len(OUTCOMES))]
    sums = relative.withColumns({"stratum": stratum, "__o": outcome}).filter("stratum is not null").groupBy("method", "stratum", "sample_id").agg(F.count(F.lit(1)).alias("n"), *(A.count_if(F.col("__o") == o).alias(h) for h, o in zip(hits, OUTCOMES, strict=True)))
    alike = materialize(sums.groupBy("method", "stratum", "n", *hits).agg(F.count(F.lit(1)).alias("alike")))
    whole = materialize(alike.groupBy("method", "stratum").agg(F.sum("alike").alias("points"), F.sum(F.col("n") * F.col("alike")).alias("events"), *(F.sum(F.col(h) * F.col("alike")).alias(f"all_{h}") for h in hits)))
    part = Window.partitionBy("method", "stratum").orderBy("n", *hits)
    stretches = alike.select(F.xxhash64("method", "stratum").alias("g"), "n", *hits, F.sum("alike").over(part).alias("upto"), (F.sum("alike").over(part) - F.col("alike")).alias("first"), F.sum("alike").over(Window.partitionBy("method", "stratum")).alias("points"))
    most = whole.agg(F.max("points")).first()[0] or 0
    hashes = numbers(whole.sparkSession, most, runs).select("run", "t", draw(F.col("run"), F.col("t")).alias("u"))
    at = F.col("u") % F.col("points")
    drawn = hashes.join(F.broadcast(stretches), (F.col("t") < F.col("points")) & (at >= F.col("first")) & (at < F.col("upto")))  # a few stretches a method
    each = drawn.groupBy("g", "run").agg(*((F.sum(h) / F.sum("n")).alias(h) for h in hits))
    each = each.join(F.broadcast(whole.select(F.xxhash64("method", "stratum").alias("__g"), "method", "stratum")), F.col("g") == F.col("__g"))  # two rows a method
    spread = each.groupBy("method", "stratum").agg(*(F.percentile(h, [0.025, 0.975]).alias(f"q_{h}") for h in hits))
    r = lambda c, n: F.round(c, 6).alias(n)
    rows = F.array(*(F.struct(F.lit(o).alias("outcome"), r(F.col(f"all_{h}") / F.col("events"), "estimate"), r(F.col(f"q_{h}")[0], "ci_low"), r(F.col(f"q_{h}")[1], "ci_high")) for h, o in zip(hits, OUTCOMES, strict=True)))
    return whole.join(F.broadcast(spread), ["method", "stratum"]).select("method", "stratum", "events", "points", F.inline(rows))  # two rows a method


def fixed_rules(events: DataFrame, baseline: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Frozen rules "at or below the threshold is too small", each alone and any of them, on the points that are not in ``baseline`` (sample_id).

    A rule is measured on the events that have its feature, "any" on those that
    have one at least; ``missing_events`` counts the others. Undefined ratios are null.
    """
    fresh = events.join(baseline.select("sample_id").distinct(), "sample_id", "left_anti")
    low = {f: F.col(f).cast("double") <= t for f, t in thresholds.items()}
    either = F.when(F.coalesce(*(c.cast("int") for c in low.values())).isNotNull(), F.greatest(*(c.cast("int") for c in low.values()), F.lit(0)) == 1)
    rules = [(f, f"{f} <= {t}", t, low[f]) for f, t in thresholds.items()] + [("combined_or", "ANY_FIXED_THRESHOLD", None, either)]
    small, valid = F.coalesce(F.col("review_class") == "EVENT_TOO_SMALL", F.lit(False)), F.coalesce(F.col("review_status") == "VALID", F.lit(False))
    each = fresh.select(small.alias("__small"), valid.alias("__valid"), F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(n).alias("rule"), F.lit(t).cast("double").alias("threshold"), c.alias("hit")) for f, n, t, c in rules))))
    hit, known, n = F.col("hit"), F.col("hit").isNotNull(), F.count_if
    cells = {
        "events": n(known), "missing_events": n(~known), "event_too_small_events": n(known & F.col("__small")), "predicted_small_events": n(hit), "true_positive": n(hit & F.col("__small")), "false_positive": n(hit & ~F.col("__small")),
        "false_negative": n(~hit & F.col("__small")), "true_negative": n(~hit & ~F.col("__small")), "valid_events": n(known & F.col("__valid")), "valid_events_lost": n(hit & F.col("__valid")),
    }
    rows = each.groupBy("feature", "rule", "threshold").agg(*(c.alias(x) for x, c in cells.items()))
    r = lambda a, b: F.round(A.ratio(F.col(a).cast("double"), sum((F.col(x) for x in b), F.lit(0))), 6)
    ratios = {"precision": r("true_positive", ("true_positive", "false_positive")), "recall": r("true_positive", ("true_positive", "false_negative")), "specificity": r("true_negative", ("true_negative", "false_positive")), "valid_lost_rate": r("valid_events_lost", ("valid_events",))}
    f1 = F.when((F.col("true_positive") > 0), F.round(2.0 * F.col("true_positive") / (2 * F.col("true_positive") + F.col("false_positive") + F.col("false_negative")), 6))
    return rows.withColumns(ratios | {"f1": f1})


def summary(events: DataFrame, predictions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row, the head of a study: reviewed, valid and rejected events, points, and points where methods select different years."""
    n = F.count_if
    chosen = predictions.groupBy("sample_id").agg((F.min("selected_year") != F.max("selected_year")).alias("differs"))
    head = events.agg(F.count(F.lit(1)).alias("reviewed_events"), n(F.col("review_status") == "VALID").alias("valid_events"), n(F.col("review_status") == "REJECTED").alias("rejected_events"))
    points = taxonomy.agg(F.count(F.lit(1)).alias("reviewed_points"), n(F.col("n_events") > 1).alias("multi_event_points"))
    apart = chosen.agg(F.count(F.lit(1)).alias("evaluable_points"), n(F.col("differs")).alias("points_where_methods_differ"))
    return head.join(F.broadcast(points)).join(F.broadcast(apart))  # one row each


def study(events: DataFrame, baseline: DataFrame, thresholds: dict[str, float], features: list[str] | None = None, runs: int = 200, merge_threshold: float = 0.5) -> dict[str, DataFrame]:
    """All result tables of a study of reviewed events, by name, as ``writers.export_tables`` takes them.

    With ``features`` there are rankings by models that leave a point out. The
    events are written once and every table reads them from there; so are the rankings.
    """
    e = materialize(events)
    left_out = None
    if features:
        used = evaluable_events(e).withColumn("__target", F.col("is_target").cast("int"))
        left_out = materialize(leave_out.leave_one_out(used, "sample_id", "__target", features).select("event_id", "p"))
    rankings = materialize(year_rankings(e, left_out))
    predictions, relative = materialize(point_predictions(rankings)), relative_events(rankings)
    taxonomy = materialize(E.point_taxonomy(e))
    fire = lambda c: F.col(c) == "Wildfire"
    return {
        "summary": summary(e, predictions, taxonomy),
        "hierarchy_counts": A.counts(e.withColumn("review_class", F.coalesce("review_class", F.lit("(missing)"))), ["review_class"]),
        "taxonomy": taxonomy,
        "taxonomy_counts": A.counts(taxonomy, ["point_type"]),
        "paired_models": E.paired_bootstrap(e.filter(F.col("human_label").isin(*TARGETS)), "sample_id", fire("human_label"), fire("label_a"), fire("label_b"), runs),
        "fixed_small_event_rules": fixed_rules(e, baseline, thresholds),
        "ranking_metrics": method_metrics(predictions),
        "point_predictions": predictions.withColumn("target_years", F.array_join("target_years", ",")),
        "ranking_details": rankings.select("method", "sample_id", "event_id", "event_year", "review_class", "score", "rank", "is_target"),
        "dominant_relative": relative_summary(relative),
        "relative_area_by_class": relative_area_by_class(relative),
        "outcome_intervals": outcome_intervals(relative, runs),
        "merge_pairs": E.merge_pairs(e, merge_threshold),
        "merge_simulation": E.merge_simulation(e, merge_threshold),
    }
