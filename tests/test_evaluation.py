"""Evaluation operators on small hand-made rows, against sequential versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from fieldlens.operators import evaluation as E

EVENT = "sample_id string, event_id string, event_year int, review_status string, review_class string, area_ha double"


def events(spark, rows):
    return spark.createDataFrame([(s, f"{s}-{i}", y, "VALID" if c.startswith("VALID") else "REJECTED", c, a) for i, (s, y, c, a) in enumerate(rows)], EVENT)


def test_taxonomy_separates_tails_repeats_and_class_changes(spark):
    rows = [
        ("tail", 2020, "VALID_WILDFIRE"), ("tail", 2021, "YEAR_MISMATCH"), ("repeat", 2019, "VALID_WILDFIRE"), ("repeat", 2022, "VALID_WILDFIRE"), ("change", 2018, "VALID_LOGGING"), ("change", 2023, "VALID_WILDFIRE"),
        ("alone", 2018, "VALID_LOGGING"), ("small", 2018, "VALID_LOGGING"), ("small", 2019, "EVENT_TOO_SMALL"), ("none", 2018, "EVENT_TOO_SMALL"), ("none", 2019, "YEAR_MISMATCH"),
    ]
    got = {r["sample_id"]: r["point_type"] for r in E.point_taxonomy(events(spark, [(*r, 1.0) for r in rows])).collect()}
    assert got == {
        "tail": "SINGLE_PHYSICAL_EVENT_WITH_TEMPORAL_TAILS", "repeat": "REPEATED_SAME_CLASS", "change": "TRUE_CLASS_CHANGE",
        "alone": "SINGLE_HANSEN_EVENT", "small": "DOMINANT_EVENT_WITH_SMALL_COMPONENTS", "none": "UNRESOLVED",
    }


def test_a_small_event_rule_that_spares_accepted_events(spark):
    rows = [("a", 2000 + i, "VALID_LOGGING", 20.0 + i) for i in range(10)] + [("b", 2000 + i, "EVENT_TOO_SMALL", 0.5 + 0.2 * i) for i in range(6)] + [("c", 2000, "YEAR_MISMATCH", 0.1)]
    (got,) = E.small_event_rules(events(spark, rows), ["area_ha"]).collect()
    assert (got["recommendation_status"], got["threshold"], got["precision"], got["recall"], got["events_below"], got["valid_events_below"]) == ("candidate_rule_at_least_70_percent_precision", 1.5, 1.0, 1.0, 6, 0)
    few = [r for r in rows if r[0] == "a"] + [("b", 2000, "EVENT_TOO_SMALL", 25.5)]
    (got,) = E.small_event_rules(events(spark, few), ["area_ha"]).collect()
    assert (got["recommendation_status"], got["threshold"]) == ("best_exploratory_f1_below_70_percent_precision", 25.5)
    assert E.small_event_rules(events(spark, rows[:10]), ["area_ha"]).count() == 0  # one class only


def merged(rows, threshold):
    """The simulation, one point after the other."""
    of = defaultdict(list)
    for s, y, c, a in rows:
        of[s].append((y, c, a))
    found, groups, good_groups, tails, before = Counter(), 0, 0, 0, 0
    for events_of in of.values():
        if len(events_of) < 2:
            continue
        before += len(events_of)
        roots = [list(range(len(events_of))) for _ in range(2)]
        for i in range(len(events_of)):
            for j in range(i):
                (y, c, a), (z, d, b) = events_of[i], events_of[j]
                if abs(y - z) > 1 or max(a, b) <= 0:
                    continue
                valid = [c.startswith("VALID"), d.startswith("VALID")]
                tail = sum(valid) == 1 and bool({c, d} & {"YEAR_MISMATCH", "EVENT_TOO_SMALL"})
                tails += tail
                if min(a, b) / max(a, b) > threshold:
                    found["no"] += 1
                    continue
                kind = "bad" if all(valid) else "good" if tail else "open"
                found[kind] += 1
                for r in roots if kind == "good" else roots[:1]:
                    x, y2 = r[i], r[j]
                    r[:] = [x if v == y2 else v for v in r]
        groups += len(set(roots[0]))
        good_groups += len(set(roots[1]))
    return found, tails, before, groups, good_groups


def test_merge_simulation_equals_a_sequential_one(spark):
    rng = random.Random(3)
    kinds = ["VALID_LOGGING", "VALID_WILDFIRE", "YEAR_MISMATCH", "EVENT_TOO_SMALL", "OTHER_INVALID"]
    rows = [(f"s{rng.randint(0, 40)}", rng.randint(2015, 2020), rng.choice(kinds), rng.choice([0.0, 1.0, 2.0, 4.0, 9.0])) for _ in range(160)]
    (got,) = E.merge_simulation(events(spark, rows), 0.5).collect()
    found, tails, before, groups, good_groups = merged(rows, 0.5)
    assert (got["adjacent_pairs"], got["good_merges"], got["bad_merges"], got["unresolved_merges"]) == (sum(found.values()), found["good"], found["bad"], found["open"])
    assert (got["physical_events_before"], got["event_groups_after_all_proposals"], got["event_groups_after_good_only"]) == (before, groups, good_groups)
    assert got["merge_recall_identifiable_tails"] == round(found["good"] / tails, 6)


def test_paired_bootstrap_equals_numpy(spark):
    rng = random.Random(1)
    rows = [(i % 12, rng.random() < 0.5, rng.random() < 0.8, rng.random() < 0.5) for i in range(80)]
    rows = [(s, t, t == a, t == b) for s, t, a, b in rows]  # the first model is right more often
    got = {r["metric"]: r for r in E.paired_bootstrap(spark.createDataFrame(rows, "s int, t boolean, a boolean, b boolean"), "s", F.col("t"), F.col("a"), F.col("b"), 50).collect()}
    deltas = []
    for run in range(50):
        drawn = [int(hashlib.md5(f"{run}-{t}".encode()).hexdigest()[:8], 16) % 12 for t in range(12)]
        sample = [r for d in drawn for r in rows if r[0] == d]
        deltas.append(np.mean([t == a for _, t, a, _ in sample]) - np.mean([t == b for _, t, _, b in sample]))
    acc = got["accuracy"]
    assert acc["point_delta"] == round(np.mean([t == a for _, t, a, _ in rows]) - np.mean([t == b for _, t, _, b in rows]), 6) > 0
    assert [acc["mean_delta"], acc["ci_low"], acc["ci_high"], acc["probability_delta_gt_zero"]] == [round(float(x), 6) for x in (np.mean(deltas), np.quantile(deltas, 0.025), np.quantile(deltas, 0.975), np.mean(np.array(deltas) > 0))]
    assert set(got) == {"accuracy", "balanced_accuracy", "macro_f1"} and acc["bootstrap_runs"] == 50
