"""Studies of reviewed events against plain loops over the same rows."""

import random
import statistics
from collections import defaultdict

from fieldlens.operators import research as R
from fieldlens.sources import writers as W

SCHEMA = "sample_id long, event_id string, event_year int, area_ha double, pixels long, dominant boolean, review_status string, review_class string, human_label string, p_a double, p_b double, label_a string, label_b string, usable long, quality double"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def made(seed, points):
    rng, rows = random.Random(seed), []
    maybe = lambda x: None if rng.random() < 0.15 else x
    for s in range(points):
        years = rng.sample(range(2015, 2022), rng.choice([1, 2, 3, 5]))
        for y in years:
            kind = rng.choice(["VALID_LOGGING", "VALID_WILDFIRE", "YEAR_MISMATCH", "EVENT_TOO_SMALL", None])
            label = {"VALID_LOGGING": "Logging", "VALID_WILDFIRE": "Wildfire"}.get(kind)
            pixels = rng.choice([0, 1, 2, 9])
            rows.append((s, f"{s}-{y}", y, maybe(float(rng.choice([0, 1, 2, 5, 40]))), pixels, maybe(y == years[0]), "VALID" if label else "REJECTED", kind, label, maybe(rng.randint(0, 4) / 4), maybe(rng.randint(0, 4) / 4), rng.choice(["Logging", "Wildfire"]), rng.choice(["Logging", "Wildfire"]), rng.randint(0, 3), rng.choice([0.0, 0.5, 1.0])))
    return [dict(zip(NAMES, r, strict=True)) for r in rows]


def fraction(values):
    seen = sorted({v for v in values if v is not None})
    return [0.0 if v is None else 1.0 if len(seen) == 1 else seen.index(v) / (len(seen) - 1) for v in values]


def loop(rows):
    """{(method, sample): (its events by rank, target years)}"""
    points = defaultdict(list)
    for r in rows:
        points[r["sample_id"]].append(r)
    out = {}
    for s, events in points.items():
        targets = {r["event_year"] for r in events if r["review_status"] == "VALID" and r["human_label"] in ("Logging", "Wildfire")}
        if len(events) < 2 or not targets:
            continue
        p = [statistics.mean([x for x in (r["p_a"], r["p_b"]) if x is not None]) if (r["p_a"], r["p_b"]) != (None, None) else None for r in events]
        area = [r["area_ha"] for r in events]
        parts = [fraction(area), fraction(p), fraction([r["usable"] for r in events]), fraction([r["quality"] for r in events])]
        scores = {
            "HISTORICAL_DOMINANT": [float(bool(r["dominant"])) for r in events],
            "MAX_HANSEN_AREA": [-1.0 if a is None else a for a in area],
            "MAX_MODEL_MEAN_P_WILDFIRE": [-1.0 if x is None else x for x in p],
            "HAND_BUILT_COMPOSITE": [round(0.45 * a + 0.3 * b + 0.15 * c + 0.1 * d, 9) for a, b, c, d in zip(*parts, strict=True)],
        }
        for method, score in scores.items():
            order = sorted(range(len(events)), key=lambda i: (-score[i], -(-1.0 if area[i] is None else area[i]), events[i]["event_year"]))  # noqa: B023
            out[method, s] = [events[i] for i in order], targets
    return out


def test_rankings_and_predictions_equal_the_loop(spark):
    rows = made(1, 120)
    wanted = loop(rows)
    rankings = R.year_rankings(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)).cache()
    got = defaultdict(dict)
    for r in rankings.collect():
        got[r["method"], r["sample_id"]][r["rank"]] = r["event_id"]
    assert {k: [e[i + 1] for i in range(len(e))] for k, e in got.items()} == {k: [r["event_id"] for r in events] for k, (events, _) in wanted.items()}
    for r in R.point_predictions(rankings).collect():
        events, targets = wanted[r["method"], r["sample_id"]]
        rank = min(i for i, e in enumerate(events, 1) if e["event_year"] in targets)
        assert (r["selected_year"], r["target_rank"], r["hit_at_1"], r["hit_at_2"]) == (events[0]["event_year"], rank, rank == 1, rank <= 2)
        assert r["year_error"] == min(abs(events[0]["event_year"] - y) for y in targets) and r["target_years"] == sorted(targets) and r["candidate_events"] == len(events)
    metrics = {r["method"]: r for r in R.method_metrics(R.point_predictions(rankings)).collect()}
    ranks = [min(i for i, e in enumerate(events, 1) if e["event_year"] in t) for (m, _), (events, t) in wanted.items() if m == "HAND_BUILT_COMPOSITE"]
    found = metrics["HAND_BUILT_COMPOSITE"]
    assert found["eligible_points"] == len(ranks) and found["median_target_rank"] == statistics.median(ranks) and abs(found["mean_reciprocal_rank"] - statistics.mean(1 / x for x in ranks)) < 1e-6


def test_relative_events_equal_the_loop(spark):
    rows = made(2, 150)
    rankings = R.year_rankings(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA))
    relative = R.relative_events(rankings).cache()
    groups, classes = defaultdict(list), defaultdict(list)
    for (method, _), (events, _) in loop(rows).items():
        top = events[0]
        for e in events:
            share = e["area_ha"] / top["area_ha"] if e["area_ha"] is not None and top["area_ha"] else None
            groups[method, e["event_year"] - top["event_year"]].append((e, share))
            if method == "MAX_HANSEN_AREA":
                classes[e["review_class"]].append(share)
    got = {(r["method"], r["delta_year"]): r for r in R.relative_summary(relative).collect()}
    assert got.keys() == groups.keys()
    for k, r in got.items():
        shares = [s for _, s in groups[k] if s is not None]
        assert r["events"] == len(groups[k]) and abs(r["valid_share"] - statistics.mean(bool(e["human_label"]) for e, _ in groups[k])) < 1e-6
        assert abs(r["model_disagreement_share"] - statistics.mean(e["label_a"] != e["label_b"] for e, _ in groups[k])) < 1e-6
        assert (r["median_relative_area"] is None and not shares) or abs(r["median_relative_area"] - statistics.median(shares)) < 2e-6
    for r in R.relative_area_by_class(relative).collect():
        shares = [s for s in classes[r["review_class"]] if s is not None]
        assert r["events"] == len(classes[r["review_class"]]) and abs(r["median_relative_area"] - statistics.median(shares)) < 2e-6 and abs(r["mean_relative_area"] - statistics.mean(shares)) < 2e-6


def test_intervals_enclose_their_estimates(spark):
    rows = made(3, 150)
    relative = R.relative_events(R.year_rankings(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)))
    found = R.outcome_intervals(relative, 200).collect()
    wanted = defaultdict(list)
    for (method, s), (events, _) in loop(rows).items():
        for e in events:
            gap = abs(e["event_year"] - events[0]["event_year"])
            if gap < 2:
                wanted[method, "delta_0" if gap == 0 else "abs_delta_1"].append((s, e["review_class"]))
    assert len(found) == 3 * len(wanted)
    for r in found:
        cohort = wanted[r["method"], r["stratum"]]
        hits = [(k or "").startswith("VALID_") if r["outcome"] == "VALID" else k == r["outcome"] for _, k in cohort]
        assert r["events"] == len(cohort) and r["points"] == len({s for s, _ in cohort}) and abs(r["estimate"] - statistics.mean(hits)) < 1e-6
        spread = (statistics.mean(hits) * (1 - statistics.mean(hits)) / len(hits)) ** 0.5
        assert r["ci_low"] <= r["estimate"] <= r["ci_high"] and 2.4 * spread - 0.01 <= r["ci_high"] - r["ci_low"] <= 5.6 * spread + 0.01


def test_a_study_is_whole_and_exported(spark, tmp_path):
    rows = made(4, 60)
    events = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    baseline = spark.createDataFrame([(s,) for s in range(0, 60, 5)], "sample_id long")
    tables = R.study(events, baseline, {"area_ha": 1.0, "pixels": 1}, ["area_ha", "p_a"], 20)
    head, told = tables["summary"].first(), loop(rows)
    chosen = defaultdict(set)
    for p in tables["point_predictions"].collect():
        chosen[p["sample_id"]].add(p["selected_year"])
    assert (head["reviewed_events"], head["reviewed_points"], head["evaluable_points"]) == (len(rows), 60, len({s for _, s in told})) and head["points_where_methods_differ"] == sum(len(x) > 1 for x in chosen.values())
    assert {r["method"] for r in tables["ranking_metrics"].collect()} == {m for m, _ in told} | {R.LEFT_OUT}
    fresh = [r for r in rows if r["sample_id"] % 5]
    for rule in tables["fixed_small_event_rules"].collect():
        low = [[None if r[f] is None else r[f] <= t for f, t in (("area_ha", 1.0), ("pixels", 1)) if rule["feature"] in (f, "combined_or")] for r in fresh]
        hits = [(r, any(x)) for r, x in zip(fresh, low, strict=True) if any(v is not None for v in x)]
        cells = [sum(h == a and (r["review_class"] == "EVENT_TOO_SMALL") == b for r, h in hits) for a, b in ((True, True), (True, False), (False, True), (False, False))]
        assert [rule[n] for n in ("true_positive", "false_positive", "false_negative", "true_negative")] == cells and rule["missing_events"] == len(fresh) - len(hits)
        assert rule["valid_events_lost"] == sum(h and r["review_status"] == "VALID" for r, h in hits) and abs(rule["precision"] - cells[0] / (cells[0] + cells[1])) < 1e-6
    manifest = W.export_tables(tables, str(tmp_path / "study"))
    assert manifest.count() == len(tables) and W.unlike_manifest(spark, str(tmp_path / "study")).isEmpty()


def test_a_study_of_no_events(spark):
    tables = R.study(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "sample_id long"), {"area_ha": 1.0, "pixels": 1}, ["area_ha"], 5)
    assert tables["summary"].first()["reviewed_events"] == 0 and all(tables[n].isEmpty() for n in ("taxonomy", "ranking_metrics", "dominant_relative", "outcome_intervals", "merge_pairs"))


def test_intervals_count_draws_by_stretches_of_like_points(spark):
    """The same intervals as a loop over every draw, with points in the order of their sums; no draw is shuffled."""
    import hashlib

    import numpy as np

    rows = made(6, 80)
    relative = R.relative_events(R.year_rankings(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)))
    runs, sums = 40, defaultdict(lambda: defaultdict(lambda: [0, 0, 0, 0]))
    for r in relative.collect():
        if r["abs_delta_year"] <= 1:
            k = r["review_class"] or ""
            x = sums[r["method"], "abs_delta_1" if r["abs_delta_year"] else "delta_0"][r["sample_id"]]
            for i, hit in enumerate((True, k.startswith("VALID_"), k == "YEAR_MISMATCH", k == "EVENT_TOO_SMALL")):
                x[i] += hit
    found = {(r["method"], r["stratum"], r["outcome"]): (r["ci_low"], r["ci_high"]) for r in R.outcome_intervals(relative, runs).collect()}
    assert len(found) == 3 * len(sums)
    for (method, stratum), points in sums.items():
        ordered = np.array(sorted(points.values()), float)
        drawn = [ordered[[int(hashlib.md5(f"{run}-{t}".encode()).hexdigest()[:8], 16) % len(ordered) for t in range(len(ordered))]].sum(0) for run in range(runs)]
        for i, outcome in enumerate(R.OUTCOMES, 1):
            assert np.allclose(found[method, stratum, outcome], np.quantile([d[i] / d[0] for d in drawn], [0.025, 0.975]), atol=2e-6)


def test_ranked_events_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_ROWS", 20)
    rows = made(5, 60)
    ranked = R.year_rankings(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA))
    count = ranked.count() // ranked.select("method").distinct().count()
    assert ranked.rdd.getNumPartitions() >= count / 20
