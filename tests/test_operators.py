import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import aggregate, joins, learn, ordered, planning, raster, reconcile, select, vectors
from fieldlens.plans.components import connected_components
from fieldlens.plans.numbering import number_rows


def test_numbers_are_gapless_in_large_groups_and_with_nulls(spark):
    rows = [("hot" if i % 3 else None, i % 50) for i in range(900)]
    got = number_rows(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"], "n", lanes=8).collect()
    for g in ("hot", None):
        assert sorted(r["n"] for r in got if r["g"] == g) == list(range(sum(r[0] == g for r in rows)))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_greedy_matching_equals_a_sequential_one(spark):
    rng = random.Random(3)
    pairs = {(rng.randint(0, 30), rng.randint(0, 30)): round(rng.random(), 1) for _ in range(200)}
    used_a, used_b, expected = set(), set(), set()
    for (a, b), c in sorted(pairs.items(), key=lambda x: (x[1], *x[0])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), expected.add((a, b, c))
    got = joins.mutual_pairs(spark.createDataFrame([(a, b, c) for (a, b), c in pairs.items()], "a int, b int, c double"), "a", "b", "c")
    assert {tuple(r) for r in got.collect()} == expected


def test_points_within_a_distance(spark):
    rng = random.Random(1)
    points = lambda n: [(i, rng.uniform(-70, 70), rng.uniform(-175, 175)) for i in range(n)]
    a, b = points(300), points(300)

    def metres(p, q):
        x, y = map(math.radians, (p[1], q[1]))
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    got = joins.within_distance(*(spark.createDataFrame(p, "id int, lat double, lon double") for p in (a, b)), 400_000)
    assert {(r["a_id"], r["b_id"]) for r in got.collect()} == {(p[0], q[0]) for p in a for q in b if metres(p, q) <= 400_000}


def test_near_join_over_the_date_line_and_the_poles(spark):
    rng = random.Random(4)
    spots = [(rng.uniform(-60, 60), rng.choice([-1, 1]) * rng.uniform(176, 180)) for _ in range(120)]
    spots += [(rng.choice([-1, 1]) * rng.uniform(70, 90), rng.uniform(-180, 180)) for _ in range(180)]
    spots += [(0.0, 180.0), (0.0, -180.0), (90.0, 10.0), (-90.0, 0.0), (89.9, -170.0)]
    points = [(i, *p) for i, p in enumerate(spots)]

    def metres(p, q):
        x, y = map(math.radians, (p[1], q[1]))
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(min(h, 1.0)))

    df = spark.createDataFrame(points, "id int, lat double, lon double")
    for reach in (300_000, 600_000, 3_000_000, 12_000_000):
        got = [(r["a_id"], r["b_id"]) for r in joins.within_distance(df, df, reach).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(p[0], q[0]) for p in points for q in points if metres(p, q) <= reach}


def test_lowest_draws_equal_sorting(spark):
    """Ties, draws that differ in the last digits only, and all or none of the rows."""
    rng = random.Random(5)
    rows = [(g, i, rng.choice([rng.randrange(2**32), 7, 2**32 - 1, 5 * 2**20 + rng.randrange(4)])) for g in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, id int, u long")
    for n in (0, 1, 29, 60):
        got = [(r["g"], r["id"]) for r in learn.mark_lowest(df, "g", "u", "id", spark.createDataFrame([(n,)], "n long")).filter("taken").collect()]
        assert sorted(got) == sorted((g, i) for k in range(4) for g, i, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))[:n])


def test_similarity_gap_equals_the_mean_over_pairs(spark, tmp_path):
    import fieldlens.queries  # noqa: F401  registers
    from fieldlens.registry import QUERIES

    rng = random.Random(6)
    rows = [(i, [rng.gauss(i % 10 < 5 and j == 2, 1) for j in range(4)], i % 10) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    cos = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
    pairs = [((a[2] < 5) == (b[2] < 5), cos(a[1], b[1])) for i, a in enumerate(rows) for b in rows[:i]]
    mean = lambda same: sum(c for s, c in pairs if s == same) / sum(s == same for s, _ in pairs)
    assert abs(QUERIES["q_similarity_gap"](spark, str(tmp_path)).first()["observed"] - (mean(True) - mean(False))) < 2e-6


def test_spaced_picks_and_next_fit_equal_loops(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 5), i, dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 200)) if rng.random() > 0.1 else None, rng.randint(1, 40)) for k in range(5) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, c int, i int, day date, size int")
    got = {(r["k"], r["i"]) for r in planning.spaced_picks(df, "k", ["c", "i"], "day", 20, 4).filter("picked").collect()}
    parts = {(r["k"], r["i"]): r["part"] for r in planning.next_fit(df.select("k", "i", "size"), "k", ["i"], "size", 50).collect()}
    for k in range(5):
        own, days = sorted(r for r in rows if r[0] == k), []
        for _, _, i, day, _ in sorted(own, key=lambda r: (r[1], r[2])):
            if len(days) < 4 and all(day is None or x is None or abs((day - x).days) >= 20 for x in days):
                days.append(day)
                assert (k, i) in got
            else:
                assert (k, i) not in got
        part = used = 0
        for _, _, i, _, size in sorted(own, key=lambda r: r[2]):
            if used and used + size > 50:
                part, used = part + 1, 0
            used += size
            assert parts[k, i] == part


def test_budget_of_ten_over_four_seasons(spark):
    df = spark.createDataFrame([(1, 10, w, i) for i, w in enumerate((2, 3, 3, 2))] + [(2, 50, w, i) for i, w in enumerate((2, 3, 3, 2))] + [(3, 7, w, i) for i, w in enumerate((2, 3, 3, 2))], "k int, total int, w int, i int")
    got = ordered.apportion(df, ["k"], "total", "w", "i", "q").orderBy("k", "i").collect()
    assert [r["q"] for r in got] == [2, 3, 3, 2, 10, 15, 15, 10, 2, 2, 2, 1] or [r["q"] for r in got][:8] == [2, 3, 3, 2, 10, 15, 15, 10]
    assert sum(r["q"] for r in got if r["k"] == 3) == 7


def test_rank_fractions(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", 9.0), ("a", None), ("b", 5.0), ("b", 5.0)], "k string, v double")
    got = sorted((r["k"], r["v"] is None, r["v"] or 0, r["f"]) for r in df.withColumn("f", ordered.rank_fraction("v", ["k"])).collect())
    assert [g[3] for g in got] == [0.0, 0.5, 0.5, 1.0, 0.0, 1.0, 1.0]


def test_metrics_and_auc(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    df = spark.createDataFrame([(bool(a), float(b)) for a, b in zip(y, p, strict=True)], "y boolean, p double")
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert abs(aggregate.roc_auc(df, "p", "y").first()["auc"] - wins) < 1e-6
    m = df.agg(*aggregate.binary_metrics(F.col("y"), F.col("p") >= 0.5)).first()
    assert abs(m["accuracy"] - np.mean((p >= 0.5) == (y == 1))) < 1e-6
    nothing = df.filter("false").agg(*aggregate.binary_metrics(F.col("y"), F.col("y"))).first()
    assert nothing["n"] == 0 and nothing["accuracy"] == 0.0


def test_sync_applied_twice_changes_nothing(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "n")], "k int, v string")
    plan = reconcile.sync(a, b, ["k"], ["v"])
    assert {r["k"]: r["action"] for r in plan.collect()} == {1: "DELETE", 2: "UPDATE", 3: "KEEP", 4: "INSERT"}
    assert {r["action"] for r in reconcile.sync(b, b, ["k"], ["v"]).collect()} == {"KEEP"}
    new = reconcile.insert_missing(a, b, ["k"])
    assert [r["k"] for r in new.collect()] == [4] and reconcile.insert_missing(a.unionByName(new), b, ["k"]).count() == 0


def test_rejects_and_folding(spark):
    good, bad = reconcile.split_valid(spark.createDataFrame([(1,), (None,), (-1,)], "v int"), {"missing": F.col("v").isNull(), "negative": F.col("v") < 0})
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["missing", "negative"]
    folded = select.fold_rare(spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [(None,)], "c string"), "c", 3)
    assert sorted(str(r["c"]) for r in folded.collect()) == ["None", "Other", "Other", "a", "a", "a", "a", "a"]


def test_shapes_of_hand_made_masks(spark):
    square = [(1, r, c) for r in range(4) for c in range(4)]
    two = [(2, 0, 0), (2, 1, 1), (2, 5, 5), (2, 5, 6), (2, 5, 7)]  # a diagonal pair and a row of three
    got = {r["k"]: r for r in raster.shape_features(spark.createDataFrame(square + two, "k long, row int, col int"), "k").collect()}
    assert (got[1]["components"], got[1]["pixels"], got[1]["rectangularity"], got[1]["edge_density"]) == (1, 16, 1.0, 0.75)
    assert (got[2]["components"], got[2]["largest_share"]) == (2, 0.6)
    assert abs(got[2]["rectangularity"] - (2 * 2 / 4 + 3 * 3 / 3) / 5) < 1e-6


def test_components_of_random_masks():
    rng = np.random.default_rng(1)
    for _ in range(60):
        grid = rng.random((9, 11)) < 0.4
        rows, cols = np.nonzero(grid)
        order = rng.permutation(len(rows))
        got = raster.label_components(rows[order], cols[order])
        place = {(int(r), int(c)): int(g) for r, c, g in zip(rows[order], cols[order], got, strict=True)}
        seen = {}
        for start in place:
            stack = [start] if start not in seen else []
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen[x] = start
                    stack += [(x[0] + a, x[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (x[0] + a, x[1] + b) in place]
        assert len(set(place.values())) == len(set(seen.values()))
        assert all((place[a] == place[b]) == (seen[a] == seen[b]) for a in place for b in place)


def test_distance_between_masks(spark):
    a = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "k long, row int, col int")
    b = spark.createDataFrame([(1, 3, 5), (2, 0, 0)], "k long, row int, col int")
    assert [tuple(r) for r in raster.min_distance(a, b, "k").collect()] == [(1, 5.0)]


def test_bootstrap_interval_is_near_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), bool(rng.random() < 0.3 + 0.4 * (c % 2))) for c in range(60) for _ in range(rng.integers(1, 9))]
    got = learn.cluster_bootstrap(spark.createDataFrame(rows, "c int, h boolean"), "c", F.col("h"), 400).first()
    hits, n = np.zeros(60), np.zeros(60)
    for c, h in rows:
        hits[c] += h
        n[c] += 1
    draws = rng.integers(0, 60, (4000, 60))
    low, high = np.quantile(hits[draws].sum(1) / n[draws].sum(1), [0.025, 0.975])
    assert abs(got["low"] - low) < 0.03 and abs(got["high"] - high) < 0.03 and abs(got["share"] - hits.sum() / n.sum()) < 1e-6


def test_folds_are_even_and_hold_groups_together(spark):
    df = spark.createDataFrame([(i % 40, "a" if i % 40 < 30 else "b") for i in range(200)], "g int, y string")
    s = learn.stratified_folds(df, "g", "y", 5, 1)
    assert learn.leaks(s, "g").count() == 0 and s.count() == 40
    assert {r["n"] for r in s.filter("stratum = 'a'").groupBy("fold").agg(F.count("*").alias("n")).collect()} == {6}


def test_blocked_similarity(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "id long, v array<double>, y int")
    got = vectors.blocked_similarity(df.filter("id < 5"), df, "id", "v", "y", k=4, block=16).filter("kind = 'near'").collect()
    for q in range(5):
        s = x @ x[q]
        s[q] = -9
        best = sorted((r["s"] for r in got if r["vec_id"] == q), reverse=True)[:4]
        assert np.allclose(best, np.sort(s)[::-1][:4])


def test_pages_are_bounded(spark):
    with pytest.raises(ValueError):
        select.page(spark.range(3).toDF("i"), ["i"], 1001)
    assert [r["i"] for r in select.page(spark.range(9).toDF("i"), ["i"], 3, 4).collect()] == [4, 5, 6]


def test_nearest_within_equals_all_pairs_and_makes_few(spark, monkeypatch):
    rng = random.Random(8)
    a = [(i, rng.choice([10.0, 10.5, 40.0 + rng.random()]), float(rng.randint(0, 9))) for i in range(60)]
    b = [(i, rng.choice([10.0, 10.5, 44.0]), rng.randint(0, 5) + rng.choice([0.0, 0.25])) for i in range(300)]
    frames = [spark.createDataFrame(p, "id int, lat double, lon double") for p in (a, b)]
    best, pairs = {}, 0
    for r in joins.within_distance(*frames, 450_000).collect():
        pairs += 1
        best[r["a_id"]] = min(best.get(r["a_id"], (1e9, 0)), (round(r["distance_m"], 4), r["b_id"]))
    made, plain = [], joins.within_distance
    monkeypatch.setattr(joins, "within_distance", lambda *x: made.append(plain(*x)) or made[-1])
    got = {r["a_id"]: r["b_id"] for r in joins.nearest_within(*frames, 450_000).collect()}
    assert got == {k: v[1] for k, v in best.items()}
    assert sum(m.count() for m in made) < pairs / 10


def test_drawn_rows_equal_a_loop_in_tasks_of_bounded_size(spark):
    import hashlib

    k, runs = 37, 5
    got = learn.resampled(spark.range(k).select(F.col("id").alias("i"), (F.col("id") * 10).alias("h")), k, runs).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).collect()
    picks = lambda run: [int(hashlib.md5(f"{run}-{t}".encode()).hexdigest()[:8], 16) % k for t in range(k)]
    assert {(r["run"], r["n"], r["h"]) for r in got} == {(run, k, 10 * sum(picks(run))) for run in range(runs)}
    parts = learn.numbers(spark, 3_000_000, 200).rdd.getNumPartitions()
    assert 3_000_000 * 200 / parts <= learn.DRAWN
    plan = learn.resampled(spark.range(10).select(F.col("id").alias("i")), 10, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_points_at_one_place_meet_and_match_as_single_ones(spark):
    rng = random.Random(8)
    make = lambda n: [(i, 50.0 + rng.randint(0, 2), 30.0 + rng.randint(0, 3) + shift) for shift in (n / 100,) for i in range(n)]
    frames = [spark.createDataFrame(make(n), "id int, lat double, lon double") for n in (40, 25)]
    plain = {(r["a_id"], r["b_id"]): r["distance_m"] for r in joins.within_distance(*frames, 150_000).collect()}
    got = joins.pairs_within(*frames, 150_000).collect()
    assert {(r["a_id"], r["b_id"]): r["distance_m"] for r in got} == plain and len(got) == len(plain) > 300
    used, wanted = (set(), set()), set()
    for _, i, j in sorted((d, *k) for k, d in plain.items()):
        if i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
            wanted.add((i, j))
    assert {(r["a_id"], r["b_id"]) for r in joins.matched_within(*frames, 150_000).collect()} == wanted
