"""Plans made in order, against sequential versions."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.functions import geo, text
from fieldlens.operators import evaluation, planning
from fieldlens.operators.joins import mutual_pairs


def parted(sizes, capacity):
    """Part of each row by the plain loop: a new part opens when the part has a row and the next one doesn't fit."""
    out, part, used, filled = [], 0, 0, False
    for s in sizes:
        if filled and used + s > capacity:
            part, used = part + 1, 0
        used, filled = used + s, True
        out.append(part)
    return out


def test_filling_parts_in_pieces_equals_the_loop():
    rng = random.Random(4)
    for _ in range(300):
        sizes = [rng.choice([0, 0, 1, 3, 7, 12, 30]) for _ in range(rng.randint(1, 40))]
        cut = rng.randint(0, len(sizes))
        state, got = planning.Open(1, 0, 0, False), []
        for piece in (sizes[:cut], sizes[cut:]):
            if piece:
                parts, state = planning.fill(np.array(piece), state, 20)
                got += parts.tolist()
        assert got == parted(sizes, 20)


@pytest.mark.parametrize("partitions", ["3", "17"])
def test_next_fit_of_one_hot_key_over_many_partitions(spark, partitions):
    rng = random.Random(7)
    rows = [("hot" if i % 5 else f"k{i % 3}", i, rng.choice([None, 0, 1, 4, 9, 25])) for i in range(1200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r["k"], r["i"]): r["part"] for r in planning.next_fit(spark.createDataFrame(rows, "k string, i int, size int"), "k", ["i"], "size", 20).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        assert [got[k, i] for _, i, _ in own] == parted([s or 0 for _, _, s in own], 20)
    assert planning.next_fit(spark.createDataFrame([], "k string, i int, size int"), "k", ["i"], "size", 20).count() == 0
    assert planning.payload_limit(10) == 9 << 20 and planning.payload_limit(200) == (200 << 20) - 2 * (1 << 20)


def test_one_scene_fills_targets_of_two_events(spark):
    events = spark.createDataFrame([("s", "s-2018", 2018), ("s", "s-2020", 2020), ("t", "t-2018", 2018)], "sample_id string, event_id string, event_year int")
    day = lambda m, d, y=2019: dt.datetime(y, m, d, 10)
    scenes = [("s", "a", day(7, 2), True, True), ("s", "b", day(7, 4), True, True), ("s", "c", day(7, 13), True, True), ("s", "d", day(7, 14), True, False), ("s", "e", day(3, 1), True, True), ("s", "f", day(7, 2, 2018), True, True), ("s", "g", None, True, True)]
    targets, caps = {"spring": 2, "summer": 2}, {(p, s): 3 for p in ("PRE", "POST") for s in ("spring", "summer")}
    grid = planning.quota_grid(events, spark.createDataFrame(scenes, "sample_id string, scene_id string, at timestamp, checked boolean, valid boolean"), targets, caps, 10)
    got = {(r["event_id"], r["period"], r["season"]): (r["valid_count"], r["deficit"], r["qc_checked_count"], r["stop_reason"]) for r in grid.collect()}
    assert len(got) == 12
    assert got["s-2018", "POST", "summer"] == got["s-2020", "PRE", "summer"] == (2, 0, 4, "target_reached")
    assert got["t-2018", "PRE", "spring"] == (0, 2, 0, None) and got["s-2018", "PRE", "summer"] == (0, 2, 0, None)
    caps["PRE", "summer"] = 1
    samples = spark.createDataFrame([("s", False, False), ("t", False, False), ("u", False, False), ("v", True, False), ("w", False, True)], "sample_id string, too_old boolean, validated boolean")
    plan = {r["sample_id"]: r for r in planning.batch_plan(samples, events, spark.createDataFrame([("t",)], "sample_id string"), grid, True).collect()}
    assert {k: r["skip_reason"] for k, r in plan.items()} == {"s": None, "t": "already_has_downloads", "u": "no_sample_events", "v": "too_old", "w": "has_manual_validation"}
    assert (plan["s"]["event_count"], plan["s"]["valid_count"], plan["s"]["target_valid"], plan["s"]["stop_reason"]) == (2, 4, 16, None)


def dealt(rows, near, pool):
    """Turn by turn, tile by tile."""
    queues = {t: sorted((r for r in rows if r[1] == t), key=lambda r: (-r[2], r[0])) for t in sorted({r[1] for r in rows})}
    accepted, passed = [], []
    while queues and len(accepted) < pool:
        for t in list(queues):
            while queues[t]:
                row = queues[t].pop(0)
                if any((row[0], a) in near or (a, row[0]) in near for a in accepted):
                    passed.append(row[0])
                    continue
                accepted.append(row[0])
                break
            if not queues[t]:
                del queues[t]
            if len(accepted) >= pool:
                break
    return accepted, passed


@pytest.mark.parametrize("pool", [5, 12, 1000])
def test_candidates_are_dealt_as_by_the_loop(spark, pool):
    rng = random.Random(5)
    rows = [(i, f"t{rng.randint(0, 3)}", float(rng.randint(0, 30))) for i in range(60)]
    near = {(a, b) for a in range(60) for b in range(a) if rng.random() < 0.12}
    got = planning.deal_candidates(spark.createDataFrame(rows, "id int, tile string, score double"), spark.createDataFrame(sorted(near), "a int, b int"), pool).collect()
    accepted, passed = dealt(rows, near, pool)
    assert [r["id"] for r in sorted((r for r in got if r["decision"] == "accepted"), key=lambda r: (r["turn"], r["tile"]))] == accepted
    assert {r["id"] for r in got if r["decision"] == "overlap"} == set(passed) and len(got) == 60


@pytest.mark.parametrize("pool", [5, 1000])
def test_only_heads_are_asked_for_conflicts(spark, pool):
    rng = random.Random(6)
    rows = [(i, f"t{rng.randint(0, 3)}", float(rng.randint(0, 30)), float(rng.randint(0, 40))) for i in range(60)]
    near = {(a[0], b[0]) for a in rows for b in rows if a[0] > b[0] and abs(a[3] - b[3]) <= 1}

    def meet(few, many):
        assert few.count() <= 4
        return few.select(F.col("id").alias("a"), F.col("at").alias("p")).join(many.select(F.col("id").alias("b"), F.col("at").alias("q")), F.abs(F.col("p") - F.col("q")) <= 1).select("a", "b")

    got = planning.deal_candidates(spark.createDataFrame(rows, "id int, tile string, score double, at double"), meet, pool).collect()
    accepted, passed = dealt([r[:3] for r in rows], near, pool)
    assert [r["id"] for r in sorted((r for r in got if r["decision"] == "accepted"), key=lambda r: (r["turn"], r["tile"]))] == accepted
    assert {r["id"] for r in got if r["decision"] == "overlap"} == set(passed) and len(got) == 60


def test_matching_along_a_path_needs_no_cap(spark):
    rows = [(f"a{i}", f"b{j}", float(2 * i + (i != j))) for i in range(70) for j in (i, i - 1) if j >= 0][:12]
    assert {(r[0], r[1]) for r in mutual_pairs(spark.createDataFrame(rows, "a string, b string, c double"), "a", "b", "c").collect()} == {(f"a{i}", f"b{i}") for i in range(7)}


def test_pair_sweep_equals_the_loop(spark):
    rng = random.Random(9)
    make = lambda n: [(i, 50 + rng.random() * 3, 30 + rng.random() * 3, 2010 + rng.randint(0, 6)) for i in range(n)]
    a, b = make(25), make(20)
    schema = "id int, lat double, lon double, year int"
    got = {(r["max_km"], r["max_years"]): (r["pairs"], r["unique_pairs"]) for r in evaluation.pair_sweep(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), [30.0, 90.0], [1, 3]).collect()}

    def metres(x, y):
        p, q = np.radians(x[1:3]), np.radians(y[1:3])
        h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
        return 2 * 6371000.0 * np.arcsin(np.sqrt(h))

    for (km, years), found in got.items():
        pairs = sorted((metres(x, y), x[0], y[0]) for x in a for y in b if metres(x, y) <= km * 1000 and abs(x[3] - y[3]) <= years)
        used, n = (set(), set()), 0
        for _, i, j in pairs:
            if i not in used[0] and j not in used[1]:
                used[0].add(i)
                used[1].add(j)
                n += 1
        assert found == (len(pairs), n)
    assert len(got) == 4


def test_flags_colours_and_artifacts(spark):
    values = ['["b", "a", "", 5]', '{"x": true, "y": ["p", "q"], "z": 0.0, "w": {"k": 1}}', "true", None, "[1", '""']
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", text.quality_flags(F.col("v")).alias("f")).collect()
    assert [r["f"] for r in sorted(rows)] == [["5", "a", "b"], ["p", "q", "w", "x"], ["true"], [], [], []]
    stops = [(0.0, (0, 0, 0)), (1.0, (100, 50, 10)), (3.0, (0, 250, 10))]
    colours = spark.createDataFrame([(v,) for v in (-1.0, 0.5, 1.0, 2.0, 9.0)], "v double").select("v", geo.palette_color(F.col("v"), stops).alias("c")).collect()
    assert [r["c"] for r in sorted(colours)] == [[0, 0, 0], [50, 25, 5], [100, 50, 10], [50, 150, 10], [0, 250, 10]]
    wanted = spark.createDataFrame([("a", "1", None), ("b", "1", "x"), ("c", "1", "x")], "k string, hash string, data string")
    found = spark.createDataFrame([("a", "1", None), ("b", "2", None)], "k string, hash string, data string")
    assert {tuple(r) for r in evaluation.artifact_status(wanted, found, "k", ["hash", "data"]).collect()} == {("a", "reuse", ""), ("b", "incompatible", "data,hash"), ("c", "missing", "")}
    assert Counter(r["decision"] for r in planning.deal_candidates(wanted.select(F.col("k").alias("id"), F.lit("t").alias("tile"), F.lit(1.0).alias("score")), spark.createDataFrame([], "a string, b string"), 2).collect()) == {"accepted": 2, "left": 1}
