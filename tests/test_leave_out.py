"""Fits that leave a group out, against one fit after the other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import leave_out


def fit_one(x, y, w, ridge):
    """Newton's method on one training set, features standardised already."""
    z, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    hold = np.array([0.0] + [ridge] * x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ b))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(hold + 1e-12), z.T @ (w * (p - y)) + hold * b)
        b = b - step * min(1.0, 4 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < 1e-12:
            break
    return b


def loop(rows, d, ridge=1.0):
    out = {}
    groups = {g for g, *_ in rows}
    sizes = {g: sum(r[0] == g for r in rows) for g in groups}
    for g in groups:
        train, test = [r for r in rows if r[0] != g], [r for r in rows if r[0] == g]
        y = np.array([r[1] for r in train], float)
        if len(train) < 10 or not 0 < y.sum() < len(y):
            out |= dict.fromkeys((r[-1] for r in test))
            continue
        x, t = (np.array([[np.nan if v is None else v for v in r[2 : 2 + d]] for r in part], float) for part in (train, test))
        used = ~np.isnan(x).all(axis=0)
        x, t = x[:, used], t[:, used]
        fill = np.nanmedian(x, axis=0)
        x, t = np.where(np.isnan(x), fill, x), np.where(np.isnan(t), fill, t)
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1
        w = np.array([1 / sizes[r[0]] for r in train]) * np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        b = fit_one((x - mean) / scale, y, w, ridge)
        p = 1 / (1 + np.exp(-(b[0] + ((t - mean) / scale) @ b[1:])))
        out |= dict(zip((r[-1] for r in test), p.tolist(), strict=True))
    return out


def made(seed, groups, d=3, only=None):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        for _ in range(rng.randint(1, 6)):
            x = [None if rng.random() < 0.2 else round(rng.gauss(5, 2), rng.choice([0, 6])) for _ in range(d)]
            y = int(sum(v or 5 for v in x) + rng.gauss(0, 3) > 5 * d)
            rows.append((g, y, *x, len(rows)))
    return [(*r[:2], None if only is not None and r[0] != only else r[2], *r[3:]) for r in rows]


@pytest.mark.parametrize("sizes", [(4096, 512), (17, 6)])
def test_leave_one_out_equals_the_loop(spark, monkeypatch, sizes):
    monkeypatch.setattr(leave_out, "ROWS", sizes[0])
    monkeypatch.setattr(leave_out, "MODELS", sizes[1])
    rows = made(sizes[0], 25, only=3)  # one feature is known of a single group
    df = spark.createDataFrame([*rows, (None, 1, 1.0, 1.0, 1.0, -1), (1, None, 1.0, 1.0, 1.0, -2)], "point long, y int, a double, b double, c double, id long").withColumns({"g": F.lit("g"), "block": F.lit(1), "mean": F.lit(2)})
    got = {r["id"]: r["p"] for r in leave_out.leave_one_out(df, "point", "y", ["a", "b", "c"]).collect()}
    wanted = loop(rows, 3)
    assert got.keys() == wanted.keys() and max(abs(got[k] - wanted[k]) for k in got) < 1e-6


def test_too_few_others_have_no_model(spark):
    rows = [(1, 1, 1.0, 0), (1, 0, 2.0, 1), *[(2, i % 2, float(i), 2 + i) for i in range(12)], (3, 1, 0.5, 14)]
    got = {r["id"]: r["p"] for r in leave_out.leave_one_out(spark.createDataFrame(rows, "point long, y int, a double, id long"), "point", "y", ["a"]).collect()}
    assert {k for k, v in got.items() if v is None} == set(range(2, 14))
    assert leave_out.leave_one_out(spark.createDataFrame([], "point long, y int, a double"), "point", "y", ["a"]).collect() == []


def test_medians_without_some_ranks():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randint(1, 30)
        values = sorted(rng.randint(0, 9) for _ in range(n))
        ranks = sorted(rng.sample(range(n), rng.randint(0, min(n, 5))))
        low, high = max((n - 5 - 1) // 2, 0), n // 2 + 5
        left = [v for i, v in enumerate(values) if i not in ranks]
        got = leave_out.median_without(n, low, values[low : high + 1], ranks)
        assert (np.isnan(got) and not left) or got == np.median(left)


def test_most_models_need_no_rows_but_their_own(spark, monkeypatch):
    rows, asked = made(7, 2500, d=2), []
    df = spark.createDataFrame(rows, "point long, y int, a double, b double, id long")
    monkeypatch.setattr(leave_out, "LARGE", 5)  # groups of six rows go the other way
    far = leave_out.far_models
    monkeypatch.setattr(leave_out, "far_models", lambda weighted, models, *rest: asked.append(models.count()) or far(weighted, models, *rest))
    got = {r["id"]: r["p"] for r in leave_out.leave_one_out(df, "point", "y", ["a", "b"]).collect()}
    monkeypatch.setattr(leave_out, "NEAR", -1.0)
    wanted = {r["id"]: r["p"] for r in leave_out.leave_one_out(df, "point", "y", ["a", "b"]).collect()}
    groups = len({r[0] for r in rows})
    assert asked[1] == groups and asked[0] < groups / 2
    assert got.keys() == wanted.keys() and max(abs(got[k] - wanted[k]) for k in got) < 1e-8
