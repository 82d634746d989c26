"""Logistic fits that each leave one group of rows out, all at once.

Each group is scored by a model of all other groups: missing features filled with
the others' medians, standardised by the others' means and deviations, classes
balanced, rows weighing one over their group's number, coefficients held by a ridge.
What a model needs to know of the others comes from totals less the group's own sums,
and medians from the ranks around the middle.

A model differs little from the one of all rows, so its gradient follows from the
derivatives up to the fourth at that one: these are summed over the rows once, and
each model takes its Newton steps on their polynomial less its own group's rows, which
enter exactly. Work grows with rows plus models. The polynomial is cut after the cube of
how far a row's line moves, so models that move any row's line by more than ``NEAR``, and
groups of more than ``LARGE`` rows, go another way: Newton steps for all of them run
together, rows meet models in blocks, a block yields each model's gradient and
curvature, and these are summed, so no task holds all rows or all models. A
group's pull falls with the number of groups, so such models stay few.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.plans.lineage import rewritten
from fieldlens.plans.prefix import running_totals

#: Rows and models that meet in a task, and Newton steps at most.
ROWS, MODELS, STEPS = 4096, 512, 40
#: How far a row's line may move for the polynomial to hold (the gradient then errs by less than 1e-10 of the weights), and the rows of a group at most.
NEAR, LARGE = 0.01, 1000


def middle_values(rows: DataFrame, group: str, feature: str, most: int) -> tuple[int, int, list[float], DataFrame]:
    """(values, rank of the first one listed, the values around the median, per group its values' ranks): enough to know the median without any group of at most ``most`` rows."""
    ordered = running_totals(rows.filter(F.col(feature).isNotNull()).select(F.col(group).alias("g"), F.struct(F.col(feature).alias("v"), "__row").alias("o"), F.lit(1).alias("one")), "o", {"i": "one"})
    ranks = rewritten(ordered.select("g", F.col("o.v").alias("v"), (F.col("i") - 1).alias("rank")))
    n = ranks.count()
    low, high = max((n - most - 1) // 2, 0), n // 2 + most
    near = [r["v"] for r in ranks.filter(F.col("rank").between(low, high)).orderBy("rank").collect()]  # at most 2 x most + 2
    own = ranks.groupBy("g").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    return n, low, near, own


class Side(NamedTuple):
    """How a model sees the rows: fillings, means and deviations of its features, weights of the classes."""

    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w0: np.ndarray
    w1: np.ndarray


def median_without(n: int, low: int, near: list[float], ranks: list[int]) -> float:
    """Median of n values without those at the given ranks; ``near`` are the values from rank ``low`` on."""
    left = n - len(ranks)
    if left <= 0:
        return float("nan")

    def value(k: int) -> float:
        """The k-th value that is left: its rank is k plus the own ranks up to it."""
        at = k
        while (moved := k + bisect_left(ranks, at + 1)) != at:
            at = moved
        return near[at - low]

    return (value((left - 1) // 2) + value(left // 2)) / 2


def _columns(d: int) -> list[str]:
    return [*(f"g{i}" for i in range(d + 1)), *(f"h{i}_{j}" for i in range(d + 1) for j in range(i, d + 1))]


class Whole:
    """The model of all rows, with what its neighbours need: sums of derivatives of both classes' losses by symmetric products of a row's columns.

    A row's columns are one, each feature less ``centre`` over ``unit`` (0 where missing), and, of features that
    some row lacks, whether it is missing: so a line with any filling is linear in them.
    """

    def __init__(self, data: DataFrame, label: str, features: list[str], centre: list[float], unit: list[float], gaps: list[int], whole: Side, ridge: float):
        self.centre, self.unit, self.gaps, self.d, self.limit = np.array(centre), np.array(unit), gaps, len(features), NEAR
        self.width = 1 + self.d + len(gaps)
        rows = data.select(F.col(label).cast("double").alias("y"), F.col("__w").alias("w"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"))
        beta, at = np.zeros(self.d + 1), self.ways(whole)
        for _ in range(STEPS):
            sums = self.sums(rows, at @ beta, 2)
            grad, curve = (whole.w0 * sums[0][k] + whole.w1 * sums[1][k] for k in (1, 2))
            hold = np.array([0.0] + [ridge] * self.d)
            step = np.linalg.solve(at.T @ curve.reshape(self.width, -1) @ at + np.diag(hold) + 1e-12 * np.eye(self.d + 1), at.T @ grad + hold * beta)
            beta = beta - step * min(1.0, 4 / max(np.abs(step).max(), 1e-300))
            if np.abs(step).max() < 1e-9:
                break
        self.beta, self.line = beta, at @ beta
        both = self.sums(rows, self.line, 4)
        self.terms, self.reach = [[None, *(both[c][k] for k in (1, 2, 3, 4))] for c in (0, 1)], both[2]

    def columns(self, x: np.ndarray) -> np.ndarray:
        missing = np.isnan(x)
        return np.column_stack([np.ones(len(x)), np.where(missing, 0.0, (x - self.centre) / self.unit), missing[:, self.gaps]])

    def ways(self, side: Side) -> np.ndarray:
        """From coefficients of standardised features to those of a row's columns."""
        mean, scale, fill = np.asarray(side.mean), np.asarray(side.scale), np.asarray(side.fill)
        lead = mean.shape[:-1]
        out = np.zeros((*lead, self.width, self.d + 1))
        out[..., 0, 0] = 1.0
        out[..., 0, 1:] = (self.centre - mean) / scale
        for i in range(self.d):
            out[..., i + 1, i + 1] = self.unit[i] / scale[..., i]
        for j, i in enumerate(self.gaps):
            out[..., 1 + self.d + j, i + 1] = (fill[..., i] - self.centre[i]) / scale[..., i]
        return out

    def sums(self, rows: DataFrame, line: np.ndarray, most: int) -> list:
        """Per class the sums of order 1 to ``most``, flat, and the greatest size of each column."""
        columns, width = self.columns, self.width
        cuts = np.cumsum([0] + [width**k for k in range(1, most + 1)])

        def run(batches):
            total, reach = np.zeros((2, cuts[-1])), np.zeros(width)
            for pdf in batches:
                for i in range(0, len(pdf), 2000):
                    part = pdf.iloc[i : i + 2000]
                    z, y, w = columns(np.array(part["x"].tolist(), float).reshape(len(part), -1)), part["y"].to_numpy(), part["w"].to_numpy()
                    reach = np.maximum(reach, np.abs(z).max(axis=0))
                    squares = (z[:, :, None] * z[:, None]).reshape(len(z), -1)
                    slopes = _slopes(z @ line, y)
                    for c in (0, 1):
                        v = w * ((y > 0) == (c == 1))
                        got = [z.T @ (v * slopes[0]), z.T @ ((v * slopes[1])[:, None] * z)]
                        if most > 2:
                            got += [z.T @ ((v * slopes[2])[:, None] * squares), squares.T @ ((v * slopes[3])[:, None] * squares)]
                        total[c] += np.concatenate([g.ravel() for g in got])
            yield pd.DataFrame({"s": [total.ravel().tolist()], "r": [reach.tolist()]})

        parts = rows.mapInPandas(run, "s array<double>, r array<double>")
        s = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        r = parts.select(F.posexplode("r").alias("i", "v")).groupBy((-1 - F.col("i")).alias("i")).agg(F.max("v").alias("v"))
        found = {x["i"]: x["v"] for x in s.unionByName(r).collect()}  # a few thousand sums, whatever the rows
        flat = np.array([found[i] for i in range(2 * cuts[-1])]).reshape(2, -1)
        return [[None, *(flat[c, a:b] for a, b in zip(cuts, cuts[1:], strict=False))] for c in (0, 1)] + [np.array([found[-1 - i] for i in range(width)])]

    def near(self, side: Side, own: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ridge: float) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients, whether they hold) of models that leave their own rows (x, y, w) out."""
        n, p = len(side.w0), self.width
        at = self.ways(side)
        turned = at.transpose(0, 2, 1)
        z, y, w = self.columns(np.concatenate([o[0] for o in own])), np.concatenate([o[1] for o in own]), np.concatenate([o[2] for o in own])
        first = np.cumsum([0] + [len(o[1]) for o in own])[:-1]
        of = np.repeat(np.arange(n), [len(o[1]) for o in own])
        w = w * np.where(y > 0, side.w1[of], side.w0[of])
        beta = np.tile(self.beta, (n, 1))
        hold, held = np.array([0.0] + [ridge] * self.d), np.diag([1e-12] + [ridge] * self.d)
        for _ in range(STEPS):
            line = (at @ beta[:, :, None])[:, :, 0]
            by = line - self.line
            twice = (by[:, :, None] * by[:, None]).reshape(n, -1)
            grad, curve = np.zeros((n, p)), np.zeros((n, p * p))
            for weight, (_, t1, t2, t3, t4) in zip((side.w0, side.w1), self.terms, strict=True):
                cube = t3.reshape(p, p * p)
                four = t4.reshape(p * p, p * p)
                bent = twice @ four  # fourth derivatives along the way, twice
                grad += weight[:, None] * (t1 + by @ t2.reshape(p, p) + twice @ cube.T / 2 + (bent.reshape(n, p, p) @ by[:, :, None])[:, :, 0] / 6)
                curve += weight[:, None] * (t2 + by @ cube + bent / 2)
            slopes = _slopes((z * line[of]).sum(axis=1), y)
            grad -= np.add.reduceat((w * slopes[0])[:, None] * z, first)
            curve -= np.add.reduceat(((w * slopes[1])[:, None, None] * z[:, :, None] * z[:, None]).reshape(len(z), -1), first)
            step = np.linalg.solve(turned @ curve.reshape(n, p, p) @ at + held, ((turned @ grad[:, :, None])[:, :, 0] + hold * beta)[:, :, None])[:, :, 0]
            size = np.abs(step).max(axis=1)
            beta = beta - step * np.minimum(1.0, 0.5 / np.maximum(size, 1e-300))[:, None]
            if not (size > 1e-10).any():
                break
        moved = np.abs((at @ beta[:, :, None])[:, :, 0] - self.line) @ self.reach
        return beta, (size <= 1e-10) & (moved <= self.limit)


def _slopes(line: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First to fourth derivative of the loss by the line."""
    p = 1 / (1 + np.exp(-np.clip(line, -700, 700)))
    q = p * (1 - p)
    return p - y, q, q * (1 - 2 * p), q * (1 - 6 * q)


def leave_one_out(rows: DataFrame, group: str, label: str, features: list[str], ridge: float = 1.0, least_rows: int = 10) -> DataFrame:
    """The rows with ``p``, the probability of label 1 by the model of all other groups.

    p is null where the others have fewer than ``least_rows`` rows or one class
    only. A feature that no other row has counts nothing. Rows with a null
    label or group are left out. A group is a point with an event a year, so
    small; ranks around the middle are read for twice the rows of the largest.
    """
    d = len(features)
    data = rewritten(rows.filter(F.col(group).isNotNull() & F.col(label).isNotNull()).withColumn("__row", F.monotonically_increasing_id()))
    whole = data.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"), *(F.avg(f).alias(f"c{i}") for i, f in enumerate(features))).first()
    if not whole["n"]:
        return rows.withColumn("p", F.lit(None).cast("double")).limit(0)
    centre = [whole[f"c{i}"] or 0.0 for i in range(d)]
    sums = [s for i, f in enumerate(features) for s in (F.count(f).alias(f"k{i}"), F.coalesce(F.sum(F.col(f) - centre[i]), F.lit(0.0)).alias(f"s{i}"), F.coalesce(F.sum(F.pow(F.col(f) - centre[i], 2)), F.lit(0.0)).alias(f"q{i}"))]
    groups = rewritten(data.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("double").alias("pos"), *sums))
    total = groups.agg(F.max("n").alias("most"), *(F.sum(c).alias(c) for c in groups.columns if c != "g")).first()
    middles = []
    for i, f in enumerate(features):
        n, low, near, own = middle_values(data, group, f, total["most"])
        middles.append((n, low, near))
        groups = groups.join(own.withColumnsRenamed({"g": "__g", "ranks": f"r{i}"}), F.col("g") == F.col("__g"), "left").drop("__g")
    kind = data.schema[group].dataType.simpleString()
    state = f"g {kind}, fill array<double>, mean array<double>, scale array<double>, w0 double, w1 double, beta array<double>, step double"
    all_of = total.asDict()

    def prepare(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                left, pos = all_of["n"] - r["n"], all_of["pos"] - r["pos"]
                if left < least_rows or not 0 < pos < left:
                    continue
                fill, mean, scale = [], [], []
                for i in range(d):
                    ranks = r[f"r{i}"]
                    median = median_without(*middles[i], [int(x) for x in ranks] if isinstance(ranks, (list, np.ndarray)) else [])
                    missing = left - (all_of[f"k{i}"] - r[f"k{i}"])
                    known = not np.isnan(median)
                    m = median - centre[i] if known else 0.0
                    s = all_of[f"s{i}"] - r[f"s{i}"] + missing * m
                    q = all_of[f"q{i}"] - r[f"q{i}"] + missing * m * m
                    deviation = max(q / left - (s / left) ** 2, 0.0) ** 0.5
                    fill.append(median if known else 0.0)
                    mean.append(centre[i] + s / left if known else 0.0)
                    scale.append((deviation if deviation > 1e-10 * max(abs(centre[i] + s / left), 1e-300) else 1.0) if known else np.inf)
                out.append((r["g"], fill, mean, scale, left / (2 * (left - pos)), left / (2 * pos), [0.0] * (d + 1), 1.0))
            yield pd.DataFrame(out, columns=["g", "fill", "mean", "scale", "w0", "w1", "beta", "step"])

    models = rewritten(groups.mapInPandas(prepare, state))
    weights = groups.select(F.col("g").alias("__g"), (1.0 / F.col("n")).alias("__w"))
    weighted = rewritten(data.join(weights, F.col(group) == F.col("__g")).drop("__g"))
    done, models = near_models(weighted, models, groups, group, label, features, centre, all_of, middles, ridge, kind, state)
    found = done if models.isEmpty() else done.unionByName(far_models(weighted, models, group, label, features, ridge, kind, state))
    found = found.select(F.col("g").alias("__g"), *(F.col(c).alias(f"__{c}") for c in ("beta", "fill", "mean", "scale")))
    fit = data.join(found, F.col(group) == F.col("__g"), "left")
    line = F.get("__beta", F.lit(0))
    for i, f in enumerate(features):
        x = F.coalesce(F.col(f).cast("double"), F.get("__fill", F.lit(i)))
        line = line + F.get("__beta", F.lit(i + 1)) * (x - F.get("__mean", F.lit(i))) / F.get("__scale", F.lit(i))
    return fit.select(*rows.columns, (1 / (1 + F.exp(-line))).alias("p"))


def near_models(weighted: DataFrame, models: DataFrame, groups: DataFrame, group: str, label: str, features: list[str], centre: list[float], all_of: dict, middles: list, ridge: float, kind: str, state: str) -> tuple[DataFrame, DataFrame]:
    """(models that the polynomial holds for, solved; the others as they were)."""
    n, d = all_of["n"], len(features)
    known = [all_of[f"k{i}"] for i in range(d)]
    if not 0 < all_of["pos"] < n:
        return models.limit(0), models
    middle = [median_without(*m, []) if k else 0.0 for m, k in zip(middles, known, strict=True)]
    fill, mean, scale = [], [], []
    for i in range(d):
        m = (middle[i] - centre[i]) if known[i] else 0.0
        s, q = all_of[f"s{i}"] + (n - known[i]) * m, all_of[f"q{i}"] + (n - known[i]) * m * m
        fill.append(middle[i])
        mean.append(centre[i] + s / n)
        deviation = max(q / n - (s / n) ** 2, 0.0) ** 0.5
        scale.append(deviation if deviation > 1e-10 * max(abs(mean[-1]), 1e-300) else 1.0)
    side = Side(np.array(fill), np.array(mean), np.array(scale), n / (2 * (n - all_of["pos"])), n / (2 * all_of["pos"]))
    whole = Whole(weighted, label, features, centre, scale, [i for i in range(d) if known[i] < n], side, ridge)
    small = groups.filter(F.col("n") <= LARGE).select(F.col("g").alias("__g"))
    own = weighted.join(small, F.col(group) == F.col("__g"), "left_semi").groupBy(F.col(group).alias("__g")).agg(F.collect_list(F.struct(F.col(label).cast("double").alias("y"), F.col("__w").alias("w"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"))).alias("own"))
    asked = models.join(own.select("__g", F.col("own.y").alias("oy"), F.col("own.w").alias("ow"), F.flatten("own.x").alias("ox")), F.col("g") == F.col("__g"), "left").drop("__g")

    def solve(batches):
        for pdf in batches:
            rows = pdf["oy"].map(lambda y: 0 if y is None else len(y)).to_numpy()
            beta, step = [None] * len(pdf), [None] * len(pdf)
            usable = np.flatnonzero(rows > 0)
            for at in np.split(usable, np.flatnonzero(np.diff(np.cumsum(rows[usable]) // 20_000)) + 1):
                if not len(at):
                    continue
                part = pdf.iloc[at]
                held = [(np.array([np.nan if v is None else v for v in r.ox], float).reshape(-1, d), np.asarray(r.oy, float), np.asarray(r.ow, float)) for r in part.itertuples(index=False)]
                of = Side(*(np.array(part[c].tolist(), float).reshape(len(part), d) for c in ("fill", "mean", "scale")), part["w0"].to_numpy(), part["w1"].to_numpy())
                got, good = whole.near(of, held, ridge)
                for k, b, g in zip(at, got.tolist(), good, strict=True):
                    beta[k], step[k] = (b, 0.0) if g else (None, None)
            out = pdf[["g", "fill", "mean", "scale", "w0", "w1"]].assign(beta=beta, step=step)
            out["beta"] = [b if b is not None else [0.0] * (d + 1) for b in beta]
            out["step"] = [x if x is not None else 1.0 for x in step]
            yield out

    solved = rewritten(asked.select("g", "fill", "mean", "scale", "w0", "w1", "oy", "ow", "ox").mapInPandas(solve, state))
    return solved.filter("step = 0"), solved.filter("step > 0")


def far_models(weighted: DataFrame, models: DataFrame, group: str, label: str, features: list[str], ridge: float, kind: str, state: str) -> DataFrame:
    """The models, solved on all rows: each step looks at every row for each of them."""
    d = len(features)
    row_blocks, batches = max(1, -(-weighted.count() // ROWS)), max(1, -(-models.count() // MODELS))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))
    narrow = weighted.select(F.col(group).alias("g"), F.col(label).cast("double").alias("y"), "__w", F.array(*(F.col(f).cast("double") for f in features)).alias("x"), F.pmod(F.xxhash64("__row"), F.lit(row_blocks)).cast("int").alias("block"))
    met = rewritten(narrow.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))))
    names = _columns(d)
    upper = np.triu_indices(d + 1)

    def slopes(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in ["g", *names]})
        x, y, w, g = np.array(left["x"].tolist(), float), left["y"].to_numpy(), left["__w"].to_numpy(), left["g"].to_numpy()
        out = []
        for m in right.itertuples(index=False):
            z = np.where(np.isnan(x), np.asarray(m.fill), x)
            z = np.column_stack([np.ones(len(z)), (z - np.asarray(m.mean)) / np.asarray(m.scale)])
            p = 1 / (1 + np.exp(-np.clip(z @ np.asarray(m.beta), -700, 700)))
            weight = np.where(y > 0, m.w1, m.w0) * w * (g != m.g)
            grad, curve = z.T @ (weight * (p - y)), (z * (weight * p * (1 - p))[:, None]).T @ z
            out.append([m.g, *grad, *curve[upper]])
        return pd.DataFrame(out, columns=["g", *names])

    def advance(batches):
        for pdf in batches:
            beta = []
            for r in pdf[["beta", *names]].itertuples(index=False):
                b = np.asarray(r[0], float)
                grad, curve = np.array(r[1 : d + 2]), np.zeros((d + 1, d + 1))
                curve[upper] = r[d + 2 :]
                curve = curve + np.triu(curve, 1).T + np.diag([1e-12] + [ridge] * d)
                grad = grad + ridge * np.concatenate(([0.0], b[1:]))
                step = np.linalg.solve(curve, grad)
                beta.append((b - step * min(1.0, 4 / max(np.abs(step).max(), 1e-300)), float(np.abs(step).max())))
            yield pdf.assign(beta=[b.tolist() for b, _ in beta], step=[s for _, s in beta])[["g", "fill", "mean", "scale", "w0", "w1", "beta", "step"]]

    done = models.filter("step < 0")
    for _ in range(STEPS):
        asked = models.withColumn("batch", F.pmod(F.xxhash64("g"), F.lit(batches)).cast("int")).withColumn("block", blocks)
        parts = met.groupBy("block", "batch").cogroup(asked.groupBy("block", "batch")).applyInPandas(slopes, f"g {kind}, " + ", ".join(f"{c} double" for c in names))
        sums = parts.groupBy(F.col("g").alias("__g")).agg(*(F.sum(c).alias(c) for c in names))
        models = rewritten(models.join(sums, F.col("g") == F.col("__g")).drop("__g").mapInPandas(advance, state))
        done = done.unionByName(models.filter("step < 1e-10"))
        models = models.filter("step >= 1e-10")
        if models.isEmpty():
            break
    return done.unionByName(models)
