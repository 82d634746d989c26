"""Matching of names against all permutations, p-values against exact sums, roles of clusters."""

import math
import random
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.functions.special import correlation_p, incomplete_beta, ln_gamma
from fieldlens.operators import agreement, learn


def test_best_matching_equals_all_permutations():
    rng = random.Random(2)
    for _ in range(300):
        rows, columns = rng.randint(1, 6), rng.randint(1, 6)
        counts = [[rng.randint(0, 5) for _ in range(columns)] for _ in range(rows)]
        wide = [*range(columns), *[None] * max(rows - columns, 0)]
        total = lambda p: sum(0 if c is None else counts[i][c] for i, c in enumerate(p))
        best = max(map(total, permutations(wide, rows)))
        got = agreement.best_matching(counts)
        given = [c for c in got if c is not None]
        assert len(got) == rows and len(set(given)) == len(given) == min(rows, columns) and total(got) == best


def test_aligned_names(spark):
    rows = [("x", 3), ("x", 3), ("x", 1), ("y", 1), ("z", 2), (None, 2), ("z", None), ("y", 9)]
    got = agreement.align(spark.createDataFrame(rows, "a string, b int"), "a", "b").collect()
    assert {(r["b"], r["aligned"]) for r in got} == {(3, "x"), (1, "y"), (2, "z"), (None, None), (9, None)}
    with pytest.raises(ValueError, match="at most"):
        agreement.align(spark.range(40).select(F.col("id").alias("a"), F.col("id").alias("b")), "a", "b")


def test_planted_clusters_are_stable(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=2) * 0.2 + 10 * (i % 3)).tolist()) for i in range(120)]
    got = agreement.membership_stability(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 3, 4).collect()
    assert len(got) == 120 and all(r["stability"] == 1.0 for r in got) and len({r["cluster"] for r in got}) == 3


def test_roles(spark):
    rows = [(0, "L")] * 3 + [(0, "W")] + [(1, "W")] * 4 + [(2, "L"), (2, "W"), (2, None)]
    got = {r["c"]: (r["role"], r["rows"], round(r["share_0"], 3)) for r in agreement.cluster_roles(spark.createDataFrame(rows, "c int, l string"), "c", "l", {"L": "first", "W": "second"}, "mixed").collect()}
    assert got == {0: ("first", 4, 0.75), 1: ("second", 4, 0.0), 2: ("mixed", 3, 0.333)}


def beta_sum(a, b, x):
    """For whole parameters the function is a tail of a binomial: exact."""
    x, n = Fraction(x), a + b - 1
    return float(sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1)))


def test_incomplete_beta_equals_binomial_tails(spark):
    cases = [(a, b, x) for a in (1, 2, 7, 40, 300) for b in (1, 3, 25, 200) for x in (0.0, 0.01, 0.25, 0.5, 0.77, 0.995, 1.0)]
    df = spark.createDataFrame([(i, float(a), float(b), x) for i, (a, b, x) in enumerate(cases)], "i int, a double, b double, x double")
    for r in df.withColumn("v", incomplete_beta(F.col("a"), F.col("b"), F.col("x"))).collect():
        assert abs(r["v"] - beta_sum(*cases[r["i"]])) < 1e-9
    for r in spark.createDataFrame([(x,) for x in (0.25, 0.5, 1.0, 3.7, 50.0, 1e5)], "x double").withColumn("v", ln_gamma(F.col("x"))).collect():
        assert abs(r["v"] - math.lgamma(r["x"])) < 1e-10 * max(1, abs(r["v"]))


def test_correlation_p_values(spark):
    """Two and four degrees of freedom have closed forms; many come near the normal distribution."""
    rows = [(0.5, 4), (-0.9, 4), (0.3, 6), (0.0, 10), (1.0, 9), (0.5, 2), (0.004, 250_000)]
    got = [r["p"] for r in spark.createDataFrame(rows, "r double, n long").withColumn("p", correlation_p(F.col("r"), F.col("n"))).collect()]
    four = lambda r: 1 - (lambda t: t * (6 + t * t) / (4 + t * t) ** 1.5)(abs(r) * math.sqrt(4 / (1 - r * r)))
    wanted = [1 - 0.5, 1 - 0.9, four(0.3), 1.0, 0.0, None]
    assert all(a is b is None or abs(a - b) < 1e-9 for a, b in zip(got, wanted, strict=False))
    assert abs(got[-1] - math.erfc(0.004 * math.sqrt(250_000) / math.sqrt(2))) < 1e-5


def test_clustering_winners_equal_the_loop(spark):
    rng = random.Random(6)
    for _ in range(4):
        ks = list(range(2, rng.randint(4, 9)))
        pick = lambda: rng.choice([None, 0.05, 0.2, 0.2, 0.4, 0.9])
        scores = [(k, pick(), 1.0, pick(), pick(), 1.0, rng.choice([1.0, 2.0, 3.0])) for k in ks]
        scores[0] = (ks[0], 0.05, 1.0, 0.05, 0.9, 1.0, 2.0)
        runs = [(k, r, rng.choice([0.1, 0.5, 0.9])) for k in ks for r in range(2)]
        got = learn.clustering_winners(spark.createDataFrame(scores, "k int, silhouette double, inertia double, calinski_harabasz double, davies_bouldin double, aic double, bic double"), spark.createDataFrame(runs, "k int, run int, ari double")).first()
        best = lambda i, sign: min((s for s in scores if s[i] is not None), key=lambda s: (-sign * s[i], s[0]))[0]
        ari = {k: sum(a for j, _, a in runs if j == k) / 2 for k in ks}
        votes = [best(1, 1), best(4, -1), best(3, 1), min(ks, key=lambda k: (-ari[k], k))]
        assert [got[c] for c in ("silhouette_k", "davies_bouldin_k", "calinski_harabasz_k", "stability_k", "bic_k")] == [*votes, best(6, -1)]
        assert got["reference_k"] == min(ks, key=lambda k: (abs(k - float(np.median(votes))), k))
        top = max(s[1] for s in scores if s[1] is not None)
        assert got["structure"].split()[0] == ("weak" if top < 0.1 else "limited" if top < 0.25 else "moderate" if top < 0.5 else "strong")


def test_effective_folds(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), (None, 9)]
    df = spark.createDataFrame(rows, "label string, point int")
    assert tuple(learn.effective_folds(df, "label", "point", 5).first()) == (2, 2)
    assert tuple(learn.effective_folds(df, "label", None, 5).first()) == (3, 3) and learn.effective_folds(df, "label", None, 2).first()["folds"] == 2
