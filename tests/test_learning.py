"""Learning queries against plain numpy on the same rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import fieldlens.queries  # noqa: F401
from fieldlens.operators import learn
from fieldlens.plans.tables import table
from fieldlens.queries.learning import cohort
from fieldlens.registry import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
FEATURES = ["area_ha", "pixels", "p_b"]


def newton(x, y, weight, ridge=0.01):
    """Weighted logistic regression with a ridge on the slopes, by Newton's steps."""
    z, w = np.column_stack((x, np.ones(len(x)))), np.zeros(x.shape[1] + 1)
    keep = np.diag([ridge] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ ((p - y) * weight) / weight.sum() + keep @ w
        hess = (z * (p * (1 - p) * weight)[:, None]).T @ z / weight.sum() + keep
        w = w - np.linalg.solve(hess, grad)
    return w


def out_of_fold(rows, splits, folds, features, balanced, part=lambda r: True):
    """Predictions p of all rows, each by the model of the other folds; medians, scales and weights from the training rows."""
    y = np.array([r["y"] for r in rows])
    fold = np.array([splits[r["sample_id"]] for r in rows])
    raw = np.array([[np.nan if r[f] is None else float(r[f]) for f in features] for r in rows])
    p, chosen = np.zeros(len(rows)), np.array([part(r) for r in rows])
    for k in range(folds):
        train = (fold != k) & chosen
        median = [np.sort(c[~np.isnan(c)])[int(np.ceil(0.5 * (~np.isnan(c)).sum())) - 1] for c in raw[train].T]
        x = np.where(np.isnan(raw), median, raw)
        mean, std = x[train].mean(0), x[train].std(0, ddof=1)
        x = (x - mean) / np.where(std > 0, std, 1)
        weight = np.array([train.sum() / (2 * (y[train] == v).sum()) for v in y[train]]) if balanced else np.ones(train.sum())
        w = newton(x[train], y[train], weight)
        p[fold == k] = 1 / (1 + np.exp(-(x[fold == k] @ w[:-1] + w[-1])))
    return y, p


def scores(y, p):
    hit = (p >= 0.5) == (y == 1)
    f1 = [2 * (hit & (y == v)).sum() / ((y == v).sum() + ((p >= 0.5) == (v == 1)).sum()) for v in (0, 1)]
    return hit.mean(), np.mean(f1)


def near(row, y, p, borderline=2):
    """Equal up to predictions within a hair of one half."""
    accuracy, f1 = scores(y, p)
    slack = max(borderline, (np.abs(p - 0.5) < 2e-3).sum()) / len(y) + 1e-6
    assert row["n"] == len(y) and abs(row["accuracy"] - accuracy) <= slack and abs(row["macro_f1"] - f1) <= 2 * slack


def split_of(spark, c, folds, seed):
    return {r["sample_id"]: r["fold"] for r in learn.stratified_folds(c, "sample_id", "y", folds, seed).collect()}


def test_logistic_out_of_fold(spark):
    c = cohort(spark, FOLDER)
    rows = c.collect()
    near(QUERIES["q_logistic_out_of_fold"](spark, FOLDER).first(), *out_of_fold(rows, split_of(spark, c, 3, 3), 3, FEATURES, True))


def test_feature_grid_and_cohort_size(spark):
    c = cohort(spark, FOLDER)
    rows, splits = c.collect(), split_of(spark, c, 2, 3)
    grid = {r["variant"]: r for r in QUERIES["q_feature_grid"](spark, FOLDER).collect()}
    for name, features in {"size": FEATURES[:2], "score": FEATURES[2:], "all": FEATURES}.items():
        near(grid[name], *out_of_fold(rows, splits, 2, features, False))
    sizes = {r["training"]: r for r in QUERIES["q_cohort_size"](spark, FOLDER).collect()}
    near(sizes["FULL"], *out_of_fold(rows, splits, 2, FEATURES, False))
    near(sizes["OLD"], *out_of_fold(rows, splits, 2, FEATURES, False, part=lambda r: int(r["event_id"].rsplit("-", 1)[1]) < 1996))


def test_linear_probe(spark):
    c = cohort(spark, FOLDER)
    rows = c.collect()
    for r in QUERIES["q_linear_probe"](spark, FOLDER).collect():
        near(r, *out_of_fold(rows, split_of(spark, c, 2, 100 + r["repeat"]), 2, FEATURES, True))


def test_boosted_trees_learn_what_a_line_can_not(spark):
    rows = [(i, i % 40, float(i % 7 - 3), float(i % 11 - 5), int((i % 7 - 3) * (i % 11 - 5) > 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "i int, sample_id int, a double, b double, y int")
    splits = learn.stratified_folds(df, "sample_id", "y", 2, 3)
    right = lambda make: learn.out_of_fold(df, splits, "sample_id", "y", make, 2).agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double"))).first()[0]
    assert right(learn.boosted(["a", "b"], "y")) >= 0.95 > 0.8 > right(learn.logistic(["a", "b"], "y"))
    got = QUERIES["q_boosted_out_of_fold"](spark, FOLDER).first()
    assert got["n"] == cohort(spark, FOLDER).count() and 0 <= got["accuracy"] <= 1


def vectors(spark):
    return np.array([r[0] for r in table(spark, FOLDER, "embeddings").orderBy("vec_id").select("embedding").collect()], float)


def test_pca(spark):
    x = vectors(spark)
    values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    share = values / values.sum()
    got = QUERIES["q_pca"](spark, FOLDER).orderBy("component").collect()
    assert np.allclose([r["variance"] for r in got], share[:20], atol=1e-9)
    enough = int(np.searchsorted(np.cumsum(share), 0.5)) + 1
    assert sum(r["needed"] for r in got) == min(enough, 20)


def test_cluster_scores(spark):
    """Of the same assignments, by the plain formulas."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = {r["k"]: r for r in learn.cluster_scores(table(spark, FOLDER, "embeddings"), "embedding", [3, 6]).collect()}
    df = table(spark, FOLDER, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    for k, row in rows.items():
        model = KMeans(k=k, seed=5, maxIter=20).fit(df.cache())
        done = model.transform(df).collect()
        x, label, centres = np.array([r["features"].toArray() for r in done]), np.array([r["prediction"] for r in done]), np.array(model.clusterCenters())
        inertia = ((x - centres[label]) ** 2).sum()
        assert abs(row["inertia"] - inertia) < 1e-6 * inertia
        total = ((x - x.mean(0)) ** 2).sum()
        assert abs(row["calinski_harabasz"] - (total - inertia) / (k - 1) / (inertia / (len(x) - k))) < 1e-6 * row["calinski_harabasz"]
        s = np.array([np.sqrt(((x[label == i] - centres[i]) ** 2).sum(1)).mean() for i in range(k)])
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.diag([np.inf] * k)
        assert abs(row["davies_bouldin"] - ((s[:, None] + s[None]) / apart).max(1).mean()) < 1e-6
        square = ((x[:, None] - x[None]) ** 2).sum(2)
        mean = np.array([[square[i, (label == j) & (np.arange(len(x)) != i)].mean() if ((label == j) & (np.arange(len(x)) != i)).any() else np.nan for j in range(k)] for i in range(len(x))])
        a = mean[np.arange(len(x)), label]
        b = np.nanmin(np.where(np.arange(k)[None] == label[:, None], np.nan, mean), 1)
        silhouette = np.where(np.isnan(a), 0, (b - a) / np.fmax(a, b))
        assert abs(row["silhouette"] - silhouette.mean()) < 1e-6
        assert abs(row["bic"] - row["aic"] - (6 * k - 1) * (np.log(len(x)) - 2)) < 1e-6


def test_cluster_stability_of_planted_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 0.1, 3) + 10 * np.eye(3)[i % 3]).tolist()) for i in range(120)]
    got = learn.cluster_stability(spark.createDataFrame(rows, "i int, v array<double>"), "i", "v", [3], 2).collect()
    assert [r["ari"] for r in got] == [1.0, 1.0]
    again = QUERIES["q_cluster_stability"](spark, FOLDER).collect()
    assert len(again) == 6 and all(-1 <= r["ari"] <= 1 for r in again)


def test_average_precision_by_hand(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False), (None, True)], "s double, y boolean")
    got = learn.average_precision(rows, "s", "y").first()
    assert (got["average_precision"], got["positives"]) == (round((1 + 2 / 3) / 2, 6), 2)


def test_folds_are_joined_once(spark):
    c = cohort(spark, FOLDER)
    found = learn.out_of_fold(c, learn.stratified_folds(c, "sample_id", "y", 2, 3), "sample_id", "y", learn.logistic(FEATURES, "y"), 2)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == c.count()
