"""Resampling, splits and models of the evaluation operators, on Spark's own learners."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.operators.aggregate import binary_metrics


def draw(*parts: Column) -> Column:
    """A fixed pseudo-random whole number below 2**32 for the parts: the first 8 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


#: Drawn numbers that a task makes, and numbers that a task looks up.
DRAWN, LOOKED_UP = 2_000_000, 4_000_000


def numbers(spark: SparkSession, k: int, runs: int) -> DataFrame:
    """run, t: 0 to k - 1 in each run. Tasks grow in number with the rows, not in size."""
    ids = spark.range(0, k * runs, 1, max(1, -(-k * runs // DRAWN)))
    return ids.select((F.col("id") / k).cast("long").alias("run"), (F.col("id") % k).alias("t"))


def resampled(numbered: DataFrame, k: int, runs: int) -> DataFrame:
    """Rows of ``numbered`` (i from 0 to k - 1) as drawn with replacement, k in each run, with ``run``.

    Draws are not counted before they meet their rows, as hardly two of a run are the same: a task
    that counts them holds them all. They pass by a small table of rows instead, in as many parts as there are draws for.
    """
    parts = max(1, -(-k * runs // LOOKED_UP))
    drawn = numbers(numbered.sparkSession, k, runs).select("run", (draw(F.col("run"), F.col("t")) % max(k, 1)).alias("i"))
    return drawn.repartition(parts, "i").join(numbered.repartition(parts, "i").hint("shuffle_hash"), "i")


def mark_lowest(rows: DataFrame, group: str, draw: str, tie: str, n: DataFrame) -> DataFrame:
    """Adds ``taken``: whether a row is one of its group's n lowest by draw (from 0 to below 2**32), then by tie.

    ``n`` is one row with the column n, at most the rows of a group. The n-th draw is found by
    descent over counts of its digits, so a window holds at most 2048 counts of a group, or the rows that share one draw.
    """
    from fieldlens.plans.lineage import materialize

    need, bars, left = n.select(F.col("n").alias("__need")), None, 32
    for bits in (11, 11, 10):
        if bars is None:
            inside = rows.crossJoin(F.broadcast(need))
        else:
            inside = rows.join(F.broadcast(bars), group).filter(F.shiftright(draw, left) == F.col("__bar"))
        left -= bits
        counts = inside.groupBy(group, "__need", F.shiftright(draw, left).alias("__d")).agg(F.count(F.lit(1)).alias("__c"))
        upto = counts.withColumn("__upto", F.sum("__c").over(Window.partitionBy(group).orderBy("__d"))).filter("__upto >= __need")
        bars = upto.groupBy(group).agg(F.min(F.struct("__d", (F.col("__need") - F.col("__upto") + F.col("__c")).alias("need"))).alias("__b"))
        bars = bars.select(group, F.col("__b.__d").alias("__bar"), F.col("__b.need").alias("__need"))
    joined = rows.join(F.broadcast(materialize(bars)), group)
    even = joined.filter(F.col(draw) == F.col("__bar")).withColumn("taken", F.row_number().over(Window.partitionBy(group).orderBy(tie)) <= F.col("__need"))
    return joined.filter(F.col(draw) != F.col("__bar")).withColumn("taken", F.col(draw) < F.col("__bar")).unionByName(even).drop("__bar", "__need")


def cluster_bootstrap(df: DataFrame, cluster: str, hits: Column, runs: int) -> DataFrame:
    """One row: share of hits with its 2.5 and 97.5 % quantiles over resamplings of whole clusters.

    Clusters are first summed, then each run draws as many clusters as there
    are, with replacement: runs x clusters narrow rows, in tasks of bounded size.
    """
    from fieldlens.plans.lineage import materialize
    from fieldlens.plans.prefix import running_totals

    sums = materialize(df.groupBy(F.col(cluster).alias("c")).agg(F.sum(hits.cast("long")).alias("h"), F.count(F.lit(1)).alias("n")))
    numbered = materialize(running_totals(sums.withColumn("one", F.lit(1)), "c", {"i": "one"}).select((F.col("i") - 1).alias("i"), "h", "n"))
    k = sums.count()
    shares = resampled(numbered, k, runs).groupBy("run").agg((F.sum("h") / F.sum("n")).alias("share"))
    all_rows = sums.agg(F.round(F.sum("h") / F.sum("n"), 6).alias("share"))
    return all_rows.join(F.broadcast(shares.agg(F.percentile("share", [0.025, 0.975]).alias("q")))).select("share", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


def stratified_folds(df: DataFrame, group: str, label: str, folds: int, seed: int) -> DataFrame:
    """group, stratum, fold: groups stay whole; within a stratum (a group's smallest label) folds are dealt in hash order, so their sizes differ by one at most.

    Strata may be large: groups are numbered in lanes, not in one window.
    """
    from fieldlens.plans.lineage import materialize
    from fieldlens.plans.numbering import number_rows

    one = materialize(df.groupBy(group).agg(F.min(label).alias("stratum")).withColumn("__h", draw(F.lit(seed), F.col(group))))
    return number_rows(one, ["stratum"], ["__h", group], "__i", lanes=16).select(group, "stratum", (F.col("__i") % folds).cast("int").alias("fold"))


def effective_folds(df: DataFrame, label: str, group: str | None, requested: int) -> DataFrame:
    """One row: folds, the requested number or, if that is fewer, the groups (rows, without groups) of the rarest label, and that label's number. A group counts for every label it holds; rows with a null label don't count."""
    one = df.filter(F.col(label).isNotNull())
    each = one if group is None else one.select(label, group).distinct()
    counts = each.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    return counts.agg(F.least(F.lit(requested), F.min("__n")).alias("folds"), F.min("__n").alias("rarest"))


def clustering_winners(scores: DataFrame, stability: DataFrame) -> DataFrame:
    """One row: the k that is best by each measure of ``scores`` and by the mean agreement of ``stability``, the k nearest to the median of these votes, and how strongly the points are separated.

    ``scores`` has a row for each k, ``stability`` (k, run, ari). Of equally good k
    the smallest wins; mixtures are judged by BIC and don't vote.
    """
    mean = stability.groupBy(F.col("k").alias("__k")).agg(F.avg("ari").alias("ari"))
    rows = scores.join(mean, F.col("k") == F.col("__k"), "left")
    votes = {"silhouette_k": ("silhouette", 1), "davies_bouldin_k": ("davies_bouldin", -1), "calinski_harabasz_k": ("calinski_harabasz", 1), "stability_k": ("ari", 1), "bic_k": ("bic", -1)}
    found = F.struct(*(F.max(F.when(F.col(c).isNotNull(), F.struct((sign * F.col(c)).alias("v"), (-F.col("k")).alias("k"))))["k"].alias(into) for into, (c, sign) in votes.items()))
    row = rows.agg(found.alias("w"), F.max("silhouette").alias("best_silhouette"), F.max("ari").alias("best_ari"), F.sort_array(F.collect_list("k")).alias("ks"))
    row = row.select(*((-F.col(f"w.{into}")).alias(into) for into in votes), "best_silhouette", "best_ari", "ks")
    vote = F.sort_array(F.array_compact(F.array(*(into for into in votes if into != "bic_k"))))
    n = F.size(vote)
    median = (F.get(vote, F.floor((n - 1) / 2).cast("int")) + F.get(vote, F.floor(n / 2).cast("int"))) / 2
    nearest = F.array_min(F.transform("ks", lambda k: F.struct(F.abs(k - median).alias("far"), k.alias("k"))))["k"]
    s = F.col("best_silhouette")
    signal = F.when(s < 0.10, "weak separation").when(s < 0.25, "limited separation").when(s < 0.50, "moderate separation").when(s.isNotNull(), "strong separation")
    return row.select(*votes, nearest.alias("reference_k"), "best_silhouette", "best_ari", signal.alias("structure"))


def leaks(splits: DataFrame, group: str) -> DataFrame:
    """Groups that are in more than one fold; should be empty."""
    return splits.groupBy(group).agg(F.count_distinct("fold").alias("folds")).filter("folds > 1")


def logistic(features: list[str], label: str, weight: str | None = None, ridge: float = 0.01) -> Pipeline:
    """Median imputation, standardisation and a ridge logistic regression; everything is learned on the training rows only."""
    filled = [f"__i_{f}" for f in features]
    model = LogisticRegression(featuresCol="__x", labelCol=label, regParam=ridge, maxIter=50)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__x", withMean=True), model])


def boosted(features: list[str], label: str) -> Pipeline:
    """Gradient-boosted trees over the same imputed features."""
    filled = [f"__i_{f}" for f in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__x"), GBTClassifier(featuresCol="__x", labelCol=label, maxIter=10, maxDepth=3, seed=7)])


def balanced_weights(df: DataFrame, label: str, into: str = "__w") -> DataFrame:
    """Adds the weight n / (classes x rows of the class), so that all classes weigh the same."""
    per = df.groupBy(F.col(label).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    whole = per.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    weights = per.join(F.broadcast(whole)).select("__c", (F.col("__all") / (F.col("__k") * F.col("__n"))).alias(into))
    return df.join(F.broadcast(weights), F.col(label) == F.col("__c")).drop("__c")  # one row a class


def average_precision(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the mean precision over the positives, from the highest score down; rows are counted per score first."""
    from fieldlens.operators.aggregate import count_if
    from fieldlens.plans.prefix import running_totals

    per = scored.groupBy((-F.col(score)).alias("__s")).agg(count_if(F.col(positive)).alias("__p"), F.count(F.lit(1)).alias("__n"))
    upto = running_totals(per.filter("__s is not null"), "__s", {"__tp": "__p", "__all": "__n"})
    return upto.agg(F.round(F.sum(F.col("__p") * F.col("__tp") / F.col("__all")) / F.sum("__p"), 6).alias("average_precision"), F.sum("__p").alias("positives"))


def out_of_fold(df: DataFrame, splits: DataFrame, group: str, label: str, make: Pipeline, folds: int, balanced: bool = False) -> DataFrame:
    """Each fold's rows scored by a model of the others: the rows with fold and p. One fit a fold; ``balanced`` adds the training rows' weights as __w.

    A fit reads its rows several times, so they are joined with their folds once and written.
    """
    from fieldlens.plans.lineage import materialize

    joined, out = materialize(df.join(splits.select(group, "fold"), group)), None
    for k in range(folds):
        training = joined.filter(F.col("fold") != k)
        model = make.fit(balanced_weights(training, label) if balanced else training)
        scored = model.transform(joined.filter(F.col("fold") == k)).withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "fold", "p")
        out = scored if out is None else out.unionByName(scored)
    return out


def auc(scored: DataFrame, label: str) -> float:
    """Area under the ROC curve of column p."""
    return BinaryClassificationEvaluator(rawPredictionCol="p", labelCol=label).evaluate(scored)


def principal_components(vectors: DataFrame, vector: str, most: int, share: float) -> tuple[int, list[float]]:
    """The fewest components that reach the share of variance, and the variance of each of the first ``most``."""
    model = PCA(k=most, inputCol="__v", outputCol="__p").fit(vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("__v")))
    variance, total = [float(x) for x in model.explainedVariance], 0.0
    for i, x in enumerate(variance, 1):
        total += x
        if total >= share:
            return i, variance
    return most, variance


def cluster_scores(vectors: DataFrame, vector: str, ks: list[int]) -> DataFrame:
    """k; silhouette, inertia, Calinski-Harabasz and Davies-Bouldin index of k-means; AIC and BIC of a Gaussian mixture of the first two components. One fit a k.

    The indices come from sums per cluster: k rows of a vector each.
    """
    import math

    import numpy as np

    from fieldlens.plans.lineage import materialize

    spark = vectors.sparkSession
    x = materialize(vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
    two = materialize(PCA(k=2, inputCol="features", outputCol="z").fit(x).transform(x).select(F.col("z").alias("features")))
    n, rows = x.count(), []
    moments = x.select(Summarizer.metrics("variance").summary(F.col("features")).alias("s")).select("s.variance").first()
    spread = float(sum(moments["variance"])) * (n - 1) if n > 1 else 0.0
    for k in ks:
        km = KMeans(k=k, seed=5, maxIter=20).fit(x)
        done = km.transform(x)
        centres = np.array(km.clusterCenters())
        each = F.array(*(F.array(*(F.lit(float(c)) for c in row)) for row in centres))
        far = F.sqrt(F.aggregate(F.zip_with(vector_to_array("features"), F.get(each, F.col("prediction")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        sums = done.groupBy("prediction").agg(F.avg(far).alias("m"), F.sum(far * far).alias("s")).collect()
        inner, inertia = {r["prediction"]: r["m"] for r in sums}, sum(r["s"] for r in sums)
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
        worst = [max((inner[i] + inner[j]) / apart[i, j] for j in inner if j != i) for i in inner if len(inner) > 1]
        gm = GaussianMixture(k=k, seed=5, maxIter=20).fit(two)
        parameters, likelihood = k * 2 + k * 3 + k - 1, float(gm.summary.logLikelihood)
        calinski = (spread - inertia) / (k - 1) / (inertia / (n - k)) if k > 1 and n > k and inertia > 0 else None
        rows.append((k, float(ClusteringEvaluator().evaluate(done)), inertia, calinski, float(np.mean(worst)) if worst else None, 2.0 * parameters - 2 * likelihood, parameters * math.log(max(n, 1)) - 2 * likelihood))
    return spark.createDataFrame(rows, "k int, silhouette double, inertia double, calinski_harabasz double, davies_bouldin double, aic double, bic double")


def cluster_stability(vectors: DataFrame, key: str, vector: str, ks: list[int], runs: int, share: float = 0.8) -> DataFrame:
    """k, run, ari: how far k-means of a part of the rows, drawn by hash, agrees with k-means of all of them on that part."""
    from fieldlens.plans.lineage import materialize

    x = materialize(vectors.select(F.col(key).alias("key"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
    out = None
    for k in ks:
        whole = KMeans(k=k, seed=5, maxIter=20, predictionCol="a").fit(x)
        for run in range(runs):
            part = x.filter(draw(F.lit(run), F.col("key")) < int(share * 2**32))
            other = KMeans(k=k, seed=5 + run, maxIter=20, predictionCol="b").fit(part)
            row = adjusted_rand(other.transform(whole.transform(part)), "a", "b").select(F.lit(k).alias("k"), F.lit(run).alias("run"), "ari")
            out = row if out is None else out.unionByName(row)
    return out


def repeated_probe(df: DataFrame, group: str, label: str, features: list[str], folds: int, repeats: int) -> DataFrame:
    """repeat, n, accuracy, macro_f1 of a balanced logistic regression's out-of-fold predictions, on new folds each time."""
    from fieldlens.plans.lineage import materialize

    df, out = materialize(df), None  # every fit reads it again
    for i in range(repeats):
        splits = stratified_folds(df, group, label, folds, 100 + i)
        scored = out_of_fold(df, splits, group, label, logistic(features, label, weight="__w"), folds, balanced=True)
        row = scored.agg(*_scores(label)).select(F.lit(i).alias("repeat"), "n", "accuracy", "macro_f1")
        out = row if out is None else out.unionByName(row)
    return out


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index of two labelings, from their contingency counts."""
    pairs = lambda c: F.sum(c * (c - 1) / 2.0)
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cell, total = n.agg(pairs(F.col("n")).alias("s"), F.sum("n").alias("m")), lambda k: n.groupBy(k).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias(f"s_{k}"))
    x = cell.join(F.broadcast(total(a))).join(F.broadcast(total(b)))
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / (F.col("m") * (F.col("m") - 1) / 2.0)
    top = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2.0
    return x.select(F.round(F.when(top == expected, 1.0).otherwise((F.col("s") - expected) / (top - expected)), 6).alias("ari"))


def reject_bands(df: DataFrame, probability: str, truth: str, widths: list[float]) -> DataFrame:
    """For each width: rows whose probability is within it of one half are rejected; coverage and accuracy of the rest. Probabilities are counted first."""
    few = df.groupBy(F.col(probability).alias("p"), F.col(truth).alias("t")).agg(F.count(F.lit(1)).alias("m"))
    each = few.select("*", F.explode(F.array(*(F.lit(w) for w in widths))).alias("width"))
    kept = F.abs(F.col("p") - 0.5) >= F.col("width")
    s = lambda c: F.sum(F.when(c, F.col("m")).otherwise(0)).cast("double")
    return each.groupBy("width").agg(F.round(s(kept) / F.sum("m"), 6).alias("coverage"), F.round(F.when(s(kept) > 0, s(kept & ((F.col("p") >= 0.5) == F.col("t"))) / s(kept)), 6).alias("accuracy"))


def best_row(df: DataFrame, order: list[Column]) -> DataFrame:
    """The one row that is largest by several keys in turn."""
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))).alias("r")).select("r.*")


def shares_within(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Counts of label within cluster with their share."""
    n = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(cluster)), 6))


def seeds_that_fit(groups: DataFrame, group: str, stratum: str, cohort: str, folds: int, seeds: list[int]) -> DataFrame:
    """seed, fits: whether every fold of a seed's split holds every stratum of every cohort. All seeds are tried in one job.

    ``groups`` has one row a group. A group's fold is its draw modulo ``folds``,
    so no stratum is brought together, however large it is.
    """
    tried = groups.select(group, stratum, cohort, F.explode(F.array(*(F.lit(s).cast("long") for s in seeds))).alias("seed"))
    dealt = tried.withColumn("fold", draw(F.col("seed"), F.col(group)) % folds)
    cells = dealt.select("seed", "fold", stratum, cohort).distinct().groupBy("seed").agg(F.count(F.lit(1)).alias("filled"))
    wanted = groups.select(stratum, cohort).distinct().agg((F.count(F.lit(1)) * folds).alias("wanted"))
    return cells.join(F.broadcast(wanted)).select("seed", (F.col("filled") == F.col("wanted")).alias("fits"))  # one row is broadcast


def feature_grid(df: DataFrame, splits: DataFrame, group: str, label: str, variants: dict[str, list[str]], folds: int) -> DataFrame:
    """variant, n, accuracy, macro_f1: scores of the out-of-fold predictions of each set of features. One fit a variant and fold."""
    from fieldlens.plans.lineage import materialize

    df, splits, out = materialize(df), materialize(splits), None  # every fit reads them again
    for name, features in variants.items():
        scored = out_of_fold(df, splits, group, label, logistic(features, label), folds)
        row = scored.agg(*_scores(label)).select(F.lit(name).alias("variant"), "n", "accuracy", "macro_f1")
        out = row if out is None else out.unionByName(row)
    return out


def _scores(label: str) -> list[Column]:
    """Metrics of the predictions p >= 0.5."""
    return binary_metrics(F.col(label) == 1, F.col("p") >= 0.5)


def compare_training_sets(df: DataFrame, splits: DataFrame, group: str, label: str, features: list[str], training: dict[str, Column], folds: int) -> DataFrame:
    """training, n, accuracy, macro_f1: models that learn from different parts of the rows, each scored on all rows of the fold left out."""
    from fieldlens.plans.lineage import materialize

    joined, out = materialize(df.join(splits.select(group, "fold"), group)), None  # every fit reads it again
    for name, part in training.items():
        scored = None
        for k in range(folds):
            model = logistic(features, label).fit(joined.filter((F.col("fold") != k) & part))
            p = model.transform(joined.filter(F.col("fold") == k)).select(label, vector_to_array("probability")[1].alias("p"))
            scored = p if scored is None else scored.unionByName(p)
        row = scored.agg(*_scores(label)).select(F.lit(name).alias("training"), "n", "accuracy", "macro_f1")
        out = row if out is None else out.unionByName(row)
    return out
