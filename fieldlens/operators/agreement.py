"""How far labelings agree: best matching of names, stability of members, rank correlations with p-values."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions.special import correlation_p
from fieldlens.operators.learn import draw
from fieldlens.plans.lineage import materialize

#: Names that a labeling may have: their matching is found over subsets of them.
MOST_NAMES = 12


def best_matching(counts: list[list[int]]) -> list[int | None]:
    """For each row the column that it gets, each column at most once, so that the counts add up to most; of equal sums the first by columns. Rows beyond the columns get none."""
    rows, columns = len(counts), len(counts[0]) if counts else 0
    skips = max(rows - columns, 0)
    # best sum of the rows from i on, by the columns already given away; the rows left out follow from their number
    best: list[dict[int, int]] = [{} for _ in range(rows + 1)]
    best[rows] = {used: 0 for used in range(1 << columns)}
    options = lambda i, used: [c for c in range(columns) if not used >> c & 1] + ([None] if i - used.bit_count() < skips else [])
    worth = lambda i, used, c: best[i + 1].get(used if c is None else used | 1 << c, -1) + (0 if c is None else counts[i][c])
    for i in range(rows - 1, -1, -1):
        for used in range(1 << columns):
            if 0 <= i - used.bit_count() <= skips and (given := options(i, used)):
                best[i][used] = max(worth(i, used, c) for c in given)
    out: list[int | None] = []
    used = 0
    for i in range(rows):
        pick = next(c for c in options(i, used) if worth(i, used, c) == best[i][used])
        out.append(pick)
        used |= 0 if pick is None else 1 << pick
    return out


def align(df: DataFrame, reference: str, predicted: str, into: str = "aligned") -> DataFrame:
    """Adds the name in ``reference`` that each name in ``predicted`` matches best when every name is matched once; null for names without a partner.

    Rows are counted by pair of names first; there are at most MOST_NAMES of each.
    """
    counts = df.groupBy(reference, predicted).agg(F.count(F.lit(1)).alias("n")).filter(F.col(reference).isNotNull() & F.col(predicted).isNotNull())
    rows = counts.limit(MOST_NAMES * MOST_NAMES + 1).collect()
    names, others = (sorted({r[i] for r in rows}) for i in (0, 1))
    if max(len(names), len(others)) > MOST_NAMES:
        raise ValueError(f"labelings of at most {MOST_NAMES} names can be matched")
    n = {(r[0], r[1]): r["n"] for r in rows}
    pairs = [(others[c], a) for a, c in zip(names, best_matching([[n.get((a, b), 0) for b in others] for a in names]), strict=True) if c is not None]
    kind = df.schema[reference].dataType
    if not pairs:
        return df.withColumn(into, F.lit(None).cast(kind))
    found = F.lit(None).cast(kind)
    for b, a in pairs:
        found = F.when(F.col(predicted) == b, F.lit(a)).otherwise(found)
    return df.withColumn(into, found.cast(kind))


def membership_stability(vectors: DataFrame, key: str, vector: str, k: int, runs: int, share: float = 0.8) -> DataFrame:
    """key, cluster, stability: the share of runs in which k-means, fitted on a part of the rows drawn by hash, keeps the row in the cluster it has by all rows."""
    x = materialize(vectors.select(F.col(key).alias("key"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
    whole = materialize(KMeans(k=k, seed=5, maxIter=20, predictionCol="cluster").fit(x).transform(x))
    out = None
    for run in range(runs):
        model = KMeans(k=k, seed=6 + run, maxIter=20, predictionCol="other").fit(x.filter(draw(F.lit(run), F.col("key")) < int(share * 2**32)))
        same = align(model.transform(whole).select("key", "cluster", "other"), "cluster", "other").select("key", "cluster", F.coalesce((F.col("cluster") == F.col("aligned")).cast("int"), F.lit(0)).alias("same"))
        out = same if out is None else out.unionByName(same)
    return out.groupBy("key", "cluster").agg((F.sum("same") / F.lit(runs)).alias("stability")).select(F.col("key").alias(key), "cluster", "stability")


def cluster_roles(df: DataFrame, cluster: str, label: str, roles: dict[str, str], rest: str) -> DataFrame:
    """cluster, role, rows and the share of each label: the first label's role goes to the cluster with its greatest share (then rows, then the smaller number), the next one's among those left."""
    shares = [F.sum((F.col(label) == name).cast("long")).alias(f"n{i}") for i, name in enumerate(roles)]
    rows = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("rows"), *shares).orderBy(cluster).limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"at most {MOST_NAMES} clusters get roles")
    left, out = list(rows), []
    for i, role in enumerate(roles.values()):
        if left:
            best = max(left, key=lambda r: (r[f"n{i}"] / r["rows"], r[f"n{i}"], -r[cluster]))
            left.remove(best)
            out.append((best, role))
    out += [(r, rest) for r in left]
    made = [(r[cluster], role, r["rows"], *(r[f"n{i}"] / r["rows"] for i in range(len(roles)))) for r, role in out]
    return df.sparkSession.createDataFrame(made, f"{cluster} long, role string, rows long, " + ", ".join(f"share_{i} double" for i in range(len(roles))))


def rank_tests(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, n, spearman, p_value: rank correlation of two columns in each group. Ranks are of counts per value, equal values share theirs; rows with a null are left out."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranks(c: str, into: str) -> DataFrame:
        upto = F.sum("__n").over(Window.partitionBy(group).orderBy(c).rowsBetween(Window.unboundedPreceding, 0))  # as many rows as the group has values
        n = rows.groupBy(group, c).agg(F.count(F.lit(1)).alias("__n"))
        return n.select(F.col(group).alias(f"__g{into}"), F.col(c).alias(f"__v{into}"), (upto - (F.col("__n") - 1) / 2.0).alias(into))

    met = rows
    for c, into in ((a, "__ra"), (b, "__rb")):
        met = met.join(ranks(c, into), (F.col(group) == F.col(f"__g{into}")) & (F.col(c) == F.col(f"__v{into}")))
    per = met.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.corr("__ra", "__rb").alias("spearman"))
    return per.withColumn("p_value", correlation_p(F.col("spearman"), F.col("n")))
