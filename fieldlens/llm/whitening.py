"""Whitening of embedding vectors: principal components scaled to unit variance.

An entry c becomes the whole number ``floor(64 * c) + 1000000``. The fit list
holds each distinct vector of these once. One aggregation of generated
expressions sums, for every pair of dimensions with i <= j, the products of
entries centred by the whole part of the mean; the driver takes out what the
mean's fraction adds, in whole numbers of any size, and so has the covariance
to the last bit of a double. LAPACK decomposes it. Nothing but sums leaves the
executors: a row of d * (d + 3) / 2 numbers for d dimensions.

Vectors that are null or hold null or non-finite entries are dropped, as are
those of another length than the commonest one (of equally common ones the
longest), and those with entries beyond 2 ** 40, which double precision could
not whiten beside the others. Copies count once in the fit and each gets its rows. Components whose variance
is below 1e-12 of the total don't exist: a fit list of one vector, or of equal
ones, has none, so nothing is returned. Ties between eigenvalues are left as
LAPACK orders them; the largest entry of a component is positive. A deviation
that no long holds is null. An empty table gives an empty result. Repeated and
null ids are kept; columns other than id and vector are not read, so their
names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm import textkit as tk
from fieldlens.plans.lineage import materialize

#: Fixed values of the contract: the grid of entries.
SCALE, SHIFT = 64, 1_000_000
#: Entries may be so large; a component's variance must be this share of the total.
LARGEST, LEAST_SHARE = float(1 << 40), 1e-12


@dataclass(frozen=True)
class Whitening:
    """n vectors with per-dimension sums, the components kept (rows), their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows. The whole part of the mean goes first, so nothing is lost to the offset."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - whole) - part) @ (self.components / np.sqrt(self.values)[:, None]).T


def gridded(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))) & (F.size("v") > 0)  # NaN is above all numbers
    rows = rows.filter(F.col("v").isNotNull() & usable)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return rows.select("vec_id", F.lit(None).cast("array<long>").alias("x")).limit(0)
    return rows.filter(F.size("v") == lengths["d"]).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def triangle(names: list[str]) -> list[Column]:
    """Expressions that sum the products of every pair of columns, i <= j."""
    return [F.expr(f"sum({a} * {b})") for i, a in enumerate(names) for b in names[i:]]


def _square(row, d: int) -> list[list]:
    out, at = [[0] * d for _ in range(d)], 0
    for i in range(d):
        for j in range(i, d):
            out[i][j] = out[j][i] = row[at]
            at += 1
    return out


def covariance(distinct: DataFrame, n: int, sums: list[int], widest: int) -> np.ndarray:
    """Covariance, divisor n, of the x of ``distinct``, whose entries lie within ``widest`` of their means."""
    d = len(sums)
    # doubles add up whole numbers exactly to 2 ** 53; beyond, entries are centred by the whole mean instead
    exact = n * (widest + 1) ** 2 < 1 << 53
    rest = [s % n for s in sums]
    names = [f"u{i}" for i in range(d)]
    entries = ((F.get("x", F.lit(i)) - F.lit(sums[i] // n)).cast("double") - (0.0 if exact else rest[i] / n) for i in range(d))
    centred = distinct.select(*(F.coalesce(e, F.lit(0.0)).alias(c) for e, c in zip(entries, names, strict=True)))
    products = _square(centred.agg(*triangle(names)).first(), d)
    if not exact:
        return np.array(products) / n
    # what is left of the mean takes rest_i * rest_j / n off the sum
    return np.array([[float(Fraction(n * int(products[i][j]) - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])


def fit(distinct: DataFrame, most: int = 16) -> Whitening | None:
    """The whitening of the fit list (x), by at most ``most`` components; None if it is empty."""
    first = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = first["n"], first["d"]
    if not n:
        return None
    at = [F.element_at("x", i + 1) for i in range(d)]
    ends = distinct.agg(*(F.sum(x.cast("decimal(18,0)")) for x in at), *(F.min(x) for x in at), *(F.max(x) for x in at)).first()
    sums = [int(s) for s in ends[:d]]
    widest = max(max(abs(ends[d + i] - s // n), abs(ends[2 * d + i] - s // n)) for i, s in enumerate(sums))
    v = covariance(distinct, n, sums, int(widest))
    values, vectors = np.linalg.eigh(v)
    trace = float(np.trace(v))
    order = [k for k in range(d - 1, -1, -1) if values[k] > LEAST_SHARE * trace][:most]
    components = vectors[:, order].T.copy()
    for c in components:
        c *= np.sign(c[np.argmax(np.abs(c))])
    return Whitening(n, sums, components, values[order], trace)


def _projected(df: DataFrame, model: Whitening, keep: list[str], with_deviation: bool) -> DataFrame:
    """Kept columns and the whitened vector, an array."""
    names, types = tk.kept(df, keep)
    rest = np.array([s % model.n for s in model.sums], np.int64)
    whole = np.array([s // model.n for s in model.sums], np.int64)

    def deviations(x: np.ndarray) -> list[int | None]:
        u = x - whole
        near = ((model.n * u.astype(float) - rest) ** 2).sum(axis=1) < 4e18  # then no step below overflows
        exact = ((model.n * np.where(near[:, None], u, 0) - rest) ** 2).sum(axis=1)
        out: list[int | None] = exact.tolist()
        for i in np.flatnonzero(~near).tolist():
            total = sum((model.n * int(a) - int(b)) ** 2 for a, b in zip(u[i], rest, strict=True))
            out[i] = total if total < 1 << 63 else None
        return out

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
            white = model.project(x)
            arrays = [batch[c] for c in names] + ([pa.array(deviations(x), pa.int64())] if with_deviation else [])
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, white.shape[1]), pa.int32()), pa.array(white.ravel()))
            yield pa.record_batch([*arrays, whitened], [*names, *(["deviation"] if with_deviation else []), "white"])

    schema = ", ".join(s for s in (types, "deviation long" if with_deviation else "", "white array<double>") if s)
    return df.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), "x").mapInArrow(run, schema)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, measured on the rows."""
    k = len(model.values)
    white = _projected(distinct, model, [], False)
    white = white.select(*(F.element_at("white", i + 1).alias(f"w{i}") for i in range(k)))
    means = white.agg(*(F.avg(c) for c in white.columns)).first()
    centred = white.select(*((F.col(c) - m).alias(c) for c, m in zip(white.columns, means, strict=True)))
    row = centred.agg(*triangle(centred.columns)).first()
    return float(np.abs(np.array(_square(row, k)) / model.n - np.eye(k)).max())


def whiten(df: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = gridded(df, id_col, vector_col)
    distinct = materialize(rows.select("x").distinct())
    model = fit(distinct, most)
    kind = df.schema[id_col].dataType.simpleString()
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(distinct, model)
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    spread = _projected(rows, model, ["vec_id"], True).toDF("vec_id", "deviation", "white").select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return spread.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
