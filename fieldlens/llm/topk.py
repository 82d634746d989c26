"""Exact top-k inner products with pivot-table elimination.

Vectors become whole numbers, floor(scale x component). Distances of all
vectors to a few dozen pivots are tabulated once; by the triangle inequality
each pivot bounds the distance of a query to a vector from below, and so their
inner product from above.

1. Vectors are dealt to cells by their nearest centre. A cell keeps, for each
   pivot, the interval of its vectors' distances, and so has a bound for any query.
2. A query first meets a block of the cell with its highest bound; its k-th
   score there is the bar.
3. It then goes to the blocks of all cells whose bound reaches the bar, and to
   no others. In a block it takes its candidates in order of their own bounds,
   and stops once its k-th score is above every bound left: the result is exact.

Blocks hold at most about ``block_rows`` vectors and ``queries_per_block``
queries, however large a cell is; queries of neighbouring cells share blocks.
The driver sees the cells' intervals, of at most ``most_cells`` cells.

Vectors that are null, or hold null or non-finite components, and rows without
an id take no part. Shorter vectors count as padded with zeros. A repeated
query id is one query (its smallest vector); candidates with the query's id are
its own row; other repeated ids are candidates each. Ties go to the smaller id.
Components may have any size: products that doubles or longs can't hold are
made with whole numbers of any length, and a score beyond a long saturates. Very
long vectors only need room in a block. An empty table, or one without a query,
gives an empty result. Columns besides id and vector, whatever their names, are
read by the query condition only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm import textkit as tk
from fieldlens.plans.lineage import materialize


def usable(vector: str) -> Column:
    """True for vectors all of whose components are finite numbers."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(column: pa.ChunkedArray | pa.Array, dim: int, scale: float) -> np.ndarray:
    """One row of whole numbers, as doubles, per vector, zero-padded to ``dim``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array(column.value_lengths(), np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(column), max(dim, 1)))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors far from each other: each next pivot is the one farthest from those before it."""
    if not len(sample):
        return sample
    with np.errstate(over="ignore", invalid="ignore"):
        far = ((sample - sample.mean(0)) ** 2).sum(1)
        chosen = []
        for _ in range(min(n, len(sample))):
            chosen.append(int(far.argmax()))
            last = ((sample - sample[chosen[-1]]) ** 2).sum(1)
            far = np.minimum(far, last) if len(chosen) > 1 else last
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distance of every row to every pivot."""
    with np.errstate(over="ignore", invalid="ignore"):
        square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * (x @ pivots.T)
        return np.sqrt(np.maximum(square, 0))


def most_product(q_norm: float, x_norm: np.ndarray, apart: np.ndarray, reach: float) -> np.ndarray:
    """Upper bound of the inner product of vectors with these lengths that are at least ``apart`` from each other; ``reach``: length of the farthest pivot, for the rounding of tabulated distances."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = np.maximum(apart - 2e-6 * (x_norm + q_norm + reach), 0)
        whole = x_norm**2 + q_norm**2
        most = (whole - apart**2) / 2 + 1e-9 * whole + 1
    return np.where(np.isfinite(most), most, np.inf)


def least_apart(columns: np.ndarray, to_pivots: np.ndarray, n: int) -> np.ndarray:
    """Lower bounds of a query's distance to n vectors: the greatest difference of their distances to a pivot. ``columns`` has a row of the table for each pivot; singles, whose rounding ``most_product`` allows for."""
    out, one = np.zeros(n, np.float32), np.empty(n, np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        for column, d in zip(columns, to_pivots, strict=True):
            np.subtract(column, d, out=one)
            np.maximum(out, np.abs(one, out=one), out=out)
    return out.astype(np.float64)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as longs; beyond a long they saturate."""
    size = x.shape[1] * np.abs(x).max(1, initial=0) * max(np.abs(q).max(initial=0), 1)
    if not (size >= 2**52).any():
        return (x @ q).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    small, fits = size < 2**52, size < 2**62
    out[small] = (x[small] @ q).astype(np.int64)
    mid = fits & ~small
    if mid.any():
        near = np.abs(q) < 2**62  # others only meet zeros
        out[mid] = x[mid].astype(np.int64) @ np.where(near, q, 0).astype(np.int64)
    wide = [int(c) for c in q] if (~fits).any() else []
    for i in np.flatnonzero(~fits).tolist():
        out[i] = max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(x[i], wide, strict=True))))
    return out


def block_top(asked: tuple, block: tuple, k: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best of a block for each query: query id, vector id, score; and how many products were computed.

    ``asked``: ids, vectors, distances to the pivots, lengths and bars of the
    queries; only scores of at least the bar are looked for. ``block``: ids,
    vectors, distances and lengths of the candidates.
    """
    ids, x, table, norm = block
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    computed = 0
    with np.errstate(over="ignore"):
        columns, asked_to = np.ascontiguousarray(table.T, np.float32), np.asarray(asked[2], np.float32)
    for qid, q, to_pivots, q_norm, bar in zip(*asked[:2], asked_to, *asked[3:], strict=True):
        most = most_product(q_norm, norm, least_apart(columns, to_pivots, len(x)), reach)
        left = np.flatnonzero((most >= bar) & (ids != qid))
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = max(4 * k, 64)
        while len(left):
            near = np.argpartition(-most[left], step)[:step] if len(left) > step else np.arange(len(left))
            some = left[near]
            best_id, best = np.concatenate((best_id, ids[some])), np.concatenate((best, products(x[some], q)))
            computed += len(some)
            top = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[top], best[top]
            left = np.delete(left, near)
            if len(best) == k:
                left = left[most[left] >= best[-1]]
            step *= 2
        found.append((np.full(len(best), qid), best_id, best))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, 0
    a, b, c = (np.concatenate(z) for z in zip(*found, strict=True))
    return a, b, c, computed


def neighbours_in_a_row(centres: np.ndarray) -> np.ndarray:
    """An order of the centres in which each is followed by the nearest one left."""
    if not len(centres):
        return np.zeros(0, np.int64)
    out, left = [0], np.ones(len(centres), bool)
    for _ in range(len(centres) - 1):
        left[out[-1]] = False
        far = ((centres - centres[out[-1]]) ** 2).sum(1)
        out.append(int(np.where(left, far, np.inf).argmin()) if np.isfinite(far[left]).any() else int(left.argmax()))
    return np.array(out)


class Cells:
    """What the driver knows of the cells: sizes, lanes, greatest lengths and intervals of distances to the pivots."""

    def __init__(self, placed: DataFrame, n_pivots: int, block_rows: int, reach: float):
        interval = [f(F.element_at("d", i + 1)).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(n_pivots)]
        rows = sorted(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), *interval).collect(), key=lambda r: r["cell"])
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        self.lanes = np.array([-(-r["n"] // block_rows) for r in rows], np.int64)
        self.norm = np.array([r["norm"] for r in rows], np.float64)
        self.low = np.array([[r[f"low{i}"] for i in range(n_pivots)] for r in rows], np.float64).reshape(len(rows), n_pivots)
        self.high = np.array([[r[f"high{i}"] for i in range(n_pivots)] for r in rows], np.float64).reshape(len(rows), n_pivots)
        self.reach = reach

    def bounds(self, to_pivots: np.ndarray, norm: float) -> np.ndarray:
        """Upper bound of a query's inner product with any vector of each cell."""
        apart = np.maximum(self.low - to_pivots, to_pivots - self.high).max(1, initial=0)
        return most_product(norm, self.norm, apart, self.reach)


def place(rows: DataFrame, scale: float, n_pivots: int, most_cells: int, sample_rows: int, block_rows: int, cell_rows: int = 2048) -> tuple[DataFrame, Cells, int, float]:
    """The table of (id, v, asks) with distances to the pivots, length and cell; its cells; the longest vector's dimension; the farthest pivot's length."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
    dim = size["dim"]
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow()
    sample = whole_numbers(sample["v"], dim, scale) if len(sample) else np.zeros((0, max(dim, 1)))
    pivots = choose_pivots(sample, n_pivots)
    centres = np.unique(sample[: max(1, min(most_cells, size["n"] // cell_rows))], axis=0)
    centres = centres[neighbours_in_a_row(centres)]
    with np.errstate(over="ignore"):
        reach = float(np.sqrt((pivots**2).sum(1)).max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch.column(1), dim, scale)
            d = distances(x, pivots).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(pivots)), pa.array(d.ravel()))
            cell = np.nan_to_num(distances(x, centres), nan=np.inf).argmin(1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array(np.sqrt((x**2).sum(1))), pa.array(cell)], ["id", "v", "asks", "d", "norm", "cell"])

    placed = materialize(rows.mapInArrow(tk.tidy(run), f"id long, v {rows.schema['v'].dataType.simpleString()}, asks boolean, d array<float>, norm double, cell long"))
    return placed, Cells(placed, len(pivots), block_rows, reach), dim, reach


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0,
    n_pivots: int = 32, most_cells: int = 512, sample_rows: int = 1024, queries_per_block: int = 2048, block_rows: int = 16384,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to the smaller id.

    Pivots and centres come from ``sample_rows`` vectors picked by a hash; any choice gives the same result.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("asks"))
    placed, cells, dim, reach = place(rows, scale, n_pivots, most_cells, sample_rows, block_rows)
    number = {c: i for i, c in enumerate(cells.cell.tolist())}
    # neighbouring cells' queries share a block, a cell with very many has several
    asked_of = {r["cell"]: r["count"] for r in placed.filter("asks").groupBy("cell").count().collect()}
    first, shares, held, at = {}, {}, 0, 0
    for c in cells.cell.tolist():
        n = asked_of.get(c, 0)
        if held and held + n > queries_per_block:
            at, held = at + 1, 0
        first[c], shares[c] = at, max(1, -(-n // queries_per_block))
        at, held = at + shares[c] - 1, held + n if shares[c] == 1 else queries_per_block

    lane_of = [F.lit(int(n)) for n in cells.lanes[[number.get(c, 0) for c in range(int(cells.cell.max(initial=0)) + 1)]]] if len(cells.cell) else [F.lit(1)]
    lanes = F.element_at(F.array(*lane_of), F.col("cell").cast("int") + 1)
    against = placed.select("id", "v", "d", "norm", "cell", F.pmod(F.xxhash64("id", F.lit("lane")), lanes).alias("lane"))
    asked = materialize(placed.filter("asks").groupBy("id").agg(F.min(F.struct("v", "d", "norm", "cell")).alias("q")).select("id", "q.*"))

    def visits(queries: DataFrame, first_only: bool) -> DataFrame:
        """One row for each block that a query goes to."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                source, block, lane, qb = [], [], [], []
                own, bars = batch.column(4).to_pylist(), batch.column(5).to_numpy()
                for i, (qid, d, norm) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True)):
                    most = cells.bounds(d.values.to_numpy().astype(np.float64), norm)
                    best = int(most.argmax())
                    for j in [best] if first_only else np.flatnonzero(most >= bars[i]).tolist():
                        for x in range(1 if first_only else int(cells.lanes[j])):
                            if first_only or j != best or x:
                                source.append(i)
                                block.append(int(cells.cell[j]))
                                lane.append(x)
                                qb.append(first[own[i]] + (qid % shares[own[i]]))
                taken = batch.take(pa.array(source, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(taken.column(i) for i in (0, 1, 2, 3, 5)), pa.array(block, pa.int64()), pa.array(lane, pa.int64()), pa.array(qb, pa.int64())], ["id", "v", "d", "norm", "bar", "cell", "lane", "qb"])

        kind = rows.schema["v"].dataType.simpleString()
        return queries.select("id", "v", "d", "norm", "cell", "bar").mapInArrow(tk.tidy(run), f"id long, v {kind}, d array<float>, norm double, bar double, cell long, lane long, qb long")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        got = (np.zeros(0, np.int64),) * 3
        if len(left) and len(right):
            read = lambda t: (t["id"].to_numpy(), whole_numbers(t["v"], dim, scale), t["d"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(t), -1), t["norm"].to_numpy())
            got = block_top((*read(left), left["bar"].to_numpy()), read(right), k, reach)[:3]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), got, strict=True)})

    def scores(queries: DataFrame) -> DataFrame:
        # a block travels once to each block of queries that has a visitor for it
        wanted = queries.select(F.col("cell").alias("c"), F.col("lane").alias("l"), "qb").distinct()
        copies = against.join(wanted, (F.col("cell") == F.col("c")) & (F.col("lane") == F.col("l"))).drop("c", "l")
        copies = copies.select(*(F.col(c).alias(c) for c in copies.columns))  # both sides come from the queries
        keys = ["qb", "cell", "lane"]
        return queries.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(tk.tidy(meet), "query_id long, vec_id long, score long")

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    opening = materialize(scores(materialize(visits(asked.withColumn("bar", F.lit(float("-inf"))), True))))
    bars = opening.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("bar"))
    barred = asked.join(bars, F.col("id") == F.col("query_id"), "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    further = scores(materialize(visits(barred, False)))
    near = opening.unionByName(further)
    return near.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
