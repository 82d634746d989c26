"""Similarity of vectors in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocked_similarity(queries: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, label_col: str, k: int = 10, block: int = 4096) -> DataFrame:
    """vec_id, other, label, s, kind: per block of vectors, each query's k nearest ('near') and the best of each label ('class').

    Vectors are unit vectors of one length. A query's own row takes no part.
    Queries and vectors meet by (query block, vector block), so neither side
    has to fit a task; blocks return a few rows for each query.
    """
    sizes = [max(1, -(-t.count() // block)) for t in (queries, vectors)]
    key = lambda n, salt: F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), key(sizes[0], "q").alias("qb"), each(sizes[1]).alias("vb"))
    right = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"), each(sizes[0]).alias("qb"), key(sizes[1], "v").alias("vb"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = []  # query ids, places in the block, scores, kind
        if len(a) and len(b):
            x, y = (np.stack(t["v"].combine_chunks().to_numpy(zero_copy_only=False)) for t in (a, b))
            ids, labels, asked = b["id"].to_numpy(), b["label"].to_numpy(), a["id"].to_numpy()
            order = np.lexsort((ids, labels))  # within a label, the smaller id comes first
            y, ids, labels = y[order], ids[order], labels[order]
            starts = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1])))
            spread = np.diff(np.concatenate((starts, [len(ids)])))
            for at in range(0, len(asked), 256):
                own = asked[at : at + 256]
                s = x[at : at + 256] @ y.T
                s[own[:, None] == ids[None]] = -np.inf
                top = np.maximum.reduceat(s, starts, axis=1)
                first = np.minimum.reduceat(np.where(s == np.repeat(top, spread, axis=1), np.arange(len(ids)), len(ids)), starts, axis=1)
                row, column = np.nonzero(top > -np.inf)
                found.append((own[row], first[row, column], top[row, column], "class"))
                for q, r in zip(own.tolist(), s, strict=True):
                    bar = np.partition(r, -k)[-k] if len(r) > k else -np.inf
                    some = np.flatnonzero((r >= bar) & (r > -np.inf))
                    some = some[np.lexsort((ids[some], -r[some]))[:k]]
                    found.append((np.full(len(some), q), some, r[some], "near"))
        none = np.zeros(0, np.int64)
        q, place, score = (np.concatenate([none, *(f[i] for f in found)]) for i in range(3))
        place = place.astype(np.int64)
        kind = np.repeat([f[3] for f in found], [len(f[0]) for f in found]) if found else []
        picked = (ids[place], labels[place]) if found else (none, none)
        columns = (pa.array(q, pa.int64()), pa.array(picked[0], pa.int64()), pa.array(picked[1].astype(np.int32), pa.int32()), pa.array(score.astype(np.float64)), pa.array(list(kind), pa.string()))
        return pa.table(dict(zip(("vec_id", "other", "label", "s", "kind"), columns, strict=True)))

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(meet, "vec_id long, other long, label int, s double, kind string")
