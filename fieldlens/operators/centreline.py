"""Centre lines of masks: thinning, the longest path of what is left, and its smoothing.

A mask is a pixel table (key, row, col) that fits a task, as one tile does. Inside
the task everything works on arrays: thinning peels all border pixels of a
pass at once, distances are relaxed for all pixels at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.lines import measured
from fieldlens.operators.raster import label_components

#: The eight places around a pixel, clockwise from above, and how far they are.
AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
STEPS = np.array([1.0 if 0 in place else 2**0.5 for place in AROUND])


def thin(mask: np.ndarray) -> np.ndarray:
    """The skeleton of a boolean image, one pixel wide.

    Passes of two halves, until none removes a pixel: a border pixel goes if it
    has two to six neighbours, these form one run around it, and it lies at the
    lower right (first half) or upper left (second half) of the figure.
    """
    image = np.pad(np.asarray(mask, bool), 1)
    height, width = image.shape
    while True:
        removed = False
        for half in (0, 1):
            n = np.array([image[1 + r : height - 1 + r, 1 + c : width - 1 + c] for r, c in AROUND])
            count = n.sum(axis=0)
            runs = (~n & np.roll(n, -1, axis=0)).sum(axis=0)
            up, right, down, left = n[0], n[2], n[4], n[6]
            sides = ~(up & right & down) & ~(right & down & left) if half == 0 else ~(up & right & left) & ~(up & down & left)
            gone = image[1:-1, 1:-1] & (count >= 2) & (count <= 6) & (runs == 1) & sides
            image[1:-1, 1:-1] &= ~gone
            removed |= bool(gone.any())
        if not removed:
            return image[1:-1, 1:-1]


def _neighbours(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For each pixel (in row order) the numbers of its eight neighbours, or the number of pixels where there is none."""
    n, width = len(rows), int(cols.max() - cols.min()) + 3
    code = (rows - rows.min()) * width + (cols - cols.min()) + 1
    wanted = code[:, None] + np.array([r * width + c for r, c in AROUND])
    at = np.minimum(np.searchsorted(code, wanted), n - 1)
    return np.where(code[at] == wanted, at, n)


def _distances(near: np.ndarray, start: int) -> np.ndarray:
    d = np.full(len(near) + 1, np.inf)
    d[start] = 0.0
    while True:
        best = np.minimum(d[:-1], np.round((d[near] + STEPS).min(axis=1), 9))
        if (best == d[:-1]).all():
            return d
        d[:-1] = best


def longest_path(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pixels from one end to the other of the largest 8-connected part.

    The far end from the first pixel, then the far end from there: the longest
    shortest path of a tree, and a long one of a figure with rings. Diagonal
    steps count as the root of 2. Of equally large parts, equally far pixels and
    equally short ways the first in row order is taken.
    """
    label = label_components(rows, cols)
    largest = label == np.bincount(label).argmax() if len(label) else np.zeros(0, bool)
    rows, cols = rows[largest].astype(np.int64), cols[largest].astype(np.int64)
    order = np.lexsort((cols, rows))
    rows, cols = rows[order], cols[order]
    if len(rows) < 2:
        return rows, cols
    near = _neighbours(rows, cols)
    first = int(_distances(near, 0)[:-1].argmax())
    d = _distances(near, first)
    path = [int(d[:-1].argmax())]
    while path[-1] != first:
        around = near[path[-1]]
        path.append(int(around[np.abs(d[around] + STEPS - d[path[-1]]) < 1e-6].min()))
    return rows[path[::-1]], cols[path[::-1]]


def centre_lines(mask: DataFrame, key: str, kind: str = "long") -> DataFrame:
    """key, k, row, col: the pixels along the centre line of each mask, k from 0. Masks whose skeleton has fewer than two connected pixels have none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        image = np.zeros((r.max() - r.min() + 1, c.max() - c.min() + 1), bool)
        image[r - r.min(), c - c.min()] = True
        rows, cols = longest_path(*np.nonzero(thin(image)))
        if len(rows) < 2:
            rows = cols = np.zeros(0, np.int64)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(rows), "k": range(len(rows)), "row": rows + r.min(), "col": cols + c.min()})

    return mask.select(key, F.col("row").cast("int"), F.col("col").cast("int")).dropna().groupBy(key).applyInPandas(run, f"{key} {kind}, k long, row int, col int")


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The points of a line that keep it within ``tolerance``: ends stay, and of every stretch the farthest point from its chord if it is farther than that."""
    keep, open_ = np.zeros(len(points), bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        chord, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = chord @ chord
        along = np.clip(inner @ chord / length, 0, 1)[:, None] * chord if length else np.zeros_like(inner)
        far = np.sqrt(((inner - along) ** 2).sum(axis=1))
        at = int(far.argmax())
        if far[at] > tolerance:
            keep[a + 1 + at] = True
            open_ += [(a, a + 1 + at), (a + 1 + at, b)]
    return points[keep]


def resampled(points: np.ndarray, step: float) -> np.ndarray:
    """Points at even distances of at most ``step`` along a line, both ends included."""
    at = np.concatenate(([0.0], np.cumsum(np.sqrt((np.diff(points, axis=0) ** 2).sum(axis=1)))))
    if at[-1] <= 0:
        return points
    even = np.linspace(0, at[-1], max(2, int(np.ceil(at[-1] / step)) + 1))
    return np.column_stack([np.interp(even, at, points[:, i]) for i in (0, 1)])


def smoothed(points: np.ndarray, inside: set[tuple[int, int]], pixel_m: float) -> np.ndarray:
    """A line of pixel centres, in pixels, made even: simplified, resampled, averaged over about 300 m, simplified again.

    A point that the average moves out of the mask (farther than one pixel
    from its nearest pixel centre, by rows or columns) stays where it was.
    """
    line = simplify(points, 3.0)
    step = max(2.0 * pixel_m, 50.0) / pixel_m
    line = resampled(line, step)
    radius = max(1, round(150.0 / (step * pixel_m)))
    n, sums = len(line), np.concatenate((np.zeros((1, 2)), np.cumsum(line, axis=0)))
    low, high = np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius + 1, n)
    mean = (sums[high] - sums[low]) / (high - low)[:, None]
    mean[[0, -1]] = line[[0, -1]]
    near = np.round(mean).astype(int)
    safe = [any((r + a, c + b) in inside for a in (-1, 0, 1) for b in (-1, 0, 1)) for r, c in near.tolist()]
    return simplify(np.where(np.array(safe)[:, None], mean, line), 1.5)


def smooth_lines(lines: DataFrame, mask: DataFrame, key: str, pixel_m: float = 25.0, kind: str = "long") -> DataFrame:
    """key, k, row, col (fractions of pixels): each centre line smoothed inside its mask."""

    def run(line: pd.DataFrame, pixels: pd.DataFrame) -> pd.DataFrame:
        if len(line) < 2:
            return pd.DataFrame({key: [], "k": [], "row": [], "col": []})
        inside = set(zip(pixels["row"].tolist(), pixels["col"].tolist(), strict=True))
        out = smoothed(line.sort_values("k")[["row", "col"]].to_numpy(float), inside, pixel_m)
        return pd.DataFrame({key: [line[key].iloc[0]] * len(out), "k": range(len(out)), "row": out[:, 0], "col": out[:, 1]})

    return lines.groupBy(key).cogroup(mask.select(key, F.col("row").cast("int"), F.col("col").cast("int")).groupBy(key)).applyInPandas(run, f"{key} {kind}, k long, row double, col double")


def segment_squares(points: DataFrame, key: str, order: str, length: float, context: float) -> DataFrame:
    """key, segment, x, y, side: for each piece of ``length`` of a line (the last one may be shorter) the square around its middle that reaches ``context`` beyond it.

    A step of the line makes the pieces whose middle falls on it, so steps and pieces are not joined. A piece's middle is at most half a length after its start.
    """
    steps = measured(points, key, order)
    total = steps.groupBy(F.col(key).alias("__key")).agg(F.max("d1").alias("__total"))
    last = F.greatest(F.lit(1), F.ceil(F.col("__total") / length)).cast("long") - 1
    low, high = F.greatest(F.floor(F.col("d0") / length - 0.5).cast("long"), F.lit(0)), F.least(F.ceil(F.col("d1") / length).cast("long"), last)
    on = steps.filter("d1 > d0").join(total, F.col(key) == F.col("__key")).filter(low <= high)
    cut = on.select(key, "d0", "d1", "x0", "y0", "x", "y", "__total", F.explode(F.sequence(low, high)).alias("segment"))
    end = F.least((F.col("segment") + 1) * length, "__total")
    cut = cut.withColumns({"__middle": (F.col("segment") * length + end) / 2, "__long": end - F.col("segment") * length}).filter("__middle >= d0 and __middle < d1")
    part = (F.col("__middle") - F.col("d0")) / (F.col("d1") - F.col("d0"))
    along = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * part
    return cut.select(key, "segment", along("x0", "x").alias("x"), along("y0", "y").alias("y"), (F.col("__long") + 2 * context).alias("side"))
