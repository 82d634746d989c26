"""Centre lines, localised changes and clipped mosaics, against loops over pixels."""

import heapq
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldlens.operators import centreline, localise, mosaic
from fieldlens.operators.centreline import AROUND
from fieldlens.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def thin_loop(pixels):
    """Thinning pixel by pixel: each half pass marks first, then removes."""
    pixels = set(pixels)
    while True:
        before = len(pixels)
        for half in (0, 1):
            gone = []
            for r, c in pixels:
                n = [(r + a, c + b) in pixels for a, b in AROUND]
                up, right, down, left = n[0], n[2], n[4], n[6]
                runs = sum(not n[i] and n[(i + 1) % 8] for i in range(8))
                held = [(up, right, down), (right, down, left)] if half == 0 else [(up, right, left), (up, down, left)]
                if 2 <= sum(n) <= 6 and runs == 1 and not any(all(h) for h in held):
                    gone.append((r, c))
            pixels -= set(gone)
        if len(pixels) == before:
            return pixels


def parts_of(pixels, around=AROUND):
    left, out = set(pixels), []
    while left:
        stack = [min(left)]
        part = set(stack)
        while stack:
            r, c = stack.pop()
            for a, b in around:
                p = (r + a, c + b)
                if p in left and p not in part:
                    part.add(p)
                    stack.append(p)
        out.append(part)
        left -= part
    return out


def path_loop(pixels):
    """Dijkstra with a heap, twice, over the largest part."""
    if not pixels:
        return []
    part = max(parts_of(pixels), key=len)  # the first of equally large ones

    def distances(start):
        d, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            far, (r, c) = heapq.heappop(heap)
            if far > d[r, c]:
                continue
            for a, b in AROUND:
                p, step = (r + a, c + b), round(far + (2**0.5 if a and b else 1.0), 9)
                if p in part and step < d.get(p, np.inf):
                    d[p] = step
                    heapq.heappush(heap, (step, p))
        return d

    far = lambda d: min(d, key=lambda p: (-d[p], p))
    first = far(distances(min(part)))
    d = distances(first)
    path = [far(d)]
    while path[-1] != first:
        r, c = path[-1]
        path.append(min((r + a, c + b) for a, b in AROUND if (r + a, c + b) in d and abs(d[r + a, c + b] + (2**0.5 if a and b else 1.0) - d[r, c]) < 1e-6))
    return path[::-1] if len(path) > 1 else []


def masks(spark, figures):
    rows = [(k, r, c) for k, pixels in enumerate(figures) for r, c in pixels]
    return spark.createDataFrame(rows, "tile long, row int, col int")


BAR = {(r, c) for r in range(3) for c in range(10)}
RING = {(r, c) for r in range(9) for c in range(9) if not (3 <= r <= 5 and 3 <= c <= 5)}
Y = {(i, i) for i in range(5)} | {(i, 9 - i) for i in range(5)} | {(r, 4) for r in range(5, 12)}
DIAGONAL = {(i, i + j) for i in range(12) for j in range(3)}


def test_centre_lines_of_known_figures(spark):
    got = defaultdict(list)
    for r in centreline.centre_lines(masks(spark, [BAR, Y, {(i, 3) for i in range(4)}, {(0, 0)}]), "tile").orderBy("tile", "k").collect():
        got[r["tile"]].append((r["row"], r["col"]))
    assert {r for r, _ in got[0]} == {1} and len(got[0]) >= 7  # along the middle of the bar
    assert sorted([got[1][0], got[1][-1]]) == [(0, 0), (11, 4)] or sorted([got[1][0], got[1][-1]]) == [(0, 9), (11, 4)]
    assert sorted(got[2]) == [(i, 3) for i in range(4)] and 3 not in got


def test_centre_lines_equal_the_loop(spark):
    rng = random.Random(9)
    figures = [BAR, RING, Y, DIAGONAL, set(), {(5, 5)}]
    for _ in range(40):
        blob = set()
        for _ in range(rng.randint(1, 6)):
            r, c, h, w = (rng.randint(0, 14) for _ in range(4))
            blob |= {(a, b) for a in range(r, r + h // 2 + 1) for b in range(c, c + w + 1)}
        figures.append(blob - {(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(8)})
    got = defaultdict(list)
    for r in centreline.centre_lines(masks(spark, figures), "tile").orderBy("tile", "k").collect():
        got[r["tile"]].append((r["row"], r["col"]))
    for k, pixels in enumerate(figures):
        assert got[k] == path_loop(thin_loop(pixels))


def test_centre_lines_of_the_table(spark):
    from fieldlens.queries.rasters import mask

    figures = defaultdict(set)
    for r in mask(spark, FOLDER).collect():
        figures[r["tile"]].add((r["row"], r["col"]))
    got = defaultdict(list)
    for r in QUERIES["q_centre_lines"](spark, FOLDER).orderBy("tile", "k").collect():
        got[r["tile"]].append((r["row"], r["col"]))
    assert got and dict(got) == {k: path for k, p in figures.items() if (path := path_loop(thin_loop(p)))}


def farthest_from(line, p):
    best = np.inf
    for a, b in zip(line[:-1], line[1:], strict=True):
        a, b, p = np.array(a, float), np.array(b, float), np.array(p, float)
        t = np.clip((p - a) @ (b - a) / max((b - a) @ (b - a), 1e-12), 0, 1)
        best = min(best, float(np.linalg.norm(p - a - t * (b - a))))
    return best


def test_simplified_lines_stay_near():
    rng = random.Random(3)
    for _ in range(60):
        line = np.cumsum([[rng.uniform(-1, 2), rng.uniform(-2, 2)] for _ in range(rng.randint(2, 40))], axis=0)
        out = centreline.simplify(line, 1.5)
        assert (out[0] == line[0]).all() and (out[-1] == line[-1]).all()
        assert len(out) < 2 or max(farthest_from(out, p) for p in line) <= 1.5 + 1e-9
        even = centreline.resampled(line, 0.7)
        gaps = np.linalg.norm(np.diff(even, axis=0), axis=1)
        assert np.allclose(even[[0, -1]], line[[0, -1]]) and gaps.max() <= 0.7 + 1e-9


def test_smooth_lines_stay_in_their_mask(spark):
    figures = [BAR, RING, DIAGONAL, {(r, c) for r in range(40) for c in range(40) if r < 4 or c < 4}]
    m = masks(spark, figures)
    lines = defaultdict(list)
    for r in centreline.smooth_lines(centreline.centre_lines(m, "tile"), m, "tile").orderBy("tile", "k").collect():
        lines[r["tile"]].append((r["row"], r["col"]))
    ends = defaultdict(list)
    for r in centreline.centre_lines(m, "tile").orderBy("tile", "k").collect():
        ends[r["tile"]].append((r["row"], r["col"]))
    assert set(lines) == set(ends)
    for k, line in lines.items():
        assert line[0] == ends[k][0] and line[-1] == ends[k][-1]
        assert all(min(max(abs(r - a), abs(c - b)) for a, b in figures[k]) <= 1.5 for r, c in line)


def reflect(i, n):
    while not 0 <= i < n:
        i = -1 - i if i < 0 else 2 * n - 1 - i
    return i


def gauss_loop(image, sigma):
    w = localise.gaussian_weights(sigma)
    r, (h, n) = len(w) // 2, image.shape
    out = np.array([[sum(w[k + r] * image[i, reflect(j + k, n)] for k in range(-r, r + 1)) for j in range(n)] for i in range(h)])
    return np.array([[sum(w[k + r] * out[reflect(i + k, h), j] for k in range(-r, r + 1)) for j in range(n)] for i in range(h)])


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (5, 30), (15, 4)])
def test_gaussian_filter_equals_the_loop(spark, shape):
    image = np.random.default_rng(1).normal(size=shape)
    rows = [(7, i + 3, j - 2, float(image[i, j])) for i in range(shape[0]) for j in range(shape[1])]
    got = localise.gaussian_smooth(spark.createDataFrame(rows, "tile long, row int, col int, v double"), "tile", "v", 1.5).collect()
    wanted = gauss_loop(image, 1.5)
    assert len(got) == image.size and all(abs(r["v"] - wanted[r["row"] - 3, r["col"] + 2]) < 1e-9 for r in got)


def test_missing_pixels_make_those_in_reach_null(spark):
    rows = [(1, i, j, None if (i, j) == (0, 0) else 1.0) for i in range(20) for j in range(20)]
    got = {(r["row"], r["col"]): r["v"] for r in localise.gaussian_smooth(spark.createDataFrame(rows, "tile long, row int, col int, v double"), "tile", "v", 1.5).collect()}
    assert got[6, 6] is None and got[0, 6] is None and abs(got[7, 6] - 1) < 1e-9 and abs(got[19, 19] - 1) < 1e-9


def winding(rings, x, y):
    """Even-odd rule over all edges: inside if an odd number of edges crosses the row to the left of the point."""
    hits = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if min(ay, by) <= y < max(ay, by) and ax + (y - ay) * (bx - ax) / (by - ay) <= x:
                hits += 1
    return hits % 2 == 1


def test_runs_equal_the_even_odd_rule(spark):
    rng = random.Random(8)
    figures = [[[(rng.uniform(-70, 140), rng.choice([rng.uniform(-5, 30), rng.randint(0, 20) + 0.5])) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 3))] for _ in range(20)]
    rings = spark.createDataFrame([(i, r, k, float(x), float(y)) for i, f in enumerate(figures) for r, ring in enumerate(f) for k, (x, y) in enumerate(ring)], "id long, ring int, k int, x double, y double")
    grid = spark.createDataFrame([(r, c) for r in range(-6, 31) for c in range(-72, 142)], "row int, col int")
    got = defaultdict(set)
    for r in mosaic.clip(grid, mosaic.row_runs(rings, "id"), "id").collect():
        got[r["id"]].add((r["row"], r["col"]))
    for i, f in enumerate(figures):
        assert got[i] == {(r, c) for r in range(-6, 31) for c in range(-72, 142) if winding(f, c + 0.5, r + 0.5)}


def test_first_tile_with_a_value_wins_and_old_years_are_zero(spark):
    rows = [("b", 0, 0, 9), ("a", 0, 0, 0), ("c", 0, 0, 20), ("a", 0, 1, 4), ("b", 0, 1, 20), ("a", 0, 2, 0), ("b", 0, 3, None), ("b", 0, 3, 99)]
    merged = mosaic.merge_tiles(spark.createDataFrame(rows, "tile string, row int, col int, code int"), "tile", "code")
    assert {r["col"]: r["code"] for r in merged.collect()} == {0: 9, 1: 4, 2: 0, 3: 99}
    assert {r["col"]: r["code"] for r in mosaic.recent(merged, "code", 2005, 30).collect()} == {0: 9, 1: 0, 2: 0, 3: 0}


def test_nearest_resampling_asks_the_source_cell(spark):
    pixels = spark.createDataFrame([(1, r, c, 10 * r + c) for r in range(4) for c in range(5)], "tile long, row int, col int, v int")
    got = {(r["row"], r["col"]): r["v"] for r in mosaic.nearest(pixels, "tile", "v", (10.0, 0, 100.0, 0, -10.0, 200.0), (5.0, 0, 95.0, 0, -5.0, 200.0), (9, 11)).collect()}
    assert len(got) == 99
    for (r, c), v in got.items():
        x, y = 95 + 5 * (c + 0.5), 200 - 5 * (r + 0.5)
        sr, sc = int((200 - y) // 10), int((x - 100) // 10)
        assert v == (10 * sr + sc if 0 <= sr < 4 and 0 <= sc < 5 else None)
    with pytest.raises(ValueError, match="area"):
        mosaic.nearest(pixels, "tile", "v", (1, 1, 0, 1, 1, 0), (1, 0, 0, 0, 1, 0), (1, 1))


def test_localised_changes_equal_the_loop(spark):
    from fieldlens.queries.rasters import mask
    from fieldlens.queries.shapes import change_map

    maps, marks = defaultdict(dict), defaultdict(set)
    for r in change_map(spark, FOLDER).collect():
        maps[r["tile"]][r["row"], r["col"]] = r["v"]
    for r in mask(spark, FOLDER).collect():
        marks[r["tile"]].add((r["row"], r["col"]))
    wanted = []
    for tile, values in maps.items():
        smooth = gauss_loop(np.array([[values[i, j] for j in range(20)] for i in range(20)]), 1.5)
        wide = {(r + a, c + b) for r, c in marks[tile] for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) <= 2}
        for part in parts_of({(i, j) for i in range(20) for j in range(20) if smooth[i, j] < -0.09}):
            if len(part) < 5:
                continue
            share = len(part & wide) / len(part)
            box = np.prod([max(p[i] for p in part) - min(p[i] for p in part) + 1 for i in (0, 1)])
            wanted.append((tile, len(part), round(float(np.median([values[p] for p in part])), 6), round(share, 3), share >= 0.3, round(len(part) / int(box), 3)))
    found = localise.changes(change_map(spark, FOLDER), mask(spark, FOLDER), "tile", "v", threshold=-0.09, least_pixels=5)
    got = [(r["tile"], r["pixels"], r["median_value"], r["overlap"], r["matched"], r["rectangularity"]) for r in found.collect()]
    assert len(got) == len(wanted) > 10
    for a, b in zip(sorted(got), sorted(wanted), strict=True):
        assert a == pytest.approx(b, abs=1.01e-3)  # the two round halves apart
    per = {r["tile"]: (r["components"], r["matched"]) for r in localise.change_summary(found, "tile").collect()}
    assert per == {t: (n, sum(w[4] for w in wanted if w[0] == t)) for t, n in Counter(w[0] for w in wanted).items()}


def test_segment_squares_equal_the_loop_without_meeting_all_steps(spark):
    rng = random.Random(8)
    rows = [(line, i, rng.uniform(0, 400) * (line != 3), i * 3.0 * (line != 3)) for line in range(5) for i in range(1 if line == 4 else 40)]
    got = centreline.segment_squares(spark.createDataFrame(rows, "line int, i int, x double, y double"), "line", "i", 70.0, 10.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in x and "middle" in x for x in plan.splitlines())
    wanted = {}
    for line in range(5):
        points = [r[2:] for r in rows if r[0] == line]
        at = np.concatenate(([0.0], np.cumsum([math.dist(p, q) for p, q in zip(points, points[1:])])))
        total = at[-1]
        for s in range(max(1, math.ceil(total / 70.0)) if total > 0 else 0):
            end = min((s + 1) * 70.0, total)
            wanted[line, s] = (*(np.interp((s * 70.0 + end) / 2, at, [p[j] for p in points]) for j in (0, 1)), end - s * 70.0 + 20.0)
    found = {(r["line"], r["segment"]): (r["x"], r["y"], r["side"]) for r in got.collect()}
    assert found.keys() == wanted.keys() and all(np.allclose(found[k], wanted[k]) for k in wanted)
