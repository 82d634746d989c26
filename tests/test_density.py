"""Density clustering against a whole-matrix version that condenses the tree from its top."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import density


def linkage(x, samples):
    """Edges of the tree by growing it from one point, shortest first."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(samples, len(x)) - 1]
    far = np.maximum(np.maximum(d, core[:, None]), core[None])
    inside, edges = {0}, []
    while len(inside) < len(x):
        w, a, b = min((far[i, j], i, j) for i in inside for j in range(len(x)) if j not in inside)
        inside.add(b)
        edges.append((w, min(a, b), max(a, b)))
    return d, sorted(edges)


def cluster_brute(x, least, samples):
    """Labels (None: noise) and memberships: the merge tree is walked from the top, clusters are chosen from below."""
    d, edges = linkage(x, samples)
    n = len(x)
    size, part, kids = dict.fromkeys(range(n), 1), list(range(n)), {}
    for k, (w, a, b) in enumerate(edges):
        pa, pb, new = part[a], part[b], n + k
        kids[new], size[new] = (pa, pb, w), size[pa] + size[pb]
        part = [new if p in (pa, pb) else p for p in part]

    def leaves(node):
        return [node] if node < n else leaves(kids[node][0]) + leaves(kids[node][1])

    clusters, out, falls = {0: (None, 0.0)}, [], []  # cluster: parent, density at birth; falls: (point, cluster, density)
    todo = [(n + len(edges) - 1, 0)]
    while todo:
        node, c = todo.pop()
        one, two, w = kids[node]
        lam = 1 / max(w, density.SHORTEST)
        big = [k for k in (one, two) if size[k] >= least]
        if len(big) == 2:
            for k in big:
                new = len(clusters)
                clusters[new] = (c, lam)
                out.append((c, lam, size[k]))
                todo.append((k, new))
        else:
            for k in (one, two):
                if k in big:
                    todo.append((k, c))
                else:
                    falls += [(p, c, lam) for p in leaves(k)]
    stability = {c: sum(lam - born for _, k, lam in falls if k == c) + sum((lam - born) * m for k, lam, m in out if k == c) for c, (_, born) in clusters.items()}
    chosen = dict.fromkeys(clusters, False)
    for c in sorted(clusters, reverse=True)[:-1]:
        below = sum(stability[k] for k, (up, _) in clusters.items() if up == c)
        chosen[c] = stability[c] >= below
        stability[c] = max(stability[c], below)
    top = {}
    for c in sorted(clusters):
        up = clusters[c][0]
        top[c] = top.get(up) if up is not None and top.get(up) is not None else (c if chosen[c] else None)
    most = {c: max([lam for _, k, lam in falls if k == c] + [lam for k, lam, _ in out if k == c], default=0) for c in clusters}
    labels, member = [None] * n, [None] * n
    for p, c, lam in falls:
        if top[c] is not None:
            labels[p], member[p] = top[c], min(lam, most[top[c]]) / most[top[c]]
    return d, labels, member


def silhouette_brute(d, labels):
    at = [i for i, c in enumerate(labels) if c is not None]
    names = {labels[i] for i in at}
    if len(names) < 2:
        return None
    out = []
    for i in at:
        own = [j for j in at if labels[j] == labels[i] and j != i]
        if not own:
            out.append(0.0)
            continue
        a = np.mean([d[i, j] for j in own])
        b = min(np.mean([d[i, j] for j in at if labels[j] == c]) for c in names - {labels[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def planted(seed, sizes, noise, dims=3):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(m, dims)) * rng.uniform(0.2, 1.0) + rng.uniform(-15, 15, dims) for m in sizes]
    return np.concatenate([*parts, rng.uniform(-20, 20, (noise, dims))])


GRID = [(5, None), (5, 1), (12, 2), (25, 5), (500, 3)]


@pytest.mark.parametrize(("seed", "sizes", "noise", "block", "stretch"), [(1, [40, 30, 25], 20, 40, 30), (2, [30, 9, 8], 10, 1000, 1000)])
def test_grid_equals_the_whole_matrix(spark, seed, sizes, noise, block, stretch):
    x = planted(seed, sizes, noise)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, None)], "id long, v array<double>").withColumns({"n": F.lit(1), "block": F.lit(1)})
    scores, labels = density.density_grid(vectors, "id", "v", GRID, block=block, stretch=stretch)
    rows = {r["combo"]: r for r in scores.collect()}
    got = {}
    for r in labels.collect():
        got.setdefault(r["combo"], {})[r["id"]] = (r["cluster"], r["membership"])
    for combo, (least, samples) in enumerate(GRID):
        d, wanted, member = cluster_brute(x, least, samples or least)
        mine = [got[combo][i][0] for i in range(len(x))]
        assert [c is None for c in mine] == [c is None for c in wanted]
        assert len({*zip(mine, wanted, strict=True)}) == len({*mine}) == len({*wanted})
        assert all(a is b is None or abs(a - b) < 1e-9 for a, b in zip((got[combo][i][1] for i in range(len(x))), member, strict=True))
        r, s = rows[combo], silhouette_brute(d, wanted)
        assert (r["clusters"], r["noise"]) == (len({*wanted} - {None}), wanted.count(None))
        assert r["silhouette"] is s is None or abs(r["silhouette"] - s) < 1e-9
        assert abs(r["score"] - (-1 if s is None else s * r["coverage"])) < 1e-9
    assert [r["selected"] for r in rows.values()].count(True) == 1
    best = max(rows.values(), key=lambda r: (r["score"], r["coverage"], r["clusters"], -r["min_cluster_size"], -r["combo"]))
    assert best["selected"] and best["clusters"] >= 2 * bool(sizes)


def test_copies_and_few_points(spark):
    for rows in ([], [(1, [0.0])], [(1, [0.0]), (2, [0.0])]):
        scores, labels = density.density_grid(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", [(2, 1)])
        assert labels.filter("cluster is not null").count() == 0 and scores.first()["score"] == -1
    rows = [(i, [float(i // 10)]) for i in range(30)]  # three groups of ten copies
    scores, _ = density.density_grid(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", [(5, 3)], block=7, stretch=8)
    assert (scores.first()["clusters"], scores.first()["noise"]) == (3, 0)


def test_no_point_looks_into_far_blocks(spark, monkeypatch):
    x = np.concatenate([np.random.default_rng(3).normal(size=(40, 3)) + at for at in (0.0, 1000.0)])
    points = density.along_curve(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "n long, x array<double>"), 20)
    box, came, plain = density.boxes(points, "block", "x"), [], density.meet
    blocks = {r["n"]: r["block"] for r in points.collect()}
    assert max(blocks.values()) == 3 and {i // 40 for i, b in blocks.items() if b < 2} in ({0}, {1})
    monkeypatch.setattr(density, "meet", lambda guests, *a: came.append(guests) or plain(guests, *a))
    got = {r["n"]: r["core"] for r in density.core_distances(points, box, [1, 4], 2).collect()}
    assert all(blocks[r["n"]] // 2 == r["to"] // 2 for r in came[0].collect())
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)
    assert all(abs(got[i][0]) < 1e-12 and abs(got[i][1] - d[i, 3]) < 1e-12 for i in range(80))


def tree_brute(x, samples):
    """The tree in the order (distance, smaller, larger number): a plain Kruskal over all pairs."""
    d = np.zeros((len(x), len(x)))
    for k in range(x.shape[1]):
        d += (x[:, None, k] - x[None, :, k]) ** 2
    d = np.sqrt(d)
    core = np.sort(d, axis=1)[:, samples - 1]
    far, part, out = np.maximum(np.maximum(d, core[:, None]), core[None]), np.arange(len(x)), set()
    a, b = np.triu_indices(len(x), 1)
    order = np.lexsort((b, a, far[a, b]))
    for i, j in zip(a[order], b[order], strict=True):
        if part[i] != part[j]:
            out.add((int(i), int(j), float(far[i, j])))
            part[part == part[j]] = part[i]
    return out


def test_lists_grow_trees_and_copies_are_leaves(spark, monkeypatch):
    for name, value in (("CHUNK", 60), ("LINKS", 1), ("WIDE", 25), ("SPAN", 20)):
        monkeypatch.setattr(density, name, value)
    rng = np.random.default_rng(5)
    cloud = planted(4, [60, 50], 40)
    x = np.concatenate([cloud, cloud[rng.integers(0, 150, 40)], np.repeat(cloud[:1], 30, axis=0), rng.integers(0, 3, (40, 3)) * 1000.0])[rng.permutation(260)]
    trees, tree = [], density.spanning_trees
    monkeypatch.setattr(density, "spanning_trees", lambda *a: trees.append(tree(*a)) or trees[0])
    grid = [(4, 1), (6, 3)]
    scores, labels = density.density_grid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", grid, block=20)
    rows = [tuple(r) for r in trees[0].select("setting", "a", "b", "distance").collect()]
    for s, (_, samples) in enumerate(grid):
        assert {r[1:] for r in rows if r[0] == s} == tree_brute(x, samples) and sum(r[0] == s for r in rows) == 259
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {(r["combo"], r["id"]): r["cluster"] for r in labels.collect()}
    for r in scores.collect():
        wanted = silhouette_brute(d, [got[r["combo"], i] for i in range(260)])
        assert abs(r["silhouette"] - wanted) < 1e-9


def test_a_cloud_needs_no_rounds_over_all_points(spark, monkeypatch):
    looked, plain = [], density.meet
    monkeypatch.setattr(density, "meet", lambda guests, *a: looked.append(guests) or plain(guests, *a))
    x = np.random.default_rng(8).normal(size=(300, 3))
    density.density_grid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", [(5, 2)], block=100)
    assert len(looked) <= 4  # once for lists, at most once for the tree, twice for silhouettes; before, once a round


def test_sums_of_distances_go_both_ways():
    rng = np.random.default_rng(2)
    a, b, p, q = rng.normal(size=(700, 3)) + 50, rng.normal(size=(300, 3)) + 50, rng.integers(1, 4, 700).astype(float), rng.integers(1, 4, 300).astype(float)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    to_a, to_b = density.sums(a, b, p, q)
    assert np.allclose(to_a, d @ q, rtol=1e-12) and np.allclose(to_b, p @ d, rtol=1e-12)
