"""Density clustering: a tree over mutual reachability, condensed to clusters of a least size, and a grid of settings.

The distance of two points is at least each one's distance to its
``min_samples``-th neighbour, itself included. A minimum spanning tree of all
points grows in rounds: every part finds its nearest other part. Then its
edges, from the shortest, merge parts; a part of ``min_cluster_size`` points is a
cluster, and a merge of two clusters ends both and begins one. A cluster's
stability is what its points' densities, one over the distance at which they
leave it, exceed its own at birth. Clusters stand that are more stable than those
within them together; points outside are noise.

Points lie in blocks along a space-filling curve, and a block's box bounds how
near its points can be. A point looks in its own block first; what it finds there
bounds what it still looks for, and only blocks whose boxes are that near are
looked into. So every point lists its nearest neighbours once. Parts grow from these
lists as long as a part's shortest edge is shorter than what its points list, first
within stretches of blocks, then between them, from what is left; what lists can't
decide, as between clusters far apart, is looked for in blocks again. Copies of a
point are listed as one, with their number, and join the tree as leaves. Bounds
only spare looks, so tree and scores are those
of all pairs. Merges go through tasks in stretches of the sorted edges, with the
state of the parts they touch, so no task holds all points or all edges. All
settings of a grid go through the same jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.plans.lineage import rewritten
from fieldlens.plans.prefix import running_totals

#: Points of a block, edges that a task merges at once, and the shortest distance that counts (copies are that far apart).
BLOCK, STRETCH, SHORTEST = 1000, 200_000, 1e-12
#: Guests of a block that come at once.
GUESTS = 20_000
#: Neighbours that a point lists at least, points whose lists grow parts in a task at first, and links that a task takes later.
LISTED, CHUNK, LINKS = 16, 16_000, 1_000_000
#: Different points of a cluster from which on it meets points in stretches of so many, not block by block.
WIDE, SPAN = 4_000, 16_000


def along_curve(points: DataFrame, block: int) -> DataFrame:
    """The points (n, x) with their block: each has as many points that follow each other on a Morton curve."""
    first = points.select(F.size("x").alias("dims")).first()
    dims = min(first["dims"], 20) if first else 0
    if not dims:
        return points.withColumn("block", F.lit(0))
    ends = points.agg(*(f(F.get("x", F.lit(k))).alias(f"{name}{k}") for k in range(dims) for name, f in (("lo", F.min), ("hi", F.max)))).first()
    lo, hi = (np.array([ends[f"{name}{k}"] for k in range(dims)]) for name in ("lo", "hi"))
    bits = 60 // dims

    @F.pandas_udf("long")
    def code(x: pd.Series) -> pd.Series:
        at = np.nan_to_num((_matrix(x)[:, :dims] - lo) / np.where(hi > lo, hi - lo, 1.0))
        cell = np.minimum(at * 2.0**bits, 2.0**bits - 1).astype(np.int64)
        return pd.Series(sum(((cell[:, k] >> j) & 1) << (j * dims + k) for k in range(dims) for j in range(bits)), dtype="int64")

    placed = rewritten(points.withColumns({"order": F.struct(code("x").alias("code"), "n"), "one": F.lit(1)}))
    return running_totals(placed, "order", {"i": "one"}).withColumn("block", F.floor((F.col("i") - 1) / block).cast("int")).drop("order", "one", "i")


def gap(lo: str, hi: str, low: str, high: str) -> Column:
    """Least distance of two boxes; rounded no higher than that of any two points in them."""
    sides = F.zip_with(F.zip_with(low, hi, lambda p, q: p - q), F.zip_with(lo, high, lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.sqrt(F.aggregate(sides, F.lit(0.0), lambda total, t: total + t * t))


def reach(lo: str, hi: str, low: str, high: str) -> Column:
    """Greatest distance of two boxes' points; rounded no lower than that of any two points in them."""
    sides = F.zip_with(F.zip_with(high, lo, lambda p, q: p - q), F.zip_with(hi, low, lambda p, q: p - q), lambda p, q: F.greatest(p, q))
    return F.sqrt(F.aggregate(sides, F.lit(0.0), lambda total, t: total + t * t)) * (1 + 1e-9)


def boxes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, lo, hi: the box of each block's vectors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf[vector])
        return pd.DataFrame({key: pdf[key].iloc[:1], "lo": [x.min(axis=0).tolist()], "hi": [x.max(axis=0).tolist()]})

    return rows.select(key, vector).groupBy(key).applyInPandas(run, f"{key} int, lo array<double>, hi array<double>")


def meet(guests: DataFrame, hosts: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, tasks: int) -> DataFrame:
    """What ``run`` makes of the guests (to, n, ...) of each block of hosts (to, ...); very many guests come in several turns.

    Rows are few for the work they make, so the number of tasks is given, not taken from their size.
    """
    came = rewritten(guests)
    turns = rewritten(came.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / GUESTS).alias("turns")).withColumnRenamed("to", "__to"))
    there = came.join(turns, F.col("to") == F.col("__to")).withColumn("turn", F.pmod(F.xxhash64("n"), "turns").cast("long")).drop("__to", "turns")
    here = hosts.join(turns, F.col("to") == F.col("__to")).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).drop("__to", "turns")
    there, here = (rows.repartition(tasks, "to", "turn").groupBy("to", "turn") for rows in (there, here))
    return there.cogroup(here).applyInPandas(run, schema)


def distances(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of stretches of rows of a to all rows of b, with the first row's place; equal both ways to the last bit."""
    step = max(1, (1 << 17) // max(len(b), 1))
    for i in range(0, len(a), step):
        d = np.zeros((len(a[i : i + step]), len(b)))
        for k in range(b.shape[1]):
            t = a[i : i + step, k, None] - b[None, :, k]
            t *= t
            d += t
        yield i, np.sqrt(d, out=d)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _frame(parts: list[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    return pd.concat(parts) if parts else pd.DataFrame(columns=columns, dtype=object)  # objects become any type


def core_distances(points: DataFrame, box: DataFrame, samples: list[int], tasks: int) -> DataFrame:
    """n, core, near, listed: for each entry of ``samples`` the distance to the point's neighbour of that number, itself being the first; its nearest others (d, to, m) and how near all others are listed.

    A point of several copies has their number as ``m``.
    """
    if "m" not in points.columns:
        points = points.withColumn("m", F.lit(1))
    most = max(LISTED, *samples)

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            na, nb, mb, bound = a["n"].to_numpy(), b["n"].to_numpy(), b["m"].to_numpy(), a["bound"].to_numpy() if "bound" in a else np.full(len(a), np.inf)
            for i, d in distances(_matrix(a["x"]), _matrix(b["x"])):
                d[na[i : i + len(d), None] == nb[None]] = np.inf
                d[d >= bound[i : i + len(d), None]] = np.inf
                many = np.flatnonzero((d < np.inf).sum(axis=1) > most)
                if len(many):
                    far = np.argpartition(d[many], most - 1, axis=1)[:, most:]
                    d[many[:, None], far] = np.inf
                r, c = np.nonzero(d < np.inf)
                out.append(pd.DataFrame({"n": na[i + r], "d": d[r, c], "to": nb[c], "m": mb[c]}))
        return _frame(out, ["n", "d", "to", "m"])

    schema = "n long, d double, to long, m long"
    lists = lambda found: points.select("n").join(found.groupBy("n").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "to", "m"))), 1, most).alias("near")), "n", "left").select("n", F.coalesce("near", F.array().cast("array<struct<d:double,to:long,m:long>>")).alias("near"))
    found = rewritten(points.select("n", "x", "m", "block").repartition(tasks, "block").groupBy("block").applyInPandas(lambda pdf: nearest(pdf, pdf), schema))
    own = lists(found)
    # only what is nearer than the last one found in the own block can change it
    last = F.coalesce(F.get("near", F.lit(most - 1))["d"], F.lit(float("inf")))
    bounded = rewritten(points.select("n", "x", "block").join(own.select("n", last.alias("bound")), "n").repartition(tasks, "block"))
    looks = bounded.groupBy("block").agg(F.max("bound").alias("bound")).join(box, "block").select(F.col("block").alias("from"), "bound", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    ways = looks.join(F.broadcast(box.withColumnRenamed("block", "to")), (F.col("from") != F.col("to")) & (gap("__lo", "__hi", "lo", "hi") < F.col("bound")))  # one row a block
    ways = rewritten(ways.select("from", "to", "lo", "hi"))
    guests = bounded.join(ways, F.col("block") == F.col("from")).filter(gap("x", "x", "lo", "hi") < F.col("bound")).select("to", "n", "x", "bound")
    hosts = points.select(F.col("block").alias("to"), "n", "x", "m")
    merged = lists(found.unionByName(meet(guests, hosts, nearest, schema, tasks)))
    merged = merged.join(points.select("n", F.col("m").alias("__m")), "n")

    def core(k: int) -> Column:
        start = F.struct(F.col("__m").cast("long").alias("seen"), F.lit(0.0).alias("d"))
        return F.aggregate("near", start, lambda now, e: F.when(now["seen"] >= k, now).otherwise(F.struct((now["seen"] + e["m"]).alias("seen"), e["d"].alias("d"))))["d"]

    return merged.select("n", F.array(*(core(k) for k in samples)).alias("core"), "near", last.alias("listed"))


def grow(ids: np.ndarray, listed: np.ndarray, links: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, pd.DataFrame, pd.DataFrame]:
    """Parts grown from links (part, to, distance, a, b): each part's number of ``ids``, how near its points list all others, tree edges found, and links left.

    A part's shortest link is an edge of the tree if it is shorter than what
    all of its points list, for then no other edge of them is as short. Parts
    whose shortest link goes to none of ``ids`` wait.
    """
    order = np.argsort(ids)
    names = ids[order]

    def place(of: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(names, of), len(names) - 1)
        return np.where(names[at] == of, order[at], -1)

    links = links.sort_values(["distance", "a", "b"])
    start, end, w, row = place(links["part"].to_numpy()), place(links["to"].to_numpy()), links["distance"].to_numpy(), np.arange(len(links))
    part, near, found = np.arange(len(ids)), listed.copy(), []
    while True:
        f, t = part[start], np.where(end >= 0, part[end], -1)
        kept = (f != t) & (w < near[f])
        start, end, w, row, f, t = start[kept], end[kept], w[kept], row[kept], f[kept], t[kept]
        first = np.full(len(ids), -1)
        first[f[::-1]] = np.arange(len(f))[::-1]
        chosen = first[first >= 0]
        chosen = chosen[t[chosen] >= 0]
        if not len(chosen):
            break
        found.append(row[chosen])
        up = np.arange(len(ids))
        up[f[chosen]] = t[chosen]
        back = (up[up] == np.arange(len(ids))) & (np.arange(len(ids)) < up)
        up[back] = np.flatnonzero(back)
        while (up[up] != up).any():
            up = up[up]
        part = up[part]
        near = np.full(len(ids), np.inf)
        np.minimum.at(near, part, listed)
    edges = links.iloc[np.concatenate(found) if found else []][["distance", "a", "b"]].drop_duplicates(["a", "b"])
    return ids[part], near[part], edges, links.iloc[row].assign(part=ids[part[start]])[["part", "distance", "a", "b"]]


_GROWN = "setting int, kind string, id long, part long, distance double, a long, b long"


def _grown(setting: int, ids: np.ndarray, listed: np.ndarray, links: pd.DataFrame) -> list[pd.DataFrame]:
    parts, near, edges, left = grow(ids, listed, links)
    rows = [pd.DataFrame({"kind": "part", "id": ids, "part": parts, "distance": near}), edges.assign(kind="edge"), left.assign(kind="link")]
    return [r.assign(setting=setting).reindex(columns=["setting", "kind", "id", "part", "distance", "a", "b"]).astype({"id": "Int64", "part": "Int64", "a": "Int64", "b": "Int64"}) for r in rows if len(r)]


def listed_trees(points: DataFrame, settings: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(edges, parts): edges (setting, a, b, distance) of the minimum spanning trees that the points' lists decide, and the part (setting, n, part) that each point is in by them."""
    wide = max(1, CHUNK // block)
    chunk = F.floor(F.col("block") / wide).cast("int")
    cores = [F.col("core")[s].alias(f"c{s}") for s in range(settings)]
    there = points.select(F.col("n").alias("to"), *cores)
    links = points.select("n", chunk.alias("chunk"), F.col("core").alias("own"), "listed", F.explode("near").alias("e")).select("n", "chunk", "own", "listed", F.col("e.d").alias("d"), F.col("e.to").alias("to")).join(there, "to")
    far = [F.greatest("d", F.col("own")[s], f"c{s}") for s in range(settings)]
    links = links.filter(F.least(*far, F.lit(float("inf"))) < F.col("listed")).select("chunk", "n", "to", *(w.alias(f"w{s}") for s, w in enumerate(far)))

    def begin(here: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        out, ids, listed = [], here["n"].to_numpy(), here["listed"].to_numpy()
        n, to = links["n"].to_numpy(), links["to"].to_numpy()
        for s in range(settings):
            out += _grown(s, ids, listed, pd.DataFrame({"part": n, "to": to, "distance": links[f"w{s}"].to_numpy(), "a": np.minimum(n, to), "b": np.maximum(n, to)}))
        return pd.concat(out)

    def again(key: tuple, here: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_grown(int(key[0]), here["id"].to_numpy(), here["listed"].to_numpy(), links))

    homes = rewritten(points.select("n", chunk.alias("chunk"), "listed"))
    chunks = homes.agg(F.max("chunk")).first()[0] + 1
    lists = [rows.repartition(chunks, "chunk").groupBy("chunk") for rows in (homes, links)]
    grown = rewritten(lists[0].cogroup(lists[1]).applyInPandas(begin, _GROWN))
    edges = grown.filter("kind = 'edge'").select("setting", "a", "b", "distance")
    parts = grown.filter("kind = 'part'").join(homes.select(F.col("n").alias("id"), "chunk"), "id").select("setting", F.col("id").alias("n"), "part", F.col("distance").alias("listed"), "chunk")
    groups = chunks
    while groups > 1:
        links = grown.filter("kind = 'link'").select("setting", "part", "distance", "a", "b")
        groups = max(1, min(groups // 2, -(-links.count() // (LINKS * settings))))
        group = F.floor(F.col("chunk") * groups / chunks).cast("int")
        # links lead to points; the parts at both ends are those by now
        parts = rewritten(parts)
        at = [parts.select(F.col("setting").alias("__s"), F.col("n").alias(f"__{end}"), F.col("part").alias(f"p_{end}")) for end in ("a", "b")]
        links = links.join(at[0], (F.col("setting") == F.col("__s")) & (F.col("a") == F.col("__a"))).drop("__s").join(at[1], (F.col("setting") == F.col("__s")) & (F.col("b") == F.col("__b")))
        links = links.withColumn("to", F.when(F.col("p_a") == F.col("part"), F.col("p_b")).otherwise(F.col("p_a")))
        nodes = rewritten(parts.filter("n = part").select("setting", F.col("part").alias("id"), "listed", group.alias("group")))
        links = links.join(nodes.select(F.col("setting").alias("__s2"), "id", "group"), (F.col("setting") == F.col("__s2")) & (F.col("part") == F.col("id"))).select("setting", "group", "part", "to", "distance", "a", "b")
        # parts without links take no part unless a link leads to them
        linked = rewritten(links)
        asked = linked.select("setting", F.col("part").alias("id")).union(linked.select("setting", F.col("to").alias("id"))).distinct()
        nodes = nodes.join(asked, ["setting", "id"])
        grown = rewritten(nodes.groupBy("setting", "group").cogroup(linked.groupBy("setting", "group")).applyInPandas(again, _GROWN))
        edges = rewritten(edges.unionByName(grown.filter("kind = 'edge'").select("setting", "a", "b", "distance")))
        now = grown.filter("kind = 'part'").select(F.col("setting").alias("__s"), F.col("id").alias("__id"), F.col("part").alias("now"), F.col("distance").alias("near"))
        parts = parts.join(now, (F.col("setting") == F.col("__s")) & (F.col("part") == F.col("__id")), "left").select("setting", "n", F.coalesce("now", "part").alias("part"), F.coalesce("near", "listed").alias("listed"), "chunk")
    return edges, rewritten(parts.select("setting", "n", "part"))


def copies(points: DataFrame, apart: DataFrame, settings: int) -> tuple[DataFrame, DataFrame]:
    """(edges, late): the edge (setting, n, first, a, b, distance) of each further copy n, and the copies (n, first) that lack one.

    All edges of a copy are as long as those of the first one and none goes
    before it, but that to the first itself; so a copy is a leaf, on the smallest number
    that is as near as its core. Where lists end at that distance a smaller one may be unlisted.
    """
    twins = rewritten(points.filter("n != first").select("n", "first"))
    if twins.isEmpty():
        return twins.select(F.lit(0).alias("setting"), "n", "first", F.col("n").alias("a"), F.col("n").alias("b"), F.lit(0.0).alias("distance")), twins
    several = apart.filter("m > 1").select("n", "core", "listed", F.explode_outer("near").alias("e")).select("n", "core", "listed", F.col("e.d").alias("d"), F.col("e.to").alias("to"))
    several = several.join(apart.select(F.col("n").alias("to"), F.col("core").alias("other")), "to", "left")
    each = several.select("n", "to", F.explode(F.array(*(F.struct(F.lit(s).alias("setting"), F.col("core")[s].alias("core"), ((F.col("d") <= F.col("core")[s]) & (F.col("other")[s] <= F.col("core")[s])).alias("on"), (F.col("listed") > F.col("core")[s]).alias("sure")) for s in range(settings)))).alias("s"))
    ends = each.groupBy("n", "s.setting", "s.core", "s.sure").agg(F.min(F.when(F.col("s.on"), F.col("to"))).alias("to"))
    ends = rewritten(ends.select(F.col("n").alias("first"), "setting", "core", "sure", F.least("n", "to").alias("end")))
    found = twins.join(ends.filter("sure"), "first").select("setting", "n", "first", F.least("n", "end").alias("a"), F.greatest("n", "end").alias("b"), F.col("core").alias("distance"))
    return found, twins.join(ends.filter("not sure").select("first").distinct(), "first").select("n", "first")


def _roots(ways: DataFrame) -> DataFrame:
    """id, root of (id, up): every id goes on to its up. All ways end in two that go to each other, the smaller of which is the root, or in one that goes to itself; steps double."""
    now = rewritten(ways)
    back = now.select(F.col("id").alias("__id"), F.col("up").alias("__up"))
    end = F.when((F.col("__up") == F.col("id")) & (F.col("id") < F.col("up")), F.col("id")).otherwise(F.col("up"))
    now = rewritten(now.join(back, F.col("up") == F.col("__id")).select("id", end.alias("up")))
    while True:
        on = now.select(F.col("id").alias("__id"), F.col("up").alias("__up"))
        step = rewritten(now.join(on, F.col("up") == F.col("__id")).select("id", F.col("__up").alias("up"), (F.col("up") != F.col("__up")).alias("moved")))
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now.withColumnRenamed("up", "root")


def spanning_trees(points: DataFrame, box: DataFrame, count: int, settings: int, tasks: int, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """setting, a, b, distance: the minimum spanning tree by each setting's core distances, from the edges found and the parts (setting, n, part) they make. Of equally long edges the one with the smaller numbers goes first."""
    labels = rewritten(parts.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("setting", "part"))).alias("p")).select("n", F.col("p.part").alias("part")))
    schema = "setting int, part long, distance double, a long, b long"

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            na, nb, ca, cb, pa, pb = a["n"].to_numpy(), b["n"].to_numpy(), _matrix(a["core"]), _matrix(b["core"]), _matrix(a["part"]).astype(int), _matrix(b["part"]).astype(int)
            looks = _matrix(a["looks"]).astype(bool) if "looks" in a else np.ones(pa.shape, bool)
            looks &= (pa != np.array(great)) & ((pa != pb[0]) | (pb != pb[0]).any(axis=0))  # not where all of b is of the own part
            some = looks.any(axis=1)
            na, ca, pa, looks = na[some], ca[some], pa[some], looks[some]
            for i, d in distances(_matrix(a["x"])[some], _matrix(b["x"])):
                for s in range(settings):
                    at = np.flatnonzero(looks[i : i + len(d), s])
                    if not len(at):
                        continue
                    here, part = na[i + at], pa[i + at, s]
                    far = np.maximum(np.maximum(d[at], ca[i + at, s, None]), cb[None, :, s])
                    far[part[:, None] == pb[None, :, s]] = np.inf
                    least = far.min(axis=1)
                    # of equally near points the one with the smallest number, and so the smallest edge of this point
                    to = np.where(far == least[:, None], nb[None], np.iinfo(np.int64).max).min(axis=1)
                    known = np.isfinite(least)
                    here, to = here[known], to[known]
                    best = pd.DataFrame({"setting": s, "part": part[known], "distance": least[known], "a": np.minimum(here, to), "b": np.maximum(here, to)})
                    out.append(best.sort_values(["part", "distance", "a", "b"]).drop_duplicates("part"))
        return _frame(out, ["setting", "part", "distance", "a", "b"])

    numbers = [F.lit(s) for s in range(settings)]
    while True:
        # the greatest part of a setting waits for the others' edges
        sizes = labels.select(F.posexplode("part").alias("s", "part")).groupBy("s", "part").agg(F.count(F.lit(1)).alias("size"))
        rows = {r["s"]: r for r in sizes.groupBy("s").agg(F.max_by("part", F.struct("size", "part")).alias("great"), F.count(F.lit(1)).alias("parts")).collect()}  # a row a setting
        if all(r["parts"] == 1 for r in rows.values()):
            return edges
        great = [rows[s]["great"] for s in range(settings)]
        largest = F.array(*(F.lit(p) for p in great))
        now = rewritten(points.join(labels, "n").repartition(tasks, "block"))
        ends = [F.array(*(f(F.get(c, s)) for s in numbers)).alias(name) for name, f, c in (("core_least", F.min, "core"), ("core_most", F.max, "core"), ("part_first", F.min, "part"), ("part_last", F.max, "part"))]
        block = rewritten(now.groupBy("block").agg(*ends).join(box, "block"))
        at = lambda c, s: F.get(c, s)
        own = now.repartition(tasks, "block").groupBy("block").applyInPandas(lambda pdf: nearest(pdf, pdf), schema)
        own = rewritten(own.groupBy("setting", "part").agg(F.min(F.struct("distance", "a", "b")).alias("e")))
        # a part looks no farther than the edge it has found within blocks, an equal one may go first; one that is alone in its blocks no farther than all of a block with others
        known = own.select("setting", "part", F.col("e.distance").alias("distance"))
        homes = now.select("block", F.posexplode("part").alias("setting", "part")).filter(F.col("part") != F.get(largest, F.col("setting"))).distinct().join(known, ["setting", "part"], "left_anti").join(block.select("block", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("core_most").alias("core")), "block")
        rest = block.select("lo", "hi", "core_most", "part_first", "part_last")
        others = (at("part_first", F.col("setting")) != F.col("part")) | (at("part_last", F.col("setting")) != F.col("part"))
        alone = homes.join(F.broadcast(rest), others).groupBy("setting", "part").agg(F.min(F.greatest(reach("__lo", "__hi", "lo", "hi"), at("core", F.col("setting")), at("core_most", F.col("setting")))).alias("distance"))  # one row a block
        known = rewritten(known.unionByName(alone)).select(F.col("setting").alias("__s"), F.col("part").alias("__p"), F.col("distance").alias("__d"))
        looking = now.filter(F.exists(F.array(*numbers), lambda s: at("part", s) != F.get(largest, s)))
        long = looking.select("n", F.posexplode("part").alias("s", "p")).join(known, (F.col("s") == F.col("__s")) & (F.col("p") == F.col("__p")), "left")
        bounds = long.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("s", F.when(F.col("p") == F.get(largest, F.col("s")), -1.0).otherwise(F.coalesce("__d", F.lit(float("inf")))).alias("d")))).alias("b")).select("n", F.col("b.d").alias("bound"))
        bounded = rewritten(looking.join(bounds, "n").repartition(tasks, "block"))
        most = bounded.groupBy("block").agg(F.array(*(F.max(F.get("bound", s)) for s in numbers)).alias("most"))
        block = rewritten(block.join(most, "block", "left").withColumn("most", F.coalesce("most", F.array_repeat(F.lit(-1.0), settings))))
        other = block.select(F.col("block").alias("to"), "lo", "hi", F.col("core_least").alias("to_core"), F.col("part_first").alias("to_first"), F.col("part_last").alias("to_last"))
        alike = lambda s: (at("part_first", s) == at("to_first", s)) & (at("part_last", s) == at("to_last", s)) & (at("part_first", s) == at("part_last", s))
        near = F.col("block") != F.col("to")
        some = F.exists(F.array(*numbers), lambda s: (F.col("__gap") <= at("most", s)) & ~alike(s))
        ways = block.withColumnsRenamed({"lo": "__lo", "hi": "__hi"}).join(F.broadcast(other), near).withColumn("__gap", gap("__lo", "__hi", "lo", "hi")).filter(some)  # one row a block
        ways = rewritten(ways.select(F.col("block").alias("from"), "to", "lo", "hi", "to_core", "to_first", "to_last"))
        same = lambda s: (at("part", s) == at("to_first", s)) & (at("part", s) == at("to_last", s))
        looks = F.transform(F.array(*numbers), lambda s: (F.greatest("__gap", at("core", s), at("to_core", s)) <= at("bound", s)) & ~same(s))
        guests = bounded.join(ways, F.col("block") == F.col("from")).withColumn("__gap", gap("x", "x", "lo", "hi")).withColumn("looks", looks).filter(F.exists("looks", lambda x: x))
        guests = guests.select("to", "n", "x", "core", "part", F.transform("looks", lambda x: x.cast("int")).alias("looks"))
        hosts = now.select(F.col("block").alias("to"), "n", "x", "core", "part")
        met = meet(guests, hosts, nearest, schema, tasks)
        best = own.unionByName(met.groupBy("setting", "part").agg(F.min(F.struct("distance", "a", "b")).alias("e"))).groupBy("setting", "part").agg(F.min("e").alias("e"))
        best = rewritten(best.select("setting", "part", "e.*"))
        if best.isEmpty():
            return edges
        edges = rewritten(edges.unionByName(best.select("setting", "a", "b", "distance").distinct()))
        # each part goes with the part at the other end of its edge
        part = lambda end: F.element_at(f"p_{end}", F.col("setting") + 1)
        ends = [labels.select(F.col("n").alias(f"n_{end}"), F.col("part").alias(f"p_{end}")) for end in ("a", "b")]
        joined = best.join(ends[0], F.col("a") == F.col("n_a")).join(ends[1], F.col("b") == F.col("n_b"))
        other = F.when(part("a") == F.col("part"), part("b")).otherwise(part("a"))
        ways = joined.select((F.col("part") + F.col("setting") * count).alias("id"), (other + F.col("setting") * count).alias("up"))
        still = F.explode(F.array(*(F.lit(p + s * count) for s, p in enumerate(great)))).alias("id")
        roots = _roots(ways.unionByName(points.sparkSession.range(1).select(still).withColumn("up", F.col("id"))))
        each = labels.select("n", F.posexplode("part").alias("s", "part")).withColumn("code", F.col("part") + F.col("s") * count)
        moved = each.join(roots, F.col("code") == F.col("id"), "left").withColumn("part", F.coalesce(F.col("root") - F.col("s") * count, "part"))
        labels = rewritten(moved.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("s", "part"))).alias("p")).select("n", F.col("p.part").alias("part")))


_OUT = "combo int, kind string, id long, parent long, density double, size long, weight double, value double, taken boolean, members array<long>"


def merge(edges: pd.DataFrame, states: pd.DataFrame, least: int, combo: int) -> pd.DataFrame:
    """A stretch of one setting's edges (rank, a, b: parts, distance), merged in order.

    Rows out, by kind: ``point`` (id leaves cluster parent at a density),
    ``cluster`` (id ends within parent; density at which it was whole, stability,
    value and whether it is taken over those within it), ``state`` of the parts
    left, ``map`` (part id is now part parent).
    """
    parts: dict[int, list] = {}  # part: size, cluster or -1, sum of densities, value of the clusters within, density when whole, its points while it is no cluster
    for r in states.itertuples(index=False):
        parts[r.id] = [r.size, r.parent, r.weight, r.value, r.density, [] if r.members is None else list(r.members)]
    merged, out = {}, []

    def root(p: int) -> int:
        while merged.get(p, p) != p:
            merged[p] = merged.get(merged[p], merged[p])
            p = merged[p]
        return p

    for e in edges.sort_values("rank").itertuples(index=False):
        a, b = sorted((root(e.a), root(e.b)))
        left, right = (parts.pop(p, None) or [1, -1, 0.0, 0.0, 0.0, [p]] for p in (a, b))
        density, size = 1.0 / max(e.distance, SHORTEST), left[0] + right[0]
        if left[1] >= 0 and right[1] >= 0:
            new, within = e.rank, 0.0
            for was in (left, right):
                stability = was[2] - was[0] * density
                taken = stability >= was[3]
                within += stability if taken else was[3]
                out.append(("cluster", was[1], new, was[4], was[0], stability, was[3], taken, None))
            parts[a] = [size, new, size * density, within, density, []]
        elif left[1] >= 0 or right[1] >= 0:
            big, small = (left, right) if left[1] >= 0 else (right, left)
            out += [("point", p, big[1], density, None, None, None, None, None) for p in small[5]]
            parts[a] = [size, big[1], big[2] + small[0] * density, big[3], big[4], []]
        elif size >= least:
            out += [("point", p, e.rank, density, None, None, None, None, None) for p in left[5] + right[5]]
            parts[a] = [size, e.rank, size * density, 0.0, density, []]
        else:
            parts[a] = [size, -1, 0.0, 0.0, 0.0, left[5] + right[5]]
        merged[b] = a
        merged.setdefault(a, a)
    out += [("state", p, s[1], s[4], s[0], s[2], s[3], None, s[5] or None) for p, s in parts.items()]
    out += [("map", p, root(p), None, None, None, None, None, None) for p in merged]
    rows = pd.DataFrame(out, columns=["kind", "id", "parent", "density", "size", "weight", "value", "taken", "members"])
    rows.insert(0, "combo", combo)
    return rows.astype({"size": "Int64", "taken": "boolean"})


def condensed(edges: DataFrame, count: int, grid: list[tuple[int, int]], stretch: int) -> DataFrame:
    """The rows of kind ``point`` and ``cluster`` of ``merge`` for every setting of the grid: (least size, number of its tree)."""
    ordered = running_totals(edges.withColumns({"order": F.struct("setting", "distance", "a", "b"), "one": F.lit(1)}), "order", {"i": "one"})
    # every tree has count - 1 edges, so their ranks follow from those over all trees
    ranked = rewritten(ordered.select("setting", (F.col("i") - 1 - F.col("setting") * (count - 1)).alias("rank"), "a", "b", "distance"))
    combos = F.array(*(F.struct(F.lit(c).alias("combo"), F.lit(tree).alias("tree")) for c, (_, tree) in enumerate(grid)))
    spark, out = edges.sparkSession, None
    part, states = None, spark.createDataFrame([], _OUT)
    for first in range(0, count - 1, stretch):
        now = ranked.filter((F.col("rank") >= first) & (F.col("rank") < first + stretch))
        if part is not None:  # the ends' parts by now; points that were not merged are parts of their own
            for end in ("a", "b"):
                known = part.select(F.col("setting").alias("__s"), F.col("point").alias("__p"), F.col("now").alias("__now"))
                now = now.join(known, (F.col("setting") == F.col("__s")) & (F.col(end) == F.col("__p")), "left").withColumn(end, F.coalesce("__now", end)).drop("__s", "__p", "__now")
        each = rewritten(now.withColumn("c", F.explode(F.filter(combos, lambda c: c["tree"] == F.col("setting")))).select("c.combo", "rank", "a", "b", "distance"))
        touched = each.select("combo", F.col("a").alias("id")).union(each.select("combo", F.col("b").alias("id"))).distinct()

        def run(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            return merge(new, old, grid[int(key[0])][0], int(key[0]))

        done = rewritten(each.groupBy("combo").cogroup(states.join(touched, ["combo", "id"]).groupBy("combo")).applyInPandas(run, _OUT))
        rest = states.join(touched, ["combo", "id"], "left_anti").select(*done.columns)
        states = rewritten(rest.unionByName(done.filter("kind = 'state'")))
        found = done.filter("kind in ('point', 'cluster')")
        out = found if out is None else out.unionByName(found)
        firsts = F.array(*(F.lit(next((c for c, (_, t) in enumerate(grid) if t == tree), -1)) for tree in range(max(t for _, t in grid) + 1)))
        moved = done.filter("kind = 'map'").withColumn("setting", F.array_position(firsts, F.col("combo")).cast("int") - 1).filter("setting >= 0")
        moved = moved.select(F.col("setting").alias("__s"), F.col("id").alias("__id"), "parent")
        if part is None:
            part = moved.select(F.col("__s").alias("setting"), F.col("__id").alias("point"), F.col("parent").alias("now"))
        else:
            kept = part.join(moved, (F.col("setting") == F.col("__s")) & (F.col("now") == F.col("__id")), "left").select("setting", "point", F.coalesce("parent", "now").alias("now"))
            fresh = moved.join(part.select("setting", "point"), (F.col("__s") == F.col("setting")) & (F.col("__id") == F.col("point")), "left_anti")
            part = kept.unionByName(fresh.select(F.col("__s").alias("setting"), F.col("__id").alias("point"), F.col("parent").alias("now")))
        part = rewritten(part)
    return out if out is not None else states


def members(tree: DataFrame) -> DataFrame:
    """combo, n, cluster, membership: the cluster that stands of each point that has one, and its density there as a share of the cluster's greatest.

    Every cluster looks up for the taken one that is nearest to the root, in
    steps that double. The last cluster, of all points, does not stand.
    """
    now = rewritten(tree.filter("kind = 'cluster'").select("combo", F.col("id").alias("c"), F.col("parent").alias("up"), F.when(F.col("taken"), F.col("id")).alias("top")))
    while True:
        above = now.select(F.col("combo").alias("__k"), F.col("c").alias("__c"), F.col("up").alias("__up"), F.col("top").alias("__top"))
        step = now.join(above, (F.col("combo") == F.col("__k")) & (F.col("up") == F.col("__c")), "left")
        now = rewritten(step.select("combo", "c", F.col("__up").alias("up"), F.coalesce("__top", "top").alias("top")))
        if now.filter("up is not null").isEmpty():
            break
    whole = tree.filter("kind = 'cluster'").select(F.col("combo").alias("__k"), F.col("id").alias("__id"), F.col("density").alias("__most"))
    tops = now.filter("top is not null").join(whole, (F.col("combo") == F.col("__k")) & (F.col("top") == F.col("__id"))).select(F.col("combo").alias("__k"), "c", F.col("top").alias("cluster"), F.col("__most").alias("most"))
    points = tree.filter("kind = 'point'").select("combo", F.col("id").alias("n"), F.col("parent").alias("__in"), "density")
    return points.join(tops, (F.col("combo") == F.col("__k")) & (F.col("__in") == F.col("c"))).select("combo", "n", "cluster", (F.least("density", "most") / F.col("most")).alias("membership"))


def silhouettes(points: DataFrame, box: DataFrame, found: DataFrame, tasks: int) -> DataFrame:
    """combo, silhouette: the mean over clustered points, of combos with two clusters or more; points alone in a cluster count 0.

    ``found`` (combo, cluster, first) has a row a copy, ``points`` one for all
    copies. The mean distance to a cluster is no less than that to its centre, and no
    more than that with the mean distance of its members to the centre added. So
    a point meets its own cluster and those whose centre is nearer than the
    least such sum, the first of which comes from the clusters of its block or,
    if its own is the only one there, from how far all centres of a group are at most.
    """
    mine = rewritten(found.groupBy("combo", "cluster", F.col("first").alias("n")).agg(F.count(F.lit(1)).alias("m")).join(points.select("n", "x", "block"), "n"))
    dims = (mine.select(F.size("x").alias("d")).first() or {"d": 1})["d"]
    middle = F.array(*((F.sum(F.get("x", F.lit(k)) * F.col("m")) / F.sum("m")).alias(f"c{k}") for k in range(dims)))
    centres = mine.groupBy("combo", "cluster").agg(F.sum("m").alias("size"), F.count(F.lit(1)).alias("members"), F.min("block").alias("at"), middle.alias("centre"))
    centres = rewritten(centres.withColumnsRenamed({"combo": "__k", "cluster": "__c"}))
    of = (F.col("combo") == F.col("__k")) & (F.col("cluster") == F.col("__c"))
    spread = mine.join(centres, of).groupBy("__k", "__c").agg((F.sum(gap("x", "x", "centre", "centre") * F.col("m")) / F.sum("m")).alias("spread"))
    centres = rewritten(centres.join(spread, ["__k", "__c"]))
    # centres lie in groups of their own, by the first block of their members
    ends = [F.array(*(f(F.get("centre", F.lit(k))) for k in range(dims))).alias(name) for name, f in (("lo", F.min), ("hi", F.max))]
    around = rewritten(centres.groupBy("__k", F.col("at").alias("to")).agg(*ends, F.max("spread").alias("spread"), F.min("__c").alias("first"), F.max("__c").alias("last")))
    corners = box.withColumnsRenamed({"lo": "__lo", "hi": "__hi"})
    alone = mine.groupBy("combo", "block").agg(F.min("cluster").alias("own"), F.max("cluster").alias("__last")).filter("own = __last").join(corners, "block")
    others = (F.col("combo") == F.col("__k")) & ((F.col("first") != F.col("own")) | (F.col("last") != F.col("own")))
    far = alone.join(F.broadcast(around), others).groupBy("combo", "block").agg(F.min(reach("__lo", "__hi", "lo", "hi") + F.col("spread")).alias("far"))  # a row a block and combo at most

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("combo"):
            names, first = np.unique(g["cluster"].to_numpy(), return_index=True)
            least, own = np.empty(len(g)), np.searchsorted(names, g["cluster"].to_numpy())
            for i, d in distances(_matrix(g["x"]), _matrix(g["centre"].iloc[first])):
                d = d + g["spread"].to_numpy()[first]
                d[np.arange(len(d)), own[i : i + len(d)]] = np.inf
                least[i : i + len(d)] = d.min(axis=1)
            least = np.minimum(least, g["far"].to_numpy(float, na_value=np.inf))
            out.append(g[["combo", "cluster", "n", "x", "m", "block"]].assign(bound=least * (1 + 1e-9) + 1e-12))
        return _frame(out, ["combo", "cluster", "n", "x", "m", "block", "bound"])

    kept = "combo int, cluster long, n long, x array<double>, m long, block int"
    near = mine.join(centres, of).join(rewritten(far), ["combo", "block"], "left").select("combo", "cluster", "n", "x", "m", "block", "centre", "spread", F.coalesce("far", F.lit(float("inf"))).alias("far"))
    bounded = rewritten(near.repartition(tasks, "block").groupBy("block").applyInPandas(bound, f"{kept}, bound double"))
    looks = bounded.groupBy("combo", "block").agg(F.max("bound").alias("most")).join(corners, "block").withColumnRenamed("block", "from")
    ways = rewritten(looks.join(F.broadcast(around), (F.col("combo") == F.col("__k")) & (gap("__lo", "__hi", "lo", "hi") <= F.col("most"))).select("__k", "from", "to", "lo", "hi"))
    guests = bounded.join(ways, (F.col("combo") == F.col("__k")) & (F.col("block") == F.col("from"))).filter(gap("x", "x", "lo", "hi") <= F.col("bound")).select("to", "combo", "cluster", "n", "x", "bound")
    hosts = centres.select(F.col("at").alias("to"), F.col("__k").alias("combo"), F.col("__c").alias("cluster"), "centre")

    def candidates(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for combo, g in a.groupby("combo"):
            other = b[b["combo"] == combo]
            names, own = other["cluster"].to_numpy(), g["cluster"].to_numpy()
            for i, d in distances(_matrix(g["x"]), _matrix(other["centre"])) if len(other) else ():
                r, c = np.nonzero((d <= g["bound"].to_numpy()[i : i + len(d), None]) & (names[None] != own[i : i + len(d), None]))
                out.append(pd.DataFrame({"combo": combo, "n": g["n"].to_numpy()[i + r], "own": own[i + r], "cluster": names[c]}))
        return _frame(out, ["combo", "n", "own", "cluster"])

    met = meet(guests, hosts, candidates, "combo int, n long, own long, cluster long", tasks)
    wanted = rewritten(met.unionByName(mine.select("combo", "n", F.col("cluster").alias("own"), "cluster")).join(points.select("n", "x"), "n"))
    narrow = mine.join(centres.filter(F.col("members") <= WIDE).select("__k", "__c"), of)
    places = rewritten(narrow.select("__k", "__c", F.col("block").alias("to")).distinct())
    guests = wanted.join(places, of).select("to", "combo", "n", "own", "cluster", "x")
    hosts = narrow.select(F.col("block").alias("to"), "combo", "cluster", "x", "m")
    schema = "combo int, n long, own long, cluster long, total double"

    def totals(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, members = [], {k: g for k, g in b.groupby(["combo", "cluster"])}
        for key, g in a.groupby(["combo", "cluster"]) if len(a) else ():
            if key in members:
                x, m = _matrix(members[key]["x"]), members[key]["m"].to_numpy(float)
                total = np.concatenate([d @ m for _, d in distances(_matrix(g["x"]), x)])
                out.append(g[["combo", "n", "own", "cluster"]].assign(total=total))
        return _frame(out, ["combo", "n", "own", "cluster", "total"])

    found, wide = meet(guests, hosts, totals, schema, tasks), wide_totals(wanted, mine, centres, schema)
    each = (found if wide is None else found.unionByName(wide)).groupBy("combo", "n", "own", "cluster").agg(F.sum("total").alias("total")).join(centres.select("__k", "__c", "size"), of)
    same = F.col("own") == F.col("cluster")
    near = each.groupBy("combo", "n", "own").agg(F.max(F.when(same & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"), F.min(F.when(~same, F.col("total") / F.col("size"))).alias("b"))
    near = near.join(mine.select(F.col("combo").alias("__k"), F.col("cluster").alias("__c"), F.col("n").alias("__n"), "m"), (F.col("combo") == F.col("__k")) & (F.col("own") == F.col("__c")) & (F.col("n") == F.col("__n")))
    value = F.when(F.col("a").isNull(), 0.0).when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return near.filter("b is not null").groupBy("combo").agg((F.sum(value * F.col("m")) / F.sum("m")).alias("silhouette"))


def sums(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a the sum of its distances to all rows of b, weighted by q, and the other way round by p.

    Squares come from products of vectors about a common middle, so distances far
    below the vectors' spread, which hardly count in sums, have fewer true digits.
    """
    middle = np.median(np.concatenate([a, b]), axis=0)
    a, b = a - middle, b - middle
    left = np.column_stack([a, (a * a).sum(axis=1), np.ones(len(a))])
    right = [np.ascontiguousarray(np.column_stack([-2 * t, np.ones(len(t)), (t * t).sum(axis=1)]).T) for t in (b[j : j + 256] for j in range(0, len(b), 256))]
    to_a, to_b = np.zeros(len(a)), np.zeros(len(b))
    for i in range(0, len(a), 512):
        for j, t in enumerate(right):
            d = left[i : i + 512] @ t
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            to_a[i : i + 512] += d @ q[j * 256 : (j + 1) * 256]
            to_b[j * 256 : (j + 1) * 256] += p[i : i + 512] @ d
    return to_a, to_b


def wide_totals(wanted: DataFrame, mine: DataFrame, centres: DataFrame, schema: str) -> DataFrame | None:
    """The sums of distances (``schema``) of points to clusters of very many members, or None: stretches of members meet each other once, and stretches of the other points that want a cluster meet those of its members.

    That is quadratic in such a cluster, but in tasks of bounded size, and a row goes to
    as many of them as there are stretches, not blocks.
    """
    of = (F.col("combo") == F.col("__k")) & (F.col("cluster") == F.col("__c"))
    parts = lambda rows: F.ceil(rows / SPAN).cast("int")
    wide = rewritten(centres.filter(F.col("members") > WIDE).select("__k", "__c", parts(F.col("members")).alias("hosts")))
    strange = wanted.filter("own != cluster")
    asked = rewritten(strange.join(wide, of).groupBy("__k", "__c", "hosts").agg(parts(F.count(F.lit(1))).alias("guests")))
    inner, outer = wide.agg(F.sum(F.col("hosts") * (F.col("hosts") + 1) / 2)).first()[0], asked.agg(F.sum(F.col("hosts") * F.col("guests"))).first()[0]
    if not inner:
        return None
    deal = lambda into: F.pmod(F.xxhash64("n", F.lit(into)), into).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    key = ["combo", "cluster", "g", "h"]

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["at"].to_numpy() == pdf["g"].to_numpy()
        parts = [pdf[side], pdf[~side]] if not side.all() else [pdf, pdf]
        x, m = [_matrix(t["x"]) for t in parts], [t["m"].to_numpy(float) for t in parts]
        found = sums(*x, *m)
        kept = parts if not side.all() else parts[:1]
        return pd.concat([t[["combo", "n", "cluster"]].assign(own=t["cluster"], total=total) for t, total in zip(kept, found, strict=False)])

    def across(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return _frame([], ["combo", "n", "own", "cluster", "total"])
        found, _ = sums(_matrix(a["x"]), _matrix(b["x"]), np.ones(len(a)), b["m"].to_numpy(float))
        return a[["combo", "n", "own", "cluster"]].assign(total=found)

    members = mine.select("combo", "cluster", "n", "x", "m")
    dealt = members.join(F.broadcast(wide), of).withColumn("at", deal("hosts")).withColumn("j", every("hosts"))  # these have more than WIDE rows each
    dealt = dealt.select("combo", "cluster", F.least("at", "j").alias("g"), F.greatest("at", "j").alias("h"), "at", "n", "x", "m")
    out = dealt.repartition(int(min(inner, 10_000)), *key).groupBy(*key).applyInPandas(within, schema)
    if not outer:
        return out
    there = strange.join(F.broadcast(asked), of).withColumn("g", deal("guests")).withColumn("h", every("hosts")).select(*key, "n", "own", "x")
    here = members.join(F.broadcast(asked), of).withColumn("h", deal("hosts")).withColumn("g", every("guests")).select(*key, "n", "x", "m")
    there, here = (rows.repartition(int(min(outer, 10_000)), *key).groupBy(*key) for rows in (there, here))
    return out.unionByName(there.cogroup(here).applyInPandas(across, schema))


def density_grid(vectors: DataFrame, key: str, vector: str, grid: list[tuple[int, int | None]], block: int = BLOCK, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(scores, labels) of every (min_cluster_size, min_samples) of the grid; no min_samples means the cluster size.

    scores: min_cluster_size, min_samples, clusters, noise, coverage,
    silhouette, membership, score (silhouette x coverage, or -1) and whether it is
    selected: the best score, then coverage, clusters and the smaller size. labels:
    combo (the number in the grid), the key, cluster (null: noise) and membership. Rows
    whose vector is null are left out; settings as large as the table or larger
    give noise only.
    """
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    numbered = running_totals(rows.withColumns({"order": F.struct("key", "x"), "one": F.lit(1)}), "order", {"i": "one"})
    points = rewritten(numbered.select((F.col("i") - 1).cast("long").alias("n"), "key", "x"))
    count = points.count()
    samples = sorted({ms or size for size, ms in grid})
    sizes = [(size, samples.index(ms or size)) for size, ms in grid]
    # copies count as one point, the first of them
    firsts = rewritten(points.groupBy("x").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("m")))
    points = rewritten(points.join(firsts.select(F.col("x").alias("__x"), "first"), F.col("x") == F.col("__x")).select("n", "key", "first"))
    apart = rewritten(along_curve(firsts.select(F.col("first").alias("n"), "x", "m"), block))
    tasks = max(1, -(-apart.count() // (2 * block)))
    box = rewritten(boxes(apart, "block", "x"))
    tree = vectors.sparkSession.createDataFrame([], _OUT)
    if count > 1:
        with_core = rewritten(apart.join(core_distances(apart, box, samples, tasks), "n"))
        edges, parts = listed_trees(with_core, len(samples), block)
        more, late = copies(points, with_core, len(samples))
        # copies whose edges the lists leave open are points of their own
        with_core = with_core.select("n", "x", "block", "core")
        if not late.isEmpty():
            with_core = rewritten(with_core.unionByName(late.join(with_core.withColumnRenamed("n", "first"), "first").select("n", "x", "block", "core")))
            known = more.join(late, ["n"], "left_semi").join(parts.withColumnsRenamed({"setting": "__s", "n": "__n"}), (F.col("setting") == F.col("__s")) & (F.col("first") == F.col("__n"))).select("setting", "n", "part")
            alone = late.select("n", F.explode(F.array(*(F.lit(s) for s in range(len(samples))))).alias("setting")).join(known, ["setting", "n"], "left_anti").select("setting", "n", F.col("n").alias("part"))
            parts = rewritten(parts.unionByName(known).unionByName(alone))
        edges = edges.unionByName(more.select("setting", "a", "b", "distance"))
        tree = rewritten(condensed(spanning_trees(with_core, box, count, len(samples), tasks, edges, parts), count, sizes, stretch))
    found = rewritten(members(tree))
    per = found.groupBy("combo").agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("clustered"), F.avg("membership").alias("membership"))
    settings = vectors.sparkSession.createDataFrame([(c, size, ms) for c, (size, ms) in enumerate(grid)], "combo int, min_cluster_size int, min_samples int")
    per = settings.join(per, "combo", "left").join(silhouettes(apart, box, found.join(points.select("n", "first"), "n"), tasks), "combo", "left")
    clusters, clustered = F.coalesce("clusters", F.lit(0)), F.coalesce("clustered", F.lit(0))
    scored = rewritten(per.withColumns({"clusters": clusters, "clustered": clustered, "noise": F.lit(count) - clustered, "coverage": clustered / F.lit(max(count, 1)), "membership": F.coalesce("membership", F.lit(0.0))}))
    scored = scored.withColumn("score", F.coalesce(F.col("silhouette") * F.col("coverage"), F.lit(-1.0)))
    best = scored.agg(F.max_by("combo", F.struct("score", "coverage", "clusters", -F.col("min_cluster_size"), -F.col("combo"))).alias("best"))
    scores = scored.join(F.broadcast(best)).select("combo", "min_cluster_size", "min_samples", "clusters", "noise", "coverage", "silhouette", "membership", "score", (F.col("combo") == F.col("best")).alias("selected"))  # one row is broadcast
    combos = F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))
    labels = points.select("n", "key", combos.alias("combo")).join(found, ["combo", "n"], "left").select("combo", F.col("key").alias(key), "cluster", "membership")
    return scores, labels
