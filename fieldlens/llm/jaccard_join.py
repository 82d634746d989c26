"""Exact n-gram Jaccard join by a size-aware heavy-light scheme.

A text's set is its distinct word shingles. Two sets of sizes s and t can reach
the similarity j only if they share j x max(s, t) shingles, so in one global
order (rare shingles first) two such sets share at least k shingles within
their first s - ceil(j x s) + k. Small sets enumerate all 2-subsets of that
stretch as keys; large sets look up single shingles in inverted lists. The
boundary between small and large is where the estimated work, subsets against
list entries, is least over the whole corpus.

1. Equal sets are one set. Shingles are counted in hash buckets that travel as
   packed arrays; one that occurs in a single set can't be shared and stays home.
   A set with very many copies is sent by one of them. A shingle of very many
   sets, found in a sample of sets, needs no exact count: its place in the global
   order comes from the sample, and its entries go straight to their sets.
2. Each set learns which of its shingles are shared. A set with too few of them
   can have no partner and goes.
3. Keys meet. A list of up to ``most_members`` sets gives pairs, thinned by size
   and position, which are verified on the whole sets.
4. Longer lists (large groups of near copies) are not paired off. Their sets
   form clusters; all of a cluster meet a block of hub sets, and whatever is not
   in the cluster's main component afterwards meets the whole cluster, in
   blocks that scan inverted lists. Pairs inside a component need no check, so
   no link between components is lost.

Texts without words have empty sets and link with nothing; texts with fewer
than n words are one shingle. Null text counts as empty. Equal rows, and texts
with equal sets, share a set and so a component; of equal ids the component is
the same. Very long texts are hashed in stretches. An empty table gives an
empty result. Columns besides id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm import textkit as tk
from fieldlens.llm.shingles import set_hash, shingle_sets
from fieldlens.plans.components import connected_components
from fieldlens.plans.lineage import materialize


def _least_shared(size: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-size * num // den)


def set_table(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, hash of the set and hash of the row for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.raw(batch.column(1))
            sizes, hashes = [], []
            for _, _, d, o in tk.chunks(data, offsets):
                for s in shingle_sets(d, o, n):
                    sizes.append(len(s))
                    hashes.append(set_hash(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.int64()), batch.column(2)], ["doc_id", "n_shingles", "sid", "rid"])

    rows = docs.select(id_col, text_col, F.xxhash64(id_col, text_col))
    return rows.mapInArrow(tk.tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, sid long, rid long")


def frequent_shingles(docs: DataFrame, sets: DataFrame, total: int, n: int, id_col: str, text_col: str, sampled: int = 1_000_000, least: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of very many sets, ascending, with an estimate of their number.

    Sets are picked by their hash so that about ``sampled`` shingles are looked
    at; those of at least ``least`` picked sets are frequent, so at most
    ``sampled / least`` of them come back, whatever the corpus.
    """
    step = max(1, total // sampled)
    one = sets.filter((F.pmod("sid", F.lit(step)) == 0) & (F.col("n_shingles") > 0)).groupBy("sid").agg(F.min("rid").alias("rid"))
    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("of"))
    rows = rows.join(F.broadcast(one.select("rid")), F.col("of") == F.col("rid"), "left_semi").dropDuplicates(["of"]).select("text")  # about ``sampled`` numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.raw(batch.column(0))
            for _, _, d, o in tk.chunks(data, offsets):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(d, o, n)]).view(np.int64))], ["token"])

    got = rows.mapInArrow(tk.tidy(run), "token long").groupBy("token").count().filter(F.col("count") >= least).toArrow()
    token, count = got["token"].to_numpy().view(np.uint64), got["count"].to_numpy()
    order = np.argsort(token)
    return token[order], count[order] * step


def _packed(group: np.ndarray, n_groups: int, owner: np.ndarray, sids: np.ndarray, sizes: np.ndarray, columns: list[np.ndarray]) -> Iterator[list]:
    """Rows (group, sids, sizes, counts, columns ...) of packed arrays: the entries of one group, by owner. Entries come sorted by owner."""
    order = np.argsort(group, kind="stable")
    bound = np.searchsorted(group[order], np.arange(n_groups + 1))
    for g in np.flatnonzero(np.diff(bound)).tolist():
        at = order[bound[g] : bound[g + 1]]
        who, counts = np.unique(owner[at], return_counts=True)
        yield [g, sids[who].tobytes(), sizes[who].astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), *(c[at].tobytes() for c in columns)]


def _seven_bytes(tokens: np.ndarray) -> np.ndarray:
    """The low 56 bits; the bucket's number, of 8 bits or more, tells the rest."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).view("V7").ravel()


def _unpack(table: pa.Table, kinds: list[type]) -> list[np.ndarray]:
    """sid and size of each entry, then the entry columns."""

    def read(name: str, kind: type | str) -> np.ndarray:
        found = np.concatenate([np.zeros(0, kind), *(np.frombuffer(b, kind) for b in table[name].to_pylist())])
        if kind == "V7":
            wide = np.zeros((len(found), 8), np.uint8)
            wide[:, :7] = found.view(np.uint8).reshape(-1, 7)
            found = wide.view("<u8").ravel()
        return found

    counts = read("counts", np.int32)
    return [np.repeat(read("sids", np.int64), counts), np.repeat(read("sizes", np.int32), counts), *(read(f"c{i}", k) for i, k in enumerate(kinds))]


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, len(names)))], names)


def live_sets(docs: DataFrame, sets: DataFrame, total: int, n: int, num: int, den: int, id_col: str, text_col: str, most_members: int, bucket_entries: int = 500_000, most_copies: int = 1000) -> DataFrame:
    """Sets that may have a partner: sid, size, core (shared shingles in global order, packed), scan, subsets.

    scan and subsets are the estimated work of the set as a large or a small one.
    """
    bits = max(8, int(np.ceil(np.log2(max(total / bucket_entries, 1)))))
    buckets = 1 << bits
    heads = ["bucket", "sids", "sizes", "counts"]
    frequent, frequency = frequent_shingles(docs, sets, total, n, id_col, text_col)
    # sets with so many copies that there can't be many of them: one copy speaks for all
    copied = sets.filter("n_shingles > 0").groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid"))
    speaker = {r["sid"]: r["rid"] for r in copied.filter(F.col("n") > max(most_copies, sets.count() // 10_000)).collect()}

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.raw(batch.column(0))
            rid = batch.column(1).to_numpy()
            for a, _, d, o in tk.chunks(data, offsets, 4 << 20):
                found: dict[int, np.ndarray] = {}
                for low, high, x, y in tk.chunks(d, o):
                    for r, s in zip(rid[a + low : a + high].tolist(), shingle_sets(x, y, n), strict=True):
                        sid = set_hash(s)
                        if len(s) and sid not in found and speaker.get(sid, r) == r:
                            found[sid] = s
                if not found:
                    continue
                sids, sizes = np.array(list(found), np.int64), np.array([len(s) for s in found.values()], np.int64)
                flat, owner = np.concatenate(list(found.values())), np.repeat(np.arange(len(sids)), sizes)
                at = np.minimum(np.searchsorted(frequent, flat), max(len(frequent) - 1, 0))
                known = frequent[at] == flat if len(frequent) else np.zeros(len(flat), bool)
                rows = list(_packed((flat[~known] >> np.uint64(64 - bits)).astype(np.int64), buckets, owner[~known], sids, sizes, [_seven_bytes(flat[~known])]))
                # frequent shingles: to a bucket of their set, with a negative number
                rows += [[-1 - r[0], *r[1:]] for r in _packed(sids[owner[known]] % buckets, buckets, owner[known], sids, sizes, [flat[known]])]
                yield _batch(rows, [*heads, "c0"])

    def count(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py() if len(table) else 0
        if bucket < 0:  # nothing to count
            sid, size, tok = _unpack(table, [np.uint64])
            df = frequency[np.searchsorted(frequent, tok)]
        else:
            sid, size, tok = _unpack(table, ["V7"])
            tok |= np.uint64(bucket >> (bits - 8)) << np.uint64(56)
        order = np.lexsort((sid, tok))
        sid, size, tok = sid[order], size[order], tok[order]
        fresh = np.ones(len(tok), bool)
        fresh[1:] = (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])  # copies of a set count once
        if bucket < 0:
            sid, size, tok, df = sid[fresh], size[fresh], tok[fresh], df[order][fresh]
        else:
            sid, size, tok = sid[fresh], size[fresh], tok[fresh]
            first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1]))) if len(tok) else np.zeros(0, np.int64)
            runs = np.diff(np.concatenate((first, [len(tok)])))
            df = np.repeat(runs, runs)
            many = df > 1
            sid, size, tok, df = sid[many], size[many], tok[many], df[many]
        order = np.argsort(sid, kind="stable")
        sid, size, tok, df = sid[order], size[order], tok[order], df[order]
        owner = np.cumsum(np.concatenate(([0], sid[1:] != sid[:-1]))) if len(sid) else np.zeros(0, np.int64)
        at = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1]))) if len(sid) else np.zeros(0, np.int64)
        rows = list(_packed(sid % buckets, buckets, owner, sid[at], size[at], [tok, np.minimum(df, 2**31 - 1).astype(np.int32)]))
        return pa.Table.from_batches([_batch(rows, [*heads, "c0", "c1"])])

    def gather(table: pa.Table) -> pa.Table:
        sid, size, tok, df = _unpack(table, [np.uint64, np.int32])
        order = np.lexsort((tok, df, sid))
        sid, size, tok, df = sid[order], size[order].astype(np.int64), tok[order], df[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1]))) if len(sid) else np.zeros(0, np.int64)
        core = np.diff(np.concatenate((first, [len(sid)])))
        sid, size = sid[first], size[first]
        reach = size - _least_shared(size, num, den) + 1 - (size - core)  # of the first shared shingles, those within the stretch
        live = (reach > 0) & (size > 1)
        # in pairs made: a key costs about four; a list is paired off up to most_members, a longer one goes through blocks, where an entry costs about a hundredth
        cost = np.concatenate(([0], np.cumsum(np.where(df <= most_members, df // 2, df // 100) + 4)))
        out = []
        for i in np.flatnonzero(live).tolist():
            a, r, c = int(first[i]), int(reach[i]), int(core[i])
            two = min(r + 1, c)
            out.append((int(sid[i]), int(size[i]), tok[a : a + c].tobytes(), int(cost[a + r] - cost[a]), 2 * two * (two - 1)))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.table({name: pa.array([r[j] for r in out], kinds[j]) for j, name in enumerate(("sid", "size", "core", "scan", "subsets"))})

    shape = "bucket int, sids binary, sizes binary, counts binary, c0 binary"
    counted = docs.select(text_col, F.xxhash64(id_col, text_col)).mapInArrow(tk.tidy(tokens), shape).groupBy("bucket").applyInArrow(tk.tidy(count), f"{shape}, c1 binary")
    return counted.groupBy("bucket").applyInArrow(tk.tidy(gather), "sid long, size long, core binary, scan long, subsets long")


def boundary(live: DataFrame) -> int:
    """Largest size of a small set: where subsets up to it plus list entries beyond it are fewest. Sizes are looked at in 5 % steps."""
    step = F.floor(F.log(F.col("size").cast("double")) / float(np.log(1.05)))
    rows = sorted(live.groupBy(step.alias("step")).agg(F.sum("scan").alias("scan"), F.sum("subsets").alias("subsets"), F.max("size").alias("top")).collect(), key=lambda r: r["step"])
    best, at, now = sum(r["scan"] for r in rows), 0, sum(r["scan"] for r in rows)
    for r in rows:
        now += r["subsets"] - r["scan"]
        if now < best:
            best, at = now, r["top"]
    return at


def _keys(live: DataFrame, bound: int, num: int, den: int) -> DataFrame:
    """key, sid, size, rest (shared shingles behind the key's last one), single (an inverted list's key, not a 2-subset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, int, int, np.ndarray, bool]] = []
            for sid, size, core in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tok = np.frombuffer(core, np.uint64)
                reach = min(size - -(-size * num // den) + 1 - (size - len(tok)), len(tok))
                if size <= bound:
                    i, j = np.triu_indices(min(reach + 1, len(tok)), 1)
                    out.append((tk.mix(tk.mix(tok[i]) * np.uint64(3) + tok[j]), sid, size, len(tok) - 1 - j, False))
                if size * den >= num * (bound + 1):  # large, or small enough a step below the boundary to pair with a large one
                    out.append((tok[:reach], sid, size, len(tok) - 1 - np.arange(reach), True))
            if out:
                n = [len(o[0]) for o in out]
                flat = lambda i, kind: np.repeat(np.array([o[i] for o in out], kind), n)
                cols = [np.concatenate([o[0] for o in out]).view(np.int64), flat(1, np.int64), flat(2, np.int64), np.concatenate([o[3] for o in out]).astype(np.int64), flat(4, bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "sid", "size", "rest", "single"])

    return live.select("sid", "size", "core").mapInArrow(tk.tidy(run), "key long, sid long, size long, rest long, single boolean")


def _linked(num: int, den: int, size_a: np.ndarray, size_b: np.ndarray, both: np.ndarray) -> np.ndarray:
    return den * both >= num * (size_a + size_b - both)


def _verify(pairs: DataFrame, live: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            ok = pa.array(_linked(num, den, batch.column(2).to_numpy(), batch.column(3).to_numpy(), both), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(ok)

    left = live.select(F.col("sid").alias("x"), F.col("size").alias("size_a"), F.col("core").alias("core_a"))
    right = live.select(F.col("sid").alias("y"), F.col("size").alias("size_b"), F.col("core").alias("core_b"))
    full = pairs.join(left, F.col("a") == F.col("x")).join(right, F.col("b") == F.col("y"))
    return full.select("a", "b", "size_a", "size_b", "core_a", "core_b").mapInArrow(tk.tidy(run), "a long, b long")


def block_edges(left: tuple[np.ndarray, np.ndarray, list[np.ndarray]], right: tuple[np.ndarray, np.ndarray, list[np.ndarray]], num: int, den: int) -> list[tuple[int, int]]:
    """Links between two blocks of sets (ids, sizes, shingles), found by scanning inverted lists; as edges to each local component's smallest id."""
    ids, sizes, sets = left
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    owner, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order], flat[order]
    root = {int(i): int(i) for i in [*ids.tolist(), *right[0].tolist()]}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for sid, size, tok in zip(right[0].tolist(), right[1].tolist(), right[2], strict=True):
        low, high = np.searchsorted(flat, tok, "left"), np.searchsorted(flat, tok, "right")
        both = np.bincount(owner[tk.ragged(low, high - low)], minlength=len(ids))
        for i in ids[_linked(num, den, sizes, np.int64(size), both)].tolist():
            a, b = find(sid), find(i)
            root[max(a, b)] = min(a, b)
    return [(i, find(i)) for i in root if find(i) != i]


def _meet(cluster_sets: DataFrame, others: DataFrame, num: int, den: int) -> DataFrame:
    """Edges from every (cluster, lane, part) group of sets to the other sets with the same key."""

    def unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        return t["sid"].to_numpy(), t["size"].to_numpy(), [np.frombuffer(b, np.uint64) for b in t["core"].to_pylist()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        edges = block_edges(unpack(left), unpack(right), num, den) if len(left) and len(right) else []
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    keys = ["cluster", "lane", "part"]
    others = others.select(*(F.col(c).alias(c) for c in others.columns))  # both sides may come from one table
    return cluster_sets.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(tk.tidy(run), "a long, b long")


def _cluster_edges(postings: DataFrame, tops: DataFrame, live: DataFrame, known: DataFrame, num: int, den: int, hubs: int = 256, block: int = 512) -> DataFrame:
    """Edges among sets that share a long list. ``known``: the edges found so far."""
    stars = postings.join(tops, F.col("key") == F.col("top_key")).select(F.col("sid").alias("a"), F.col("top_sid").alias("b"))
    clusters = materialize(connected_components(stars).withColumnRenamed("root", "cluster"))
    # one row per cluster, written first: so the joins to it are plain ones whose large keys Spark can split
    lanes = materialize(clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).alias("lanes")).withColumnRenamed("cluster", "cl"))
    member = clusters.join(lanes, F.col("cluster") == F.col("cl")).join(live.select("sid", "size", "core"), F.col("id") == F.col("sid"))
    member = materialize(member.select("cluster", "lanes", "sid", "size", "core", F.pmod(F.xxhash64("sid"), F.col("lanes")).alias("lane")))
    # hubs: the sets with the fewest shingles of their own are nearest to what the group has in common
    near = Window.partitionBy("cluster").orderBy("own", "sid")
    chosen = member.select("cluster", "sid", (F.col("size") - F.length("core") / 8).alias("own")).withColumn("nth", F.row_number().over(near)).filter(F.col("nth") <= hubs)
    hub = member.join(chosen.select(F.col("sid").alias("h")), F.col("sid") == F.col("h"))
    each_lane = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("lanes") - 1).cast("long"))).alias("lane")
    first = materialize(_meet(member.withColumn("part", F.lit(0).cast("long")), hub.select("cluster", "sid", "size", "core", each_lane).withColumn("part", F.lit(0).cast("long")), num, den))

    roots = connected_components(known.unionByName(first)).select(F.col("id"), "root")
    placed = materialize(member.join(roots, F.col("sid") == F.col("id"), "left").select("cluster", "lanes", "sid", "size", "core", F.coalesce("root", "sid").alias("root")))
    sizes = placed.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    main = materialize(sizes.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("m")).select(F.col("cluster").alias("cl"), F.col("m.root").alias("main")))
    rest = placed.join(main, F.col("cluster") == F.col("cl")).filter("root <> main").select("cluster", "lanes", "sid", "size", "core")
    parts = materialize(rest.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")).select(F.col("cluster").alias("cl"), "parts"))
    rest = rest.join(parts, F.col("cluster") == F.col("cl")).select("cluster", "sid", "size", "core", F.pmod(F.xxhash64("sid", F.lit("part")), F.col("parts")).alias("part"), each_lane)
    again = member.join(parts, F.col("cluster") == F.col("cl")).select("cluster", "lane", "sid", "size", "core", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("parts") - 1).cast("long"))).alias("part"))
    return first.unionByName(_meet(again, rest, num, den))


def components(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", most_members: int = 64, most_broadcast: int = 200_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id reachable over links of at least the similarity."""
    num, den = similarity
    sets = materialize(set_table(docs, n, id_col, text_col))
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    live = materialize(live_sets(docs, sets, total, n, num, den, id_col, text_col, most_members))
    bound = boundary(live)
    postings = materialize(_keys(live, bound, num, den))
    lists = materialize(postings.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("sid").alias("top_sid")).filter("members > 1").withColumnRenamed("key", "top_key"))

    long = materialize(lists.filter(F.col("members") > most_members).select("top_key", "top_sid"))
    # the keys of long lists leave before the others meet: by their own broadcast while they are few, else by a join that may be split
    few = long.count() <= most_broadcast
    away = F.broadcast(long) if few else long
    short = postings.join(away, F.col("key") == F.col("top_key"), "left_anti").join(lists.select("top_key"), F.col("key") == F.col("top_key")).drop("top_key")
    x = short.select("key", F.col("sid").alias("a"), F.col("size").alias("sa"), F.col("rest").alias("ra"), "single")
    y = short.select(F.col("key").alias("k"), F.col("sid").alias("b"), F.col("size").alias("sb"), F.col("rest").alias("rb"))
    # sets of too different sizes, and pairs whose first common key leaves too few shingles behind it, can't link
    most = F.least("ra", "rb") + F.when(F.col("single"), 1).otherwise(2)
    fit = (F.col("a") < F.col("b")) & (~F.col("single") | (F.greatest("sa", "sb") > bound)) & (F.least("sa", "sb") * den >= F.greatest("sa", "sb") * num) & (most * den >= (F.col("sa") + F.col("sb") - most) * num)
    pairs = x.join(y, (F.col("key") == F.col("k")) & fit).select("a", "b").distinct()
    edges = materialize(_verify(pairs, live, num, den))
    if not long.isEmpty():
        edges = materialize(edges.unionByName(_cluster_edges(postings, away, live, edges, num, den)))

    roots = connected_components(edges)
    own = sets.filter("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    reach = own.join(roots, F.col("sid") == F.col("id"), "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    least = reach.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "r")
    where = reach.join(least, F.col("root") == F.col("r")).select(F.col("sid").alias("set"), "component")
    alone = sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return sets.filter("n_shingles > 0").join(where, F.col("sid") == F.col("set")).select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionByName(alone)
