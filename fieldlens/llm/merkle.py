"""Merkle manifest of a table: a digest of every row, of every group and of the whole, with proofs.

A leaf is the SHA-256 of a row's fields, each with its length. The leaves of a
group ascend by id; every ``fanout`` consecutive nodes become one, until one is
left, the group's; the groups' nodes, in order of the group's bytes (null first),
likewise become the root.

No sort orders the table. The place of a row in its group is a sum over a trie
of digits of the id: histograms count the rows of each cell of a digit, cells
of more than ``cell_rows`` rows are split by the next digit, and a row's rank is
the number of rows in the cells before its own, plus its place in its cell. Rows
of equal id go on by digits of their leaf, those of equal leaves by the number
of the row, so a hot id is split too. (Which of two equal rows comes first
changes neither the tree nor a leaf.)

The digits of the rank to base ``fanout`` are the path to the row in the tree. Nodes
with the same longest prefix, that is with all but the last ``BLOCK`` digits
in common, meet in one small group, which yields the node at the prefix; then
the prefixes do, and so on to the root. On the way back each group hands its
nodes the siblings from their place up. What a group holds is at most
``fanout ** BLOCK`` nodes, whatever the table's size.

Null fields count as ``-``; null ids come first, and a null group is a group. Repeated
rows are leaves of their own. Very long texts are hashed by the JVM where they
are. An empty table gives an empty result. Ids must be whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm import textkit as tk
from fieldlens.plans.lineage import materialize
from fieldlens.plans.prefix import running_totals

#: Bits of a histogram's digit; rows that a cell may have before it is split; levels of the tree in one group.
DIGIT, CELL_ROWS, BLOCK = 12, 1 << 14, 6


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as ``-`` or as its byte count, a colon and its value."""
    texts = (f.cast("string") for f in fields)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def _ends(df: DataFrame, column: str) -> tuple[int, int]:
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    return ends["low"] or 0, ends["high"] or 0


def _prefixes(column: str, low: int, high: int) -> list[Column]:
    """The column without its low bits, from the shift that leaves about 2 ** DIGIT values of its range down to none; nulls come before all."""
    shift = max((high - low).bit_length() - DIGIT, 0)
    found = []
    while True:
        null = max(low >> shift, 1 - (1 << 63)) - 1
        found.append(F.coalesce(F.shiftright(column, shift), F.lit(null).cast("long")))
        if not shift:
            return found
        shift = max(shift - DIGIT, 0)


def ranked(rows: DataFrame, group: str, id_col: str, tie_col: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``gid``, ``size`` and ``rank``: the group's place among the groups, its rows, and the row's place in it by (id, tie), all from 0.

    ``id_col`` and ``tie_col`` are longs; rows equal in both come in any order.
    ``rows`` is read several times: it should be narrow and checkpointed.
    """
    sizes = rows.groupBy(F.col(group).alias("__kg")).agg(F.count(F.lit(1)).alias("size")).withColumn("__one", F.lit(1))
    sizes = running_totals(sizes, "__kg", {"gid": "__one"}).select("__kg", "size", (F.col("gid") - 1).cast("long").alias("gid"))
    now = materialize(rows.withColumn("__row", F.monotonically_increasing_id()))
    prefixes = [*_prefixes(id_col, *_ends(now, id_col)), *_prefixes(tie_col, *_ends(now, tie_col)), *_prefixes("__row", *_ends(now, "__row"))]
    done: DataFrame | None = None
    for n, prefix in enumerate(prefixes):
        keyed = now.withColumn("__prefix", prefix)
        # a cell has at most 2 ** DIGIT children and one for nulls, however many rows it holds
        if n == 0:
            cells = keyed.groupBy(F.col(group).alias("__kg"), F.col("__prefix").alias("__kp")).agg(F.count(F.lit(1)).alias("__n"))
            before = Window.partitionBy("__kg").orderBy("__kp").rowsBetween(Window.unboundedPreceding, -1)
            cells = cells.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
            cells = cells.join(sizes.withColumnRenamed("__kg", "__sg"), F.col("__kg").eqNullSafe(F.col("__sg"))).drop("__sg")
            same = F.col(group).eqNullSafe(F.col("__kg")) & (F.col("__prefix") == F.col("__kp"))
        else:
            cells = keyed.groupBy(F.col("__cell").alias("__kc"), F.col("__prefix").alias("__kp")).agg(F.count(F.lit(1)).alias("__n"), F.first("__base").alias("__base"), F.first("size").alias("size"), F.first("gid").alias("gid"))
            before = Window.partitionBy("__kc").orderBy("__kp").rowsBetween(Window.unboundedPreceding, -1)
            cells = cells.withColumn("__base", F.col("__base") + F.coalesce(F.sum("__n").over(before), F.lit(0)))
            keyed = keyed.drop("__base", "size", "gid", "__n")
            same = (F.col("__cell") == F.col("__kc")) & (F.col("__prefix") == F.col("__kp"))
        cells = materialize(cells.withColumn("__next", F.monotonically_increasing_id()))
        now = materialize(keyed.join(cells, same).withColumn("__cell", F.col("__next")).drop("__kg", "__kc", "__kp", "__next", "__prefix"))
        inside = Window.partitionBy("__cell").orderBy(F.col(id_col).asc_nulls_first(), tie_col, "__row")
        small = now.filter(F.col("__n") <= cell_rows)
        small = small.withColumn("rank", F.col("__base") + F.row_number().over(inside) - 1).drop("__row", "__base", "__cell", "__n")
        done = small if done is None else done.unionByName(small)
        now = now.filter(F.col("__n") > cell_rows)
        if now.isEmpty():
            break
    return materialize(done)


def _above(level: Column, fanout: int) -> Column:
    """Digests of every ``fanout`` consecutive ones."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * fanout + 1, fanout), "").cast("binary"), 256))


def _blocks(nodes: DataFrame, fanout: int, *more: str) -> DataFrame:
    """The nodes of (tree, idx, size, digest) by block of ``fanout ** BLOCK``: ``nodes`` in order, and the digests level by level, ``level0`` to ``level{BLOCK}``.

    Levels end at the top of a tree, however many are left in its block.
    """
    blocked = nodes.withColumn("block", F.floor(F.col("idx") / fanout**BLOCK))
    rows = blocked.groupBy("tree", "block").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("idx", "digest", *more))).alias("nodes"))
    rows = rows.withColumn("level0", F.transform("nodes", lambda n: F.lower(F.hex(n["digest"]))))
    for k in range(BLOCK):
        rows = rows.withColumn(f"level{k + 1}", F.when(F.col("size") > fanout**k, _above(F.col(f"level{k}"), fanout)).otherwise(F.col(f"level{k}")))
    return rows


def _up(nodes: DataFrame, fanout: int) -> DataFrame:
    """The nodes at the prefixes of (tree, idx, size, digest): one row for each block."""
    size = F.ceil(F.col("size") / fanout**BLOCK).cast("long")
    return _blocks(nodes, fanout).select("tree", F.col("block").alias("idx"), size.alias("size"), F.unhex(F.get(f"level{BLOCK}", F.lit(0))).alias("digest"))


def _to_tops(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Nodes by block level, the last of them with one node a tree."""
    found = [nodes]
    while (found[-1].agg(F.max("size").alias("n")).first()["n"] or 0) > 1:
        found.append(materialize(_up(found[-1], fanout)))
    return found


def _siblings(fanout: int) -> tuple[Column, Column]:
    """What stands left and right of the way of the node at ``at`` in its block, level by level to the top of the block."""
    left, right = [], []
    for k in range(BLOCK):
        place = F.floor(F.col("at") / fanout**k).cast("int")
        first = place - place % fanout
        inside = F.col("size") > fanout**k
        left.append(F.when(inside, F.array_join(F.slice(f"level{k}", first + 1, place - first), "")))
        right.append(F.when(inside, F.array_join(F.slice(f"level{k}", place + 2, fanout - 1 - place + first), "")))
    return F.array_compact(F.array(*left)), F.array_compact(F.array(*right))


def _down(nodes: DataFrame, paths: DataFrame, fanout: int, *more: str) -> DataFrame:
    """tree, idx, digest (hex), subroot and ``more`` of each node, with the siblings left and right on its way up to the root, given those of the nodes at the prefixes."""
    above = paths.select(F.col("tree").alias("__tree"), F.col("idx").alias("__block"), F.col("left").alias("__left"), F.col("right").alias("__right"), "subroot")
    met = _blocks(nodes, fanout, *more).join(above, (F.col("tree") == F.col("__tree")) & (F.col("block") == F.col("__block")))
    each = met.select("*", F.posexplode("nodes").alias("at", "node"))
    left, right = _siblings(fanout)
    return each.select("tree", F.col("node.idx").alias("idx"), F.get("level0", F.col("at")).alias("digest"), F.concat(left, "__left").alias("left"), F.concat(right, "__right").alias("right"), "subroot", *(F.col(f"node.{c}").alias(c) for c in more))


def manifest(df: DataFrame, fields: list[Column], keep: list[str], id_col: str = "doc_id", group_col: str = "lang", altered: Column | None = None, fanout: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every row with its leaf, the node of its group (``subroot``), the ``root`` and its proof.

    ``fields`` make the leaf. ``altered`` is a leaf to verify in place of the
    row's own, null where it is unaltered; ``folded_root`` is what that leaf and
    the original siblings give, and ``verified`` whether it is the root.
    """
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be a whole number: its digits rank the rows")
    names, _ = tk.kept(df, keep)
    rows = df.select(
        *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(id_col).cast("long").alias("__id"), F.col(group_col).cast("string").alias("__group"),
        F.unhex(leaf(fields)).alias("digest"), (F.unhex(altered) if altered is not None else F.lit(None).cast("binary")).alias("altered"),
    )
    # 60 bits of the leaf order rows of equal id
    rows = materialize(rows.withColumn("__tie", F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")))
    leaves = ranked(rows, "__group", "__id", "__tie", cell_rows).withColumnsRenamed({"gid": "tree", "rank": "idx"})
    groups = _to_tops(leaves.select("tree", "idx", "size", "digest"), fanout)
    total = groups[-1].count()  # one node a group
    tops = groups[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(total).cast("long").alias("size"), "digest")
    whole = _to_tops(tops, fanout)
    last = whole[-1].first()
    root = last["digest"].hex() if last else ""
    none = F.array().cast("array<string>")
    paths = whole[-1].select("tree", "idx", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"))
    for nodes in reversed(whole[:-1]):
        paths = materialize(_down(nodes, paths, fanout))
    # the way of a group's node leads on from its group's tree
    subroots = groups[-1].select("tree", F.lower(F.hex("digest")).alias("subroot"))
    paths = paths.select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("idx"), "left", "right").join(subroots, "tree")
    for nodes in reversed(groups[1:-1]):
        paths = materialize(_down(nodes, paths, fanout))
    found = _down(leaves, paths, fanout, "altered", *names)
    way = F.zip_with("left", "right", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    folded = F.aggregate(way, F.coalesce(F.lower(F.hex("altered")), "digest"), lambda now, s: F.sha2(F.concat(s["a"], now, s["b"]).cast("binary"), 256))
    proof = F.sha2(F.array_join(F.zip_with("left", "right", lambda a, b: F.concat(a, b)), "").cast("binary"), 256)
    found = found.withColumns({"proof_sha256": proof, "folded_root": folded})
    return found.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
