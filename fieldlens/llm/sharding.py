"""Sharding by k-d tree partitioning, with DataFrame functions only.

Every row is a point: its source and language, each by a 16-bit hash of its text,
and its id, all scaled to a range of whole numbers; its size is its weight. A hash
keeps rows of one source or language together, but says nothing about which
are alike. All nodes of a level are split at the weighted median of their widest
dimension, for as many levels as bring the leaves to the target bytes. Ties in a dimension are broken by a hash of the row, so a
source or language that holds most rows splits as evenly as any other.

A median is found by descent over digits of the split coordinate: each pass
sums the bytes of at most ``nodes x 1024`` digit values, so that is all that
the driver sees, however many rows there are. All nodes of a level descend
together. A large row at a median leaves the halves uneven; one row of each
node, the one whose size is nearest to the excess, then changes sides.

Null text has size 1 and the checksum of no bytes; null source or language are a
value of their own, a null id counts as 0. Ids are numbers or texts; a text that is no finite number
counts as a 16-bit hash of itself. Repeated rows are separate points. A very long text is one row, so a leaf may exceed the
target by it. An empty table gives an empty result. Columns other than id, text,
source and language are not read, so their names can't clash.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.plans.lineage import materialize
from fieldlens.plans.numbering import number_rows

#: Bits of a scaled dimension, of the hash below it, and of a digit.
SCALE, TIE, DIGIT = 20, 20, 10


def _points(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """Narrow rows: id, size, checksum, the raw dimensions and a tie-breaking hash."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    crc = F.crc32(text)
    number = F.col(id_col).try_cast("double")
    place = F.when(F.abs(number) < 1e300, number).when(F.col(id_col).isNull(), 0.0).otherwise(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 16)).cast("double"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc.cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(source_col)), F.lit(1 << 16)).cast("double").alias("d_source"),
        F.pmod(F.xxhash64(F.col(lang_col)), F.lit(1 << 16)).cast("double").alias("d_lang"),
        place.alias("d_id"),
        F.pmod(F.xxhash64(F.col(id_col), crc), F.lit(1 << TIE)).alias("tie"),
    )


DIMENSIONS = ("d_source", "d_lang", "d_id")


def _per_node(values: list, default: float = 0) -> Column:
    """The node's entry of a short list (one entry a node, at most the number of shards)."""
    return F.element_at(F.array(*(F.lit(v) for v in values or [default])), F.col("node") + 1)


def _split_level(rows: DataFrame, nodes: int, spans: dict[str, tuple[float, float]]) -> DataFrame:
    """Splits every node 0..nodes-1 at the weighted median of its widest dimension: node n becomes 2n and 2n+1."""
    ranges = {r["node"]: r for r in rows.groupBy("node").agg(*(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max)))).collect()}
    widest, low, span = [], [], []
    for node in range(nodes):
        r = ranges.get(node)
        wide = max(DIMENSIONS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / max(spans[d][1] - spans[d][0], 1e-9)) if r else DIMENSIONS[0]
        widest.append(DIMENSIONS.index(wide))
        low.append(float(r[f"lo_{wide}"]) if r else 0.0)
        span.append(float(max(r[f"hi_{wide}"] - r[f"lo_{wide}"], 1e-9)) if r else 1.0)
    value = F.element_at(F.array(*(F.col(d) for d in DIMENSIONS)), _per_node(widest) + 1)
    scaled = F.least(F.floor((value - _per_node(low)) / _per_node(span) * ((1 << SCALE) - 1)), F.lit((1 << SCALE) - 1))
    rows = materialize(rows.withColumn("at", scaled * (1 << TIE) + F.col("tie")))

    known, below, reached, half = [0] * nodes, [0] * nodes, [0] * nodes, None
    for shift in range(SCALE + TIE - DIGIT, -1, -DIGIT):
        near = F.shiftright("at", shift + DIGIT) == _per_node(known)
        digit = F.shiftright("at", shift).bitwiseAND((1 << DIGIT) - 1)
        sums: dict[int, dict[int, int]] = {}
        for r in rows.filter(near).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("bytes")).collect():
            sums.setdefault(r["node"], {})[r["digit"]] = r["bytes"]
        if half is None:
            half = [sum(sums.get(k, {}).values()) / 2 for k in range(nodes)]
        for node in range(nodes):
            digits = sorted(sums.get(node, {}).items())
            running = list(accumulate((b for _, b in digits), initial=below[node]))
            at = min(bisect_left(running, half[node], lo=1), len(digits)) - 1 if digits else 0
            at = max(at, 0)
            known[node] = (known[node] << DIGIT) + (digits[at][0] if digits else 0)
            below[node] = running[at] if digits else below[node]
            if shift == 0 and digits:
                reached[node] = running[at + 1]
                if half[node] - running[at] < running[at + 1] - half[node]:
                    known[node] -= 1  # the rows at the median go where the halves differ least
                    reached[node] = running[at]
    lower = F.col("at") <= _per_node(known)
    # what the halves still differ by is evened out by the one row whose size is nearest to the excess
    excess = [r - h for r, h in zip(reached, half or [0.0] * nodes, strict=True)]
    heavy = rows.filter(lower == _per_node([e > 0 for e in excess], False))
    gap = F.abs(F.col("size") - F.abs(_per_node([float(e) for e in excess], 0.0)))
    best = heavy.groupBy("node").agg(F.min(F.struct(gap.alias("gap"), F.col("row"))).alias("b")).collect()
    moved = [r["b"]["row"] for r in best if r["b"]["gap"] < abs(excess[r["node"]])]
    upper = ~lower if not moved else lower == F.col("row").isin(moved)
    return rows.withColumn("node", F.col("node") * 2 + upper.cast("int")).drop("at")


def kd_shards(docs: DataFrame, levels: int = 4, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Puts rows into 2**levels shards of nearly equal bytes (law ``bytes``).

    The target of a leaf is the total over 2**levels. Each row gets its shard, a
    gapless slot in it, its size and the checksum of its text.
    """
    rows = materialize(_points(docs, id_col, text_col, source_col, lang_col).withColumns({"node": F.lit(0), "row": F.monotonically_increasing_id()}))
    first = rows.agg(*(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max)))).first()
    spans = {d: (first[f"lo_{d}"] or 0.0, first[f"hi_{d}"] or 0.0) for d in DIMENSIONS}
    for level in range(levels):
        rows = materialize(_split_level(rows, 1 << level, spans))
    placed = number_rows(rows.withColumnRenamed("node", "shard"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
