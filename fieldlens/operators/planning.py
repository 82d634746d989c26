"""Plans made in order: parts of limited size, quotas over seasons and periods, candidate pools dealt by tile."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import dates
from fieldlens.plans.lineage import materialize, rewritten

MIB = 1 << 20


def payload_limit(max_mib: int) -> int:
    """Bytes of files that a bundle part of so many MiB holds: 1 MiB, or 1 % if that is more, is left for manifests and headers."""
    return max(1, max_mib * MIB - max(MIB, max_mib * MIB // 100))


class Open(NamedTuple):
    """The part that is being filled: its key, its number, what it holds, and whether it holds a row."""

    key: int | None
    part: int
    used: int
    filled: bool


def fill(sizes: np.ndarray, state: Open, capacity: int) -> tuple[np.ndarray, Open]:
    """Part of each row of one key, in order, and the state after them."""
    upto = np.cumsum(sizes)
    parts = np.empty(len(sizes), np.int64)
    part, base, filled, i = state.part, -state.used, state.filled, 0
    while True:
        j = max(int(np.searchsorted(upto, base + capacity, "right")), i if filled else i + 1)
        parts[i:j] = part
        if j >= len(sizes):
            return parts, Open(state.key, part, int(upto[-1]) - base, True)
        part, base, filled, i = part + 1, int(upto[j - 1]) if j else 0, False, j


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return list(zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True))


def next_fit(df: DataFrame, key: str, order: list[str], size: str, capacity: int, into: str = "part") -> DataFrame:
    """Parts of at most ``capacity`` in the given order, never splitting a row: a new part opens when the next row doesn't fit. A larger row is a part of its own; null sizes count as 0.

    A key may hold most rows. Rows are sorted over all tasks and written once. How a
    partition's first key goes on depends on what the partition before left in
    the open part, and only by where its first new part opens: so a partition
    is summed up by one entry for each row that may open it, of which there
    are about as many as rows in a part. The driver chains these summaries, one a
    partition, and a second pass numbers the parts.
    """
    ranged = df.repartitionByRange(F.col(key), *(F.col(c) for c in order)).sortWithinPartitions(key, *order)
    placed = materialize(ranged.withColumns({"__k": F.xxhash64(key), "__s": F.coalesce(F.col(size).cast("long"), F.lit(0)), "__p": F.spark_partition_id()}))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)[0].as_py()) for b in batches if len(b)]
        if not held:
            return
        keys, sizes = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        runs = _runs(keys)
        a, b = runs[0]
        s = sizes[a:b]
        upto = np.cumsum(s)
        opens = np.arange(min(len(s), int(np.searchsorted(upto, capacity, "right")) + 1))  # rows that may be the first to open a part
        ends = [fill(s[j:], Open(None, 0, 0, False), capacity)[1] for j in opens.tolist()]
        last = fill(sizes[runs[-1][0] : runs[-1][1]], Open(None, 0, 0, False), capacity)[1]
        row = {
            "p": held[0][2], "first": int(keys[0]), "last": int(keys[-1]), "alone": len(runs) == 1, "total": int(upto[-1]),
            "upto": upto[opens].tolist(), "parts": [e.part for e in ends], "used": [e.used for e in ends], "end_part": last.part, "end_used": last.used,
        }
        yield pa.RecordBatch.from_pylist([row], schema=shape)

    longs = pa.list_(pa.int64())
    shape = pa.schema([("p", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("alone", pa.bool_()), ("total", pa.int64()), ("upto", longs), ("parts", longs), ("used", longs), ("end_part", pa.int64()), ("end_used", pa.int64())])
    ddl = "p long, first long, last long, alone boolean, total long, upto array<long>, parts array<long>, used array<long>, end_part long, end_used long"
    starts: dict[int, Open] = {}
    state = Open(None, 0, 0, False)
    for r in sorted(placed.select("__k", "__s", "__p").mapInArrow(summarise, ddl).collect(), key=lambda r: r["p"]):
        start = starts[r["p"]] = state if state.key == r["first"] else Open(r["first"], 0, 0, False)
        if r["alone"]:
            at = int(np.searchsorted(np.array(r["upto"]), capacity - start.used, "right")) if start.filled else 0
            if not start.filled:
                state = Open(r["last"], r["parts"][0], r["used"][0], True)
            elif at < len(r["upto"]):
                state = Open(r["last"], start.part + 1 + r["parts"][at], r["used"][at], True)
            else:
                state = Open(r["last"], start.part, start.used + r["total"], True)
        else:
            state = Open(r["last"], r["end_part"], r["end_used"], True)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            if not len(batch):
                continue
            keys, sizes, p = (batch.column(n + i).to_numpy() for i in range(3))
            now = starts[int(p[0])] if now is None else now
            parts = []
            for a, b in _runs(keys):
                got, now = fill(sizes[a:b], now if now.key == keys[a] else Open(int(keys[a]), 0, 0, False), capacity)
                parts.append(got)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.concatenate(parts).astype(np.int32))], names)

    n, names = len(df.columns), [*(f"c{i}" for i in range(len(df.columns))), "part"]
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))
    return placed.mapInArrow(number, f"{kinds}, part int").toDF(*df.columns, into)


def spaced_picks(df: DataFrame, key: str, order: list[str], day: str, days: int, most: int) -> DataFrame:
    """Greedy in order: a row is picked if fewer than ``most`` are and each picked day is at least so many days away; null days pass. Rows carry ``picked``.

    ``order`` tells a key's rows apart. Of one day only the first row can be picked, and of null days the first ``most``: with
    these alone the fold goes over as many entries as there are days, however many rows a key has.
    """
    if days < 1:
        raise ValueError("days is at least 1")
    first = df.filter(F.col(day).isNotNull()).groupBy(key, day).agg(F.min(F.struct(*order)).alias("o"))
    blank = df.filter(F.col(day).isNull()).groupBy(key).agg(F.min_by(F.struct(*order), F.struct(*order)).alias("o"))
    if most > 1:
        w = Window.partitionBy(key).orderBy(*order)
        blank = df.filter(F.col(day).isNull()).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).select(key, F.struct(*order).alias("o"))
    entries = first.select(key, "o", F.col(day).alias("d")).unionByName(blank.select(key, "o", F.lit(None).cast(df.schema[day].dataType).alias("d")))
    lists = entries.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("o", "d"))).alias("rows"))
    nothing = F.slice(F.col("rows"), 1, 0)

    def step(acc: Column, x: Column) -> Column:
        free = F.forall(acc, lambda p: F.coalesce(F.abs(F.datediff(x["d"], p["d"])) >= days, F.lit(True)))
        return F.when((F.size(acc) < most) & free, F.concat(acc, F.array(x))).otherwise(acc)

    picks = lists.select(F.col(key).alias("__key"), F.explode(F.aggregate("rows", nothing, step)).alias("p")).select("__key", *(F.col(f"p.o.{c}").alias(f"__{c}") for c in order), F.lit(True).alias("__picked"))
    same = F.col(key).eqNullSafe(F.col("__key"))
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(picks, same, "left").select(*df.columns, F.coalesce("__picked", F.lit(False)).alias("picked"))


#: Periods that scenes are sought for, as years from the event's own.
PERIODS = {"PRE": -1, "POST": 1}


def quota_grid(events: DataFrame, scenes: DataFrame, targets: dict[str, int], caps: dict[tuple[str, str], int], min_days: int) -> DataFrame:
    """What each event has and lacks: one row per event, period and season.

    events: sample_id, event_id, event_year. scenes: sample_id, scene_id, at (a
    time), checked, valid. A scene counts for every event of its sample whose
    period its year is, so it may fill several targets. Checked scenes count
    towards the season's cap. Valid ones are accepted in order of time while the
    season's target isn't met, at least ``min_days`` from the last one accepted
    for the event's period. Of one day only the first valid scene can be
    accepted, so the fold of a period goes over a year's days at most.
    """
    if min_days < 1:
        raise ValueError("min_days is at least 1")
    names = list(targets)
    season = dates.season(F.col("at"))
    periods = F.array(*(F.struct(F.lit(p).alias("period"), F.lit(s).alias("step")) for p, s in PERIODS.items()))
    relations = events.select("sample_id", "event_id", "event_year", F.inline(periods)).withColumn("year", F.col("event_year") + F.col("step"))
    seen = scenes.withColumns({"season": season, "y": F.year("at")}).filter(F.col("season").isin(*names)).withColumnRenamed("sample_id", "__s")
    met = relations.join(seen, (F.col("sample_id") == F.col("__s")) & (F.col("year") == F.col("y")))
    checked = met.filter("checked").groupBy("event_id", "period", "season").agg(F.count_distinct("scene_id").alias("qc"))
    days = met.filter("valid").groupBy("event_id", "period", F.to_date("at").alias("day")).agg(F.min(F.struct("at", "scene_id", "season")).alias("one"))
    lists = days.groupBy("event_id", "period").agg(F.sort_array(F.collect_list(F.struct("day", F.col("one.season").alias("season")))).alias("days"))
    zero = F.struct(F.lit(None).cast("date").alias("last"), *(F.lit(0).alias(n) for n in names))

    def step(acc: Column, x: Column) -> Column:
        wanted = F.lit(False)
        for n in names:
            wanted = wanted | ((x["season"] == n) & (acc[n] < targets[n]))
        take = wanted & F.coalesce(F.datediff(x["day"], acc["last"]) >= min_days, F.lit(True))
        return F.struct(F.when(take, x["day"]).otherwise(acc["last"]).alias("last"), *((acc[n] + (take & (x["season"] == n)).cast("int")).alias(n) for n in names))

    taken = lists.select("event_id", "period", F.aggregate("days", zero, step).alias("t"))
    grid = F.array(*(F.struct(F.lit(p).alias("period"), F.lit(n).alias("season"), F.lit(targets[n]).alias("target_valid"), F.lit(caps[p, n]).alias("max_qc_scenes")) for p in PERIODS for n in names))
    dense = events.select("sample_id", "event_id", "event_year", F.inline(grid))
    held = F.coalesce(*(F.when(F.col("season") == n, F.col(f"t.{n}")) for n in names), F.lit(0))
    rows = dense.join(taken, ["event_id", "period"], "left").join(checked, ["event_id", "period", "season"], "left").withColumns({"valid_count": held.cast("int"), "qc_checked_count": F.coalesce("qc", F.lit(0)).cast("int")})
    stop = F.when(F.col("valid_count") >= F.col("target_valid"), "target_reached").when(F.col("qc_checked_count") >= F.col("max_qc_scenes"), "qc_cap_reached")
    return rows.select("sample_id", "event_id", "event_year", "period", "season", "valid_count", "target_valid", F.greatest(F.col("target_valid") - F.col("valid_count"), F.lit(0)).alias("deficit"), "qc_checked_count", "max_qc_scenes", stop.alias("stop_reason"))


def batch_plan(samples: DataFrame, events: DataFrame, scenes: DataFrame, grid: DataFrame, empty_only: bool) -> DataFrame:
    """One row per sample: skipped with a reason, or planned with what it has, what it lacks and why it needs no work.

    samples: sample_id, too_old, validated. Reasons come in this order: too old; for
    ``empty_only``, reviewed by hand or with scenes already; without events.
    """
    has_scene = scenes.select("sample_id").distinct().withColumn("__scene", F.lit(True))
    n_events = events.groupBy("sample_id").agg(F.count(F.lit(1)).alias("event_count"))
    sums = grid.groupBy("sample_id").agg(
        F.sum("valid_count").alias("valid_count"), F.sum("target_valid").alias("target_valid"), F.sum("qc_checked_count").alias("qc_checked_count"), F.sum("max_qc_scenes").alias("max_qc_scenes"),
        F.bool_and(F.coalesce(F.col("stop_reason") == "target_reached", F.lit(False))).alias("__full"), F.bool_and(F.col("stop_reason").isNotNull()).alias("__stopped"),
    )
    joined = samples.join(has_scene, "sample_id", "left").join(n_events, "sample_id", "left").join(sums, "sample_id", "left")
    reason = F.when(F.col("too_old"), "too_old")
    if empty_only:
        reason = reason.when(F.col("validated"), "has_manual_validation").when(F.col("__scene"), "already_has_downloads")
    reason = reason.when(F.col("event_count").isNull(), "no_sample_events")
    stop = F.when(F.col("__full"), "target_reached").when(F.col("__stopped"), "qc_cap_reached")
    planned = reason.isNull()
    numbers = [F.when(planned, F.col(c)).alias(c) for c in ("event_count", "valid_count", "target_valid", "qc_checked_count", "max_qc_scenes")]
    return joined.select("sample_id", reason.alias("skip_reason"), *numbers, F.when(planned, F.greatest(F.col("target_valid") - F.col("valid_count"), F.lit(0))).alias("deficit"), F.when(planned, stop).alias("stop_reason"))


def deal_candidates(candidates: DataFrame, conflicts: DataFrame | Callable[[DataFrame, DataFrame], DataFrame], pool: int) -> DataFrame:
    """Candidates (id, tile, score) with decision and turn: tiles deal in order of their names, one candidate a turn, the best first; one that conflicts with a candidate accepted before is passed over.

    ``conflicts``: pairs (a, b), each once, in either order, or a function that finds the pairs (a of the
    first, b of the second) of two tables with the columns of ``candidates``: it is asked for a round's heads,
    one a tile, against the undecided, so pairs of others are never made. accepted rows have
    the turn they came in; passed-over ones are overlap; the rest, once the pool
    is full, is left. A candidate is decided as soon as nothing undecided that
    conflicts with it could come before it, so many tiles go on at once in each
    round, and no task holds a tile.
    """
    if isinstance(conflicts, DataFrame):
        both = materialize(conflicts.select("a", "b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())

        def meet(few: DataFrame, many: DataFrame) -> DataFrame:
            known = both.join(many.select(F.col("id").alias("__b")), F.col("b") == F.col("__b"), "left_semi")
            return known.join(few.select(F.col("id").alias("__a")), F.col("a") == F.col("__a"), "left_semi")
    else:
        meet = conflicts
    left = rewritten(candidates)
    accepted = left.select("id", "tile", F.lit(0).cast("long").alias("turn")).limit(0)
    overlap = left.select("id").limit(0)
    while True:
        turns = accepted.groupBy(F.col("tile").alias("t")).agg(F.max("turn").alias("had"))
        heads = left.groupBy("tile").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("h")).select("tile", F.col("h.id").alias("id"))
        heads = materialize(heads.join(turns, F.col("tile") == F.col("t"), "left").select("id", "tile", (F.coalesce("had", F.lit(0)) + 1).alias("turn")))
        coming = heads.select(F.struct("turn", "tile").alias("x"))
        if coming.isEmpty():
            break
        full = accepted.orderBy("turn", "tile").limit(pool).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("turn", "tile")).alias("last")).first()
        if full["n"] >= pool and coming.agg(F.min("x").alias("x")).first()["x"] > full["last"]:
            break
        # the earliest turn at which each undecided neighbour could come is its tile's next one
        first = rewritten(left.join(heads.select(F.col("id").alias("__h")), F.col("id") == F.col("__h"), "left_semi"))
        near = materialize(meet(first, left).filter("a <> b").select("a", "b").distinct())
        rivals = heads.select(F.col("id").alias("me"), F.struct("turn", "tile").alias("mine")).join(near, F.col("me") == F.col("a"))
        rivals = rivals.join(left.select(F.col("id").alias("other"), F.col("tile").alias("ot")), F.col("b") == F.col("other")).join(heads.select(F.col("tile").alias("ht"), F.struct("turn", "tile").alias("theirs")), F.col("ot") == F.col("ht"))
        waiting = rivals.filter("theirs < mine").select(F.col("me").alias("w")).distinct()
        sure = materialize(heads.join(waiting, F.col("id") == F.col("w"), "left_anti"))
        passed = materialize(sure.join(near, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct())
        accepted, overlap = materialize(accepted.unionByName(sure)), overlap.unionByName(passed)
        left = rewritten(left.join(sure.select(F.col("id").alias("x")).unionByName(passed.select(F.col("id").alias("x"))), F.col("id") == F.col("x"), "left_anti"))
    kept = materialize(accepted.orderBy("turn", "tile").limit(pool).join(candidates.select(F.col("id").alias("k"), "score"), F.col("id") == F.col("k")).select("k", "tile", "turn", "score"))
    end = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("turn", "tile")).alias("last")).first()
    # a candidate's tile came to it in the turn after its accepted candidates before it: at most ``pool`` rows in all
    own = kept.groupBy(F.col("tile").alias("t")).agg(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("k").alias("id"))).alias("taken"))
    joined = candidates.join(kept.select("k", "turn"), F.col("id") == F.col("k"), "left").join(overlap.select(F.col("id").alias("o"), F.lit(True).alias("__o")), F.col("id") == F.col("o"), "left")
    joined = joined.join(F.broadcast(own), F.col("tile") == F.col("t"), "left")
    before = F.coalesce(F.size(F.filter("taken", lambda x: x < F.struct((-F.col("score")).alias("s"), F.col("id").alias("id")))), F.lit(0))
    came = F.lit(True) if end["n"] < pool else F.struct((before + 1).cast("long").alias("turn"), F.col("tile").alias("tile")) <= F.struct(F.lit(end["last"]["turn"]).alias("turn"), F.lit(end["last"]["tile"]).alias("tile"))
    decision = F.when(F.col("turn").isNotNull(), "accepted").when(F.col("__o") & came, "overlap").otherwise("left")
    return joined.select(*candidates.columns, decision.alias("decision"), "turn")
