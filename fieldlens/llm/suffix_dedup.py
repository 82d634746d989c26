"""Exact removal of repeated byte strings with sharded suffix arrays.

Every byte covered by a ``length``-byte string that also starts anywhere else
(in another text or the same one) is removed. The corpus is not sorted as one
string. Each window of ``length`` bytes has an anchor: the k-byte string in it
with the smallest hash, the first one of equals. Equal windows have equal
anchors at equal places, so only windows with the same anchor need comparing.
Consecutive windows with one anchor form a context, the unit of work.

1. Anchors with a hash of their context are counted. Equal contexts are merged
   before anything is shuffled further: a context seen twice is repeated as a
   whole, and one copy of it stands for all.
2. Unlike contexts with the same anchor are split by where a window reaches
   farther from the anchor, left or right, and meet by a hash of anchor and the
   bytes on that side. Those that meet another go to a shard. Each shard's
   suffix array (induced sorting) and permuted common prefixes give the windows
   that occur at two places or more.
3. A meeting of very many unlike contexts would overfill a shard. Its windows
   are counted by hash instead, as rows spread over all tasks: exact as well,
   without a group.
4. Each text's covered ranges are merged and cut out.

A text is identified by a 64-bit hash of id and bytes; equal rows count as two
texts, so each repeats the other. Null text counts as empty. Texts shorter than
``length`` lose nothing. Very long texts are read in overlapping stretches.
Anchors of equal hash within a window are a tie that the first wins. An empty
table gives an empty result. Columns besides id and text keep their names and
values, whatever these are. Bytes 0xFF, which UTF-8 never has, separate contexts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm import textkit as tk
from fieldlens.llm.suffix_array import permuted_lcp, suffix_array
from fieldlens.plans.lineage import materialize

#: Bytes of an anchor.
ANCHOR = 40


def _slide(x: np.ndarray, w: int, op: np.ufunc, empty: int) -> np.ndarray:
    """op over every w neighbours, in linear time."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate((x, np.full(pad, np.uint64(empty)))).reshape(-1, w)
    up = op.accumulate(y, axis=1).ravel()
    down = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(down[:n], up[w - 1 : w - 1 + n])


#: Low bits of a window key hold a position in the buffer, which has 16 MB at most.
_PLACE = np.uint64((1 << 24) - 1)


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, most: int = 1 << 20) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """First text and contexts of each stretch of about ``most`` bytes. A longer text is taken in stretches that share ``length`` - 1 bytes, so each of its windows lies in one of them; a context that a stretch cuts in two is two contexts."""
    for a, b, d, o in tk.chunks(data, offsets, most):
        if b > a + 1 or len(d) <= 2 * most:
            yield a, anchors(d, o, length)
            continue
        for at in range(0, len(d) - length + 1, most):
            part = d[at : at + most + length - 1]
            found = anchors(part, np.array([0, len(part)]), length)
            yield a, found | {k: found[k] + at for k in ("low", "high", "at")}


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """One entry per context: text number, first and last window start and anchor position (all in the text), hashes of anchor, context and the bytes left and right of the anchor (0: no window reaches half of the rest there)."""
    names = ("doc", "low", "high", "at", "anchor", "context", "left", "right")
    if len(data) < length or not (np.diff(offsets) >= length).any():
        return {k: np.zeros(0, np.int64) for k in names}
    roll = tk.Rolling(data)
    h = roll.windows(ANCHOR)
    least = _slide((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - ANCHOR + 1, np.minimum, 2**64 - 1)
    sizes = np.diff(offsets)
    long = sizes >= length
    edge = np.zeros(len(least) + 1, np.int32)
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(edge[: len(least)]) > 0)
    at = (least[start] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    low, high, at = start[first], start[np.concatenate((first[1:], [len(start)])) - 1], at[first]
    half = (length - ANCHOR) // 2
    context = tk.mix(roll.of(low, high + length) ^ tk.mix((at - low).astype(np.uint64) * np.uint64(1 << 20) + (high - low).astype(np.uint64)))
    left = np.where(at - low >= half, roll.of(np.maximum(at - half, 0), at) | np.uint64(1), np.uint64(0))
    end = np.minimum(at + length - half, len(data))
    right = np.where(at - high < half, roll.of(at + ANCHOR, end) | np.uint64(1), np.uint64(0))
    doc = np.searchsorted(offsets, low, "right") - 1
    base = offsets[doc]
    return dict(zip(names, (doc, low - base, high - base, at - base, h[at], context, left, right), strict=True))


def repeated_windows(contexts: list[bytes], owner: np.ndarray, start: np.ndarray, copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Context number and offset of windows that occur at two places or more.

    ``owner`` and ``start`` say which text a context is from and where it begins,
    so that overlapping contexts don't take one place for two.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    s = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)
    first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    sa = suffix_array(s)
    lcp = permuted_lcp(s, sa, first, int(sizes.max()) + 8)[sa]
    which = np.repeat(np.arange(len(contexts)), sizes + 1)[sa]
    inside = sa - first[which]
    full = inside + length <= sizes[which]
    lcp[1:][~(full[1:] & full[:-1])] = 0
    lcp[0] = 0
    run = np.flatnonzero(lcp < length)
    place = tk.mix(owner[which].astype(np.uint64) ^ tk.mix((start[which] + inside).astype(np.uint64)))
    many = np.maximum.reduceat(copies[which], run) > 1
    twice = (np.minimum.reduceat(place, run) != np.maximum.reduceat(place, run)) | many
    hit = np.repeat(twice, np.diff(np.concatenate((run, [len(sa)])))) & full
    return which[hit], inside[hit]


def _spans(key: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges windows of one key that overlap or touch: key, start, end."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + length)
    at = np.flatnonzero(fresh)
    return key[at], start[at], start[np.concatenate((at[1:], [len(key)]))[: len(at)] - 1] + length if len(at) else start


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.withColumn("__data", data).withColumn("__rid", F.xxhash64(F.col(id_col), F.col("__data")))


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 20, most_contexts: int = 1000, batch_bytes: int = 4 << 20) -> DataFrame:
    """rid, spans: for each text with repeated strings, its covered byte ranges (low, high), unmerged."""
    half = (length - ANCHOR) // 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.raw(batch.column(1).cast(pa.binary()).view(pa.string()))
            rid = batch.column(0).to_numpy()
            for a, x in anchors_of(data, offsets, length):
                # first window, anchor's distance from it and number of further windows in one number; so are the two sides
                place = (x["low"] << 20) | ((x["at"] - x["low"]) << 10) | (x["high"] - x["low"])
                sides = (x["left"].astype(np.uint64) >> np.uint64(32) << np.uint64(32)) | (x["right"].astype(np.uint64) >> np.uint64(32))
                cols = [x["anchor"].view(np.int64), x["context"].view(np.int64), rid[a + x["doc"]], place, sides.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "context", "rid", "place", "sides"])

    texts = _keyed(docs, text_col, id_col)
    found = texts.filter(F.octet_length("__data") >= length).select("__rid", "__data").mapInArrow(tk.tidy(find), "anchor long, context long, rid long, place long, sides long")
    # anchors seen once can't be part of a repetition
    again = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1")).filter("n > 1")
    again = materialize(again.select(F.col("anchor").alias("a"), (F.col("c0") == F.col("c1")).alias("alike")))
    shared = materialize(found.join(again, F.col("anchor") == F.col("a")).drop("a"))
    low, first, more = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(1023), F.col("place").bitwiseAND(1023)
    span = [low.cast("int").alias("low"), (low + more + length).cast("int").alias("high")]

    unlike = shared.filter(~F.col("alike"))
    kinds = materialize(unlike.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "place", "sides")).alias("one")))
    many = kinds.filter("copies > 1").select(F.col("anchor").alias("a"), F.col("context").alias("c"))
    whole = shared.filter("alike").select("rid", *span).unionByName(unlike.join(many, (F.col("anchor") == F.col("a")) & (F.col("context") == F.col("c"))).select("rid", *span))

    # windows whose anchor begins at least half of the rest behind their start meet by the bytes left of it, the others by those right of it
    one = kinds.select("anchor", "copies", "one.*")
    side = lambda name, value, begin, end: one.filter(value != 0).select(F.xxhash64("anchor", F.lit(name), value).alias("meeting"), "copies", "rid", begin.cast("int").alias("low"), (end + length).cast("int").alias("high"))
    at = low + first
    left = side("left", F.shiftrightunsigned("sides", 32), low, F.least(low + more, at - half))
    right = side("right", F.col("sides").bitwiseAND(0xFFFFFFFF), F.greatest(low, at - half + 1), low + more)
    members = left.unionByName(right)
    crowd = members.groupBy("meeting").agg(F.count(F.lit(1)).alias("contexts"), F.min("copies").alias("fewest")).filter("contexts > 1 and fewest = 1")
    crowd = materialize(crowd.select(F.col("meeting").alias("m"), (F.col("contexts") > most_contexts).alias("crowded")))
    members = materialize(members.join(crowd, F.col("meeting") == F.col("m")).drop("m"))
    n_shards = max(1, -(-(members.agg(F.sum(F.col("high") - F.col("low"))).first()[0] or 0) // shard_bytes))
    wanted = members.groupBy("rid").agg(F.collect_set(F.struct("low", "high", "copies", "meeting", "crowded")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.raw(batch.column(1).view(pa.string()))
            cuts = batch.column(2)
            flat, n = cuts.flatten(), cuts.value_lengths().fill_null(0).to_numpy()
            row = np.repeat(np.arange(len(batch)), n)
            meeting, copies, low, high = (pc.struct_field(flat, k).to_numpy() for k in ("meeting", "copies", "low", "high"))
            crowded, rid = pc.struct_field(flat, "crowded"), batch.column(0).to_numpy()[row]
            begin, size = offsets[row] + low, (high - low).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(size)))
            a = 0
            while a < len(size):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + batch_bytes, "right")) - 1)
                taken = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends[a : b + 1] - ends[a]).astype(np.int32).tobytes()), pa.py_buffer(data[tk.ragged(begin[a:b], size[a:b])].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(meeting[a:b] % n_shards), pa.array(meeting[a:b]), crowded.slice(a, b - a), pa.array(copies[a:b]), pa.array(rid[a:b]), pa.array(low[a:b]), taken], schema=shape)
                a = b

    shape = pa.schema([("shard", pa.int64()), ("meeting", pa.int64()), ("crowded", pa.bool_()), ("copies", pa.int64()), ("rid", pa.int64()), ("low", pa.int32()), ("bytes", pa.binary())])
    one_of_each = texts.select("__rid", "__data").join(wanted, F.col("__rid") == F.col("rid")).select("rid", F.col("__data").alias("data"), "cuts")
    contexts = materialize(one_of_each.mapInArrow(tk.tidy(cut), "shard long, meeting long, crowded boolean, copies long, rid long, low int, bytes binary"))

    def sort_shard(table: pa.Table) -> pa.Table:
        rid, low, copies = (table.column(c).to_numpy() for c in ("rid", "low", "copies"))
        which, inside = repeated_windows(table.column("bytes").to_pylist(), rid, low.astype(np.int64), copies, length)
        own = copies[which] == 1
        which, inside = which[own], inside[own]
        key, start, end = _spans(rid[which], low[which] + inside, length)
        return pa.table({"rid": pa.array(key, pa.int64()), "low": pa.array(start.astype(np.int32)), "high": pa.array(end.astype(np.int32))})

    sorted_out = contexts.filter("not crowded").groupBy("shard").applyInArrow(tk.tidy(sort_shard), "rid long, low int, high int")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.raw(batch.column(4).view(pa.string()))
            for a, b, d, o in tk.chunks(data, offsets):
                n = np.maximum(np.diff(o) - length + 1, 0)
                at = tk.ragged(o[:-1], n)
                row = np.repeat(np.arange(a, b), n)
                meeting, copies, rid, low = (batch.column(i).to_numpy()[row] for i in range(4))
                start = low + at - o[row - a]
                h = tk.Rolling(d).of(at, at + length) ^ tk.mix(meeting.view(np.uint64))
                place = tk.mix(rid.view(np.uint64) ^ tk.mix(start.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h.view(np.int64), place.view(np.int64), copies, rid, start.astype(np.int32))], ["h", "place", "copies", "rid", "low"])

    spans = whole.unionByName(sorted_out)
    if not crowd.filter("crowded").isEmpty():
        crowded = materialize(contexts.filter("crowded").select("meeting", "copies", "rid", "low", "bytes").mapInArrow(tk.tidy(windows), "h long, place long, copies long, rid long, low int"))
        twice = crowded.groupBy("h").agg(F.min("place").alias("p0"), F.max("place").alias("p1"), F.max("copies").alias("c")).filter("p0 <> p1 or c > 1").select(F.col("h").alias("k"))
        counted = crowded.filter("copies = 1").join(materialize(twice), F.col("h") == F.col("k"))
        spans = spans.unionByName(counted.select("rid", "low", (F.col("low") + length).alias("high")))
    return spans.groupBy("rid").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the ranges cover."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    fresh = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1]))) if len(low) else np.zeros(0, np.int64)
    return low[fresh], high[np.concatenate((fresh[1:], [len(low)]))[: len(fresh)] - 1]


def dedup(docs: DataFrame, keep: list[str], length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """The ``keep`` columns, n_bytes, n_removed, n_spans and kept_sha256 of every row; with_text adds the remaining text, without bytes of characters that were cut in half (null text: empty).

    All columns are of the input's rows; nothing is dropped, repeated or reordered within a row.
    """
    spans = repeated_spans(docs, length, id_col, text_col)
    texts = _keyed(docs, text_col, id_col)

    names, kinds = tk.kept(docs, keep)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 2
            out: list[list] = [[], [], [], [], []]
            flat, spans_of = batch.column(n + 1).flatten(), batch.column(n + 1).value_lengths().fill_null(0).to_numpy()
            lows, highs = (pc.struct_field(flat, k).to_numpy().astype(np.int64) for k in ("low", "high"))
            at = np.concatenate(([0], np.cumsum(spans_of)))
            for i in range(len(batch)):  # one text and its ranges at a time, however many a batch has
                data = batch.column(n)[i].as_py()
                low, high = merged(lows[at[i] : at[i + 1]], highs[at[i] : at[i + 1]])
                rest = b"".join([data[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(data)], strict=True)])
                for column, v in zip(out, (len(data), len(data) - len(rest), len(low), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else ""), strict=True):
                    column.append(v)
            cols = [*(batch.column(i) for i in range(n)), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(out[4], pa.string())] * with_text, [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text)

    spans = spans.select(F.col("rid").alias("__of"), F.col("spans").alias("__spans"))
    joined = texts.select(*keep, "__rid", "__data").join(spans, F.col("__rid") == F.col("__of"), "left").select(*keep, "__data", "__spans")
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    return joined.mapInArrow(tk.tidy(finish), f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text).toDF(*keep, *added)
