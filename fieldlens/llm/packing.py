"""Best-fit packing of tokenised documents by exact-complement hashing.

Texts become token ids plus an end id; only documents longer than a sequence
are cut. What is packed are lengths, and lengths are few: the plan is made over
their counts. The longest open length is completed by a single length, a pair
or a triple that fills its gap exactly, looked up in indexes of length sums
and used as often as the counts allow; what has no exact complement is filled
by best fit. Each step uses up a length, so the plan has about as many patterns
as there are lengths (at most ``capacity``), however many documents there are.
Pieces then find their places by their number within their length.

Null and empty texts are one piece holding the end id. Rows with equal or null
ids, repeated rows and equal lengths are packed separately, each in a place of
its own; equal rows may change places. Very long texts are encoded in slices
and give as many pieces as they need. Other columns, whatever their names, are
left out. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from fieldlens.llm import textkit as tk
from fieldlens.plans.lineage import materialize
from fieldlens.plans.numbering import number_rows

#: The characters that the vocabulary's split pattern takes as white space.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A long run of white space with what follows up to the next one.
_LONG = re.compile(f"[{_WHITE}]{{512,}}[^{_WHITE}]*")
_CUT = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
_INSIDE = re.compile(f"(?<=[A-Za-z])(?=[A-Za-z])|(?<=[0-9])(?=[0-9])|(?<=[{_WHITE}])(?=[{_WHITE}]{{2}})")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of a byte-level BPE given in the JSON form of the ``tokenizers`` library.

    Two libraries read the one vocabulary: ``tiktoken``, the faster, takes
    ordinary text, ``tokenizers`` what the other's pattern matching can't (very
    long white space). Both see stretches that no piece of the split pattern crosses: the
    pattern never takes white space behind another character into the same
    piece, and merges stay inside pieces, so cuts before white space change no
    id. A long run is cut further between two letters, two digits or two white
    spaces that stand side by side in no token, as no merge can join them. The
    end-of-text string in a text is its special id, in both libraries.
    """

    def __init__(self, path: str, slice_chars: int = 1 << 18):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        special = {t["content"]: t["id"] for t in form["added_tokens"]}
        # the JSON form writes each byte as a printable character: itself where it is one, else the next one from 256
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        self.ranks = {bytes(byte_of[c] for c in token): i for token, i in form["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=special)
        self.path, self.slice_chars = path, slice_chars

    @cached_property
    def library(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def joined(self) -> set[bytes]:
        """Pairs of bytes that stand side by side in a token."""
        return {token[k : k + 2] for token in self.ranks for k in range(len(token) - 1)}

    @staticmethod
    def load(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _long(self, run: str) -> Iterator[np.ndarray]:
        at = 0
        for m in _INSIDE.finditer(run):
            p = m.start()
            if p - at >= 1024 and run[p - 1].encode()[-1:] + run[p].encode()[:1] not in self.joined:
                yield np.array(self.library.encode(run[at:p], add_special_tokens=False).ids, "<u4")
                at = p
        yield np.array(self.library.encode(run[at:], add_special_tokens=False).ids, "<u4")

    def _slices(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > self.slice_chars:
                cut = _CUT.search(text, at + self.slice_chars)
                end = cut.start() if cut else end
            part = text[at:end]
            done = 0
            for m in _LONG.finditer(part):
                yield self.fast.encode_to_numpy(part[done : m.start()], allowed_special="all")
                yield from self._long(m[0])
                done = m.end()
            yield self.fast.encode_to_numpy(part[done:], allowed_special="all")
            at = end

    def encode(self, text: str) -> np.ndarray:
        """The text's ids."""
        return np.concatenate([np.zeros(0, "<u4"), *self._slices(text)]).astype("<u4")


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", batch_pieces: int = 1 << 16) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Of a cut document, the first piece is the short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Encoder.load(vocabulary)

        def made(owner: pa.Array, source: list[int], rows: list[tuple]) -> pa.RecordBatch:
            a = np.array(rows, np.int64).reshape(len(rows), 4)
            return pa.RecordBatch.from_arrays([owner.take(pa.array(source, pa.int64())), pa.array(a[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(a[:, j])) for j in (1, 2, 3))], ["doc_id", "piece", "start", "length", "ids_crc32"])

        for batch in batches:
            source, rows = [], []
            for i, text in enumerate(tk.as_strings(batch.column(1))):
                ids = np.append(code.encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                end = len(ids) - (len(ids) - 1) // capacity * capacity
                start, k = 0, 0
                while start < len(ids):
                    source.append(i)
                    rows.append((k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, k = end, end + capacity, k + 1
                if len(rows) > batch_pieces:
                    yield made(batch.column(0), source, rows)
                    source, rows = [], []
            yield made(batch.column(0), source, rows)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tk.tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Pattern(NamedTuple):
    """Lengths that share a sequence, and how many sequences look so."""

    lengths: tuple[int, ...]
    times: int


def _fits(lengths: tuple[int, ...], counts: np.ndarray) -> int:
    """How often the combination can be taken."""
    return min(int(counts[x]) // k for x, k in Counter(lengths).items())


class SumIndex:
    """Which single lengths, pairs and triples of lengths have a given sum.

    ``pairs[s]`` holds the larger members of pairs with sum s, ``triples[s]`` the
    largest members of triples, both descending, of the lengths that there were
    at first. A lookup passes over entries whose lengths have been used up.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        have, top = np.flatnonzero(counts), len(counts) - 1
        self.pairs = self._by_sum(have, have, top)
        sums = np.array([s for s, members in enumerate(self.pairs) if len(members)], np.int64)
        self.triples = self._by_sum(have, sums, top)

    @staticmethod
    def _by_sum(lengths: np.ndarray, others: np.ndarray, top: int) -> list[np.ndarray]:
        """For each sum up to top: the lengths that reach it with one of ``others``, from the largest down."""
        reached = [np.zeros(0, np.int64)] * (top + 1)
        is_other = np.zeros(top + 1, bool)
        is_other[others] = True
        for s in range(1, top + 1):
            a = lengths[lengths < s]
            reached[s] = a[is_other[s - a]][::-1]
        return reached

    def single(self, total: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        return (total,) if self.counts[total] and _fits((*taken, total), self.counts) else None

    def pair(self, total: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        members = self.pairs[total]
        for a in members[(self.counts[members] > 0) & (self.counts[total - members] > 0) & (2 * members >= total)].tolist():
            if _fits((*taken, a, total - a), self.counts):
                return a, total - a
        return None

    def triple(self, total: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        members = self.triples[total]
        for a in members[(self.counts[members] > 0) & (3 * members >= total)].tolist():
            rest = self.pair(total - a, (*taken, a)) if _fits((*taken, a), self.counts) else None
            if rest:
                return (a, *rest)
        return None

    def complement(self, first: int, gap: int) -> tuple[int, ...] | None:
        """Available lengths that sum to the gap beside ``first``: one, else two, else three, the largest first."""
        return self.single(gap, (first,)) or self.pair(gap, (first,)) or self.triple(gap, (first,))


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up all counts; the longest lengths are placed first."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    index = SumIndex(left)
    out = []
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        gap = capacity - first
        exact = index.complement(first, gap) if gap else ()
        chosen = (first, *(exact or ()))
        if exact is None:  # best fit: the largest length that still goes in, again and again
            while gap > 0:
                room = left[: gap + 1].copy()
                for x in chosen:
                    if x <= gap:
                        room[x] -= 1
                fit = np.flatnonzero(room > 0)
                if not len(fit):
                    break
                chosen += (int(fit[-1]),)
                gap -= int(fit[-1])
        times = _fits(chosen, left)
        for x in chosen:
            left[x] -= times
        out.append(Pattern(chosen, times))
    return out


def places(patterns: list[Pattern]) -> list[Row]:
    """Per pattern and slot: which numbers of a length go where."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append(Row(p_length=x, low=used[x], high=used[x] + times, first_sequence=sequence, offset=offset))
            used[x] += times
            offset += x
        sequence += times
    return rows


def pack(found: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), which should be cheap to read more than once."""
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    spark = found.sparkSession
    table = spark.createDataFrame(places(plan(counts, capacity)), "p_length long, low long, high long, first_sequence long, offset long")
    numbered = number_rows(found, ["length"], ["doc_id", "piece", "ids_crc32"], "number")
    here = (F.col("length") == F.col("p_length")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))
    placed = numbered.join(F.broadcast(table), here)  # at most capacity x patterns rows, whatever the corpus
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("number") - F.col("low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024) -> DataFrame:
    """Tokenises, cuts and packs all documents. ``vocabulary``: path of a byte-level BPE in the JSON form of ``tokenizers``."""
    return pack(materialize(pieces(docs.select("doc_id", "text"), vocabulary, capacity)), capacity)
