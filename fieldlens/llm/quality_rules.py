"""Quality filtering by a learned decision list.

Text statistics are computed for every document. From labelled documents,
sequential covering learns rules that mark low quality: a rule grows one
threshold condition at a time on two thirds of the rows, is pruned on the
rest, and is kept while it stays precise; covered rows go, and the next rule
starts. The list becomes one ordered Spark ``CASE WHEN``.

Null and empty texts have no words, so they fail the base rule (fewer than 20
words). Equal texts get equal verdicts, each row its own; of conditions that gain
alike the first in order is taken. Very long texts are counted in stretches.
With no labelled row the list is empty and only the base rule decides; an empty
table gives an empty result. Kept columns may have any names but those of the
statistics, which would be taken for them: rename such columns first, as the
pipeline does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm import textkit as tk

#: Words in a window whose second occurrence counts as repetition.
WINDOW = 8
_CHAR = np.zeros((6, 256), np.int32)
_CHAR[0] = (np.arange(256) & 0xC0) != 0x80  # starts of code points
for _i, _set in enumerate((b"#*$%&|<>", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b".,;:"), 1):
    _CHAR[_i, list(_set)] = 1
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_EXTRA = ["n_digits", "n_upper", "n_marks", "n_stops", "n_lines", "n_distinct_words", "longest_word"]


class Counted(NamedTuple):
    """What is known of a stretch of texts: sums and longest word of each text, hashes of words and of lines that hold a word, with their text numbers."""

    sums: np.ndarray
    longest: np.ndarray
    words: np.ndarray
    word_doc: np.ndarray
    lines: np.ndarray
    line_doc: np.ndarray


def _counted(data: np.ndarray, offsets: np.ndarray, with_lines: bool = True) -> Counted:
    n = len(offsets) - 1
    begin, end, doc = tk.words(data, offsets)
    sums = np.zeros((6, len(data) + 1), np.int64)
    for i in range(6):
        np.cumsum(_CHAR[i][data], out=sums[i, 1:])
    per = [s[offsets[1:]] - s[offsets[:-1]] for s in sums[1:]]
    size = sums[0][end] - sums[0][begin]
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, size)
    roll = tk.Rolling(data)
    totals = np.stack([np.bincount(doc, size, n).astype(np.int64), *per], 1)
    if not with_lines:
        return Counted(totals, longest, tk.range_hashes(data, roll, begin, end), doc, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    # lines: from a text's start or after \n to the next \n or the text's end
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    first, line_doc = np.concatenate((offsets[:-1], breaks + 1)), np.concatenate((np.arange(n), owner))
    order = np.lexsort((first, line_doc))
    first, line_doc = first[order], line_doc[order]
    last = np.sort(np.concatenate((breaks, offsets[1:])))
    has_word = np.searchsorted(begin, last) > np.searchsorted(begin, first)
    first, last, line_doc = first[has_word], last[has_word], line_doc[has_word]
    return Counted(totals, longest, tk.range_hashes(data, roll, begin, end), doc, tk.range_hashes(data, roll, first, last), line_doc)


def _stretches(data: np.ndarray, most: int) -> Iterator[tuple[int, int, bool]]:
    """Ranges of one long text of about ``most`` bytes: of whole lines, or (False) of whole words of a line that is longer."""
    breaks = np.flatnonzero(data == 10)
    at = 0
    while at < len(data):
        k = int(np.searchsorted(breaks, at + most))
        end = int(breaks[k]) + 1 if k < len(breaks) else len(data)
        if end - at > 2 * most:  # a very long line ends here; lines before it come first
            line = int(breaks[k - 1]) + 1 if k and breaks[k - 1] >= at else at
            if line > at:
                yield at, line, True
            for low, high in tk.parts(data[line:end], most):
                yield line + low, line + high, False
        else:
            yield at, end, True
        at = end


def _long(data: np.ndarray, most: int) -> Counted:
    """_counted of one long text, put together from its stretches."""
    found, whole = [], 0
    for low, high, lines in _stretches(data, most):
        part = data[low:high]
        c = _counted(part, np.array([0, len(part) - (lines and part[-1] == 10)]), lines)
        if not lines:  # the line is hashed as one
            ends = high == len(data) or data[high - 1] == 10
            line = data[whole : high - (data[high - 1] == 10)] if ends else data[:0]
            if ends and not tk.SPACE[line].all():
                c = c._replace(lines=np.array([tk.long_hash(line)], np.uint64), line_doc=np.zeros(1, np.int64))
        if lines or ends:
            whole = high
        found.append(c)
    return Counted(sum(c.sums for c in found), np.maximum.reduce([c.longest for c in found]), *(np.concatenate(x) for x in list(zip(*found, strict=True))[2:]))


def _finished(c: Counted) -> np.ndarray:
    n = len(c.longest)
    own = lambda doc: tk.mix(doc.astype(np.uint64) + np.uint64(1))
    distinct = lambda hashes, doc: np.bincount(doc[np.unique(tk.mix(hashes + own(doc)), return_index=True)[1]], minlength=n)
    doc = c.word_doc
    windows = tk.combine(c.words, WINDOW)
    inside = np.flatnonzero(doc[: len(windows)] == doc[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    _, which, count = np.unique(tk.mix(windows[inside] + own(doc[inside])), return_inverse=True, return_counts=True)
    twice = inside[count[which] > 1]
    edge = np.bincount(twice, minlength=len(doc) + 1)[: len(doc) + 1] - np.bincount(twice + WINDOW, minlength=len(doc) + 1)[: len(doc) + 1]
    repeated = np.bincount(doc, np.cumsum(edge)[:-1] > 0, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
    lines = np.bincount(c.line_doc, minlength=n)
    chars, symbols, digits, upper, marks, stops = c.sums.T
    return np.stack([np.bincount(doc, minlength=n), chars, symbols, lines - distinct(c.lines, c.line_doc), repeated, digits, upper, marks, stops, lines, distinct(c.words, doc), c.longest], 1).astype(np.int64)


def statistics(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """One row per text: the columns of _COUNTS, then those of _EXTRA. Of a text longer than ``most`` bytes only hashes of its words and lines are held at once."""
    rows = [np.zeros((0, 12), np.int64)]
    for a, b, d, o in tk.chunks(data, offsets, most):
        rows.append(_finished(_long(d, most) if b == a + 1 and len(d) > most else _counted(d, o)))
    return np.concatenate(rows)


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and the statistics of the whole text, as longs."""
    columns = keep if text_col in keep else [*keep, text_col]
    names, kinds = tk.kept(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.raw(batch.column(columns.index(text_col)))
            rows = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], [*names, *_COUNTS, *_EXTRA])

    return docs.select(*columns).mapInArrow(tk.tidy(run), ", ".join([kinds, *(f"{c} long" for c in _COUNTS + _EXTRA)])).toDF(*keep, *_COUNTS, *_EXTRA)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Rates the rules read, each as numerator, denominator.
RATES = {
    "mean_word_chars": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "digit_share": ("n_digits", "word_chars"), "upper_share": ("n_upper", "word_chars"), "marks_per_word": ("n_marks", "n_words"), "stops_per_word": ("n_stops", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"), "words_per_line": ("n_words", "n_lines"),
}
PLAIN = ("n_words", "longest_word", "n_symbols")


def rate(name: str) -> Column:
    if name in PLAIN:
        return F.col(name).cast("double")
    a, b = RATES[name]
    return F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))


@dataclass
class Rule:
    """Conditions (feature, ">=" or "<", threshold) that all must hold, with the precision seen in pruning."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)
    precision: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, side, bar in self.conditions:
            out = out & (rate(name) >= bar if side == ">=" else rate(name) < bar)
        return out

    def mask(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, side, bar in self.conditions:
            v = x[:, names.index(name)]
            out &= v >= bar if side == ">=" else v < bar
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {b:.6g}" for n, s, b in self.conditions)


def _best_condition(x: np.ndarray, bad: np.ndarray, held: np.ndarray, names: list[str]) -> tuple[float, tuple[str, str, float] | None]:
    """The threshold that gains most information on the bad rows still covered."""
    p0, n0 = bad[held].sum(), held.sum()
    before, best = np.log2(p0 / n0), (0.0, None)
    for j, name in enumerate(names):
        v = x[held, j]
        order = np.argsort(v, kind="stable")
        v, y = v[order], bad[held][order]
        cut = np.flatnonzero(np.diff(v) > 0) + 1
        if not len(cut):
            continue
        below = np.concatenate(([0], np.cumsum(y)))[cut]
        for side, p, n in (("<", below, cut), (">=", p0 - below, n0 - cut)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / n) - before), 0)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), (name, side, float((v[cut[k] - 1] + v[cut[k]]) / 2)))
    return best


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], least_precision: float = 0.8, least_rows: int = 3, most_rules: int = 24, most_conditions: int = 4) -> list[Rule]:
    """Sequential covering: grow, prune, keep while precise, remove what is covered."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    rng = np.random.default_rng(11)
    part = rng.permutation(len(x)) % 3
    misses = 0
    while (bad & left).sum() >= least_rows and len(rules) < most_rules and misses < 3:
        grow, prune = left & (part != len(rules) % 3), left & (part == len(rules) % 3)
        if not (bad & grow).any():
            break
        rule, held = Rule(), grow.copy()
        while bad[held].mean() < 1 and len(rule.conditions) < most_conditions:
            _, condition = _best_condition(x, bad, held, names)
            if condition is None:
                break
            rule.conditions.append(condition)
            held = grow & rule.mask(x, names)

        def worth(r: Rule) -> tuple[float, int]:
            m = prune & r.mask(x, names)
            p = (bad & m).sum()
            return ((2 * p - m.sum()) / m.sum() if m.any() else -1.0, -len(r.conditions))

        if rule.conditions:
            rule = max((Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)), key=worth)
        m = left & rule.mask(x, names)
        rule.precision = float((bad & m).sum() / max(1, m.sum()))
        unseen = prune & rule.mask(x, names)
        fine = rule.conditions and rule.precision >= least_precision and (bad & m).sum() >= least_rows and (not unseen.any() or bad[unseen].mean() >= least_precision)
        if not fine:
            misses += 1
            part = rng.permutation(len(x)) % 3
            continue
        rules.append(rule)
        left &= ~m
    return rules


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 20000) -> list[Rule]:
    """Rules from labelled documents (0: low quality) that pass the base rule.

    Bounded: about ``most_rows`` labels, picked by a hash, are broadcast to
    their texts, and only those rows' rates reach the driver. Labels that are
    null or have no document are left out.
    """
    names = [*RATES, *PLAIN]
    marks = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) == 0).alias("__bad"))
    n = marks.count()
    picked = marks.filter(F.pmod(F.xxhash64("__id", F.lit("quality")), F.lit(2**31)) < int(min(1.0, most_rows / max(n, 1)) * 2**31)).limit(2 * most_rows)
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(picked), F.col("__doc") == F.col("__id")).select("__bad", "__text")
    got = with_statistics(rows, ["__bad"], "__text").filter(~base_failed()).select(*(rate(c).alias(c) for c in names), "__bad").toArrow()
    x = np.stack([got[c].to_numpy() for c in names], 1) if len(got) else np.zeros((0, len(names)))
    bad = got["__bad"].to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort((bad, *x.T))
    return learn(x[order], bad[order], names) if len(x) else []


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (0: the base rule, from 1: the list's), null if none."""
    out = F.when(base_failed(), F.lit(0))
    for i, rule in enumerate(rules, 1):
        out = out.when(rule.column(), F.lit(i))
    return out


def apply(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rejected_by and kept."""
    return stats.withColumns({"base_failed": base_failed(), "rejected_by": verdict(rules)}).withColumn("kept", F.col("rejected_by").isNull())
