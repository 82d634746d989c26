"""Toxicity scores from a counterfactually regularised linear classifier.

Words and word beginnings are hashed; a logistic regression reads which occur.
For labelled sentences, identity terms are swapped for others of their list
and for a neutral word; sentences without one get terms set in for a word. The
training loss adds the squared score change between the two versions, so that
neutral mentions of a group don't move a score.

Null and empty texts score by the intercept alone. Equal texts get equal scores,
each row its own; a score of exactly 0.5 is predicted 1. Very long texts are
read in stretches. With no labelled row the score is 0 everywhere; with labels
of one kind only, it is that label's rate. Of several labels of one id each
counts. An empty table gives an empty result. Kept columns may have any names;
if one has that of a result column, the result has both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm import textkit as tk

#: Terms that may stand for each other in a neutral sentence; the first of each list is the neutral word.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "immigrants", "refugees", "foreigners"),
    ("person", "woman", "man", "girl", "boy", "immigrant", "refugee", "foreigner"),
    ("human", "black", "white", "asian", "african", "european", "american", "mexican", "arab"),
    ("believer", "muslim", "christian", "jewish", "jew", "hindu", "buddhist", "atheist", "catholic"),
    ("adult", "gay", "lesbian", "straight", "bisexual", "transgender", "queer", "disabled", "deaf", "blind", "elderly"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "noirs", "blancs", "immigrés"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "schwarze", "weiße", "ausländer"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "negros", "blancos", "inmigrantes"),
)
#: Byte lengths of word beginnings that count as features besides the whole word.
PREFIXES = (4, 5, 6, 7, 8)
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


_GAPS = ~_LETTERS


def _short(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin, end, doc = tk.words(np.where(_LETTERS[data], data, np.uint8(32)), offsets)
    roll = tk.Rolling(data)
    ids, docs = [(roll.of(begin, end) ^ np.uint64(1)) >> np.uint64(32)], [doc]
    for k in PREFIXES:
        long = end - begin > k
        ids.append(tk.mix(roll.of(begin[long], begin[long] + k) + np.uint64(k)) >> np.uint64(32))
        docs.append(doc[long])
    return np.concatenate(ids), np.concatenate(docs)


def hashed(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature number (32 bits) and text number of every word and word beginning of lower-cased texts, a stretch of them at a time.

    Words are runs of letters, digits and bytes of longer characters, never
    across texts; a word beyond ``most`` bytes counts by its beginnings only.
    """
    for a, b, d, o in tk.chunks(data, offsets, most):
        for low, high in tk.parts(d, most, _GAPS) if b == a + 1 else [(0, len(d))]:
            part = d[low:high]
            if len(part) > 2 * most:
                gaps = np.flatnonzero(_GAPS[part])
                begin = int(gaps[-1]) + 1 if len(gaps) else 0
                part = part[: begin + 2 * max(PREFIXES)]
            ids, doc = _short(part, o if b > a + 1 else np.array([0, len(part)]))
            yield ids, doc + a


def text_features(texts: list[str]) -> list[np.ndarray]:
    """The distinct feature numbers of each text, ascending."""
    data, offsets = tk.raw(pc.utf8_lower(pa.array(texts, pa.string())))
    key = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique((doc.astype(np.uint64) << np.uint64(32)) | ids) for ids, doc in hashed(data, offsets))]))
    at = np.searchsorted(key, np.arange(len(texts) + 1).astype(np.uint64) << np.uint64(32))
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [low[at[i] : at[i + 1]] for i in range(len(texts))]


_ENDS = ".,;:!?\"'()"
_TERM = re.compile(rf"(?<![^ ])[{re.escape(_ENDS)}]*({'|'.join(sorted({t for g in IDENTITY_TERMS for t in g}, key=len, reverse=True))})[{re.escape(_ENDS)}]*(?![^ ])")


def swapped(text: str, seed: int) -> tuple[str, str]:
    """The text and its counterfactual: identity terms are exchanged, or one is set in for a word against the neutral word."""
    rng = np.random.default_rng(seed)
    where = {t: group for group in IDENTITY_TERMS for t in group}
    low = text.lower()
    if _TERM.search(low):

        def other(m: re.Match) -> str:
            group = [t for t in where[m[1]] if t != m[1]]
            return m[0].replace(m[1], group[int(rng.integers(len(group)))])

        return low, _TERM.sub(other, low)
    group = IDENTITY_TERMS[int(rng.integers(len(IDENTITY_TERMS)))]
    nth, term = int(rng.integers(low.count(" ") + 1)), group[1 + int(rng.integers(len(group) - 1))]
    begin = next(islice((m.end() for m in re.finditer(" ", low)), nth - 1, None)) if nth else 0
    end = low.find(" ", begin)
    end = len(low) if end < 0 else end
    return low[:begin] + group[0] + low[end:], low[:begin] + term + low[end:]


@dataclass
class LinearModel:
    """Sorted feature numbers with their weights, and the intercept."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, most = len(offsets) - 1, len(self.ids)
        total, pairs = np.full(n, self.bias), [np.zeros(0, np.int64)]
        for ids, doc in hashed(data, offsets) if most else ():
            ids = ids.astype(np.uint32)
            at = np.minimum(np.searchsorted(self.ids, ids), most - 1)
            hit = self.ids[at] == ids
            pairs.append(np.unique(doc[hit].astype(np.int64) * most + at[hit]))
        if most:
            seen = np.unique(np.concatenate(pairs))
            total += np.bincount(seen // most, self.weights[seen % most], n)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _csr(rows: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and columns of the features that are in ``ids``."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    at = np.minimum(np.searchsorted(ids, flat), max(len(ids) - 1, 0))
    hit = ids[at] == flat if len(ids) else np.zeros(len(flat), bool)
    return row[hit], at[hit]


def fit(rows: list[np.ndarray], labels: np.ndarray, class_weight: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], most_features: int = 1500, least_rows: int = 3, strength: float = 2.0, ridge: float = 3e-5, steps: int = 500) -> LinearModel:
    """Logistic loss + strength x mean squared counterfactual change + ridge, by Adam.

    Only features of at least ``least_rows`` rows that tell the classes apart best (by signed root of the log likelihood ratio) get a weight.
    """
    if not len(labels) or labels.min() == labels.max():
        rate = float(labels[0]) if len(labels) else 0.0
        return LinearModel(np.zeros(0, np.uint32), np.zeros(0), 40.0 if rate else -40.0)
    ids, column = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    all_n, pos_n = np.bincount(column, minlength=len(ids)), np.bincount(column, labels[owner], len(ids))
    pos, n = labels.sum(), len(labels)
    p, q = (pos_n + 0.5) / (pos + 1), (all_n - pos_n + 0.5) / (n - pos + 1)
    z = np.abs(np.log(p / q)) * np.sqrt(1 / (1 / (pos_n + 0.5) + 1 / (all_n - pos_n + 0.5)))
    z[all_n < least_rows] = 0
    ids = np.sort(ids[np.argsort(-z, kind="stable")[: min(most_features, int((z > 2).sum()))]])
    ids = np.union1d(ids, np.concatenate(text_features([" ".join(g) for g in IDENTITY_TERMS]))).astype(np.uint32)
    r, c = _csr(rows, ids)
    left, right = _csr([a for a, _ in pairs], ids), _csr([b for _, b in pairs], ids)
    w, b, weight = np.zeros(len(ids)), float(np.log(class_weight[labels == 1].sum() / class_weight[labels == 0].sum())), class_weight / class_weight.sum()
    m1, m2, mb1, mb2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, steps + 1):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], n) + b, -40, 40)))
        pull = (score - labels) * weight
        grad = np.bincount(c, pull[r], len(ids)) + ridge * w
        if pairs:
            change = np.bincount(left[0], w[left[1]], len(pairs)) - np.bincount(right[0], w[right[1]], len(pairs))
            change *= 2 * strength / len(pairs)
            grad += np.bincount(left[1], change[left[0]], len(ids)) - np.bincount(right[1], change[right[0]], len(ids))
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        mb1, mb2 = 0.9 * mb1 + 0.1 * pull.sum(), 0.99 * mb2 + 0.01 * pull.sum() ** 2
        step = 0.05 / (1 + k / 100)
        w -= step * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        b -= step * (mb1 / (1 - 0.9**k)) / (np.sqrt(mb2 / (1 - 0.99**k)) + 1e-8)
    return LinearModel(ids, w, b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000) -> LinearModel:
    """Fits on a bounded sample: about ``per_class`` labels of each kind, picked by a hash; counts cover all labels.

    Only the picked labels, so bounded, are broadcast to find their texts; the
    texts' features are made where the texts lie. Labels that are null or have
    no document are left out. A counterfactual pair is made from the whole of
    each picked text; only the features that differ in it are kept.
    """
    marks = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("int").alias("__y"))
    counts = {r[0]: r[1] for r in marks.groupBy("__y").count().collect()}
    pick = F.lit(False)
    for y, n in counts.items():
        pick = pick | ((F.col("__y") == y) & (F.pmod(F.xxhash64("__id", F.lit("pick")), F.lit(2**31)) < int(min(1.0, per_class / n) * 2**31)))
    picked = F.broadcast(marks.filter(pick).limit(4 * per_class))
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(picked, F.col("__doc") == F.col("__id")).select("__y", "__text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.as_strings(batch.column(1))
            bytes_upto = np.cumsum(np.diff(tk.raw(texts)[1]))
            i = 0
            while i < len(texts):  # some texts at a time, a very long one alone
                end = min(i + 200, max(i + 1, int(np.searchsorted(bytes_upto, (bytes_upto[i - 1] if i else 0) + (4 << 20)))))
                part = texts.slice(i, end - i).to_pylist()
                two = [swapped(t, len(t)) for t in part]
                out = [text_features(part), text_features([a for a, _ in two]), text_features([b for _, b in two])]
                own = [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in zip(out[1], out[2], strict=True)]
                cols = [out[0], [a for a, _ in own], [b for _, b in own]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in cols)], ["y", "x", "a", "b"])
                i = end

    got = rows.mapInArrow(tk.tidy(sparse), "y int, x binary, a binary, b binary").limit(4 * per_class).toArrow().to_pylist() if counts else []
    got.sort(key=lambda r: (r["x"], r["y"]))
    labels = np.array([r["y"] for r in got], np.int64)
    # a row stands for its share of all labels, less what would drown the rarer kind: kinds weigh as the roots of their numbers
    share = {y: counts[y] ** 0.5 / max(1, int((labels == y).sum())) for y in counts}
    unpack = lambda b: np.frombuffer(b, np.uint32)
    return fit([unpack(r["x"]) for r in got], labels, np.array([share[y] for y in labels.tolist()]), [(unpack(r["a"]), unpack(r["b"])) for r in got])


def score(docs: DataFrame, model: LinearModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from a score of 0.5) to the ``keep`` columns."""
    columns = keep if text_col in keep else [*keep, text_col]

    names, kinds = tk.kept(docs, keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.raw(pc.utf8_lower(tk.as_strings(batch.column(columns.index(text_col)))))
            out = np.concatenate([np.zeros(0), *(model.scores(d, o) for _, _, d, o in tk.chunks(data, offsets))])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return docs.select(*columns).mapInArrow(tk.tidy(scored), f"{kinds}, score double, predicted int").toDF(*keep, "score", "predicted")
