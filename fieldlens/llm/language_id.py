"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier per bit reads hashed byte
n-grams of the text. A prediction takes the language whose codeword has the
smallest loss over all bits, where a bit weighs more the better its classifier
was on the training rows. The gap to the second language flags ambiguity.

Nulls and texts without a letter are ``und`` with score 0. Equal texts get equal
predictions, each row its own; of languages with equal losses the first by name
wins. Very long texts are counted in stretches. Empty tables give empty results;
with no labelled row at all, every text is ``und``. Kept columns may have any
names; if one has that of a result column, the result has both.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm import textkit as tk

UNKNOWN = "und"


def _buckets(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hash bucket of every byte n-gram."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order * 0x3C6EF372, np.uint32)
    for i in range(order):
        h = h * np.uint32(0x01000193) ^ data[i : i + n].astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def features(data: np.ndarray, orders: tuple[int, ...], bits: int, stretch: int = 1 << 20) -> np.ndarray:
    """Square roots of the shares of each order's n-grams: a unit vector for each order. N-grams are counted a stretch of the text at a time."""
    out = np.zeros(1 << bits, np.float32)
    for order in orders:
        count = np.zeros(1 << bits, np.int64)
        for at in range(0, len(data) - order + 1, stretch):
            count += np.bincount(_buckets(data[at : at + stretch + order - 1], order, bits), minlength=1 << bits)
        if count.any():
            out += np.sqrt(count / count.sum()).astype(np.float32)
    return out


def has_letter(data: np.ndarray, stretch: int = 1 << 16) -> bool:
    """Whether UTF-8 text holds a letter; it is read only as far as the first one."""
    import regex

    letter = regex.compile(r"\p{L}")
    for at in range(0, len(data), stretch):
        if letter.search(data[max(0, at - 3) : at + stretch].tobytes().decode("utf-8", "ignore")):
            return True
    return False


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: all splits for up to 6 languages, else random codes with widely separated rows."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = [[1 if (k >> i) & 1 else -1 for i in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(bits, np.int8).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, gap = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        far = (width - code.astype(np.float32) @ code.T.astype(np.float32)) / 2 + width * np.eye(n)
        if far.min() > gap and (np.abs(code.sum(0)) < n).all():
            best, gap = code, far.min()
    return best


@dataclass
class CodeModel:
    """Codewords and the bit classifiers."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray
    orders: tuple[int, ...]
    bits: int

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each language's codeword."""
        return (np.logaddexp(0, -margins[:, None, :] * self.codes[None]) * self.bit_weight).sum(2)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def fit(x: np.ndarray, labels: list[str], orders: tuple[int, ...], bits: int, steps: int = 300, ridge: float = 1e-5) -> CodeModel:
    """Logistic regressions for all bits at once, by accelerated gradient steps."""
    languages = sorted(set(labels))
    codes = codewords(len(languages))
    y = codes[np.searchsorted(languages, labels)].astype(np.float32) if labels else np.zeros((0, codes.shape[1]), np.float32)
    share = Counter(labels)
    row = np.array([1 / share[c] for c in labels], np.float32)
    row /= max(row.sum(), 1e-9)
    w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    ahead_w, ahead_b, rate = w, b, 4 / (len(orders) ** 2 + 1)
    for k in range(steps if len(labels) else 0):
        pull = -y / (1 + np.exp(np.clip(y * (x @ ahead_w + ahead_b), -30, 30))) * row[:, None]
        new_w, new_b = ahead_w - rate * (x.T @ pull + ridge * ahead_w), ahead_b - rate * pull.sum(0)
        push = k / (k + 3)
        ahead_w, ahead_b, w, b = new_w + push * (new_w - w), new_b + push * (new_b - b), new_w, new_b
    right = ((np.sign(x @ w + b) == y) * row[:, None]).sum(0) if len(labels) else np.ones(codes.shape[1])
    strength = np.log(np.clip(right, 0.5, 1 - 1e-3) / (1 - np.clip(right, 0.5, 1 - 1e-3))) + 1e-3
    return CodeModel(languages, codes, w, b, strength / strength.mean(), orders, bits)


def train(labelled: DataFrame, text_col: str, label_col: str, per_language: int = 800, orders: tuple[int, ...] = (1, 2, 3), bits: int = 12, id_col: str | None = None) -> CodeModel:
    """Fits on a bounded sample: about ``per_language`` rows of every language, picked by a hash of id and text.

    Copies of a text have ids of their own and are picked one by one; rows that
    are equal in both (or in the text alone, without ``id_col``) count once, in
    the sample and in the number its share is reckoned from. Beyond 64 languages
    the sample of each gets smaller, so that the whole stays within the driver's memory.
    The corpus is counted whole; only the features of the picked rows, a fixed
    number of bytes each, reach the driver.
    """
    key = F.xxhash64(text_col) if id_col is None else F.xxhash64(id_col, text_col)
    rows = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).alias("__lang"), F.col(text_col).alias("__text"), key.alias("__key"))
    counts = {r[0]: r[1] for r in rows.groupBy("__lang").agg(F.approx_count_distinct("__key", 0.02)).collect()}
    if not counts:
        return fit(np.zeros((0, 1 << bits), np.float32), [], orders, bits)
    wanted = min(per_language, max(1, 64 * per_language // len(counts)))
    # a language of few rows is taken whole, and one of many has 20 expected rows at least: none is missed
    bars = [(lang, 2**31 if n <= max(wanted, 20) else int(max(wanted, 20) / n * 2**31)) for lang, n in sorted(counts.items())]
    bars = labelled.sparkSession.createDataFrame(bars, "__name string, __bar long")
    picked = rows.join(F.broadcast(bars), F.col("__lang") == F.col("__name")).filter(F.pmod("__key", F.lit(2**31)) < F.col("__bar"))
    picked = picked.dropDuplicates(["__lang", "__key"]).select("__lang", "__text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.raw(pc.utf8_lower(tk.as_strings(batch.column(1))))
            out = [features(data[a:b], orders, bits).astype(np.float16).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["lang", "x"])

    got = picked.mapInArrow(tk.tidy(sparse), "lang string, x binary").toArrow()
    order = sorted(zip(got["lang"].to_pylist(), got["x"].to_pylist(), strict=True))
    x = np.array([np.frombuffer(b, np.float16) for _, b in order], np.float32).reshape(len(order), 1 << bits)
    return fit(x, [lang for lang, _ in order], orders, bits)


def predict(docs: DataFrame, model: CodeModel, keep: list[str], text_col: str = "text", ambiguous_below: float = 0.6) -> DataFrame:
    """Adds lang_pred, score (0 to 1), runner_up and ambiguous to the ``keep`` columns."""

    names, kinds = tk.kept(docs, keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.raw(pc.utf8_lower(tk.as_strings(batch.column(batch.num_columns - 1))))
            pred, score, second = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = data[a:b]
                if not model.languages or not has_letter(text):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    second.append(None)
                    continue
                loss = model.losses(model.margins(features(text, model.orders, model.bits)[None]))[0]
                share = np.exp(loss.min() - loss)
                share /= share.sum()
                order = np.lexsort((np.arange(len(loss)), loss))
                pred.append(model.languages[order[0]])
                score.append(float(share[order[0]]))
                second.append(model.languages[order[1]] if len(order) > 1 else None)
            got = np.array(score)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(got), pa.array(second, pa.string()), pa.array(got < ambiguous_below)], [*names, "lang_pred", "score", "runner_up", "ambiguous"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(tk.tidy(scored), f"{kinds}, lang_pred string, score double, runner_up string, ambiguous boolean").toDF(*keep, "lang_pred", "score", "runner_up", "ambiguous")
