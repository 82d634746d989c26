import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fieldlens.llm import suffix_dedup
from fieldlens.llm.suffix_array import permuted_lcp, suffix_array

ROWS = "doc_id long, text string"


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        rest = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        spans = sum(1 for i in range(len(t)) if covered[i] and (i == 0 or not covered[i - 1]))
        out.append((len(t), len(t) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


def common_prefix(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def test_suffix_array_and_prefixes_equal_sorting():
    rng = np.random.default_rng(0)
    for trial in range(300):
        n = int(rng.integers(1, 90))
        s = rng.integers(97, 97 + int(rng.integers(1, 5)), n).astype(np.uint8)
        if trial % 3 == 0:
            s = np.tile(s[: max(1, n // 4)], 4)
        t = s.tobytes()
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        if len(t) > 1:
            lcp = permuted_lcp(s, sa, np.array([0]), 1000)
            assert all(lcp[sa[r]] == common_prefix(t[sa[r] :], t[sa[r - 1] :]) for r in range(1, len(t)))


def texts():
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["alpha", "béta", "gam", "de", "x"]) + str(rng.randint(0, 99)) for _ in range(n))
    passages = [words(60) for _ in range(4)]
    out = [None, "", "abc", "a" * 500, "ab" * 300, "日本" * 200, words(100)]
    for _ in range(110):
        cut = "".join(" " + rng.choice(passages)[rng.randint(0, 60) :] for _ in range(rng.randint(0, 3)))
        out.append(words(rng.randint(0, 40)) + cut + " " + words(rng.randint(0, 40)))
    return out + out[:20]


@pytest.mark.parametrize("most_contexts", [1000, 2])
def test_equals_brute_force(spark, monkeypatch, most_contexts):
    """Once through suffix arrays, once with windows of crowded meetings counted by hash."""
    plain = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda *a: plain(*a, most_contexts=most_contexts))
    rows = list(enumerate(texts()))
    got = suffix_dedup.dedup(spark.createDataFrame(rows, ROWS), ["doc_id"]).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == brute([t for _, t in rows])


def test_equal_rows_repeat_each_other_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(60))
    got = suffix_dedup.dedup(spark.createDataFrame([(7, text, "x"), (7, text, "x"), (None, "short", "x")], "doc_id long, text string, rid string"), ["doc_id", "rid"], with_text=True).collect()
    assert sorted((r["n_removed"], r["kept_text"], r["rid"]) for r in got) == [(0, "short", "x"), (len(text), "", "x"), (len(text), "", "x")]
    assert suffix_dedup.dedup(spark.createDataFrame([], ROWS), ["doc_id"]).count() == 0


def test_very_long_texts(spark):
    """Texts of many stretches; what they share begins and ends inside stretches."""
    rng = np.random.default_rng(4)
    long = "".join(map(chr, rng.integers(97, 123, 7_000_000)))
    rows = [(1, long), (2, "<" + long[300_000:5_500_000] + ">"), (3, long[-250:] + "!" + "z" * 100)]
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(spark.createDataFrame(rows, ROWS), ["doc_id"], with_text=True).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[1]["kept_text"]) == (5_200_250, 2, long[:300_000] + long[5_500_000:-250])
    assert (got[2]["n_removed"], got[2]["kept_text"]) == (5_200_000, "<>")
    assert (got[3]["n_removed"], got[3]["kept_text"]) == (250, "!" + "z" * 100)
