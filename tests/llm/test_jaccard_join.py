import random
import re
from collections import defaultdict

import pytest

from fieldlens.llm import jaccard_join

ROWS = "doc_id long, text string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    near = defaultdict(set)
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= 80 * len(a | b):
                near[i].add(j)
                near[j].add(i)
    found = {}
    for i in sorted(sets):
        stack = [i] if i not in found else []
        while stack:
            x = stack.pop()
            if x not in found:
                found[x] = i
                stack += near[x]
    return {i: (len(s), found[i]) for i, s in sets.items()}


def mutated(n, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijkl") + str(rng.randint(0, 30))
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a b c d e"), (5, "A b\tc d e"), (6, "é É ß . ,")]
    base = [[word() for _ in range(rng.choice([6, 12, 30, 80, 200]))] for _ in range(8)]
    for i in range(len(rows), n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.2:
            words += [word() for _ in range(rng.randint(1, 60))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("most_members", [64, 3])
def test_components_equal_brute_force(spark, most_members):
    """Also with lists short enough that nearly everything goes through clusters and blocks."""
    rows = mutated(160, 4)
    got = jaccard_join.components(spark.createDataFrame(rows, ROWS), most_members=most_members)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            words[rng.randrange(60)] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    got = jaccard_join.components(spark.createDataFrame(rows, ROWS), most_members=16)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute(rows)


def test_shingles_of_every_document_and_many_copies(spark):
    rng = random.Random(12)
    line = "this line stands in every single document of the whole collection"
    own = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    rows = [(i, f"{line} {own(20)}") for i in range(60)]
    base = f"{line} {own(60)}"
    rows += [(100 + i, base) for i in range(40)] + [(200 + i, f"{base} {own(rng.randint(1, 3))}") for i in range(40)] + [(300 + i, line) for i in range(5)]
    docs = spark.createDataFrame(rows, ROWS)
    got = jaccard_join.components(docs)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute(rows)
    sets = jaccard_join.set_table(docs, 5, "doc_id", "text")
    total = sum(r["n_shingles"] for r in sets.collect())
    tokens, _ = jaccard_join.frequent_shingles(docs, sets, total, 5, "doc_id", "text")
    assert len(tokens) >= 7  # those of the line
    live = {r["sid"]: len(r["core"]) // 8 for r in jaccard_join.live_sets(docs, sets, total, 5, 80, 100, "doc_id", "text", 64, most_copies=3).collect()}
    assert live == {r["sid"]: len(r["core"]) // 8 for r in jaccard_join.live_sets(docs, sets, total, 5, 80, 100, "doc_id", "text", 64).collect()}


def test_a_very_long_text_and_a_very_long_word(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**7)}" for _ in range(400_000)]
    long = " ".join(words)
    rows = [(1, long), (2, long.replace(" ", "  ").upper() + "\n"), (3, " ".join(words[:360_000])), (4, " ".join(words[:300_000])), (5, "x" * 3_000_000 + " a b c d"), (6, "x" * 3_000_000 + " a b\tc d")]
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.components(spark.createDataFrame(rows, ROWS)).collect()}
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5} and got[1] == got[2]
    assert got[1][0] == len(set(zip(*(words[k:] for k in range(5)), strict=False))) and got[5][0] == 1


def test_equal_rows_null_ids_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 9), (1, "a b c d e f", 9), (None, "a b c d e f", 9), (None, None, 9)], "doc_id long, text string, sid long")
    got = sorted(jaccard_join.components(rows).collect(), key=str)
    assert len(got) == 4
    assert sorted(r["n_shingles"] for r in got) == [0, 2, 2, 2]
    assert {r["component_id"] for r in got if r["n_shingles"]} == {1}


def test_empty_table(spark):
    assert jaccard_join.components(spark.createDataFrame([], ROWS)).count() == 0
