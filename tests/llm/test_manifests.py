"""Whitening against numpy, the Merkle manifest against a loop, URL verdicts against the rules and formulas."""

import math
import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.llm import merkle, queries, url_filter, whitening

FOLDER = "/root/testdata/sf0.001"


def exact_fit(vectors):
    """The grid, sums and covariance by whole numbers and numpy."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    distinct = sorted({tuple(v) for v in x})
    n, d = len(distinct), len(distinct[0])
    s = [sum(v[i] for v in distinct) for i in range(d)]
    centred = np.array([[n * v[i] - s[i] for i in range(d)] for v in distinct], float) / n
    return x, n, s, centred.T @ centred / n


def check_whitening(rows, vectors):
    x, n, s, v = exact_fit([c for _, c in vectors])
    values, axes = np.linalg.eigh(v)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(by_id) == len(vectors)
    for (i, _), xi in zip(vectors, x, strict=True):
        got = by_id[i]
        assert sorted(got) == list(range(1, min(16, len(s)) + 1))
        for k, r in got.items():
            assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(xi, s, strict=True))
            wanted = (np.array([a - b / n for a, b in zip(xi, s, strict=True)]) @ axes[:, -k]) / math.sqrt(values[-k])
            assert abs(abs(r["whitened"]) - abs(wanted)) < 1e-6
            assert r["explained"] == pytest.approx(values[-k] / v.trace(), rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    check_whitening(queries.op11_whitening(spark, FOLDER).collect(), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_whitening_counts_copies_once_and_drops_odd_vectors(spark):
    rng = random.Random(4)
    good = [(i, [rng.gauss(0, 3), rng.gauss(5, 1), rng.gauss(0, 0.5)]) for i in range(40)]
    good += [(100 + i, good[0][1]) for i in range(60)]
    odd = [(900, None), (901, [1.0, None, 2.0]), (902, [1.0, float("nan"), 2.0]), (903, [float("inf"), 0.0, 0.0]), (904, [1.0]), (905, []), (906, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumns({"n": F.lit(1), "x": F.lit("x"), "component": F.lit(2)})
    check_whitening(whitening.whiten(df).collect(), good)


def test_whitening_beside_large_offsets(spark):
    """Entries of 2**39 leave the double products behind: sums are taken of centred entries."""
    rng = random.Random(5)
    rows = [(i, [2.0**33 + rng.gauss(0, 1), rng.gauss(0, 2.0**30)]) for i in range(50)]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {k for _, k in got} == {1}  # the other's share is below the least
    assert got[0, 1]["identity_error"] < 1e-4


@pytest.mark.parametrize("vectors", [[], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, None)]])
def test_whitening_without_variance_is_empty(spark, vectors):
    assert whitening.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect() == []


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, at, fanout):
    for nodes in levels[:-1]:
        run = at - at % fanout
        yield nodes[run:at], nodes[at + 1 : run + fanout]
        at //= fanout


def brute_manifest(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text) rows, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names}
    whole, out = tree([trees[g][-1][0] for g in names], fanout), []
    root = whole[-1][0] if rows else None
    for place, g in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            way = [*siblings(trees[g], i, fanout), *siblings(whole, place, fanout)]
            tampered = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            now = leaf_of((*r[:3], r[3] + 1, r[4])) if tampered else leaf
            for left, right in way:
                now = h("".join([*left, now, *right]))
            out.append((r[0], leaf, trees[g][-1][0], root, h("".join("".join(a + b) for a, b in way)), now, now == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_of(docs, **options):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf([*fields[:3], F.col("n_chars") + 1, fields[4]]))
    return sorted((tuple(r) for r in merkle.manifest(docs, fields, ["doc_id"], altered=altered, **options).collect()), key=str)


def test_manifest_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, FOLDER).collect()), key=str)
    assert got == brute_manifest(rows) and any(not r[-1] for r in got)


@pytest.mark.parametrize(("fanout", "cell_rows", "block"), [(2, 3, 2), (3, 1, 1), (4, 1000, 6), (2, 5, 1)])
def test_manifest_of_hard_rows(spark, monkeypatch, fanout, cell_rows, block):
    """A hot group with a hot id, copies, nulls, ids at both ends, groups of one row, whatever the cells and blocks hold."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(fanout)
    rows = [(rng.choice([7, 7, 7, i, -i, None, 2**63 - 1, -(2**63)]), rng.choice(["a", "é", None]), rng.choice(["en", "en", "en", "de", None, ""]), rng.choice([1, None, 12]), rng.choice(["", "x", "é\n", None])) for i in range(150)]
    rows += [(5, "s", f"l{i}", 3, "only") for i in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("idx", "size", "tree", "digest", "leaf", "rank")})
    assert manifest_of(docs, fanout=fanout, cell_rows=cell_rows) == brute_manifest(rows, fanout)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "x")], [(1, None, None, None, None), (2, None, "en", 1, "é" * 10)]])
def test_manifest_of_few_rows(spark, rows):
    assert manifest_of(spark.createDataFrame(rows, SCHEMA)) == brute_manifest(rows)


def test_manifest_of_a_very_long_text(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.repeat(F.lit("ab "), F.when(F.col("id") == 1, 16_000_000).otherwise(1)).alias("text"))
    assert manifest_of(docs) == brute_manifest([(i, "s", "en", 1, "ab " * (16_000_000 if i == 1 else 1)) for i in range(3)])


def test_manifest_wants_numbers(spark):
    with pytest.raises(ValueError, match="whole number"):
        merkle.manifest(spark.createDataFrame([("a", "b")], "doc_id string, lang string"), [F.col("doc_id")], ["doc_id"])


URLS = [
    ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
    ("https://badexample.net/en/1", "badexample.net", "/en/1", "net/", "block"),
    ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("x://w.example.com/de", "w.example.com", "/de", None, "allow"),
    ("http://example.org/fr/a#b/c", "example.org", "/fr/a", "org/fr/", "allow"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("http://example.net?a=://b/c", "example.net", "", None, "allow"),
    ("http://h#://", "h", "", None, "allow"),
    ("no scheme/en/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://É.Ä/x\ny", "É.Ä", "/x\ny", None, "allow"),
    ("http://" + "a" * 100_000 + ".org/fr/" + "b" * 100_000, "a" * 100_000 + ".org", "/fr/" + "b" * 100_000, "org/fr/", "allow"),
]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "n", "k", "bad")})
    none = spark.createDataFrame([], "id long, bad boolean")
    got = {r["page_id"]: r for r in url_filter.judge(pages, none, queries.URL_RULES).collect()}
    for i, (_, *wanted) in enumerate(URLS):
        assert [got[i][c] for c in ("host", "path", "rule", "verdict")] == wanted
    assert url_filter.judge(pages.limit(0), none, []).collect() == []


def test_reputation_shrinks_hosts_to_their_domain(spark):
    """Few bad pages block a host of a bad domain, not one of a good domain; many block it anywhere; unlabelled hosts follow their domain."""
    rows, outcomes, n = [], [], 0

    def add(host, good, bad, unknown=0):
        nonlocal n
        for outcome in [False] * good + [True] * bad + [None] * unknown:
            rows.append((n, f"http://{host}/p{n}"))
            if outcome is not None:
                outcomes.append((n, outcome))
            n += 1

    for i in range(12):
        add(f"h{i}.good.aa", 40, 1)
        add(f"h{i}.bad.aa", 1, 40)
    add("few.good.aa", 0, 2)
    add("few.bad.aa", 0, 2)
    add("many.good.aa", 0, 200)
    add("new.bad.aa", 0, 0, 5)
    add("new.good.aa", 0, 0, 5)
    outcomes += [(0, False), (0, False), (10**9, True), (None, True)]
    pages = spark.createDataFrame([*rows, (None, "http://h0.good.aa/")], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(outcomes, "id long, bad boolean"), []).collect()
    assert len(got) == n + 1
    verdicts = {r["host"]: r["verdict"] for r in got}
    assert [verdicts[h] for h in ("few.good.aa", "few.bad.aa", "many.good.aa", "new.bad.aa", "new.good.aa")] == ["allow", "block", "block", "block", "allow"]
    assert {r["host_labelled"] for r in got if r["host"] == "many.good.aa"} == {200}


def test_rule_lists_and_domains(spark):
    row = spark.range(1).select(*(c.alias(n) for n, c in zip("ab", url_filter.domain_and_suffix(F.lit("x.y.co.uk"), ("co.uk",)), strict=True)), *(c.alias(n) for n, c in zip("cd", url_filter.domain_and_suffix(F.lit("10.0.0.1")), strict=True))).first()
    assert tuple(row) == ("y.co.uk", "co.uk", "10.0.0.1", "10.0.0.1")
