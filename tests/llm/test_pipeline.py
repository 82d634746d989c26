import random

import corpus_pipeline
from fieldlens.llm import queries


def words(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "er", "in", "on", "at", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def folder(spark, path):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        text = words(rng, rng.randint(40, 90))
        if i % 8 == 0:
            text += " idiot moron scum " + words(rng, 5)
        if i % 8 == 1:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en", f"s{i % 3}", len(text), "kept"))
        labels.append((i, int(i % 8 != 1), int(i % 8 == 0)))
    passage = words(rng, 70)
    clean = [r[1] for r in rows if r[0] % 8 == 2]
    rows += [(1000 + k, t, "en", "s0", len(t), "kept") for k, t in enumerate(clean)]  # exact copies
    rows += [(2000 + k, words(rng, 60) + " " + passage + " " + words(rng, 60), "en", "s0", 0, "kept") for k in range(5)]
    rows += [(3000, None, "en", "s0", None, "kept")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, passage


def test_every_stage_does_its_work(spark, tmp_path):
    rows, passage = folder(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [{r["doc_id"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(kept) and set(kept) <= seen[-1]
        seen.append(set(kept))
    toxic, low, near, rest = (a - b for a, b in zip(seen, seen[1:], strict=False))
    assert len(toxic ^ {i for i in range(0, 240, 8)}) <= 2
    assert len(low ^ ({i for i in range(1, 240, 8)} | {3000})) <= 2
    assert near == {i for i in seen[2] if 1000 <= i < 2000} and not rest
    for i in range(2000, 2005):
        assert passage not in kept[i]["text"] and kept[i]["n_chars"] == len(kept[i]["text"]) > 300
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == seen[-1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def stages(spark, docs, path):
    """What each stage leaves, written and read again."""
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.mode("overwrite").parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        yield name, docs


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, docs in stages(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)):
        assert docs.count() == 0 and (name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"])


def test_stages_of_null_and_repeated_ids_ties_and_a_long_text(spark, tmp_path):
    rng = random.Random(8)
    same, other, long = words(rng, 60), words(rng, 60), words(rng, 400_000)
    rows = [(1, same), (1, same), (1, other), (None, words(rng, 70)), (None, words(rng, 70)), (2, None), (3, ""), (4, long), (5, same)]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "kept") for i, t in rows], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counts, last = {}, None
    for name, docs in stages(spark, docs, str(tmp_path)):
        counts[name] = docs.count()
        if name == "suffix_dedup":
            last = docs.collect()
    # the base rule drops the two empty texts, the join the two copies of the first text; nothing is repeated then
    assert [counts[n] for n in ("toxicity", "quality_rules", "jaccard_join", "suffix_dedup")] == [9, 7, 5, 5]
    assert sorted((str(r["doc_id"]), r["text"]) for r in last) == sorted((str(i), t) for i, t in [rows[0], *rows[2:5], rows[7]])
    assert counts["packing"] > 400


def test_queries_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(queries.QUERIES) < set(found) and "pipeline" in found
    assert [name[: name.index("_")] for name in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
