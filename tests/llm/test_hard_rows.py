"""Very long texts, repeated rows, ties and clashing names, for operators whose other tests don't have them."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fieldlens.llm import language_id, quality_rules, queries, sentencepiece_codec, sharding, toxicity
from fieldlens.llm import textkit as tk

FOLDER = "/root/testdata/sf0.1"
MODEL = queries.tokenizer_path("piece_bpe_32k.model")


def test_word_hashes_do_not_depend_on_stretches(monkeypatch):
    rng = random.Random(1)
    for most in (8, 30, 1 << 20):
        monkeypatch.setattr(tk, "LONG_WORD", most)
        texts = ["".join(rng.choice(["ab", "c", " ", "\n", "longer-word"]) for _ in range(rng.randint(0, 60))) for _ in range(50)]
        data, offsets = tk.raw(pa.array(texts))
        hashes, doc = tk.word_hashes(data, offsets, most)
        begin, end, owner = tk.words(data, offsets)
        assert doc.tolist() == owner.tolist()
        assert hashes.tolist() == tk.range_hashes(data, tk.Rolling(data), begin, end).tolist()


def test_statistics_do_not_depend_on_stretches(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "c", "é", " ", "\n", "#", "1", "A!", "the word line\n"]) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    data, offsets = tk.raw(pa.array(texts))
    whole = quality_rules.statistics(data, offsets)
    monkeypatch.setattr(tk, "LONG_WORD", 10)
    assert (quality_rules.statistics(data, offsets, most=16) == whole).all()


def labelled(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        lang = ("aa", "bb")[i % 2]
        words = [rng.choice({"aa": ["the", "and", "ing"], "bb": ["der", "die", "ung"]}[lang]) for _ in range(30)]
        rows.append((i, " ".join(words + ["vile"] * (i % 5 == 0)), lang, int(i % 5 == 0), int(i % 6 > 1)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, quality int")


def test_very_long_texts_are_read_whole(spark):
    """The only telling words of 50 MB stand at the end."""
    rows = labelled(spark)
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.concat(F.repeat(F.lit("der ung "), 6_250_000), F.lit("vile\n"), F.repeat(F.lit("one line\n"), 3))).otherwise(F.repeat(F.lit("x"), 50_000_000)).alias("text"))
    toxic = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxic, ["doc_id"]).collect()} == {0: 1, 1: 0}
    language = language_id.train(rows, "text", "lang")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, language, ["doc_id"]).collect()}[0] == "bb"
    got = {r["doc_id"]: r for r in quality_rules.apply(quality_rules.with_statistics(docs, ["doc_id"]), []).collect()}
    assert (got[0]["n_words"], got[0]["n_dup_lines"], got[0]["base_failed"]) == (12_500_007, 2, True)
    assert got[0]["n_repeat_words"] == 12_500_000 and (got[1]["n_words"], got[1]["longest_word"]) == (1, 50_000_000)
    shards = sharding.kd_shards(docs.withColumn("source", F.lit("s")).withColumn("lang", F.lit("l"))).collect()
    assert sorted(r["size"] for r in shards) == [50_000_001, 50_000_033]


def test_codec_of_a_long_text(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "some words of a longer text, é " * 100_000
    (got,) = sentencepiece_codec.encode_digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL).collect()
    assert got["n_tokens"] == len(library.encode(text))


def test_repeated_rows_ties_and_clashing_names(spark):
    rows = labelled(spark)
    twice = rows.unionByName(rows).withColumn("score", F.lit("own")).withColumn("lang_pred", F.lit("own")).withColumn("__text", F.lit("own"))
    toxic = toxicity.train(twice.select("doc_id", "text"), rows.select("doc_id", "toxic", F.lit(1).alias("__y")))
    scored = toxicity.score(twice, toxic, ["doc_id", "score"])
    assert scored.columns == ["doc_id", "score", "score", "predicted"] and scored.count() == 480
    assert scored.toDF("doc_id", "own", "score", "predicted").select("doc_id", "own", "score").distinct().count() == 240
    language = language_id.train(twice, "text", "lang", id_col="doc_id")
    named = language_id.predict(twice, language, ["doc_id", "lang_pred"]).toDF("doc_id", "own", "lang_pred", "score", "runner_up", "ambiguous")
    assert named.count() == 480 and named.filter("own <> 'own'").count() == 0
    even = language_id.fit(np.zeros((2, 8), np.float32), ["b", "a"], (1,), 3)  # nothing tells them apart
    assert int(even.losses(even.margins(np.zeros((1, 8), np.float32)))[0].argmin()) == 0 and even.languages == ["a", "b"]
    rules = quality_rules.train(twice, rows.select("doc_id", "quality"))
    stats = quality_rules.with_statistics(twice.select("doc_id", F.col("score").alias("source"), "text"), ["doc_id", "source"])
    assert quality_rules.apply(stats, rules).count() == 480
    shards = sharding.kd_shards(twice.withColumn("source", F.lit("s")).withColumn("size", F.lit("own")).withColumn("shard", F.lit("own"))).collect()
    assert len(shards) == 480 and {type(r["shard"]) for r in shards} == {int}
    digests = sentencepiece_codec.encode_digests(spark.createDataFrame([(1, "same", 7), (1, "same", 7)], "doc_id long, text string, n_tokens int"), MODEL).collect()
    assert len(digests) == 2 and digests[0] == digests[1]


def test_identity_swaps_move_scores_less_with_the_regulariser(spark):
    """Neutral mentions of a group that toxic texts mention more often."""
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(["one", "two", "three", "four"]) for _ in range(12)]
        if bad:
            words[3] = "vile"
        if bad and i % 12 or i % 37 == 0:
            words[7] = "muslim"
        texts.append(" ".join(words))
        labels.append(int(bad))
    rows = toxicity.text_features(texts)
    two = [toxicity.swapped(t, i) for i, t in enumerate(texts)]
    pairs = [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in zip(toxicity.text_features([x for x, _ in two]), toxicity.text_features([y for _, y in two]), strict=True)]
    neutral = [f"{t} one two three" for t in ("muslim", "christian", "hindu", "believer")]
    moved, flagged = [], []
    for strength in (2.0, 0.0):
        model = toxicity.fit(rows, np.array(labels), np.ones(400), pairs, strength=strength)
        scores = model.scores(*tk.raw(pa.array(neutral)))
        moved.append(np.ptp(scores))
        flagged.append(int((scores >= 0.5).sum()))
        assert (model.scores(*tk.raw(pa.array(["one vile two"]))) > model.scores(*tk.raw(pa.array(["one two"])))).all()
    assert moved[0] < 0.5 * moved[1] and flagged[0] <= flagged[1]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_held_out_labels(spark):
    """Of the given tables: most held-out toxic texts are found, clean ones left alone, languages right."""
    got = queries.op7_toxicity(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out and toxic is not null")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9 and n.get((0, 1), 0) <= 0.01 * n[0, 0]
    named = queries.op2_language_id(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    right = named.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.99


def test_shards_and_ids_of_clashing_and_missing_columns(spark):
    """Columns with the operators' own names are not read; an empty table gives an empty result; repeated rows stay."""
    own = ("size", "shard", "slot", "node", "row", "tie", "at", "d_id", "n_tokens", "ids_sha256")
    docs = spark.createDataFrame([(1, "one text", "s", "en"), (1, "one text", "s", "en"), (None, None, None, None), (3, "", "s", None)], "doc_id long, text string, source string, lang string").withColumns({c: F.lit("x") for c in own})
    placed = sharding.kd_shards(docs).collect()
    assert sorted(r["size"] for r in placed) == [1, 1, 9, 9] and {r["law"] for r in placed} == {"bytes"}
    assert sorted(r["n_tokens"] for r in sentencepiece_codec.encode_digests(docs, MODEL).collect())[:2] == [0, 0]
    assert sharding.kd_shards(docs.limit(0)).collect() == [] and sentencepiece_codec.encode_digests(docs.limit(0), MODEL).collect() == []


def test_ids_of_a_very_long_text_are_the_library_s(spark):
    text = "der ung and " * 400_000
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("der ung and "), 400_000).alias("text"))
    ids = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)
    assert sentencepiece_codec.encode_digests(docs, MODEL).first()["n_tokens"] == len(ids)
