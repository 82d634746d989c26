import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldlens.llm import language_id, quality_rules, toxicity
from fieldlens.llm import textkit as tk

LANGS = {"aa": "the and of ing ation", "bb": "der die und ung keit", "cc": "le la et ment eau", "dd": "el los y ción mente"}


def prose(rng, lang, n):
    parts = LANGS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 2))) for _ in range(n))


def corpus(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        rows.append((i, prose(rng, lang, rng.randint(20, 60)), lang if i % 7 else None))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_codewords_differ_in_many_bits():
    for n in (2, 4, 6, 12, 30):
        code = language_id.codewords(n)
        far = (code[:, None] != code[None]).sum(2) + 10**6 * np.eye(n, dtype=int)
        assert far.min() >= (1 if n == 2 else code.shape[1] / 4)


def test_languages_of_held_out_texts(spark):
    rows, docs = corpus(spark)
    model = language_id.train(docs.filter("doc_id % 4 <> 2"), "text", "lang")
    assert model.languages == sorted(LANGS)
    got = {r[0]: r for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    held = [(i, lang) for i, _, lang in rows if i % 4 == 2 and lang]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_undetermined_texts_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, "aa"), (2, "", "aa"), (3, "123 ...", "aa"), (4, "é", "aa"), (None, "and", "bb")], "doc_id long, text string, lang string")
    model = language_id.train(docs, "text", "lang")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in ("aa", "bb") and got[None] in ("aa", "bb")
    none = language_id.train(docs.filter("false"), "text", "lang")
    assert {r["lang_pred"] for r in language_id.predict(docs, none, ["doc_id"]).collect()} == {"und"}
    assert language_id.predict(docs.filter("false"), model, ["doc_id"]).count() == 0


def test_every_counted_language_is_learned(spark):
    """More than 64 languages, the last of which has the fewest rows."""
    names = [f"l{i:02}" for i in range(70)]
    rows = [(i * 10 + j, " ".join([f"{chr(0x4E00 + 7 * i)}{chr(0x4E01 + 7 * i)}"] * (5 + j)), lang) for i, lang in enumerate(names) for j in range(3 if i < 69 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, "text", "lang", id_col="doc_id")
    assert model.languages == names
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.97 * len(rows)


def test_a_large_group_of_copies_hides_no_language(spark):
    """The copied text is one that a hash of the text alone picks, and its rows come first."""
    hot = spark.range(20000).selectExpr("concat('der die ', id) as t").orderBy(F.expr("pmod(xxhash64(t), 2147483648L)")).first()["t"]
    rng = random.Random(9)
    rows = [(i, hot, "bb") for i in range(3000)] + [(3000 + i, prose(rng, "bb", 20), "bb") for i in range(300)] + [(4000 + i, prose(rng, "cc", 20), "cc") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    for id_col in ("doc_id", None):
        model = language_id.train(docs, "text", "lang", per_language=20, id_col=id_col)
        assert model.languages == ["bb", "cc"]
        got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model, ["doc_id"]).collect()}
        assert sum(got[i] == lang for i, _, lang in rows) >= 0.97 * len(rows)


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(marked)]


def test_statistics_equal_brute_force():
    rng = random.Random(3)
    texts = ["", "\n", " \n a\n a\n a", "a " * 9, "é é|#\n\né é|#", "\n\n\n", "x\r\nx\r\n"]
    texts += ["".join(rng.choice(["a", "b ", " ", "\n", "é", "#", "a b a b a b a b ", "\t"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    got = quality_rules.statistics(*tk.raw(pa.array(texts)))
    assert got[:, :5].tolist() == [brute_statistics(t) for t in texts]


def test_rules_find_bad_texts_and_spare_good_ones(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        text = prose(rng, "aa", rng.randint(30, 60))
        if i % 6 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i % 6 == 1:
            text = " | ".join(text.upper().split())
        rows.append((i, text, 1))
        labels.append((i, int(i % 6 > 1) if i % 25 else None, 0))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, n_words long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = quality_rules.train(docs, marks)
    assert rules and all(r.precision >= 0.8 for r in rules)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.apply(quality_rules.with_statistics(docs, ["doc_id"]), rules).collect()}
    assert sum(got[i] == (i % 6 > 1) for i in got) >= 0.97 * len(got)


def test_base_rule_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b"), (3, " ".join(map(str, range(40)))), (4, "a b c d e f g h " * 6), (None, "x " * 30)], "doc_id long, text string")
    rules = quality_rules.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.apply(quality_rules.with_statistics(docs, ["doc_id"]), rules).collect()}
    assert rules == [] and got == {1: (True, False), 2: (True, False), 3: (False, True), 4: (True, False), None: (True, False)}


def toxic_corpus(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        words = prose(rng, "aa", rng.randint(15, 40)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["nasty", "vile", "rotten"])
        if bad and i % 2 or i % 11 == 0:
            words[rng.randrange(len(words))] = "women"  # over-represented among the toxic ones
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_texts_are_found_and_identity_terms_are_not(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels.filter("doc_id % 4 <> 0"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [r for r in labels.collect() if r["doc_id"] % 4 == 0]
    assert sum(got[r["doc_id"]] == r["toxic"] for r in held) >= 0.97 * len(held)
    pair = spark.createDataFrame([(1, "the women and the ation"), (2, "the men and the ation"), (3, "the people and the ation")], "doc_id long, text string")
    scores = [r["score"] for r in toxicity.score(pair, model, ["doc_id"]).collect()]
    assert max(scores) < 0.5 and max(scores) - min(scores) < 0.05


def test_scores_without_text_or_labels(spark):
    docs, labels = toxic_corpus(spark)
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "vile nasty rotten", 5)], "doc_id long, text string, __y int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(odd, model, ["doc_id"]).collect()}
    assert got[1]["score"] == got[2]["score"] < 0.5 and got[None]["predicted"] == 1
    none = toxicity.train(docs, labels.filter("false"))
    assert {r["predicted"] for r in toxicity.score(odd, none, ["doc_id"]).collect()} == {0}
    assert toxicity.score(odd.filter("false"), model, ["doc_id"]).count() == 0


def test_identity_terms_are_swapped_in_the_whole_text(spark, monkeypatch):
    """The only term of a long text lies at its end."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels, weight, pairs: seen.extend(pairs))
    docs = spark.createDataFrame([(1, "ation " * 1500 + "women")], "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    ((without, put_in),) = seen
    assert without.tolist() == toxicity.text_features(["women"])[0].tolist()
    others = toxicity.text_features([t for t in toxicity.IDENTITY_TERMS[0] if t != "women"])
    assert put_in.tolist() in [o.tolist() for o in others]
