"""Corpus preparation in stages: from raw documents to packed training sequences.

``STAGES`` lists (name, function); a function takes (spark, docs, folder) and
returns a DataFrame. All but the last return the columns of documents, whatever
these are: inside a stage, columns go by numbers, so no name of the input can
clash with one of an operator's. ``doc_id`` and ``text`` must be there. In every
stage:

- Null and empty texts count as empty; null ones stay null. They aren't toxic
  by themselves, but fail the base rule of the quality stage.
- Repeated rows, and rows with equal or null ids, are separate documents up to
  the near-duplicate stage, which keeps one row of each group.
- Ties: a toxicity score of exactly 0.5 goes; of near duplicates with the
  smallest id the one row with the least hash of id and text stays.
- Very long texts are read in stretches and stay whole.
- An empty table gives an empty table with the same columns (the last stage:
  with those of the pieces); without labels nothing is dropped but by the base rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import jaccard_join, packing, quality_rules, suffix_dedup, toxicity
from fieldlens.llm.queries import fold, tokenizer_path
from fieldlens.plans.lineage import materialize
from fieldlens.plans.tables import table


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """The documents with columns __c0, __c1, ...; these names; those of id and text."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. It learns from the labelled ones among them, those of op7's held-out fold left out."""
    rows, names, id_col, text_col = _numbered(docs)
    labels = table(spark, folder, "labels").filter(fold(5) != 0).withColumnRenamed("doc_id", id_col)
    model = toxicity.train(rows, labels, id_col, text_col)
    return toxicity.score(rows, model, names, text_col).filter("predicted = 0").select(*names).toDF(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list."""
    rows, names, id_col, text_col = _numbered(docs)
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", id_col)
    rules = quality_rules.train(rows, labels, id_col, text_col)
    return quality_rules.apply(quality_rules.with_statistics(rows, names, text_col), rules).filter("kept").select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. A row without an id counts as smallest."""
    rows, names, id_col, text_col = _numbered(docs)
    rows = rows.withColumn("__rid", F.xxhash64(id_col, text_col))
    grouped = jaccard_join.components(rows.select(F.struct(F.col(id_col).alias("id"), F.col("__rid").alias("rid")).alias("doc_id"), F.col(text_col).alias("text")), n=5, similarity=(80, 100))
    first = grouped.filter("doc_id.rid = component_id.rid").select(F.col("doc_id.rid").alias("__first"))
    return rows.join(first, F.col("__rid") == F.col("__first"), "left_semi").dropDuplicates(["__rid"]).select(*names).toDF(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents without the bytes of strings that occur elsewhere too; ``n_chars``, if there, counts what is left."""
    rows, names, id_col, text_col = _numbered(docs)
    rest = suffix_dedup.dedup(rows.withColumn("__was_null", F.col(text_col).isNull()), [*(c for c in names if c != text_col), "__was_null"], 200, id_col, text_col, with_text=True)
    rest = rest.withColumn(text_col, F.when(~F.col("__was_null"), F.col("kept_text")))
    if "n_chars" in docs.columns:
        count = names[docs.columns.index("n_chars")]
        rest = rest.withColumn(count, F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return rest.select(*names).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), 1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each on what its predecessor kept, cut off from it by a checkpoint."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, folder)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs


#: SQL can't express the learned stages and the clusters; tests hold each stage against a brute-force version.
ORACLE_SQL = None
