"""A corpus pipeline in stages, each of which works on all documents that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwave.llm.mil_quality import fit, score_documents, training_bags
from siftwave.llm.packing import packed_rows
from siftwave.llm.prefix_join import join_similar
from siftwave.llm.quality_rules import score_quality
from siftwave.llm.storage import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), "text")
    return score_quality(whole, "text", out="quality").where("quality.kept").select("doc.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled documents of the whole table, scores 0.5 or more."""
    model = fit(*training_bags(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_documents(docs, model, out="_quality_score").where("_quality_score >= 0.5").drop("_quality_score")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id, and one row of those that share it."""
    # The stage's docs are a table that Spark reads in the same order each time, so a row's number is the same in every scan.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    joined = join_similar(numbered.select(F.col("row").alias("doc_id"), "doc.text")).select(F.col("doc_id").alias("row"), "component")
    ids = numbered.select("row", F.col("doc.doc_id").alias("doc_id"))
    first = joined.join(ids, "row").groupBy("component").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    return numbered.join(first.select("row"), "row", "left_semi").select("doc.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that are left."""
    return packed_rows(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("best-fit packing", best_fit_packing),
]

# The classifier, the join of near duplicates and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
