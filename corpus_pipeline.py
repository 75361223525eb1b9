"""Corpus pipeline: clean, deduplicate and pack ``documents``, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, line_dedup, packing, suffix_dedup, toxicity
from tidemark.llm.shared import drop_table, materialize


def _recount(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the rows not held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out()))
    return toxicity.keep_below(docs, model, 0.3)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of like lines the first stays; documents stay, with fewer lines."""
    return _recount(line_dedup.dedup_lines(docs))


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked texts the document with the smallest id stays.

    Documents without words are linked with nothing and stay.
    """
    classes = jaccard_join.link_classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_id"))
    return docs.join(classes, docs["doc_id"] == classes["_id"], "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that an earlier text holds are cut out."""
    return _recount(suffix_dedup.dedup_text(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_per_class),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: Fitted models, fingerprints and tokenizers are beyond SQL; tests/llm holds each stage and run() to brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage has read is deleted once its result is written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        drop_table(spark, *written)
        written = [docs]
    return docs
