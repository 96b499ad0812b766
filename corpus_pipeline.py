"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``;
``n_chars`` follows the text. Every stage is written as Parquet and read again, so a lost
executor costs at most one stage. Nulls, empty tables and repeated rows are as the operator of
the stage defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import jaccard_join, langid, line_dedup, mixing, packing
from tapewright.llm.common import importable_by_tasks
from tapewright.llm.queries import tokenizer
from tapewright.session import materialize, scratch

MIN_SCORE = 0.5  # share of a text's n-grams that its language must explain
CACHED_WORDS = 15_000  # executors that ran the stages before have less room for packing


def as_documents(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``like``; a column ``n_chars`` is counted anew."""
    counted = {"n_chars": F.length("text").cast("bigint")} if "n_chars" in like.columns else {}
    return rows.withColumns(counted).select(*like.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages: not ``und``, and not under ``MIN_SCORE``.

    Learnt from the labels of the documents themselves. Rejects texts that are null or have no
    letter; without any label, only those.
    """
    with scratch(spark):  # the model is all that is needed of training
        model = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    said = langid.identify(docs, model, lang="_said", score="_score")
    good = F.col("_said") != "und"
    if model.languages:
        good = good & (F.col("_score") >= MIN_SCORE)
        return said.where(good).select(*docs.columns)
    return docs.where(F.col("text").rlike(r"\p{L}"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long lines they share with many others."""
    return as_documents(line_dedup.drop_shared_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in reading order, as often as their source's target wants them."""
    placed = mixing.place(docs, keep=docs.columns)
    return as_documents(mixing.ordered_texts(placed, docs.columns), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, cached_words=CACHED_WORDS, **tokenizer())


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: A language model, MinHash classes and byte-pair tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable_by_tasks(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
