"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gets what the one before kept, reread from
Parquet.  All but the last return the columns of ``documents``; rows that a stage
rejects are gone, and everything else about a row stays unless the stage says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import chosen_path, importance, line_dedup, packing, queries, toxicity
from quadrille.llm.common import Workspace, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxic grade is below one half.  A null text has no toxic words and stays."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(~F.col("rejected")).select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws."""
    _, ratios, least = queries.quality_scores(spark, docs, table(spark, sf_dir, "labels"))
    scored = importance.score(docs, ratios).withColumn("_key", importance.sample_key())
    return scored.where(F.col("_key") >= F.lit(least)).select(*docs.columns)


def line_dedup_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with one occurrence of each group of like lines; n_chars follows the text."""
    cleaned = line_dedup.dedup_lines(docs, Workspace(spark, "pipeline-lines"))
    n = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", n).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id; rows without a doc_id all stay."""
    found = chosen_path.near_duplicates(docs, Workspace(spark, "pipeline-near"))
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document that is left."""
    return packing.pack_documents(docs, Workspace(spark, "pipeline-packing"), queries.RANKS)


STAGES = [
    ("toxicity", toxicity_filter),
    ("quality", quality_filter),
    ("line_dedup", line_dedup_texts),
    ("near_dedup", near_dedup),
    ("packing", pack_sequences),
]

#: The stages fit models and search for near duplicates, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"{number}-{name}")
    return docs
