"""Registered queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import attribution, chosen_path, flat_graph, importance, line_dedup, packing, spm_bpe, toxicity, warc, weighted_sampling
from quadrille.llm.common import Workspace, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document; rejected ones are toxic."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", F.round("expected_severity", 6).alias("expected_severity"), F.round("p_toxic", 6).alias("p_toxic"), "rejected")


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole text."""
    return attribution.token_counts(table(spark, sf_dir, "documents"), RANKS)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, lines removed and the digest of the text that stays, of every document."""
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), Workspace(spark, "lines"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))


def op4_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return flat_graph.near_vectors(table(spark, sf_dir, "embeddings"), Workspace(spark, "flat-graph"))


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight, sampling key and selection of every document."""
    scored, _, least = quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    keyed = scored.withColumn("sample_key", importance.sample_key()).withColumn("selected", F.col("sample_key") >= F.lit(least))
    return keyed.select("doc_id", "n_grams", F.round("log_weight", 6).alias("log_weight"), F.round("sample_key", 6).alias("sample_key"), "selected")


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, np.ndarray, float]:
    """The scores of all documents without their texts, the log ratios, and the sampling threshold.

    k is the number of documents that look like the target, the labelled good text: the
    cut on the mean log ratio comes from a bounded sample of labels, and how many pass
    it is counted over all documents.
    """
    work = Workspace(spark, "importance")
    ratios = importance.log_ratios(docs, importance.target_keys(labels))
    scored = work.save(importance.score(docs.select("doc_id", "text"), ratios).drop("text"), "scored")
    cut = importance.calibrate(scored, labels)
    k = scored.where(F.col("mean_log_ratio") >= cut).count()
    return scored, ratios, importance.sampling_threshold(scored, k)


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return weighted_sampling.fingerprints(table(spark, sf_dir, "documents"))


def op7_spm_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the serialised sentencepiece model, and what they decode to."""
    return spm_bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), Workspace(spark, "packing"), RANKS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC archives and read back."""
    files = warc.write_archives(table(spark, sf_dir, "pages"), Workspace(spark, "warc"))
    found = warc.read_archives(files)
    return found.select(
        F.expr("try_cast(nullif(regexp_extract(record_id, '^<urn:row:(-?[0-9]+)>$', 1), '') as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(nullif(regexp_extract(refers_to, '^<urn:row:(-?[0-9]+)>$', 1), '') as bigint)").alias("refers_to"),
    )


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "chosen-path"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_attribution, op3_line_dedup, op4_flat_graph, op5_importance, op6_weighted_sampling, op7_spm_bpe, op8_packing, op9_warc, op10_chosen_path)}
ORACLE_SQL: dict[str, str] = {
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
             m AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN last > page_id THEN last END AS refers_to
        FROM p LEFT JOIN m ON p.d = m.d AND n >= 1000
    """,
}
