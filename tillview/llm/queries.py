"""The numbered queries and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.llm import content_sort, cover_tree, decontamination, fm_index, gam, hard_negatives, host_reputation, packing, periods, pieces, range_coder, warc, weighted_minhash

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return content_sort.exact_groups(_table(spark, sf_dir, "documents"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with an end id, and decoded again."""
    return pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents: five words a shingle, weighted similarity of 0.8 or more."""
    return weighted_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page by rule or by the reputation of its host."""
    return host_reputation.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, as read back from them."""
    manifest = warc.write_pages(spark, _table(spark, sf_dir, "pages"))
    return warc.by_page(warc.read_archives(manifest))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to coded files, as read back from them."""
    manifest = range_coder.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return range_coder.read_digests(manifest)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from the labels that are not held out."""
    return gam.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that begin in a document with a smaller id."""
    return fm_index.repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95."""
    return cover_tree.links(_table(spark, sf_dir, "embeddings"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, after documents chosen by their id were made to repeat."""
    return periods.digests(periods.periodic_runs(periods.stuttering(_table(spark, sf_dir, "documents"))))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector among all vectors."""
    found = hard_negatives.hard_negatives(hard_negatives.whole_scores(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)
    return found.withColumns({c: F.col(c).cast("long") for c in ("positive_score", "negative_score")})


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the windows of ten words of all benchmark items."""
    return decontamination.digests(decontamination.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_packing": op4_packing,
    "op5_url_filter": op5_url_filter,
    "op6_warc": op6_warc,
    "op7_token_files": op7_token_files,
    "op8_quality": op8_quality,
    "op9_repeats": op9_repeats,
    "op10_vectors": op10_vectors,
    "op11_runs": op11_runs,
    "op12_negatives": op12_negatives,
    "op13_decontamination": op13_decontamination,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op5_url_filter": host_reputation.SQL,
    "op6_warc": warc.SQL,
    "op10_vectors": cover_tree.SQL,
    "op12_negatives": hard_negatives.SQL,
    "op13_decontamination": decontamination.SQL,
}
