"""From raw documents to packed training sequences: quality, exact and near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All stages but the last return the columns
of ``docs``. A null text is kept as null where nothing is taken from it and otherwise counts as empty; rows with a
null doc_id pass the duplicate stages unless their text is an exact copy; empty tables give empty results; further
columns, whatever their names, are handed on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.llm import content_sort, fm_index, gam, packing, weighted_minhash
from tillview.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return gam.keep(docs, gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the smallest doc_id."""
    return content_sort.unique_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest doc_id."""
    found = weighted_minhash.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_near_duplicate")).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col("_near_duplicate"), "left_anti")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller doc_id holds; n_chars follows the text."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    at = {c: f"c{i}" for i, c in enumerate(carry)}
    out = fm_index.repeats(docs, carry=carry, renamed=False)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    columns = {c: F.col(at.get(c, c)) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(columns["n_chars"])
    return out.select(*[v.cast(kinds[c]).alias(c) for c, v in columns.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("passages", passages), ("pack", pack)]

# Scores, weighted samples and packing have no SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what a stage returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
