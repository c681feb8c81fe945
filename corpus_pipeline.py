"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, secret scans, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents. Labels, lang, source and doc_id are no inputs of the toxicity scores; its
model is learned from the labelled rows of the corpus that aren't held out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, ngram_join, secret_scan, sentencepiece_codec, toxicity
from tessera.llm._io import checkpoint_folder, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.3; null and empty texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model, threshold=0.3)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose shingles of five words link at a Jaccard similarity of 0.8."""
    return ngram_join.first_of_each(docs, k=5, num=80, den=100)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows the text."""
    out = secret_scan.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))
    return out.select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and round_trip: whether the ids decode to the text."""
    return sentencepiece_codec.encoded(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", not_in_benchmark),
    ("secret_scans", without_secrets),
    ("sentencepiece", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet into the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
