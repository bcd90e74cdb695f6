"""From raw documents to token ids: toxicity, line de-duplication, near de-duplication, benchmark decontamination, byte-level BPE."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberlake.llm import bpe, decontamination, line_dedup, near_duplicates, toxicity
from fiberlake.llm.common import shared_checkpoints, table
from fiberlake.llm.labelled import held_out
from fiberlake.llm.queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not reject."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(3, 1))
    return toxicity.score(docs, model).where(f"score < {toxicity.THRESHOLD}").select("document.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines held by an earlier document go, and documents of which nothing else is left. n_chars follows the text."""
    out = line_dedup.line_dedup(docs).where(r"n_dropped = 0 or document.text rlike '\\S'").select("document")
    if "n_chars" in docs.columns:
        out = out.select(F.col("document").withField("n_chars", F.char_length("document.text").cast(docs.schema["n_chars"].dataType)).alias("document"))
    return out.select("document.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle sets with similarity of 0.8 or more."""
    return near_duplicates.drop_near_duplicates(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and their digest columns; the ids decode to the text's bytes."""
    out = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return out.selectExpr("document.doc_id", "cast(size(ids) as bigint) as n_tokens", "ids", "sha2(decoded, 256) as decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", to_tokens),
]

#: SQL can express neither the trained model nor the encoding; tests hold run() against brute-force versions.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again. A stage's table goes once the next one is written."""
    shared_checkpoints(spark)
    docs = table(spark, sf_dir, "documents")
    top = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}_{name}")
        docs = spark.read.parquet(f"{top}/{k}_{name}")
        if k:
            remove(spark, f"{top}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
