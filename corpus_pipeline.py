"""The corpus pipeline: five stages from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. All but the last return the columns of docs.

Cases: an empty table gives no rows at any stage; null and empty texts are kept
and become sequences of the end token alone; rows with a null doc_id pass line
dedup and the near-duplicate stage as they are; of copies, ties and repeated
rows the line stage keeps each line where it comes first by doc_id (repeated
rows of one doc_id keep theirs alike), and the near-duplicate stage keeps the
rows of the least doc_id; very long texts are read whole by every stage; extra
columns stay as they are up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.llm import lines, near, packing, pii, quality
from meridion.llm.common import scratch, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    kept = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept.filter("keep").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line matches."""
    return lines.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group of near duplicates."""
    gone = near.near_duplicates(docs).filter("doc_id <> group_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["__gone"], "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_stage), ("personal_data", pii_stage), ("packing", packing_stage)]

#: No stage but the last gives rows, and neither EM, LSTM nor packing is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage has stored on its way goes with its end
            docs = stored(stage(spark, docs, sf_dir), name, outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
