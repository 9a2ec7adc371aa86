"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows that the one before kept; between stages the rows are written as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import begin_stage, public_tokenizer, saved, table
from proofline.llm.decontaminate import without_contaminated
from proofline.llm.lines import dedup_lines
from proofline.llm.packing import pack
from proofline.llm.quality import kept_documents
from proofline.llm.simhash import near_duplicates
from proofline.session import configure


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that fail a base rule or leave their language's perplexity band go."""
    configure(spark)
    begin_stage(spark, "quality_rules")
    return kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines that match an earlier line go; the documents stay, with their length brought up to date."""
    configure(spark)
    begin_stage(spark, "line_dedup", after="quality_rules")
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near-duplicates one document stays, that of the smallest id (a null one last).

    Rows are told apart by a number of their own, so rows of equal or null ids are dropped only as near-duplicates. Of equal ids
    the smallest text hash stays, then the smallest number.
    """
    configure(spark)
    begin_stage(spark, "near_dedup", after="line_dedup")
    rows = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "_row")
    groups = near_duplicates(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    first = (
        groups.join(rows.select("_row", rank.alias("rank")), "_row").groupBy("component_id").agg(F.min("rank").alias("first"))
        .select(F.col("first._row").alias("_row"))
    )
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that contain a benchmark item go."""
    configure(spark)
    begin_stage(spark, "decontamination", after="near_dedup")
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the places of the documents' tokens in sequences of 2048."""
    configure(spark)
    begin_stage(spark, "packing", after="decontamination")
    return pack(docs, public_tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Tokenization and the trained language model cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, rows, sf_dir)
        begin_stage(spark, "kept")
        rows = saved(kept, name)
    return STAGES[-1][1](spark, rows, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
