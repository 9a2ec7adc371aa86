"""Readers: event topics, raw sensor and label text, stored evidence."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofline.constants import FAIL, PASS
from proofline.functions.scalars import class_name
from proofline.schemas import RAW_EVENT_DDL


def topic_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """Committed records of a topic as ``key``, ``value`` and the arrival order per key."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("kafka.isolation.level", "read_committed").option("startingOffsets", "earliest")
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    # All records of one key share a partition, so the offset orders them.
    return reader.load().select(
        F.col("key").cast("string"), F.col("value").cast("string"), F.col("offset").alias("arrival")
    )


def file_stream(spark: SparkSession, path: str, arrival: bool = True, max_files: int | None = None) -> DataFrame:
    """The same columns from a folder of JSON lines files."""
    reader = spark.readStream.schema(RAW_EVENT_DDL + (", arrival bigint" if arrival else ""))
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with a column ``place`` that sorts in source order across splits."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return lines.select("value", place.alias("place"))


def sensor_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Whitespace separated numbers without header; NaN is null, a wrong width is an error."""
    parts = F.split(F.trim("value"), r"\s+")
    numbers = F.transform("_parts", lambda t: F.when(t != "NaN", t.try_cast("double")))
    bad = F.exists("_parts", lambda t: (t != "NaN") & t.try_cast("double").isNull())
    complaint = F.raise_error(F.lit("sensor row has a wrong width or a value that is not a number"))
    return text_rows(spark, path).withColumn("_parts", parts).select(
        "place", F.when((F.size("_parts") == width) & ~bad, numbers).otherwise(complaint.cast("array<double>")).alias("values"),
    )


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``±1 timestamp``: value and class name in source order; other values are an error."""
    value = F.split(F.trim("value"), r"\s+")[0].try_cast("int")
    known = F.when(value.isin(FAIL, PASS), value).otherwise(F.raise_error(F.lit("label must be -1 or 1")).cast("int"))
    return text_rows(spark, path).select("place", known.alias("actual_value")).withColumn(
        "actual_label", class_name(F.col("actual_value"))
    )


def numbered(df: DataFrame, place: str = "place") -> DataFrame:
    """Add ``number``: the place of each row in source order, from 0, without moving a row.

    ``place`` is (file, block, line) as ``text_rows`` and ``ordered_rows`` give it: the lines of a block follow one another. Only
    the blocks, a line each, are put in order; a row's number is its block's first plus its distance from the block's first line.
    """
    at = {name: F.col(place)[name] for name in ("file", "block", "line")}
    keyed = df.withColumns({f"_{name}": column for name, column in at.items()})
    blocks = keyed.groupBy("_file", "_block").agg(F.min("_line").alias("_begin"), F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)  # one row per block of the source
    starts = blocks.select("_file", "_block", "_begin", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    numbers = keyed.join(starts, ["_file", "_block"])
    return numbers.select(*df.columns, (F.col("_before") + F.col("_line") - F.col("_begin")).cast("bigint").alias("number"))


def first_rows(df: DataFrame, count: int, place: str = "place") -> DataFrame:
    """The first ``count`` rows in source order; fails if there are fewer. Rows stay where they are, however many are wanted."""
    held = df.count()
    if held < count:
        raise ValueError(f"source has fewer than {count} rows: {held}")
    return numbered(df, place).where(F.col("number") < count).drop("number")


def write_ordered(df: DataFrame, order: Sequence, path: str) -> None:
    """Write ``df`` in a total order: ranges of it in files whose numbers follow the order, each sorted."""
    df.orderBy(*order).write.mode("overwrite").parquet(path)


def ordered_rows(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_ordered`` wrote, with ``place``: the number of the file, and the row's index in it."""
    rows = spark.read.parquet(path)
    file = F.col("_metadata.file_name")
    return rows.select("*", F.struct(file.alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("_metadata.row_index").alias("line")).alias("place"))


def evidence(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def jdbc_evidence(spark: SparkSession, url: str, table: str, split_on: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table read in ``parts`` ranges of ``split_on``."""
    return spark.read.jdbc(
        url, table, column=split_on, lowerBound=low, upperBound=high, numPartitions=parts, properties=options
    )


def offline_snapshots_at(snapshots: DataFrame, cutoff: float, only_complete: bool = True) -> DataFrame:
    chosen = snapshots.where(F.col("build_cutoff_time") == F.lit(float(cutoff)))
    return (chosen.where("is_complete") if only_complete else chosen).orderBy("sample_id")
