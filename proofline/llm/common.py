"""Small helpers shared by the operators: tables, written intermediate results, Arrow columns."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.session import scratch

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# What separates words in every operator: blank and the ASCII control spaces. Fixed value.
BLANKS = "[\\x20\\x09-\\x0D]+"


# Paths of written tables by the stage of a pipeline that wrote them.
LEFT: dict[str, list[str]] = {}
STAGE = [""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the write go when it is done; nothing can need them any more.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    LEFT.setdefault(STAGE[0], []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def of_ids(rows: DataFrame, found: DataFrame, key: str, most: int = 2_000_000) -> DataFrame:
    """The rows whose key is in ``found``, without moving their texts if there are at most ``most`` ids (8 bytes each) to send.

    More ids are joined by shuffle; the result is the same.
    """
    found = saved(found.select(key).distinct(), "ids")
    return rows.join(F.broadcast(found) if found.count() <= most else found, key, "left_semi")


def last_saved() -> str:
    return LEFT[STAGE[0]][-1]


def begin_stage(spark: SparkSession, name: str, after: str | None = None) -> None:
    """Name what is written from now on; delete what the stage ``after`` left, whose result has been written by now."""
    STAGE[0] = name
    for path in LEFT.pop(after, []) if after else []:
        forget(spark, path)


def tokenizer_definition(path: str) -> str:
    """The text of a public tokenizer file; it travels to the tasks with the job, a few MB."""
    return Path(path).read_text(encoding="utf-8")


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator works on, under its own names; other columns, whatever their names, stay out."""
    return df.select(*[F.col(f"`{column}`").alias(name) for name, column in columns.items()])


def ids(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.cast(pa.int64())
