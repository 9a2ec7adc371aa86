"""Idempotent writes. Planning functions return DataFrames; the writers around them are thin."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofline.operators.latest import top_per_key
from proofline.operators.scale import attach


def new_rows(
    incoming: DataFrame, existing: DataFrame | None, keys: Sequence[str], order: Sequence, null_keys: bool = False,
) -> DataFrame:
    """Insert-ignore: the first row per key in ``order`` unless the key is stored.

    With ``null_keys`` nulls count as equal; without, the join reuses the partitioning of the ranking. The stored keys are never
    broadcast: a compressed table is taken for smaller than its keys are, and they would all pass through the driver.
    """
    firsts = top_per_key(incoming, keys, order)
    if existing is None:
        return firsts
    if null_keys:
        return attach(firsts, existing.select(*keys), keys, "left_anti")
    return firsts.join(existing.select(*keys).hint("merge"), list(keys), "left_anti")


def insert_counts(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Received, inserted and duplicate counts of an insert-ignore, as one row."""
    per_key = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    stored = existing.select(*keys).distinct().withColumn("_stored", F.lit(1))
    marked = per_key.join(stored, list(keys), "left")
    return marked.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("received"),
        F.count_if(F.col("_stored").isNull()).alias("inserted"),
    ).withColumn("duplicates", F.col("received") - F.col("inserted"))


def replay_conflicts(
    incoming: DataFrame, existing: DataFrame | None, key: str, payload: Sequence[str], order: Sequence,
) -> DataFrame:
    """Incoming rows whose id is known, from the table or earlier in the batch, with another payload.

    The payload that counts is the stored one, else that of the first row in the batch. Repeats are reduced to one row per id
    and payload before ids meet, so an id with many repeats costs its distinct payloads; the rows themselves are only joined
    to the payloads found wrong.
    """
    place = F.struct(*order)
    variants = incoming.groupBy(key, F.struct(*payload).alias("_payload")).agg(F.min(place).alias("_first"))
    agreed = variants.groupBy(key).agg(F.min_by("_payload", "_first").alias("_agreed"))
    if existing is not None:
        known = existing.select(key, F.struct(*payload).alias("_known")).hint("merge")  # as in new_rows
        agreed = agreed.join(known, key, "left").withColumn("_agreed", F.coalesce("_known", "_agreed")).drop("_known")
    wrong = variants.join(agreed.hint("merge"), key).where(~F.col("_payload").eqNullSafe(F.col("_agreed"))).select(key, "_payload")
    marked = incoming.withColumn("_mine", F.struct(*payload))
    same = (marked[key] == wrong[key]) & marked["_mine"].eqNullSafe(wrong["_payload"])
    return marked.join(wrong, same, "left_semi").select(*incoming.columns)


def merged(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str, keep: Sequence[str] = (),
) -> DataFrame:
    """Upsert: the incoming row with the highest ``order`` replaces the stored one, whatever the order of that one.

    ``keep`` names columns (such as a surrogate id) whose stored value survives. One aggregate by key over the stored and the
    incoming rows; null keys match each other.
    """
    columns = existing.columns
    both = existing.withColumn("_new", F.lit(False)).unionByName(incoming.select(*columns).withColumn("_new", F.lit(True)))
    rest = [c for c in columns if c not in keys]
    # The order column of a stored row does not count: it loses to any incoming one.
    place = F.struct("_new", F.when(F.col("_new"), F.col(order)))
    held = [F.max_by(c, ~F.col("_new")).alias(f"_keep_{c}") for c in keep]
    stored = F.bool_or(~F.col("_new")).alias("_stored")
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_row"), stored, *held)
    value = {c: F.col("_row")[c] for c in rest}
    for c in keep:
        value[c] = F.when(F.col("_stored"), F.coalesce(f"_keep_{c}", value[c])).otherwise(value[c])
    return best.select(*[F.col(c) if c in keys else value[c].alias(c) for c in columns])


@dataclass(frozen=True)
class Table:
    """A Parquet folder with a primary key, in ``buckets`` partitions by the hash of the key. One writer per table.

    A batch of rows only concerns the partitions its keys fall into, so look-ups read those and nothing else (a partition
    filter), and an upsert rewrites those and no other (dynamic partition overwrite). The number of partitions is part of the
    partition column's name and belongs to the table; take many, so that a batch touches few. 0 keeps the rows together, for
    small logs that are only appended to.

    Inserts can be repeated at any point. An upsert swaps partition by partition when its job commits; if the driver is lost
    in those moments, repeat it from the history the table is derived from.
    """

    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    @property
    def bucket(self) -> str:
        return f"key_hash_of_{self.buckets}"

    def exists(self, spark: SparkSession) -> bool:
        """Has a write committed anything? What a failed one leaves has names that begin with an underscore or a dot."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        return system.exists(folder) and any(s.getPath().getName()[0] not in "_." for s in system.listStatus(folder))

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.bucket, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")) if self.buckets else rows

    def touched(self, rows: DataFrame) -> list[int]:
        """The partitions the keys of ``rows`` fall into: one small number each, ``buckets`` at most."""
        return sorted(r[0] for r in self.bucketed(rows).select(self.bucket).distinct().collect()) if self.buckets else []

    def read(self, spark: SparkSession, only: Sequence[int] | None = None) -> DataFrame | None:
        """The stored rows, of the partitions ``only`` if given; None before the first write."""
        if not self.exists(spark):
            return None
        stored = spark.read.parquet(self.path)
        if not self.buckets:
            return stored
        return (stored if only is None else stored.where(F.col(self.bucket).isin(*only))).drop(self.bucket)

    def _write(self, rows: DataFrame, mode: str) -> None:
        if not self.buckets:
            rows.write.mode(mode).parquet(self.path)
            return
        placed = self.bucketed(rows)
        if rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
            placed = placed.hint("rebalance", F.col(self.bucket))  # a file or few per partition, large ones split
        else:  # a stream with state turns the adaptive plan off, and the hint with it: a file per partition, not one per task
            placed = placed.repartition(F.col(self.bucket))
        placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(self.bucket).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        self._write(rows, "append")

    def insert_ignore(self, rows: DataFrame, order: Sequence, only: Sequence[int] | None = None) -> None:
        """Append the rows whose key is not stored; repeating the call changes nothing. ``only``: ``touched(rows)`` if known."""
        if not self.buckets:
            raise ValueError("a table without partitions is only appended to")
        stored = self.read(rows.sparkSession, self.touched(rows) if only is None else only)
        self.append(new_rows(rows, stored, self.keys, order))

    def upsert(self, rows: DataFrame, order: str, keep: Sequence[str] = ()) -> None:
        """Replace or add a row per key of ``rows``; partitions without such a key keep their files."""
        if not self.buckets:
            raise ValueError("a table without partitions is only appended to")
        spark = rows.sparkSession
        stored = self.read(spark, self.touched(rows))
        self._write(merged(rows.limit(0) if stored is None else stored, rows, self.keys, order, keep), "overwrite")
        spark.catalog.refreshByPath(self.path)


def as_stored(rows: DataFrame, schema: StructType, **constants) -> DataFrame:
    """``rows`` in the columns, types and order of a stored table; ``constants`` fill columns of the same value everywhere.

    A column that is in neither is null, which a required column does not take: the job stops.
    """
    given = {name: F.lit(value) for name, value in constants.items()} | {c: F.col(c) for c in rows.columns}
    made = []
    for field in schema.fields:
        value = given.get(field.name, F.lit(None)).cast(field.dataType)
        if not field.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"{field.name} is required")).cast(field.dataType))
        made.append(value.alias(field.name))
    return rows.select(*made)


def latest_table(history: DataFrame) -> DataFrame:
    """The newest snapshot per sample. The first recorded ``available_at`` of a snapshot is never replaced."""
    firsts = top_per_key(history, ["serving_snapshot_id"], ["available_at"])
    return top_per_key(firsts, ["sample_id"], [F.col("snapshot_version").desc()])


def as_messages(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows as keyed compact JSON, the form of the event topics. Null fields are written."""
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def prediction_evidence(scored: DataFrame, slot: str | None = None) -> DataFrame:
    """Scored rows to prediction events, without the features and with a runtime slot."""
    columns = [c for c in scored.columns if c not in ("features", "values", "runtime_slot")]
    given = F.col("runtime_slot") if "runtime_slot" in scored.columns else F.lit(None).cast("string")
    return scored.select(*columns, F.coalesce(F.lit(slot), given, F.lit("unknown")).alias("runtime_slot"))
