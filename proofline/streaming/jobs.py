"""Streaming jobs around the contracts and tables: archive, materialize, score."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofline.operators.latest import top_per_key
from proofline.operators.validate import Contract, check
from proofline.session import SETTINGS
from proofline.sources.sinks import Table, replay_conflicts

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_SETTINGS = {**SETTINGS, "spark.sql.streaming.stateStore.providerClass": ROCKSDB}
LABEL_PAYLOAD = ("sample_id", "label_revision", "actual_value", "actual_label")


def start(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, name: str, once: bool = False,
    every: str = "10 seconds",
) -> StreamingQuery:
    """Run ``step`` per micro-batch. Offsets are committed after it returns, so a replayed batch must be harmless."""
    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def archive_step(
    contract: Contract, table: Table, quarantine: str, clock: Callable[[], float], stamp: str | None = None,
    payload: Sequence[str] | None = None, arrival: str = "arrival",
) -> Callable[[DataFrame, int], None]:
    """Validate, set bad rows aside, insert the rest if their key is new.

    ``stamp`` names a column set to the time of the insert. With ``payload`` a known key must bring the
    same payload again, else the batch fails.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        checked = check(batch, contract).persist()
        try:
            bad = checked.where(F.size("reasons") > 0).select("key", "value", "reasons")
            bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
            rows = checked.where(F.size("reasons") == 0).drop("key", "value", "reasons")
            only = table.touched(rows)
            if payload is not None:
                stored = table.read(batch.sparkSession, only)
                clash = replay_conflicts(rows, stored, table.keys[0], payload, [arrival]).first()
                if clash is not None:
                    raise RuntimeError(f"payload conflict for {table.keys[0]}={clash[table.keys[0]]}")
            if stamp is not None:
                rows = rows.withColumn(stamp, F.lit(float(clock())))
            table.insert_ignore(rows, [arrival], only)
        finally:
            checked.unpersist()

    return step


def dedupe_by_state(valid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop repeated keys with the state store instead of a lookup in the table.

    The work per batch depends on the batch alone, however large the table has grown; repeated keys must carry
    equal payloads. Write the result with ``batch_append``.
    """
    return valid.dropDuplicates(list(keys))


def batch_append(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder; a replayed batch overwrites itself."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return step


def materialize_step(history: Table, clock: Callable[[], float], publish: Callable[[DataFrame], None] | None = None):
    """Newest snapshot per sample to ``publish``, then all snapshots to the history with their availability.

    The time is taken after publishing. A snapshot that is already stored keeps its first availability.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            if publish is not None:
                publish(top_per_key(rows, ["sample_id"], [F.col("snapshot_version").desc()]))
            history.insert_ignore(rows.withColumn("available_at", F.lit(float(clock()))), ["snapshot_version"])
        finally:
            rows.unpersist()

    return step


def refreshed_latest(latest: DataFrame | None, history: DataFrame) -> DataFrame:
    """The latest table after another refresh: only history newer than the previous table is read."""
    if latest is None:
        return top_per_key(history, ["sample_id"], [F.col("snapshot_version").desc()])
    seen = latest.agg(F.max("available_at")).first()[0]
    fresh = history if seen is None else history.where(F.col("available_at") >= F.lit(seen))
    both = latest.unionByName(fresh.select(*latest.columns))
    return top_per_key(both, ["sample_id"], [F.col("snapshot_version").desc(), F.col("available_at")])
