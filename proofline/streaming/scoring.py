"""Scoring of snapshots by several models at once: the released one decides, shadow models are recorded beside it."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.constants import FAIL, PASS
from proofline.operators.latest import top_per_key
from proofline.sources.sinks import Table

DECISIONS = (
    "prediction_id string, request_id string, sample_id string, serving_snapshot_id string, snapshot_version bigint, "
    "feature_hash string, model_run_id string, runtime_slot string, predicted_at double, fail_probability double, "
    "predicted_value int, predicted_label string, threshold double, missing_count int"
)


@dataclass(frozen=True)
class Model:
    """A model of one slot: ``score`` takes rows of features, NaN where there is none, and gives probabilities of failure."""

    run_id: str
    threshold: float
    score: Callable[[np.ndarray], np.ndarray]


def decisions(snapshots: DataFrame, models: dict[str, Model], keys: Sequence[str], at: float) -> DataFrame:
    """One row per complete snapshot and model slot.

    The models travel to the tasks once, as a broadcast, and each block of snapshots is turned into a matrix once for all of
    them. The id of a decision is made of slot and snapshot, so a replayed micro-batch brings the same ids again. A model that
    gives a number outside [0, 1] stops the job.
    """
    ready = snapshots.where(F.col("is_complete") & (F.col("snapshot_status") == "complete")).select(
        "serving_snapshot_id", "sample_id", "snapshot_version", "feature_hash",
        F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.col("features")[k]).alias("vector"),
    )
    # As bytes, so that a model may be any function; a task reads them once.
    shared, width = snapshots.sparkSession.sparkContext.broadcast(cloudpickle.dumps(models)), len(keys)

    def score(batches):
        fitted = cloudpickle.loads(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vector").flatten()
            vectors = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            missing = pa.array(np.isnan(vectors).sum(axis=1), pa.int32())
            for slot, model in fitted.items():
                yield _decided(batch, slot, model, np.asarray(model.score(vectors), np.float64), missing, at)

    return ready.mapInArrow(score, DECISIONS)


def _decided(batch: pa.RecordBatch, slot: str, model: Model, found: np.ndarray, missing: pa.Array, at: float) -> pa.RecordBatch:
    if found.shape != (batch.num_rows,) or not ((found >= 0.0) & (found <= 1.0)).all():
        raise ValueError(f"the model of slot {slot} does not give a probability for each row")
    failed, rows = found >= model.threshold, batch.num_rows
    same = lambda value, kind: pa.repeat(pa.scalar(value, kind), rows)
    ids = pa.array([f"{slot}:{s}" for s in batch.column("serving_snapshot_id").to_pylist()])
    columns = {
        "prediction_id": ids, "request_id": ids, "sample_id": batch.column("sample_id"),
        "serving_snapshot_id": batch.column("serving_snapshot_id"), "snapshot_version": batch.column("snapshot_version").cast(pa.int64()),
        "feature_hash": batch.column("feature_hash"), "model_run_id": same(model.run_id, pa.string()),
        "runtime_slot": same(slot, pa.string()), "predicted_at": same(float(at), pa.float64()), "fail_probability": pa.array(found),
        "predicted_value": pa.array(np.where(failed, FAIL, PASS).astype(np.int32)),
        "predicted_label": pa.array(np.where(failed, "fail", "pass").tolist()), "threshold": same(float(model.threshold), pa.float64()),
        "missing_count": missing,
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def scoring_step(
    models: dict[str, Model], keys: Sequence[str], clock: Callable[[], float], table: Table, only_newest: bool = False,
) -> Callable[[DataFrame, int], None]:
    """Score the complete snapshots of each micro-batch and keep the first decision per slot and snapshot.

    ``only_newest`` scores the newest complete snapshot of each sample in the batch and no other.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if only_newest:
            rows = top_per_key(batch.where("is_complete"), ["sample_id"], [F.col("snapshot_version").desc()])
        scored = decisions(rows, models, keys, clock()).persist()
        try:
            table.insert_ignore(scored, ["predicted_at"])
        finally:
            scored.unpersist()

    return step
