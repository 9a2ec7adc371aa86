"""Feature vectors: canonical maps, wide and long forms, perturbations, the vector hash."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.constants import HASH_DOMAIN, HASH_PREFIX, model_columns
from proofline.functions.scalars import clean_feature


def canonical(features: Column, keys: Sequence[str]) -> Column:
    """A map with exactly ``keys``; absent ones become null."""
    names = F.array(*[F.lit(k) for k in keys])
    return F.map_from_arrays(names, F.transform(names, lambda k: features[k]))


def null_count(features: Column) -> Column:
    return F.size(F.filter(F.map_values(features), lambda v: v.isNull()))


def unexpected_keys(features: Column, keys: Sequence[str]) -> Column:
    return F.array_except(F.map_keys(features), F.array(*[F.lit(k) for k in keys]))


def missing_keys(features: Column, keys: Sequence[str]) -> Column:
    return F.array_except(F.array(*[F.lit(k) for k in keys]), F.map_keys(features))


def vector_from_map(features: Column, count: int) -> Column:
    """Ordered values; each is looked up as fNNN, feature_NNN or N, the first key present winning."""

    def lookup(i):
        padded = F.lpad(i.cast("string"), 3, "0")
        first, second = F.concat(F.lit("f"), padded), F.concat(F.lit("feature_"), padded)
        found = (
            F.when(F.map_contains_key(features, first), features[first])
            .when(F.map_contains_key(features, second), features[second])
            .otherwise(features[i.cast("string")])
        )
        return clean_feature(found)

    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lookup)


def vector_from_list(features: Column, count: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)), lambda i: clean_feature(F.get(features, i))
    )


def widen(df: DataFrame, keys: Sequence[str], features: str = "features") -> DataFrame:
    """Map column to one double column per feature."""
    names = model_columns(len(keys))
    rest = [c for c in df.columns if c != features]
    wide = [clean_feature(F.col(features)[k]).alias(n) for k, n in zip(keys, names)]
    return df.select(*rest, *wide)


def lengthen(df: DataFrame, keep: Sequence[str], features: str = "features", width: int | None = None) -> DataFrame:
    """One row per feature: ``feature_index``, ``feature_name``, ``value``. The form all statistics use.

    Without ``width`` a row per key of the map. With it a row for each of ``width`` features, null where the map has none of the
    feature's names, so that samples and nulls are counted over all rows whatever their maps hold.
    """
    if width is not None:
        rows = df.select(*keep, F.posexplode(vector_from_map(F.col(features), width)).alias("feature_index", "value"))
        name = F.concat(F.lit("f"), F.lpad(F.col("feature_index").cast("string"), 3, "0"))
        return rows.select(*keep, "feature_index", name.alias("feature_name"), "value")
    rows = df.select(*keep, F.explode(features).alias("feature_name", "value"))
    index = F.substring("feature_name", 2, 9).cast("int")
    return rows.select(*keep, index.alias("feature_index"), "feature_name", clean_feature(F.col("value")).alias("value"))


def scale_features(features: Column, direction: str, ratio: float) -> Column:
    """Multiply every value by 1 + ratio (up) or 1 - ratio (down)."""
    factors = {"none": 1.0, "up": 1.0 + ratio, "down": 1.0 - ratio}
    if direction not in factors:
        raise ValueError(f"unknown direction: {direction}")
    return F.transform_values(features, lambda _, v: v * F.lit(factors[direction]))


def offset_feature(features: Column, key: str, amount: float, every: int, row_number: Column) -> Column:
    """Add ``amount`` to one feature on every ``every``-th row; nulls stay null."""
    due = row_number % every == 0
    return F.transform_values(features, lambda k, v: F.when(due & (k == key), v + F.lit(amount)).otherwise(v))


def reflect(features: Column, medians: Mapping[str, float]) -> Column:
    """``2 * median - x`` per feature; a feature without a median is left alone."""
    known = F.create_map(*[F.lit(x) for name, value in medians.items() for x in (name, float(value))])
    return F.transform_values(features, lambda k, v: F.coalesce(2 * known[k] - v, v))


def split_groups(features: Column, starts: Mapping[str, int]) -> Column:
    """Map of group name to its part of the features, groups being consecutive index ranges."""
    ordered = sorted(starts.items(), key=lambda item: item[1])
    ends = [start for _, start in ordered[1:]] + [None]
    parts = []
    for (name, start), end in zip(ordered, ends):
        parts += [F.lit(name), F.map_filter(features, _index_between(start, end))]
    return F.create_map(*parts)


def _index_between(start: int, end: int | None):
    def inside(key, _):
        index = F.substring(key, 2, 9).cast("int")
        return (index >= start) if end is None else (index >= start) & (index < end)

    return inside


def vector_hash():
    """Pandas UDF: array<double> of one full feature vector to its digest text.

    No SQL function exposes the bytes of a double, so the digest runs in Python over Arrow batches.
    """
    domain, prefix = HASH_DOMAIN, HASH_PREFIX

    @F.pandas_udf("string")
    def digest(vectors):
        import hashlib

        import numpy as np
        import pandas as pd

        given = [v for v in vectors if v is not None]
        sizes = np.array([len(v) for v in given], dtype=np.int64)
        numbers = np.concatenate([*[np.asarray(v, dtype="float64") for v in given], np.zeros(0)])  # None becomes NaN
        if np.isinf(numbers).any():
            raise ValueError("feature value must be finite")
        # A present value is a one and its eight bytes, an absent one a zero; laid out once for the whole batch.
        present = ~np.isnan(numbers)
        cells = np.zeros((len(numbers), 9), dtype="uint8")
        cells[:, 0] = present
        cells[:, 1:] = (numbers + 0.0).astype(">f8").view("uint8").reshape(-1, 8)
        keep = np.ones_like(cells, dtype=bool)
        keep[~present, 1:] = False
        data = cells[keep].tobytes()
        ends = np.concatenate([[0], np.cumsum(1 + 8 * present)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        hashes = iter([prefix + hashlib.sha256(domain + data[i:j]).hexdigest() for i, j in zip(ends, ends[1:])])
        return pd.Series([None if v is None else next(hashes) for v in vectors], dtype="object")

    return digest


def with_vector_hash(df: DataFrame, keys: Sequence[str], features: str = "features") -> DataFrame:
    """Add ``feature_hash``. NaN and infinities are refused before values cross into Python."""
    values = F.transform(
        F.array(*[F.lit(k) for k in keys]), lambda k: clean_feature(F.col(features)[k], "error")
    )
    return df.withColumn("feature_hash", vector_hash()(values))
