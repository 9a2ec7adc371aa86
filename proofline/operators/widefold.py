"""Forward fill of sparse changes: the last value of every feature after each row, for hundreds of features.

A patch names few of the features. The changes of a block of rows are written into a matrix of row numbers, one running maximum
gives for every cell the row that set it last, and one gather gives the values. The memory is that of a block.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 2_000_000


class Vector:
    """The state of one sample: values (NaN where there is none) and which features have been set, null included."""

    def __init__(self, width: int) -> None:
        self.values = np.full(width, np.nan)
        self.seen = np.zeros(width, bool)


def changes(features: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end of each row's entries, feature numbers, values) of a map column. Unknown features and infinities are errors."""
    sizes = pc.fill_null(pc.list_value_length(features.cast(pa.list_(pa.struct([("key", pa.string()), ("value", pa.float64())])))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    begin, end = features.offsets[0].as_py(), features.offsets[len(features)].as_py()
    keys, values = features.keys.slice(begin, end - begin), features.items.slice(begin, end - begin)
    places = pc.index_in(keys, value_set=names)
    if places.null_count:
        raise ValueError(f"unexpected feature key: {keys.filter(pc.is_null(places))[0]}")
    numbers = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    if np.isinf(numbers).any() or (np.isnan(numbers) & values.is_valid().to_numpy(zero_copy_only=False)).any():
        raise ValueError("feature value is not a finite number")
    return ends, places.to_numpy().astype(np.int64), numbers


def fill(
    ends: np.ndarray, places: np.ndarray, values: np.ndarray, starts: np.ndarray, state: Vector,
) -> tuple[np.ndarray, np.ndarray]:
    """(values, seen) after each row, as matrices. ``starts[r]`` is the first row of r's sample; -1 means it continues ``state``.

    Rows of one sample are successive and in order. ``state`` becomes that of the last row.
    """
    rows, width = len(ends), len(state.values)
    row_of = np.repeat(np.arange(rows), np.diff(ends, prepend=0))
    set_by = np.full((rows, width), -1, np.int64)
    set_by[row_of, places] = np.arange(len(places))  # entries are numbered in row order, so the greatest is the last
    np.maximum.accumulate(set_by, axis=0, out=set_by)
    first_entry = np.concatenate([[0], ends])[np.maximum(starts, 0)]
    own = set_by >= first_entry[:, None]
    filled = np.where(own, values[set_by] if len(values) else np.nan, np.nan)
    going_on = starts < 0
    if going_on.any():
        filled[going_on] = np.where(own[going_on], filled[going_on], state.values)
        own[going_on] |= state.seen
    if rows:
        state.values, state.seen = filled[-1].copy(), own[-1].copy()
    return filled, own


def folded_batches(batches: Iterator[pa.RecordBatch], keys: Sequence[str], group: Sequence[str], carry: str) -> Iterator[pa.RecordBatch]:
    """Replace ``features`` and ``carry`` by ``feature_values``, ``feature_count`` and ``missing_count``.

    The batches hold the rows of each group together and in order. ``carry`` has a map on the first row of a group that goes on
    from an earlier state, else null.
    """
    names, width = pa.array(keys, pa.string()), len(keys)
    state, before = Vector(width), None
    step = max(1, CELLS // width)
    for whole in batches:
        for begin in range(0, whole.num_rows, step):
            batch = whole.slice(begin, step)
            coded = [batch.column(g).dictionary_encode().indices.to_numpy(zero_copy_only=False) for g in group]
            fresh = np.zeros(batch.num_rows, bool)
            for codes in coded:
                fresh[1:] |= codes[1:] != codes[:-1]
            fresh[0] = tuple(batch.column(g)[0].as_py() for g in group) != before
            at = np.where(fresh, np.arange(batch.num_rows), -1)
            starts = np.maximum.accumulate(at)
            ends, places, values = changes(pa.concat_arrays([batch.column("features")]), names)
            filled, seen = _with_carries(ends, places, values, starts, state, batch.column(carry), fresh, names)
            before = tuple(batch.column(g)[batch.num_rows - 1].as_py() for g in group)
            known = ~np.isnan(filled)
            listed = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(filled.ravel(), mask=~known.ravel())
            )
            kept = [n for n in batch.schema.names if n not in ("features", carry)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], listed, pa.array(seen.sum(1), pa.int32()), pa.array(width - known.sum(1), pa.int32())],
                [*kept, "feature_values", "feature_count", "missing_count"],
            )


def _with_carries(ends, places, values, starts, state, carries, fresh, names):
    """``fill`` in stretches that begin where a group brings its earlier state along; those are few."""
    brought = np.flatnonzero(fresh & carries.is_valid().to_numpy(zero_copy_only=False)) if carries.null_count < len(carries) else []
    parts, begin = [], 0
    for stop in [*brought, len(ends)]:
        if stop > begin or not len(ends):
            low = ends[begin - 1] if begin else 0
            part = slice(begin, stop)
            # A group that began before this stretch goes on from the state its last row left.
            moved = np.where(starts[part] >= begin, starts[part] - begin, -1)
            parts.append(fill(ends[part] - low, places[low : ends[stop - 1]], values[low : ends[stop - 1]], moved, state))
        if stop < len(ends):
            _, at, numbers = changes(pa.concat_arrays([carries.slice(stop, 1)]), names)
            state.values, state.seen = np.full(len(names), np.nan), np.zeros(len(names), bool)
            state.values[at], state.seen[at] = numbers, True
            last = stop
            while last < len(starts) and starts[last] == starts[stop]:
                last += 1
            starts[stop:last] = -1
        begin = stop
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
