"""Best-fit packing of documents into sequences of at most ``capacity`` tokens by linear grouping.

Only lengths matter for a packing, and there are at most ``capacity`` of them. So the corpus is reduced to a histogram of
piece lengths (bounded, whatever the corpus), the packing is planned on that histogram, and the plan, a list of intervals
"pieces of length L and rank a..b go to sequences s..s+b-a at offset o", is applied to the pieces where they are.

The plan: lengths above ``capacity / small_part`` are put in groups of equal cardinality and rounded up to the largest of
their group; full configurations of those few sizes are found one after another, each anchored at the largest size left
and filled as far as possible by a knapsack over the others; each is used as often as the counts allow. The actual
pieces, longest first, then take the places of their group, and the small ones are best-fitted into the room that is
left. Several group counts are tried, the plan of fewest sequences is kept.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import narrow, saved, tokenizer_definition
from proofline.llm.encoding import chunks, encoder

CAPACITY = 2048
END_ID = 0
TRIALS = ((2, 64), (4, 64), (8, 32), (8, 96), (16, 64))
RANK_ROWS = 200_000
LEAST_BUCKETS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, *, keeps_space: bool, capacity: int) -> DataFrame:
    """Token counts and checksums of the pieces: only documents of over ``capacity`` tokens are cut."""
    definition = tokenizer_definition(tokenizer)

    def cut(batches):
        encode = encoder(definition, keeps_space).encode
        for batch in batches:
            keys = batch.column("doc_id")
            for row, texts in chunks(batch.column("text")):
                counts, ids = encode(texts)
                counts = counts + 1
                whole = np.insert(ids.astype("<u4"), np.cumsum(counts - 1), END_ID)
                begin = np.cumsum(counts) - counts
                pieces = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, counts[owner] - start)
                data = memoryview(whole.tobytes())
                at = (begin[owner] + start) * 4
                sums = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(owner + row)).cast(pa.int64()), pa.array(number.astype(np.int32)),
                        pa.array(start), pa.array(length), pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.mapInArrow(cut, PIECES)


class _Plan:
    """Runs of equally filled sequences; ``open`` has them by the room left."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, last rank, first sequence, offset
        self.ranks: dict[int, int] = {}
        self.rooms: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        first = self.ranks.get(length, 0)
        self.ranks[length] = first + n
        self.rows.append((length, first, first + n - 1, sequence, offset))

    def leave(self, room: int, sequence: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((sequence, n))

    def best_fit(self, length: int, n: int) -> int:
        """Put pieces into the fullest sequences that can take them; how many are left."""
        while n:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                break
            room = self.rooms[at]
            sequence, have = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                del self.rooms[at]
            used = min(n, have)
            self.place(length, used, sequence, self.capacity - room)
            self.leave(room - length, sequence, used)
            self.leave(room, sequence + used, have - used)
            n -= used
        return n

    def new(self, lengths: list[int], n: int) -> None:
        offset = 0
        for length in lengths:
            self.place(length, n, self.sequences, offset)
            offset += length
        self.leave(self.capacity - offset, self.sequences, n)
        self.sequences += n


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Places of each size in one sequence: the largest size there is, then the fullest choice of the others."""
    anchor = next(i for i, n in enumerate(left) if n)
    used = [0] * len(sizes)
    used[anchor] = 1
    room = capacity - sizes[anchor]
    reached = np.full(room + 1, -1, np.int32)  # last size by which each sum is reached
    reached[0] = len(sizes)
    reached_any = np.zeros(room + 1, bool)
    reached_any[0] = True
    for i in range(anchor, len(sizes)):
        size = sizes[i]
        most = min(left[i] - used[i], room // size)
        grown = reached_any
        for _ in range(most):
            shifted = np.zeros_like(grown)
            shifted[size:] = grown[: room + 1 - size]
            new = shifted & ~reached_any
            if not new.any():
                break
            reached[new] = i
            reached_any = reached_any | new
            grown = new
    total = int(np.flatnonzero(reached_any)[-1])
    while total:
        i = int(reached[total])
        used[i] += 1
        total -= sizes[i]
    return used


def plan_packing(histogram: dict[int, int], capacity: int, small_part: int, groups: int) -> _Plan:
    plan = _Plan(capacity)
    large = sorted((s for s in histogram if s * small_part > capacity), reverse=True)
    total = sum(histogram[s] for s in large)
    queues: list[list[list[int]]] = []  # of each group: [length, count], longest first
    share, filled = max(1, -(-total // groups)), 0
    for length in large:
        n = histogram[length]
        while n:
            if filled % share == 0:
                queues.append([])
            part = min(n, share - filled % share)
            queues[-1].append([length, part])
            filled += part
            n -= part
    sizes = [q[0][0] for q in queues]
    left = [sum(n for _, n in q) for q in queues]
    while any(left):
        used = _configuration(sizes, left, capacity)
        times = min(n // u for n, u in zip(left, used, strict=True) if u)
        slots = [i for i, u in enumerate(used) for _ in range(u)]
        left = [n - u * times for n, u in zip(left, used, strict=True)]
        while times:
            # Actual pieces: the same lengths hold for as many sequences as each queue's first run allows.
            run = min(queues[i][0][1] // used[i] for i in set(slots))
            if run == 0:  # a group's first run ends within this sequence
                run, lengths = 1, []
                for i in slots:
                    lengths.append(queues[i][0][0])
                    queues[i][0][1] -= 1
                    if not queues[i][0][1]:
                        queues[i].pop(0)
            else:
                run = min(run, times)
                lengths = [queues[i][0][0] for i in slots]
                for i in set(slots):
                    queues[i][0][1] -= run * used[i]
                    if not queues[i][0][1]:
                        queues[i].pop(0)
            plan.new(lengths, run)
            times -= run
    for length in sorted((s for s in histogram if s * small_part <= capacity), reverse=True):
        n = plan.best_fit(length, histogram[length])
        each = capacity // length
        if n >= each:
            plan.new([length] * each, n // each)
            n %= each
        if n:
            plan.new([length] * n, 1)
    return plan


def best_plan(histogram: dict[int, int], capacity: int) -> _Plan:
    bound = -(-sum(s * n for s, n in histogram.items()) // capacity)
    best = None
    for small_part, groups in TRIALS:
        plan = plan_packing(histogram, capacity, small_part, groups)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= bound:
            break
    return best


def _ranked(pieces: DataFrame) -> DataFrame:
    """Rank of each piece among those of its length, from 0; no length is ordered in one task.

    A length's pieces are dealt to buckets, ranked there, and moved up by the counts of the buckets before.
    """
    total = pieces.count()
    buckets = max(LEAST_BUCKETS, -(-total // RANK_ROWS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        "length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")
    )
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return (
        dealt.withColumn("own", own)
        .join(before, ["length", "bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))
    )


def pack(
    docs: DataFrame, tokenizer: str, *, keeps_space: bool = False, capacity: int = CAPACITY, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: where its tokens are in the document, and its sequence and offset there.

    Null and empty texts are documents of one token, the end id. Rows of equal or null ids are packed like any other. An
    empty table gives no rows.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    pieces = saved(cut_pieces(rows, tokenizer, keeps_space=keeps_space, capacity=capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # ``capacity`` rows at most
    plan = best_plan(histogram, capacity)
    # Intervals by length and rank; their number depends on the lengths there are, not on the corpus.
    table = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    starts = (table[:, 0] << 48) + table[:, 1]

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(starts, (length.astype(np.int64) << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4]),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    if not len(table):
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    return _ranked(pieces).mapInArrow(assign, PIECES + ", sequence_id long, offset long")
