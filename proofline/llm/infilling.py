"""Fill-in-the-middle texts: a text is cut in three at unit boundaries and its parts are put in another order with marks.

A unit is a word of ASCII letters or one other character. Each text is laid out in blocks of fixed size, and a Fenwick tree over
the blocks holds how many units and code points begin in each. A cut after u units is found by binary-lifting descent to the
block in which the next unit begins; only that block is then searched for the place. The counts are taken with array operations
over the bytes of many texts at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import narrow
from proofline.llm.encoding import chunks, plain

BLOCK = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PERCENT_CUT = 90
PERCENT_SPM = 20
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


class Fenwick:
    """Prefix sums of (units, code points) over blocks."""

    def __init__(self, units: np.ndarray, points: np.ndarray) -> None:
        self.size = len(units)
        self.units = [0, *units.tolist()]
        self.points = [0, *points.tolist()]
        for i in range(1, self.size + 1):
            above = i + (i & -i)
            if above <= self.size:
                self.units[above] += self.units[i]
                self.points[above] += self.points[i]

    def totals(self) -> tuple[int, int]:
        at, units, points = self.size, 0, 0
        while at:
            units += self.units[at]
            points += self.points[at]
            at &= at - 1
        return units, points

    def descend(self, unit: int) -> tuple[int, int, int]:
        """(block in which unit number ``unit``, from 0, begins; units and code points that begin before that block)."""
        at, units, points = 0, 0, 0
        step = 1 << self.size.bit_length()
        while step:
            there = at + step
            if there <= self.size and units + self.units[there] <= unit:
                at = there
                units += self.units[there]
                points += self.points[there]
            step >>= 1
        return at, units, points


class Blocks:
    """Where units and code points of one text begin, with the tree over its blocks."""

    def __init__(self, unit_starts: np.ndarray, point_starts: np.ndarray, block: int = BLOCK) -> None:
        self.unit_starts, self.point_starts, self.block = unit_starts, point_starts, block
        begins = np.arange(0, len(unit_starts), block)
        count = lambda marks: np.add.reduceat(marks, begins, dtype=np.int64) if len(begins) else np.zeros(0, np.int64)
        self.tree = Fenwick(count(unit_starts), count(point_starts))
        self.units, self.points = self.tree.totals()

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code point) at which the first ``units`` units end."""
        if units >= self.units:
            return len(self.unit_starts), self.points
        at, before, points = self.tree.descend(units)
        begin = at * self.block
        inside = np.flatnonzero(self.unit_starts[begin : begin + self.block])[units - before]
        return begin + int(inside), points + int(np.count_nonzero(self.point_starts[begin : begin + inside]))


def marks_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each UTF-8 byte: does a unit begin there, does a code point; as if the bytes before the first were no letters."""
    letter = LETTER[data]
    point = (data & 0xC0) != 0x80
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    return unit, point


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four numbers under 2^32 from the seed and the id in decimal digits; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def restored(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made. No part contains a mark, so the first of each mark is the one put in."""
    first = F.when(form == "psm", F.lit(PREFIX)).otherwise(SUFFIX)
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(PREFIX)
    upto = lambda text, mark: F.call_function("substring_index", text, mark, F.lit(1))
    head = upto(output, second)
    tail = F.substr(output, F.length(head) + F.length(second) + 1)
    one = F.substr(head, F.length(first) + 1)
    two = upto(tail, F.lit(MIDDLE))
    middle = F.substr(tail, F.length(two) + F.lit(len(MIDDLE) + 1))
    psm, spm = F.concat(one, middle, two), F.concat(two, middle, one)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, percent_cut: int = PERCENT_CUT,
    percent_spm: int = PERCENT_SPM, block: int = BLOCK,
) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (code points), output.

    form ``plain``: the text as it is; chosen for texts that are empty (null too) or contain a mark, and for the share of
    documents beyond ``percent_cut``; the two lengths are null. ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle. ``spm``, for
    ``percent_spm`` of those cut: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. Parts may be empty. Choices and cuts depend on the
    seed and the id alone, so a rerun gives the same rows, rows of one id share them, and rows without id are treated as one id.
    Each row is worked on where it is: nothing is shuffled, other columns are ignored whatever their names, an empty table gives
    no rows. ``restored`` undoes it. Memory: a few MB of text at a time, or one text if it is longer.
    """

    def work(batches):
        for batch in batches:
            texts = plain(batch.column("text"))
            for row, part in chunks(texts):
                ids = batch.column("doc_id").slice(row, len(part)).cast(pa.int64())
                yield _cut(ids, pa.concat_arrays([part]), seed, percent_cut, percent_spm, block)

    return narrow(docs, doc_id=id_col, text=text_col).mapInArrow(work, OUTPUT)


def _cut(ids: pa.Array, texts: pa.Array, seed: int, percent_cut: int, percent_spm: int, block: int) -> pa.RecordBatch:
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    units, points = marks_of(data)
    bounds = bounds - bounds[0]
    begins = bounds[:-1][np.diff(bounds) > 0]
    units[begins] = True  # a text before that ends with a letter does not matter
    rows = []
    for doc_id, begin, end in zip(ids.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        text = data[begin:end].tobytes()
        blocks = Blocks(units[begin:end], points[begin:end], block)
        h1, h2, h3, h4 = draws(doc_id, seed)
        marked = any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE))
        if not text or marked or h3 % 100 >= percent_cut:
            rows.append((blocks.units, "plain", None, None, text))
            continue
        low, high = sorted((h1 % (blocks.units + 1), h2 % (blocks.units + 1)))
        (a, a_points), (b, b_points) = blocks.cut(low), blocks.cut(high)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        spm = h4 % 100 < percent_spm
        first, second = PREFIX.encode() + prefix, SUFFIX.encode() + suffix
        output = b"".join((*((second, first) if spm else (first, second)), MIDDLE.encode(), middle))
        rows.append((blocks.units, "spm" if spm else "psm", a_points, b_points - a_points, output))
    n, form, before, between, output = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()),
            pa.array(output, pa.binary()).cast(pa.string()),
        ],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )
