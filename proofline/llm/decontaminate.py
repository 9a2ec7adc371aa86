"""Benchmark decontamination by pigeonhole edit matching.

A test item with error budget k is split into k + 1 pieces: wherever the item occurs with at most k edits, one piece occurs
exactly. Pieces of all items are found in one pass over each text by an Aho-Corasick automaton. A hit is verified with
Myers' bit-parallel distance, from the inside out: the pieces are the leaves of a binary tree in which a node of m leaves has a
budget of m - 1, so a chance hit is given up after comparing two or three pieces. Where a node is within its budget, one of its
two children is.

The budget k is all of ``error_rate`` of the item's length, rounded down; the tree is uneven where k + 1 is no power of two.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import narrow

ERROR_RATE = 0.1
LEAST_CHARS = 16
BLOCK_CHARS = 16 << 20
# Separators: ASCII signs, and the blocks of signs of Latin-1, general punctuation and CJK punctuation in UTF-8.
ASCII = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SIGNS = re.compile(b"\xc2[\x80-\xbf]|\xe2[\x80\x81][\x80-\xbf]|\xe3\x80[\x80-\xbf]")
MATCHES = "doc_id long, item_id long, distance int, start long, length int"


def normalised(text: str | None) -> str:
    """Lower-case words with one blank between them and at both ends."""
    data = (text or "").lower().encode("utf-8", "replace").translate(ASCII)
    if b"\xc2" in data or b"\xe2" in data or b"\xe3" in data:
        data = SIGNS.sub(b" ", data)
    words = b" ".join(data.split()).decode()
    return f" {words} " if words else ""


def edits(length: int, error_rate: float) -> int:
    """The error budget: the rate of the length, rounded down."""
    return int(error_rate * length + 1e-9)


def tree_paths(leaves: int) -> list[list[tuple[int, int]]]:
    """Of each leaf the nodes above it, as (first leaf, end), from its parent to the root. A node's halves differ by one leaf at most."""
    paths: list[list[tuple[int, int]]] = [[] for _ in range(leaves)]
    nodes = [(0, leaves)]
    for first, end in nodes:  # grows: parents come before their children
        if end - first > 1:
            for leaf in range(first, end):
                paths[leaf].insert(0, (first, end))
            middle = (first + end) // 2
            nodes += [(first, middle), (middle, end)]
    return paths


def budget(length: int, error_rate: float) -> int:
    """The largest 2^h - 1 within the rate. Not the budget of an item, which is ``edits``."""
    k = 0
    while 2 * k + 1 <= error_rate * length:
        k = 2 * k + 1
    return k


class Pattern:
    """An item: its pieces, the tree over them, and the bit masks of each node's text."""

    def __init__(self, item_id: int, text: str, error_rate: float) -> None:
        self.item_id = item_id
        # A short item must be whole words, a longer one need not begin or end at one.
        self.text = text if len(text) - 2 < LEAST_CHARS else text[1:-1]
        self.k = 0 if len(text) - 2 < LEAST_CHARS else edits(len(self.text), error_rate)
        n, size = self.k + 1, len(self.text)
        self.cuts = [size * i // n for i in range(n + 1)]
        self.paths = tree_paths(n)
        self.masks: dict[tuple[int, int], dict[str, int]] = {}

    def pieces(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def _distance(self, a: int, b: int, window: str) -> tuple[int, int]:
        """Least edit distance of text[a:b] to a part of the window, and where that part ends."""
        masks = self.masks.get((a, b))
        if masks is None:
            masks = {}
            for i, c in enumerate(self.text[a:b]):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks[a, b] = masks
        size = b - a
        full, top = (1 << size) - 1, 1 << (size - 1)
        plus, minus, score, best, end = full, 0, size, size, 0
        for at, c in enumerate(window, 1):
            equal = masks.get(c, 0)
            across = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(across | plus))
            down = plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best, end = score, at
            up, down = up << 1, down << 1
            both = equal | minus
            plus = (down | ~(both | up)) & full
            minus = up & both & full
        return best, end

    def _near(self, text: str, piece: int, begin: int, after: bool) -> bool:
        """Is the piece's sibling, before or after it, beside the hit with at most one edit? A budget of one leaves one half exact, so this is exact."""
        end = begin + self.cuts[piece + 1] - self.cuts[piece]
        if not after:  # the sibling is before: compare both reversed
            want = self.text[self.cuts[piece - 1] : self.cuts[piece]][::-1]
            have = text[max(0, begin - len(want) - 1) : begin][::-1]
        else:
            want = self.text[self.cuts[piece + 1] : self.cuts[piece + 2]]
            have = text[end : end + len(want) + 1]
        n = len(want)
        if have[:n] == want:
            return True
        at = 0
        while at < len(have) and at < n and have[at] == want[at]:
            at += 1
        return have[at + 1 : n] == want[at + 1 :] or have[at + 1 : n + 1] == want[at:] or have[at : n - 1] == want[at + 1 :]

    def verify(self, text: str, piece: int, begin: int) -> tuple[int, int] | None:
        """(distance, end) of the item around its piece found at ``begin``, or None if it is not there."""
        if self.k == 0:
            return 0, begin + len(self.text)
        path, offset = self.paths[piece], self.cuts[piece]
        first, end = path[0]
        if end - first == 2 and not self._near(text, piece, begin, piece == first):
            return None
        for first, end in path[1:] if end - first == 2 and len(path) > 1 else path:
            inner = end - first - 1
            a, b = self.cuts[first], self.cuts[end]
            left = max(0, begin - (offset - a) - inner)
            distance, last = self._distance(a, b, text[left : begin + (b - offset) + inner])
            if distance > inner:
                return None
        return distance, left + last


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        import ahocorasick

        self.patterns = [Pattern(i, t, error_rate) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for p, pattern in enumerate(self.patterns):
            for k, piece in enumerate(pattern.pieces()):
                places.setdefault(piece, []).append((p, k))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.any = bool(places)

    def matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """(distance, start at the earliest, length) of the best occurrence of each item that is in the text."""
        best: dict[int, tuple[int, int, int]] = {}
        if not self.any or not text:
            return best
        for last, (size, where) in self.automaton.iter(text):
            begin = last + 1 - size
            for p, piece in where:
                known = best.get(p)
                if known and (known[0] == 0 or known[1] <= begin < known[1] + known[2]):
                    continue
                pattern = self.patterns[p]
                found = pattern.verify(text, piece, begin)
                if found and (not known or found[0] < known[0]):
                    start = max(0, found[1] - len(pattern.text))
                    best[p] = (found[0], start, found[1] - start)
        return best


_MATCHERS: dict[object, Matcher] = {}


def _matcher(key: object, items: list[tuple[int, str]], error_rate: float) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()  # one block of items at a time
        _MATCHERS[key] = Matcher(items, error_rate)
    return _MATCHERS[key]


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_chars: int):
    """The items in blocks of about ``block_chars`` characters at most, each small enough to travel with a job."""
    items = narrow(benchmark, item_id=item_col, text=item_text_col).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-2 * total // block_chars) or 1
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield sorted(((r.item_id, n) for r in part.collect() if (n := normalised(r.text))), key=str)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and item that it contains within the item's error budget.

    distance: edits of the best occurrence; start, length: its place in the normalised text. Letter case, punctuation and
    white space do not count. Null and empty texts and items match nothing; items under 16 characters match as whole words
    only. Rows of equal ids are matched each by itself; equal items once. Nothing is shuffled: the items go to the documents in
    blocks of bounded size, and each block is one pass over the documents.
    """
    rows, found = narrow(docs, doc_id=id_col, text=text_col), None
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        one = _match_block(rows, sorted(set(block), key=str), error_rate)
        found = one if found is None else found.unionByName(one)
    return found


def _match_block(rows: DataFrame, items: list[tuple[int, str]], error_rate: float) -> DataFrame:
    shared, key = rows.sparkSession.sparkContext.broadcast(items), hash((tuple(items), error_rate))

    def match(batches):
        matcher = _matcher(key, shared.value, error_rate)
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for p, (distance, start, length) in matcher.matches(normalised(text.as_py())).items():
                    found.append((doc_id, matcher.patterns[p].item_id, distance, start, length))
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "start", "length"]
            )

    return rows.mapInArrow(match, MATCHES)


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows that contain no item, with all their columns. Each row is judged where it is: no join, ids may be null."""
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        docs = _clean_of(docs, block, text_col, error_rate)
    return docs


def _clean_of(docs: DataFrame, items: list[tuple[int, str]], text_col: str, error_rate: float) -> DataFrame:
    shared, key = docs.sparkSession.sparkContext.broadcast(items), hash((tuple(items), error_rate))

    def clean(batches):
        matcher = _matcher(key, shared.value, error_rate)
        for batch in batches:
            kept = [not matcher.matches(normalised(t.as_py())) for t in batch.column(text_col)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
