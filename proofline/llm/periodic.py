"""Periodic runs in the words of a text: maximal stretches that repeat their first ``period`` words at least four times.

A suffix automaton of the words gives the tree of suffix links; the path from a prefix to the root holds all suffixes of that
prefix. A link-cut tree keeps for each vertex where its words ended last: appending a word *accesses* the path of the new prefix
and recolours it with the new end. The path is then made of few segments of one previous end each. Of a segment with previous
end e, its deepest vertex has the longest suffix that ended at e; where the distance to the new end is no greater than that
length there is a square, whose left end cannot be moved further. Squares of one left end and period at successive ends are one
run. That distance is also the smallest period of the stretch: a smaller one would have given a later previous end.

A text of n words costs O(n log n) steps. Before that, words that cannot lie in a run are set aside by array operations: every
window of five words of a run is in that run a second time, so windows that are alone in their stretch of text end it, and what
is left is taken as new, smaller stretches until nothing changes. This never loses a run, see ``window``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from proofline.llm.common import narrow
from proofline.llm.encoding import chunks, plain

LEAST_WORDS = 6
LEAST_EXPONENT = 4
ROUNDS = 32
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_links(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link of each state, its longest length, the state of each prefix) of the suffix automaton of ``words``."""
    link, longest, after = [-1], [0], [{}]
    prefixes, last = [], 0
    for word in words:
        state = len(link)
        link.append(0)
        longest.append(longest[last] + 1)
        after.append({})
        at = last
        while at != -1 and word not in after[at]:
            after[at][word] = state
            at = link[at]
        if at != -1:
            target = after[at][word]
            if longest[target] == longest[at] + 1:
                link[state] = target
            else:
                clone = len(link)
                link.append(link[target])
                longest.append(longest[at] + 1)
                after.append(after[target].copy())
                while at != -1 and after[at].get(word) == target:
                    after[at][word] = clone
                    at = link[at]
                link[target] = link[state] = clone
        prefixes.append(state)
        last = state
    return link, longest, prefixes


class LastEnds:
    """Link-cut tree over suffix links. A preferred path has one last end, kept at the root of the path's splay tree."""

    def __init__(self, link: list[int], longest: list[int]) -> None:
        self.parent = link  # of a splay root: the vertex above its path
        self.longest = longest
        self.upper = [-1] * len(link)
        self.lower = [-1] * len(link)
        self.end = [-1] * len(link)

    def _splay(self, x: int) -> None:
        parent, upper, lower = self.parent, self.upper, self.lower
        while True:
            p = parent[x]
            if p == -1 or (upper[p] != x and lower[p] != x):
                return
            g = parent[p]
            if g != -1 and (upper[g] == p or lower[g] == p):
                self._rotate(p if (upper[p] == x) == (upper[g] == p) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        parent, upper, lower = self.parent, self.upper, self.lower
        p = parent[x]
        g = parent[p]
        if upper[p] == x:
            moved = lower[x]
            upper[p], lower[x] = moved, p
        else:
            moved = upper[x]
            lower[p], upper[x] = moved, p
        if moved != -1:
            parent[moved] = p
        parent[p], parent[x] = x, g
        if g != -1:
            if upper[g] == p:
                upper[g] = x
            elif lower[g] == p:
                lower[g] = x
        self.end[x] = self.end[p]  # read at the root only

    def access(self, state: int, end: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from ``state`` to the root with ``end``; its segments before that as (previous end, longest length)."""
        below, at = -1, state
        while at != -1:
            self._splay(at)
            before = self.end[at]
            if before >= 0:
                yield before, self.longest[at]
            rest = self.lower[at]
            if rest != -1:
                self.end[rest] = before  # a path of its own from now on
            self.lower[at] = below
            below, at = at, self.parent[at]
        self.end[below] = end
        self._splay(state)


def runs_of(words: list[int], least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs of ``words`` as (start, length, period), by start, then period."""
    link, longest, prefixes = suffix_links(words)
    tree, ends = LastEnds(link, longest), {}
    for i, state in enumerate(prefixes):
        for before, length in tree.access(state, i):
            period = i - before
            if period <= length and period + length >= least_words and period + length >= least_exponent * period:
                ends[i - length - period + 1, period] = i
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())


def window(least_words: int, least_exponent: int) -> int:
    """The most words w such that every window of w words of any run has an equal one, a period away, in the same run.

    A run of period q has max(least_words, least_exponent * q) words at least, so it has that less w, plus 1, windows; each has
    a partner if they are 2q or more. For exponents of two and more the least over q is reached at the first q's.
    """
    periods = range(1, least_words // least_exponent + 2)
    return max(1, min(max(least_words, least_exponent * q) - 2 * q + 1 for q in periods))


def stretches(codes: np.ndarray, group: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Parts [begin, end) of the word codes that hold all runs. ``group`` numbers the texts; no part spans two."""
    if len(codes) < size:
        return
    count = len(codes) - size + 1
    digest = np.zeros(count, np.uint64)
    for k in range(size):
        digest = (digest ^ codes[k : k + count].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        digest ^= digest >> np.uint64(29)
    at = np.flatnonzero(group[:count] == group[size - 1 :])
    part = group[at]
    for _ in range(ROUNDS):  # equal digests of unequal windows only keep more than is needed
        key = (digest[at] ^ part.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        kept, part = at[again], part[again]
        if len(kept) == 0:
            return
        fresh = np.concatenate([[True], (np.diff(kept) != 1) | (np.diff(part) != 0)])
        done = len(kept) == len(at)
        at, part = kept, np.cumsum(fresh)
        if done:
            break
    begins = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))
    ends = np.append(begins[1:], len(at))
    yield from zip(at[begins].tolist(), (at[ends - 1] + size).tolist(), strict=True)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, where each text's words begin, with the end)."""
    cut = pc.ascii_split_whitespace(plain(texts))
    flat, bounds = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return flat.filter(filled).cast(pa.string()), upto[bounds]


def runs_of_texts(texts: pa.Array, least_words: int, least_exponent: int) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], pa.Array]:
    """Of each text: the number of words, its runs, and the words left when each run keeps only its first period."""
    words, bounds = _words(texts)
    sizes = np.diff(bounds)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    group = np.repeat(np.arange(len(sizes)), sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    kept = np.ones(len(codes), bool)
    for begin, end in stretches(codes, group, window(least_words, least_exponent)):
        if end - begin < least_words:
            continue
        text = int(group[begin])
        for start, length, period in runs_of(codes[begin:end].tolist(), least_words, least_exponent):
            found[text].append((begin + start - int(bounds[text]), length, period))
            kept[begin + start + period : begin + start + length] = False
    for runs in found:
        runs.sort(key=lambda run: (run[0], run[2]))
    upto = np.concatenate([[0], np.cumsum(kept)])
    left = pa.ListArray.from_arrays(pa.array(upto[bounds], pa.int32()), words.filter(pa.array(kept)))
    return sizes, found, pc.binary_join(left, " ")


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS,
    least_exponent: int = LEAST_EXPONENT,
) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period in words, by start, then period), collapsed text.

    Words are what blanks and the ASCII control spaces separate; they are equal if their bytes are. A run is a stretch of
    successive words with smallest period q, of ``least_words`` and of ``least_exponent`` (two or more) times q words at least,
    that cannot be extended; runs may overlap and all are given. ``collapsed`` has the words that are in no run after that run's
    first q words, joined by one blank. Null and empty texts, and texts without words, have no runs and an empty collapsed text.
    Each row is judged by itself, where it is: repeated rows and null ids give a row each, other columns are ignored whatever
    their names, an empty table gives no rows. Whole texts are taken; nothing is shuffled. Memory: a few MB of text at a time,
    or one text if it is longer.
    """
    if least_exponent < 2 or least_words < 1:
        raise ValueError("a run repeats its period twice at least")

    def find(batches):
        for batch in batches:
            texts = plain(batch.column("text"))
            for row, part in chunks(texts):
                sizes, runs, collapsed = runs_of_texts(part, least_words, least_exponent)
                keys = ("start", "length", "period")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(part)).cast(pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([[dict(zip(keys, run, strict=True)) for run in found] for found in runs], pa.list_(RUN_TYPE)),
                        collapsed.cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return narrow(docs, doc_id=id_col, text=text_col).mapInArrow(find, RUNS)
