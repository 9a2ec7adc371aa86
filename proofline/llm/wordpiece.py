"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie. Every node has a failure link and the number of tokens that are given off on the way along it:
for the text read so far, the tokens that greedy longest matching would cut from its front, and the node of what is
left. So each symbol of a word is read once, no pieces are built and nothing is read twice. All distinct words of a chunk
move through the automaton together, in numpy.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from proofline.llm.common import narrow
from proofline.llm.encoding import chunks, plain

END = 256  # the symbol after a word's last byte
SYMBOLS = 257
NONE = -1


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones are themselves, others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def word_end_vocabulary(path: str, mark: str = "</w>") -> list[tuple[int, ...]]:
    """The tokens of a byte-level vocabulary file as symbols; ``mark`` at a token's end becomes the end symbol."""
    letters, tokens = byte_letters(), []
    for token in json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]:
        end = token.endswith(mark) and token != mark
        body = token.removesuffix(mark) if end else token
        if all(c in letters for c in body):
            tokens.append((*[letters[c] for c in body], *([END] if end else [])))
    return tokens


class Automaton:
    """``first``: tokens that may begin a word; ``later``: those that may follow (the same ones if not given).

    Words end with the end symbol if any token has it; a vocabulary without it matches the bare bytes.
    """

    def __init__(self, first: list[tuple[int, ...]], later: list[tuple[int, ...]] | None = None) -> None:
        self.ends = any(END in t for t in first)
        child: dict[int, int] = {}
        whole, parent, symbol = {}, [NONE, NONE], [NONE, NONE]
        self.root, self.next_root = 0, 1 if later is not None else 0
        lone_end = [(END,)] if self.ends else []  # an end that no token takes in is cut off for nothing
        parts = ((self.root, first + lone_end * (later is None)), (self.next_root, (later or []) + lone_end * (later is not None)))
        for root, tokens in parts:
            for token in tokens:
                node = root
                for s in token:
                    key = node * SYMBOLS + s
                    if key not in child:
                        child[key] = len(parent)
                        parent.append(node)
                        symbol.append(s)
                    node = child[key]
                if token:
                    whole[node] = True
        n = len(parent)
        fail, pops = [NONE] * n, [0] * n
        level = [self.root, self.next_root] if later is not None else [self.root]
        below: dict[int, list[int]] = {}
        for node in range(2, n):
            below.setdefault(parent[node], []).append(node)
        while level:
            level = [c for node in level for c in below.get(node, ())]
            for node in level:
                if node in whole:
                    alone = symbol[node] == END and parent[node] in (self.root, self.next_root)
                    fail[node], pops[node] = self.next_root, 0 if alone else 1
                    continue
                at, given = fail[parent[node]], pops[parent[node]]
                while at != NONE and at * SYMBOLS + symbol[node] not in child:
                    given += pops[at]
                    at = fail[at]
                if at != NONE:
                    fail[node], pops[node] = child[at * SYMBOLS + symbol[node]], given
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.keys, self.children = keys[order], np.fromiter(child.values(), np.int64, len(child))[order]
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of each word; -1 if a word cannot be cut; 0 for the empty word."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + self.ends
        ends = np.cumsum(size)
        line = np.full(int(ends[-1]) if len(ends) else 0, END, np.int64)
        mine = np.ones(len(line), bool)
        if self.ends:
            mine[ends - 1] = False
        line[mine] = np.frombuffer(b"".join(words), np.uint8)
        out = np.zeros(len(words), np.int64)
        at, node = ends - size, np.full(len(words), self.root, np.int64)
        active = np.flatnonzero(size > self.ends)
        while len(active):
            place = at[active]
            reading = place < ends[active]
            key = node[active] * SYMBOLS + line[np.minimum(place, len(line) - 1)]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            step = reading & (self.keys[found] == key)
            moved = active[step]
            node[moved] = self.children[found[step]]
            at[moved] += 1
            rest = active[~step]
            out[rest] += self.pops[node[rest]]
            node[rest] = self.fail[node[rest]]
            out[rest[node[rest] == NONE]] = -1
            done = (node[active] == NONE) | (at[active] >= ends[active]) & (node[active] == self.next_root)
            active = active[~done]
        return out


def token_counts(
    docs: DataFrame, automaton: Automaton, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_chars, n_words, n_tokens, n_unknown of every whole text, lower-cased and cut at blanks.

    A word that the vocabulary cannot cut counts as one token and as unknown. Null and empty texts have none; rows of equal or
    null ids are counted each by itself. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # the vocabulary's size

    def count(batches):
        for batch in batches:
            for row, texts in chunks(batch.column("text")):
                texts = plain(texts)
                cut = pc.ascii_split_whitespace(pc.utf8_lower(texts))
                coded = cut.flatten().dictionary_encode()
                words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
                pieces = shared.value.count(words)
                real = np.fromiter(map(bool, words), bool, len(words))
                codes = coded.indices.to_numpy()
                owner = np.repeat(np.arange(len(texts)), cut.value_lengths().to_numpy())
                add = lambda x: pa.array(np.bincount(owner, x[codes], len(texts)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(texts)).cast(pa.int64()), pc.utf8_length(texts).cast(pa.int64()),
                        add(real.astype(np.float64)), add(np.where(pieces < 0, 1.0, pieces)), add((pieces < 0).astype(np.float64)),
                    ],
                    ["doc_id", "n_chars", "n_words", "n_tokens", "n_unknown"],
                )

    rows = narrow(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(count, "doc_id long, n_chars long, n_words long, n_tokens long, n_unknown long")
