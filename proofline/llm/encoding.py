"""Ids of whole texts by a public tokenizer file, with every distinct piece of a chunk encoded once.

A text is cut only where the tokenizer's own pre-tokenization always has a boundary, so the ids are those of the whole
text. The string of an added token, such as an end mark, is that token's one id wherever it stands, as the tokenizers library has
it; texts with one go to the tokenizer uncut. Work is done on chunks of bounded size, in numpy, and a
bounded cache, keyed by 128-bit hashes, keeps the ids of pieces seen before.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 8 << 20
CACHE_ENTRIES = 3_000_000

# Any white space before a space: there a cut could change the ids of a tokenizer that keeps spaces.
RUN_BEFORE_SPACE = (
    "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "
)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``limit`` bytes (one text at least) with the row each begins at."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    row = 0
    while row < len(texts):
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield row, texts.slice(row, stop - row)
        row = stop


def plain(texts: pa.Array) -> pa.Array:
    """Large strings without nulls or slicing offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])


class PieceCache:
    """Ids of pieces by their 128-bit hash, in sorted arrays: about 30 bytes a piece instead of Python objects."""

    def __init__(self, entries: int = CACHE_ENTRIES) -> None:
        self.entries = entries
        self.clear()

    def clear(self) -> None:
        self.high = np.zeros(0, np.uint64)
        self.low = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if not len(self.high):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.high, keys[:, 0]), len(self.high) - 1)
        return np.where((self.high[at] == keys[:, 0]) & (self.low[at] == keys[:, 1]), at, -1)

    def add(self, keys: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        begin = len(self.ids) + np.cumsum(length) - length
        high = np.concatenate([self.high, keys[:, 0]])
        order = np.argsort(high, kind="stable")
        self.high = high[order]
        self.low = np.concatenate([self.low, keys[:, 1]])[order]
        self.begin = np.concatenate([self.begin, begin])[order]
        self.length = np.concatenate([self.length, length.astype(np.int32)])[order]
        self.ids = np.concatenate([self.ids, ids])


class Encoder:
    """``keeps_space``: spaces belong to the word after them (byte-level BPE); otherwise white space is dropped."""

    def __init__(self, definition: str, keeps_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Texts that are not cut: what the tokenizer finds in them before it splits words may span a cut.
        self.uncut = "|".join([*added, *([RUN_BEFORE_SPACE] if keeps_space else [])])
        self.keeps_space = keeps_space
        self.cache = PieceCache()

    def _look_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, ids): the ids of each piece, within one array."""
        digest = xxhash.xxh3_128_digest
        keys = np.frombuffer(b"".join([digest(p) for p in pieces]), "<u8").reshape(-1, 2)
        missing = np.flatnonzero(self.cache.find(keys) < 0)
        if len(missing) + len(self.cache.high) > self.cache.entries:
            self.cache.clear()
            missing = np.arange(len(pieces))
        if len(missing):
            new = missing[np.unique(keys[missing, 0], return_index=True)[1]]
            lengths, parts = [], []
            for at in range(0, len(new), 4096):
                part = [pieces[i] for i in new[at : at + 4096].tolist()]
                found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                lengths.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
                parts.append(np.array(found.ids, np.uint32))
            self.cache.add(keys[new], np.concatenate(lengths), np.concatenate(parts))
        place = self.cache.find(keys)
        if (place < 0).any():
            raise RuntimeError("two pieces of a chunk share 64 bits of their hash")
        return self.cache.begin[place], self.cache.length[place].astype(np.int64), self.cache.ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids in order); null counts as empty."""
        texts = plain(texts)
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        whole = np.zeros(0, np.int64)
        parts_of = texts
        if self.uncut:
            marked = pc.match_substring_regex(texts, self.uncut)
            whole = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
            parts_of = plain(pc.if_else(marked, "", texts)) if len(whole) else texts
        cut = pc.split_pattern(parts_of, " ") if self.keeps_space else pc.ascii_split_whitespace(parts_of)
        bounds = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        entries = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.keeps_space:
            starts = bounds[:-1]
            first = [entries[i] for i in codes[starts].tolist()]
            codes[starts] = len(entries) + np.arange(len(first))
            entries = [" " + e for e in entries] + first
        begin, length, flat = self._look_up(entries)
        sizes = length[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begin[codes] - (ends - sizes), sizes) + np.arange(total)]
        upto = np.concatenate([[0], ends])
        counts = upto[bounds[1:]] - upto[bounds[:-1]]
        if not len(whole):
            return counts, ids
        parts = np.split(ids, np.cumsum(counts)[:-1])  # these texts go to the tokenizer uncut, one at a time
        for row in whole.tolist():
            parts[row] = np.array(self.tokenizer.encode(texts[row].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.array([len(p) for p in parts], np.int64), np.concatenate(parts)


_ENCODERS: dict[tuple[int, bool], Encoder] = {}


def encoder(definition: str, keeps_space: bool) -> Encoder:
    """One encoder, with its cache, for each definition in a worker process."""
    key = (hash(definition), keeps_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition, keeps_space)
    return _ENCODERS[key]
