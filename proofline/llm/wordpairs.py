"""Counts of words and word pairs over two sets of texts, looked up again for each text. No pair is dropped, and none is a row.

Texts are cut into units of about ``UNIT_BYTES`` where they are read. A unit is one row: its texts as numbers of its own words, and
those words as 64-bit hashes. It asks for its distinct pairs (``asked``), as hashes in ascending order that are kept as differences
and cut into parts by ranges of the hash. A part (``answered``) adds up what all units say of a pair and answers each of them with
the sums alone, in its order; the first unit that has a pair owns it. What depends on the distinct pairs of a word (how many pairs
it begins, and ends) is counted by the owners and asked for by word in the same way. The memory of a task is that of a unit or a part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import forget, last_saved, saved
from proofline.llm.encoding import chunks, plain
from proofline.llm.ngrams import CHUNK_BYTES, MULTIPLIER, Words, _discounts, _numbers, _part, _planes

UNIT_BYTES = 16 << 20  # of text in a unit
PART_PAIRS = 2_000_000  # pairs of all units in a part, at most and on average
PART_WORDS = 500_000
START = np.uint64(0x5EED)  # stands before the first word of a text
ASKED = "aimed boolean, unit long, part int, keys binary, numbers binary"
ANSWERED = "aimed boolean, unit long, part int, numbers binary, tally array<long>"
TALLY = ["n1", "n2", "n3", "n4", "more", "total", "distinct"]  # numbers that are 1, 2, 3, 4, at least 3; their sum; those above 0
WORD_NUMBERS = 5  # pairs that a word begins: occurrences, distinct ones that occur once, twice, more often; distinct pairs it ends


def word_units(rows: DataFrame, aimed: bool, tokens: Words) -> DataFrame:
    """aimed, unit, n_tokens, n_words, ids, size, tokens, words: the rows (doc_id, text) of each unit, frequent words first."""

    def cut(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at, texts in chunks(batch.column("text"), CHUNK_BYTES):
                ids = pa.array(batch.column("doc_id").slice(at, len(texts)).to_pylist(), pa.int64())  # a slice would keep the batch
                held.append((ids, *tokens(texts)))
                size += pc.sum(pc.binary_length(plain(texts))).as_py() or 0
                if size >= UNIT_BYTES:
                    yield unit(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield unit(number, held)

    def unit(number, held):
        docs, sizes, places, hashes = zip(*held, strict=True)
        begins = np.cumsum([0, *map(len, hashes)])
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        line = place[np.concatenate([p + b for p, b in zip(places, begins)]).astype(np.int64)]
        often = np.argsort(-np.bincount(line, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[often] = np.arange(len(words), dtype=np.uint32)
        ids = pa.concat_arrays(docs)
        columns = [
            pa.array([aimed]), pa.array([number], pa.int64()), pa.array([len(line)], pa.int64()), pa.array([len(words)], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            *(pa.array([_planes(x)], pa.binary()) for x in (np.concatenate(sizes).astype("<i8"), rank[line], words[often])),
        ]
        return pa.RecordBatch.from_arrays(columns, ["aimed", "unit", "n_tokens", "n_words", "ids", "size", "tokens", "words"])

    schema = "aimed boolean, unit long, n_tokens long, n_words long, ids array<long>, size binary, tokens binary, words binary"
    return saved(rows.select("doc_id", "text").mapInArrow(cut, schema), "word-units")


class Unit:
    """The distinct pairs of a unit by ascending hash (``first`` and ``second``: places in ``words``), and of each token its pair."""

    def __init__(self, size: bytes, tokens: bytes, words: bytes) -> None:
        self.size, line = _numbers(size, np.int64), _numbers(tokens, np.uint32).astype(np.int64)
        self.words = np.append(_numbers(words, np.uint64), START)
        before = np.empty(len(line), np.int64)
        before[1:] = line[:-1]
        before[(np.cumsum(self.size) - self.size)[self.size > 0]] = len(self.words) - 1
        distinct, place, n = np.unique(before * len(self.words) + line, return_inverse=True, return_counts=True)
        first, second = distinct // len(self.words), distinct % len(self.words)
        hashes = (self.words[first] ^ (self.words[first] >> np.uint64(31))) * MULTIPLIER + self.words[second]
        hashes = (hashes ^ (hashes >> np.uint64(29))) * MULTIPLIER
        hashes ^= hashes >> np.uint64(32)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hashes, self.n, self.first, self.second, self.pair = hashes[order], n[order], first[order], second[order], rank[place]
        self.by_hash = np.argsort(self.words)  # the order in which a unit asks for its words


def unit_of(table: pa.Table) -> Unit:
    return Unit(*(table[c][0].as_py() for c in ("size", "tokens", "words")))


def asked(aimed: bool, unit: int, hashes: np.ndarray, numbers: np.ndarray, parts: int) -> pa.RecordBatch:
    """Keys in ascending order and their numbers, a row of ``numbers`` each kind, as rows of ``ASKED``."""
    ends = np.searchsorted(_part(hashes, parts), np.arange(parts), side="right").tolist()
    out = [
        (part, _planes(np.diff(hashes[low:high], prepend=np.uint64(0))), _planes(numbers[:, low:high].astype("<i8")))
        for part, (low, high) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if low < high
    ]
    columns = [pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 3, (pa.int32(), pa.binary(), pa.binary()), strict=True)]
    same = [pa.array([aimed] * len(out), pa.bool_()), pa.array([unit] * len(out), pa.int64())]
    return pa.RecordBatch.from_arrays([*same, *columns], ["aimed", "unit", "part", "keys", "numbers"])


class Sums:
    """What the units of one set ask of a part: the distinct keys and the sums of their numbers over all units."""

    def __init__(self, asked: list[tuple[int, bytes, bytes]], kinds: int) -> None:
        self.units = [unit for unit, _, _ in asked]
        keys = [np.cumsum(_numbers(k, np.uint64), dtype=np.uint64) for _, k, _ in asked]
        self.bounds = np.cumsum([0, *map(len, keys)])
        numbers = [_numbers(n, np.int64).reshape(kinds, -1) for _, _, n in asked]
        numbers = np.concatenate([np.zeros((kinds, 0), np.int64), *numbers], axis=1)
        self.keys, first, self.place = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_index=True, return_inverse=True)
        self.owned = np.zeros(self.bounds[-1], np.int64)
        self.owned[first] = 1
        self.sums = np.stack([np.bincount(self.place, weights=n, minlength=len(self.keys)).astype(np.int64) for n in numbers])

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The sums of these keys; zeros where no unit of this set has them."""
        if not len(self.keys):
            return np.zeros((len(self.sums), len(keys)), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.sums[:, at] * (self.keys[at] == keys)

    def tally(self, kind: int) -> list[int]:
        n = self.sums[kind]
        return [int(x) for x in (*((n == k).sum() for k in (1, 2, 3, 4)), (n >= 3).sum(), n.sum(), (n > 0).sum())]


def answered(asked: DataFrame, kinds: int, tallied: int, sets: tuple[bool, ...], name: str) -> DataFrame:
    """To each unit of ``sets``: is the key its own, the sums of its set, those of the other set. A row without unit: ``TALLY`` of one kind."""

    def answer(table: pa.Table) -> pa.Table:
        part, by_set = table["part"][0].as_py(), {False: [], True: []}
        for aimed, *row in zip(*(table[c].to_pylist() for c in ("aimed", "unit", "keys", "numbers")), strict=True):
            by_set[aimed].append(row)
        found, out = {aimed: Sums(rows, kinds) for aimed, rows in by_set.items()}, []
        for aimed, own in found.items():
            out.append((aimed, None, None, own.tally(tallied)))
            if aimed in sets:
                both = np.concatenate([own.sums, found[not aimed].of(own.keys)])
                for unit, low, high in zip(own.units, own.bounds, own.bounds[1:]):
                    numbers = np.concatenate([own.owned[None, low:high], both[:, own.place[low:high]]])
                    out.append((aimed, unit, _planes(numbers.astype("<i8")), None))
        aimed, units, numbers, tally = zip(*out, strict=True)
        return pa.table({
            "aimed": pa.array(aimed), "unit": pa.array(units, pa.int64()), "part": pa.array([part] * len(out), pa.int32()),
            "numbers": pa.array(numbers, pa.binary()), "tally": pa.array(tally, pa.list_(pa.int64())),
        })

    return saved(asked.groupBy("part").applyInArrow(answer, ANSWERED), name)


def answers_of(table: pa.Table, kinds: int, keys: int) -> np.ndarray:
    """The answers to a unit: own, sums of its set, sums of the other, in the order in which it asked."""
    parts = sorted(zip(table["part"].to_pylist(), table["numbers"].to_pylist(), strict=True))
    rows = [_numbers(n, np.int64).reshape(1 + 2 * kinds, -1) for _, n in parts]
    found = np.concatenate([np.zeros((1 + 2 * kinds, 0), np.int64), *rows], axis=1)
    if found.shape[1] != keys:
        raise RuntimeError("a unit has not as many keys as answers: its rows changed between two readings")
    return found


@dataclass
class Model:
    """Numbers of an interpolated modified Kneser-Ney model of word pairs: discounts of pairs and of words, the words' total, back-off weight and number, and one."""

    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    total: int
    back: float
    letters: float

    def log_p(self, unit: Unit, pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of each pair of the unit, from the pairs' counts and ``WORD_NUMBERS`` of the unit's words. Unknown contexts weigh 1."""
        occurrences, *classes, ends = words
        weight = np.where(occurrences > 0, self.pair_discounts @ np.stack(classes) / np.maximum(occurrences, 1), 1.0)
        single = _discounted(ends, self.word_discounts) / self.total + self.back / self.letters
        return np.log(_discounted(pairs, self.pair_discounts) / np.maximum(occurrences, 1)[unit.first] + weight[unit.first] * single[unit.second])


def _discounted(n: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - discounts[np.clip(n, 1, 3) - 1], 0.0)


def models(pairs: DataFrame, words: DataFrame) -> dict[bool, Model]:
    """The model of each set that has a token, from the tallies of the pairs' counts and of the distinct pairs that words end."""

    def tallies(answers):
        sums = [F.sum(F.get("tally", F.lit(k))).alias(name) for k, name in enumerate(TALLY)]
        return {r.aimed: r for r in answers.where("unit IS NULL").groupBy("aimed").agg(*sums).select("*", *_discounts()).collect()}

    ends, made = tallies(words), {}
    for aimed, pair in tallies(pairs).items():
        if pair.total:
            word = ends[aimed]
            by_pair, by_word = (np.array([t.d1, t.d2, t.d3]) for t in (pair, word))
            back = float(by_word @ np.array([word.n1, word.n2, word.more])) / word.total
            made[aimed] = Model(by_pair, by_word, word.total, back, word.distinct + 1.0)
    return made


def counted(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The answers on pairs and on words for ``units`` of both sets: of pairs to all units, of words to those not aimed."""
    n_tokens, n_words = units.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    pair_parts, word_parts = (max(1, -(-(n or 0) // size)) for n, size in ((n_tokens, PART_PAIRS), (n_words, PART_WORDS)))
    texts = units.select("aimed", "unit", "size", "tokens", "words")

    def pairs_of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row["size"], row["tokens"], row["words"])
                yield asked(row["aimed"], row["unit"], unit.hashes, unit.n[None, :], pair_parts)

    def words_of(own: pa.Table, found: pa.Table) -> pa.Table:
        unit = unit_of(own)
        mine, n, _ = answers_of(found, 1, len(unit.hashes))
        mine = np.flatnonzero(mine)
        n, first, size = n[mine], unit.first[mine], len(unit.words)
        numbers = [np.bincount(first, n, size), *(np.bincount(first[c], minlength=size) for c in (n == 1, n == 2, n > 2))]
        numbers = np.stack([*numbers, np.bincount(unit.second[mine], minlength=size)]).astype(np.int64)
        at = (own["aimed"][0].as_py(), own["unit"][0].as_py())
        return pa.Table.from_batches([asked(*at, unit.words[unit.by_hash], numbers[:, unit.by_hash], word_parts)])

    pairs = answered(texts.mapInArrow(pairs_of, ASKED), 1, 0, (False, True), "pair-answers")
    known = pairs.where("unit IS NOT NULL").select("aimed", "unit", "part", "numbers").groupBy("aimed", "unit")
    wanted = texts.groupBy("aimed", "unit").cogroup(known).applyInArrow(words_of, ASKED)
    return pairs, answered(wanted, WORD_NUMBERS, WORD_NUMBERS - 1, (False,), "word-answers")


def losses(own: pa.Table, found: pa.Table, made: dict[bool, Model], untrained: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(tokens of each text of a unit, the sums of their losses by the model of its set and by that of the other). ``found``: answers, with words or not."""
    unit = unit_of(own)
    on_words = found["on_words"].to_numpy()
    _, *pairs = answers_of(found.filter(pa.array(~on_words)), 1, len(unit.hashes))
    numbers = answers_of(found.filter(pa.array(on_words)), WORD_NUMBERS, len(unit.words))[1:]
    words = np.empty_like(numbers)
    words[:, unit.by_hash] = numbers
    text, out = np.repeat(np.arange(len(unit.size)), unit.size), []
    for k, aimed in enumerate((False, True)):
        if aimed in made:
            token = -made[aimed].log_p(unit, pairs[k], words[k * WORD_NUMBERS : (k + 1) * WORD_NUMBERS])[unit.pair]
        else:
            token = np.full(len(text), untrained)
        out.append(np.bincount(text, token, len(unit.size)))
    return unit.size, out


def text_losses(docs: DataFrame, target: DataFrame, tokens: Words, untrained: float) -> DataFrame:
    """doc_id, n_tokens, background, target of each row of ``docs`` (doc_id, text): sums of the losses by models of ``docs`` and of ``target`` (text).

    Without a target text, a token's loss by its model is ``untrained``.
    """
    spark = docs.sparkSession
    rows = word_units(docs, False, tokens)
    aims = word_units(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), True, tokens)
    used = last_saved()
    pairs, words = counted(rows.unionByName(aims))
    forget(spark, used)
    made = models(pairs, words)

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        n, (background, target) = losses(own, found, made, untrained)
        columns = [own["ids"].combine_chunks().flatten(), *map(pa.array, (n, background, target))]
        return pa.table(columns, ["doc_id", "n_tokens", "background", "target"])

    answers = [a.where("NOT aimed AND unit IS NOT NULL").select("unit", "part", "numbers", F.lit(k).alias("on_words")) for a, k in ((pairs, False), (words, True))]
    asking = rows.select("unit", "ids", "size", "tokens", "words").groupBy("unit")
    schema = "doc_id long, n_tokens long, background double, target double"
    return asking.cogroup(answers[0].unionByName(answers[1]).groupBy("unit")).applyInArrow(score, schema)
