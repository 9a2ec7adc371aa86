"""Interpolated modified Kneser-Ney models of token n-grams, counted and kept in Spark tables. No n-gram is dropped.

A token is a character, so an n-gram is a short string, and counts, suffixes and contexts are plain DataFrame group-bys over strings.

Texts are dealt into units of ``WIDE_UNIT_BYTES`` by a hash of their row. The rows of a unit travel as compressed blocks, its
n-grams as tokens in the order of their hash, cut into parts by ranges of the hash. A part of the model answers with the values
alone, in the same order, and the unit finds its own n-grams again from its texts: the memory of a task is that of a unit,
whatever the number of n-grams. Word pairs are counted in ``wordpairs.py``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import forget, last_saved, saved
from proofline.llm.encoding import chunks, plain

START = 2
CHUNK_BYTES = 3 << 20  # of text at once: the arrays of a chunk take about forty times as much
UNIT_BYTES = 8 << 20  # of text in a unit
WIDE_UNIT_BYTES = 32 << 20  # of text in a packed unit
UNITS_A_PART = 4  # a part has about as many n-grams as so many units
BLOCK_BYTES = 32 << 20  # of rows that are packed at once
PENDING = 1_000_000  # n-grams of chunks, merged when there are more
MOST_BROADCAST = 10_000  # groups whose totals may be broadcast
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

# (tokens of each text, all tokens as small numbers, the code points of each number or None if it is one itself)
Tokens = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray | None]]
# (words of each text, all words as numbers, the 64-bit hash of each number's word)
Words = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, None]:
    """Tokens are the characters, with line ends as blanks."""
    texts = plain(texts)
    count = pc.utf8_length(texts).to_numpy().astype(np.int64)
    joined = np.frombuffer("".join(texts.to_numpy(zero_copy_only=False)).encode("utf-32-le"), "<u4")
    return count, np.where(joined == 10, np.uint32(32), joined), None


def words(vocabulary: pa.Array | None = None) -> Words:
    """Tokens are the lower-cased words; with a vocabulary, all words outside it are one token."""

    def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(plain(texts))))
        coded = cut.flatten().dictionary_encode()
        names = coded.dictionary
        if vocabulary is not None:  # the empty word stands for the unknown ones
            names = pc.if_else(pc.is_in(names, value_set=vocabulary), names, pa.scalar("", names.type))
        size = cut.value_lengths().to_numpy().astype(np.int64)
        ids = coded.indices.to_numpy().astype(np.uint32)
        empty = pc.equal(pc.binary_length(plain(texts)), 0).to_numpy(zero_copy_only=False)
        blank = empty | (size == 1) & (pc.binary_length(pc.ascii_trim_whitespace(plain(texts))).to_numpy() == 0)
        if blank.any():
            ids = np.delete(ids, (np.cumsum(size) - size)[blank & (size > 0)])
            size = np.where(blank, 0, size)
        return size, ids, np.array([xxhash.xxh64_intdigest(w) for w in names.to_pylist()], np.uint64)

    return tokens


def vocabulary(docs: DataFrame, share: float) -> pa.Array:
    """Lower-case words of at least this share of all words: 1 / share of them at most."""

    def count(batches):
        for batch in batches:
            for _, texts in chunks(batch.column("text")):
                found = pc.ascii_split_whitespace(pc.utf8_lower(plain(texts))).flatten().value_counts()
                yield pa.RecordBatch.from_arrays(
                    [found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"]
                )

    counted = saved(
        docs.select("text").mapInArrow(count, "word string, n long").where("word != ''").groupBy("word").agg(F.sum("n").alias("n")),
        "words",
    )
    total = counted.agg(F.sum("n")).first()[0] or 0
    kept = counted.where(F.col("n") >= share * total).select("word").collect()
    return pa.array(sorted(r.word for r in kept), pa.large_string())


def windows(size: np.ndarray, tokens: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the tokens, alphabet, codes): all texts after one another, each behind order - 1 start marks, as places in the alphabet."""
    at = np.repeat(np.arange(len(size)) + 1, size) * (order - 1) + np.arange(len(tokens))
    line = np.full(len(tokens) + len(size) * (order - 1), START, np.uint32)
    line[at] = tokens
    seen = np.zeros(int(line.max(initial=START)) + 1, bool)
    seen[line] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    rank = np.zeros(len(seen), np.int32)
    rank[alphabet] = np.arange(len(alphabet))
    return at, alphabet, rank[line]


def keyed(at: np.ndarray, alphabet: np.ndarray, codes: np.ndarray, order: int) -> tuple[np.ndarray, Callable]:
    """A key for the n-gram that ends at each token, and how to get the n-grams' tokens, a row each, from distinct keys."""
    bits = max(1, int(len(alphabet) - 1).bit_length())
    if bits * order <= 63:
        line = np.zeros(len(codes), np.int64)
        for k in range(order - 1, -1, -1):
            line[order - 1 :] |= codes[order - 1 - k : len(codes) - k].astype(np.int64) << (bits * k)
        mask = (1 << bits) - 1

        def tokens(keys):
            return np.stack([alphabet[(keys >> (bits * k)) & mask] for k in range(order - 1, -1, -1)], axis=1)

        return line[at], tokens
    # A very large alphabet: the keys are places of rows in the table of distinct windows.
    rows = np.lib.stride_tricks.sliding_window_view(codes, order)[at - order + 1]
    table, place = np.unique(rows, axis=0, return_inverse=True)
    return place.reshape(-1).astype(np.int64), lambda keys: alphabet[table[keys]]


def grams_of(rows: np.ndarray) -> pa.Array:
    """Rows of tokens as strings."""
    data = np.ascontiguousarray(rows, "<u4").tobytes().decode("utf-32-le")
    n = rows.shape[1]
    return pa.array([data[k : k + n] for k in range(0, len(data), n)], pa.string())


def by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """(group, rows, texts) in chunks; a null group is the empty one."""
    groups = pc.fill_null(batch.column("grp").cast(pa.string()), "")
    for group in pc.unique(groups).to_pylist():
        rows = np.flatnonzero(pc.equal(groups, group).to_numpy(zero_copy_only=False))
        texts = batch.column("text").take(pa.array(rows))
        for at, part in chunks(texts, CHUNK_BYTES):
            yield group, rows[at : at + len(part)], part


def hashed(rows: np.ndarray, group: int) -> np.ndarray:
    """64-bit hash of each row of tokens within a group."""
    out = np.full(len(rows), (group + 1) * int(MULTIPLIER) % 2**64, np.uint64)
    for k in range(rows.shape[1]):
        out = (out ^ (rows[:, k].astype(np.uint64) + np.uint64(1))) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


class HashArray:
    """Values by 64-bit hash: two sorted arrays."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order] for v in values]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), [np.zeros(len(keys)) for _ in self.values]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, [v[at] for v in self.values]


def distinct_grams(size, ids, names, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key of the n-gram at each token, distinct keys, their counts, their code points, a row each)."""
    keys, back = keyed(*windows(size, ids, order), order)
    distinct, n = np.unique(keys, return_counts=True)
    rows = back(distinct)
    return keys, distinct, n, rows if names is None else names[rows].reshape(len(rows), -1)


def seed(group: str) -> int:
    return xxhash.xxh64_intdigest(group)


def unit_count(rows: DataFrame, text: str, size: int) -> int:
    return -(-(rows.agg(F.sum(F.octet_length(text))).first()[0] or 0) // size) or 1


def with_units(rows: DataFrame, text: str = "text", units: int | None = None) -> DataFrame:
    """Adds unit, by a hash of all columns that can be hashed, so copies of a text with ids of their own are dealt out."""
    units = units or unit_count(rows, text, UNIT_BYTES)
    parts = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    return rows.withColumn("unit", F.pmod(F.xxhash64(*parts), F.lit(units)))


def packed(rows: DataFrame) -> DataFrame:
    """unit, rows: the rows of each unit, without that column, as compressed blocks of Arrow batches."""

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield blocks(held)
                held, size = [], 0
        if held:
            yield blocks(held)

    def blocks(held):
        table = pa.Table.from_batches(held).combine_chunks()
        unit = table["unit"].to_numpy()
        order = np.argsort(unit, kind="stable")
        found, begins = np.unique(unit[order], return_index=True)
        table, out = table.drop_columns(["unit"]), []
        for low, high in zip(begins, [*begins[1:], len(order)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table.take(pa.array(order[low:high])))
            out.append(zstandard.ZstdCompressor(level=3).compress(sink.getvalue()))
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(out, pa.binary())], ["unit", "rows"])

    return rows.mapInArrow(pack, "unit long, rows binary")


def unpacked(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The batches in the blocks of a unit."""
    for block in table["rows"]:
        yield from pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(block.as_py()))


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, the first bytes of all before the second."""
    wide = np.ascontiguousarray(numbers)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, wide.itemsize).T).tobytes())


def _numbers(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows of tokens, counts), each n-gram once, by hash."""
    hashes, first, place = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    n = np.bincount(place, weights=np.concatenate([p[2] for p in parts]), minlength=len(hashes)).astype(np.int64)
    return hashes, np.concatenate([p[1] for p in parts])[first], n


def found_grams(batches: Iterator[pa.RecordBatch], order: int, tokens: Tokens) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By group the hashes, tokens and counts of the distinct n-grams of all texts, by hash."""
    parts: dict[str, list] = {}
    for batch in batches:
        for group, _, texts in by_group(batch):
            size, ids, codes = tokens(texts)
            if len(ids):
                _, _, n, found = distinct_grams(size, ids, codes, order)
                held = parts.setdefault(group, [])
                held.append((hashed(found, seed(group)), found, n))
                if len(held) > 2 and sum(len(h[0]) for h in held[1:]) > PENDING:
                    held[:] = [_merged(held)]
    return {group: _merged(held) for group, held in sorted(parts.items())}


def part_count(units: int) -> int:
    return -(-units // UNITS_A_PART)


def packed_grams(rows: DataFrame, order: int, tokens: Tokens, parts: int) -> DataFrame:
    """unit, part, grp, tokens, n from rows of ``packed``: the distinct n-grams of a unit, by hash, in ``parts`` ranges of the hash."""

    def count(table: pa.Table) -> pa.Table:
        out = []
        for group, (hashes, found, n) in found_grams(unpacked(table), order, tokens).items():
            ends = np.searchsorted(_part(hashes, parts), np.arange(parts), side="right").tolist()
            for part, (low, high) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if low < high:
                    out.append((part, group, _planes(found[low:high].T.astype("<u4")), _planes(n[low:high].astype("<i8"))))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary()]
        unit = pa.array([table["unit"][0].as_py()] * len(out), pa.int64())
        return pa.table([unit, *map(pa.array, columns, kinds)], ["unit", "part", "grp", "tokens", "n"])

    schema = "unit long, part int, grp string, tokens binary, n binary"
    return saved(rows.groupBy("unit").applyInArrow(count, schema), "packed-grams")


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) * np.uint64(parts)) >> np.uint64(31)


def part_of(hash_: Column, parts: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(hash_, 33) * F.lit(parts).cast("long"), 31).cast("int")


def merged_grams(grams: DataFrame, order: int) -> DataFrame:
    """grp, gram, c, hash: the n-grams of all units from ``packed_grams``, a part in a task. Tokens are single code points."""
    names = ["grp", "gram", "c", "hash"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]

    def merge(table: pa.Table) -> pa.Table:
        held: dict[str, list] = {}
        for group, tokens, n in zip(table["grp"], table["tokens"], table["n"], strict=True):
            rows = _numbers(tokens.as_py(), np.uint32).reshape(order, -1).T
            parts = held.setdefault(group.as_py(), [])
            parts.append((hashed(rows, seed(group.as_py())), rows, _numbers(n.as_py(), np.int64)))
            if len(parts) > 2 and sum(len(p[0]) for p in parts[1:]) > PENDING:
                parts[:] = [_merged(parts)]
        out = [pa.table([pa.array([], t) for t in kinds], names)]
        for group, parts in held.items():
            hashes, rows, n = _merged(parts)
            place = np.lexsort(rows.T[::-1])  # neighbours share their beginning, which compresses well
            columns = [pa.array([group] * len(place), pa.string()), grams_of(rows[place]), pa.array(n[place]), pa.array(hashes[place].view(np.int64))]
            out.append(pa.table(columns, names))
        return pa.concat_tables(out)

    return grams.groupBy("part").applyInArrow(merge, "grp string, gram string, c long, hash long")


def packed_values(grams: DataFrame, model: DataFrame, order: int, parts: int) -> DataFrame:
    """unit, part, grp, numbers: the ``value`` of each n-gram of a row of ``packed_grams``, in its order; ``model`` has hash and value."""
    names = ["unit", "part", "grp", "numbers"]

    def look_up(own: pa.Table, model: pa.Table) -> pa.Table:
        table = HashArray(model["hash"].to_numpy().view(np.uint64), model["value"].to_numpy())
        out = []
        for group, tokens in zip(own["grp"], own["tokens"], strict=True):
            rows = _numbers(tokens.as_py(), np.uint32).reshape(order, -1).T
            found, (values,) = table.find(hashed(rows, seed(group.as_py())))
            if not found.all():
                raise RuntimeError("n-grams of a unit are not in the model")
            out.append(_planes(values.astype("<f8")))
        return pa.table([own["unit"], own["part"], own["grp"], pa.array(out, pa.binary())], names)

    asked = model.select(part_of(F.col("hash"), parts).alias("part"), "hash", "value").groupBy("part")
    schema = "unit long, part int, grp string, numbers binary"
    return saved(grams.select("unit", "part", "grp", "tokens").groupBy("part").cogroup(asked).applyInArrow(look_up, schema), "packed-values")


def unit_values(batches: Iterator[pa.RecordBatch], values: pa.Table, order: int, tokens: Tokens) -> HashArray:
    """The values of a unit by the hashes of its n-grams, which are found again from its texts."""
    held: dict[str, list] = {}
    for part, group, numbers in zip(values["part"], values["grp"], values["numbers"], strict=True):
        held.setdefault(group.as_py(), []).append((part.as_py(), _numbers(numbers.as_py(), np.float64)))
    found = {group: hashes for group, (hashes, _, _) in found_grams(batches, order, tokens).items()}
    answers = {group: np.concatenate([v for _, v in sorted(parts, key=lambda p: p[0])]) for group, parts in held.items()}
    if {g: len(h) for g, h in found.items()} != {g: len(v) for g, v in answers.items()}:
        raise RuntimeError("n-grams of a text are not in the table of all: its rows changed between two readings")
    if not found:
        return HashArray(np.zeros(0, np.uint64), np.zeros(0))
    return HashArray(np.concatenate(list(found.values())), np.concatenate([answers[g] for g in found]))


def losses(size, ids, names, order: int, group: str, table: HashArray) -> list[np.ndarray]:
    """Sums of the token losses of each text, one for each value (a log probability) that the table has of an n-gram."""
    ends = np.cumsum(size)
    if not len(ids):
        return [np.zeros(len(size)) for _ in table.values]
    keys, distinct, _, rows = distinct_grams(size, ids, names, order)
    found, values = table.find(hashed(rows, seed(group)))
    if not found.all():
        raise RuntimeError("n-grams of a text are not in the table of all: its rows changed between two readings")
    # A direct table by hash; what it has no room for is searched.
    room = max(10, int(len(distinct) * 8).bit_length())
    slot = lambda x: (x.view(np.uint64) * MULTIPLIER) >> np.uint64(64 - room)
    owner = np.full(1 << room, -1, np.int64)
    owner[slot(distinct)] = np.arange(len(distinct))
    place = owner[slot(keys)]
    wrong = np.flatnonzero(distinct[place] != keys)
    place[wrong] = np.searchsorted(distinct, keys[wrong])
    sums = [np.concatenate([[0.0], np.cumsum(-value[place])]) for value in values]
    return [total[ends] - total[ends - size] for total in sums]


def _discounts() -> list[Column]:
    """D1, D2, D3+ of the modified method from the counts of counts n1 to n4; 0.5, 1, 1.5 where they cannot be estimated."""
    n = [F.col(f"n{j}").cast("double") for j in (1, 2, 3, 4)]
    y = F.try_divide(n[0], n[0] + 2 * n[1])
    known = F.least(*n) > 0
    return [
        F.when(known, F.least(F.greatest(k + 1 - (k + 2) * y * F.try_divide(n[k + 1], n[k]), F.lit(0.05)), F.lit(k + 1 - 0.05)))
        .otherwise(F.lit(0.5 * (k + 1))).alias(f"d{k + 1}")
        for k in range(3)
    ]


class Level:
    """Order k: ``grams`` (grp, gram, p and, of the highest, hash) and ``contexts`` (grp, context, total, back)."""

    def __init__(self, grams: DataFrame, contexts: DataFrame) -> None:
        self.grams, self.contexts = grams, contexts


def kneser_ney(grams: DataFrame, order: int) -> tuple[list[Level], DataFrame]:
    """The levels from order 1 on (between the first and the last the n-grams are deleted) of a model per group, and grp, letters: its distinct tokens and one.

    ``grams`` is of ``merged_grams``: each n-gram is one row with its count c.

    p is the interpolated probability of the last token after the others. Lower orders count the distinct tokens before an
    n-gram; start marks count like any token. Every n-gram is kept, so the back-off weights leave each context's sum at one.
    """
    spark = grams.sparkSession
    part = lambda first, tokens: F.substring("gram", first + 1, tokens)
    tables = {order: saved(grams, "grams")}
    paths = {order: last_saved()}
    for k in range(order - 1, 0, -1):
        longer = tables[k + 1].select("grp", part(1, k).alias("gram"))
        tables[k] = saved(longer.groupBy("grp", "gram").agg(F.count(F.lit(1)).alias("c")), f"grams{k}")
        paths[k] = last_saved()
    letters = saved(tables[1].groupBy("grp").agg((F.count(F.lit(1)) + 1).cast("double").alias("letters")), "letters")
    few = letters.count() <= MOST_BROADCAST
    small = lambda t: F.broadcast(t) if few else t
    levels, stale = [], None
    for k in range(1, order + 1):
        table = tables[k]
        kinds = [F.count_if(F.col("c") == j).alias(f"n{j}") for j in (1, 2, 3, 4)]
        taken = saved(table.groupBy("grp").agg(*kinds).select("grp", *_discounts()), "discounts")
        counts = [*kinds[:2], F.count_if(F.col("c") >= 3).alias("n3")]
        contexts = table.groupBy("grp", part(0, k - 1).alias("context")).agg(F.sum("c").alias("total"), *counts)
        contexts = saved(contexts.join(small(taken), "grp").select(
            "grp", "context", "total", ((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")).alias("back")
        ), f"contexts{k}")
        placed = table.withColumn("context", part(0, k - 1)).join(small(taken), "grp")
        if k == 1:
            placed = placed.join(small(contexts), ["grp", "context"]).join(small(letters), "grp").withColumn("lower", 1 / F.col("letters"))
        else:
            lower = levels[-1].grams.select("grp", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            placed = placed.join(contexts, ["grp", "context"]).withColumn("suffix", part(1, k - 1)).join(lower, ["grp", "suffix"])
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        p = ((F.col("c") - discount) / F.col("total") + F.col("back") * F.col("lower")).alias("p")
        done = saved(placed.select("grp", "gram", p, *["hash"][: k == order]), f"model{k}")
        levels.append(Level(done, contexts))
        forget(spark, paths[k])
        if k > 2:  # the n-grams of orders between the first and the last are not needed any more
            forget(spark, stale)
        stale = last_saved() if k > 1 else stale
    return levels, letters
