"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words. Two lines match at Jaccard similarity 0.8 or more; a line is removed if any line before it
(by document id, then line number) matches it. Method: words are ordered by rarity; if two sets of sizes m and n match, they
share at least a = ceil(t / (1 + t) * (m + n)) words, so the first word they share is, in both, among the first
size - a + 1. Only those prefixes are joined, under the length filter, the positional filter, and a filter on 128-bit
signatures (each word turns one bit over, so the differing bits are at most the differing words, however long the lines are).
What is left is verified on the words.

Words are represented by 64-bit hashes: the logarithm of the word's frequency in the six high bits, so that plain numeric
order is the order by rarity, and 57 bits of hash. Frequencies are those of 2^18 hash buckets, counted over all lines;
any order gives exact results, a rare one only gives short candidate lists.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import forget, last_saved, saved

SIMILARITY = (4, 5)  # as a fraction, so that all limits are whole numbers
BUCKET_BITS = 18
KEY_WORDS = 8  # rarest words of a set; two neighbours of them lead to its likely match
MOST_BROADCAST = 2_000_000  # settled sets, 8 bytes each; more are joined by shuffle
SETTLED = 1 << 31  # a bit above every place in a line
HALVES = ["low", "high"]
PARTS = [f"p{i}" for i in range(4)]
MARKS = 7 << BUCKET_BITS  # lines are marked in a bitmap of this fixed size, seven to a byte


def _least_shared(m: Column, n: Column) -> Column:
    """ceil(t / (1 + t) * (m + n)): words that matching sets of these sizes share."""
    p, q = SIMILARITY
    return F.floor(((m + n) * p + (p + q - 1)) / F.lit(p + q))


def _bucket(word: Column) -> Column:
    return F.shiftrightunsigned(word, 64 - BUCKET_BITS)


def _bit(word: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def _signature(i: int, parts: int) -> Column:
    """64 bits, part i of the signature of the set ``words`` in so many parts (a power of two): each word turns one bit of one part over."""
    turned = lambda w: F.when(F.shiftright(w, 6).bitwiseAND(F.lit(parts - 1)) == i, _bit(w)).otherwise(F.lit(0).cast("long"))
    return F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s.bitwiseXOR(turned(w)))


def _distance(parts: list[str]) -> Column:
    return sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in parts), F.lit(0))


def _table(rows: DataFrame, key: str, value: str) -> Column:
    """The numbers, under 128, of a table of 2^BUCKET_BITS places as one array; places without a row are 0.

    A scalar subquery: the array travels with the tasks, and no plan holds it as text.
    """
    places = rows.sparkSession.range(1 << BUCKET_BITS).select(F.col("id").alias("place"), F.lit(0).cast("tinyint").alias("v"))
    full = rows.select(F.col(key).cast("long").alias("place"), F.col(value).cast("tinyint").alias("v")).unionByName(places)
    full = full.groupBy("place").agg(F.max("v").alias("v"))
    in_order = lambda x, y: F.transform(F.array_sort(F.collect_list(F.struct(x, y))), lambda e: e[y])
    pieces = full.groupBy(F.shiftright("place", 10).alias("piece")).agg(in_order("place", "v").alias("vs"))
    return pieces.agg(F.flatten(in_order("piece", "vs"))).scalar()


def word_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each line's own number (uid), document, place, length, set key (s1, s2) and distinct word hashes.

    Lines without words are left out. A document is its id and a hash of its text, so rows of equal id and equal text count as one document.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    each = rows.select("doc_id", F.xxhash64("text").alias("doc_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # One blank between words, so that the split needs no pattern; empty pieces drop out by their hash.
    line = F.col("line")
    for other in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(other), F.lit(" "))
    hashed = F.array_remove(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))
    sets = each.select(
        "doc_id", "doc_hash", "line_no", F.length("line").alias("chars"), F.sort_array(F.array_distinct(hashed)).alias("words")
    ).where(F.size("words") > 0)
    return saved(
        sets.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "doc_hash", "line_no", "chars", F.xxhash64("words").alias("s1"), F.hash("words").alias("s2"), "words"),
        "line-sets", "zstd",
    )


def _rarity(lines: DataFrame) -> Column:
    """For each hash bucket how often its words are in a line, as a logarithm; 0: at most once. A table of fixed size."""
    counts = lines.select(F.explode("words").alias("w")).groupBy(_bucket(F.col("w")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return _table(counts.select("bucket", F.least(F.lit(62), F.ceil(F.log2("n") * 2)).alias("level")), "bucket", "level")


def _prefix_size(n: Column) -> Column:
    p, q = SIMILARITY
    return (n - F.floor((n * p + (q - 1)) / F.lit(q)) + 1).cast("int")


def _distinct_sets(lines: DataFrame) -> DataFrame:
    """Each distinct set once, as its first line, with its rarest words: those of its prefix, and at least KEY_WORDS."""
    n = F.size("words")
    key = lambda w, levels: F.shiftleft(F.get(levels, _bucket(w).cast("int")).cast("long"), 57).bitwiseOR(F.shiftrightunsigned(w, 7))
    # Subqueries may not stand in a higher-order function, so the table comes as a column; it is used once, and no row holds it.
    keys = F.transform(F.array("levels"), lambda levels: F.transform("words", lambda w: key(w, levels)))[0]
    each = lines.withColumn("levels", _rarity(lines)).select(
        "s1", "s2", F.struct("doc_id", "line_no", "uid", "doc_hash").alias("place"), n.alias("n"),
        *[_signature(i, len(HALVES)).alias(c) for i, c in enumerate(HALVES)],
        F.slice(F.sort_array(keys), F.lit(1), F.greatest(_prefix_size(n), F.lit(KEY_WORDS))).alias("rarest"),
    )
    distinct = each.groupBy("s1", "s2").agg(
        F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("n", *HALVES, "rarest")]
    )
    return saved(distinct.select("s1", "s2", "place.*", "n", *HALVES, "rarest"), "line-prefixes", "zstd")


def _in_other_lines(word: Column) -> Column:
    return F.shiftrightunsigned(word, 57) > 0


def _prefixes(distinct: DataFrame) -> DataFrame:
    """A row for each word of a set's prefix that is in another line too; of ``distinct`` with the flag settled.

    Words are 32 bits here: words that fall together only make a candidate more.
    """
    n = F.col("n")
    each = distinct.select(
        "doc_id", "line_no", "uid", "n", *HALVES, "settled", F.posexplode(F.slice("rarest", F.lit(1), _prefix_size(n))).alias("i", "word")
    ).where(_in_other_lines(F.col("word")))
    sizes = F.shiftleft(n.cast("long"), 32).bitwiseOR(F.col("i").cast("long")).bitwiseOR(F.when(F.col("settled"), F.lit(SETTLED)).otherwise(F.lit(0)).cast("long"))
    return each.select(F.hash("word").alias("word"), "doc_id", "line_no", "uid", *HALVES, sizes.alias("sizes"))


def _likely(distinct: DataFrame) -> DataFrame:
    """(b, a): for each set the first set that has two neighbours of its KEY_WORDS rarest words, without those no other has, as neighbours too, a before b.

    One row at most for each pair of those words, so the size of a group of near copies does not matter.
    """
    rare = distinct.select(F.struct("doc_id", "line_no", "uid").alias("place"), F.filter("rarest", _in_other_lines).alias("rare"))
    two = lambda i, j: F.when(F.size("rare") > j, F.xxhash64(F.col("rare")[i], F.col("rare")[j]))
    keys = F.array_compact(F.array(*[two(i, j) for i, j in pairwise(range(KEY_WORDS))]))
    keyed = rare.select("place.*", F.explode(keys).alias("key"))
    common = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("key")
    keyed = saved(keyed.join(common, "key").select("key", F.struct("doc_id", "line_no", "uid").alias("place")), "line-keys")
    firsts = keyed.groupBy("key").agg(F.min("place").alias("first"))
    found = keyed.join(firsts, "key").where("place.uid <> first.uid")
    return found.select(F.col("place.uid").alias("b"), F.col("first.uid").alias("a")).distinct()


def _candidates(prefixes: DataFrame) -> DataFrame:
    """(b, a, distance): first lines b, not settled, and a of sets that may match, a before b, with the distance of their signatures.

    Both sides are the same rows, so they are shuffled once; a settled b fails the positional filter.
    """
    a, b = (prefixes.select(*[F.col(c).alias(f"{side}_{c}") for c in prefixes.columns]) for side in "ab")
    p, q = SIMILARITY
    (m, i), (n, j) = ((F.shiftright(f"{s}_sizes", 32), F.col(f"{s}_sizes").bitwiseAND(F.lit(mask))) for s, mask in (("a", SETTLED - 1), ("b", 2 * SETTLED - 1)))
    shared = _least_shared(m, n)
    before = F.struct(F.col("a_doc_id").alias("x"), F.col("a_line_no").alias("y"), F.col("a_uid").alias("z")) < F.struct(
        F.col("b_doc_id").alias("x"), F.col("b_line_no").alias("y"), F.col("b_uid").alias("z")
    )
    distance = _distance(HALVES)
    pairs = a.join(
        b,
        (F.col("a_word") == F.col("b_word")) & (m * q >= n * p) & (n * q >= m * p) & (distance <= m + n - shared * 2)
        & (i <= m - shared) & (j <= n - shared) & before,
    )
    return pairs.select(F.col("b_uid").alias("b"), F.col("a_uid").alias("a"), distance.alias("distance")).distinct()


def _asked(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines that ``pairs`` name, and few others, with signatures of 256 bits in four parts.

    A bitmap of fixed size by hash of the line leaves most other lines unread by the joins that follow; where there are so many
    pairs that it is full, all lines go in.
    """
    mark = lambda uid: F.pmod(F.xxhash64(uid), F.lit(MARKS))
    place, bit = F.floor(F.col("mark") / 7).cast("int"), F.expr("shiftleft(1, cast(mark % 7 as int))")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("uid")).select(mark("uid").alias("mark"))
    marks = _table(asked.groupBy(place.alias("i")).agg(F.bit_or(bit).alias("bits")), "i", "bits")

    marked = lines.select("uid", "doc_id", "line_no", "words", mark("uid").alias("mark"))
    marked = marked.where(F.get(marks, place).cast("int").bitwiseAND(bit) != 0)
    return saved(
        marked.select("uid", F.struct("doc_id", "line_no", "uid").alias("place"), F.size("words").alias("n"), *[_signature(i, len(PARTS)).alias(c) for i, c in enumerate(PARTS)], "words"),
        "line-asked", "zstd",
    )


def _close(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs, a before b, that signatures of 256 bits allow, with that distance; the longest lines pass the 128 bits of the join by chance."""
    joined = pairs.select("a", "b")
    for side in "ab":
        joined = joined.join(asked.select(F.col("uid").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("place", "n", *PARTS)]), side)
    m, n = F.col("a_n"), F.col("b_n")
    distance = _distance(PARTS)
    allowed = m + n - _least_shared(m, n) * 2
    close = joined.where("a_place < b_place").select("a", "b", distance.alias("distance"), allowed.alias("allowed"))
    return saved(close.where("distance <= allowed").drop("allowed"), "line-pairs-close")


def _verified(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """The lines b that match their a on the words."""
    with_a = pairs.select("a", "b").join(asked.select(F.col("uid").alias("a"), F.col("words").alias("wa")), "a")
    with_b = with_a.join(asked.select(F.col("uid").alias("b"), F.col("words").alias("wb")), "b")
    p, q = SIMILARITY
    both = F.size(F.array_intersect("wa", "wb"))
    return saved(with_b.where(both * q >= (F.size("wa") + F.size("wb") - both) * p).select("b").distinct(), "line-matches")


def _matching(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines b that match one of their a.

    One earlier match is enough, so each set is first verified against its most likely one; only sets that fail there are
    verified against all their candidates.
    """
    asked = _asked(pairs, lines)
    path = last_saved()
    pairs = _close(pairs, asked)
    best = pairs.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("best"))
    sure = _verified(best.select("b", "best.a"), asked)
    rest = saved(pairs.join(sure, "b", "left_anti"), "line-pairs-left")
    found = sure.unionByName(_verified(rest, asked))
    forget(lines.sparkSession, path)
    return found


def _repeated_sets(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """First lines b whose set matches a set at an earlier place.

    Sets that match the first of those with two neighbours of their rarest words, as the members of a group of near copies do, need no more;
    the others are joined to all earlier sets that may match.
    """
    early = _matching(saved(_likely(distinct), "line-pairs-likely"), lines)
    done = early.select(F.col("b").alias("uid"), F.lit(True).alias("settled"))
    settled = distinct.join(F.broadcast(done) if early.count() <= MOST_BROADCAST else done, "uid", "left")
    settled = settled.withColumn("settled", F.coalesce("settled", F.lit(False)))
    pairs = saved(_candidates(_prefixes(settled)), "line-pairs")
    return early.unionByName(_matching(pairs, lines))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lines: DataFrame | None = None) -> DataFrame:
    """doc_id, doc_hash, line_no, chars of every line that matches an earlier one."""
    lines = word_sets(docs, id_col, text_col) if lines is None else lines
    distinct = _distinct_sets(lines)
    matched = _repeated_sets(distinct, lines).select(F.col("b").alias("first"), F.lit(True).alias("matched"))
    place = F.struct("doc_id", "line_no", "doc_hash")
    sets = saved(distinct.select("s1", "s2", place.alias("place"), F.col("uid").alias("first")).join(matched, "first", "left"), "line-firsts")
    same = F.col("place.doc_id").eqNullSafe(F.col("doc_id"))
    for column in ("line_no", "doc_hash"):  # rows of equal id and text share their lines' places
        same = same & (F.col(f"place.{column}") == F.col(column))
    return (
        lines.select("doc_id", "doc_hash", "line_no", "chars", "s1", "s2").join(sets, ["s1", "s2"])
        .where(F.col("matched").isNotNull() | ~same)
        .select("doc_id", "doc_hash", "line_no", "chars")
    )


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_removed, removed_chars. Null texts have no lines."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("doc_hash"),
                      F.coalesce(F.size(F.split(F.col(f"`{text_col}`"), "\n")), F.lit(0)).alias("n_lines"))
    own = own.withColumn("n_lines", F.greatest("n_lines", F.lit(0)).cast("long"))
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col).distinct().groupBy("doc_id", "doc_hash").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")
    )
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("doc_hash").alias("gone_hash"), "n", "chars")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("doc_hash") == F.col("gone_hash"))
    return own.join(gone, same, "left").select(
        "doc_id", "n_lines", F.coalesce("n", F.lit(0)).alias("n_removed"), F.coalesce("chars", F.lit(0)).alias("removed_chars")
    )


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that match an earlier line removed from the text; rows and columns stay as they are.

    Lines without words stay. Rows of equal id and equal text count as one document and keep the same lines. Null texts stay null.
    """
    mark = "_gone"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"  # whatever the table's columns are called
    gone = (
        repeated_lines(docs, id_col=id_col, text_col=text_col).groupBy("doc_id", "doc_hash")
        .agg(F.collect_set("line_no").alias(mark))
        .select(F.col("doc_id").alias(f"{mark}id"), F.col("doc_hash").alias(f"{mark}hash"), mark)
    )
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(f"{mark}id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(f"{mark}hash"))
    joined = docs.join(gone, same, "left")
    kept = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda line, i: ~F.array_contains(mark, i)), "\n")
    text = F.when(F.col(mark).isNull(), F.col(f"`{text_col}`")).otherwise(kept)
    return joined.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])
