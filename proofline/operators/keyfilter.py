"""Cut a long history to the keys that matter before it is shuffled.

A Bloom filter of the wanted keys is built by an aggregate and read as a scalar subquery, so the long table is filtered where
it is scanned. It lets some other rows through, never drops a wanted one; an exact join follows anyway. Its size is fixed by
``bits``, whatever the number of keys: with many keys it only filters less.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23  # one megabyte; up to about a million keys, one row in fifty of the others passes
HASHES = 3


def _places(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(bits).cast("bigint")) for seed in range(HASHES)]


def bloom_words(wanted: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """One row with the filter as an array of ``bits / 64`` numbers. Keys meet in it by bit_or, map-side first."""
    if bits % 64:
        raise ValueError("bits must be a multiple of 64")
    spark = wanted.sparkSession
    marked = wanted.select(F.explode(F.array(*_places(key, bits))).alias("_at")).select(
        F.shiftright("_at", 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_at") % 64).cast("int")).alias("_bits")
    )
    zeros = spark.range(bits // 64).select(F.col("id").alias("_word"), F.lit(0).cast("bigint").alias("_bits"))
    words = marked.unionByName(zeros).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    listed = F.array_sort(F.collect_list(F.struct("_word", "_bits")))
    return words.agg(F.transform(listed, lambda w: w["_bits"]).alias("words"))


def with_wanted_keys(rows: DataFrame, wanted: DataFrame, key: str, bits: int | None = BITS) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``; None as ``bits`` leaves them as they are."""
    if bits is None:
        return rows
    words = bloom_words(wanted, key, bits).scalar()
    found = F.lit(True)  # the subquery is named once per hash and run once
    for at in _places(key, bits):
        word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
        found = found & (F.getbit(word, (at % 64).cast("int")) == 1)
    return rows.where(found)
