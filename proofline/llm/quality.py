"""Quality rules: counts of each text, base limits, and language-specific bands of character n-gram perplexity.

The model of each language is counted over all its texts and keeps every n-gram, so no verdict depends on other languages.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm.common import forget, last_saved, saved
from proofline.llm.ngrams import (
    WIDE_UNIT_BYTES, by_group, characters, kneser_ney, losses, merged_grams, packed, packed_grams, packed_values, part_count,
    unit_count, unit_values, unpacked, with_units,
)

ORDER = 5
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
BAND = 12.0  # spreads above and below a language's median loss
LEAST_SPREAD = 0.02  # of the median
WINDOW = 3
MOST_BROADCAST = 10_000  # languages whose limits may be broadcast

# Characters that count as symbols. Fixed value.
SYMBOLS = re.compile(r"[#*$%&|<>]")

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*NAMES, "loss")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: exactly blank and \x09-\x0D
    if not words:
        return 0, 0, len(SYMBOLS.findall(text or "")), 0, 0
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    lines, again = set(), 0
    for line in data.split(b"\n"):
        if line in lines:
            again += 1
        elif line.strip():
            lines.add(line)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(seen) < len(words) - WINDOW + 1:
        covered = 0
        for at, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
            if seen[window] > 1:
                repeated += at + WINDOW - max(at, covered)
                covered = at + WINDOW
    return len(words), chars, len(SYMBOLS.findall(text)), again, repeated


def scored(docs: DataFrame, values: DataFrame, order: int, text_col: str, carried: list[str]) -> DataFrame:
    """``docs``, with columns grp and unit; keeps grp and the carried columns, adds the base counts and the mean loss a character (null without any).

    ``values``: of ``packed_values``, the log probabilities of the n-grams in the unit's texts.
    """

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        texts_of = lambda batch: pa.RecordBatch.from_arrays([batch.column("grp"), batch.column(text_col)], ["grp", "text"])
        table = unit_values(map(texts_of, unpacked(own)), found, order, characters)
        out = []
        for batch in unpacked(own):
            n, loss, text = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), batch.column(text_col)
            for group, rows, texts in by_group(texts_of(batch)):
                size, ids, names = characters(texts)
                n[rows] = size
                (loss[rows],) = losses(size, ids, names, order, group, table)
            counts = np.array([base_counts(t.as_py()) for t in text], np.int64).reshape(-1, len(NAMES))
            columns = [*(pa.array(counts[:, k]) for k in range(len(NAMES))), pa.array(loss / np.maximum(n, 1), mask=n == 0)]
            out.append(pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *ADDED]).select(names_out))
        return pa.Table.from_batches(out) if out else pa.table({})

    kept = [f for f in docs.schema.fields if f.name in ("grp", *carried)]
    added = T.StructType([T.StructField(c, T.LongType() if c in NAMES else T.DoubleType()) for c in ADDED])
    names_out = [*[f.name for f in kept], *ADDED]
    return packed(docs).groupBy("unit").cogroup(values.groupBy("unit")).applyInArrow(score, T.StructType([*kept, *added.fields]))


def bands(rows: DataFrame, band: float = BAND) -> DataFrame:
    """Per language the lower and upper limit of the mean loss: so many spreads from the median.

    A spread is the median distance from the median, on the scale of a normal deviation, over the documents that pass the base
    rules; the sketch that Spark's percentile uses bounds the memory of a language with any number of documents.
    """
    passed = rows.where("not base_failed and loss is not null")
    middle = passed.groupBy("grp").agg(F.percentile_approx("loss", F.lit(0.5), F.lit(10_000)).alias("middle"))
    spread = (
        passed.join(middle, "grp").groupBy("grp")
        .agg(F.first("middle").alias("middle"), F.percentile_approx(F.abs(F.col("loss") - F.col("middle")), F.lit(0.5), F.lit(10_000)).alias("mad"))
        .withColumn("width", F.lit(band) * F.greatest(1.4826 * F.col("mad"), LEAST_SPREAD * F.col("middle")))
    )
    return spread.select("grp", (F.col("middle") - F.col("width")).alias("lower"), (F.col("middle") + F.col("width")).alias("upper"))


def _judged(docs: DataFrame, text_col: str, lang_col: str, order: int, band: float, carry: list[str]) -> DataFrame:
    """The carried columns in a struct ``doc``, the added ones and kept; written once before the bands are known."""
    grp = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(""))
    # The carried columns travel as c0, c1, ..., so their names cannot clash with the added ones. A carried text travels once.
    carried = [f"c{k}" for k in range(len(carry))]
    text = f"c{carry.index(text_col)}" if text_col in carry else "own_text"
    moved = docs.select(grp.alias("grp"), *[F.col(f"`{text_col}`").alias(c) for c in [text] if c not in carried], *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, carried)])
    units = unit_count(moved, text, WIDE_UNIT_BYTES)
    moved, parts = with_units(moved, text, units), part_count(units)
    grams = packed_grams(packed(moved.select("unit", "grp", F.col(text).alias("text"))), order, characters, parts)
    used = last_saved()
    levels, _ = kneser_ney(merged_grams(grams, order), order)
    values = packed_values(grams, levels[-1].grams.select("hash", F.log("p").alias("value")), order, parts)
    forget(docs.sparkSession, used)
    used = last_saved()
    judged = scored(moved, values, order, text, carried).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    )
    judged = saved(judged, "scored", "zstd")
    forget(docs.sparkSession, used)
    limits = saved(bands(judged, band), "bands")
    if limits.count() <= MOST_BROADCAST:
        limits = F.broadcast(limits)
    inside = F.coalesce(F.col("loss").between(F.col("lower"), F.col("upper")), F.lit(True))
    return judged.join(limits, "grp", "left").withColumn("kept", ~F.col("base_failed") & inside)


def quality_verdicts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
    band: float = BAND,
) -> DataFrame:
    """One row per document: base counts, base_failed, loss and perplexity a character, and kept.

    kept is false if a base rule fails or the perplexity is outside the band of the document's language. Null and empty texts
    have no words and fail; a null language is one of its own; every
    document is counted, so every language with a character has a model; rows of equal ids are judged each by itself; a language without
    any document that passes the base rules has no band.
    """
    judged = _judged(docs, text_col, lang_col, order, band, [id_col])
    return judged.select(
        F.col("c0").alias("doc_id"), *NAMES, "base_failed", "kept", F.col("grp").alias("language"), "loss",
        F.exp("loss").alias("perplexity"), "lower", "upper",
    )


def kept_documents(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, band: float = BAND,
) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, with their columns; no join on ids, which may repeat or be null."""
    judged = _judged(docs, text_col, lang_col, order, band, docs.columns)
    return judged.where("kept").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
