"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import BLANKS, of_ids, public_tokenizer, saved, table
from proofline.llm.packing import pack
from proofline.llm.tokenfile import read_token_files, write_token_files
from proofline.llm.warc import assemble, read_warc, write_warc
from proofline.llm.simhash import near_duplicates
from proofline.llm.decontaminate import contaminated
from proofline.llm.quality import quality_verdicts
from proofline.llm.crossentropy import cross_entropy_difference
from proofline.llm.lines import line_report
from proofline.llm.wordpiece import Automaton, token_counts, word_end_vocabulary
from proofline.llm.quoting import format_threads, linked_messages
from proofline.llm.infilling import fill_in_middle, restored
from proofline.llm.periodic import periodic_runs
from proofline.llm.secrets import KINDS, secret_spans
from proofline.session import scratch


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 tokens at most. Nulls, empty texts, ties and repeated rows as in ``pack``."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"))


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids in files of planes, read back from them. Nulls, empty texts and repeated rows as in ``write_token_files``."""
    folder = scratch(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, folder, public_tokenizer("byte_bpe_50k.json"))
    return read_token_files(manifest, folder)


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as archive records, read back and assembled to one row per capture. Nulls and repeated payloads as in ``write_warc``."""
    folder = scratch(spark, "warc-files")
    manifest = write_warc(table(spark, sf_dir, "pages"), folder)
    records = saved(read_warc(manifest, folder, with_payload=False), "warc-records")
    return assemble(records).select(
        "page_id",
        "response.payload_bytes",
        "response.payload_digest",
        F.col("response.type").alias("record_type"),
        "response.refers_to",
    )


def op4_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Nulls, empty texts and repeated rows as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_pigeonhole_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that occurs in it. Nulls, short items and repeated rows as in ``contaminated``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document. Nulls, empty texts and repeated rows as in ``quality_verdicts``."""
    return quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "loss"
    )


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the models of the good documents and of all. Nulls, empty texts and repeated rows as in ``cross_entropy_difference``."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy_difference(docs, of_ids(docs, good, "doc_id"))


def op5_line_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document and how many repeat an earlier one. Nulls, empty texts and repeated rows as in ``line_report``."""
    return line_report(table(spark, sf_dir, "documents"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pieces of every document. Nulls, empty texts and repeated rows as in ``token_counts``."""
    automaton = Automaton(word_end_vocabulary(public_tokenizer("word_bpe_49k.json")))
    return token_counts(table(spark, sf_dir, "documents"), automaton)


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as reply-ordered threads without quotes. Nulls, empty texts and repeated rows as in ``linked_messages``."""
    return format_threads(linked_messages(table(spark, sf_dir, "conversations")))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(decimal doc_id) ends in 0, the words from number a on repeat p words, as the contract of op11 says.

    A null id counts as no digits, a null text as empty.
    """
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    chosen = docs.select("doc_id", "text", number.alias("h")).withColumn(
        "words", F.when(F.expr("h % 10 = 0"), F.array_remove(F.split(F.coalesce("text", F.lit("")), BLANKS), ""))
    )
    placed = chosen.selectExpr("*", "size(words) AS n", "h div 10 AS g").selectExpr(
        "doc_id", "text", "words", "n", "g", "cast(if(n > 0, g % n, 0) AS int) AS a",
    ).selectExpr("*", "cast(1 + (n - a) div (3 + g % 8) AS int) AS p")
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a + p - 1) div p AS int))), 1, n - a)"
    return placed.selectExpr(
        "doc_id", f"CASE WHEN n > 0 THEN array_join(concat(slice(words, 1, a), {tail}), ' ') ELSE text END AS text"
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them with planted periods; the longest run and digests of all runs and of the collapsed text.

    Ties of the longest run go to the smallest start, then period. The results for nulls, empty texts and repeated rows are those of
    ``periodic_runs`` and ``with_periodic_tails``.
    """
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"])))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    found = periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents"))).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.expr("1000 * best.length div -best.col3").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the three base kinds, and all spans with those confirmed by structure.

    The results for nulls, empty texts and repeated rows are those of ``secret_spans``.
    """
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return secret_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
    )


def op13_fenwick_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-the-middle form: digests of the output and of the text restored from it.

    The results for nulls, empty texts and repeated rows are those of ``fill_in_middle``.
    """
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
           sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex
    FROM documents
), numbers AS (
    SELECT *, len(units) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
           ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4
    FROM drawn
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
           CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), parts AS (
    SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
           array_to_string(units[high + 1:], '') AS suffix
    FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quotation_linking": op2_quotation_linking,
    "op3_cross_entropy_difference": op3_cross_entropy_difference,
    "op4_simhash_tiles": op4_simhash_tiles,
    "op5_line_similarity_join": op5_line_similarity_join,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_planes": op7_token_planes,
    "op8_perplexity_bands": op8_perplexity_bands,
    "op9_warc_transactions": op9_warc_transactions,
    "op10_pigeonhole_matches": op10_pigeonhole_matches,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_structural_secrets": op12_structural_secrets,
    "op13_fenwick_infilling": op13_fenwick_infilling,
}
ORACLES: dict[str, str] = {"op13_fenwick_infilling": OP13_SQL}
