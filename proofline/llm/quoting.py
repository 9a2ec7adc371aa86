"""Chat formatting with quotation linking.

Messages that quote others by leading ">" marks, nested or not, are linked to the messages they quote: each quoted line and
passage is normalised and hashed, and joined to the earliest message that says it itself: one before it in the same conversation
if there is one, else the one of the smallest number in any other conversation, whether that number is smaller or greater, since
conversation numbers are no times. Short passages are looked for in the same conversation only. Conversations whose messages quote one another become one thread. The thread is written out without its quotes,
every message after the one it replies to.

Messages are numbered once, in order of conversation and turn, by a range sort. A thread is in order of the greatest number among a
message and all that it replies to, directly or not, then of its depth: without links to greater numbers that is the order
of the numbers. Where replies go in a circle, the message of the smallest number in it replies to nothing. No conversation,
however long, is ordered or collected in one task.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import saved
from proofline.llm.components import components

MARKS = re.compile(r"\s{0,3}((?:>\s?)+)")
LEAST_CHARS = 12  # shorter passages are said by too many to tell who is quoted, outside their conversation
BLOCK_MESSAGES = 500

# Line before a quote that names its author, in the languages at hand. Fixed values.
AUTHOR_LINE = re.compile(r"(?:On|Am|Le|El)\b.{0,200}(?:wrote|schrieb.{0,80}|a écrit|escribió)\s?:\s*")

PARSED = "number long, body string, own array<long>, quoted array<struct<level:int,passage:long>>"
PARSED_ARROW = pa.schema({
    "number": pa.int64(), "body": pa.string(), "own": pa.list_(pa.int64()),
    "quoted": pa.list_(pa.struct({"level": pa.int32(), "passage": pa.int64()})),
})


def parse_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(text without quotes and author lines, quoted passages with their level, outermost 1)."""
    own, passages = [], []
    last = 0
    for line in (text or "").split("\n"):
        found = MARKS.match(line)
        level = found[1].count(">") if found else 0
        rest = line[found.end():] if found else line
        if not level:
            own.append(line)
        elif level == last:
            passages[-1][1].append(rest)
        else:
            if not last:
                while own and (not own[-1].strip() or AUTHOR_LINE.fullmatch(own[-1].strip())):
                    own.pop()
            passages.append((level, [rest]))
        last = level
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines in passages]


def passage_keys(text: str) -> list[int]:
    """Hashes of the normalised lines, paragraphs and whole of a text: how a quote is wrapped does not matter for the last two.

    The lowest bit is set for those under ``LEAST_CHARS``. What has no word is taken as it is.
    """
    parts = {text, *text.split("\n"), *re.split(r"\n\s*\n", text)}
    plain = {" ".join(re.findall(r"\w+", p.lower()) or p.split()) for p in parts}
    return sorted((xxhash.xxh64_intdigest(p) - (1 << 63)) & ~1 | (len(p) < LEAST_CHARS) for p in plain if p)


def numbered(rows: DataFrame, name: str, *keys: str | Column) -> DataFrame:
    """``rows`` with column number: 0, 1, ... in the order of the keys, from a range sort and the counts of its parts."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = saved(placed, name)
    part = F.shiftright("_place", 33)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())  # one row a part
    before, starts = 0, []
    for p, n in counts:
        starts.append((p, before))
        before += n
    table = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _start long"))
    return (
        placed.withColumn("_part", part).join(table, "_part")
        .withColumn("number", F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_start", "_place")
    )


def _parse(messages: DataFrame) -> DataFrame:
    def parse(batches):
        for batch in batches:
            rows = []
            for number, text in zip(batch.column("number").to_pylist(), batch.column("text"), strict=True):
                body, passages = parse_quotes(text.as_py())
                keys = {(level, key) for level, p in passages for key in passage_keys(p)}
                rows.append({
                    "number": number, "body": body, "own": passage_keys(body),
                    "quoted": [{"level": level, "passage": key} for level, key in sorted(keys)],
                })
            yield pa.RecordBatch.from_pylist(rows, PARSED_ARROW)

    return messages.select("number", "text").mapInArrow(parse, PARSED)


def _upward(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(message, top, depth) of the messages whose replies end, and (message, up, least) of the others, which lead into a circle.

    ``rows``: number, reply_to. Every step doubles the way looked at. top is the greatest number on a message's way, least the
    smallest; for the others the way is at least as long as they are many, so ``up`` is in a circle and least, there, its smallest.
    """
    total = rows.count()
    state = rows.select(
        F.col("number").alias("message"), F.col("reply_to").alias("up"), F.col("number").alias("top"), F.col("number").alias("least"),
        F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("depth"),
    )
    state, reach = saved(state, "upward"), 1
    while True:
        left = state.where("up is not null").count()
        if not left or reach > total:
            break
        above = state.select(
            F.col("message").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("least").alias("_least"),
            F.col("depth").alias("_depth"),
        )
        going = state.where("up is not null").join(above, "up", "left").select(  # what is outside the rows is an end
            "message", F.col("_up").alias("up"), F.greatest("top", "_top").alias("top"), F.least("least", "_least").alias("least"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
        )
        state, reach = saved(state.where("up is null").unionByName(going), "upward"), 2 * reach
    return state.where("up is null").select("message", "top", "depth"), state.where("up is not null").select("message", "up", "least")


def _placing(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(message, top, depth) for messages number, reply_to, and the messages (number, cut) that stop replying to break a circle."""
    ended, circling = _upward(rows)
    circle = circling.select(F.col("up").alias("message")).distinct()
    cut = saved(
        circling.join(circle, "message", "left_semi").where("message = least").select(F.col("message").alias("number"), F.lit(True).alias("cut")),
        "circles",
    )
    if cut.count():
        ended, _ = _upward(rows.join(cut, "number", "left").select("number", F.when(F.col("cut").isNull(), F.col("reply_to")).alias("reply_to")))
    return ended, cut


def linked_messages(messages: DataFrame) -> DataFrame:
    """Every message with number, thread_id, position in the thread, reply_to (a number), n_quotes, n_linked, and its body.

    ``messages``: conv_id, turn, role, text. Ties of conversation and turn are ordered by role and text; repeated rows are
    messages of their own. A message without a found quote replies to the one before it in its conversation. Null texts have an empty
    body; messages with a null conversation are threads of one, as long as nothing links them.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = numbered(rows, "messages", "conv_id", "turn", "role", F.xxhash64("text"))
    heads = saved(order, "numbered-messages")
    parsed = saved(_parse(heads), "parsed-messages")
    conv = heads.select("number", "conv_id")
    said = parsed.select("number", F.explode("own").alias("passage")).join(conv, "number")
    in_conv = said.groupBy("conv_id", "passage").agg(F.min("number").alias("near"))
    long = F.col("passage").bitwiseAND(F.lit(1)) == 0
    anywhere = said.where(long).groupBy("passage").agg(F.min(F.struct("number", "conv_id")).alias("far"))
    asked = parsed.where(F.size("quoted") > 0).select("number", F.explode("quoted").alias("q")).select("number", "q.level", "q.passage")
    # Messages of a null conversation are each one of their own.
    other = ~F.coalesce(F.col("conv_id") == F.col("far.conv_id"), F.col("number") == F.col("far.number"))
    seen = saved(
        asked.join(conv, "number").join(in_conv, ["conv_id", "passage"], "left").join(anywhere, "passage", "left")
        .withColumn("parent", F.when(F.col("near") < F.col("number"), F.col("near")).when(other, F.col("far.number")))
        .where("parent is not null or far is not null"), "quotes",
    )
    # Said first in the quoting conversation itself, but later: the earliest of another conversation.
    stuck = seen.where("parent is null").select("passage", "far").distinct()
    second = said.join(stuck, "passage").where(other).groupBy("passage").agg(F.min("number").alias("second"))
    found = (
        seen.join(second, "passage", "left").withColumn("parent", F.coalesce("parent", "second")).where("parent is not null")
    )
    votes = found.groupBy("number", "level", "parent").agg(F.count(F.lit(1)).alias("n"), F.count_if(long).alias("n_long"))
    # The innermost level that is found at all wins, then the most passages, long ones first, then the latest message.
    links = saved(
        votes.groupBy("number").agg(F.min(F.struct("level", -F.col("n_long"), -F.col("n"), -F.col("parent"), "parent")).alias("best"), F.sum("n").alias("n_linked"))
        .select("number", F.col("best.parent").alias("parent"), "n_linked"), "quote-links",
    )
    across = (
        links.join(conv, "number").join(conv.select(F.col("number").alias("parent"), F.col("conv_id").alias("other")), "parent")
        .where("conv_id != other").select(F.least("conv_id", "other").alias("a"), F.greatest("conv_id", "other").alias("b"))
    )
    merged = components(across).select(F.col("node").alias("conv_id"), F.col("component").alias("thread"))
    before = conv.select((F.col("number") + 1).alias("number"), F.col("conv_id").alias("previous"))
    whole = (
        heads.join(parsed.select("number", "body", F.size("quoted").alias("n_quotes")), "number")
        .join(links, "number", "left").join(before, "number", "left").join(merged, "conv_id", "left")
        .select(
            F.col("number"), F.col("thread").isNotNull().alias("merged"), F.coalesce("thread", "conv_id").alias("thread_id"), "conv_id", "turn", "role", "body", "n_quotes",
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
            F.coalesce("parent", F.when(F.col("previous") == F.col("conv_id"), F.col("number") - 1)).alias("reply_to"),
        )
    )
    whole = saved(whole, "replies")
    ahead = whole.where("reply_to > number").select(F.col("thread_id").alias("_thread")).distinct()
    turned = saved(
        whole.where("merged").join(ahead, F.col("thread_id") == F.col("_thread"), "left_semi").select("number", "reply_to"), "turned"
    )
    placing, cut = _placing(turned)
    whole = (
        whole.join(placing.withColumnRenamed("message", "number"), "number", "left").join(cut, "number", "left")
        .withColumn("reply_to", F.when(F.col("cut").isNull(), F.col("reply_to")))
        .withColumn("top", F.coalesce("top", "number")).withColumn("depth", F.coalesce("depth", F.lit(0))).drop("cut", "merged")
    )
    placed = saved(
        numbered(whole.withColumnRenamed("number", "message"), "threads", "thread_id", "top", "depth", "message")
        .withColumnRenamed("number", "place"), "placed-messages",
    )
    first = placed.groupBy(F.col("thread_id").alias("_thread")).agg(F.min("place").alias("first"))
    return placed.join(first, F.col("thread_id") == F.col("_thread"), "left").select(
        F.col("message").alias("number"), "thread_id", F.coalesce(F.col("place") - F.col("first"), F.lit(0)).alias("position"),
        "conv_id", "turn", "role", "body", "n_quotes", "n_linked", "reply_to",
    )


def chat_text(role: str = "role", body: str = "body") -> Column:
    return F.concat(F.lit("<|"), F.coalesce(F.col(role), F.lit("unknown")), F.lit("|>\n"), F.col(body), F.lit("\n<|end|>\n"))


def format_threads(linked: DataFrame, block_messages: int = BLOCK_MESSAGES) -> DataFrame:
    """thread_id, block, n_messages, n_quotes, n_linked, text: the threads in blocks of so many messages at most.

    A block is the most that is ever gathered in one row; a thread's text is that of its blocks in order.
    """
    place = F.when(F.col("thread_id").isNull(), F.col("number")).otherwise(F.floor(F.col("position") / block_messages))
    rows = linked.select("thread_id", place.alias("block"), F.struct("position", "number", chat_text().alias("said")).alias("m"), "n_quotes", "n_linked")
    return rows.groupBy("thread_id", "block").agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum("n_quotes").alias("n_quotes"), F.sum("n_linked").alias("n_linked"),
        F.array_join(F.array_sort(F.collect_list("m"))["said"], "").alias("text"),
    )
