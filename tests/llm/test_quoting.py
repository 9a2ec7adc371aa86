"""Quotation linking on small conversations."""

from proofline.llm.quoting import format_threads, linked_messages, parse_quotes

FIRST = "Does anybody know where the red lantern went last night?"
OTHER = "It hangs behind the old mill, close to the river bank."


def test_parse_quotes():
    body, passages = parse_quotes(f"On Monday Ann wrote:\n> {OTHER}\n>> {FIRST}\n\nThanks, found it.\n> bye")
    assert body == "Thanks, found it."
    assert passages == [(1, OTHER), (2, FIRST), (1, "bye")]
    assert parse_quotes(None) == ("", [])


def _rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_links_threads_and_order(spark):
    messages = _rows(spark, [
        (1, 0, "user", FIRST), (1, 1, "assistant", OTHER), (1, 2, "user", "I see nothing there at all, sorry."),
        (1, 3, "assistant", f"> {FIRST}\n\nThen ask the miller about it."),
        (7, 0, "user", "On Friday Bob wrote:\n> It hangs behind the old mill,\n> close to the river bank.\nIs that still so?"),
        (9, 0, "user", FIRST), (9, 1, "user", f">> {FIRST}\n> unknown words that nobody said\nyes"), (4, 0, None, None),
        (5, 0, "user", "> never said by anyone before\nok"),
    ])
    rows = {(r.conv_id, r.turn): r for r in linked_messages(messages).collect()}
    number = {k: r.number for k, r in rows.items()}
    assert rows[1, 3].reply_to == number[1, 0] and rows[1, 2].reply_to == number[1, 1]
    assert rows[7, 0].reply_to == number[1, 1] and rows[7, 0].thread_id == 1
    assert [rows[k].position for k in ((1, 0), (1, 1), (1, 2), (1, 3), (7, 0))] == [0, 1, 2, 3, 4]
    assert rows[9, 1].reply_to == number[9, 0] and rows[9, 1].thread_id == 9 and rows[9, 1].body == "yes"
    assert rows[5, 0].reply_to is None and rows[5, 0].n_linked == 0 and rows[5, 0].body == "ok"
    assert all(r.reply_to is None or r.reply_to < r.number for r in rows.values())
    threads = {(r.thread_id, r.block): r for r in format_threads(linked_messages(messages), 3).collect()}
    assert threads[1, 0].n_messages == 3 and threads[1, 1].n_messages == 2
    assert threads[1, 1].text == "<|assistant|>\nThen ask the miller about it.\n<|end|>\n<|user|>\nIs that still so?\n<|end|>\n"
    assert threads[4, 0].text == "<|unknown|>\n\n<|end|>\n"


def test_ties_nulls_and_empty(spark):
    messages = _rows(spark, [(1, 0, "user", "same words here"), (1, 0, "user", "same words here"), (None, None, None, "lost message"),
                             (None, 1, "user", None)])
    rows = linked_messages(messages.withColumn("number", messages["turn"])).collect()
    assert len(rows) == 4 and len({r.number for r in rows}) == 4
    assert {r.thread_id for r in rows} == {1, None}
    assert sum(r.n_messages for r in format_threads(linked_messages(messages)).collect()) == 4
    assert linked_messages(messages.limit(0)).count() == 0


def test_links_to_later_conversations_short_passages_and_circles(spark):
    messages = _rows(spark, [
        (5, 0, "user", f"> {OTHER}\nIs it still there?"), (5, 1, "assistant", "I shall go and look for it."),
        (9, 0, "user", "Where is it?"), (9, 1, "assistant", OTHER), (9, 2, "user", "ok"), (9, 3, "assistant", "Anything else?"),
        (9, 4, "user", "> ok\nNot really."), (11, 0, "user", "> ok\nWho said so?"),
        # The second quotes what its own conversation says only later, and another one too.
        (20, 0, "user", f"> {FIRST}\nNo idea."), (20, 1, "user", FIRST), (30, 0, "user", FIRST),
        # Two conversations that quote each other.
        (40, 0, "user", "> The second text in a circle of two.\nThe first text in a circle of two."),
        (41, 0, "user", "> The first text in a circle of two.\nThe second text in a circle of two."),
    ])
    rows = {(r.conv_id, r.turn): r for r in linked_messages(messages).collect()}
    number = {k: r.number for k, r in rows.items()}
    assert rows[5, 0].reply_to == number[9, 1] and rows[5, 0].n_linked > 0
    assert {rows[c, 0].thread_id for c in (5, 9)} == {5}
    assert rows[9, 4].reply_to == number[9, 2]  # a whole short message of the same conversation
    assert rows[11, 0].reply_to is None and rows[11, 0].thread_id == 11  # not of another one
    assert rows[20, 0].reply_to == number[30, 0] and rows[20, 1].thread_id == rows[30, 0].thread_id
    assert rows[40, 0].thread_id == rows[41, 0].thread_id == 40
    assert rows[40, 0].reply_to is None and rows[41, 0].reply_to == number[40, 0]
    place = {r.number: (r.thread_id, r.position) for r in rows.values()}
    for r in rows.values():
        if r.reply_to is not None:
            assert place[r.reply_to][0] == r.thread_id and place[r.reply_to][1] < r.position
    assert len(set(place.values())) == len(rows)
