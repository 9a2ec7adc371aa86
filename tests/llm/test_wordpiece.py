"""The automaton against plain greedy longest matching."""

import random

import pytest

from proofline.llm.common import public_tokenizer
from proofline.llm.wordpiece import END, Automaton, token_counts, word_end_vocabulary


def greedy(word, first, later, ends):
    rest, tokens, n = (*word, *([END] if ends else [])), set(first), 0
    while rest:
        if rest == (END,):
            return n
        size = next((k for k in range(len(rest), 0, -1) if rest[:k] in tokens), 0)
        if not size:
            return -1
        rest, tokens, n = rest[size:], set(later), n + 1
    return n


@pytest.mark.parametrize("seed", range(40))
def test_random_vocabularies(seed):
    rng = random.Random(seed)
    make = lambda n, end: list({tuple(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) + ((END,) if end and rng.random() < 0.4 else ())
                                for _ in range(n)})
    end = seed % 2 == 0
    first = make(rng.randrange(1, 25), end)
    later = make(rng.randrange(1, 25), end) if seed % 4 < 2 else None
    automaton = Automaton(first, later)
    words = [bytes(rng.choice(b"abcd" if seed % 5 == 0 else b"abc") for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    ends = any(END in t for t in first)
    expected = [greedy(w, first, first if later is None else later, ends) for w in words]
    got = automaton.count(words)
    assert [int(x) for x in got] == expected


def test_empty_words_and_long_words():
    automaton = Automaton([(97,), (97, 97)])
    assert automaton.count([b"", b"a" * 5001, b"b"]).tolist() == [0, 2501, -1]


def test_table(spark):
    vocabulary = word_end_vocabulary(public_tokenizer("word_bpe_49k.json"))
    automaton = Automaton(vocabulary)
    docs = spark.createDataFrame(
        [(1, "The  CAT\tsat", "a"), (2, None, "b"), (3, "", "c"), (None, "éééxq z", "d"), (1, "The  CAT\tsat", "a")],
        "doc_id long, text string, n_words string",
    )
    rows = sorted(map(tuple, token_counts(docs, automaton).collect()), key=str)
    tokens = lambda t: sum(greedy(tuple(w), vocabulary, vocabulary, True) for w in t.lower().encode().split())
    assert rows == sorted([
        (1, 12, 3, tokens("The CAT sat"), 0), (1, 12, 3, tokens("The CAT sat"), 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0),
        (None, 7, 2, tokens("éééxq z"), 0),
    ], key=str)
    assert token_counts(docs.limit(0), automaton).count() == 0
