"""Round trips and small cases of token files, packing, archives and SimHash."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from proofline.llm.common import public_tokenizer, tokenizer_definition
from proofline.llm.encoding import Encoder
from proofline.llm.packing import pack, plan_packing
from proofline.llm.simhash import near_duplicates
from proofline.llm.tokenfile import from_planes, read_token_files, to_planes, write_token_files
from proofline.llm.warc import assemble, read_warc, write_warc
from proofline.session import scratch

TEXTS = ["a<|endoftext|> b<|endoftext|>", "<|startoftext|>\tx <|endoftext| >", "Hello  world\n it's", None, "", " lead", "a \n b  c", "x" * 5000, "same text", "same text"]


@pytest.mark.parametrize("form", ["bit", "byte"])
def test_planes(form):
    ids = np.random.default_rng(1).integers(0, 2**32, 1003, dtype=np.uint64).astype("<u4")
    assert (from_planes(to_planes(ids, form), len(ids), form) == ids).all()


def _ids(name):
    tokenizer = Tokenizer.from_file(public_tokenizer(name))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in TEXTS]


@pytest.mark.parametrize(("name", "keeps_space"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_are_those_of_the_library(name, keeps_space):
    rng, tokenizer = random.Random(6), Tokenizer.from_file(public_tokenizer(name))
    parts = ["<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", "it's", " ", "  ", "\n", "\t ", "Ünï", "é", "漢字", "12", "...", "word", "\u00a0", "A"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    counts, ids = Encoder(tokenizer_definition(public_tokenizer(name)), keeps_space).encode(pa.array(texts))
    ends = np.cumsum(counts)
    for text, end, count in zip(texts, ends.tolist(), counts.tolist(), strict=True):
        assert ids[end - count : end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    folder = scratch(spark, "test-ids")
    manifest = write_token_files(docs, folder, public_tokenizer("byte_bpe_50k.json"), block=7, file_ids=50)
    rows = sorted(map(tuple, read_token_files(manifest, folder).collect()))
    ids, start, expected = _ids("byte_bpe_50k.json"), 0, []
    for k, own in enumerate(ids):
        expected.append((k, start, len(own), _crc(own)))
        start += len(own)
    assert rows == expected


def test_packing(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, length long")
    rows = pack(docs, public_tokenizer("word_bpe_49k.json"), capacity=16).collect()
    ids = _ids("word_bpe_49k.json")
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length <= 16 and _crc(own) == r.ids_crc32
    assert sorted((r.doc_id, r.piece) for r in rows) == [(k, p) for k, own in enumerate(ids) for p in range(-(-len(own) // 16))]
    for s in {r.sequence_id for r in rows}:
        places = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 16
    assert pack(docs.limit(0), public_tokenizer("word_bpe_49k.json")).count() == 0


def test_plan_fills_sequences():
    plan = plan_packing({1500: 40, 548: 40, 100: 100}, 2048, 8, 32)
    assert plan.sequences == 45


def test_archives(spark):
    long, short = "<p>" + "é" * 80, "<p>short"
    pages = [(5, "http://a/\r\nx", long), (3, "http://b", long), (9, None, long), (4, "u", short), (2, "u", short), (7, "u", None)]
    folder = scratch(spark, "test-warc")
    manifest = write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), folder, file_bytes=900)
    found = {r.page_id: r.response for r in assemble(read_warc(manifest, folder)).collect()}
    assert len(found) == 6
    for page_id, _, html in pages:
        data = (html or "").encode()
        r = found[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        again = page_id in (5, 9)
        assert (r.type, r.refers_to) == (("revisit", 3) if again else ("response", None))


def test_simhash_components(spark):
    text = " ".join(f"word{k}" for k in range(300))
    docs = spark.createDataFrame([(4, text), (2, text.upper()), (9, None), (7, ""), (8, "some other text here")], "doc_id long, text string")
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    assert rows[2] == (rows[4][0], 2) and rows[4][1] == 2
    assert rows[9] == ("0" * 16, 7) and rows[7] == ("0" * 16, 7) and rows[8][1] == 8
