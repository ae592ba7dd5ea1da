import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import bpe, tokens
from quantloom.llm.tokens import encoding, ranks_path

rng = random.Random(1)
TEXTS = ["", None, "a" * 900, "hello world  it's 12 x\n\n y " * 60, "".join(rng.choice("ab c\n'sé1漢 \x1c\x85") for _ in range(3000)), "漢字かな" * 400, " " * 1000 + "x", "word " * 50, "<|endoftext|>", "word"]


@pytest.mark.parametrize("chunk,overlap", [(100, 30), (64, 32), (bpe.CHUNK, bpe.OVERLAP)])
def test_equals_encoding_in_one_go_and_round_trips(make_docs, chunk, overlap):
    docs = make_docs(TEXTS).withColumnRenamed("lang", "ids").withColumnRenamed("source", "bytes")
    enc = encoding(ranks_path())
    rows = bpe.decode(bpe.encode(docs, chunk=chunk, overlap=overlap)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(text)
        assert bytes(r.bytes) == text.encode()


def test_query_on_real_documents(real_docs):
    want = {r.doc_id: bpe.reference_digest(r.text) for r in real_docs.collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op10(real_docs).collect()} == want


def test_long_text_repeated_rows_and_empty_table(make_docs):
    text = "some words, 12 and more\n" * 9000
    rows = bpe.op10(make_docs([text, text, ""], [1, 1, None])).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted([bpe.reference_digest(text)] * 2 + [bpe.reference_digest("")])
    assert bpe.op10(make_docs([])).count() == 0


def test_overlap_is_checked(make_docs):
    with pytest.raises(ValueError):
        bpe.encode(make_docs(["a"]), chunk=10, overlap=6)


SCRIPTS = {
    "japanese": "吾輩は猫である。名前はまだ無い。どこで生れたか、とんと見当がつかぬ。",
    "cyrillic": "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. ",
    "greek": "Ἐν ἀρχῇ ἦν ὁ λόγος, καὶ ὁ λόγος ἦν πρὸς τὸν θεόν. ",
    "thai": "กาลครั้งหนึ่งนานมาแล้ว มีชายคนหนึ่ง ",
    "mixed": "don't 12漢字, we'll see… ünïcode😀 x\n\n\ty ",
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_every_script_is_stitched(spark, name):
    own = random.Random(2)
    words = [SCRIPTS[name][a : a + own.randrange(3, 20)] for a in range(0, len(SCRIPTS[name]), 3)]
    text = SCRIPTS[name] + "".join(own.choice(words) for _ in range(200_000 // 8))
    text = (text * 2)[:200_000]
    chunk, overlap = bpe.CHUNK, bpe.OVERLAP
    step = chunk - overlap
    rows = [(0, k, text[k * step : k * step + chunk]) for k in range(-(-(len(text) - overlap) // step))]
    got = [r["_piece"] for r in bpe.pieces(spark.createDataFrame(rows, "_doc long, _no int, _chunk string"), chunk, overlap).orderBy("_no").collect()]
    assert "".join(got) == text and len(got) == len(rows) > 1  # each chunk is a piece of its own
    code = encoding(ranks_path()).encode_ordinary
    assert [i for p in got for i in code(p)] == code(text)


def test_only_chunks_without_a_common_boundary_are_put_together(spark):
    text = "some words here " * 400 + "x" * 900 + " and more words, too" * 400
    rows = [(0, k, text[k * 150 : k * 150 + 200]) for k in range(-(-(len(text) - 50) // 150))]
    got = [r["_piece"] for r in bpe.pieces(spark.createDataFrame(rows, "_doc long, _no int, _chunk string"), 200, 50).orderBy("_no").collect()]
    assert "".join(got) == text and 0.85 * len(rows) < len(got) < len(rows)
    code = encoding(ranks_path()).encode_ordinary
    assert [i for p in got for i in code(p)] == code(text)


def test_a_sure_boundary_is_one_for_both_libraries():
    """Between any two kinds of character, wherever the reading starts; tiktoken's own reading of the pattern is asked with
    a vocabulary of single bytes and the ids of a text and of its halves."""
    code = encoding(ranks_path()).encode_ordinary
    own = random.Random(7)
    letters = "aZéßжя漢かกاא'1２٣ \u00a0\u2003.。,-_“…\n\tँ゛"
    seen = 0
    for _ in range(4000):
        text = "".join(own.choice(letters) for _ in range(12))
        for b in range(1, len(text)):
            if tokens.sure_boundary(text[b - 1], text[b]):
                seen += 1
                assert any(m.end() == b for m in tokens.pattern().finditer(text))
                assert code(text[:b]) + code(text[b:]) == code(text)
    assert seen > 5000


def test_numbered_rows_of_a_shuffled_table(make_docs):
    texts = [f"{k} some words, 12 and more\n" * 200 for k in range(40)]
    docs = make_docs(texts).repartition(5).withColumn("more", F.lit(1))
    rows = bpe.decode(bpe.encode(docs, chunk=300, overlap=40)).collect()
    assert {r.doc_id: bytes(r.bytes).decode() for r in rows} == dict(enumerate(texts)) and len(rows) == 40 and rows[0].more == 1


def test_the_possessive_pattern_matches_as_the_given_one_does():
    own = random.Random(9)
    given = tokens.regex.compile(tokens.public_tokenizers.PATTERN)
    for _ in range(3000):
        text = "".join(own.choice("ab's'tre'vell'd 1٣²é漢_-.\u00a0\n\t ") for _ in range(own.randrange(0, 40)))
        assert given.findall(text) == tokens.pattern().findall(text)
