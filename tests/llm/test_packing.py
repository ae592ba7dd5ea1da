import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quantloom.llm import packing, tokens


LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, packing.END], dtype="<u4")


def check(got, texts, capacity=1024):
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_seq.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    docs = {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
    for i, own in docs.items():
        ids = ids_of(texts[i])
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        assert len(own) == 1 or (len(ids) > capacity and all(r.length == capacity for r in own[1:]))
    return len(by_seq), -(-sum(r.length for r in got) // capacity)


def test_real_documents_pack_tightly(real_docs):
    texts = {r.doc_id: r.text for r in real_docs.collect()}
    got = packing.op5(real_docs).collect()
    assert set(r.doc_id for r in got) == set(texts)
    used, least = check(got, texts)
    assert used <= 1.05 * least


def test_edges(make_docs):
    texts = ["", None, "a", "a " * 5000, "<|endoftext|> spelled", "é" * 1023, "word " * 1023, "word " * 1022]
    docs = make_docs(texts).withColumnRenamed("lang", "length").withColumnRenamed("source", "offset")
    check(packing.op5(docs).collect(), dict(enumerate(texts)))
    assert packing.op5(make_docs([])).count() == 0


def test_repeated_rows_and_null_ids(make_docs):
    got = packing.op5(make_docs(["x y z"] * 3, [4, 4, None])).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3


def best_fit_decreasing(histogram, capacity=1024):
    room, n = [0] * (capacity + 1), 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length] if length < capacity else 0):
            space = next((s for s in range(length, capacity + 1) if room[s]), None)
            if space is None:
                n, space = n + 1, capacity
            else:
                room[space] -= 1
            room[space - length] += 1
    return n


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(n): int(rng.integers(1, 40)) for n in rng.choice(np.arange(1, 1025), 300, replace=False)}
    ranges, used = packing.plan(histogram)
    seen = {}
    fill = {}
    for length, rank, n, first, offset in ranges.tolist():
        seen.setdefault(length, []).append((rank, n))
        for k in range(n):
            fill.setdefault(first + k, []).append((offset, length))
    for length, count in histogram.items():
        if length < 1024:
            own = sorted(seen[length])
            assert sum(n for _, n in own) == count and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    for own in fill.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 1024
    assert len(fill) == used <= 1.04 * best_fit_decreasing(histogram)


def test_ids_equal_those_of_tokenizers():
    own = LIBRARY
    for cp in [*range(1, 0x3000, 7), *range(0x3000, 0x20000, 501)]:
        if not 0xD800 <= cp < 0xE000:
            text = f"a{chr(cp)}b {chr(cp)} 1{chr(cp)}  {chr(cp)}\n"
            assert packing.token_ids(text) == own.encode(text, add_special_tokens=False).ids


def test_ids_of_all_documents_equal_those_of_the_library(spark, monkeypatch):
    """Also once the memory for pre-tokens is full."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["\U0001f600 emoji\u180e and\u200b others\x1c\x85", "it's we'll 'tis ''s", " \u2003 x\u00a0\u00a0y \n\n", "a<|endoftext|>b"]
    want = [np.array(LIBRARY.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    for memory in (tokens.MEMORY, 1000):
        monkeypatch.setattr(tokens, "MEMORY", memory)
        own = tokens.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
        assert [x for k in range(0, len(texts), 300) for x in own.encode(texts[k : k + 300])] == want
        assert len(own) <= memory


def test_a_row_repeated_very_often_is_ranked_in_many_buckets(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    docs = make_docs(["x y z", "some other words"], [4, 5]).selectExpr("explode(sequence(1, 3000)) AS k", "*").drop("k")
    got = packing.op5(docs).collect()
    places = {(r.sequence_id, r.offset): r.length for r in got}
    assert len(got) == len(places) == 6000
    used = {q for q, _ in places}
    assert all(sum(n for (s, _), n in places.items() if s == q) <= 1024 for q in list(used)[:20]) and len(used) <= 1.05 * sum(places.values()) / 1024 + 1


def test_spelled_out_pattern_splits_as_the_pattern_does(real_docs):
    """On texts of sure characters, whatever their order; every such character is tried beside each kind."""
    rng = np.random.default_rng(5)
    sure = np.array([c for c in map(chr, range(0x10000)) if tokens.kind(c)])
    common = np.array([*" \n\t\r　\xa0'slltremvdA9é!-²٣日"])
    texts = ["".join(np.where(rng.random(n) < 0.8, rng.choice(common, n), rng.choice(sure, n))) for n in rng.integers(0, 40, 4000)]
    texts += ["".join(x) for c in ("a", "7", "!", " ", "\n", "'") for x in (sure, sum(([s, c] for s in sure.tolist()), []))]
    texts += [r.text for r in real_docs.collect() if r.text]
    for t in texts:
        assert tokens.unsure().search(t) or tokens.sure_pattern().findall(t) == tokens.pattern().findall(t)
