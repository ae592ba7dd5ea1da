import hashlib
import random
import re

from pyspark.sql import functions as F

from quantloom.llm import chunk_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    out = {}
    for key, own in groups.items():
        keep = min(own)[1]
        for _, i in own:
            out[i] = (keep, len(own), i == keep, hashlib.sha256(key.encode()).hexdigest())
    return out


def check(docs):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in chunk_dedup.op3(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_real_documents(real_docs):
    check(real_docs)


def test_edge_texts(make_docs):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij klmno\n漢é𝒳") for _ in range(60_000))
    texts = ["", None, " \t\n", "a b", "ab", "a\tb ", " ab", "x" * 20_000, "x" * 19_999, long, long + "z", " ".join(long[i : i + 50] for i in range(0, len(long), 50)), "same", "same"]
    check(make_docs(texts).withColumnRenamed("lang", "kept").withColumnRenamed("source", "chunk"))


def test_repeated_rows_keep_one_and_null_ids(make_docs):
    got = chunk_dedup.op3(make_docs(["t u", "t u", "tu"], [7, 7, None])).collect()
    assert len(got) == 3 and sum(r.kept for r in got) == 1
    assert {r.group_size for r in got} == {3} and {r.keep_id for r in got} == {7}


def test_empty_table(make_docs):
    assert chunk_dedup.op3(make_docs([])).count() == 0


def test_chunks_join_to_the_text_and_resynchronise(spark):
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    df = spark.createDataFrame([(body,), ("inserted" + body,)], "t string").select(chunk_dedup.chunks(F.col("t")).alias("c"), "t")
    one, two = df.collect()
    assert "".join(one.c) == one.t and "".join(two.c) == two.t
    assert len(set(one.c) & set(two.c)) >= 0.8 * len(one.c)


def test_shared_hashes_are_told_apart(make_docs, monkeypatch):
    """With an identifier that collides all the time the verified numbers still separate contents."""
    bad = lambda chunk, number=None: F.struct(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b"), (F.lit(0) if number is None else number).cast("int").alias("n"))
    monkeypatch.setattr(chunk_dedup, "identifier", bad)
    check(make_docs(["one", "two", "one", "three three", "threethree", ""]))
