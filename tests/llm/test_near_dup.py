import random

import pytest
from pyspark.sql import functions as F

from quantloom.llm import near_dup
from quantloom.llm.components import components


def shingle_set(text, width):
    words = (text or "").encode().translate(near_dup._LOWER).split()
    if not words:
        return set()
    own = min(width, len(words))
    return {tuple(words[k : k + own]) for k in range(len(words) - own + 1)}


def brute(rows, width, percent):
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter) and find(i) != find(j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def check(docs, width=3, percent=85):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, width, percent).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], width, percent)


def test_real_documents(real_docs):
    check(real_docs)


def edited(rng, words, share):
    return " ".join(rng.choice(["new", "other", "word", "thing"]) + str(rng.randrange(999)) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("width,percent,blocks", [(3, 85, (256, 1024)), (5, 80, (3, 5))])
def test_a_large_group_of_near_copies_loses_no_link(make_docs, monkeypatch, width, percent, blocks):
    """Similarities spread over the threshold, so that many links are between members other than the least one."""
    monkeypatch.setattr(near_dup, "BLOCK_U", blocks[0])
    monkeypatch.setattr(near_dup, "BLOCK_V", blocks[1])
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [edited(rng, words, rng.choice([0.005, 0.01, 0.02, 0.04])) for _ in range(120)] + [" ".join(words)] * 30
    check(make_docs(texts), width, percent)


def test_edges(make_docs):
    texts = ["", None, " \n\t", "one", "ONE", "one two", "One  Two\n", "a b c d", "A\tb c D", "é É", "É É", "x " * 9000, "x " * 9001, "\x1c"]
    docs = make_docs(texts).withColumnRenamed("lang", "n_shingles").withColumnRenamed("source", "component_id")
    check(docs)
    assert near_dup.op8(make_docs([])).count() == 0


def test_repeated_and_null_ids(make_docs):
    got = near_dup.op8(make_docs(["a b c d e"] * 4, [5, 5, 3, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("3", "3", True), ("5", "3", False), ("5", "3", False), ("None", "None", True)]


def test_rows_that_repeat_an_id_with_another_text_are_judged_by_their_text(make_docs):
    one, two = " ".join(f"x{k}" for k in range(40)), " ".join(f"y{k}" for k in range(40))
    docs = make_docs([one, one, two, two + " z", one], [3, 5, 5, 5, 3])
    got = near_dup.near_duplicates(docs).orderBy("row").collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(3, 3), (5, 3), (5, 5), (5, 5), (3, 3)]
    assert [r.kept for r in got] == [True, False, True, False, False]  # one row of each component


def test_sketch_counts_equal_bytes_and_admits_pairs_at_the_threshold(spark):
    rng = random.Random(4)
    for percent in (80, 85):
        m = near_dup.bands_for(percent)
        lanes, values = near_dup.lanes_for(m), 2 * m * near_dup.ROWS
        need, lost, rows = near_dup.least_matches(percent, values), 0, []
        for k in range(300):
            both = [rng.getrandbits(64) for _ in range(percent * 4)]
            sides = [near_dup.np.array(both + [rng.getrandbits(64) for _ in range((100 - percent) * 2)], dtype=near_dup.np.uint64) for _ in range(2)]
            one, two = (near_dup.sketch(near_dup.least_values(s, m), lanes) for s in sides)
            same = int((one.view(near_dup.np.uint8) == two.view(near_dup.np.uint8)).sum())
            lost += same - (8 * lanes - values) < need
            rows.append((same, *one.tolist(), *two.tolist()))
        names = [f"{s}{i}" for s in "ab" for i in range(lanes)]
        df = spark.createDataFrame(rows, "same long, " + ", ".join(f"{x} long" for x in names))
        assert df.where(near_dup.matches(lanes, "a", "b") != F.col("same")).count() == 0
        assert not lost


def test_bands_meet_the_stated_miss_rate():
    for percent in (80, 85):
        m = near_dup.bands_for(percent)
        s = (percent / 100) ** near_dup.ROWS
        assert 1 - (1 - (1 - s) ** m) ** 2 <= near_dup.MISS


def test_even_keys_fill_every_partition_once(spark):
    keys = near_dup.even_keys(spark, 37)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(37, "k")
    assert df.groupBy(F.spark_partition_id()).count().count() == 37


def test_components_match_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_order_of_rows_does_not_matter(real_docs):
    one = near_dup.op8(real_docs).agg(F.sum(F.xxhash64("doc_id", "component_id").cast("decimal(38,0)"))).first()
    two = near_dup.op8(real_docs.repartition(7, "n_chars")).agg(F.sum(F.xxhash64("doc_id", "component_id").cast("decimal(38,0)"))).first()
    assert one == two
