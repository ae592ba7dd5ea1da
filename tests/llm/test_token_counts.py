from collections import Counter

from quantloom.llm import token_counts
from quantloom.llm.tokens import encoding, ranks_path

TEXTS = ["", None, "a b c", "a b c", "word " * 700, "naïve 漢字", "x" * 3000]


def lengths(texts):
    enc = encoding(ranks_path())
    return [len(enc.encode_ordinary(t or "")) for t in texts]


def test_histogram_and_suffix_sums_match_brute_force(make_docs):
    got = {r.n_tokens: r for r in token_counts.op1(make_docs(TEXTS)).collect()}
    own = lengths(TEXTS)
    assert {k: r.n_docs for k, r in got.items()} == Counter(own)
    for limit, r in got.items():
        assert r.docs_ge == sum(n >= limit for n in own)
        assert r.tokens_ge == sum(n for n in own if n >= limit)
        assert r.docs_le == sum(n <= limit for n in own)
        assert r.truncated_tokens == sum(min(n, limit) for n in own)
        assert (r.total_docs, r.total_tokens) == (len(own), sum(own))
        assert abs(r.quantile - sum(n <= limit for n in own) / len(own)) < 1e-12


def test_small_blocks_and_any_limit(real_docs):
    own = lengths([r.text for r in real_docs.collect()])
    table = token_counts.context_table(token_counts.length_histogram(real_docs), block=7)
    wanted = [0, 1, 100, 511, 512, 5000, 10**6]
    for r in token_counts.limits(table, wanted).collect():
        assert r.docs_over == sum(n > r.context_limit for n in own)
        assert r.truncated_tokens == sum(min(n, r.context_limit) for n in own)


def test_empty_table_and_clashing_columns(make_docs):
    docs = make_docs([]).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "block")
    assert token_counts.op1(docs).count() == 0


def test_each_text_is_encoded_once_and_a_very_long_one_is_whole(make_docs):
    text = "some words, 12 and more\n" * 45_000
    got = token_counts.op1(make_docs([text, "a"]))
    assert {r.n_tokens for r in got.collect()} == set(lengths([text, "a"]))
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()  # only the written counts are read
    assert token_counts.limits(token_counts.length_histogram(make_docs([])), [5]).collect()[0].truncated_tokens == 0
