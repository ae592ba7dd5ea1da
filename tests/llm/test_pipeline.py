import corpus_pipeline
from quantloom.llm import near_dup, packing, secret_scan
from quantloom.llm.common import table, written

DIR = "/root/testdata/sf0.001"


def test_stages_do_their_work_on_what_is_left(spark):
    docs = table(spark, DIR, "documents")
    columns = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, before, DIR), name)
        assert docs.columns == columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and docs.count() == len(left)
        sizes.append(len(left))
        if name == "exact_dedup":
            assert docs.selectExpr("translate(text, ' \\n\\t\\r', '') AS t").distinct().count() == docs.count()
        if name == "near_dedup":
            assert near_dup.near_duplicates(docs).where("NOT kept").count() == 0
        if name == "secrets":
            assert len(left) == len(ids)
            assert secret_scan.op9(docs).where("n_assign + n_access + n_hex > 0").count() == 0
            assert docs.where("n_chars != length(text)").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * table(spark, DIR, "documents").count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert out.columns == packing.op5(docs).columns


def test_repeated_rows_null_ids_and_extra_columns(spark, make_docs):
    docs = make_docs(["one text here", "one text here", "one  text here", "token = abcdef12", None, ""], [1, 1, None, 2, 3, None]).selectExpr("*", "'x' AS score", "1 AS kept", "text AS _text2")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        docs = written(out)
    assert sorted((r.text or "") for r in docs.collect()) == ["", "[SECRET]", "one  text here"]


def test_rows_that_share_an_id_but_not_their_text_stay(spark, make_docs):
    one, two = " ".join(f"x{k}" for k in range(40)), " ".join(f"y{k}" for k in range(40))
    docs = make_docs([one, one + " end", two, two, one + "  end"], [3, 5, 5, 5, 9])
    for name in ("exact_dedup", "near_dedup"):
        docs = written(dict(corpus_pipeline.STAGES)[name](spark, docs, DIR))
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(3, one), (5, two)]


def test_the_run_leaves_only_what_its_result_reads(spark):
    import pathlib

    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    out = corpus_pipeline.run(spark, DIR)
    left = sorted(p.name.split("-")[1] for p in set(shared.iterdir()) - before)
    assert left == ["pieces", "secrets"] and out.count() > 0


def test_empty(spark, make_docs):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0
