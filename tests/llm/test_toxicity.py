import numpy as np
from pyspark.sql import functions as F

from quantloom.llm import boosting, toxicity
from quantloom.llm.common import table

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    got = toxicity.query(spark, DIR)
    rows = got.join(table(spark, DIR, "labels").select("doc_id", "toxic"), "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() >= 0.9
    rank, pos = held["score"].rank(), held["toxic"].sum()
    auc = (rank[held["toxic"] == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(held) - pos))
    assert auc >= 0.8
    every = got.toPandas()
    assert len(every) == table(spark, DIR, "documents").count()
    assert every["score"].between(0, 1).all() and ((every["score"] >= 0.7) == (every["predicted"] == 1)).all()
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(every["doc_id"], every["held_out"]))


def test_edge_rows(spark, make_docs):
    docs = make_docs(["", None, "you stupid 1d10t", "you stupid 1d10t", "fine words here", "w " * 50_000], [1, 2, 3, 3, None, 5])
    labels = spark.createDataFrame([(3, 1), (5, 0), (5, None), (2, 7), (None, 1)], "doc_id long, toxic int")
    got = toxicity.op4(docs.withColumnRenamed("lang", "score"), labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id == 3]
    assert same[0] == same[1]
    assert toxicity.op4(make_docs([]), labels).count() == 0


def test_no_labels_at_all(spark, make_docs):
    got = toxicity.op4(make_docs(["a", "b"]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [r.predicted for r in got] == [0, 0]


def test_obfuscations_are_found():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "lowe*": 2.0})
    assert lexicon.look("idiot,")[0] == 1
    assert lexicon.look("1d1ot")[0] == 3 and lexicon.look("i.d.i.o.t")[0] == 3 and lexicon.look("iiiidiot")[0] == 3
    assert lexicon.look("loweiß")[0] == 2 and lexicon.look("lower")[0] == 2 and lexicon.look("low")[0] == 0
    spaced = toxicity.features("what an i d i o t here", lexicon)
    assert spaced[-1] == 1


def test_boosting_and_calibration_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    odds = model.log_odds(x[2000:])
    assert ((odds > 0) == (y[2000:] > 0.5)).mean() > 0.95
    scale = boosting.calibrate(odds, y[2000:])
    grid = scale(np.linspace(-10, 10, 200))
    assert (np.diff(grid) >= 0).all() and grid.min() >= 0 and grid.max() <= 1
    assert boosting.calibrate(np.zeros(4), np.array([0, 1, 1, 1.0]))(np.zeros(1))[0] == 0.75


def test_at_most_so_many_documents_are_learned_from_and_only_such_as_are_there(spark, make_docs):
    docs = make_docs(["you idiot", "other text"], [7, 8]).selectExpr("explode(sequence(1, 500)) AS k", "*").unionByName(make_docs([f"text {i}" for i in range(60)], list(range(100, 160))).selectExpr("1 AS k", "*"))
    labels = spark.createDataFrame([(7, 1), (7, 1), (7, 0), (8, 0), *((i, i % 2) for i in range(100, 400))], "doc_id long, toxic int")
    rows = toxicity._training_rows(docs, labels, "text", 50).collect()
    assert len(rows) == 50  # absent documents take no place, repeated rows take one
    every = toxicity._training_rows(docs, labels, "text", 1000).collect()
    assert len(every) == 62 and [(r.y, r.text) for r in every if "idiot" in r.text] == [(1, "you idiot")]


def test_a_fold_s_lexicon_does_not_know_the_fold(spark):
    rows = [(f, y, f"zyx{f} common" if y else "common words") for f in range(toxicity.FOLDS) for y in (0, 1) for _ in range(60)]
    own = toxicity.learn_lexicons(spark.createDataFrame(rows, "fold int, y int, text string"))
    assert len(own) == toxicity.FOLDS + 1
    for f in range(toxicity.FOLDS):
        assert f"zyx{f}" not in own[f] and all(f"zyx{g}" in own[f] for g in range(toxicity.FOLDS) if g != f)
        assert f"zyx{f}" in own[-1]


def test_clashing_names_of_the_result(spark, make_docs):
    docs = make_docs(["a", "b"]).selectExpr("*", "'x' AS predicted", "'y' AS held_out", "'z' AS score", "3 AS y")
    got = toxicity.op4(docs, spark.createDataFrame([(0, 1)], "doc_id long, toxic int").selectExpr("*", "'q' AS text"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 2
