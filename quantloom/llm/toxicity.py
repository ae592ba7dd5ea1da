"""Operator 4, toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

Features are counts and rates: words of a lexicon, words that begin like one, their density and nearness to second-person
words, capitals, exclamation and other punctuation, and signs of obfuscation (digits or symbols inside words, letters
set apart, repeated letters; a lexicon word found only after undoing these). Labels, language, source and ids are never
inputs.

The lexicon is a short fixed list plus words and word beginnings that the training rows show to go with the label, by a
likelihood-ratio test that allows for the number of words tried. Word counts are taken by the workers and summed by
groupBy. Learned from are at most TRAIN labelled documents that are there, one row each: those with the smallest hash of
the id. What reaches the driver is bounded by them: the terms that pass the test, and the features.

Calibration is on scores of rows that neither the trees nor the lexicon had been fitted on: the rows lie in FOLDS folds by
a hash of their id, and for each fold a lexicon and trees of their own are learned from the others.

Null and empty texts have all features 0 and get a score too. Very long texts are scored whole. Rows are scored one by
one; repeated rows get equal scores. Labels that are null or not 0 or 1 are not learned from; a document with several
labels is toxic if one says so. Of labelled rows that repeat an id the first text in order is learned from. With no usable
label the score is 0.5. An empty table gives no rows. Extra columns are carried by score(), but for an own `score`, which
is replaced; the query ignores them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import boosting
from quantloom.llm.common import slices, table, text_of, written

TRAIN = 12_000
FOLDS = 4
THRESHOLD = 0.7
STEM = 4

#: A starting list of insults, and second-person words.
SEEDS = ("asshole", "bastard", "bitch", "clown", "crap", "cretin", "damn", "disgusting", "dumb", "dumbass", "fool", "freak", "fuck", "garbage", "hate", "idiot", "idiotic", "imbecile", "jerk", "kill", "lame", "loser", "moron", "nasty", "pathetic", "pig", "retard", "scum", "shit", "shut", "sick", "slut", "stupid", "suck", "sucks", "trash", "ugly", "vermin", "vile", "whore", "worthless")
SECOND_PERSON = frozenset(("you", "your", "yours", "yourself", "you're", "u", "ur", "du", "dich", "dir", "dein", "deine", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros"))
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"})
_TRIM = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W\d_]")
_REPEAT = re.compile(r"(.)\1{2,}")
_MARKS = np.zeros(256)
_MARKS[[ord(c) for c in "#$%&*@^~"]] = 1
_PUNCT = np.zeros(256)
_PUNCT[[ord(c) for c in "!?.,;:'\"()[]{}-_/\\|<>#$%&*@^~+="]] = 1
_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256)
_DIGIT[48:58] = 1
WIDTH = 24
#: Distinct words a worker remembers before it forgets them all.
MEMORY = 100_000
NEAR = 4


def plain(word: str) -> str:
    """The word without marks at its ends."""
    return word if word.isalnum() else _TRIM.sub("", word)


def undone(word: str) -> str:
    """The word with usual obfuscations undone: look-alike signs, marks between letters, repeated letters."""
    return _REPEAT.sub(r"\1", re.sub(r"[\W_]", "", word.translate(_LEET)))


def terms(word: str) -> tuple[str, ...]:
    own = plain(word)
    return (own, own[:STEM] + "*") if len(own) > STEM else (own,) if own else ()


@dataclass
class Lexicon:
    weight: dict[str, float]

    def __post_init__(self) -> None:
        self.seen: dict[str, tuple[int, float]] = {}

    def look(self, word: str) -> tuple[int, float]:
        """(kind, weight): 1 a word of the lexicon, 2 begins like one, 3 is one once undone, 4 second person, else 0."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > MEMORY:
                self.seen.clear()
            found = self.seen[word] = self._look(word)
        return found

    def _look(self, word: str) -> tuple[int, float]:
        own = plain(word)
        if own in self.weight:
            return 1, self.weight[own]
        if own in SECOND_PERSON:
            return 4, 0.0
        if len(own) > STEM and (w := self.weight.get(own[:STEM] + "*")) is not None:
            return 2, w
        if _INNER.search(word) or _REPEAT.search(word):
            bare = undone(word)
            if len(bare) >= STEM and bare != own and bare in self.weight:
                return 3, self.weight[bare]
        return 0, 0.0


def features(text: str, lexicon: Lexicon) -> list[float]:
    if not text:
        return [0.0] * WIDTH
    raw = text.split()
    words = text.lower().split()
    look = lexicon.look
    n = len(words)
    size = max(1, n)
    hits: list[int] = []
    persons: list[int] = []
    kinds = [0, 0, 0, 0]
    best = [0.0, 0.0, 0.0, 0.0]
    total = 0.0
    distinct: set[str] = set()
    apart: list[str] = []
    apart_hits = apart_runs = 0
    for i, w in enumerate(words):
        kind, weight = look(w)
        if kind == 4:
            persons.append(i)
        elif kind:
            hits.append(i)
            kinds[kind] += 1
            best[kind] = max(best[kind], weight)
            total += weight
            distinct.add(w)
        if len(w) == 1 and w.isalnum():
            apart.append(w)
        elif apart:
            if len(apart) >= STEM:
                apart_runs += 1
                apart_hits += undone("".join(apart)) in lexicon.weight
            apart = []
    if len(apart) >= STEM:
        apart_runs += 1
        apart_hits += undone("".join(apart)) in lexicon.weight
    near = 0
    if hits and persons:
        p = np.array(persons)
        h = np.array(hits)
        at = np.searchsorted(p, h)
        gap = np.minimum(np.abs(h - p[np.minimum(at, len(p) - 1)]), np.abs(h - p[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    chars = float(max(1, len(text)))
    shouted = sum(1 for w in raw if len(w) > 2 and w.isupper()) if counts[65:91].sum() > 0.1 * chars else 0
    return [
        kinds[1], kinds[1] / size, best[1], kinds[2], kinds[2] / size, best[2], kinds[3], kinds[3] / size, best[3],
        total, total / size, total / math.sqrt(size), len(distinct), len(persons) / size, near, near / size,
        float(counts @ _UPPER) / chars, shouted / size, counts[33] / chars, float(counts @ _PUNCT) / chars,
        float(counts @ _MARKS) / chars, float(counts @ _DIGIT) / chars, apart_runs, apart_hits,
    ]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: boosting.Boosted
    scale: boosting.Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scale(self.trees.log_odds(x)), 0.0, 1.0)


def _training_rows(docs: DataFrame, labels: DataFrame, text: str, limit: int) -> DataFrame:
    """(fold, y, text) of at most `limit` labelled documents of docs: those with the smallest hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", text_of(docs, text).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `limit` rows
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return rows.select(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "y", "text")


def learn_lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Seeds, and terms that go with the label: log odds by a smoothed count of documents. One lexicon for each fold, from
    the rows outside it, and one from all rows."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            toxic, every = Counter(), Counter()
            for t, y, f in zip(frame["text"], frame["y"], frame["fold"]):
                own = {(x, f) for w in set(t.lower().split()) for x in terms(w)}
                every.update(own)
                if y:
                    toxic.update(own)
            yield pd.DataFrame({"term": [x for x, _ in every], "fold": [f for _, f in every], "k": [toxic[x] for x in every], "n": list(every.values())})

    every = range(FOLDS)
    in_fold = lambda c, f: F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}")
    sums = rows.mapInPandas(count, "term string, fold int, k long, n long").groupBy("term").agg(*(in_fold(c, f) for c in "kn" for f in every))
    sums = written(sums, "terms")
    base = {r["fold"]: r for r in rows.groupBy("fold").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n")).collect()}  # a row for each fold
    sides = [[f for f in every if f != out] for out in (*every, None)]
    shares = [(sum(base[f]["k"] for f in side if f in base), sum(base[f]["n"] for f in side if f in base)) for side in sides]
    plus = lambda c, side: sum((F.col(f"{c}{f}") for f in side), F.lit(0)).cast("double")
    tried = sums.agg(*(F.count_if(plus("n", side) >= 3).alias(f"t{i}") for i, side in enumerate(sides))).first()
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

    def passes(i: int) -> Column:
        k, n, (toxic, rows_in) = plus("k", sides[i]), plus("n", sides[i]), shares[i]
        if not 0 < toxic < rows_in:
            return F.lit(False)
        p = toxic / rows_in
        gain = 2 * (part(k, n * p) + part(n - k, n * (1 - p)))
        return (n > 0) & (k > n * p) & (gain >= 2 * math.log(max(tried[i], 1)) + 2)

    named = sums.select("*", *(passes(i).alias(f"p{i}") for i in range(len(sides))))
    found = named.where(" OR ".join(f"p{i}" for i in range(len(sides)))).orderBy("term").collect()
    out = []
    for i, side in enumerate(sides):
        own = {w: 1.0 for w in SEEDS}
        for r in found:
            if r[f"p{i}"]:
                k, n, p = sum(r[f"k{f}"] for f in side), sum(r[f"n{f}"] for f in side), shares[i][0] / shares[i][1]
                odds = math.log((k + 0.5) / (n - k + 0.5)) - math.log(p / (1 - p))
                if odds > 1.0:
                    own[r["term"]] = odds
        out.append(own)
    return out


def _featured(rows: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """fold, y, x: the features by each lexicon, one after another."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = [Lexicon(x) for x in lexicons]
        for frame in slices(frames):
            out = frame[["fold", "y"]].copy()
            out["x"] = [[v for own in each for v in features(t, own)] for t in frame["text"]]
            yield out

    return rows.mapInPandas(run, "fold int, y int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = TRAIN) -> Model:
    """Learn from labels (doc_id, toxic) of docs."""
    rows = written(_training_rows(docs, labels, text, limit), "sample")  # looked at several times, the corpus once
    lexicons = learn_lexicons(rows)
    got = _featured(rows, lexicons).toPandas()  # at most `limit` rows of WIDTH numbers for each lexicon
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), FOLDS + 1, WIDTH)
    y, fold = got["y"].to_numpy(dtype=float), got["fold"].to_numpy()
    order = np.lexsort((*x[:, FOLDS].T, fold, y))  # the same model whatever the order of arrival
    x, y, fold = x[order], y[order], fold[order]
    held = np.zeros(len(y))
    for k in range(FOLDS):
        own = x[:, k]
        held[fold == k] = boosting.fit(own[fold != k], y[fold != k]).log_odds(own[fold == k])
    return Model(lexicons[FOLDS], boosting.fit(x[:, FOLDS], y), boosting.calibrate(held, y))


def score(model: Model, docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns (an own `score` is replaced) and score double."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        own = run_lexicon(model)
        parts = [np.zeros(0)]
        for part in slices([pa.RecordBatch.from_arrays([texts], names=["t"])]):
            parts.append(model.score(np.array([features(t, own) for t in part.column(0).to_pylist()], dtype=float).reshape(-1, WIDTH)))
        return pa.array(np.concatenate(parts), pa.float64())

    return docs.withColumn("score", run(text_of(docs, text)))


_LAST: list = [None, None]


def run_lexicon(model: Model) -> Lexicon:
    """The lexicon with what this worker remembers of words, kept from batch to batch."""
    if _LAST[0] is not model:
        _LAST[:] = [model, Lexicon(model.lexicon)]
    return _LAST[1]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' columns and score, predicted, learning only from rows that are not held out."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(model, docs).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = classify(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def query(spark, sf_dir: str) -> DataFrame:
    return op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
