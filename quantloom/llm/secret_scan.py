"""Operator 9, secret scans: fixed patterns plus a randomness test battery; DataFrame functions only.

Base spans come from the patterns below, leftmost and non-overlapping for each kind. Spark has no function for match
offsets, so they are running sums of the lengths of the matches and of what lies between them, taken by doubling: a text
of n matches costs n log n.

The battery looks at every run of 20 or more token characters that no base span overlaps. It infers the run's encoding
(hex, base32 or base64) and has two sides:
 * randomness must not be rejected: chi-squared uniformity over the encoding's alphabet, a runs test on changes of
   character class, and lag-one serial correlation, each at RANDOM_Z;
 * ordinary text must be: coincidence index and class changes are set against those of ordinary text, with the spread
   they have at the run's length, which gives a bound of the p-value.
False discoveries are controlled by Benjamini-Hochberg within strata of length, at rate FDR, over all runs of the
input: p-values are counted in fixed logarithmic bins, rounded up, so only a bounded table of counts reaches the driver.

The corpus is read once: spans and tested runs are written, without texts where these are not asked for, and then judged.
Nothing is shuffled but the counts. Null texts read as empty, which have no spans. Very long texts, and such with very
many matches, are read whole. Rows are judged one by one, so repeated rows give repeated results; an empty table gives no
rows. Extra columns are ignored by the query, and carried, whatever their names, by redact().
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import text_of, written

# The base patterns, and least lengths of what they match.
_WORDS = "password|passwd|secret|token|api_?key"
ASSIGN = f"(?i:{_WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: Runs that the battery looks at.
RUN = "[A-Za-z0-9+/_-]{20,}+={0,2}"
FDR = 0.01
RANDOM_Z = 4.0
#: Lower bounds of the strata of length, and bins of -10 ln p.
STRATA = (20, 28, 40, 64, 128)
BINS = 2000
# Ordinary text: sums of squared and cubed letter frequencies (English, as published in cryptology texts), and share of
# neighbouring characters whose class differs.
SQUARES, CUBES, CHANGES = 0.0655, 0.0054, 0.12
MARK = "[SECRET]"
#: Spans of a text from which on it is taken apart into characters once, rather than searched for each.
MANY_SPANS = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], neutral: int) -> Column:
    """op over each element and all before it, by doubling: in step k each takes in what stands 2^k places before."""
    steps = F.when(F.size(values) > 1, F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1), lambda k: F.call_function("shiftleft", F.lit(1), k)))
    none = F.array().cast("array<int>")
    return F.aggregate(F.coalesce(steps, none), values, lambda acc, k: F.zip_with(acc, F.concat(F.array_repeat(F.lit(neutral), k), F.slice(acc, 1, F.size(acc) - k)), op))


def before(values: Column, neutral: int) -> Column:
    """Each element's predecessor, neutral for the first."""
    return F.slice(F.concat(F.array(F.lit(neutral)), values), 1, F.size(values))


def _spans(text: Column, pattern: str, kind: int, least: int, group: int = 0, keep: bool = False) -> Column:
    """array<struct<start,kind,end>> of the matches whose group has at least `least` characters; keep: with tok, the match."""

    def place(hits: Column) -> Column:
        sizes = F.transform(hits, lambda x: F.length(x))
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        ends = running(F.zip_with(sizes, F.slice(gaps, 1, F.size(hits)), lambda x, y: x + y), lambda x, y: x + y, 0)
        kept = F.transform(hits, lambda x: F.length(F.regexp_extract(x, pattern, group))) if group else sizes
        rows = F.filter(F.arrays_zip(ends.alias("end"), sizes.alias("size"), kept.alias("kept"), hits.alias("tok")), lambda x: x["kept"] >= least)
        return F.transform(rows, lambda x: F.struct((x["end"] - x["size"]).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), *([x["tok"].alias("tok")] if keep else [])))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def apart(runs: Column, base: Column) -> Column:
    """The runs (by start, not overlapping each other) that no base span overlaps. All are put in one order by start: a run
    is free if the greatest end of the base spans before it and the least start of those after it lie outside."""
    far = 2**31 - 1

    def judge(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: F.when(x["no"] < 0, x["end"]).otherwise(0)), lambda x, y: F.greatest(x, y), 0)
        starts = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(x["no"] < 0, x["start"]).otherwise(far))), lambda x, y: F.least(x, y), far))
        free = F.filter(F.arrays_zip(both.alias("x"), ends.alias("e"), starts.alias("s")), lambda y: (y["x"]["no"] >= 0) & (y["e"] <= y["x"]["start"]) & (y["s"] >= y["x"]["end"]))
        return F.transform(free, lambda y: F.element_at(runs, y["x"]["no"] + 1))

    mine = F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.lit(-1).alias("no"), x["end"].alias("end")))
    own = F.transform(runs, lambda x, i: F.struct(x["start"].alias("start"), i.cast("int").alias("no"), x["end"].alias("end")))
    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(_let(F.array_sort(F.concat(mine, own)), judge))


def with_base(own: DataFrame) -> DataFrame:
    """own: _text. Adds _long (it has a run of 20 token characters), _assign, _access, _hex."""
    own = own.withColumn("_long", F.col("_text").rlike("[A-Za-z0-9+/_-]{20}"))
    t = F.col("_text")
    assign = F.when(t.rlike(ASSIGN), _spans(t, ASSIGN, 0, ASSIGN_LEAST, 1)).otherwise(_none())
    # A maximal run of the class is what the greedy pattern takes, so asking for the length at once finds the same.
    access = F.when(F.col("_long") & t.contains("AKIA"), _spans(t, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}+", 1, ACCESS_LEAST)).otherwise(_none())
    hexes = F.when(F.col("_long"), _spans(t, f"[0-9a-f]{{{HEX_LEAST},}}+", 2, HEX_LEAST)).otherwise(_none())
    return own.withColumn("_assign", assign).withColumn("_access", access).withColumn("_hex", hexes)


def _tail(z: Column) -> Column:
    """A lower bound of -ln of the normal distribution's upper tail: for z > 0 the tail is at most exp(-z^2 / 2) times the
    lesser of 1/2 and 1 / (z sqrt(2 pi)); a p-value that is too large errs on the safe side. At z <= 0 it is taken as 1."""
    return F.when(z <= 0, F.lit(0.0)).otherwise(z * z / 2 + F.greatest(F.lit(math.log(2.0)), F.log(z * math.sqrt(2 * math.pi))))


def with_runs(own: DataFrame) -> DataFrame:
    """Adds _base (by start, then kind) and _runs, array<struct<start,end,stratum,bin,random,chi_z,runs_z,serial_z,text_z>>
    of the runs outside base spans."""
    own = own.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,tok:string>>")
    own = own.withColumn("_found", F.when(F.col("_long"), _spans(F.col("_text"), RUN, 3, 20, keep=True)).otherwise(none))
    own = own.withColumn("_free", apart(F.col("_found"), F.col("_base")))
    one = F.transform(
        "_free",
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["tok"].alias("tok"), F.length(x["tok"]).cast("double").alias("n"),
            F.transform(F.split(x["tok"], ""), lambda c: F.ascii(c).cast("double")).alias("codes"),
            F.when(x["tok"].rlike("^[0-9a-fA-F]+$"), 16.0).when(x["tok"].rlike("^[A-Z2-7]+=*$"), 32.0).otherwise(64.0).alias("k"),
            (F.regexp_count(x["tok"], F.lit("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[+/_=-])[^+/_=-]"))).cast("double").alias("changes"),
        ),
    )
    own = own.withColumn("_one", one)
    two = F.transform(
        "_one",
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n"), x["k"].alias("k"), x["changes"].alias("changes"), x["codes"].alias("codes"),
            (F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + c) / x["n"]).alias("mean"),
            F.aggregate(F.array_distinct(F.split(x["tok"], "")), F.lit(0.0), lambda a, c: a + F.pow(F.length(x["tok"]) - F.length(F.replace(x["tok"], c, F.lit(""))), F.lit(2.0))).alias("squares"),
        ),
    )
    own = own.withColumn("_two", two)
    three = F.transform(
        "_two",
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n"), x["k"].alias("k"), x["changes"].alias("changes"), x["squares"].alias("squares"),
            F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + F.pow(c - x["mean"], 2)).alias("spread"),
            F.aggregate(F.zip_with(F.slice(x["codes"], 1, F.size(x["codes"]) - 1), F.slice(x["codes"], 2, F.size(x["codes"]) - 1), lambda a, b: (a - x["mean"]) * (b - x["mean"])), F.lit(0.0), lambda a, c: a + c).alias("lagged"),
        ),
    )
    own = own.withColumn("_three", three)

    def judged(x):
        n, k = x["n"], x["k"]
        chi = k / n * x["squares"] - n
        chi_z = (chi - (k - 1)) / F.sqrt(2 * (k - 1))
        # Share of neighbours whose class differs if drawn at random: hex has digits and letters, the others three classes.
        rate = F.when(k == 16.0, 0.469).when(k == 32.0, 0.305).otherwise(0.645)
        runs_z = (x["changes"] - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate))
        serial_z = F.when(x["spread"] > 0, x["lagged"] / F.nullif(x["spread"], F.lit(0.0)) * F.sqrt(n)).otherwise(F.lit(99.0))
        random = (chi_z <= RANDOM_Z) & (F.abs(runs_z) <= RANDOM_Z) & (F.abs(serial_z) <= RANDOM_Z)
        coincidence = (x["squares"] - n) / (n * (n - 1))
        sd = F.sqrt(2 * SQUARES / (n * (n - 1)) + 4 * (CUBES - SQUARES * SQUARES) / n)
        text_z = ((SQUARES - coincidence) / sd + (x["changes"] - (n - 1) * CHANGES) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))) / math.sqrt(2.0)
        stratum = sum((F.when(n >= s, 1).otherwise(0) for s in STRATA[1:]), F.lit(0))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), stratum.alias("stratum"), F.least(F.lit(BINS), F.floor(10 * _tail(text_z))).cast("int").alias("bin"), random.alias("random"), chi_z.alias("chi_z"), runs_z.alias("runs_z"), serial_z.alias("serial_z"), text_z.alias("text_z"))

    return own.withColumn("_runs", F.transform("_three", judged)).drop("_found", "_free", "_one", "_two", "_three")


def thresholds(tested: DataFrame, fdr: float = FDR) -> list[int]:
    """For each stratum of length, the least bin that Benjamini-Hochberg accepts over all runs (column _runs)."""
    runs = tested.select(F.explode("_runs").alias("r"))
    counts = runs.groupBy("r.stratum", "r.bin").agg(F.count(F.lit(1)).alias("k")).collect()  # at most strata times bins
    return [accepted({r["bin"]: r["k"] for r in counts if r["stratum"] == s}, fdr) for s in range(len(STRATA))]


def accepted(counts: dict[int, int], fdr: float) -> int:
    """The least bin b whose p-value exp(-b / 10) is at most fdr times the share of tests in bins from b on."""
    total, above, least = sum(counts.values()), 0, BINS + 1
    for b in sorted(counts, reverse=True):
        above += counts[b]
        if total * math.exp(-b / 10) <= fdr * above:
            least = b
    return least


def find(docs: DataFrame, text: str = "text", fdr: float = FDR, keep: list[str] | None = None) -> DataFrame:
    """_row: a struct of the columns named in keep (default all); _assign, _access, _hex, _base and _spans:
    array<struct<start,kind,end>>, the last two by start, then kind. A row for each of docs."""
    own = docs.select(F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("_row"), text_of(docs, text).alias("_text"))
    tested = written(with_runs(with_base(own)).select("_row", "_assign", "_access", "_hex", "_base", "_runs"), "runs")
    limit = F.array(*[F.lit(x) for x in thresholds(tested, fdr)])
    good = F.filter("_runs", lambda r: r["random"] & (r["bin"] >= F.element_at(limit, r["stratum"] + 1)))
    added = F.transform(good, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return tested.withColumn("_spans", F.array_sort(F.concat("_base", added)))


def joined(spans: str) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = MARK) -> DataFrame:
    """docs with every span replaced by mark (spans that overlap, by one); other texts stay as they are, nulls too."""
    names = docs.columns
    own = find(docs, text)
    # A span's piece is what lies between it and the farthest end before it, and the mark if it does not overlap that.
    ends = F.transform("_spans", lambda x: x["end"])
    own = own.withColumn("_ends", running(ends, lambda x, y: F.greatest(x, y), 0)).withColumn("_text", F.coalesce(F.col("_row")[text].cast("string"), F.lit("")))
    own = own.withColumn("_gaps", F.zip_with(before(F.col("_ends"), 0), "_spans", lambda at, x: F.struct(at.alias("at"), F.greatest(x["start"] - at, F.lit(0)).alias("size"), (x["start"] >= at).alias("fresh"))))
    last = F.element_at("_ends", -1)
    joined_up = lambda part, tail: F.concat(F.array_join(F.transform("_gaps", lambda g: F.concat(part(g), F.when(g["fresh"], F.lit(mark)).otherwise(""))), ""), tail)
    few = joined_up(lambda g: F.substring(F.col("_text"), g["at"] + 1, g["size"]), F.substring(F.col("_text"), last + 1, F.length("_text")))
    many = _let(F.split(F.col("_text"), ""), lambda c: joined_up(lambda g: F.array_join(F.slice(c, g["at"] + 1, g["size"]), ""), F.array_join(F.slice(c, last + 1, F.size(c)), "")))
    clean = F.when(F.size("_spans") == 0, F.col("_row")[text]).when(F.size("_spans") < MANY_SPANS, few).otherwise(many)
    return own.select(*[clean.alias(c) if c == text else F.col("_row")[c].alias(c) for c in names])


def op9(docs: DataFrame) -> DataFrame:
    own = find(docs, keep=["doc_id"])
    size = lambda c: F.size(c).cast("long")
    return own.select(
        "_row.doc_id", size("_assign").alias("n_assign"), size("_access").alias("n_access"), size("_hex").alias("n_hex"),
        F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_spans").alias("spans"),
    )
