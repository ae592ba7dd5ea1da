"""Operator 5, best-fit packing by length patterns and non-negative least squares.

Pieces are counted by length, which is all the driver sees: at most `capacity` counts. Patterns of two or three lengths
that fill a sequence (nearly) are enumerated; non-negative least squares (accelerated projected gradient) fits how often
to repeat each so that the patterns use up the histogram; repeats are rounded within what is there; what remains is
packed best-fit decreasing, on counts. The plan is a table of ranges: of the pieces with some length, those ranked r to
s go to sequences q, q+1, ... at some offset. Its size depends on the capacity, not on the documents.

Pieces are numbered as they are written. Ranks among pieces of one length are taken within buckets of these numbers, of
at most some RANK_ROWS rows, and moved by the counts of the buckets before, so a length that a third of all rows share, or
a row that is repeated as often, is ranked by many tasks. Pieces that fill a sequence alone are never ranked or moved.

Ids are those of the tokenizers library, file byte_bpe_50k.json; a worker asks it once for each distinct pre-token (see
tokens.WordIds).

A null text reads as empty and is the end token alone. Very long texts are read whole, one at a time. Repeated rows are
packed as often as they occur. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import slices, text_of, written
from quantloom.llm.tokens import DEFAULT_JSON, word_ids

CAPACITY = 1024
END = 2
LEAST_BUCKETS, RANK_ROWS = 64, 200_000
#: Rounds of the least squares fit; tokens a pattern may leave free, and their price in the fit.
ROUNDS, WASTE, PRICE = 400, 16, 2.0


def token_ids(text: str) -> list[int]:
    """The ids of one text."""
    return np.frombuffer(word_ids(public_tokenizers.path(DEFAULT_JSON)).encode([text])[0], dtype="<u4").tolist()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole ones of the capacity, the first may be shorter."""
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [(s, (starts + [n])[i + 1] - s) for i, s in enumerate(starts)]


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, nr (a number of the row); written to the shared folder, as it is used
    several times."""
    path = public_tokenizers.path(DEFAULT_JSON)
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            coded = word_ids(path).encode(batch.column("text").to_pylist())
            rows = []
            for i, ids in zip(batch.column("doc_id").to_pylist(), coded):
                ids += end
                view = memoryview(ids)
                rows += [(i, k, s, n, zlib.crc32(view[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    own = own.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return written(own.withColumn("nr", F.monotonically_increasing_id()), "pieces")


def patterns(counts: np.ndarray, capacity: int, waste: int | None = None) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c of lengths that occur, 0 for none, that leave at most `waste` tokens free; c is the
    longest that still fits. Lengths that no such row holds (short ones only, say) are left to the packing of the rest."""
    have = np.flatnonzero(counts[:capacity] > 0)
    have = have[have > 0]
    if not len(have):
        return np.zeros((0, 3), dtype=np.int64)
    longest = np.zeros(capacity + 1, dtype=np.int64)  # the longest length that occurs and is at most the index
    longest[have] = have
    longest = np.maximum.accumulate(longest)
    a, b = np.meshgrid(have, have, indexing="ij")
    ok = (b <= a) & (a + b <= capacity)
    a, b = a[ok], b[ok]
    c = longest[np.minimum(b, capacity - a - b)]
    two = longest[np.minimum(have, capacity - have)]
    table = np.concatenate([np.stack([a, b, c], axis=1), np.stack([have, two, np.zeros_like(have)], axis=1)])
    free = capacity - table.sum(axis=1)
    good = free <= (WASTE if waste is None else waste)
    return np.unique(table[good], axis=0)


def fit_repeats(counts: np.ndarray, table: np.ndarray, capacity: int, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative x that nearly minimises the squared relative gaps between counts and what the patterns use, with a
    price on what a pattern leaves free."""
    size = len(counts)
    if not len(table):
        return np.zeros(0)
    flat = table.ravel()
    used = lambda x: np.bincount(flat, weights=np.repeat(x, 3), minlength=size)
    weight = 1.0 / (counts + 1.0)
    weight[0] = 0.0
    back = lambda v: v[table].sum(axis=1)
    price = PRICE * (capacity - table.sum(axis=1)) / capacity
    probe = np.ones(len(table))
    norm = 1.0
    for _ in range(12):  # largest singular value, by power iteration
        probe = back(weight * used(probe))
        norm = np.linalg.norm(probe)
        if not norm:
            return np.zeros(len(table))
        probe /= norm
    x = y = np.zeros(len(table))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - (back(weight * (used(y) - counts)) + price) / (1.05 * norm))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Ranges (length, first rank, pieces, first sequence, offset), and the number of sequences used. Lengths equal to
    the capacity need no plan and are left out."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if 0 < length < capacity:
            left[length] = n
    rank = np.zeros(capacity + 1, dtype=np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, int(rank[length]), n, first, offset))
        rank[length] += n
        left[length] -= n

    table = patterns(left, capacity)
    repeats = fit_repeats(left.astype(float), table, capacity)
    for rounded in (np.floor(repeats), np.ceil(repeats - 0.02)):
        for i in np.argsort(-repeats, kind="stable"):
            want = int(rounded[i])
            if want <= 0:
                if repeats[i] <= 0.02:
                    break
                continue
            lengths, need = np.unique(table[i][table[i] > 0], return_counts=True)
            n = min(want, int((left[lengths] // need).min()))
            if n > 0:
                offset = 0
                for length in table[i][table[i] > 0]:
                    place(int(length), n, sequences, offset)
                    offset += int(length)
                sequences += n
        repeats = np.maximum(0.0, repeats - np.floor(repeats))
    # The rest, longest first, each to the fullest sequence that still takes it; runs of alike sequences move together.
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity - 1, 0, -1):
        space = length
        while left[length]:
            while space <= capacity and not room[space]:
                space += 1
            if space <= capacity:
                first, n = room[space].pop()
            else:
                # New sequences take as many of this length as fit, best-fit decreasing does the same one by one.
                first, n, space = sequences, int(-(-left[length] // (capacity // length))), capacity
                sequences += n
            take = min(n, int(left[length]))
            if take < n:
                room[space].append((first + take, n - take))
            place(length, take, first, capacity - space)
            room[space - length].append((first, take))
            space = length
    return np.array(out, dtype=np.int64).reshape(-1, 5), sequences


def assign(own: DataFrame, ranges: np.ndarray, capacity: int, total: int) -> DataFrame:
    """Adds sequence_id and offset to pieces. Pieces that fill a sequence get negative numbers of their own."""
    full = own.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("nr")).withColumn("offset", F.lit(0).cast("long"))
    buckets = max(LEAST_BUCKETS, -(-total // RANK_ROWS))
    rest = own.where(F.col("length") < capacity).withColumn("_bucket", F.pmod(F.xxhash64("nr"), F.lit(buckets)))
    sizes = rest.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("nr")
    rest = rest.withColumn("_rank", F.row_number().over(inside) - 1).join(sizes, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    if len(ranges):
        ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    keys = (ranges[:, 0] << 44) + ranges[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy() << 44) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": ranges[at, 3] + rank.to_numpy() - ranges[at, 1], "offset": ranges[at, 4]})

    rest = rest.withColumn("_to", look_up("length", "_rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rest = rest.withColumn("sequence_id", F.col("_to.sequence_id")).withColumn("offset", F.col("_to.offset"))
    return full.select(*names).unionByName(rest.select(*names))


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    own = pieces(docs, text, doc_id, capacity)
    histogram = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    ranges, _ = plan(histogram, capacity)
    return assign(own, ranges, capacity, sum(histogram.values()))


def op5(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text"))
