"""Operator 8, near-duplicate documents by MinHash with tensored banding, and exact verification.

Two collections of m short bands are made from 2 * m * ROWS minhash values. Each pair of a band of the first and one of
the second is the key of a table, so there are m * m tables for the cost of 2 * m bands: about the square root of the
hashing that separate tables would need. m is the least with which a pair at the threshold is missed with probability
MISS at most; pairs above it are missed far more rarely. One byte of each minhash value is kept as a sketch: of two sets
at the threshold fewer than `least_matches` bytes agree with probability SKETCH_MISS at most.

1. Rows with equal shingle sets (128-bit digests of the whole sorted sets) are one class, a node with a number of its own.
2. In each table's bucket every class is paired with the least one. Distinct pairs that size and sketch admit are
   verified on whole sets, which only they fetch.
3. Verified links give components. A bucket whose classes are all in one component is done.
4. In the other buckets each class outside the bucket's largest component is held against all classes of other
   components, in bounded blocks. Blocks hold sizes and sketches first; only classes with a partner that these admit
   fetch their sets, and meet again in the same blocks. Only links found leave a block, so no list of all pairs is made.
   Buckets with the same largest component are done together.
5. Links of step 4 join components.

No bucket is capped or sampled: whatever shares a table key and is not in the same component anyhow is compared.

Null and empty texts, and those of white space only, have empty sets and are linked with nothing; they are kept. Rows
are judged by their text, each by itself: rows that repeat an id with other texts may lie in other components. A
component's name is the smallest id in it; the row kept is the one with that id, the first such if the id is repeated.
Rows with a null id are never linked; their component is null and they are kept. Very long texts are read whole; blocks
have fewer classes the longer these are. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import sized, slices, text_of, written
from quantloom.llm.components import components, spread_join

#: Minhash values in a band of either collection.
ROWS = 2
MISS, SKETCH_MISS = 1e-4, 1e-6
#: Classes of a block, and hashes of all sets of a block's side.
BLOCK_U, BLOCK_V, BLOCK_HASHES = 192, 384, 2_000_000
#: Rows of blocks for which there is one task.
TASK_ROWS = 8192
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands a collection needs, so that a pair of this similarity shares one of either with probability 1 - miss."""
    same = (percent / 100) ** rows
    m = 1
    while 1 - (1 - (1 - same) ** m) ** 2 > miss:
        m += 1
    return m


def least_matches(percent: int, values: int, miss: float = SKETCH_MISS) -> int:
    """The most c for which fewer than c of the values agree with probability `miss` at most, at this similarity."""
    p, below = percent / 100, 0.0
    for c in range(values + 1):
        below += math.comb(values, c) * p**c * (1 - p) ** (values - c)
        if below > miss:
            return c
    return values


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()  # bytes split on just the six white space characters
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    own = min(width, n)
    acc = np.full(n - own + 1, own, dtype=np.uint64)
    for k in range(own):
        acc = mix(acc + np.uint64(0x9E3779B97F4A7C15) + w[k : n - own + 1 + k])
    return np.unique(acc)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:count, None], seeds[count:, None] | np.uint64(1)


def least_values(own: np.ndarray, m: int, rows: int = ROWS) -> np.ndarray:
    """The 2 * m * rows minhash values of a set that is not empty."""
    flip, odd = _functions(2 * m * rows)
    least = np.full(len(flip), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(own), 65_536):
        part = own[None, at : at + 65_536]
        least = np.minimum(least, ((part ^ flip) * odd).min(axis=1))
    return least


def table_keys(least: np.ndarray, m: int, rows: int = ROWS) -> np.ndarray:
    """The m * m table keys of a set with these minhash values."""
    least = least.reshape(2, m, rows)
    band = np.zeros((2, m), dtype=np.uint64)
    for r in range(rows):
        band = mix(band * np.uint64(31) + least[:, :, r] + np.uint64(r + 1))
    salt = np.arange(m * m, dtype=np.uint64).reshape(m, m)
    return mix(mix(band[0][:, None] + salt) ^ band[1][None, :]).ravel()


def lanes_for(m: int, rows: int = ROWS) -> int:
    """64-bit numbers that hold a byte of each minhash value."""
    return -(-2 * m * rows // 8)


def sketch(least: np.ndarray, lanes: int) -> np.ndarray:
    """A byte of each minhash value, eight to a number; what is left over is 0 in every sketch."""
    out = np.zeros(8 * lanes, dtype=np.uint8)
    out[: len(least)] = (mix(least) & np.uint64(255)).astype(np.uint8)
    return out.view(np.int64)


def matches(lanes: int, one: str, two: str) -> Column:
    """How many bytes of the sketches in columns one0, one1, ... and two0, two1, ... agree."""
    unequal = F.lit(0)
    for i in range(lanes):
        z = F.col(f"{one}{i}").bitwiseXOR(F.col(f"{two}{i}"))
        for s in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, s))
        unequal = unequal + F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(8 * lanes) - unequal


def digest(own: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64)


def _signatures(rows: DataFrame, width: int, m: int) -> DataFrame:
    """rows: doc_id, row, text. doc_id, row, n, f1, f2 (digest of the set), keys, s0, s1, ... (sketch)."""
    lanes = lanes_for(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, blank = np.zeros(0, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        for batch in slices(batches):
            sizes, digests, keys, marks = [], [], [], []
            for t in batch.column("text").to_pylist():
                own = shingles(t, width)
                sizes.append(len(own))
                digests.append(digest(own))
                least = least_values(own, m) if len(own) else None
                keys.append(none if least is None else table_keys(least, m).view(np.int64))
                marks.append(blank if least is None else sketch(least, lanes))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
            digests, marks = np.array(digests).reshape(-1, 2), np.array(marks).reshape(-1, lanes)
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([none, *keys])))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(marks[:, i]) for i in range(lanes))], names=["doc_id", "row", "n", "f1", "f2", "keys", *(f"s{i}" for i in range(lanes))])

    return rows.mapInArrow(run, "doc_id long, row long, n long, f1 long, f2 long, keys array<long>, " + ", ".join(f"s{i} long" for i in range(lanes)))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, set (sorted hashes), a row for each of wanted (node, doc_id, f1, f2). An id with several texts gives the one
    of the class; rows that repeat id and text meet before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, sets = [], []
            for t, node, f1, f2 in zip(*(batch.column(c).to_pylist() for c in ("text", "node", "f1", "f2"))):
                own = shingles(t, width)
                if tuple(digest(own).tolist()) == (f1, f2):
                    nodes.append(node)
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    own = wanted.select("node", F.col("doc_id").alias("_id"), "f1", "f2")
    rows = docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("_id")).select("text", "node", "f1", "f2")
    return rows.mapInArrow(run, "node long, set array<long>").groupBy("node").agg(F.first("set").alias("set"))


def linked(inter, one, two, percent: int):
    return 100 * inter >= percent * (one + two - inter)


def block_survivors(frame: pd.DataFrame, percent: int, need: int, lanes: int) -> pd.DataFrame:
    """Of a block's rows those with a partner of the other role and of another component that size and sketch admit."""
    side = frame["u"].to_numpy(dtype=bool)
    us, vs = frame[side], frame[~side]
    names = [f"s{i}" for i in range(lanes)]
    bytes_of = lambda f: np.ascontiguousarray(f[names].to_numpy(dtype=np.int64)).view(np.uint8)
    one, two = bytes_of(us), np.ascontiguousarray(bytes_of(vs).T)
    same = np.zeros((len(us), len(vs)), dtype=np.uint16)
    for k in range(8 * lanes):
        same += one[:, k, None] == two[k][None, :]
    a, b = us["n"].to_numpy()[:, None], vs["n"].to_numpy()[None, :]
    good = (same >= need) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (us["component"].to_numpy()[:, None] != vs["component"].to_numpy()[None, :])
    out = pd.concat([us[good.any(axis=1)], vs[good.any(axis=0)]])
    return out[["task", "main", "ub", "vb", "u", "node", "component"]]


def block_links(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between rows with role u and rows of other components; for each u and component, its least neighbour."""
    us, vs = frame[frame["u"]], frame[~frame["u"]]
    out: list[tuple[int, int]] = []
    if len(us) and len(vs):
        sets = [np.asarray(s, dtype=np.int64) for s in vs["set"]]
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        rows = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, rows = flat[order], rows[order]
        comp, ids = vs["component"].to_numpy(), vs["node"].to_numpy()
        for uid, ucomp, uset in zip(us["node"], us["component"], us["set"]):
            uset = np.asarray(uset, dtype=np.int64)
            lo, hi = np.searchsorted(flat, uset, "left"), np.searchsorted(flat, uset, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            inter = np.bincount(rows[at], minlength=len(sets))
            good = np.flatnonzero(linked(inter, len(uset), sizes, percent) & (comp != ucomp))
            if len(good):
                good = good[np.argsort(ids[good], kind="stable")]
                _, first = np.unique(comp[good], return_index=True)
                out += [(int(uid), int(v)) for v in ids[good[first]]]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def even_keys(spark: SparkSession, tasks: int) -> list[int]:
    """For each of so many shuffle partitions a number that repartition() puts into it."""
    own = spark.range(0, 64 * tasks, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("p")).agg(F.min("id").alias("id"))
    found = {r["p"]: r["id"] for r in own.collect()}  # a row for each partition
    return [found.get(p, p) for p in range(tasks)]


def _rest(members: DataFrame, comps: DataFrame, marks: DataFrame, fetch, percent: int, need: int, lanes: int, like: DataFrame) -> DataFrame:
    """Links between components within buckets, beyond those to the bucket's least member.

    Buckets with the same largest component are taken together: a class that lies in many of them is compared once, not
    once for each bucket. Of two classes of different components at least one is outside the largest, so holding those
    outside against all members leaves out no pair of any bucket. fetch gives the sets of some nodes."""
    own = spread_join(members.where("size > 2").select("key", "node"), comps.withColumnRenamed("id", "node"), "node", "left")
    own = written(own.withColumn("component", F.coalesce("component", "node")), "placed", like)
    by = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    main = by.groupBy("key").agg(F.max(F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = spread_join(own, main.select("key", F.col("main.component").alias("main")), "key").select("main", "node", "component").distinct()
    bundles = written(spread_join(rows, marks, "node"), "bundles", like)
    outside = F.col("component") != F.col("main")
    sides = bundles.groupBy("main").agg(F.count(F.lit(1)).alias("nv"), F.count_if(outside).alias("nu"), F.sum("n").alias("hv"), F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("hu"))
    blocks = lambda count, hashes, most: F.ceil(F.greatest(F.col(count) / most, F.col(hashes) / BLOCK_HASHES)).cast("int")
    sides = sides.select("main", "nu", "nv", blocks("nu", "hu", BLOCK_U).alias("ublocks"), blocks("nv", "hv", BLOCK_V).alias("vblocks"))
    work = sides.agg(F.sum(F.col("nu") * F.col("vblocks") + F.col("nv") * F.col("ublocks"))).first()[0] or 0
    conf = bundles.sparkSession.conf.get("spark.sql.shuffle.partitions")
    tasks = max(2 * bundles.sparkSession.sparkContext.defaultParallelism, int(conf), -(-work // TASK_ROWS))
    rows = spread_join(bundles, sides.drop("nu", "nv"), "main")
    other = rows.where(outside).withColumn("u", F.lit(True)).withColumn("ub", F.pmod(F.xxhash64("node"), "ublocks").cast("int"))
    other = other.withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vblocks") - 1)))
    every = rows.withColumn("u", F.lit(False)).withColumn("vb", F.pmod(F.xxhash64("node"), "vblocks").cast("int"))
    every = every.withColumn("ub", F.explode(F.sequence(F.lit(0), F.col("ublocks") - 1)))
    # Blocks of one bundle get consecutive tasks: few do not meet by chance, and rows that are small but take long to
    # compare are not put together.
    keys = even_keys(bundles.sparkSession, tasks)
    place = F.pmod(F.xxhash64("main") + F.col("ub").cast("long") * F.col("vblocks") + F.col("vb"), F.lit(tasks))
    full = [F.element_at(F.lit(keys), place.cast("int") + 1).alias("task"), "main", "ub", "vb", "u", "node", "component", "n", *(f"s{i}" for i in range(lanes))]
    block = ["task", "main", "ub", "vb"]
    dealt = other.select(*full).unionByName(every.select(*full)).repartition(tasks, "task")
    schema = "task long, main long, ub int, vb int, u boolean, node long, component long"
    left = written(dealt.groupBy(*block).applyInPandas(lambda f: block_survivors(f, percent, need, lanes), schema), "survivors")
    sets = fetch(left.select("node").distinct())
    whole = spread_join(left, sets, "node").repartition(tasks, "task")
    found = whole.groupBy(*block).applyInPandas(lambda f: block_links(f, percent), "a long, b long")
    return written(found.distinct(), "across", like)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept: one row for each row of docs. row: a column of docs, long, that tells rows
    of one id apart; else any numbers."""
    m = bands_for(percent)
    lanes = lanes_for(m)
    need = least_matches(percent, 2 * m * ROWS) + 8 * lanes - 2 * m * ROWS  # what is left over agrees always
    number = docs[row].cast("long") if row else F.monotonically_increasing_id()
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), number.alias("row"), text_of(docs, text).alias("text"))
    signed = written(_signatures(texts, width, m), "signatures")
    marks = ["n", *(f"s{i}" for i in range(lanes))]
    digests = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2")
    classes = digests.agg(F.min(F.struct("doc_id", "row", "keys", *marks[1:])).alias("least")).select("n", "f1", "f2", "least.*").withColumn("node", F.monotonically_increasing_id())
    classes = written(classes, "classes", signed)

    rows = classes.select("node", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(spread_join(rows, buckets, "key"), "members", signed)
    pairs = members.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = spread_join(pairs, classes.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}{c}") for c in marks)), side)
    alike = (100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")) & (matches(lanes, "as", "bs") >= need)
    pairs = written(pairs.where(alike).select("a", "b"), "pairs", signed)

    known = classes.select("node", "doc_id", "f1", "f2")
    fetch = lambda nodes: written(_sets(texts, spread_join(nodes, known, "node"), width), "sets", signed)
    sets = fetch(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    one = spread_join(pairs.withColumnRenamed("a", "node"), sets, "node").withColumnsRenamed({"node": "a", "set": "one", "b": "node"})
    two = spread_join(one, sets, "node")
    inter = F.size(F.array_intersect("one", "set"))
    links = two.where(linked(inter, F.size("one"), F.size("set"), percent)).select("a", F.col("node").alias("b"))
    comps = components(links, signed)

    across = _rest(members, comps, classes.select("node", *marks), fetch, percent, need, lanes, signed)
    if not across.isEmpty():
        name = lambda side: comps.select(F.col("id").alias(side), F.col("component").alias(f"{side}c"))
        ends = across.join(name("a"), "a", "left").join(name("b"), "b", "left")
        joined = components(ends.select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b")), signed)
        every = comps.unionByName(across.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comps, "id", "left_anti").select("id", F.col("id").alias("component")))
        comps = written(_renamed(every, joined), "components", signed)

    # From classes to rows: a component is named after the least id in it, and keeps the first row with that id.
    named = spread_join(classes.select("n", "f1", "f2", "node", "doc_id", "row"), comps.withColumnRenamed("id", "node"), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    best = named.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("best")).select("component", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("first"))
    named = spread_join(named, best, "component").select((F.col("f1").bitwiseXOR(F.lit(1))).alias("g1"), "f2", "n", "component_id", "first")
    out = signed.select("doc_id", "row", "n", (F.col("f1").bitwiseXOR(F.lit(1))).alias("g1"), "f2").join(named, ["g1", "f2", "n"], "left")
    judged = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component, kept = F.when(judged, F.col("component_id")).otherwise(F.col("doc_id")), ~judged | ((F.col("doc_id") == F.col("component_id")) & (F.col("row") == F.col("first")))
    out = out.select("doc_id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
    return sized(out, signed)


def _renamed(every: DataFrame, joined: DataFrame) -> DataFrame:
    """every (id, component) with each component replaced by the one it was joined to."""
    to = joined.select(F.col("id").alias("component"), F.col("component").alias("new"))
    return spread_join(every, to, "component", "left").select("id", F.coalesce("new", "component").alias("component"))


def op8(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs.select("doc_id", "text"), width=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), "kept").alias("kept"))


#: The query's rows by an exact join of all shingles and a closure over the links.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.seen
), c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
