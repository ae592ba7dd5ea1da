"""Operator 6, URL filters: a blocked Bloom filter of listed canonical keys, then an exact hash join.

A rule is (host, path prefix, verdict). A URL is judged by the longest rule whose host it has, or is a subdomain of,
and whose path prefix its path starts with. Every (host suffix, path prefix) of a URL whose number of labels and length
of prefix occur in the list is a key, so their number follows the list and not the URL; keys that the filter passes are
joined with the list itself, so false positives drop out. Rows meet their rule again by host and path, not by a number.

The filter holds `bits_per_key` bits for each listed key in blocks of 64 bits: all probes of a key fall into one
word. It travels to the workers only up to MAX_FILTER_BYTES; a larger list is joined without it.

Null URLs and those without `://` have empty host and path and match no rule. Very long URLs, and hosts of very many
labels, are judged whole, in time proportional to their length. Repeated rows give repeated results, an empty table none.
An empty list lets everything through with the default verdict. Extra columns are carried by judge(), but for those named
like results, which are replaced; the query ignores them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
PROBES = 4
MAX_FILTER_BYTES = 64 << 20
SEP = "\u0001"


def parts(url):
    """(host, path) of a URL column: host lower-cased in A-Z, both empty without `://`."""
    rest = F.coalesce(F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def key_hash(key):
    return F.xxhash64(F.lit(6), key)


def words_and_masks(h: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each hash and the bits it sets there, all from one 64-bit hash."""
    h = h.astype(np.uint64)
    word = ((h >> np.uint64(32)) % np.uint64(n_words)).astype(np.int64)
    mask = np.zeros(len(h), dtype=np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return word, mask


def build_filter(hashes: DataFrame, n_keys: int) -> np.ndarray | None:
    """The filter's words, or None where they would pass MAX_FILTER_BYTES. Each task makes (word, mask) pairs, masks of
    a word are or-ed before and after the shuffle; what reaches the driver is bounded by the filter's own size."""
    n_words = max(8, -(-n_keys * BITS_PER_KEY // 64))
    if n_words * 8 > MAX_FILTER_BYTES:
        return None
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 6 * i).bitwiseAND(63).cast("int"))
    mask = bit(0)
    for i in range(1, PROBES):
        mask = mask.bitwiseOR(bit(i))
    got = hashes.select((F.shiftrightunsigned("h", 32) % n_words).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words = np.zeros(n_words, dtype=np.uint64)
    words[got["word"].to_numpy(dtype=np.int64)] = got["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return words


def may_contain(words: np.ndarray):
    @F.pandas_udf("array<boolean>")
    def probe(hashes: pd.Series) -> pd.Series:
        sizes = [len(x) for x in hashes]
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in hashes]) if sum(sizes) else np.zeros(0, dtype=np.int64)
        word, mask = words_and_masks(flat.view(np.uint64), len(words))
        hit = (words[word] & mask) == mask
        return pd.Series(np.split(hit, np.cumsum(sizes)[:-1])) if sizes else pd.Series([], dtype=object)

    return probe


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """All columns of urls plus host, path, rule, verdict. rules: host string, path string, verdict string; of equal
    (host, path) with different verdicts `block` holds."""
    listed = rules.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("verdict"))
    listed = listed.select(
        F.concat_ws(SEP, "host", "path").alias("key"), F.concat("host", "path").alias("rule"), F.length(F.concat("host", "path")).alias("rule_length"),
        F.length("path").alias("path_length"), F.size(F.split("host", r"\.", -1)).alias("labels"), "verdict",
    )
    shapes = [tuple(r) for r in listed.select("labels", "path_length").distinct().orderBy("labels", "path_length").collect()]  # at most a rule's labels times its length
    n_keys = listed.count()
    words = build_filter(listed.select(key_hash(F.col("key")).alias("h")), n_keys) if n_keys else np.zeros(8, dtype=np.uint64)

    host, path = parts(F.col(url))
    clash = [c for c in ("host", "path", "rule", "verdict") if c in urls.columns]
    own = urls.drop(*clash).withColumn("host", host).withColumn("path", path)
    # substring_index gives the whole host where it has too few labels: these keys are another number of labels' then.
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    key = lambda labels, n: F.when((dots + 1 >= labels) & (F.length("path") >= n), F.concat_ws(SEP, F.substring_index("host", ".", -labels), F.substring("path", 1, n)))
    keys = F.array_compact(F.array(*[key(*x) for x in shapes])) if shapes else F.array().cast("array<string>")
    own = own.withColumn("_keys", keys)
    if words is None:
        hits = F.col("_keys")
    else:
        probed = may_contain(words)(F.transform("_keys", lambda k: key_hash(k)))
        own = own.withColumn("_may", probed)
        hits = F.transform(F.filter(F.arrays_zip("_keys", "_may"), lambda x: x["_may"]), lambda x: x["_keys"])
    own = own.withColumn("_hits", hits).drop("_keys", "_may")
    # The exact step: only keys that passed move, once for each host and path. The key of the way back is made anew, so
    # that both sides of that join are shuffled and a hot URL's rows can be split.
    found = own.where(F.size("_hits") > 0).select("host", "path", F.explode("_hits").alias("key")).distinct().join(listed.drop("path_length", "labels"), "key")
    best = found.groupBy("host", "path").agg(F.max(F.struct("rule_length", "rule", "verdict")).alias("_best"))
    best = best.select(F.concat(F.lit(SEP), "host", F.lit(SEP), "path").alias("_at"), "_best")
    own = own.withColumn("_at", F.concat(F.lit(SEP), "host", F.lit(SEP), "path")).join(best, "_at", "left")
    return own.select(*[c for c in urls.columns if c not in clash], "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query, in the order given.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    END AS rule
  FROM split
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
