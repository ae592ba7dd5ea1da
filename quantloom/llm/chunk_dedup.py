"""Operator 3, exact deduplication by content-defined chunk recipes; DataFrame functions only.

The text, without white space, is cut where its own content says: after a character pair of a fixed rule, with a least
and a greatest chunk length. A chunk's identifier is a pair of 64-bit hashes with different seeds. Distinct chunks are
shuffled once, and verified: an identifier that two different chunks share gets a number for each content. A document
is then its ordered list of verified identifiers, some 16 bytes for each few hundred characters, and documents are
equal exactly if the lists are. Long texts themselves never move again.

Grouping on lists is pre-aggregated before the shuffle, so a group with a third of all rows costs one row for each
task; its members are joined back to the group by a join whose both sides are shuffled, which Spark splits on skew.

Null texts count as empty; all empty texts (also those of white space only) are equal to each other. Of equal texts
the longest original stays, ties to the smallest doc_id (a null doc_id last). Rows that repeat a whole row form one
group, and one of them (the first by the number that rows get as they are written) is kept. Very long texts are chunked
whole; a recipe has some 16 bytes for each few hundred characters. An empty table gives no rows. Extra columns are
carried, except those named like results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import text_of, written

#: Least and greatest characters of a chunk.
LEAST, MOST = 256, 4096
#: A chunk ends after one of these characters followed by one of those; a pair rule that text of most scripts meets
#: about once in a few hundred characters. Texts that never meet it are cut at MOST, which is as right, if less shared.
FIRST, SECOND = "a-dA-D0-3.,\\u00e0-\\u00e7\\u0430-\\u0437\\u4e00-\\u5fff", "m-oM-O4-6\\u00f0-\\u00f6\\u043d-\\u0442\\u6000-\\u6fff"


def normalised(text: Column) -> Column:
    """Without the characters of [\\x20\\x09-\\x0D]; plain replaces run on bytes, much faster than a pattern."""
    for c in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Content-defined chunks, in order; their concatenation is the text."""
    pattern = f"(?s).{{{least},{most}}}?(?<=[{FIRST}][{SECOND}])|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def identifier(chunk: Column, number: Column | None = None) -> Column:
    first, second = F.xxhash64(F.lit(31), chunk), F.xxhash64(F.lit(37), chunk)
    return F.struct(first.alias("a"), second.alias("b"), (F.lit(0) if number is None else number).cast("int").alias("n"))


def _shared_identifiers(cut: DataFrame) -> DataFrame:
    """(a, b, chunk, n) of chunks that share both hashes with another content: in practice none, but proven so."""
    each = cut.select(F.explode("_chunks").alias("chunk")).select(identifier(F.col("chunk")).alias("i"), "chunk")
    distinct = each.select("i.a", "i.b", "chunk").distinct()
    # distinct() above puts equal (a, b, chunk) together after a map-side pass; only hashes go on from here.
    doubled = distinct.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("a", "b")
    return doubled


def recipes(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' rows with _recipe: the ordered verified identifiers of their chunks; n_cp, code points of the original;
    text_sha256 of the normalised text; _row, a number of the row. Written to the shared folder, without texts."""
    keep = [c for c in docs.columns if c not in (text, "_recipe", "_n_cp", "text_sha256", "_row", "_text")]
    base = docs.select(*[docs[c] for c in keep], text_of(docs, text).alias("_text"))
    norm = base.withColumn("_n_cp", F.length("_text").cast("long")).withColumn("_text", normalised(F.col("_text")))
    cut = norm.withColumn("_chunks", chunks(F.col("_text")))
    doubled = written(_shared_identifiers(cut), "doubled")
    listed = F.transform("_chunks", lambda c: identifier(c))
    if not doubled.isEmpty():
        # Rare: number the contents of each doubled identifier, and give the documents that hold one these numbers. The rows
        # are written with numbers of their own first, as these have to be the same in both looks at them.
        ids = identifier(F.col("chunk"))
        cut = written(cut.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        every = cut.select("_row", F.posexplode("_chunks").alias("pos", "chunk"))
        held = every.withColumn("i", ids).select("_row", "pos", "chunk", "i.a", "i.b").join(doubled, ["a", "b"], "left_semi")
        contents = held.select("a", "b", "chunk").distinct()
        lower = contents.alias("x").join(contents.alias("y"), ["a", "b"]).where("y.chunk <= x.chunk").groupBy("a", "b", "x.chunk").agg(F.count(F.lit(1)).cast("int").alias("n"))
        numbers = held.join(lower, ["a", "b", "chunk"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("_numbers"))
        cut = cut.join(written(numbers, "numbers"), "_row", "left").drop("_row")
        listed = F.transform("_chunks", lambda c, p: identifier(c, F.coalesce(F.try_element_at("_numbers", p), F.lit(0))))
    out = cut.select(*keep, "_n_cp", F.sha2(F.col("_text"), 256).alias("text_sha256"), listed.alias("_recipe")).withColumn("_row", F.monotonically_increasing_id())
    return written(out, "recipes")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Columns of docs but text, and keep_id, group_size, kept, text_sha256, for every row."""
    own = recipes(docs, text)
    clash = ("keep_id", "group_size", "kept")
    own = own.drop(*clash)
    # Largest first: length, then not null, then smallest id, then first row.
    best = F.max(F.struct("_n_cp", F.col(doc_id).isNotNull().alias("known"), (-F.col(doc_id)).alias("less"), (-F.col("_row")).alias("first")))
    groups = own.groupBy("_recipe").agg(F.count(F.lit(1)).alias("group_size"), best.alias("_best"))
    # The groups' key is made anew from the list, so that both sides are shuffled and a hot group's rows can be split.
    groups = groups.select(F.concat(F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(-1).alias("n"))), "_recipe").alias("_key"), "group_size", "_best")
    left = own.withColumn("_key", F.concat(F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(-1).alias("n"))), "_recipe")).drop("_recipe")
    out = left.join(groups, "_key").withColumn("keep_id", -F.col("_best.less")).withColumn("kept", F.col("_row") == -F.col("_best.first"))
    return out.drop("_key", "_best", "_row", "_n_cp")


def op3(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n_cp DESC, doc_id)
"""
