"""Operator 10, byte-level BPE encoding and decoding by overlapping chunks.

Texts up to `chunk` code points are one chunk and never move. Longer ones are cut into chunks that overlap by `overlap`;
the chunks are written, and each is pre-tokenised on its own, in any task. Of its chain of pre-tokens only the boundaries
within its first and last `overlap` code points go on, as numbers. Where the chains of two neighbours have a boundary in
common they agree from there on, so the text is cut at the first such place. A place counts only if no reading of the
pattern could go on over it (a letter or number before what is none, in any script; see tokens.sure_boundary), so that
another implementation of the pattern has the same boundary. Pieces are encoded where they lie; ids of one document are
gathered in one row, which a text fits as well.

Chunks between which there is no such place (one word longer than the overlap, say) are encoded as one piece; the rest
of the document is not touched by that. Decoding looks up each id's bytes and concatenates them.

Null texts read as empty; an empty text has no ids. Very long texts are read whole, by many tasks. Repeated rows (also
repeated document ids) give repeated results, an empty table none. Extra columns are carried by encode(), but for an own
`ids`, which is replaced; the query ignores them. The corpus is read once for texts of one chunk and once, by length
alone, for the others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import text_of, written
from quantloom.llm.tokens import encoding, pattern, ranks_path, sure_boundary

CHUNK = 65_536
OVERLAP = 2_048
#: Characters from a match's start, and after its end, that decide on it.
LOOK, AHEAD = 3, 1


def boundaries(chunk: str, first: int, last: int) -> list[int]:
    """Sure boundaries b of the chunk's chain of pre-tokens, first <= b < last, up to the first match that hangs on what
    follows the chunk."""
    out = []
    size = len(chunk)
    for m in pattern().finditer(chunk):
        start, end = m.span()
        if end + AHEAD > size or start + LOOK > size or end >= last:
            break
        if end >= first and sure_boundary(chunk[end - 1], chunk[end]):
            out.append(end)
    return out


def _ends(overlap: int, step: int):
    @F.arrow_udf("struct<head:array<int>,tail:array<int>>")
    def run(chunks: pa.Array) -> pa.Array:
        """Boundaries in the first `overlap` characters, and beyond `step` ones, counted from there."""
        out = []
        for c in chunks:
            c = c.as_py()
            out.append({"head": boundaries(c, 1, overlap), "tail": [b - step for b in boundaries(c, step + 1, len(c))]})
        return pa.array(out, pa.struct([("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))]))

    return run


def encode_bytes(path: str):
    """Ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        code = encoding(path).encode_ordinary
        return pa.array((np.array(code(t.as_py()), dtype="<u4").tobytes() for t in texts), pa.binary())

    return run


def decode_bytes(path: str):
    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        plain = encoding(path).decode_bytes
        return pa.array((plain(np.frombuffer(b.as_py(), dtype="<u4").tolist()) for b in ids), pa.binary())

    return run


def pieces(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """chunks: _doc, _no, _chunk. _doc, _no, _piece: texts that can be encoded apart, in order, and make up the document."""
    step = chunk - overlap
    order = Window.partitionBy("_doc").orderBy("_no")
    # The windows see a few numbers for each chunk, no texts.
    marks = chunks.select("_doc", "_no", _ends(overlap, step)("_chunk").alias("_e"))
    marks = marks.withColumn("_cut", F.when(F.col("_no") == 0, 0).otherwise(F.array_min(F.array_intersect(F.lag("_e.tail").over(order), "_e.head"))))
    marks = marks.select("_doc", "_no", "_cut", F.lead("_cut").over(order).alias("_next"), (F.lead("_no").over(order).isNull()).alias("_last"), F.max(F.when(F.col("_cut").isNotNull(), F.col("_no"))).over(order).alias("_first"))
    own = chunks.join(marks, ["_doc", "_no"])
    size = F.length("_chunk")
    end = F.when(F.col("_last"), size).otherwise(step + F.coalesce("_next", F.lit(0)))
    start = F.coalesce("_cut", F.lit(0))
    own = own.withColumn("_part", F.col("_chunk").substr(start + 1, end - start))
    alone = own.where((F.col("_first") == F.col("_no")) & (F.col("_last") | F.col("_next").isNotNull())).select("_doc", "_no", F.col("_part").alias("_piece"))
    several = own.where((F.col("_first") != F.col("_no")) | (~F.col("_last") & F.col("_next").isNull()))
    merged = several.groupBy("_doc", "_first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_part"))), lambda x: x["_part"]), "").alias("_piece"))
    return alone.unionByName(merged.withColumnRenamed("_first", "_no"))


def encode(docs: DataFrame, text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Columns of docs but text (and any named ids), and ids binary (little-endian unsigned 32-bit)."""
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("overlap must be positive and at most half a chunk")
    run = encode_bytes(path or ranks_path())
    keep = [c for c in docs.columns if c not in (text, "ids")]
    own = docs.select(F.struct(*[docs[c] for c in keep]).alias("_row"), text_of(docs, text).alias("_text")) if keep else docs.select(F.struct(F.lit(0)).alias("_row"), text_of(docs, text).alias("_text"))
    short = own.where(F.length("_text") <= chunk).select("_row", run("_text").alias("ids"))

    step = chunk - overlap
    long = own.where(F.length("_text") > chunk).withColumn("_doc", F.monotonically_increasing_id())
    count = F.ceil((F.length("_text") - overlap) / step).cast("int")
    rows = long.select("_doc", "_row", "_text", F.explode(F.sequence(F.lit(0), count - 1)).alias("_no"))
    rows = rows.select("_doc", "_no", F.when(F.col("_no") == 0, F.col("_row")).alias("_row"), F.col("_text").substr(F.col("_no") * step + 1, F.lit(chunk)).alias("_chunk"))
    rows = written(rows, "chunks")  # numbered once
    parts = pieces(rows.select("_doc", "_no", "_chunk"), chunk, overlap).select("_doc", "_no", run("_piece").alias("_ids"))
    gathered = parts.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("_no", "_ids"))).alias("_parts"))
    gathered = gathered.select("_doc", F.call_function("array_join", F.transform("_parts", lambda x: F.hex(x["_ids"])), F.lit("")).alias("_hex")).select("_doc", F.unhex("_hex").alias("ids"))
    back = rows.where("_no = 0").select("_doc", "_row").join(gathered, "_doc").select("_row", "ids")
    return short.unionByName(back).select(*[F.col("_row")[c].alias(c) for c in keep], "ids")


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """The same rows with bytes binary: the raw bytes of all ids, one after another."""
    return encoded.withColumn("bytes", decode_bytes(path or ranks_path())(F.col(ids)))


def op10(docs: DataFrame) -> DataFrame:
    out = decode(encode(docs.select("doc_id", "text")))
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def reference_digest(text: str | None) -> tuple[int, str, str]:
    """The digest of one text encoded in one go, for tests."""
    enc = encoding(ranks_path())
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()
