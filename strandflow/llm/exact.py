"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

Two texts are equal if they are the same after each run of white space
(``[\\x20\\x09-\\x0D]+``) is replaced by one space. A normalised text is cut
where its own bytes say so, so equal passages give equal chunks wherever they
stand. Chunks are known by a 64-bit hash that is verified: all chunk texts meet
once by hash, copies combined before they move, and where one hash has several
texts each gets a rank. A document's recipe is the list of its chunks'
identifiers, some bytes for each kilobyte of text; grouping and the join back
move recipes only, never the texts again.

Of equal texts the row of the smallest doc_id stays. Defined results: null text
is the empty text; null doc_ids come last; of several rows with the smallest
doc_id one stays, by its place in the table; texts of any length are whole; an
empty table gives no rows; extra columns are ignored by ``mark_copies`` and kept
by ``drop_copies``.

A group that holds much of the table is combined before the shuffle; the join
back is a sort-merge join, whose hot partitions Spark splits (adaptive skew
join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import base_columns, free_name, materialize

#: Bytes of a chunk, at least (but for a text's last) and at most.
LEAST, MOST = 256, 8192
#: A chunk ends behind RUN bytes in a row that are RESIDUE modulo MODULUS.
MODULUS, RESIDUE, RUN = 5, 3, 3


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """Matches the next chunk of a text with one character for each byte."""
    marks = "[" + "".join(f"\\x{b:02x}" for b in range(256) if b % MODULUS == RESIDUE) + "]"
    return f"(?s).{{{least},{most - RUN}}}?{marks}{{{RUN}}}|.{{1,{most}}}"


def chunks_of(text: Column) -> Column:
    """The chunks of a text, each byte as the character of its number."""
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(chunk_pattern()), F.lit(0))


def chunk_hash(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.pmod(F.xxhash64(chunk), F.lit(1 << bits))


def shared_hashes(chunks: DataFrame) -> DataFrame:
    """h of each hash that several texts have, from rows of h and chunk."""
    return chunks.groupBy("h", "chunk").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """row, doc_id, text_sha256, recipe and ranks of each document, written down.

    recipe lists the chunks' hashes of ``bits`` bits. ranks lists, for chunks
    whose hash stands for several texts, the place and the rank of the chunk
    among these, so recipe and ranks together are equal for equal texts only.
    """
    rows = base_columns(docs, "doc_id", "text").select("doc_id", normalised(F.col("text")).alias("text"))
    cut = rows.select(F.explode(chunks_of(F.col("text"))).alias("chunk")).select(chunk_hash(F.col("chunk"), bits).alias("h"), "chunk")
    several = materialize(shared_hashes(cut), "hashes")
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    collided = not several.isEmpty()
    if collided:
        numbered = materialize(numbered, "numbered")
    recipe = F.transform(chunks_of(F.col("text")), lambda c: chunk_hash(c, bits))
    out = numbered.select("row", "doc_id", F.sha2("text", 256).alias("text_sha256"), recipe.alias("recipe"))
    none = F.array().cast("array<struct<place:int,rank:int>>")
    if collided:
        places = numbered.select("row", F.posexplode(chunks_of(F.col("text"))).alias("place", "chunk")).withColumn("h", chunk_hash(F.col("chunk"), bits))
        ranked = places.join(several, "h").select("h", "chunk").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
        ranks = places.join(ranked, ["h", "chunk"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "rank"))).alias("ranks"))
        out = out.join(ranks, "row", "left").withColumn("ranks", F.coalesce("ranks", none))
    else:
        out = out.withColumn("ranks", none)
    return materialize(out, "recipes")


def mark_copies(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row."""
    known = recipes(docs, bits)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    groups = known.groupBy("recipe", "ranks").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    # written down, so that both sides of the join are plain exchanges, whose hot partitions Spark can split
    groups = materialize(groups, "groups")
    met = known.join(groups, ["recipe", "ranks"], "left")
    alone = F.col("n").isNull()
    return met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n")).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    row = free_name("__row", docs.columns)
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    ordered = numbered.select(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(f"`{row}`").alias("row")).alias("doc_id"), "text")
    stay = mark_copies(ordered).where("kept").select(F.col("doc_id.row").alias(row))
    return numbered.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
