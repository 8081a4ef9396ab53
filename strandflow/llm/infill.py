"""Fill-in-middle transformation by relations over the units of a text.

A unit is a word with the white space before it, or the white space at a
text's end: ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, matched
from left to right. Two cuts, given as numbers of units, part a text into
prefix, middle and suffix; hashes of seed and doc_id give the cuts and the form.

Units are rows: a text's matches are exploded with their places, window sums
give running lengths, each document's cut requests are joined to them by unit
ordinal, the offsets are aggregated for each document, and the text is cut with
substring. Two levels bound what a document sorts: first blocks of ``BLOCK``
units, joined by the block of the requested ordinal, then the units of the
blocks that hold a cut. Documents move once, dealt by row, and all these steps
use that exchange.

Defined results: null text is the empty text; a null doc_id hashes as the empty
string; rows may repeat, each is a document of its own; texts of any length are
whole; an empty table gives no rows; extra columns are ignored by ``infill``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import base_columns, partitions

#: Units of a block.
BLOCK = 64
#: Percent of texts that take a form with a middle, and of these in the order suffix, prefix, middle.
FIM_PERCENT, SPM_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
UNIT = rf"{_WORD}|[\x20\x09-\x0D]++"
#: BLOCK units; a text's last block also takes the white space at the end.
UNITS = rf"(?:{_WORD}){{1,{BLOCK}}}+(?:[\x20\x09-\x0D]++\z)?|[\x20\x09-\x0D]++"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def unit_count(blocks: Column) -> Column:
    """Units of a text from its blocks, of which only the last may hold another number than BLOCK."""
    last = F.size(matches(F.element_at(blocks, -1), UNIT))
    return F.when(F.size(blocks) == 0, 0).otherwise((F.size(blocks) - 1) * BLOCK + last).cast("long")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned integers of 32 bits from seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def plan_cuts(docs: DataFrame, seed: int) -> DataFrame:
    """Adds n, form, and cuts (the two numbers of units, ascending) to rows of doc_id, text and blocks."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= FIM_PERCENT)
    form = F.when(plain, "plain").when(h4 % 100 < SPM_PERCENT, "spm").otherwise("psm")
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    return docs.withColumn("n", unit_count(F.col("blocks"))).withColumn("form", form).withColumn("cuts", F.array(F.least(a, b), F.greatest(a, b)))


def cut_offsets(planned: DataFrame) -> DataFrame:
    """row, prefix_end and middle_end in characters of each document with a middle.

    planned: row, blocks, n, form and cuts, dealt by row. A cut of no units has no row to meet and stays null.
    """
    cut = planned.where("form <> 'plain'")
    # the unit that ends at the cut
    requests = cut.select("row", F.posexplode("cuts").alias("which", "units")).where("units > 0").select("row", "which", (F.col("units") - 1).alias("ordinal"))
    blocks = cut.select("row", "n", F.posexplode("blocks").alias("block", "part"), (F.size("blocks") - 1).alias("last_block"))
    first = F.col("block").cast("long") * BLOCK
    blocks = blocks.select("row", "block", "part", first.alias("first"), F.when(F.col("block") == F.col("last_block"), F.col("n")).otherwise(first + BLOCK).alias("next"))
    before = Window.partitionBy("row").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("chars_before", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)))
    # row is the only key, by which both sides are dealt already
    asked = requests.withColumnRenamed("row", "asked_row")
    held = blocks.join(asked, (F.col("row") == F.col("asked_row")) & (F.col("ordinal") >= F.col("first")) & (F.col("ordinal") < F.col("next")))
    units = held.select("row", "which", "ordinal", "first", "chars_before", F.posexplode(matches(F.col("part"), UNIT)).alias("place", "unit"))
    upto = Window.partitionBy("row", "which").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    units = units.withColumn("chars", F.col("chars_before") + F.sum(F.length("unit")).over(upto))
    ends = units.where(F.col("first") + F.col("place") == F.col("ordinal"))
    at = lambda k: F.max(F.when(F.col("which") == k, F.col("chars")))
    return ends.groupBy("row").agg(at(0).alias("prefix_end"), at(1).alias("middle_end"))


def infill(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain), output and text of each row."""
    blocks = matches(F.col("text"), UNITS)
    rows = base_columns(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(partitions(docs.sparkSession), "row")
    # all uses read every column, so that they share one exchange
    whole = dealt.where((F.hash("row", "doc_id", "text") + F.rand(7)) > F.lit(-4e9))
    planned = plan_cuts(whole.withColumn("blocks", blocks), seed)
    offsets = cut_offsets(planned)
    met = planned.drop("blocks", "cuts").join(offsets.hint("shuffle_hash"), "row", "left")
    has = F.col("form") != "plain"
    a = F.coalesce("prefix_end", F.lit(0)).cast("int")
    b = F.coalesce("middle_end", F.lit(0)).cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text") - b)
    mark = {m: F.lit(m) for m in (PREFIX, SUFFIX, MIDDLE)}
    spm = F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    psm = F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    output = F.when(F.col("form") == "spm", spm).when(F.col("form") == "psm", psm).otherwise(F.col("text"))
    return met.select("doc_id", "n", "form", F.when(has, a).cast("long").alias("prefix_chars"), F.when(has, b - a).cast("long").alias("middle_chars"), output.alias("output"), "text")


def restore(output: Column, form: Column) -> Column:
    """The text of an output, read from its marks."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "spm", F.concat(at(3), at(4), at(2))).otherwise(F.concat(at(2), at(4), at(3)))


def infill_digests(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of each row."""
    done = infill(docs, seed)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
