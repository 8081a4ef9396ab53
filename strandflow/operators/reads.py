"""Aligned reads: filters, CIGAR expansion, pileup counts and candidate sites.

Reads have ord (input order), contig, pos0 (0-based start), mapq, flag, cigar
and seq. Nothing but the pileup's groupBy shuffles; filters come before the
CIGAR is expanded, and the reference joins on positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from ..functions.bases import sums_before, to_acgt

#: Unmapped, mate unmapped, secondary, supplementary.
DROPPED_FLAGS = 2316
SYMBOLS = ["A", "C", "G", "T", "I", "D", "N"]


def with_ops(reads: DataFrame) -> DataFrame:
    """Adds lens and ops, the CIGAR's operation lengths and letters."""
    part = lambda g: F.regexp_extract_all("cigar", F.lit(r"(\d+)([A-Z=])"), F.lit(g))
    return reads.withColumn("lens", F.transform(part(1), lambda x: x.cast("int"))).withColumn("ops", part(2))


def total(lens: Column) -> Column:
    return F.aggregate(lens, F.lit(0), lambda s, x: s + x)


def clipped_share_ok(least: float = 0.55) -> Column:
    """Whether enough of a read with lens and ops is not soft-clipped."""
    soft = total(F.zip_with("lens", "ops", lambda n, o: F.when(o == "S", n).otherwise(0)))
    return F.lit(1.0) - soft / (total(F.col("lens")) + 1) >= least


def filter_reads(reads: DataFrame, min_mapq: int = 0, soft_clip: bool = True) -> DataFrame:
    """Flag, mapping quality, missing CIGAR and, for candidates, soft-clip filters; adds lens and ops."""
    kept = reads.where((F.col("flag").bitwiseAND(DROPPED_FLAGS) == 0) & (F.col("mapq") >= min_mapq) & (F.col("cigar") != "*"))
    kept = with_ops(kept)
    return kept.where(clipped_share_ok()) if soft_clip else kept


def cap_depth(reads: DataFrame, cap: int = 250) -> DataFrame:
    """At most ``cap`` reads of equal start, in input order; at position 0 one fewer."""
    w = Window.partitionBy("contig", "pos0").orderBy("ord")
    most = F.when(F.col("pos0") == 0, cap - 1).otherwise(cap)
    return reads.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")


def expand(reads: DataFrame) -> DataFrame:
    """One row per event of reads with lens and ops.

    kind M: a base aligned to reference position r; D: a deleted position r
    (k counts inside the deletion); I: inserted base k before position r.
    base is the upper-case query symbol, first whether r is the read's first
    consumed position, begun whether one was consumed before. N, H and P
    consume nothing.
    """
    ref_step = F.zip_with("lens", "ops", lambda n, o: F.when(o.isin("M", "=", "X", "D"), n).otherwise(0))
    query_step = F.zip_with("lens", "ops", lambda n, o: F.when(o.isin("M", "=", "X", "I", "S"), n).otherwise(0))
    ops = reads.withColumn("at_ref", sums_before(ref_step)).withColumn("at_query", sums_before(query_step))
    ops = ops.withColumn("op", F.explode(F.arrays_zip("lens", "ops", "at_ref", "at_query"))).drop("lens", "ops", "at_ref", "at_query")
    ops = ops.where(F.col("op.ops").isin("M", "=", "X", "I", "D") & (F.col("op.lens") > 0))
    kind = F.when(F.col("op.ops").isin("I", "D"), F.col("op.ops")).otherwise("M")
    ops = ops.withColumn("kind", kind).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("op.lens") - 1)))
    inserted = F.col("kind") == "I"
    r = F.col("pos0") + F.col("op.at_ref") + F.when(inserted, 0).otherwise(F.col("k"))
    base = F.when(F.col("kind") != "D", F.upper(F.expr("substring(seq, op.at_query + k + 1, 1)")))
    return ops.select(
        "contig", r.alias("r"), "kind", "k", base.alias("base"), (F.col("flag").bitwiseAND(16) > 0).alias("reverse"),
        (~inserted & (F.col("op.at_ref") + F.col("k") == 0)).alias("first"), (F.col("op.at_ref") > 0).alias("begun"), "pos0", "ord",
    )


def pileup_counts(events: DataFrame) -> DataFrame:
    """Counts of A, C, G, T, I, D, N by contig and 0-based position; an insertion or deletion counts once, at the base before it."""
    aligned = F.col("kind") == "M"
    at = F.when(aligned, F.col("r")).otherwise(F.col("r") - 1)
    symbol = F.when(aligned, to_acgt(F.col("base"))).otherwise(F.col("kind"))
    rows = events.where(aligned | (F.col("k") == 0)).select("contig", at.alias("pos0"), symbol.alias("symbol"))
    return rows.groupBy("contig", "pos0").agg(*(F.count_if(F.col("symbol") == s).alias(s) for s in SYMBOLS))


def ranked(counts: list[str] = SYMBOLS) -> Column:
    """Array of (n, symbol), most frequent first, ties in the order of ``counts``."""
    pairs = F.array(*(F.struct((-F.col(s)).alias("m"), F.lit(i).alias("o"), F.lit(s).alias("symbol")) for i, s in enumerate(counts)))
    return F.transform(F.array_sort(pairs), lambda x: F.struct((-x["m"]).alias("n"), x["symbol"].alias("symbol")))


def candidates(counts: DataFrame, reference: DataFrame, threshold: float = 0.125, min_coverage: int = 4) -> DataFrame:
    """Sites whose most frequent symbol is not the reference base, or whose second is frequent enough: contig, pos (1-based), ref, depth, counts text."""
    depth = sum((F.col(s) for s in "ACGTN"), F.lit(0))
    sites = counts.withColumn("depth", depth).where(F.col("depth") >= min_coverage)
    sites = sites.hint("merge").join(reference, ["contig", "pos0"]).withColumn("top", ranked())
    ref = to_acgt(F.col("base"))
    frequent = F.col("top")[1]["n"] / F.greatest("depth", F.lit(1)) >= threshold
    sites = sites.where((F.col("top")[0]["symbol"] != ref) | frequent)
    text = F.array_join(F.transform("top", lambda x: F.concat_ws(" ", x["symbol"], x["n"].cast("string"))), " ")
    return sites.select("contig", (F.col("pos0") + 1).alias("pos"), ref.alias("ref"), F.col("depth").cast("long").alias("depth"), text.alias("counts"))


def spans(reads: DataFrame) -> DataFrame:
    """Adds span, the reference positions that a read covers by its CIGAR."""
    sizes = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)[M=XDN]"), F.lit(1)), lambda x: x.cast("int"))
    return reads.withColumn("span", F.aggregate(sizes, F.lit(0), lambda s, x: s + x))


def touching(reads: DataFrame, start: int | None, end: int | None, widen: int = 0) -> DataFrame:
    """Reads that cover a 1-based position from start to end, both included, widened on both sides; all without bounds."""
    if start is None or end is None:
        return reads
    low, high = max(start - widen, 1) - 1, end + widen - 1
    # the first test reaches a scan, the second needs the CIGAR
    return spans(reads.where(F.col("pos0") <= high)).where(F.col("pos0") + F.greatest("span", F.lit(1)) > low).drop("span")


def in_region(sites: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Sites of 1-based positions from start to end, both included."""
    return sites if start is None or end is None else sites.where(F.col("pos").between(start, end))


def indel_counts(events: DataFrame, kind: str, low: int = 1, high: int = 50) -> DataFrame:
    """contig, pos0 (the base before), bases (of insertions), size, n and seen (start and ord of the first read) of each inserted string or deleted length."""
    k = F.when(F.col("kind") == "D", F.col("k")).otherwise(0)
    rows = events.where(F.col("kind") == kind).groupBy("contig", "pos0", "ord", (F.col("r") - k).alias("at"))
    bases = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "base"))), lambda x: x["base"]), "") if kind == "I" else F.lit("")
    strings = rows.agg(bases.alias("bases"), F.count("*").cast("int").alias("size")).where(F.col("size").between(low, high))
    return strings.groupBy("contig", (F.col("at") - 1).alias("site"), "bases", "size").agg(F.count("*").alias("n"), F.min(F.struct("pos0", "ord")).alias("seen")).withColumnRenamed("site", "pos0")


def indel_mode(events: DataFrame, kind: str, low: int = 1, high: int = 50, ignored: str = "", reference: DataFrame | None = None) -> DataFrame:
    """contig, pos0, bases, n: the most frequent inserted or deleted bases of low to high length after the base at pos0, ties to the first read.

    Deleted bases are the reference's; ``ignored`` is an inserted string that does not count.
    """
    w = Window.partitionBy("contig", "pos0").orderBy(F.desc("n"), "seen", "bases", "size")
    rows = indel_counts(events, kind, low, high).where((F.col("bases") != ignored) | (F.lit(kind) == "D"))
    best = rows.withColumn("rank", F.row_number().over(w)).where("rank = 1")
    if kind == "I":
        return best.select("contig", "pos0", "bases", "n")
    gone = best.select("contig", "pos0", "n", F.posexplode(F.sequence(F.col("pos0") + 1, F.col("pos0") + F.col("size"))).alias("i", "at"))
    named = gone.join(reference.select("contig", F.col("pos0").alias("at"), F.upper("base").alias("base")), ["contig", "at"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "base"))), lambda x: x["base"]), "")
    return named.groupBy("contig", "pos0", "n").agg(text.alias("bases")).select("contig", "pos0", "bases", "n")


#: Order of a position's rows: read by read, its indels (inserted bases as they stand in the read) before its base.
READ_ORDER = ["start", "ord", "kind", "k", "symbol"]


def pileup_rows(events: DataFrame, most: int = 250) -> DataFrame:
    """contig, pos0, kind, symbol, k, reverse, start, ord: what each read shows at a position.

    Symbols are bases, ``+`` and an inserted base, ``-`` for a deleted one; the last two belong to
    the position before them. At most ``most`` reads that cover a position, in the order of their starts.
    """
    at = F.when(F.col("kind") == "M", F.col("r")).when(F.col("kind") == "D", F.col("r") - F.col("k") - 1).otherwise(F.col("r") - 1)
    symbol = F.when(F.col("kind") == "M", F.col("base")).when(F.col("kind") == "I", F.concat(F.lit("+"), "base")).otherwise("-")
    rows = events.select("contig", at.alias("pos0"), "kind", symbol.alias("symbol"), "k", "reverse", F.col("pos0").alias("start"), "ord")
    nth = F.dense_rank().over(Window.partitionBy("contig", "pos0").orderBy("start", "ord"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def map_pileup(events: DataFrame, column: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = 250) -> DataFrame:
    """``column`` of each position's pileup_rows() in read order, as rows of ``schema``."""
    rows = pileup_rows(events, most)
    return rows.groupBy("contig", "pos0").applyInPandas(lambda own: column(own.sort_values(READ_ORDER, kind="stable")), schema)


def pileup_function(column: Callable[[list[Row]], Iterable[tuple]], schema: str) -> UserDefinedTableFunction:
    """A table function of pileup_rows() that calls ``column`` with each position's rows and gives the tuples that it returns.

    Positions come as partitions of the function's table, so a task holds the
    rows of one, and the exchange that counted its reads serves the function,
    too. Register it with spark.udtf.register to call it in SQL::

        SELECT * FROM name(TABLE(rows) PARTITION BY (contig, pos0) ORDER BY (start, ord, kind, k, symbol))

    or hand it to apply_pileup().
    """

    class Position:
        def __init__(self) -> None:
            self.rows: list[Row] = []

        def eval(self, row: Row) -> None:
            self.rows.append(row)

        def terminate(self) -> Iterator[tuple]:
            if self.rows:
                yield from column(self.rows)

    return F.udtf(Position, returnType=schema)


def apply_pileup(events: DataFrame, function: UserDefinedTableFunction, most: int = 250) -> DataFrame:
    """A pileup_function() over the pileup of events."""
    return function(pileup_rows(events, most).asTable().partitionBy("contig", "pos0").orderBy(*READ_ORDER))
