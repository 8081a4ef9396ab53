"""Windowed count tensors around candidate sites.

In the default mode a window's counts depend only on what is at each
reference position, so events are counted by position first and candidates
join the counts on 33 (for insertions as many) positions: an equi join, never
candidate by read. The stop-left-edge mode needs reads and joins them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import CHANNELS, FLANK, ROWS, WIDTH, base_row
from . import packed

CELL = ["contig", "pos", "idx", "row", "ch"]


KINDS = packed.KINDS


def position_counts(events: DataFrame, reference: DataFrame) -> DataFrame:
    """contig, r, kind, k, first, begun, ref_row, query_row, n: events by position with rows 0 to 7 of both symbols.

    Events are counted by position and one packed number before they meet the reference.
    """
    k = F.when(F.col("kind") == "I", F.least("k", F.lit(WIDTH))).otherwise(0)
    fields = [k, F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1, F.coalesce(base_row(F.col("base")), F.lit(4)), F.col("first"), F.col("begun"), F.col("reverse")]
    sizes = packed.FIELDS
    code = F.lit(0)
    for field, size in zip(fields, sizes, strict=True):
        code = code * size + F.coalesce(field.cast("int"), F.lit(0))
    return _named(events.groupBy("contig", "r", code.cast("int").alias("code")).agg(F.count("*").alias("n")), reference)


def position_counts_of(reads: DataFrame, reference: DataFrame, min_mapq: int = 0) -> DataFrame:
    """position_counts() of the events of reads.filter_reads() without the soft-clip filter; a task hands on counts only."""
    return _named(packed.position_codes(reads, min_mapq), reference)


def from_codes(rows: DataFrame, ref_base: Column) -> DataFrame:
    """Adds kind, k, first, begun, ref_row and query_row of rows with code (of packed.FIELDS); ref_base: 0 to 3 of the reference."""
    unit, parts = 1, []
    for size in reversed(packed.FIELDS):
        parts.append(F.floor(F.col("code") / unit) % size)
        unit *= size
    reverse, begun, first, row, kind, k = parts
    strand = (reverse * 4).cast("int")
    return rows.withColumns({
        "kind": F.element_at(F.array(*map(F.lit, KINDS)), (kind + 1).cast("int")), "k": k.cast("int"), "first": first == 1, "begun": begun == 1,
        "ref_row": ref_base + strand, "query_row": F.when(row < 4, row.cast("int")) + strand,
    })


def _named(counted: DataFrame, reference: DataFrame) -> DataFrame:
    """position_counts() from contig, r, code, n."""
    known = reference.select("contig", F.col("pos0").alias("r"), base_row(F.col("base")).alias("ref_base"))
    rows = from_codes(counted.hint("merge").join(known, ["contig", "r"]), F.col("ref_base"))
    return rows.select("contig", "r", "kind", "k", "first", "begun", "ref_row", "query_row", "n")


def cell_rows(hits: DataFrame, n: Column) -> DataFrame:
    """Long-form cells, not yet summed, of events placed at index i of a window."""
    known = {"M": F.col("ref_row").isNotNull() & F.col("query_row").isNotNull(), "D": F.col("ref_row").isNotNull(), "I": F.col("query_row").isNotNull()}
    inner = F.col("i").between(1, WIDTH - 1)
    counted = (
        ((F.col("kind") == "M") & known["M"] & F.col("i").between(0, WIDTH - 1))
        | ((F.col("kind") == "D") & known["D"] & inner & ~F.col("first"))
        | ((F.col("kind") == "I") & known["I"] & inner & F.col("begun"))
    )
    cell = lambda row, ch: F.struct(row.alias("row"), F.lit(ch).alias("ch"))
    ref, query = F.col("ref_row"), F.col("query_row")
    cells = F.when(F.col("kind") == "M", F.array(cell(ref, 0), cell(query, 1), cell(ref, 2), cell(query, 3))).when(F.col("kind") == "D", F.array(cell(ref, 2))).otherwise(F.array(cell(query, 1)))
    idx = F.when(F.col("kind") == "I", F.least(F.col("i") + F.col("k"), F.lit(WIDTH - 1))).otherwise(F.col("i"))
    long = hits.where(counted).select("contig", "pos", idx.cast("int").alias("idx"), F.explode(cells).alias("cell"), n.alias("n"))
    return long.select("contig", "pos", "idx", "cell.row", "cell.ch", "n")


def _summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*CELL).agg(F.sum("n").alias("n"))


def window_spots(sites: DataFrame, unique: bool = False) -> DataFrame:
    """contig, pos, i, r: the 33 positions of each site's window; ``unique``: no site is there twice.

    Spark takes exploded rows for as large as the sites, so a join with these is
    hinted (merge), or it would broadcast far more than its threshold.
    """
    known = sites.select("contig", "pos")
    return (known if unique else known.distinct()).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1)))).withColumn("r", F.col("pos") + F.col("i") - FLANK - 1)


def position_cells(counts: DataFrame) -> DataFrame:
    """contig, r and cells (row, ch, k, inner, n), what a position adds to every window that it lies in.

    At index i of a window a cell counts at index i + k, 32 at most; an inner one only if i is over 0.
    """
    m = F.col("kind") == "M"
    ref, query = F.col("ref_row"), F.col("query_row")
    both = ref.isNotNull() & query.isNotNull()
    cell = lambda row, ch: F.struct(row.alias("row"), F.lit(ch).alias("ch"))
    cells = (
        F.when(m & both, F.array(cell(ref, 0), cell(query, 1), cell(ref, 2), cell(query, 3)))
        .when((F.col("kind") == "D") & ref.isNotNull() & ~F.col("first"), F.array(cell(ref, 2)))
        .when((F.col("kind") == "I") & query.isNotNull() & F.col("begun"), F.array(cell(query, 1)))
    )
    rows = counts.select("contig", "r", F.explode(cells).alias("cell"), F.when(F.col("kind") == "I", F.col("k")).otherwise(0).alias("k"), (~m).alias("inner"), "n")
    summed = rows.groupBy("contig", "r", "cell.row", "cell.ch", "k", "inner").agg(F.sum("n").alias("n"))
    return summed.groupBy("contig", "r").agg(F.collect_list(F.struct("row", "ch", "k", "inner", "n")).alias("cells"))


def window_cells(sites: DataFrame, counts: DataFrame) -> DataFrame:
    """Sparse tensors, default mode: contig, pos (1-based centre), idx, row, ch, n; from sites and position_counts().

    A position is one row, so a site meets 33 rows however deep the reads are.
    """
    met = window_spots(sites).hint("merge").join(position_cells(counts), ["contig", "r"])
    long = met.select("contig", "pos", "i", F.explode("cells").alias("c")).where((F.col("i") > 0) | ~F.col("c.inner"))
    return _summed(long.select("contig", "pos", F.least(F.col("i") + F.col("c.k"), F.lit(WIDTH - 1)).cast("int").alias("idx"), "c.row", "c.ch", "c.n"))


def window_cells_left_edge(sites: DataFrame, events: DataFrame, reference: DataFrame) -> DataFrame:
    """The same where a read takes part only if it consumes the position at index 0."""
    edges = sites.select("contig", "pos", (F.col("pos") - FLANK - 1).alias("edge")).distinct()
    reads = events.where("kind <> 'I'").select("contig", "pos0", "ord", F.col("r").alias("edge"))
    # only reads that take part go on, and of their events those in the window
    taking = edges.hint("merge").join(reads, ["contig", "edge"]).select("contig", "pos", "pos0", "ord").distinct()
    hits = taking.hint("merge").join(events, ["contig", "pos0", "ord"]).withColumn("i", F.col("r") - F.col("pos") + FLANK + 1).where(F.col("i").between(0, WIDTH - 1))
    strand = F.when(F.col("reverse"), 4).otherwise(0)
    rows = hits.hint("merge").join(reference.select("contig", F.col("pos0").alias("r"), F.col("base").alias("ref_base")), ["contig", "r"])
    rows = rows.withColumn("ref_row", base_row(F.col("ref_base")) + strand).withColumn("query_row", base_row(F.col("base")) + strand)
    return _summed(cell_rows(rows, F.lit(1).cast("long")))


def aligned_depth(events: DataFrame, reference: DataFrame) -> DataFrame:
    """contig, pos, depth: aligned bases at each 1-based position whose base is known, counted before they meet the reference.

    From the events rather than from position_counts(): there a test of a
    part of the packed number would move below the grouping and be made for every event.
    """
    counted = events.where((F.col("kind") == "M") & base_row(F.col("base")).isNotNull()).groupBy("contig", "r").agg(F.count("*").alias("depth"))
    known = reference.where(base_row(F.col("base")).isNotNull()).select("contig", F.col("pos0").alias("r"))
    return counted.join(known, ["contig", "r"], "left_semi").select("contig", (F.col("r") + 1).alias("pos"), "depth")


def window_depth(sites: DataFrame, events: DataFrame, reference: DataFrame) -> DataFrame:
    """contig, pos, idx, depth: aligned bases at all 33 indices of each site's window, 0 where there are none; default mode.

    A position is one row before it meets the windows.
    """
    at = aligned_depth(events, reference).select("contig", (F.col("pos") - 1).alias("r"), "depth")
    met = window_spots(sites).hint("merge").join(at, ["contig", "r"], "left")
    return met.select("contig", "pos", F.col("i").alias("idx"), F.coalesce("depth", F.lit(0)).alias("depth"))


def depth_of_cells(cells: DataFrame) -> DataFrame:
    """The same of either mode's cells, indices without aligned bases left out: each such base counts once in channel 0."""
    return cells.where("ch = 0").groupBy("contig", "pos", "idx").agg(F.sum("n").alias("depth"))


def dense(cells: DataFrame, subtract: bool = False) -> DataFrame:
    """contig, pos, x: flat arrays of 33 x 8 x 4 counts, with channel 0 taken from the others if ``subtract``; densify at the edge only."""
    flat = ((F.col("idx") * ROWS + F.col("row")) * CHANNELS + F.col("ch")).cast("int")
    rows = cells.groupBy("contig", "pos").agg(F.collect_list(F.struct(flat.alias("at"), F.col("n").cast("int").alias("n"))).alias("cells"))
    size = WIDTH * ROWS * CHANNELS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch.column("cells"), batch.num_rows
            inner, site = column.flatten(), np.repeat(np.arange(n), np.diff(column.offsets.to_numpy()))
            x = np.zeros((n, size), np.int32)
            x[site, inner.field("at").to_numpy()] = inner.field("n").to_numpy()
            if subtract:
                x.reshape(n, -1, CHANNELS)[:, :, 1:] -= x.reshape(n, -1, CHANNELS)[:, :, :1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("contig"), batch.column("pos"), lists], names=["contig", "pos", "x"])

    return rows.mapInArrow(run, "contig string, pos long, x array<int>")
