"""From reads to calls: tensors of sites, their sequence windows, scores, decoding and VCF columns in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import FLANK, WIDTH, subtract_reference
from ..operators import calls, intervals, reads, tensors


def site_sequences(sites: DataFrame, reference: DataFrame, behind: int = calls.LONGEST) -> DataFrame:
    """contig, pos, seq (the bases around the centre, 33 but at a contig's end) and after (those behind it), of sites whose window does not begin before the reference."""
    spots = sites.select("contig", "pos").distinct()
    # as for tensors.window_spots()
    spots = spots.withColumn("pos0", F.explode(F.sequence(F.col("pos") - FLANK - 1, F.col("pos") + behind - 1))).hint("merge")
    bases = spots.join(reference.select("contig", "pos0", F.upper("base").alias("base")), ["contig", "pos0"])
    i = F.col("pos0") - F.col("pos") + FLANK + 1
    text = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(i.alias("i"), "base")))), lambda x: x["base"]), "")
    rows = bases.groupBy("contig", "pos").agg(F.min(i).alias("first"), text(i < WIDTH).alias("seq"), text(i > FLANK).alias("after"))
    return rows.where("first = 0").drop("first")


def tensor_rows(sites: DataFrame, events: DataFrame, reference: DataFrame, min_coverage: int = 0, counts: DataFrame | None = None) -> DataFrame:
    """contig, pos, seq, after, x (33 x 8 x 4 counts as they are) of sites that reads touch, with min_coverage aligned bases at the centre.

    ``counts``: the events' position_counts(), if they are there already.
    """
    counts = tensors.position_counts(events, reference) if counts is None else counts
    x = tensors.dense(tensors.window_cells(sites, counts))
    rows = x.join(site_sequences(sites, reference), ["contig", "pos"])
    if min_coverage > 0:
        rows = rows.join(tensors.aligned_depth(events, reference).where(F.col("depth") >= min_coverage).select("contig", "pos"), ["contig", "pos"], "left_semi")
    return rows


def call_tensors(rows: DataFrame, events: DataFrame, forced: bool = False) -> DataFrame:
    """Decoded calls (see calls.decode) of tensor_rows() with g, z, u, v; indel bases come from the events where they must."""
    indels = calls.read_indels(events).hint("merge")  # of exploded events
    full = rows.withColumn("x", subtract_reference(F.col("x"))).join(indels, ["contig", "pos"], "left")
    return calls.decode(full, forced)


def call_reads(
    aligned: DataFrame, reference: DataFrame, score: Callable[[DataFrame], DataFrame], *, bed: DataFrame | None = None, start: int | None = None, end: int | None = None,
    threshold: float = 0.125, min_coverage: int = 4, min_mapq: int = 0, depth_cap: int = 250, qual: int | None = None, show_reference: bool = False, haploid: str | None = None, forced: bool = False,
) -> DataFrame:
    """VCF columns of the variants in aligned reads: candidates, tensors, ``score`` (adds g, z, u, v to rows with x) and calls."""
    near = reads.touching(aligned, start, end)
    counts = reads.pileup_counts(reads.expand(reads.filter_reads(near, min_mapq)))
    sites = reads.in_region(reads.candidates(counts, reference, threshold, min_coverage), start, end)
    if bed is not None:
        sites = intervals.points_in(sites.withColumn("pos0", F.col("pos") - 1), bed)
    events = reads.expand(reads.cap_depth(reads.filter_reads(near, min_mapq, soft_clip=False), depth_cap))
    scored = score(tensor_rows(sites, events, reference))
    return calls.finish_calls(call_tensors(scored, events, forced), qual, show_reference, haploid)
