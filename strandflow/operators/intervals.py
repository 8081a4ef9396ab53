"""Interval joins, chunk plans and sites near variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 16_384
# Contigs that the chunk planner knows, with or without the prefix.
MAIN_CONTIGS = [*map(str, range(1, 23)), "X", "Y"]


def clean_bed(bed: DataFrame) -> DataFrame:
    """Intervals of no length get one."""
    return bed.select("contig", "start", F.when(F.col("start") == F.col("end"), F.col("end") + 1).otherwise(F.col("end")).alias("end"))


def points_in(points: DataFrame, bed: DataFrame, at: str = "pos0", width: int = BIN) -> DataFrame:
    """Left semi join of points with half-open intervals of their contig.

    Both sides are cut into bins, so the join is on contig and bin with the
    range as residual, and a long contig does not meet all its intervals.
    """
    cut = clean_bed(bed).select("contig", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("bin"))
    p, b = points.withColumn("bin", F.floor(F.col(at) / width)).alias("p"), cut.alias("b")
    on = (F.col("p.contig") == F.col("b.contig")) & (F.col("p.bin") == F.col("b.bin")) & (F.col(f"p.{at}") >= F.col("b.start")) & (F.col(f"p.{at}") < F.col("b.end"))
    return p.join(b, on, "left_semi").drop("bin")


def intervals_overlapping(regions: DataFrame, bed: DataFrame, width: int = BIN) -> DataFrame:
    """Left semi join of intervals with intervals that overlap them; regions' rows (contig, start, end) are distinct."""
    bins = lambda d: d.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    r, b = bins(regions).alias("r"), bins(clean_bed(bed)).alias("b")
    on = (F.col("r.contig") == F.col("b.contig")) & (F.col("r.bin") == F.col("b.bin")) & (F.col("r.start") < F.col("b.end")) & (F.col("b.start") < F.col("r.end"))
    return r.join(b, on, "left_semi").drop("bin").distinct()


def intervals_near(reads: DataFrame, bed: DataFrame, width: int = BIN) -> DataFrame:
    """Reads (contig, pos0, span) that share a bin of ``width`` positions, or its neighbours, with an interval: a coarse filter that loses no read over one.

    A read spans less than two bins or is kept. The bins are as few as the
    intervals touch, and a read joins once.
    """
    touched = clean_bed(bed).select("contig", F.explode(F.sequence(F.floor(F.col("start") / width) - 2, F.floor((F.col("end") - 1) / width) + 1)).alias("bin")).distinct()
    long = F.col("span") > width
    own = reads.withColumn("bin", F.floor(F.col("pos0") / width))
    return own.where(~long).join(touched, ["contig", "bin"], "left_semi").unionByName(own.where(long)).drop("bin", "span")


def plan_chunks(index: DataFrame, chunk: int = 10_000_000, all_contigs: bool = False) -> DataFrame:
    """contig, start, end: pieces of ``chunk`` positions of the contigs in a FASTA index, from 0; the last ends with its contig."""
    known = F.regexp_replace("contig", "^chr", "").isin(MAIN_CONTIGS)
    rows = index if all_contigs else index.where(known)
    rows = rows.where("length > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / chunk))))
    return rows.select("contig", (F.col("k") * chunk).alias("start"), F.least((F.col("k") + 1) * chunk, F.col("length")).alias("end"))


def near_variants(variants: DataFrame, low: int = 15, high: int = 16) -> DataFrame:
    """contig, pos: positions low to high away from a variant, closer than low to none."""
    sites = variants.select("contig", "pos").distinct()
    spread = sites.withColumn("offset", F.explode(F.sequence(F.lit(-high), F.lit(high)))).select("contig", (F.col("pos") + F.col("offset")).alias("pos"), F.abs("offset").alias("away"))
    near = spread.where(F.col("pos") > 0).groupBy("contig", "pos").agg(F.min("away").alias("away"))
    return near.where(F.col("away") >= low).select("contig", "pos")
