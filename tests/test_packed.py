"""Counts made by numpy where the reads lie, against expand() and groupings."""

import random

from pyspark.sql import functions as F
from strandflow.operators import packed, reads, tensors

SCHEMA = "ord long, contig string, pos0 long, mapq int, flag int, cigar string, seq string"
CIGARS = ["20M", "2I18M", "5M3D15M", "10M30N10M", "3S17M", "8M4I8M", "2D20M", "4=2X4=", "3H10M", "5M1P5M", "8M2I", "1M40I1M", "3M1I2M1D4M", "19S20M", "*", "", "0M5M", "M5M", "12x3M", "100M", "20000D4M"]


def made(spark):
    rng = random.Random(21)
    rows = [(i, rng.choice(["chr1", "chr2"]), rng.choice([rng.randrange(0, 200), packed.BUCKET - rng.randrange(30), 0]), rng.choice([3, 60]), rng.choice([0, 16, 4, 256]), rng.choice(CIGARS), "".join(rng.choice("ACGTNRacgt=.") for _ in range(rng.choice([20, 42])))) for i in range(600)]
    rows += [(601, "chr1", 50, 60, 0, "4M", None), (602, "chr1", 50, 60, 0, None, "ACGT"), (603, "chr1", 50, 60, 0, "4M", "AéGT")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    assert sorted(map(str, a.select(names).collect())) == sorted(map(str, b.select(names).collect()))


def test_counts_equal_those_of_expanded_reads(spark):
    rows = made(spark)
    for soft in (True, False):
        same(packed.pileup_counts(rows, 5, soft), reads.pileup_counts(reads.expand(reads.filter_reads(rows, 5, soft))))
    plain = rows.where("ord < 602 AND seq IS NOT NULL")
    same(packed.event_counts(plain, 5), reads.expand(reads.filter_reads(plain, 5)).groupBy("contig", "r", "kind", "k", "base", "reverse").agg(F.count("*").alias("n")))


def test_position_counts_equal_those_of_events(spark):
    rows = made(spark)
    rng = random.Random(22)
    reference = spark.createDataFrame([(c, p, rng.choice("ACGTNX")) for c in ("chr1", "chr2") for p in [*range(300), *range(packed.BUCKET - 40, packed.BUCKET + 60)]], "contig string, pos0 long, base string")
    same(tensors.position_counts_of(rows, reference, 5), tensors.position_counts(reads.expand(reads.filter_reads(rows, 5, soft_clip=False)), reference))


def test_pileup_hands_on_counts_not_events(spark):
    """A task's rows are as many as the buckets that its reads touch, however deep these lie."""
    rows = spark.range(5000).select(F.col("id").alias("ord"), F.lit("chr1").alias("contig"), F.col("id") % 50, F.lit(60).alias("mapq"), F.lit(0).alias("flag"), F.lit("4M").alias("cigar"), F.lit("ACGT").alias("seq")).toDF(*SCHEMA.replace(" long", "").replace(" int", "").replace(" string", "").split(", ")).coalesce(2)
    assert packed.parts_of(rows, packed._pileup_code, 8).count() <= 2
    assert packed.pileup_counts(rows).agg(F.sum(F.col("A") + F.col("C") + F.col("G") + F.col("T"))).first()[0] == 20_000
