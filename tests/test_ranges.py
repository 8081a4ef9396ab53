"""Blocked gzip, BAM and tabix: round trips, regions, byte counts and split files."""

import gzip
import os
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from strandflow.operators.reads import touching
from strandflow.sources import bam, bgzf, files, tabix

COLUMNS = ["contig", "pos0", "mapq", "flag", "cigar", "seq"]
CONTIGS = [("chr1", 900_000), ("chr2", 900_000), ("chrEmpty", 10)]


def rows_of(df):
    return sorted(map(str, df.select(*COLUMNS).collect()))


def moved_index(path, ending):
    os.rename(path + ending, path + ".away")


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        n = rng.choice([1, 2, 31, 32, 150])
        cigar = rng.choice([f"{n}M", f"{n}M", f"{n}S", f"{n}=", f"{n}M20000N", f"{n}M7D", "*"])
        rows.append((i, rng.choice(["chr1", "chr2"]), rng.randrange(800_000), rng.randrange(61), rng.choice([0, 16, 4, 1024]), cigar, "".join(rng.choice("ACGTNRMK") for _ in range(n))))
    rows += [(9000 + i, "chr1", 500_000, 60, 0, "100M", "A" * 100) for i in range(2000)]  # many reads at one place
    rows += [(20_000, "chr1", 10, 60, 0, "5M", "*"), (20_001, None, None, 0, 4, "*", "ACG"), (20_002, "chr1", 0, 1, 0, "90000M", "C" * 90_000)]
    rows += [(20_003, "chr2", 100, 9, 0, "".join("1M1I" for _ in range(40_000)), "G" * 80_000)]
    return spark.createDataFrame(rows, "ord long, contig string, pos0 long, mapq int, flag int, cigar string, seq string").cache()


@pytest.fixture(scope="module")
def bam_file(reads, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "x.bam")
    bam.write_bam(reads, CONTIGS, path)
    return path


def plain_bam(path):
    """Rows of a BAM file by a plain walk over its data."""
    data = gzip.open(path).read()
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    n, names, at = struct.unpack_from("<i", data, at)[0], [], at + 4
    for _ in range(n):
        size = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    while at < len(data):
        size, contig, pos, name, mapq, _, ops, flag, bases = struct.unpack_from("<iiiBBHHHi", data, at)
        codes = struct.unpack_from(f"<{ops}I", data, at + 36 + name)
        packed = data[at + 36 + name + 4 * ops :][: (bases + 1) // 2]
        seq = "".join(bam.BASES[x >> 4] + bam.BASES[x & 15] for x in packed)[:bases]
        yield names[contig] if contig >= 0 else None, pos if pos >= 0 else None, mapq, flag, "".join(f"{c >> 4}{bam.OPS[c & 15]}" for c in codes) or "*", seq or "*"
        at += 4 + size


def test_bam_round_trip(spark, reads, bam_file):
    got = bam.read_bam(spark, bam_file)
    assert rows_of(got) == rows_of(reads)
    assert got.orderBy("ord").select("contig", "pos0").collect() == got.select("contig", "pos0").orderBy(F.col("contig").asc_nulls_last(), "pos0").collect()
    plain = [x for x in plain_bam(bam_file) if len(x[5]) != 80_000]  # whose CIGAR is in a tag
    assert sorted(map(str, plain)) == sorted(str(tuple(r)) for r in reads.select(*COLUMNS).where("length(cigar) < 100").collect())
    assert gzip.open(bam_file).read()  # every member's checksum holds
    assert not [f for f in os.listdir(os.path.dirname(bam_file)) if ".part-" in f or ".joining" in f]


@pytest.mark.parametrize("indexed", [True, False])
@pytest.mark.parametrize("target", [16 << 20, 70_000, 5_000])
def test_bam_splits(spark, reads, bam_file, indexed, target):
    if not indexed:
        moved_index(bam_file, ".bai")
    try:
        got = bam.read_bam(spark, bam_file, target_bytes=target)
        assert target > 1 << 20 or got.rdd.getNumPartitions() > 2
        assert rows_of(got) == rows_of(reads)
    finally:
        if not indexed:
            os.rename(bam_file + ".away", bam_file + ".bai")


REGIONS = [("chr1", 1, 1), ("chr1", 499_999, 500_001), ("chr2", 700_000, 700_300), ("chr2", 16_384, 16_385), ("chr1", 800_000, 5_000_000), ("chrEmpty", 1, 5), ("chrNone", 1, 5), ("chr2", None, None)]


@pytest.mark.parametrize("region", REGIONS)
def test_bam_regions(spark, reads, bam_file, region):
    want = touching(reads.where(F.col("contig") == region[0]), *region[1:])
    assert rows_of(bam.read_bam(spark, bam_file, *region)) == rows_of(want)


def test_bam_region_reads_its_members_only(bam_file):
    f, size = bgzf.open_file(bam_file)
    reader = bam.BamReader({"path": bam_file, "contig": "chr2", "low": "700000", "high": "700300"})
    fetched = 0
    for p in reader.partitions():
        members = bgzf.Members(f, size)
        header = bgzf.Members(f, size)
        bam.read_header(header)
        assert sum(b.num_rows for b in reader.rows(p, members))
        fetched += members.read - header.read
    assert fetched < size / 3


def test_bam_pushes_filters(spark, reads, bam_file):
    test = "contig = 'chr2' AND pos0 >= 1000 AND pos0 < 200000 AND mapq > 30"
    got = bam.read_bam(spark, bam_file).where(test)
    assert rows_of(got) == rows_of(reads.where(test))
    filters = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter" in line]
    assert all("200000" not in line and "chr2" not in line for line in filters)
    assert rows_of(bam.read_bam(spark, bam_file, min_mapq=20, without_flags=4)) == rows_of(reads.where("mapq >= 20 AND (flag & 4) = 0"))
    assert rows_of(bam.read_bam(spark, bam_file).where("contig IN ('chr1', 'x') AND pos0 = 500000")) == rows_of(reads.where("contig = 'chr1' AND pos0 = 500000"))


def test_bam_rows_over_member_ends(spark, tmp_path, reads):
    """A file whose members are cut anywhere, as some writers do, without an index."""
    source = str(tmp_path / "a.bam")
    bam.write_bam(reads, CONTIGS, source)
    data, cut = gzip.open(source).read(), str(tmp_path / "b.bam")
    with open(cut, "wb") as out:
        for k in range(0, len(data), 7919):
            out.write(bgzf.deflate(data[k : k + 7919]))
        out.write(bgzf.END)
    for target in (16 << 20, 20_000):
        assert rows_of(bam.read_bam(spark, cut, target_bytes=target)) == rows_of(reads)


def test_empty_bam(spark, reads, tmp_path):
    path = str(tmp_path / "none.bam")
    bam.write_bam(reads.limit(0), CONTIGS, path)
    assert bam.read_bam(spark, path).count() == 0 and bam.read_bam(spark, path, "chr1", 1, 10).count() == 0


def test_members():
    rng = random.Random(2)
    for data in (b"", b"x", bytes(rng.randrange(256) for _ in range(bgzf.MEMBER)), b"A" * bgzf.MEMBER):
        member = bgzf.deflate(data)
        assert bgzf.member_size(member) == len(member) <= 1 << 16 and bgzf.inflate(member) == data == gzip.decompress(member)
    assert bgzf.member_size(bgzf.END) == len(bgzf.END) and bgzf.member_size(gzip.compress(b"x") + b"0" * 20) == 0
    assert zlib.crc32(b"") == 0


def test_bins():
    assert bgzf.bin_of(0, 1) == 4681 and bgzf.bin_of(0, 1 << 14) == 4681 and bgzf.bin_of(0, (1 << 14) + 1) == 585 and bgzf.bin_of((1 << 26) - 1, (1 << 26) + 1) == 0
    rng = random.Random(1)
    for _ in range(300):
        s = rng.randrange(1 << 28)
        e = s + rng.randrange(1, 1 << rng.randrange(1, 27))
        x = rng.randrange(max(0, s - 50), e + 50)
        touches = any(bgzf.bin_of(s, e) in group for group in bgzf.bins_over(x, x + 1))
        assert touches or not s <= x < e


@pytest.fixture(scope="module")
def vcf_file(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(rng.choice(["chr1", "chr2", "odd"]), rng.randrange(1, 300_000), "A" * rng.choice([1, 1, 40_000 if i % 500 == 0 else 3]), "C", i % 60, ".", "0/1", 5, 9, 0.25) for i in range(5000)]
    calls = spark.createDataFrame(rows, "contig string, pos long, ref string, alt string, qual int, filter string, gt string, gq int, dp int, af double")
    path = str(tmp_path_factory.mktemp("vcf") / "x.vcf.gz")
    files.write_vcf_file(calls, CONTIGS, path)
    return rows, path


@pytest.mark.parametrize("target", [16 << 20, 9_000, 700])
def test_lines_of_split_files(spark, vcf_file, target):
    text = gzip.open(vcf_file[1]).read().decode().split("\n")[:-1]
    assert len(text) == 5000 + 15 and re.match("#CHROM", text[14])
    body = [(["chr1", "chr2", "chrEmpty", "odd"].index(c), int(p)) for c, p in (x.split("\t")[:2] for x in text[15:])]
    assert body == sorted(body)
    got = tabix.read_lines(spark, vcf_file[1], target_bytes=target)
    assert [r.value for r in got.orderBy("ord").collect()] == text


@pytest.mark.parametrize("region", [("chr1", 1, 100), ("chr2", 150_000, 151_000), ("odd", 299_000, 400_000), ("odd", None, None), ("none", 1, 2)])
def test_vcf_regions(spark, vcf_file, region):
    rows, path = vcf_file
    contig, start, end = region
    got = files.read_vcf(spark, path, *region)
    assert sorted((r.contig, r.pos, r.ref, r.alt) for r in got.collect()) == sorted(r[:4] for r in rows if r[0] == contig and (start is None or start <= r[1] <= end))


def test_vcf_region_reads_its_members_only(vcf_file):
    f, size = bgzf.open_file(vcf_file[1])
    reader = tabix.LineReader({"path": vcf_file[1], "contig": "chr2", "low": "150000", "high": "151000"})
    fetched = 0
    for p in reader.partitions():
        members = bgzf.Members(f, size)
        assert sum(b.num_rows for b in reader.rows(p, members))
        fetched += members.read
    assert 0 < fetched < size


def test_index_survives_packing(vcf_file):
    index = tabix.read_index(vcf_file[1])
    assert list(index) == ["chr1", "chr2", "odd"]
    again = bgzf.ContigIndex.unpack(index["chr1"].pack(), 0)[0]
    assert dict(again.bins) == dict(index["chr1"].bins)


def test_lines_over_member_ends(spark, tmp_path):
    lines = ["x" * (k % 97) + str(k) for k in range(20_000)] + ["", "y" * 200_000, "last without an end"]
    data, path = "\n".join(lines).encode(), str(tmp_path / "a.gz")
    with open(path, "wb") as out:
        for k in range(0, len(data), 5003):
            out.write(bgzf.deflate(data[k : k + 5003]))
        out.write(bgzf.END)
    for target in (1 << 20, 10_000):
        assert [r.value for r in tabix.read_lines(spark, path, target_bytes=target).orderBy("ord").collect()] == lines
