"""Text sources and sinks of the field's formats as DataFrames.

Plain and gzip files, one or many; partition pruning and column pruning are
Spark's. ``ord`` follows the order of lines in a file. Text sinks sort by
contig and position first; their parts are in that order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import CHANNELS, FLANK, ROWS, WIDTH
from ..operators import ordered
from ..operators.reads import touching
from . import bgzf, tabix
from .shared import file_system

SIZE = WIDTH * 32
#: Positions that a region of reads is widened by on both sides for candidates.
WIDEN = 1_000_000


def _lines(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return rows if comment is None else rows.where(~F.col("value").startswith(comment))


def read_sam(spark: SparkSession, path: str, contig: str | None = None, start: int | None = None, end: int | None = None, widen: int = 0) -> DataFrame:
    """ord, contig, pos0, mapq, flag, cigar, seq of SAM text; of a contig and of reads over 1-based positions start to end, widened by ``widen``."""
    part = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(part, F.lit(i))
    rows = _lines(spark, path, "@").select("ord", at(2).alias("contig"), (at(3).cast("long") - 1).alias("pos0"), at(4).cast("int").alias("mapq"), at(1).cast("int").alias("flag"), at(5).alias("cigar"), F.upper(at(9)).alias("seq"))
    return touching(rows if contig is None else rows.where(F.col("contig") == contig), start, end, widen)


def read_fasta(spark: SparkSession, path: str, contig: str | None = None, start: int | None = None, end: int | None = None, chunk: int = 1_000_000) -> DataFrame:
    """contig, pos0, base of an indexed FASTA file, a row for each position; of a contig and of 1-based positions start to end.

    The index gives each contig's offset and line width, so a task reads its
    ``chunk`` positions by their byte range.
    """
    index = spark.read.csv(f"{path}.fai", sep="\t", schema="contig string, length long, at long, line long, width long").where("length > 0")
    index = index if contig is None else index.where(F.col("contig") == contig)
    plan = index.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))))
    plan = plan.withColumn("last", F.least(F.col("first") + chunk, F.col("length")))
    if start is not None and end is not None:
        plan = plan.withColumn("first", F.greatest("first", F.lit(max(start, 1) - 1))).withColumn("last", F.least("last", F.lit(end))).where("first < last")
    schema = pa.schema([("contig", pa.string()), ("pos0", pa.int64()), ("base", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = file_system(path)
        for batch in batches:
            for row in batch.to_pylist():
                place = lambda p, r=row: r["at"] + p // r["line"] * r["width"] + p % r["line"]
                with fs.open_input_file(where) as f:
                    text = f.read_at(place(row["last"] - 1) + 1 - place(row["first"]), place(row["first"]))
                text = text.translate(None, b"\r\n").upper()
                n = len(text)
                base = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32)), pa.py_buffer(text)])
                yield pa.RecordBatch.from_arrays([pa.array([row["contig"]]).take(pa.array(np.zeros(n, np.int64))), pa.array(row["first"] + np.arange(n)), base], schema=schema)

    return plan.repartition("contig", "first").mapInArrow(run, "contig string, pos0 long, base string")


def read_fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """The same of a file without an index; each record must fit a task."""
    records = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^\s*(\S+)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    return records.select(head.alias("contig"), F.posexplode(F.split(body, "")).alias("pos0", "base")).where("base <> ''").select("contig", F.col("pos0").cast("long").alias("pos0"), "base")


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="contig string, length long, at long, line int, width int").select("contig", "length")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end; intervals of no length get one."""
    part = F.split(F.trim("value"), r"\s+")
    start, end = F.get(part, F.lit(1)).cast("long"), F.get(part, F.lit(2)).cast("long")
    return _lines(spark, path).where(F.length(F.trim("value")) > 0).select(F.get(part, F.lit(0)).alias("contig"), start.alias("start"), F.when(start == end, end + 1).otherwise(end).alias("end"))


def read_vcf(spark: SparkSession, path: str, contig: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """ord, contig, pos, ref, alt, qual, gt (text before a colon in the last column).

    Of a blocked gzip file with an index beside it (``.tbi``) only the members of the region are read.
    """
    part = F.split("value", r"\s+")
    lines = tabix.read_lines(spark, path, contig, start, end).where(~F.col("value").startswith("#")) if has_index(path) else _lines(spark, path, "#")
    rows = lines.select("ord", F.get(part, F.lit(0)).alias("contig"), F.get(part, F.lit(1)).cast("long").alias("pos"), F.get(part, F.lit(3)).alias("ref"), F.get(part, F.lit(4)).alias("alt"), F.try_to_number(F.get(part, F.lit(5)), F.lit("999999.99")).cast("int").alias("qual"), F.split(F.element_at(part, -1), ":")[0].alias("gt"))
    rows = rows if contig is None else rows.where(F.col("contig") == contig)
    return rows if start is None or end is None else rows.where(F.col("pos").between(start, end))


def has_index(path: str) -> bool:
    return path.endswith(".gz") and bgzf.read_all(f"{path}.tbi") is not None


def read_vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """ord and value of a VCF's header lines."""
    return _lines(spark, path).where(F.col("value").startswith("#")).select("ord", "value")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """ord, contig, pos, ref, alt (the first two), qual and the last two columns of VCF body lines, as overlap removal takes them."""
    part = F.split("value", "\t")
    qual = F.floor(F.get(part, F.lit(5)).cast("double")).cast("int")
    return _lines(spark, path, "#").select("ord", F.get(part, F.lit(0)).alias("contig"), F.get(part, F.lit(1)).cast("long").alias("pos"), F.get(part, F.lit(3)).alias("ref"), F.array_join(F.slice(F.split(F.get(part, F.lit(4)), ","), 1, 2), ",").alias("alt"), qual.alias("qual"), F.get(part, F.lit(7)).alias("info"), F.get(part, F.lit(8)).alias("format"), F.get(part, F.lit(9)).alias("sample"))


def call_line() -> Column:
    """A line of read_calls()'s columns; ID and FILTER come out as dots."""
    return F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.col("qual").cast("string"), F.lit("."), "info", "format", "sample")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """contig and pos, the first two fields of candidate or truth rows."""
    part = F.split("value", r"\s+", 3)
    return _lines(spark, path).select("ord", F.get(part, F.lit(0)).alias("contig"), F.get(part, F.lit(1)).cast("long").alias("pos"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """ord, contig, pos, ref, alt, gt1, gt2 of truth lines."""
    part = F.split("value", r"\s+")
    return _lines(spark, path).select("ord", F.get(part, F.lit(0)).alias("contig"), F.get(part, F.lit(1)).cast("long").alias("pos"), F.get(part, F.lit(2)).alias("ref"), F.get(part, F.lit(3)).alias("alt"), F.get(part, F.lit(4)).cast("int").alias("gt1"), F.get(part, F.lit(5)).cast("int").alias("gt2"))


def tensor_line(x: Column) -> Column:
    return F.concat_ws(" ", "contig", F.col("pos").cast("string"), "seq", F.array_join(F.transform(x, lambda n: n.cast("string")), " "))


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """ord, contig, pos, seq, x (1056 floats)."""
    part = F.split("value", r"\s+")
    return _lines(spark, path).select("ord", F.get(part, F.lit(0)).alias("contig"), F.get(part, F.lit(1)).cast("long").alias("pos"), F.get(part, F.lit(2)).alias("seq"), F.slice(part, 4, SIZE).cast("array<float>").alias("x"))


def write_lines(rows: DataFrame, line: Column, path: str, gzip: bool = True, order: tuple[str, ...] = ("contig", "pos")) -> None:
    """Text parts in the order of ``order``."""
    rows.select(*order, line.alias("value")).orderBy(*order).select("value").write.mode("overwrite").text(path, compression="gzip" if gzip else "none")


def candidate_line() -> Column:
    return F.concat_ws(" ", "contig", F.col("pos").cast("string"), "ref", F.col("depth").cast("string"), "counts")


def truth_line() -> Column:
    return F.concat_ws(" ", "contig", F.col("pos").cast("string"), "ref", "alt", F.col("gt1").cast("string"), F.col("gt2").cast("string"))


def probability_line() -> Column:
    """contig, pos, seq, x and the 90 probabilities p with six decimals, by tabs."""
    return F.concat_ws("\t", "contig", F.col("pos").cast("string"), "seq", F.array_join(F.transform("x", lambda n: n.cast("int").cast("string")), "\t"), F.array_join(F.transform("p", lambda v: F.format_string("%.6f", v)), "\t"))


def read_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """ord, contig, pos, seq, x, g, z, u, v."""
    part = F.split("value", "\t")
    cut = lambda first, n: F.slice(part, first, n).cast("array<double>")
    at = 4 + SIZE
    return _lines(spark, path).select("ord", F.get(part, F.lit(0)).alias("contig"), F.get(part, F.lit(1)).cast("long").alias("pos"), F.get(part, F.lit(2)).alias("seq"), F.slice(part, 4, SIZE).cast("array<int>").alias("x"), cut(at, 21).alias("g"), cut(at + 21, 3).alias("z"), cut(at + 24, WIDTH).alias("u"), cut(at + 24 + WIDTH, WIDTH).alias("v"))


def vcf_line() -> Column:
    """VCF body line of finished calls."""
    sample = F.format_string("%s:%d:%d:%.4f", "gt", "gq", "dp", "af")
    return F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.col("qual").cast("string"), "filter", F.lit("."), F.lit("GT:GQ:DP:AF"), sample)


def vcf_header(contigs: list[tuple[str, int]], sample: str = "SAMPLE") -> str:
    # Header lines of the format.
    fixed = [
        "##fileformat=VCFv4.1",
        '##FILTER=<ID=PASS,Description="All filters passed">',
        '##FILTER=<ID=LowQual,Description="Confidence in this variant being real is below calling threshold.">',
        '##ALT=<ID=DEL,Description="Deletion">',
        '##ALT=<ID=INS,Description="Insertion of novel sequence">',
        '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">',
        '##INFO=<ID=LENGUESS,Number=.,Type=Integer,Description="Best guess of the indel length">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype Quality">',
        '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read Depth">',
        '##FORMAT=<ID=AF,Number=1,Type=Float,Description="Estimated allele frequency in the range (0,1)">',
    ]
    return "\n".join([*fixed, *(f"##contig=<ID={c},length={n}>" for c, n in contigs), "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]) + "\n"


def write_vcf(calls: DataFrame, contigs: list[tuple[str, int]], path: str) -> None:
    """Header and body, sorted by position, as text parts in order; the header is a part of its own in front."""
    spark = calls.sparkSession
    rank = F.coalesce(F.array_position(F.array(*(F.lit(c) for c, _ in contigs)), F.col("contig")), F.lit(0)) if contigs else F.lit(0)
    body = calls.select(rank.alias("c"), F.col("pos").alias("p"), vcf_line().alias("value"))
    head = spark.createDataFrame([(-1, i, line) for i, line in enumerate(vcf_header(contigs).splitlines())], "c long, p long, value string")
    head.unionByName(body.select(F.col("c").cast("long").alias("c"), "p", "value")).orderBy("c", "p").select("value").write.mode("overwrite").text(path)


def write_vcf_file(calls: DataFrame, contigs: list[tuple[str, int]], path: str) -> None:
    """The same as one blocked gzip file (``.vcf.gz``) with its tabix index; contigs that the list lacks come last, by name."""
    rank = F.array_position(F.array(*(F.lit(c) for c, _ in contigs)), F.col("contig")) if contigs else F.lit(0)
    rank = F.when(rank > 0, rank).otherwise(len(contigs) + 1)
    tabix.write_lines(calls, vcf_line(), path, vcf_header(contigs), (rank, "contig", "pos"), F.length("ref"))


def write_bins(rows: DataFrame, path: str) -> None:
    """Training rows (block, contig, pos, x, y, split) as compressed Parquet by split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path, compression="zstd")


def read_bins(spark: SparkSession, *paths: str, split: str | None = None) -> DataFrame:
    """Rows of one or more bins with ``bin``, the name of the folder each came from; of one split, only its folder is read."""
    rows = None
    for path in paths:
        one = spark.read.parquet(path).withColumn("bin", F.lit(path.rstrip("/").rsplit("/", 1)[-1]))
        rows = one if rows is None else rows.unionByName(one)
    return rows if split is None else rows.where(F.col("split") == split)


def combine_bins(bins: list[DataFrame]) -> DataFrame:
    """All rows of several bins as one, whose blocks are numbered on in the order of the list and, in a bin, as they were."""
    rows = None
    for k, one in enumerate(bins):
        one = one.withColumn("nth_bin", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    sizes = rows.groupBy("nth_bin").agg((F.max("block") + 1).alias("blocks"))  # a row for each bin
    before = sizes.alias("a").join(F.broadcast(sizes).alias("b"), F.col("b.nth_bin") < F.col("a.nth_bin"), "left").groupBy("a.nth_bin").agg(F.coalesce(F.sum("b.blocks"), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "nth_bin").withColumn("block", F.col("block") + F.col("before")).drop("nth_bin", "before")


def train_with_validation(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Training and validation bins as one, with their split; the number of training rows is the size of its train part."""
    return combine_bins([train.withColumn("split", F.lit("train")), validation.withColumn("split", F.lit("validation"))])


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """nth and x (1056 numbers) of text files with numbers parted by commas and line ends; a file must fit a task."""
    numbers = F.filter(F.split("value", r"[,\s]+"), lambda x: x != "")
    rows = spark.read.text(path, wholetext=True).select(numbers.alias("all"))
    rows = rows.select("all", F.explode(F.sequence(F.lit(0), F.floor(F.size("all") / SIZE).cast("int") - 1)).alias("nth"))
    return rows.select("nth", F.slice("all", F.col("nth") * SIZE + 1, F.lit(SIZE)).cast("array<float>").alias("x"))


#: Rows and channels of a tensor plot.
ROW_NAMES = ["A+", "C+", "G+", "T+", "A-", "C-", "G-", "T-"]
CHANNEL_NAMES = ["reference", "insert", "delete", "snp"]


def plot_rows(tensors: DataFrame, *keys: str, most: int = -1) -> DataFrame:
    """keys, channel, row, idx, value: a tensor's four heat maps as rows, for any plotting tool; of ``most`` tensors in key order (all if negative)."""
    rows = tensors.select(*keys, "x")
    rows = rows if most < 0 else rows.orderBy(*keys).limit(most)
    long = rows.select(*keys, F.posexplode("x").alias("at", "value"))
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    return long.select(*keys, name(CHANNEL_NAMES, F.col("at") % CHANNELS).alias("channel"), name(ROW_NAMES, F.floor(F.col("at") / CHANNELS) % ROWS).alias("row"), F.floor(F.col("at") / (ROWS * CHANNELS)).cast("int").alias("idx"), "value")


def heat_map(x: np.ndarray, scale: int = 8) -> bytes:
    """A PNG image of a tensor's four heat maps, one below the other in the order of CHANNEL_NAMES.

    A cell is a square of ``scale`` pixels, white at 0, redder above and bluer
    below it up to the map's largest absolute value; ``scale`` white lines part the maps.
    """
    cells = np.nan_to_num(np.asarray(x, float)).reshape(WIDTH, ROWS, CHANNELS).transpose(2, 1, 0)
    share = cells / np.maximum(np.abs(cells).max(axis=(1, 2), keepdims=True), 1e-9)
    red, green, blue = (np.rint(255 * (1 - part)) for part in (np.maximum(-share, 0), np.abs(share), np.maximum(share, 0)))
    maps = np.stack([red, green, blue], axis=-1).astype(np.uint8).repeat(scale, axis=1).repeat(scale, axis=2)
    maps = np.pad(maps, ((0, 0), (0, scale), (0, 0), (0, 0)), constant_values=255)
    pixels = maps.reshape(-1, WIDTH * scale, 3)[:-scale]
    # each line of pixels begins with its filter type, 0
    lines = np.pad(pixels.reshape(len(pixels), -1), ((0, 0), (1, 0))).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH * scale, len(pixels), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def plot_images(tensors: DataFrame, *keys: str, most: int = -1, scale: int = 8) -> DataFrame:
    """name (the keys, joined by hyphens) and png: heat_map() of each tensor, of ``most`` in key order (all if negative); tensors of another size than 33 x 8 x 4 go."""
    rows = tensors.where(F.size("x") == SIZE)
    rows = rows if most < 0 else rows.orderBy(*keys).limit(most)
    named = rows.select(F.concat_ws("-", *(F.col(k).cast("string") for k in keys)).alias("name"), F.col("x").cast("array<double>").alias("x"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name")
            for k, x in enumerate(batch.column("x")):  # an image at a time, so that a task holds one
                yield pa.RecordBatch.from_arrays([names.slice(k, 1), pa.array([heat_map(x.values.to_numpy(zero_copy_only=False), scale)], pa.binary())], names=["name", "png"])

    return named.mapInArrow(run, "name string, png binary")


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Writes plot_images()'s rows as ``folder/name.png``, where names tell tensors apart; gives name and size of each file.

    A task that runs again writes the same files. Other signs than letters,
    digits, dots, hyphens and underscores become underscores. Nothing is written before the result is used.
    """
    named = images.select(F.regexp_replace("name", r"[^A-Za-z0-9._-]", "_").alias("name"), "png")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = file_system(folder)
        fs.create_dir(where, recursive=True)
        for batch in batches:
            sizes = []
            for name, png in zip(batch.column("name").to_pylist(), batch.column("png"), strict=True):
                with fs.open_output_stream(f"{where}/{name}.png") as f:
                    f.write(png.as_buffer())
                sizes.append(len(png.as_buffer()))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64())], names=["name", "size"])

    return named.mapInArrow(run, "name string, size long")


def list_folders(path: str) -> list[str]:
    """The folders in a folder, by name."""
    fs, where = file_system(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(where))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.type == pyarrow.fs.FileType.Directory]


def numbered_lines(spark: SparkSession, path: str, size: int = 3) -> DataFrame:
    """ord, line_no, value of text whose records take ``size`` lines each, in the order of file names and lines."""
    lines = _lines(spark, path).withColumn("file", F.input_file_name())
    at = F.col("nth") - 1
    return ordered.rank(lines, [], ["file", "ord"]).select(F.floor(at / size).alias("ord"), (at % size).cast("int").alias("line_no"), "value")


def bin_to_text(rows: DataFrame) -> DataFrame:
    """ord, line_no, value: three lines for each record (x, y, contig:pos)."""
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return rows.select("ord", F.posexplode(F.array(text("x"), text("y"), F.concat_ws(":", "contig", F.col("pos").cast("string")))).alias("line_no", "value"))


def text_to_bin(lines: DataFrame) -> DataFrame:
    """Records from bin_to_text()'s rows."""
    wide = lines.groupBy("ord").pivot("line_no", [0, 1, 2]).agg(F.first("value"))
    key = F.split("2", ":")
    return wide.select("ord", key[0].alias("contig"), key[1].cast("long").alias("pos"), F.split("0", " ").cast("array<float>").alias("x"), F.split("1", " ").cast("array<int>").alias("y"))


def region_text(contig: str, start: int | None, end: int | None) -> str:
    return f"{contig}:{start}-{end}" if start is not None and end is not None else ""


def with_prefix(rows: DataFrame, letter: str) -> DataFrame:
    """Rows of one sample with its letter before the contig, so that samples can be put together."""
    return rows.withColumn("contig", F.concat(F.lit(letter), "contig"))


def command_text(program: list[str], options: dict[str, object]) -> str:
    """A command line: None and False drop an option, True stands without a value, other values are quoted."""
    parts = [f"--{k}" if v is True else f'--{k} "{v}"' for k, v in options.items() if v is not None and v is not False]
    return " ".join([*program, *parts])


def centre(seq: Column) -> Column:
    return F.substring(seq, FLANK + 1, 1)
