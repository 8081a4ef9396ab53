"""Commands over text files: each reads its inputs, applies the library's operators and writes text, all on Spark.

``python -m strandflow.commands NAME --option value ...``; ``python -m
strandflow.commands --help`` lists them. Outputs are folders of text parts in
order.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bases import subtract_reference
from .operators import calls, intervals, metrics, network, reads, tensors, training, truth
from .plans import calling
from .sources import bam, files

COMMANDS: dict[str, tuple[Callable, list[tuple[str, type, object]]]] = {}


def command(*options: tuple[str, type, object]):
    """Registers a function (spark, options) with its options: name, type, default."""

    def keep(f):
        COMMANDS[f.__name__] = f, list(options)
        return f

    return keep


REGION = (("contig", str, None), ("start", int, None), ("end", int, None))


def _aligned(spark: SparkSession, o, widen: int = 0) -> DataFrame:
    """Reads of SAM text or, by its name, of a BAM file."""
    return (bam.read_bam if o.reads.endswith(".bam") else files.read_sam)(spark, o.reads, o.contig, o.start, o.end, widen)


def _reference(spark: SparkSession, o, around: int = 0) -> DataFrame:
    bounded = o.start is not None and o.end is not None
    return files.read_fasta(spark, o.ref, o.contig, max(o.start - around, 1) if bounded else None, o.end + around if bounded else None)


def _in_bed(spark: SparkSession, rows: DataFrame, bed: str | None, at: str) -> DataFrame:
    return rows if bed is None else intervals.points_in(rows, files.read_bed(spark, bed), at)


@command(("reads", str, None), ("ref", str, None), ("out", str, None), *REGION, ("bed", str, None), ("threshold", float, 0.125), ("min_coverage", int, 4), ("min_mapq", int, 0), ("training", bool, False), ("variants", str, None), ("chance", float, truth.PLAIN_CHANCE), ("seed", int, 0))
def extract_candidates(spark: SparkSession, o) -> None:
    """Candidate sites of aligned reads; with --training a random part of all sites, by whether they are near a variant."""
    aligned = reads.filter_reads(_aligned(spark, o, files.WIDEN), o.min_mapq)
    counts = reads.pileup_counts(reads.expand(aligned))
    sites = reads.candidates(counts, _reference(spark, o, files.WIDEN), 0.0 if o.training else o.threshold, o.min_coverage)
    sites = _in_bed(spark, reads.in_region(sites, o.start, o.end).withColumn("pos0", F.col("pos") - 1), o.bed, "pos0").drop("pos0")
    if o.training:
        known = None if o.variants is None else files.read_sites(spark, o.variants)
        sites = truth.training_gate(sites, known, plain_chance=o.chance, seed=o.seed)
        if known is not None:
            truth.near_tallies(sites).show()
    files.write_lines(sites, files.candidate_line(), o.out)


@command(("vcf", str, None), ("ref", str, None), ("out", str, None), *REGION)
def get_truth(spark: SparkSession, o) -> None:
    """Truth variants of a VCF."""
    vcf = files.read_vcf(spark, o.vcf, o.contig, o.start, o.end)
    files.write_lines(truth.truth_variants(vcf, _reference(spark, o, 1)), files.truth_line(), o.out)


@command(("reads", str, None), ("ref", str, None), ("sites", str, None), ("out", str, None), *REGION, ("min_mapq", int, 0), ("depth_cap", int, 250), ("min_coverage", int, 0), ("stop_left_edge", bool, False))
def create_tensors(spark: SparkSession, o) -> None:
    """Tensor lines of sites."""
    kept = reads.cap_depth(reads.filter_reads(_aligned(spark, o), o.min_mapq, soft_clip=False), o.depth_cap)
    sites = files.read_sites(spark, o.sites)
    sites = reads.in_region(sites if o.contig is None else sites.where(F.col("contig") == o.contig), o.start, o.end)
    events, reference = reads.expand(kept), _reference(spark, o, files.WIDEN)
    if o.stop_left_edge:
        rows = tensors.dense(tensors.window_cells_left_edge(sites, events, reference)).join(calling.site_sequences(sites, reference), ["contig", "pos"])
    else:
        rows = calling.tensor_rows(sites, events, reference, o.min_coverage)
    files.write_lines(rows, files.tensor_line(F.col("x")), o.out)


@command(("variants", str, None), ("candidates", str, None), ("out", str, None), ("bed", str, None), ("amplify", float, 2.0), ("seed", int, 0))
def pair_with_non_variants(spark: SparkSession, o) -> None:
    """Tensor lines of variants and of a sample of the other candidates."""
    v, c = files.read_tensors(spark, o.variants), files.read_tensors(spark, o.candidates)
    pairs = truth.pair_non_variants(v, c, o.amplify, o.seed, None if o.bed is None else files.read_bed(spark, o.bed))
    chosen = c.join(pairs.where("variant = 0").select("contig", "pos").distinct(), ["contig", "pos"], "left_semi")
    both = v.unionByName(chosen).withColumn("x", F.col("x").cast("array<int>"))
    files.write_lines(both, files.tensor_line(F.col("x")), o.out)


@command(("tensors", str, None), ("variants", str, None), ("out", str, None), ("bed", str, None), ("allow_duplicates", bool, False), ("seed", int, None), ("share", float, 0.9))
def tensors_to_bin(spark: SparkSession, o) -> None:
    """A training bin: tensors with labels, split and numbered in blocks."""
    labels = truth.variant_labels(files.read_truth(spark, o.variants))
    rows = truth.training_rows(files.read_tensors(spark, o.tensors), labels, o.allow_duplicates, None if o.bed is None else files.read_bed(spark, o.bed))
    made = truth.split_train(rows.withColumn("bin", F.lit("all")), o.share)
    files.write_bins(made if o.seed is None else truth.shuffled(made, o.seed, "contig", "pos"), o.out)


@command(("bins", str, None), ("out", str, None), ("seed", int, None))
def combine_bins(spark: SparkSession, o) -> None:
    """Several bins (parted by commas, or all in a folder) as one, in the order of their names or, with a seed, in an order of its own."""
    paths = sorted(o.bins.split(",")) if "," in o.bins else files.list_folders(o.bins)
    if o.seed is not None:
        paths = [paths[training.permuted(i, len(paths), o.seed)] for i in range(len(paths))]
    files.write_bins(files.combine_bins([files.read_bins(spark, path).drop("bin") for path in paths]), o.out)


@command(("bin", str, None), ("out", str, None))
def bin_to_text(spark: SparkSession, o) -> None:
    """Three lines for each record of a bin."""
    rows = files.read_bins(spark, o.bin).withColumn("ord", F.monotonically_increasing_id())
    lines = files.bin_to_text(rows)
    files.write_lines(lines, F.col("value"), o.out, gzip=False, order=("ord", "line_no"))


@command(("text", str, None), ("out", str, None))
def text_to_bin(spark: SparkSession, o) -> None:
    """A bin, all of it for training, from bin_to_text's lines."""
    made = truth.split_train(files.text_to_bin(files.numbered_lines(spark, o.text)).withColumn("bin", F.lit("all")), 1.0)
    files.write_bins(made, o.out)


def _weights(path: str) -> training.Weights:
    """The weights of a checkpoint that train wrote."""
    found = training.load(path)
    if found is None:
        raise FileNotFoundError(path)
    return found[0]


def _score(o) -> Callable[[DataFrame], DataFrame]:
    """Scores of tensors whose channels still hold channel 0."""
    weights = _weights(o.weights)

    def run(rows: DataFrame) -> DataFrame:
        scored = network.score(rows.withColumn("raw", F.col("x")).withColumn("x", subtract_reference(F.col("x"))), weights)
        return scored.withColumn("x", F.col("raw")).drop("raw")

    return run


CALLING = (("weights", str, None), ("out", str, None), ("qual", int, None), ("show_reference", bool, False), ("haploid", str, None), ("forced", bool, False), ("sample", str, "SAMPLE"), ("ensemble", bool, False))


def _contigs(spark: SparkSession, ref: str) -> list[tuple[str, int]]:
    return [(r.contig, r.length) for r in files.read_fai(spark, f"{ref}.fai").collect()]  # a row for each contig


@command(("reads", str, None), ("ref", str, None), ("tensors", str, None), ("probabilities", str, None), *REGION, *CALLING)
def call_variants(spark: SparkSession, o) -> None:
    """Calls of tensor lines, or of probability lines that an ensemble averaged."""
    if o.probabilities is not None:
        rows = files.read_probabilities(spark, o.probabilities)
    else:
        scored = _score(o)(files.read_tensors(spark, o.tensors).withColumn("x", F.col("x").cast("array<int>")))
        rows = scored.withColumn("x", subtract_reference(F.col("x")))
    if o.ensemble:
        basic = rows.where(files.centre(F.col("seq")).isin(*"ACGTU")).withColumn("p", F.concat("g", "z", "u", "v"))
        return files.write_lines(basic, files.probability_line(), o.out)
    events = reads.expand(reads.filter_reads(_aligned(spark, o), soft_clip=False))
    after = calling.site_sequences(rows, _reference(spark, o, files.WIDEN)).select("contig", "pos", "after")
    full = rows.join(after, ["contig", "pos"], "left").join(calls.read_indels(events), ["contig", "pos"], "left")
    done = calls.finish_calls(calls.decode(full, o.forced), o.qual, o.show_reference, o.haploid)
    # one indexed file, or a folder of parts
    (files.write_vcf_file if o.out.endswith(".gz") else files.write_vcf)(done, _contigs(spark, o.ref), o.out)


@command(("reads", str, None), ("ref", str, None), *REGION, ("bed", str, None), ("threshold", float, 0.125), ("min_coverage", int, 4), ("depth_cap", int, 250), *CALLING)
def call_reads(spark: SparkSession, o) -> None:
    """Calls of aligned reads: candidates, tensors, scores and VCF in one plan."""
    bed = None if o.bed is None else files.read_bed(spark, o.bed)
    done = calling.call_reads(
        _aligned(spark, o, files.WIDEN), _reference(spark, o, files.WIDEN), _score(o), bed=bed, start=o.start, end=o.end, threshold=o.threshold,
        min_coverage=o.min_coverage, depth_cap=o.depth_cap, qual=o.qual, show_reference=o.show_reference, haploid=o.haploid, forced=o.forced,
    )
    # one indexed file, or a folder of parts
    (files.write_vcf_file if o.out.endswith(".gz") else files.write_vcf)(done, _contigs(spark, o.ref), o.out)


@command(("ref", str, None), ("bed", str, None), ("chunk", int, 10_000_000), ("all_contigs", bool, False), ("prefix", str, "var"), ("arguments", str, ""))
def plan_calls(spark: SparkSession, o) -> None:
    """Prints a call_reads command for each chunk of the reference that a BED touches."""
    chunks = intervals.plan_chunks(files.read_fai(spark, f"{o.ref}.fai"), o.chunk, o.all_contigs)
    chunks = chunks if o.bed is None else intervals.intervals_overlapping(chunks, files.read_bed(spark, o.bed))
    for r in chunks.orderBy("contig", "start").toLocalIterator():
        own = {"contig": r.contig, "start": r.start, "end": r.end, "out": f"{o.prefix}.{r.contig}_{r.start}_{r.end}.vcf", "bed": o.bed, "ref": o.ref}
        print(files.command_text(["python", "-m", "strandflow.commands", "call_reads", *([o.arguments] if o.arguments else [])], own))


@command(("bin", str, None), ("weights", str, None))
def evaluate(spark: SparkSession, o) -> None:
    """Confusion counts, F1 and top-2 hits of a model on a bin."""
    weights = _weights(o.weights)
    rows = network.score(files.read_bins(spark, o.bin).select("contig", "pos", "x", "y"), weights)
    first = lambda at, n: F.array_position(F.slice("y", at, n), 1).cast("int") - 1
    labels = rows.withColumns({"gt21": first(1, 21), "zyg": first(22, 3), "len1": first(25, 33), "len2": first(58, 33)})
    metrics.evaluate(labels).orderBy("task", "metric", "truth", "pred").show(5000, truncate=False)


@command(("probabilities", str, None), ("out", str, None), ("least", int, 0))
def ensemble(spark: SparkSession, o) -> None:
    """Means of the probability lines of several runs (folders parted by commas), of sites with enough of them."""
    rows = None
    for k, path in enumerate(o.probabilities.split(",")):
        one = files.read_probabilities(spark, path).withColumn("ord", F.lit(k)).withColumn("p", F.concat("g", "z", "u", "v"))
        rows = one if rows is None else rows.unionByName(one)
    files.write_lines(calls.average_runs(rows, o.least), files.probability_line(), o.out)


@command(("vcf", str, None), ("out", str, None))
def remove_overlaps(spark: SparkSession, o) -> None:
    """A VCF without calls that overlap a better one."""
    rows = files.read_calls(spark, o.vcf)
    kept = calls.remove_overlaps(rows).select(F.lit(1).alias("part"), "contig", "pos", files.call_line().alias("value"))
    head = files.read_vcf_header(spark, o.vcf).select(F.lit(0).alias("part"), F.lit("").alias("contig"), F.col("ord").alias("pos"), "value")
    files.write_lines(head.unionByName(kept), F.col("value"), o.out, gzip=False, order=("part", "contig", "pos"))


@command(("arrays", str, None), ("out", str, None), ("most", int, -1))
def plot_rows(spark: SparkSession, o) -> None:
    """The heat maps of tensors in text arrays, as CSV rows."""
    files.plot_rows(files.read_arrays(spark, o.arrays), "nth", most=o.most).write.mode("overwrite").csv(o.out, header=True)


@command(("arrays", str, None), ("out", str, None), ("most", int, -1), ("scale", int, 8))
def plot_tensors(spark: SparkSession, o) -> None:
    """The heat maps of tensors in text arrays, as a PNG file for each."""
    images = files.plot_images(files.read_arrays(spark, o.arrays), "nth", most=o.most, scale=o.scale)
    files.write_images(images, o.out).write.format("noop").mode("overwrite").save()


TRAINING = (("hidden", int, 128), ("slices", int, 30), ("dense", int, 192), ("head", int, 96), ("optimizer", str, "adam"), ("loss", str, "focal"), ("weights", str, None), ("seed", int, 0))


def _begin(o) -> training.Weights:
    return network.random_weights(o.seed, o.hidden, o.slices, o.dense, o.head) if o.weights is None else _weights(o.weights)


@command(("bin", str, None), ("out", str, None), ("epochs", int, 30), ("rate", float, 1e-3), ("l2", float, 0.005), ("resume", int, None), ("blocks", int, 20), *TRAINING)
def train(spark: SparkSession, o) -> None:
    """Trains on a bin at rates that decay with the validation loss; a checkpoint (out-NNNNNN.npz) for each epoch."""
    start = training.Progress(rate=o.rate, l2=o.l2)
    _, done = training.train(spark.read.parquet(o.bin), _begin(o), o.out, o.epochs, start, training.Optimizer(o.optimizer), o.blocks, o.loss, seed=o.seed, resume=o.resume)
    for epoch, losses in enumerate(zip(done.training, done.validation, strict=True), 1):
        print(epoch, *losses)


@command(("bin", str, None), ("out", str, None), ("epochs", int, 30), ("low", float, 1e-4), ("high", float, 3e-2), ("half", int, 1), ("mode", str, "tri"), ("l2", float, 0.005), ("resume", int, None), ("blocks", int, 20), *TRAINING)
def train_cyclical(spark: SparkSession, o) -> None:
    """The same at a rate that goes up and down."""
    start = training.Progress(l2=o.l2)
    training.train(spark.read.parquet(o.bin), _begin(o), o.out, o.epochs, start, training.Optimizer(o.optimizer), o.blocks, o.loss, (o.half, o.low, o.high, o.mode), seed=o.seed, resume=o.resume)


@command(("bin", str, None), ("out", str, None), ("low", float, 1e-6), ("high", float, 1e-1), ("points", int, 10), ("steps", int, 20), *TRAINING)
def find_rates(spark: SparkSession, o) -> None:
    """Losses and accuracies of short trainings at rates from low to high, as CSV rows."""
    rates = [o.low * (o.high / o.low) ** (k / max(o.points - 1, 1)) for k in range(o.points)]
    sweep = training.rate_sweep(spark.read.parquet(o.bin).where("split = 'train'"), _begin(o), rates, o.steps, loss=o.loss, optimizer=o.optimizer, seed=o.seed)
    sweep.write.mode("overwrite").csv(o.out, header=True)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandflow", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        own = sub.add_parser(name, help=f.__doc__)
        for option, kind, default in options:
            if kind is bool:
                own.add_argument(f"--{option}", action="store_true")
            else:
                own.add_argument(f"--{option}", type=kind, default=default)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(arguments)
    COMMANDS[o.command][0](spark or SparkSession.builder.getOrCreate(), o)


if __name__ == "__main__":
    main()
