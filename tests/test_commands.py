"""The commands end to end on a made-up contig with planted variants."""

import gzip
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandflow import commands
from strandflow.functions import bases as B
from strandflow.operators import network, training
from strandflow.sources import bam, files


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A reference of two contigs in lines of 60, reads of 80 bases, a SNP at 500, an insertion after 700 and a deletion after 900."""
    rng = random.Random(4)
    root = tmp_path_factory.mktemp("genome")
    contigs = {"chr1": "".join(rng.choice("ACGT") for _ in range(1303)), "chrU": "ACGTN" * 20}
    text, index, at = "", "", 0
    for name, seq in contigs.items():
        head = f">{name} made\n"
        body = "".join(f"{seq[i : i + 60]}\n" for i in range(0, len(seq), 60))
        index += f"{name}\t{len(seq)}\t{at + len(head)}\t60\t61\n"
        text, at = text + head + body, at + len(head) + len(body)
    (root / "ref.fa").write_text(text)
    (root / "ref.fa.fai").write_text(index)
    seq = contigs["chr1"]
    snp = "ACGT"[("ACGT".index(seq[499]) + 1) % 4]
    reads = ["@HD\tVN:1.6"]
    for start in sorted(rng.randrange(300, 1150) for _ in range(600)):
        own, cigar = list(seq[start : start + 80]), "80M"
        if start <= 499 < start + 80:
            own[499 - start] = snp
        for place, kind in ((700, "I"), (900, "D")):
            cut = place - start
            if 10 < cut < 70:
                if kind == "I":
                    own, cigar = own[:cut] + list("GATTACA") + own[cut:], f"{cut}M7I{80 - cut}M"
                else:
                    own, cigar = own[:cut] + own[cut + 4 :], f"{cut}M4D{76 - cut}M"
        reads.append(f"r\t{rng.choice([0, 16])}\tchr1\t{start + 1}\t60\t{cigar}\t*\t0\t0\t{''.join(own)}\t*")
    (root / "reads.sam").write_text("\n".join(reads) + "\n")
    (root / "truth.vcf").write_text(f"##x\nchr1\t500\t.\t{seq[499]}\t{snp}\t50\tPASS\t.\tGT\t1/1\nchr1\t700\t.\t{seq[699]}\t{seq[699]}GATTACA\t50\tPASS\t.\tGT\t1/1\nchr1\t900\t.\t{seq[899:904]}\t{seq[899]}\t50\tPASS\t.\tGT\t0|1\n")
    (root / "a.bed").write_text("chr1 300 1000\n")
    training.save(str(root / "weights"), network.random_weights(hidden=4, slices=3, dense=8, head=4), training.Optimizer(), training.Progress())
    bam.write_bam(files.read_sam(spark, str(root / "reads.sam")), [("chr1", 1303), ("chr2", 1303)], str(root / "reads.bam"))
    return root, seq, snp


def text(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_fasta_ranges(spark, made):
    root, seq, _ = made
    for chunk in (1_000_000, 7, 60):
        rows = files.read_fasta(spark, str(root / "ref.fa"), "chr1", chunk=chunk).orderBy("pos0").collect()
        assert "".join(r.base for r in rows) == seq and [r.pos0 for r in rows] == list(range(len(seq)))
    part = files.read_fasta(spark, str(root / "ref.fa"), "chr1", 55, 130, chunk=50).orderBy("pos0").collect()
    assert "".join(r.base for r in part) == seq[54:130] and part[0].pos0 == 54
    assert files.read_fasta(spark, str(root / "ref.fa")).count() == len(seq) + 100


def test_region_reads(spark, made):
    root, *_ = made
    every = files.read_sam(spark, str(root / "reads.sam"))
    near = files.read_sam(spark, str(root / "reads.sam"), "chr1", 500, 510)
    want = [r for r in every.collect() if r.pos0 < 510 and r.pos0 + (84 if "D" in r.cigar else 80) > 499]
    assert 0 < near.count() == len(want) and files.read_sam(spark, str(root / "reads.sam"), "chr2").count() == 0


def test_commands_from_reads_to_calls(spark, made, tmp_path):
    root, seq, snp = made
    run = lambda name, **o: commands.main([name, *(x for k, v in o.items() for x in ((f"--{k}",) if v is True else (f"--{k}", str(v))))], spark)
    at = {k: str(root / k) for k in ("reads.sam", "ref.fa", "truth.vcf", "a.bed", "weights")}
    run("extract_candidates", reads=at["reads.sam"], ref=at["ref.fa"], bed=at["a.bed"], contig="chr1", start=1, end=1303, out=tmp_path / "can")
    sites = [line.split()[1] for line in text(spark, tmp_path / "can")]
    assert {"500", "700", "900"} <= set(sites) and len(sites) < 20 and sites == sorted(sites, key=int)
    run("get_truth", vcf=at["truth.vcf"], ref=at["ref.fa"], out=tmp_path / "var")
    assert text(spark, tmp_path / "var") == [f"chr1 500 {seq[499]} {snp} 1 1", f"chr1 700 {seq[699]} {seq[699]}GATTACA 1 1", f"chr1 900 {seq[899:904]} {seq[899]} 0 1"]
    run("create_tensors", reads=at["reads.sam"], ref=at["ref.fa"], sites=tmp_path / "can", out=tmp_path / "t_can")
    run("create_tensors", reads=at["reads.sam"], ref=at["ref.fa"], sites=tmp_path / "var", out=tmp_path / "t_var")
    lines = text(spark, tmp_path / "t_var")
    assert [x.split()[:3] for x in lines] == [["chr1", str(p), seq[p - 17 : p + 16]] for p in (500, 700, 900)] and all(len(x.split()) == 3 + 1056 for x in lines)
    (tmp_path / "more").write_text("\n".join([*text(spark, tmp_path / "t_can"), lines[0].replace("chr1 500", "chr1 501")]))
    run("pair_with_non_variants", variants=tmp_path / "t_var", candidates=tmp_path / "more", amplify=50, out=tmp_path / "pairs")
    paired = [x.split()[1] for x in text(spark, tmp_path / "pairs")]
    assert sorted(set(paired), key=int) == sorted({*sites, "501"}, key=int)
    run("tensors_to_bin", tensors=tmp_path / "pairs", variants=tmp_path / "var", out=tmp_path / "bin")
    rows = {r.pos: r for r in files.read_bins(spark, str(tmp_path / "bin")).collect()}
    ones = lambda pos: [i for i, y in enumerate(rows[pos].y) if y]
    assert ones(700) == [B.GT21_LABELS.index("InsIns"), 22, 24 + 23, 57 + 23] and ones(501)[1] == 21 and len(rows) == len(set(paired))
    run("combine_bins", bins=f"{tmp_path}/bin,{tmp_path}/bin", out=tmp_path / "both")
    assert files.read_bins(spark, str(tmp_path / "both")).count() == 2 * len(rows)
    run("bin_to_text", bin=tmp_path / "bin", out=tmp_path / "three")
    assert len(text(spark, tmp_path / "three")) == 3 * len(rows)
    run("text_to_bin", text=tmp_path / "three", out=tmp_path / "bins" / "again")
    again = {r.pos: (r.x, r.y) for r in files.read_bins(spark, str(tmp_path / "bins" / "again")).collect()}
    assert again == {p: (r.x, r.y) for p, r in rows.items()}
    run("combine_bins", bins=tmp_path / "bins", out=tmp_path / "one", seed=3)
    assert files.read_bins(spark, str(tmp_path / "one")).count() == len(rows)
    size = {"hidden": 4, "slices": 3, "dense": 8, "head": 4}
    run("train", bin=tmp_path / "bin", out=tmp_path / "model", epochs=1, **size)
    run("train_cyclical", bin=tmp_path / "bin", out=tmp_path / "cycle", epochs=1, weights=tmp_path / "model-000001.npz")
    run("find_rates", bin=tmp_path / "bin", out=tmp_path / "rates", points=2, steps=2, **size)
    assert spark.read.csv(str(tmp_path / "rates"), header=True).count() == 4 and (tmp_path / "cycle-000001.npz").exists()
    run("evaluate", bin=tmp_path / "bin", weights=at["weights"])
    run("call_reads", reads=at["reads.sam"], ref=at["ref.fa"], weights=at["weights"], out=tmp_path / "vcf", show_reference=True)
    called = text(spark, tmp_path / "vcf")
    assert called[0] == "##fileformat=VCFv4.1" and any(x.startswith("##contig=<ID=chr1,length=1303>") for x in called)
    body = [x.split("\t") for x in called if not x.startswith("#")]
    run("call_reads", reads=root / "reads.bam", ref=at["ref.fa"], weights=at["weights"], out=tmp_path / "one.vcf.gz", show_reference=True)
    with gzip.open(tmp_path / "one.vcf.gz", "rt") as f:
        assert f.read().splitlines() == called
    assert body and all(x[0] == "chr1" and 0 <= float(x[9].split(":")[3]) <= 1 for x in body)
    run("call_variants", reads=at["reads.sam"], ref=at["ref.fa"], tensors=tmp_path / "t_can", weights=at["weights"], out=tmp_path / "p1", ensemble=True)
    run("ensemble", probabilities=f"{tmp_path}/p1,{tmp_path}/p1", least=2, out=tmp_path / "mean")
    assert text(spark, tmp_path / "mean") == text(spark, tmp_path / "p1")
    run("call_variants", reads=at["reads.sam"], ref=at["ref.fa"], probabilities=tmp_path / "mean", out=tmp_path / "vcf2", show_reference=True)
    assert [x.split("\t")[:2] for x in text(spark, tmp_path / "vcf2") if x[0] != "#"] == [x[:2] for x in body if x[1] in sites]
    run("remove_overlaps", vcf=tmp_path / "vcf", out=tmp_path / "vcf3")
    assert set(text(spark, tmp_path / "vcf3")) <= {"\t".join([*x.split("\t")[:6], ".", *x.split("\t")[7:]]) if x[0] != "#" else x for x in called}


def test_plan_and_plot(spark, made, tmp_path, capsys):
    root, *_ = made
    commands.main(["plan_calls", "--ref", str(root / "ref.fa"), "--bed", str(root / "a.bed"), "--chunk", "400"], spark)
    lines = capsys.readouterr().out.strip().splitlines()
    assert [x.split('--start "')[1].split('"')[0] for x in lines] == ["0", "400", "800"] and '--contig "chr1"' in lines[0]
    assert files.command_text(["x"], {"a": 1, "b": None, "c": False, "d": True}) == 'x --a "1" --d'
    x = np.arange(2 * 1056)
    (tmp_path / "arrays").write_text("\n".join(",".join(map(str, row)) for row in x.reshape(-1, 32)))
    commands.main(["plot_rows", "--arrays", str(tmp_path / "arrays"), "--out", str(tmp_path / "plot"), "--most", "1"], spark)
    rows = spark.read.csv(str(tmp_path / "plot"), header=True, inferSchema=True)
    assert rows.count() == 1056 and rows.where("channel = 'snp' AND row = 'C-' AND idx = 3").first().value == 3 * 32 + 5 * 4 + 3
    commands.main(["plot_tensors", "--arrays", str(tmp_path / "arrays"), "--out", str(tmp_path / "images")], spark)
    assert sorted(f.name for f in (tmp_path / "images").iterdir()) == ["0.png", "1.png"]
    assert (tmp_path / "images" / "1.png").read_bytes() == files.heat_map(x[1056:])
    assert files.with_prefix(rows.select(F.lit("chr1").alias("contig")).limit(1), "a").first().contig == "achr1"


def pixels_of(png):
    """The lines of RGB pixels of an unfiltered PNG, its chunks' sums checked."""
    import struct
    import zlib

    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, size = 8, b"", None
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]
        size = struct.unpack(">II", body[:8]) if kind == b"IHDR" else size
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], 1 + size[0] * 3)
    assert not raw[:, 0].any()
    return raw[:, 1:].reshape(size[1], size[0], 3)


def test_heat_maps_show_each_cell():
    x = np.zeros((33, 8, 4))
    x[5, 2, 0], x[6, 2, 0], x[32, 7, 3] = 4, 2, -3
    shown = pixels_of(files.heat_map(x.ravel(), 2))
    assert shown.shape == (4 * 16 + 3 * 2, 66, 3)
    colours = {(int(r), int(c)): tuple(map(int, shown[r, c])) for r, c in zip(*np.nonzero((shown != 255).any(axis=2)), strict=True)}
    squares = {(2 * 2, 5 * 2): (255, 0, 0), (2 * 2, 6 * 2): (255, 128, 128), (3 * 18 + 7 * 2, 32 * 2): (0, 0, 255)}
    assert colours == {(r + a, c + b): v for (r, c), v in squares.items() for a in (0, 1) for b in (0, 1)}
    assert (pixels_of(files.heat_map(np.zeros(1056), 3)) == 255).all() and (pixels_of(files.heat_map(np.full(1056, np.nan), 1)) == 255).all()


def test_images_of_tensors(spark, tmp_path):
    rows = spark.createDataFrame([("chr1/a", 7, [1] * 1056), ("chr1", 9, [2] * 1056), ("chr1", 8, [1] * 3), ("chr1", 6, None)], "contig string, pos long, x array<int>")
    images = files.plot_images(rows, "contig", "pos")
    assert {r.name for r in images.collect()} == {"chr1/a-7", "chr1-9"}
    done = {r.name: r.size for r in files.write_images(images, str(tmp_path / "a" / "b")).collect()}
    assert {f.name: f.stat().st_size for f in (tmp_path / "a" / "b").iterdir()} == {f"{n}.png": size for n, size in done.items()} and set(done) == {"chr1_a-7", "chr1-9"}
    assert [r.name for r in files.plot_images(rows, "contig", "pos", most=1).collect()] == ["chr1-9"]
    assert files.plot_images(rows.where("false"), "contig", "pos").count() == 0


def test_one_shared_folder_is_needed():
    from types import SimpleNamespace

    from strandflow.sources import shared

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="checkpoint"):
        shared.fresh_path(session("spark://host:7077", None), "x")
    assert shared.fresh_path(session("spark://host:7077", "hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")
    assert Path(shared.fresh_path(session("local[4]", None), "x")).parent.exists()
    assert shared.file_system("file:/tmp/x")[1] == "/tmp/x"
