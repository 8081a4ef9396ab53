import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandflow.functions import bases as B
from strandflow.operators import calls, metrics, network, truth
from strandflow.sources import files


def test_gt21_of_all_classes(spark):
    cases = [("A", "A", 0, 0, "AA"), ("A", "C", 0, 1, "AC"), ("G", "T", 0, 1, "GT"), ("T", "C", 1, 1, "CC"), ("A", "C,G", 1, 2, "CG"), ("AC", "A", 1, 1, "DelDel"), ("AC", "A", 0, 1, "ADel"), ("A", "AC", 1, 1, "InsIns"), ("C", "CA", 0, 1, "CIns"), ("AC", "A,ACT", 1, 2, "InsDel"), ("AC", "TC,A", 1, 2, "TDel"), ("A", "AT,G", 1, 2, "GIns"), ("A", "C,G,T", 1, 2, "CG")]
    df = spark.createDataFrame(cases, "ref string, alt string, gt1 int, gt2 int, want string")
    for r in df.withColumn("got", B.gt21(*(F.col(c) for c in ("ref", "alt", "gt1", "gt2")))).collect():
        assert B.GT21_LABELS[r.got] == r.want, r


def test_truth_stars_and_merges(spark):
    rows = [(1, "c", 10, "A", "G", "0/1"), (2, "c", 10, "A", "G", "1|0"), (3, "c", 20, "A", "G", "0/1"), (4, "c", 20, "A", "T", "./1"), (5, "c", 30, "AC", "A", "0/1"), (6, "c", 30, "A", "T", "0/1"), (7, "c", 40, "A", "TT,*", "1/2"), (8, "c", 50, "A", "*,G", "1/2"), (9, "c", 20, "A", "C", "1/1")]
    vcf = spark.createDataFrame(rows, "ord long, contig string, pos long, ref string, alt string, gt string")
    reference = spark.createDataFrame([("c", i, "C") for i in range(60)], "contig string, pos0 long, base string")
    got = sorted(tuple(r) for r in truth.truth_variants(vcf, reference).collect())
    assert got == sorted([("c", 10, "A", "G", 0, 1), ("c", 20, "A", "G,T", 1, 2), ("c", 20, "A", "C", 1, 1), ("c", 30, "A", "A,T", 1, 2), ("c", 39, "CA", "C", 0, 1), ("c", 40, "A", "T", 0, 1), ("c", 49, "CA", "C", 0, 1), ("c", 50, "A", "G", 0, 1)])
    with pytest.raises(Exception, match="two alleles"):
        truth.parse_genotypes(spark.createDataFrame([("1",)], "gt string")).collect()


def test_truth_of_long_runs(spark):
    vcf = spark.range(10_002).select(F.col("id").alias("ord"), F.lit("c").alias("contig"), F.lit(10).cast("long").alias("pos"), F.lit("A").alias("ref"), F.when(F.col("id") < 10_001, "G").otherwise("T").alias("alt"), F.lit("0/1").alias("gt"))
    stars = spark.createDataFrame([(20_000, "c", 40, "A", ",".join(["TT", "*", *("G" * (i + 3) for i in range(101))]), "1/2")], vcf.schema)
    reference = spark.createDataFrame([("c", i, "C") for i in range(60)], "contig string, pos0 long, base string")
    assert [tuple(r) for r in truth.truth_variants(vcf, reference).collect()] == [("c", 10, "A", "G,T", 1, 2)]
    parts = truth.split_stars(truth.parse_genotypes(stars), reference).orderBy("part").collect()
    assert [r.alt for r in parts[1:]] == ["T", *("G" * (i + 3) for i in range(101))]


def test_duplicate_keys(spark):
    rows = spark.createDataFrame([("c", 1, i) for i in range(60)] + [("c", 2, 5)], "contig string, pos long, ord long")
    assert truth.number_duplicates(rows, True).count() == 54 and truth.number_duplicates(rows, False).count() == 2


def test_pairing_needs_candidates(spark):
    v = spark.createDataFrame([("c", 1)], "contig string, pos long")
    with pytest.raises(ValueError):
        truth.pair_non_variants(v, v)
    c = spark.createDataFrame([("c", i) for i in range(1, 4)], "contig string, pos long")
    assert truth.pair_non_variants(v, c).count() == 3


def random_site(rng):
    soft = lambda n: (lambda x: [v / sum(x) for v in x])([rng.random() ** 6 for _ in range(n)])
    return soft(21), soft(3), soft(33), soft(33)


def loop_scores(g, z, u, v, ref):
    """(score, class, what) of every hypothesis by plain loops."""
    at = lambda label: g[B.GT21_LABELS.index(label)]
    U, V = (lambda i: u[16 + i]), (lambda i: v[16 + i])
    out = [(U(0) * V(0) * z[0] * at(ref + ref), 0, None)]
    out += [(U(0) * V(0) * z[1] * at(b + b), 1, b + b) for b in "ACGT"]
    out += [(U(0) * V(0) * z[2] * at(p), 2, p) for p in ("AC", "AG", "AT", "CG", "CT", "GT")]
    for cls, kind, sign in ((3, "Ins", 1), (6, "Del", -1)):
        out += [(U(sign * i) * V(sign * i) * (z[1] * at(kind * 2)), cls, i) for i in range(1, 17)]
        for i in range(1, 17):
            best = max(U(0) * V(sign * i), U(sign * i) * V(0))
            out += [(best * at(b + kind) * z[2], cls + 1, (i, b)) for b in "ACGT"]
        out += [(U(sign * i) * V(sign * j) * (z[2] * at(kind * 2)), cls + 2, (min(i, j), max(i, j))) for i in range(1, 17) for j in range(1, 17) if i != j or sign > 0]
    for i in range(1, 17):
        for j in range(1, 17):
            out += [(U(i) * V(-j) * (z[2] * at("InsDel")), 9, (i, j)), (U(-i) * V(j) * (z[2] * at("InsDel")), 9, (j, i))]
    return out


def loop_decode(g, z, u, v, site):
    """Class and alleles: hypotheses from the best on until one has bases to show."""
    ref = site.seq[16]
    gain = lambda p: [site.x[p, b, 1] + site.x[p, b + 4, 1] - site.x[p, b, 3] - site.x[p, b + 4, 3] for b in range(4)]
    pick = lambda p: "ACGT"[([*gain(p), 0]).index(max([*gain(p), 0])) % 4]
    top = lambda n: 50 if n >= 16 else n

    def from_reads(low, high, ignored=""):
        return next((b for b, _ in site.ins if low <= len(b) <= high and b != ignored), "")

    def inserted(n):
        if site.forced:
            return from_reads(n, top(n))
        if n < 16:
            return "".join(pick(p) for p in range(17, 17 + n))
        found = from_reads(16, 50)
        if found:
            return found
        last = sum(gain(32)) >= 0.125 * sum(site.x[32, :, 0])
        return "".join(pick(p) for p in range(17, 33 if last else 32))

    def deleted(n):
        low, high = (n, top(n)) if site.forced else (16, 50)
        size = next((k for k, _ in site.dels if low <= k <= high), 0) if site.forced or n >= 16 else 0
        if site.forced or len(site.after[:size]) >= 16:
            return site.after[:size]
        return site.seq[17 : 17 + n]

    for _, cls, what in sorted(loop_scores(g, z, u, v, ref), key=lambda h: (-h[0], h[1])):
        if cls == 0:
            return 0, ref, ref
        if cls in (1, 2):
            labels = ["AA", "CC", "GG", "TT"] if cls == 1 else ["AC", "AG", "AT", "CG", "CT", "GT"]
            best = max(labels, key=lambda x: g[B.GT21_LABELS.index(x)])
            others = [b for b in dict.fromkeys(best) if b != ref]
            return cls, ref, ",".join(others) if others else ref
        if cls == 3 and (b := inserted(what)):
            return 3, ref, ref + b
        if cls == 4 and (b := inserted(what[0])):
            return 4, ref, ref + b if what[1] == ref else f"{what[1]},{ref}{b}"
        if cls == 5 and (b := inserted(what[1])):
            other = from_reads(what[0], top(what[0]), b) or b[: what[0]]
            if other != b:
                return 5, ref, f"{ref}{other},{ref}{b}"
        if cls == 6 and (b := deleted(what)):
            return 6, ref + b, ref
        if cls == 7 and (b := deleted(what[0])):
            return 7, ref + b, ref if what[1] == ref else f"{ref},{what[1]}{b}"
        if cls == 8 and (b := deleted(what[1])):
            other = ref + (ref + b)[what[0] + 1 :]
            if other not in (ref, ref + b):
                return 8, ref + b, f"{ref},{other}"
        if cls == 9 and (b := inserted(what[0])) and (c := deleted(what[1])):
            return 9, ref + c, f"{ref},{ref}{b}{c}"


def made_site(rng, forced):
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    x = np.array([rng.choice([0, 0, 0, 1, 3]) for _ in range(1056)]).reshape(33, 8, 4)
    x[:, :, 3] -= np.array([rng.choice([0, 2]) for _ in range(264)]).reshape(33, 8)
    ins = [(text(rng.choice([1, 2, 3, 15, 16, 17, 50])), k) for k in (5, 3, 1)] if rng.random() < 0.7 else []
    dels = [(rng.choice([1, 2, 16, 20, 50]), 4), (3, 1)] if rng.random() < 0.7 else []
    return calls.Site(text(rng.choice([33, 33, 20, 17])), x, ins, dels, text(rng.choice([50, 50, 10])), forced)


def test_decoding_equals_plain_loops():
    rng = random.Random(8)
    seen = set()
    for k in range(600):
        g, z, u, v = (np.array(x) for x in random_site(rng))
        if k % 3 == 0:  # long indels
            u[[0, 32]] += rng.random(), rng.random()
            v[[0, 32]] += rng.random(), rng.random()
        if k % 5 == 0:  # ties
            g[:], u[:], v[:] = 0.1, 0.1, 0.1
        site = made_site(rng, k % 2 == 0)
        scores = calls.hypothesis_scores(g[None], z[None], u[None], v[None], [site.seq[16]])[0]
        plain = loop_scores(g, z, u, v, site.seq[16])
        assert scores.tolist() == [h[0] for h in plain] and [h[1] for h in plain] == [h[0] for h in calls.HYPOTHESES]
        got = calls.decide(scores, site, g, site.seq[16])
        assert got == loop_decode(g, z, u, v, site)
        seen.add(got[0])
    assert seen == set(range(10))


def test_decode_rows(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(120):
        g, z, u, v = random_site(rng)
        site = made_site(rng, False)
        seq = site.seq.ljust(33, "A")
        seq = seq[:16] + rng.choice("ACGTNRU") + seq[17:]
        site.seq = seq.replace("U", "T") if seq[16] == "U" else seq
        depth = int(site.x[16, :, 0].sum() + site.x[16, :, 2].sum())
        rows.append(("c", i, seq, [int(n) for n in site.x.ravel()], g, z, u, v, [{"what": b, "n": n} for b, n in site.ins], [{"what": b, "n": n} for b, n in site.dels] or None, site.after))
        if seq[16] in "ACGTU" and depth > 0:
            want[i] = (seq[16], depth, loop_decode(np.array(g), z, u, v, site))
    schema = "contig string, pos long, seq string, x array<int>, g array<double>, z array<double>, u array<double>, v array<double>, ins array<struct<what:string,n:long>>, dels array<struct<what:int,n:long>>, after string"
    df = spark.createDataFrame(rows, schema)
    got = {r.pos: r for r in calls.decode(df).collect()}
    assert set(got) == set(want)
    by_column = {r.pos: r for r in df.join(calls.decode(df).select("pos", "cls", "ref", "alt"), "pos").select("pos", calls.read_depth(F.col("x")).alias("depth"), calls.allele_frequency(F.col("x"), F.col("cls"), F.col("ref"), F.col("alt")).alias("af")).collect()}
    for i, (centre, depth, (cls, ref, alt)) in want.items():
        r = got[i]
        if centre != "U":
            assert (r.cls, r.ref, r.alt) == (calls.CLASSES[cls], ref, alt)
            assert r.af == pytest.approx(by_column[i].af)
        assert r.depth == depth == by_column[i].depth and r.af <= 1 and 0 <= r.p <= 1


def test_reference_rows_show_only_if_asked(spark):
    rows = [("c", 1, "A", "A", 0.5, 3, 0.1, "reference"), ("c", 2, "A", "A", 0.5, 3, 0.1, "hom_snp"), ("c", 3, "A", "C", 0.5, 3, 0.1, "hom_snp"), ("c", 4, "A", "C", 0.5, 0, None, "hom_snp")]
    df = spark.createDataFrame(rows, "contig string, pos long, ref string, alt string, p double, depth long, af double, cls string")
    assert {r.pos for r in calls.finish_calls(df).collect()} == {3} and {r.pos for r in calls.finish_calls(df, show_reference=True).collect()} == {1, 3}


def test_quality(spark):
    p = [0.0, 1e-6, 0.5, 0.9, 0.999, 1.0]
    got = [r.q for r in spark.createDataFrame([(x,) for x in p], "p double").select(B.quality(F.col("p")).alias("q")).collect()]
    want = [round(max(-10 * math.log10((1 - x + 1e-300) / (x + 1e-300)) + 16, 0) ** 2) for x in p]
    assert got == want


def overlap_loop(rows):
    kept = []
    for r in rows:
        size = lambda x: len(x[2]) - min(map(len, x[3].split(",")))
        snp = any(len(a) == len(r[2]) for a in r[3].split(","))
        a = kept[-1] if kept else None
        if a and size(a) > 0 and (snp or size(r) > 0) and r[1] <= a[1] + size(a):
            if a[4] <= r[4]:
                kept[-1] = r
        else:
            kept.append(r)
    return [r[0] for r in kept]


def test_overlaps_equal_the_fold(spark):
    rng = random.Random(3)
    rows, pos = [], 0
    for i in range(600):
        pos += rng.randrange(0, 5)
        ref = rng.choice(["A", "ACGT", "AC", "ACGTACGT"])
        rows.append((i, pos, ref, rng.choice(["A", "G", "ATT", "A,AC", ref]), rng.randrange(6)))
    df = spark.createDataFrame([("c", *r) for r in rows], "contig string, ord long, pos long, ref string, alt string, qual int")
    assert sorted(r.ord for r in calls.remove_overlaps(df).collect()) == overlap_loop(rows)


def test_overlaps_of_a_long_island(spark):
    n = 1_000_002
    df = spark.range(n).select(F.lit("c").alias("contig"), F.col("id").alias("ord"), F.lit(7).cast("long").alias("pos"), F.lit("AC").alias("ref"), F.lit("A").alias("alt"), F.lit(1).alias("qual"))
    assert [r.ord for r in calls.remove_overlaps(df).collect()] == [n - 1]


def test_ensemble_of_equal_runs_is_the_input(spark):
    rows = [(k, "c", i, f"s{k}", [0.125 * i, 0.5]) for k in range(3) for i in range(4)]
    df = spark.createDataFrame(rows, "ord long, contig string, pos long, seq string, p array<double>")
    got = {r.pos: (r.runs, r.seq, r.p) for r in calls.average_runs(df, 3, 2).collect()}
    assert got == {i: (3, "s0", [0.125 * i, 0.5]) for i in range(4)}
    assert calls.average_runs(df, 4, 2).count() == 0 and calls.vote_threshold(2, 3) == 4


def test_metrics(spark):
    rows = spark.createDataFrame([("t", 0, 0), ("t", 0, 1), ("t", 1, 1), ("t", 2, 1)], "task string, truth int, pred int")
    m = metrics.confusion(rows)
    assert m.agg(F.sum("n")).first()[0] == 4
    f1 = {r.cls: r.f1 for r in metrics.f1_by_class(m).collect()}
    assert f1[0] == pytest.approx(2 / 3) and f1[1] == pytest.approx(0.5) and f1[2] == 0


def loop_flags(losses):
    low, last = min(losses), losses[-6:]
    ways = [b > a for a, b in zip(last, last[1:])]
    flat = any(a == b for a, b in zip(last, last[1:]))
    return len(losses) <= 5 or low in losses[-5:], len(losses) > 6 and not flat and all(a != b for a, b in zip(ways, ways[1:])), len(losses) > 6 and all(x > low for x in losses[-5:])


def test_training_histories(spark):
    rng = random.Random(6)
    runs = {0: [3.0], 1: [5.0, 4.0, 3.0, 2.0, 1.0], 2: [1.0, 2.0, 1.5, 2.5, 1.2, 2.2], 3: [0.5, 2.0, 1.0, 2.0, 1.0, 2.0, 1.0], 4: [1.0, *[2.0] * 40]}
    runs |= {k: [rng.randrange(8) / 2 for _ in range(rng.randrange(6, 60))] for k in range(5, 40)}
    df = spark.createDataFrame([(k, i, x) for k, xs in runs.items() for i, x in enumerate(xs)], "run long, epoch long, loss double")
    flags = metrics.loss_flags(df)
    got = {(r.run, r.epoch): (r.approaches, r.oscillates, r.rises) for r in flags.collect()}
    assert got == {(k, i): loop_flags(xs[: i + 1]) for k, xs in runs.items() for i in range(len(xs))}
    rates = {}
    for k, xs in runs.items():
        rate, since, left = 1e-3, 0, 3
        for i in range(len(xs)):
            near, swings, rises = loop_flags(xs[: i + 1])
            since += 1
            switch = (since >= 6 and not near and swings) or (since >= 8 and rises)
            left -= switch
            rates[k, i] = (pytest.approx(rate), switch, left == 0)
            if left == 0:
                break
            if switch:
                rate, since = rate * 0.1, 0
    assert {(r.run, r.epoch): (r.rate, r.switched, r.stopped) for r in metrics.adaptive_rates(flags).collect()} == rates
    assert any(x[2] for x in rates.values())


def test_cyclical_rates(spark):
    size, low, high = 3, 0.1, 0.9
    steps = spark.range(3 * (2 * size + 1) + 2)
    for mode in ("tri", "tri2", "exp"):
        got = [r.lr for r in steps.select("id", B.triangular_lr(F.col("id"), size, low, high, mode).alias("lr")).orderBy("id").collect()]
        top, n, want = high, 0, []
        for _ in got:
            n += 1
            if n > 2 * size:
                n, top = 0, {"tri": top, "tri2": top / 2, "exp": top * 0.95}[mode]
            part = n / size
            want.append(low + (top - low) * max(0, part if part <= 1 else 2 - part))
        assert got == pytest.approx(want)


def test_evaluate_equals_loops(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(80):
        p = [[rng.randrange(6) / 8 for _ in range(n)] for n in (21, 3, 33, 33)]
        rows.append((rng.randrange(21), rng.randrange(3), rng.randrange(33), rng.randrange(33), *p))
    df = spark.createDataFrame(rows, "gt21 int, zyg int, len1 int, len2 int, g array<double>, z array<double>, u array<double>, v array<double>")
    got = {(r.task, r.metric, r.truth, r.pred): r.value for r in metrics.evaluate(df).collect()}
    best = lambda p: p.index(max(p))
    want, hits = {}, [0, 0]
    for a, b, c, d, g, z, u, v in rows:
        x, y = sorted((c, d)), sorted((best(u), best(v)))
        for task, t, q in (("gt21", a, best(g)), ("zyg", b, best(z)), ("length_1", x[0], y[0]), ("length_2", x[1], y[1])):
            want[task, t, q] = want.get((task, t, q), 0) + 1
        order = sorted(range(21), key=lambda i: (-g[i], -i))
        hits[0] += order[0] == a
        hits[1] += a in order[:2]
    assert {(k[0], k[2], k[3]): v for k, v in got.items() if k[1] == "n"} == want
    assert [got["gt21", m, None, None] for m in ("all", "top1", "top2")] == [80, *hits]


def test_losses(spark):
    logits, y = [0.3, -1.2, 2.0], [0, 1, 0]
    e = np.exp(logits) / np.exp(logits).sum()
    focal = -sum((b - a) ** 2 * math.log(a) if b else a**2 * math.log(1 - a) for a, b in zip(e, y))
    df = spark.createDataFrame([(logits, y, e.tolist())], "l array<double>, y array<int>, p array<double>")
    got = df.select(B.focal_loss(F.col("l"), F.col("y")).alias("f"), B.cross_entropy(F.col("p"), F.col("y"), F.array(*map(F.lit, (1.0, 3.0, 1.0)))).alias("c")).first()
    assert got.f == pytest.approx(focal) and got.c == pytest.approx(-3 * math.log(e[1] + 1e-10))


def test_network_gives_distributions(spark):
    w = network.random_weights(hidden=4, slices=3, dense=8, head=4)
    x = np.random.RandomState(0).rand(3, 1056)
    out = network.forward(x, w)
    assert {k: v.shape for k, v in out.items()} == {"g": (3, 21), "z": (3, 3), "u": (3, 33), "v": (3, 33)}
    assert all(np.allclose(v.sum(axis=1), 1) for v in out.values())
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "pos long, x array<float>")
    for r in network.score(df, w).collect():
        assert np.allclose(r.g, out["g"][r.pos], atol=1e-5)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nq1\t16\tchr1\t11\t60\t4M\t*\t0\t0\tacgT\tIIII\n")
    assert tuple(files.read_sam(spark, str(tmp_path / "a.sam")).drop("ord").first()) == ("chr1", 10, 60, 16, "4M", "ACGT")
    (tmp_path / "a.fa").write_text(">chr1 x\nacg\nT\n>chr2\nGG\n")
    assert [tuple(r) for r in files.read_fasta_records(spark, str(tmp_path / "a.fa")).orderBy("contig", "pos0").collect()] == [("chr1", 0, "A"), ("chr1", 1, "C"), ("chr1", 2, "G"), ("chr1", 3, "T"), ("chr2", 0, "G"), ("chr2", 1, "G")]
    (tmp_path / "a.bed").write_text("chr1 5 5\nchr1\t7\t9\n")
    assert [tuple(r)[:3] for r in files.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 5, 6), ("chr1", 7, 9)]
    done = spark.createDataFrame([("chr1", 7, "A", "G", 652, "PASS", "0/1", 652, 30, 0.4667), ("chr1", 3, "A", "T", 10, ".", "1/1", 10, 3, 1.0)], "contig string, pos long, ref string, alt string, qual int, filter string, gt string, gq int, dp int, af double")
    files.write_vcf(done, [("chr1", 100)], str(tmp_path / "out"))
    text = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert "chr1\t7\t.\tA\tG\t652\tPASS\t.\tGT:GQ:DP:AF\t0/1:652:30:0.4667" in text and any(t.startswith("##contig=<ID=chr1") for t in text)
    back = files.read_vcf(spark, str(tmp_path / "out")).orderBy("pos").collect()
    assert [(r.pos, r.qual, r.gt) for r in back] == [(3, 10, "1/1"), (7, 652, "0/1")]
    bins = spark.createDataFrame([(1, "c", 9, [0.5, 2.0], [1, 0])], "ord long, contig string, pos long, x array<float>, y array<int>")
    assert [tuple(r) for r in files.text_to_bin(files.bin_to_text(bins)).collect()] == [(1, "c", 9, [0.5, 2.0], [1, 0])]


def test_star_before_the_first_base_goes(spark):
    """A * alternate at a contig's first position has no base before it; the other alternate stays, and null alleles have null labels."""
    vcf = spark.createDataFrame([(0, "c", 1, "A", "*,G", "0/1"), (1, "c", 3, "A", "*,G", "0/1"), (2, "other", 5, "A", "*,T", "1/2")], "ord long, contig string, pos long, ref string, alt string, gt string")
    reference = spark.createDataFrame([("c", i, b) for i, b in enumerate("ACAT")], "contig string, pos0 long, base string")
    got = truth.split_stars(truth.parse_genotypes(vcf), reference).orderBy("ord", "part").collect()
    assert [(r.ord, r.pos, r.ref, r.alt, r.gt1, r.gt2) for r in got] == [(0, 1, "A", "G", 0, 1), (1, 2, "CA", "C", 0, 1), (1, 3, "A", "G", 0, 1), (2, 5, "A", "T", 0, 1)]
    nothing = spark.createDataFrame([("c", 1, None, None, 0, 1), ("c", 2, "A", None, 0, 1), ("c", 3, None, "A", 1, 1), ("c", 4, "A", "G", None, 1)], "contig string, pos long, ref string, alt string, gt1 int, gt2 int")
    labels = truth.variant_labels(nothing).orderBy("pos").collect()
    assert all(r.gt21 is None for r in labels[:3]) and all(r.len1 is None and r.len2 is None for r in labels) and labels[3].zyg is None
