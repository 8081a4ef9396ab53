import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from strandflow.operators import intervals, reads, tensors

SCHEMA = "ord long, contig string, pos0 long, mapq int, flag int, cigar string, seq string"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_flag_mapq_and_clip_filters(spark):
    rows = [(i, "chr1", 10, 30, f, "10M", "A" * 10) for i, f in enumerate((0, 16, 4, 8, 256, 2048, 64))]
    rows += [(10, "chr1", 10, 4, 0, "10M", "A" * 10), (11, "chr1", 10, 5, 0, "*", "A"), (12, "chr1", 10, 5, 0, "9S10M", "A" * 19), (13, "chr1", 10, 5, 0, "8S10M", "A" * 18), (14, "chr1", 10, 5, 0, "10S10M", "A" * 20)]
    kept = {r.ord for r in reads.filter_reads(make(spark, rows), 5).collect()}
    assert kept == {0, 1, 6, 12, 13}
    assert 14 in {r.ord for r in reads.filter_reads(make(spark, rows), 5, soft_clip=False).collect()}


def walk(cigar, pos, seq):
    """Events by a plain walk over the CIGAR."""
    out, r, q, n, begun = [], pos, 0, "", False
    for c in cigar:
        if c.isdigit():
            n += c
            continue
        k, n = int(n), ""
        if c in "M=X":
            for _ in range(k):
                out.append(("M", r, 0, seq[q], not begun, begun))
                r, q, begun = r + 1, q + 1, True
        elif c == "I":
            out += [("I", r, i, seq[q + i], False, begun) for i in range(k)]
            q += k
        elif c == "D":
            for i in range(k):
                out.append(("D", r, i, None, not begun, begun))
                r, begun = r + 1, True
        elif c == "S":
            q += k
    return out


CIGARS = ["10M", "3S7M", "4=2X4=", "3M2I5M", "4M3D6M", "2I8M", "2D10M", "5M4N5M", "3H10M", "5M1P5M", "8M2I", "1M40I1M", "3M1I2M1D4M"]


def consumed(cigar):
    import re

    return sum(int(n) for n, c in re.findall(r"(\d+)([A-Z=])", cigar) if c in "M=XIS")


def test_expand_and_pileup_equal_the_walk(spark):
    rng = random.Random(4)
    rows = [(i, "chr1", rng.randrange(20, 60), 60, rng.choice([0, 16]), c := rng.choice(CIGARS), "".join(rng.choice("ACGTNRacgt") for _ in range(consumed(c)))) for i in range(200)]
    events = reads.expand(reads.with_ops(make(spark, rows)))
    got = Counter((r.ord, r.kind, r.r, 0 if r.kind == "M" else r.k, r.base, r["first"], r.kind == "I" and r.begun) for r in events.collect())
    want = Counter((i, kind, r, k, base and base.upper(), first, kind == "I" and begun) for i, _, pos, _, _, cigar, seq in rows for kind, r, k, base, first, begun in walk(cigar, pos, seq))
    assert got == want
    counts = defaultdict(Counter)
    for _, _, pos, _, _, cigar, seq in rows:
        for kind, r, k, base, *_ in walk(cigar, pos, seq):
            if kind == "M":
                counts[r][{"R": "A"}.get(base.upper(), base.upper())] += 1
            elif k == 0:
                counts[r - 1][kind] += 1
    got = {r.pos0: Counter({s: r[s] for s in reads.SYMBOLS if r[s]}) for r in reads.pileup_counts(events).collect()}
    assert got == dict(counts)


def test_candidate_ties_and_threshold(spark):
    counts = spark.createDataFrame([("c", 1, 5, 5, 0, 0, 0, 0, 0), ("c", 2, 8, 1, 0, 0, 0, 0, 0), ("c", 3, 4, 0, 0, 0, 5, 0, 0), ("c", 4, 2, 0, 0, 0, 0, 0, 1), ("c", 5, 10, 0, 0, 0, 0, 0, 0), ("c", 6, 7, 1, 0, 0, 0, 0, 0)], "contig string, pos0 long, A long, C long, G long, T long, I long, D long, N long")
    reference = spark.createDataFrame([("c", i, "A") for i in range(1, 8)], "contig string, pos0 long, base string")
    got = {r.pos: r for r in reads.candidates(counts, reference, 0.125, 4).collect()}
    assert set(got) == {2, 4, 7}
    assert got[2].counts == "A 5 C 5 G 0 T 0 I 0 D 0 N 0" and got[4].counts.startswith("I 5 A 4")


def test_depth_cap(spark):
    rows = [(i, "c", p, 60, 0, "1M", "A") for p in (0, 7) for i in range(5)]
    got = Counter(r.pos0 for r in reads.cap_depth(make(spark, rows), 3).collect())
    assert got == {0: 2, 7: 3}


def test_bed_edges(spark):
    bed = spark.createDataFrame([("c", 10, 20), ("c", 30, 30), ("d", 16_380, 33_000)], "contig string, start long, end long")
    points = spark.createDataFrame([("c", p) for p in (9, 10, 19, 20, 30, 31)] + [("d", p) for p in (16_379, 16_380, 20_000, 32_999, 33_000)], "contig string, pos0 long")
    got = {(r.contig, r.pos0) for r in intervals.points_in(points, bed).collect()}
    assert got == {("c", 10), ("c", 19), ("c", 30), ("d", 16_380), ("d", 20_000), ("d", 32_999)}


def test_range_joins_are_equi_joins(spark):
    bed = spark.range(1000).select(F.lit("c").alias("contig"), F.col("id").alias("start"), (F.col("id") + 5).alias("end"))
    points = spark.range(1000).select(F.lit("c").alias("contig"), F.col("id").alias("pos0"))
    plan = intervals.points_in(points, bed)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_chunks(spark):
    index = spark.createDataFrame([("chr1", 2000), ("X", 1001), ("chrUn", 5), ("2", 1)], "contig string, length long")
    got = {tuple(r) for r in intervals.plan_chunks(index, 1000).collect()}
    assert got == {("chr1", 0, 1000), ("chr1", 1000, 2000), ("X", 0, 1000), ("X", 1000, 1001), ("2", 0, 1)}


def test_near_variants(spark):
    v = [5, 100, 120]
    got = {r.pos for r in intervals.near_variants(spark.createDataFrame([("c", p) for p in v], "contig string, pos long")).collect()}
    want = {p for x in v for p in range(x - 16, x + 17) if p > 0 and 15 <= abs(p - x) and all(abs(p - y) >= 15 for y in v)}
    assert got == want


@pytest.mark.parametrize("left_edge", [True, False])
def test_window_cells_equal_a_walk(spark, left_edge):
    rng = random.Random(9)
    reference = "".join(rng.choice("ACGTN") for _ in range(120))
    rows = [(i, "c", rng.randrange(10, 80), 60, rng.choice([0, 16]), c := rng.choice(CIGARS), "".join(rng.choice("ACGTR*") for _ in range(consumed(c)))) for i in range(120)]
    centres = [30, 55, 70]
    row = lambda b: {"A": 0, "C": 1, "G": 2, "T": 3, "R": 0, "N": 0}.get(b)
    want = Counter()
    for _, _, pos, _, flag, cigar, seq in rows:
        events = walk(cigar, pos, seq)
        strand = 4 if flag & 16 else 0
        for c in centres:
            if not left_edge and not any(k != "I" and r == c - 17 for k, r, *_ in events):
                continue
            for kind, r, k, base, first, begun in events:
                i, ref = r - c + 17, row(reference[r])
                q = row(base) if base else None
                if kind == "M" and 0 <= i <= 32 and ref is not None and q is not None:
                    for w, ch in ((ref, 0), (q, 1), (ref, 2), (q, 3)):
                        want[c, i, w + strand, ch] += 1
                elif kind == "D" and 1 <= i <= 32 and not first:
                    want[c, i, ref + strand, 2] += 1
                elif kind == "I" and 1 <= i <= 32 and begun and q is not None:
                    want[c, min(i + k, 32), q + strand, 1] += 1
    events = reads.expand(reads.with_ops(make(spark, rows)))
    ref = spark.createDataFrame([("c", i, b) for i, b in enumerate(reference)], "contig string, pos0 long, base string")
    sites = spark.createDataFrame([("c", c) for c in centres], "contig string, pos long")
    cells = tensors.window_cells(sites, tensors.position_counts(events, ref)) if left_edge else tensors.window_cells_left_edge(sites, events, ref)
    got = Counter({(r.pos, r.idx, r.row, r.ch): r.n for r in cells.collect()})
    assert got == want
    depth = Counter()
    for (c, i, _, ch), n in want.items():
        depth[c, i] += n * (ch == 0)
    depth = +depth
    assert {(r.pos, r.idx): r.depth for r in tensors.depth_of_cells(cells).collect()} == depth
    if left_edge:
        direct = tensors.window_depth(sites, events, ref).collect()
        assert {(r.pos, r.idx): r.depth for r in direct} == {(c, i): depth[c, i] for c in centres for i in range(33)}
        x = {r.pos: r.x for r in tensors.dense(cells).collect()}
        assert all(x[c][(i * 8 + w) * 4 + ch] == n for (c, i, w, ch), n in want.items()) and len(x[30]) == 1056


def test_pileup_callback(spark):
    import pandas as pd

    rows = [(i, "chr1", 5, 60, 16 * (i % 2), "2M1I2M1D1M", "ACGTAC") for i in range(4)] + [(9, "chr1", 7, 60, 0, "3M", "GGG")]
    events = reads.expand(reads.with_ops(make(spark, rows)))

    def column(own):
        return pd.DataFrame({"pos0": [own["pos0"].iloc[0]], "text": ["".join(own["symbol"])]})

    got = {r.pos0: r.text for r in reads.map_pileup(events, column, "pos0 long, text string").collect()}
    assert got == {5: "AAAA", 6: "+GC" * 4, 7: "TTTTG", 8: "-A" * 4 + "G", 9: "G", 10: "CCCC"}
    assert {r.pos0: r.text for r in reads.map_pileup(events, column, "pos0 long, text string", most=2).collect()}[8] == "-A-A"


def test_pileup_function_equals_the_callback(spark):
    import pandas as pd

    rng = random.Random(12)
    rows = [(i, rng.choice(["c1", "c2"]), rng.randrange(20, 60), 60, rng.choice([0, 16]), c := rng.choice(CIGARS), "".join(rng.choice("ACGTN") for _ in range(consumed(c)))) for i in range(150)]
    events = reads.expand(reads.with_ops(make(spark, rows)))
    schema = "contig string, pos0 long, text string"

    def frame(own):
        return pd.DataFrame({"contig": [own["contig"].iloc[0]], "pos0": [own["pos0"].iloc[0]], "text": ["".join(own["symbol"])]})

    function = reads.pileup_function(lambda own: [(own[0]["contig"], own[0]["pos0"], "".join(r["symbol"] for r in own))], schema)
    spark.udtf.register("shown", function)
    for most in (250, 5):
        want = sorted(map(tuple, reads.map_pileup(events, frame, schema, most).collect()))
        assert sorted(map(tuple, reads.apply_pileup(events, function, most).collect())) == want
        reads.pileup_rows(events, most).createOrReplaceTempView("rows_of_reads")
        got = spark.sql("SELECT * FROM shown(TABLE(rows_of_reads) PARTITION BY (contig, pos0) ORDER BY (start, ord, kind, k, symbol))")
        assert sorted(map(tuple, got.collect())) == want
        # the exchange that counts the reads serves the function
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("hashpartitioning") == 1
    assert reads.apply_pileup(events.where("false"), function).count() == 0


def test_pileup_keeps_inserted_bases_in_order(spark):
    events = reads.expand(reads.with_ops(make(spark, [(1, "c", 3, 60, 0, "2M3I2D1M", "ACTGAG")])))
    function = reads.pileup_function(lambda own: [(own[0]["pos0"], "".join(r["symbol"] for r in own))], "pos0 long, text string")
    assert dict(map(tuple, reads.apply_pileup(events, function).collect())) == {3: "A", 4: "--+T+G+AC", 7: "G"}


def test_region_text_and_spans(spark):
    from strandflow.sources import files

    assert files.region_text("c", 3, 9) == "c:3-9" and files.region_text("c", None, 9) == ""
    spans = {r.ord: r.span for r in reads.spans(make(spark, [(1, "c", 0, 9, 0, "3S4M2D1I5N2=", "A"), (2, "c", 0, 9, 0, "*", "A")])).collect()}
    assert spans == {1: 13, 2: 0}
    long = make(spark, [(1, "c", 0, 9, 0, "1M1I" * 300, "AC" * 300)])
    events = reads.expand(reads.with_ops(long)).where("kind = 'M'").orderBy("r").collect()
    assert [r.r for r in events] == list(range(300)) and {r.base for r in events} == {"A"}
