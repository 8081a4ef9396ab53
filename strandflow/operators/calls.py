"""From class probabilities to calls: hypotheses, decoding, scores, ensembles and overlaps.

Probabilities of a site: g (21 genotype-base classes), z (reference,
homozygous, heterozygous), u and v (33 lengths each, offset 16). The scores of
all hypotheses of a batch of sites are one numpy array; a site takes its best
hypothesis, and only where that one gives no alleles does it go on to the next.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import CHANNELS, FLANK, GT21_LABELS, ROWS, WIDTH, gt21, quality, to_acgt, vcf_filter, zygosity
from . import ordered

#: Classes in the order in which equal scores are decided.
CLASSES = ["reference", "hom_snp", "het_snp", "hom_ins", "het_base_ins", "het_ins_ins", "hom_del", "het_base_del", "het_del_del", "ins_del"]
BASES = "ACGT"
PAIRS = [a + b for i, a in enumerate(BASES) for b in BASES[i + 1 :]]
N = FLANK
PROBABILITIES = 21 + 3 + 2 * WIDTH
#: Indels of this length or more take their bases from the reads, up to LONGEST.
LONG, LONGEST = 16, 50
#: Share of the reference counts that the last position of an inferred insertion needs.
INFERRED_SHARE = 0.125
_STEPS = range(1, N + 1)
#: Class number and alleles (bases; lengths; for ins_del the inserted and the deleted length) of each hypothesis, class by class.
HYPOTHESES: list[tuple[int, tuple]] = [
    (0, ()), *((1, (b, b)) for b in BASES), *((2, tuple(p)) for p in PAIRS),
    *((3, (i,)) for i in _STEPS), *((4, (i, b)) for i in _STEPS for b in BASES), *((5, (min(i, j), max(i, j))) for i in _STEPS for j in _STEPS),
    *((6, (i,)) for i in _STEPS), *((7, (i, b)) for i in _STEPS for b in BASES), *((8, (min(i, j), max(i, j))) for i in _STEPS for j in _STEPS if i != j),
    *((9, pair) for i in _STEPS for j in _STEPS for pair in ((i, j), (j, i))),
]
_STARTS = [next(k for k, (cls, _) in enumerate(HYPOTHESES) if cls == c) for c in range(len(CLASSES))]


def _g(*labels: str) -> list[int]:
    return [GT21_LABELS.index(x) for x in labels]


def hypothesis_scores(g: np.ndarray, z: np.ndarray, u: np.ndarray, v: np.ndarray, ref: Sequence[str]) -> np.ndarray:
    """Scores of all HYPOTHESES, a row for each site; ref: its base, one of ACGT."""
    n = len(g)
    row = np.arange(n)
    still = u[:, N] * v[:, N]
    hom, het = z[:, 1:2], z[:, 2:3]
    same = np.array([_g(r + r)[0] for r in ref], int)
    parts = [(still * z[:, 0] * g[row, same])[:, None], (still[:, None] * hom) * g[:, _g(*(b + b for b in BASES))], (still[:, None] * het) * g[:, _g(*PAIRS)]]
    up, down = np.arange(N + 1, 2 * N + 1), np.arange(N - 1, -1, -1)
    for kind, at in (("Ins", up), ("Del", down)):
        both = g[:, _g(kind * 2)]
        a, b = u[:, at], v[:, at]
        one = np.maximum(u[:, N : N + 1] * b, a * v[:, N : N + 1])
        pairs = (a[:, :, None] * b[:, None, :]).reshape(n, -1) * (het * both)
        if kind == "Del":
            pairs = pairs[:, ~np.eye(N, dtype=bool).ravel()]
        parts += [a * b * (hom * both), (one[:, :, None] * g[:, None, _g(*(x + kind for x in BASES))]).reshape(n, -1) * het, pairs]
    mixed = np.stack([u[:, up][:, :, None] * v[:, down][:, None, :], u[:, down][:, :, None] * v[:, up][:, None, :]], axis=3)
    parts.append(mixed.reshape(n, -1) * (het * g[:, _g("InsDel")]))
    return np.concatenate(parts, axis=1)


def _scores_of(batch: pd.DataFrame, ref: Sequence[str]) -> np.ndarray:
    return hypothesis_scores(*(np.stack(batch[k].to_list()).astype(float) for k in "gzuv"), ref)


def best_scores(rows: DataFrame) -> DataFrame:
    """contig, pos, the best score of each class, and the class that wins, from contig, pos, ref (one base), g, z, u, v."""
    columns = ", ".join(f"{c} double" for c in CLASSES)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                best = np.maximum.reduceat(_scores_of(batch, batch["ref"]), _STARTS, axis=1)
                winner = [CLASSES[k] for k in best.argmax(axis=1)]
                yield pd.DataFrame({"contig": batch["contig"], "pos": batch["pos"], **{c: best[:, k] for k, c in enumerate(CLASSES)}, "winner": winner})

    return rows.select("contig", "pos", "ref", "g", "z", "u", "v").mapInPandas(run, f"contig string, pos long, {columns}, winner string")


def inserted_from_tensor(x: Column, size: Column) -> Column:
    """Bases of an insertion of ``size`` after the centre: at each position the base whose insert counts exceed its SNP counts most."""
    cell = lambda i, row, ch: F.element_at(x, ((i * 8 + row) * 4 + ch + 1).cast("int"))
    gain = lambda i, b: cell(i, b, 1) + cell(i, b + 4, 1) - cell(i, b, 3) - cell(i, b + 4, 3)

    def base(gains: Column) -> Column:
        first = F.array_position(gains, F.array_max(gains)).cast("int")
        return F.when(F.array_max(gains) < 0, "A").otherwise(F.substring(F.lit(BASES), first, F.lit(1)))

    span = F.sequence(F.lit(FLANK + 1), F.least(F.lit(FLANK) + size, F.lit(2 * FLANK)))
    return F.array_join(F.transform(F.transform(span, lambda i: F.array(*(gain(i, b) for b in range(4)))), base), "")


@dataclass
class Site:
    """What indel bases are taken from: the 33-base window, reference counts (33, 8, 4), the reads' indels and the reference behind the site.

    ins: (bases, reads) and dels: (length, reads), most frequent first, ties by
    first read; forced: all indel bases come from the reads.
    """

    seq: str
    x: np.ndarray
    ins: Sequence[tuple[str, int]] = ()
    dels: Sequence[tuple[int, int]] = ()
    after: str = ""
    forced: bool = False

    @staticmethod
    def _most(size: int) -> int:
        return LONGEST if size >= LONG else size

    def read_insertion(self, low: int, high: int, ignored: str = "") -> str:
        return next((b for b, _ in self.ins if low <= len(b) <= high and b != ignored), "")

    def read_deletion(self, low: int, high: int) -> str:
        return self.after[: next((n for n, _ in self.dels if low <= n <= high), 0)]

    def tensor_insertion(self, size: int) -> tuple[str, np.ndarray]:
        """Bases after the centre, and each position's sum of what insert counts exceed SNP counts by."""
        part = self.x[N + 1 : N + 1 + size].astype(float)
        gain = (part[:, :4, 1] + part[:, 4:, 1]) - (part[:, :4, 3] + part[:, 4:, 3])
        return "".join("A" if row.max() < 0 else BASES[int(row.argmax())] for row in gain), gain.sum(axis=1)

    def inferred_insertion(self) -> str:
        bases, gain = self.tensor_insertion(N)
        return bases if gain[-1] >= INFERRED_SHARE * self.x[2 * N, :, 0].sum() else bases[:-1]

    def insertion(self, size: int) -> str:
        if self.forced:
            return self.read_insertion(size, self._most(size))
        if size < LONG:
            return self.tensor_insertion(size)[0]
        return self.read_insertion(LONG, LONGEST) or self.inferred_insertion()

    def second_insertion(self, size: int, first: str) -> str:
        return self.read_insertion(size, self._most(size), first) or first[:size]

    def deletion(self, size: int) -> str:
        if self.forced:
            return self.read_deletion(size, self._most(size))
        found = self.read_deletion(LONG, LONGEST) if size >= LONG else ""
        return found if len(found) >= N else self.seq[N + 1 : N + 1 + size]


def alleles(site: Site, cls: int, what: tuple, g: np.ndarray) -> tuple[str, str] | None:
    """Reference and alternate of a hypothesis, or None if it has no bases to show or its alleles coincide."""
    ref = site.seq[N]
    if cls in (1, 2):
        labels = [b + b for b in BASES] if cls == 1 else PAIRS
        chosen = labels[int(np.argmax(g[_g(*labels)]))]
        return ref, ",".join(b for b in dict.fromkeys(chosen) if b != ref) or ref
    if cls in (3, 4, 5):
        bases = site.insertion(what[-1] if cls == 5 else what[0])
        if not bases:
            return None
        if cls == 5:
            other = site.second_insertion(what[0], bases)
            return (ref, f"{ref}{other},{ref}{bases}") if other != bases else None
        return ref, (ref + bases if cls == 3 or what[1] == ref else f"{what[1]},{ref}{bases}")
    if cls in (6, 7, 8):
        gone = site.deletion(what[-1] if cls == 8 else what[0])
        if not gone:
            return None
        whole = ref + gone
        if cls == 8:
            other = ref + whole[what[0] + 1 :]
            return (whole, f"{ref},{other}") if other not in (ref, whole) else None
        return whole, (ref if cls == 6 or what[1] == ref else f"{ref},{what[1]}{gone}")
    bases, gone = site.insertion(what[0]), site.deletion(what[1])
    return (ref + gone, f"{ref},{ref}{bases}{gone}") if bases and gone else None


def decide(scores: np.ndarray, site: Site, g: np.ndarray, ref: str) -> tuple[int, str, str]:
    """Class number, reference and alternate of one site; ref: its base as one of ACGT."""
    left = scores
    while True:
        best = int(left.argmax())
        cls, what = HYPOTHESES[best]
        if cls == 0:
            return cls, ref, ref
        found = alleles(site, cls, what, g)
        if found:
            return cls, *found
        left = left.copy() if left is scores else left
        left[best] = -1


def supporting_reads(x: np.ndarray, cls: int, ref: str, alt: str) -> float:
    """Reads at the centre that support a call, by class; x: counts (33, 8, 4), channel 0 taken from the others."""
    at, behind = x[N], x[N + 1]
    row = lambda base: BASES.index("T" if base == "U" else base)
    snp = lambda base: float(at[[row(base), row(base) + 4]][:, [0, 3]].sum())
    multi = alt.split(",") if "," in alt else []
    if cls == 0:
        return float(at[[row(ref), row(ref) + 4], 0].sum())
    if cls in (1, 2):
        return sum(snp(b) for b in alt if b != ",")
    gain, gone = float(behind[:, 1].sum() - behind[:, 3].sum()), float(behind[:, 2].sum())
    if cls in (3, 4, 5):
        return gain + (snp(multi[0][0]) if cls == 4 and multi else 0)
    if cls in (6, 7, 8):
        return gone + (snp(multi[1][0]) if cls == 7 and multi else 0)
    return gain + gone


DECODED = "contig string, pos long, cls string, ref string, alt string, depth long, af double, g array<double>, z array<double>"


def decode(rows: DataFrame, forced: bool = False) -> DataFrame:
    """contig, pos, cls, ref, alt, p, depth, af of each site that has reads and a centre of A, C, G, T or U.

    rows: contig, pos, seq (33 bases), x (33 x 8 x 4 counts, channel 0 taken
    from the others), g, z, u, v, and of the reads ins, dels and after (see
    Site). p is the probability of the call's own genotype bases times that of
    its zygosity.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_list()).reshape(-1, WIDTH, ROWS, CHANNELS)
            depth = x[:, N, :, 0].sum(axis=1) + x[:, N, :, 2].sum(axis=1)
            base = ["T" if s[N] == "U" else s[N] for s in batch["seq"]]
            scores = _scores_of(batch, base)
            cls, refs, alts, af = [], [], [], []
            for k, (seq, g, ins, dels, after) in enumerate(zip(*(batch[c] for c in ("seq", "g", "ins", "dels", "after")), strict=True)):
                pairs = lambda a: [] if a is None else [(r["what"], r["n"]) for r in a]
                c, ref, alt = decide(scores[k], Site(seq, x[k], pairs(ins), pairs(dels), after or "", forced), np.asarray(g), base[k])
                cls.append(CLASSES[c])
                refs.append(ref)
                alts.append(alt)
                af.append(min(supporting_reads(x[k], c, ref, alt) / depth[k], 1.0) if depth[k] else None)
            yield pd.DataFrame({"contig": batch["contig"], "pos": batch["pos"], "cls": cls, "ref": refs, "alt": alts, "depth": depth.astype(np.int64), "af": af, "g": batch["g"], "z": batch["z"]})

    basic = F.substring("seq", FLANK + 1, 1).isin(*"ACGTU")
    found = rows.where(basic).select("contig", "pos", "seq", "x", "g", "z", "u", "v", "ins", "dels", "after").mapInPandas(run, DECODED).where("depth > 0")
    gt = genotype_text(F.col("cls"), F.col("alt"))
    one, two = F.substring(gt, 1, 1).cast("int"), F.substring(gt, 3, 1).cast("int")
    label = gt21(to_acgt(F.col("ref")), to_acgt(F.col("alt")), one, two)
    p = F.get("g", label) * F.get("z", zygosity(one, two))
    return found.select("contig", "pos", "cls", "ref", "alt", p.alias("p"), "depth", "af")


def read_indels(events: DataFrame, most: int = LONGEST) -> DataFrame:
    """contig, pos (1-based, the base before), ins and dels: arrays of (what, n), most frequent first, ties by the first read.

    what: inserted bases, or the deleted length. As many rows in an array as a
    site has different indels of ``most`` bases at most.
    """
    from .reads import indel_counts

    both = indel_counts(events, "I", 1, most).select("contig", "pos0", "bases", F.lit(None).cast("int").alias("size"), "n", "seen")
    both = both.unionByName(indel_counts(events, "D", 1, most).select("contig", "pos0", F.lit(None).cast("string").alias("bases"), "size", "n", "seen"))
    order = F.struct((-F.col("n")).alias("m"), "seen", "bases", "size")
    rows = both.groupBy("contig", (F.col("pos0") + 1).alias("pos")).agg(*(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), order))).alias(k) for k, c in (("ins", "bases"), ("dels", "size"))))
    pick = lambda k, c: F.transform(k, lambda r: F.struct(r[c].alias("what"), (-r["m"]).alias("n"))).alias(k)
    return rows.select("contig", "pos", pick("ins", "bases"), pick("dels", "size"))


def _counts(x: Column, at: int, channel: int) -> Column:
    """Sum over the rows of one position and channel of a flat tensor."""
    return sum((F.element_at(x, (at * ROWS + row) * CHANNELS + channel + 1) for row in range(ROWS)), F.lit(0))


def read_depth(x: Column) -> Column:
    """Delete plus reference counts at the centre over both strands; x: a flat tensor, channel 0 taken from the others."""
    return _counts(x, FLANK, 0) + _counts(x, FLANK, 2)


def allele_frequency(x: Column, cls: Column, ref: Column, alt: Column) -> Column:
    """Supporting reads by class over the depth, 1 at most; null without depth. x: as for read_depth()."""
    sums = lambda at, ch: _counts(x, at, ch)
    cell = lambda row, ch: F.element_at(x, (FLANK * 32 + row * 4 + ch + 1).cast("int"))
    row_of = lambda base: F.instr(F.lit(BASES), F.substring(base, 1, 1)) - 1
    snp = lambda base: cell(row_of(base), 3) + cell(row_of(base), 0) + cell(row_of(base) + 4, 3) + cell(row_of(base) + 4, 0)
    alts = F.split(alt, ",")
    multi = F.size(alts) > 1
    ins = sums(FLANK + 1, 1) - sums(FLANK + 1, 3)
    gone = sums(FLANK + 1, 2)
    hom = cell(row_of(ref), 0) + cell(row_of(ref) + 4, 0)
    support = (
        F.when(cls == "reference", hom)
        .when(cls.isin("hom_snp", "het_snp"), snp(alts[0]) + F.when(multi, snp(F.get(alts, F.lit(1)))).otherwise(0))
        .when(cls.isin("hom_ins", "het_ins_ins"), ins)
        .when(cls == "het_base_ins", ins + F.when(multi, snp(alts[0])).otherwise(0))
        .when(cls.isin("hom_del", "het_del_del"), gone)
        .when(cls == "het_base_del", gone + F.when(multi, snp(F.get(alts, F.lit(1)))).otherwise(0))
        .otherwise(sums(FLANK + 1, 1) + gone - sums(FLANK + 1, 3))
    )
    depth = read_depth(x)
    return F.when(depth > 0, F.least(support / depth, F.lit(1.0)))


def genotype_text(cls: Column, alt: Column, haploid: bool = False) -> Column:
    multi = F.instr(alt, ",") > 0
    hom = cls.isin("hom_snp", "hom_ins", "hom_del")
    if haploid:
        return F.when(cls == "reference", "0").otherwise("1")
    return F.when(multi, "1/2").when(cls == "reference", "0/0").when(hom, "1/1").otherwise("0/1")


def finish_calls(calls: DataFrame, threshold: int | None = None, show_reference: bool = False, haploid: str | None = None) -> DataFrame:
    """VCF columns of decoded calls with p, depth and af; haploid: None, precise (no heterozygous class) or sensitive (no second alternate)."""
    rows = calls.where("depth > 0")
    reference = F.col("cls") == "reference"
    rows = rows.where(reference | (F.col("ref") != F.col("alt"))) if show_reference else rows.where(~reference & (F.col("ref") != F.col("alt")))
    if haploid == "precise":
        rows = rows.where(F.col("cls").isin("reference", "hom_snp", "hom_ins", "hom_del"))
    elif haploid == "sensitive":
        rows = rows.where(F.instr("alt", ",") == 0)
    rows = rows.withColumn("qual", quality(F.col("p")))
    gt = genotype_text(F.col("cls"), F.col("alt"), haploid is not None)
    return rows.select("contig", "pos", "ref", "alt", "qual", vcf_filter(F.col("qual"), threshold).alias("filter"), gt.alias("gt"), F.col("qual").alias("gq"), F.col("depth").alias("dp"), F.round("af", 4).alias("af"))


def average_runs(runs: DataFrame, least: int = 0, size: int = PROBABILITIES) -> DataFrame:
    """contig, pos, runs, seq, x and mean probabilities p over the runs of a site (ord, contig, pos, seq, p and, if there is one, x); the first run's sequence and tensor stand.

    One grouping: the means of the ``size`` probabilities are partial sums of a site's row.
    """
    first = [c for c in ("seq", "x") if c in runs.columns]
    means = [F.avg(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(size)]
    sites = runs.groupBy("contig", "pos").agg(F.count("*").alias("runs"), F.min_by(F.struct(*first), "ord").alias("first"), *means)
    return sites.where(F.col("runs") >= least).select("contig", "pos", "runs", "first.*", F.array(*(F.round(f"p{i}", 6) for i in range(size))).alias("p"))


def vote_threshold(bams: int, models: int) -> int:
    return (bams * models + 2) // 2


def overlap_facts(calls: DataFrame) -> DataFrame:
    """Adds dl (deleted length) and snp (some alternate is as long as the reference)."""
    sizes = F.transform(F.split("alt", ","), lambda a: F.length(a))
    return calls.withColumn("dl", F.length("ref") - F.array_min(sizes)).withColumn("snp", F.array_contains(sizes, F.length("ref")))


def _fold_islands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """contig and ord of the calls that stay, from calls sorted by contig, island and place."""
    a = None
    for batch in batches:
        types = [batch.column(c).type for c in ("contig", "ord")]
        kept = []
        for b in zip(*(batch.column(c).to_pylist() for c in ("contig", "ord", "island", "pos", "last", "qual", "deletes", "hit")), strict=True):
            if a is not None:
                contig, _, island, _, last, qual, deletes, _ = a
                # a null says neither that two calls are apart nor that the first is better
                apart = deletes is False or b[7] is False or (None not in (b[3], last) and b[3] > last)
                if (contig, island) != (b[0], b[2]) or apart:
                    kept.append(a)
                elif None not in (qual, b[5]) and qual > b[5]:
                    continue
            a = b
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate(types)], names=["contig", "ord"])
    if a is not None:
        yield pa.RecordBatch.from_arrays([pa.array([a[i]], t) for i, t in enumerate(types)], names=["contig", "ord"])


def remove_overlaps(calls: DataFrame) -> DataFrame:
    """Calls without those that overlap a better one: of a deletion and a later SNP or deletion inside it the higher qual stays, on a tie the later.

    Islands that no deletion reaches across are independent; within one the
    rows are folded in order, by a task that holds only the last kept call.
    """
    rows = ordered.islands(overlap_facts(calls), ["contig"], ["pos", "ord"], "pos", F.when(F.col("dl") > 0, F.col("pos") + F.col("dl")))
    rows = rows.select("contig", "ord", "island", "pos", (F.col("pos") + F.col("dl")).alias("last"), "qual", (F.col("dl") > 0).alias("deletes"), (F.col("snp") | (F.col("dl") > 0)).alias("hit"))
    dealt = rows.repartition("contig", "island").sortWithinPartitions("contig", "island", "pos", "ord", "qual")
    kept = dealt.mapInArrow(_fold_islands, calls.select("contig", "ord").schema)
    return calls.join(kept, ["contig", "ord"], "left_semi")
