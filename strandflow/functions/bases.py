"""Column functions for base symbols, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ambiguity codes and the base each one stands for.
AMBIGUITY_FROM = "URYSWKMBDHV"
AMBIGUITY_TO = "TACCAGACAAA"
# Genotype-base labels in class order.
GT21_LABELS = [
    "AA", "AC", "AG", "AT", "CC", "CG", "CT", "GG", "GT", "TT",
    "DelDel", "ADel", "CDel", "GDel", "TDel",
    "InsIns", "AIns", "CIns", "GIns", "TIns", "InsDel",
]
FLANK, WIDTH, ROWS, CHANNELS = 16, 33, 8, 4


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sums_before(steps: Column, block: int = 64) -> Column:
    """For each entry the sum of those before it: sums of blocks first, so long arrays take little more than one pass."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    of_blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / block).cast("int")), lambda b: add(F.slice(a, b * block + 1, F.lit(block))))
    before = lambda blocks: F.transform(blocks, lambda _, b: add(F.slice(blocks, F.lit(1), b)))
    inside = lambda a, starts: F.transform(a, lambda _, i: F.get(starts, F.floor(i / block).cast("int")) + add(F.slice(a, i - i % block + 1, i % block)))
    return let(steps, lambda a: let(let(of_blocks(a), before), lambda starts: inside(a, starts)))


def to_acgt(base: Column, keep_n: bool = True) -> Column:
    """Base symbol to A, C, G or T; N stays unless keep_n is false (then A)."""
    return F.translate(F.upper(base), AMBIGUITY_FROM + ("" if keep_n else "N"), AMBIGUITY_TO + ("" if keep_n else "A"))


def base_row(base: Column) -> Column:
    """0 to 3 for the base that a symbol stands for, null for other symbols."""
    at = F.instr(F.lit("ACGT"), to_acgt(base, keep_n=False))
    return F.when((at > 0) & (F.length(base) == 1), at - 1)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def partial_label(ref: Column, alt: Column) -> Column:
    return F.when(F.length(ref) > F.length(alt), "Del").when(F.length(ref) < F.length(alt), "Ins").when(ref.isNotNull(), F.substring(alt, 1, 1))


def mixed_label(a: Column, b: Column) -> Column:
    """Label of two allele labels: bases sorted, a base before Ins or Del, equal ones doubled."""
    one_a, one_b = F.length(a) == 1, F.length(b) == 1
    return (
        F.when(one_a & one_b, F.concat(F.least(a, b), F.greatest(a, b)))
        .when(one_a, F.concat(a, b))
        .when(one_b, F.concat(b, a))
        .when(a == b, F.concat(a, b))
        .when(a != b, "InsDel")
    )


def gt21(ref: Column, alt: Column, gt1: Column, gt2: Column) -> Column:
    """Class number of a variant's genotype bases; of several alternates the first two count."""

    def of(alts: Column) -> Column:
        single = F.size(alts) == 1
        first = F.when(single & ((gt1 == 0) | (gt2 == 0)), ref).otherwise(F.get(alts, F.lit(0)))
        second = F.when(single, F.get(alts, F.lit(0))).otherwise(F.get(alts, F.lit(1)))
        return let(partial_label(ref, first), lambda a: let(partial_label(ref, second), lambda b: mixed_label(a, b)))

    return F.array_position(F.array(*map(F.lit, GT21_LABELS)), let(F.split(alt, ","), of)).cast("int") - 1


def zygosity(gt1: Column, gt2: Column) -> Column:
    """0 reference, 1 homozygous, 2 heterozygous."""
    return F.when((gt1 == 0) & (gt2 == 0), 0).when(gt1 == gt2, 1).when(gt1 != gt2, 2)


def lengths(ref: Column, alt: Column, gt1: Column, gt2: Column) -> tuple[Column, Column]:
    """Both alleles' indel lengths, clamped to 16 and ascending, plus 16."""
    sizes = F.transform(F.slice(F.split(alt, ","), 1, 2), lambda a: clamp(F.length(a) - F.length(ref), -FLANK, FLANK) + FLANK)
    both = let(sizes, lambda s: F.when(F.size(s) > 1, s).when((gt1 == 0) | (gt2 == 0), F.array(F.lit(FLANK), s[0])).otherwise(F.array(s[0], s[0])))
    known = ref.isNotNull() & alt.isNotNull() & gt1.isNotNull() & gt2.isNotNull()
    return F.when(known, F.array_min(both)), F.when(known, F.array_max(both))


def argmax(values: Column) -> Column:
    """Place of the first maximum, from 0."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def quality(p: Column) -> Column:
    """Phred-like score of a probability: squared, rounded half to even."""
    tiny = F.lit(1e-300)
    score = F.greatest(F.lit(-10.0) * F.log10((F.lit(1.0) - p + tiny) / (p + tiny)) + 16, F.lit(0.0))
    return F.bround(F.pow(score, 2), 0).cast("int")


def vcf_filter(qual: Column, threshold: int | None) -> Column:
    return F.lit(".") if threshold is None else F.when(qual >= threshold, "PASS").otherwise("LowQual")


def subtract_reference(tensor: Column) -> Column:
    """Channels 1 to 3 minus channel 0 in a flat (33, 8, 4) array."""
    return F.transform(tensor, lambda v, i: F.when(i % CHANNELS == 0, v).otherwise(v - tensor[(i - i % CHANNELS).cast("int")]))


def crop(tensor: Column, width: int, flank: int, merge_strands: bool = False) -> Column:
    """The middle 2 * flank + 1 positions of a flat (width, 8, 4) array; with merged strands, 4 rows."""
    cell = ROWS * CHANNELS
    middle = F.slice(tensor, ((width - 1) // 2 - flank) * cell + 1, (2 * flank + 1) * cell)
    if not merge_strands:
        return middle
    half = cell // 2
    forward = F.filter(middle, lambda _, i: i % cell < half)
    reverse = F.filter(middle, lambda _, i: i % cell >= half)
    return F.zip_with(forward, reverse, lambda a, b: a + b)


def softmax(logits: Column) -> Column:
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, v: s + v))


def focal_loss(logits: Column, y: Column, gamma: float = 2.0, floor: float = 1e-8) -> Column:
    """Sum over classes of the focal loss of the logits' probabilities against one-hot y."""
    log = lambda x: F.ln(F.greatest(F.least(x, F.lit(1.0)), F.lit(floor)))
    term = lambda a, b: F.when(b > 0, -F.pow(b - a, F.lit(gamma)) * log(a)).otherwise(-F.pow(a, F.lit(gamma)) * log(F.lit(1.0) - a))
    return F.aggregate(F.zip_with(softmax(logits), y, term), F.lit(0.0), lambda s, v: s + v)


def cross_entropy(p: Column, y: Column, weights: Column) -> Column:
    """Cross-entropy of probabilities p against one-hot y, with a weight for each class."""
    term = F.zip_with(F.zip_with(p, y, lambda a, b: -b * F.ln(a + F.lit(1e-10))), weights, lambda t, w: t * w)
    return F.aggregate(term, F.lit(0.0), lambda s, v: s + v)


def triangular_lr(step: Column, half_cycle: int, low: float, high: float, mode: str = "tri", gamma: float = 0.95) -> Column:
    """Cyclical learning rate after ``step`` (from 0) updates more: up and down in 2 * half_cycle updates, then one at the lowest rate.

    Each new cycle the highest rate is kept (tri), halved (tri2) or times gamma (exp).
    """
    cycle = F.floor((step + 1) / (2 * half_cycle + 1))
    x = ((step + 1) % (2 * half_cycle + 1)) / F.lit(float(half_cycle))
    top = F.lit(high) * {"tri": F.lit(1.0), "tri2": F.pow(F.lit(0.5), cycle), "exp": F.pow(F.lit(gamma), cycle)}[mode]
    return F.lit(low) + (top - F.lit(low)) * F.greatest(F.lit(0.0), F.when(x <= 1, x).otherwise(F.lit(2.0) - x))
