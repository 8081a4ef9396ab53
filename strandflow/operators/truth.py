"""Truth variants, labels and training-set assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import FLANK, gt21, lengths, let, subtract_reference, zygosity
from . import ordered
from .intervals import near_variants, points_in

VARIANT = ["contig", "pos", "ref", "alt", "gt1", "gt2"]


def parse_genotypes(vcf: DataFrame) -> DataFrame:
    """Adds gt1 and gt2, ascending, from gt such as 0/1 or 1|0; a missing allele is 0. One allele only raises."""
    alleles = F.split(F.replace(F.replace("gt", F.lit("/"), F.lit("|")), F.lit("."), F.lit("0")), r"\|")
    checked = lambda a: F.when(F.size(a) == 2, F.array_sort(F.transform(a, lambda x: x.cast("int")))).otherwise(F.raise_error(F.concat(F.lit("a genotype needs two alleles: "), F.col("gt"))))
    return vcf.withColumn("both", let(alleles, checked)).select(*vcf.columns, F.col("both")[0].alias("gt1"), F.col("both")[1].alias("gt2"))


def split_stars(variants: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows with a * alternate become a row per alternate, the star as a deletion from the base before; others stay. Keeps ord, adds part.

    A star whose base before is not in the reference (at a contig's first
    position, or beyond its end) has no alleles and goes; the row's other
    alternates stay.
    """

    def ordered(alts: Column) -> Column:
        lone = F.array(F.raise_error(F.lit("a lone * alternate"))).cast("array<string>")
        whole = F.array_join(alts, ",")
        moved = F.concat(F.array(F.lit("*"), F.substring(whole, 1, 1)), F.slice(alts, 3, F.size(alts)))
        parts = F.when(F.size(alts) < 2, lone).when(F.get(alts, F.lit(1)) == "*", moved).otherwise(alts)
        return F.when(F.exists(alts, lambda a: F.instr(a, "*") > 0), parts).otherwise(F.array(whole))

    rows = variants.select("*", F.posexplode(let(F.split("alt", ","), ordered)).alias("part", "one"))
    rows = rows.withColumn("starred", F.instr("alt", "*") > 0)
    is_star = F.col("starred") & (F.col("one") == "*")
    before = reference.select("contig", (F.col("pos0") + 1).alias("at"), F.col("base").alias("before"))
    rows = rows.withColumn("at", F.when(is_star, F.col("pos") - 1)).join(before, ["contig", "at"], "left")
    return rows.where(~is_star | F.col("before").isNotNull()).select(
        "ord", "part", "contig", F.when(is_star, F.col("at")).otherwise(F.col("pos")).alias("pos"),
        F.when(is_star, F.concat("before", F.substring("ref", 1, 1))).otherwise(F.col("ref")).alias("ref"),
        F.when(is_star, F.col("before")).otherwise(F.col("one")).alias("alt"),
        F.when(F.col("starred"), 0).otherwise(F.col("gt1")).alias("gt1"), F.when(F.col("starred"), 1).otherwise(F.col("gt2")).alias("gt2"),
    )


def _tail(text: Column, start: Column) -> Column:
    """text[start:] where a negative start counts from the end."""
    return F.when(start < 0, F.right(text, -start)).otherwise(F.substring(text, start + 1, F.length(text)))


def merge_pair(a: Column, b: Column) -> Column:
    """One variant struct of two at a position."""
    shape = lambda ref, alt, g1, g2: F.struct(ref.alias("ref"), alt.alias("alt"), g1.alias("gt1"), g2.alias("gt2"))
    swap = F.length(a["alt"]) > F.length(b["alt"])
    x = F.when(swap, b).otherwise(a)
    y = F.when(swap, a).otherwise(b)
    longer = F.concat(x["alt"], _tail(y["ref"], F.length(x["ref"]) - F.length(y["ref"])), F.lit(","), y["alt"])
    one, two = F.lit(1), F.lit(2)
    return (
        F.when((F.instr(a["ref"], ",") > 0) | (F.instr(a["alt"], ",") > 0), a)
        .when((a["ref"] == b["ref"]) & (a["alt"] == b["alt"]), a)
        .when(a["ref"] == b["ref"], shape(a["ref"], F.concat(a["alt"], F.lit(","), b["alt"]), one, two))
        .otherwise(shape(y["ref"], longer, one, two))
    )


def merge_adjacent(rows: DataFrame) -> DataFrame:
    """Folds neighbouring rows (by ord and part) of equal position into one; equal positions apart stay apart."""
    runs = ordered.runs(rows, ["contig"], ["ord", "part"], "pos")
    each = F.struct("ord", "part", F.struct("ref", "alt", "gt1", "gt2").alias("v"))
    sets = runs.groupBy("contig", "run", "pos").agg(F.array_sort(F.collect_list(each)).alias("rows"))
    values = F.transform("rows", lambda x: x["v"])
    folded = F.aggregate(F.slice(values, 2, F.size(values)), values[0], lambda a, b: merge_pair(a, b))
    # inline() evaluates the fold once for its four fields
    return sets.select("contig", "pos", F.inline(F.array(folded)))


def truth_variants(vcf: DataFrame, reference: DataFrame) -> DataFrame:
    """VARIANT rows of a truth VCF (ord, contig, pos, ref, alt, gt)."""
    return merge_adjacent(split_stars(parse_genotypes(vcf), reference))


def variant_labels(variants: DataFrame) -> DataFrame:
    """contig, pos, gt21, zyg, len1, len2."""
    first, second = lengths(*(F.col(c) for c in ("ref", "alt", "gt1", "gt2")))
    return variants.select("contig", "pos", gt21(*(F.col(c) for c in ("ref", "alt", "gt1", "gt2"))).alias("gt21"), zygosity(F.col("gt1"), F.col("gt2")).alias("zyg"), first.alias("len1"), second.alias("len2"))


def label_sites(sites: DataFrame, labels: DataFrame) -> DataFrame:
    """Sites (contig, pos, base) with their label, or that of the reference base where there is no variant; null for other symbols."""
    base = F.when(F.col("base") == "U", "T").otherwise(F.col("base"))
    plain = F.array_position(F.array(*map(F.lit, "ACGT")), base).cast("int")
    own = F.when(plain == 1, 0).when(plain == 2, 4).when(plain == 3, 7).when(plain == 4, 9)
    joined = sites.join(labels, ["contig", "pos"], "left")
    return joined.select("contig", "pos", "base", F.coalesce("gt21", own).alias("gt21"), F.coalesce("zyg", F.when(own.isNotNull(), 0)).alias("zyg"), F.coalesce("len1", F.when(own.isNotNull(), FLANK)).alias("len1"), F.coalesce("len2", F.when(own.isNotNull(), FLANK)).alias("len2"))


def number_duplicates(rows: DataFrame, allow: bool, most: int = 53) -> DataFrame:
    """Copies of a key by ord: the first only, or up to ``most`` numbered from 0 in ``copy``."""
    nth = F.row_number().over(Window.partitionBy("contig", "pos").orderBy("ord"))
    return rows.withColumn("copy", nth - 1).where(F.col("copy") < (most if allow else 1))


def uniform(*columns: str, seed: int = 0) -> Column:
    """A number from 0 to 1 by row, the same on every run and in any engine with md5."""
    text = F.concat_ws(":", *(F.col(c).cast("string") for c in columns), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pair_non_variants(variant_sites: DataFrame, candidate_sites: DataFrame, amplify: float = 2.0, seed: int = 0, bed: DataFrame | None = None) -> DataFrame:
    """Variant sites and a sample of the candidates that are none, ``amplify`` for each variant on average, at most all; a label column says which.

    With a BED, only candidates whose 1-based position lies in an interval
    count (the position is not shifted). Without candidates left it raises.
    """
    rest = candidate_sites.join(variant_sites.select("contig", "pos").distinct(), ["contig", "pos"], "left_anti")
    rest = rest if bed is None else points_in(rest, bed, at="pos")
    sizes = variant_sites.agg(F.count("*").alias("v")).crossJoin(rest.agg(F.count("*").alias("c"))).first()  # one row
    if not sizes.c:
        raise ValueError("no non-variant candidate to pair with")
    chosen = rest.where(uniform("contig", "pos", seed=seed) <= min(sizes.v * amplify / sizes.c, 1.0))
    return variant_sites.select("contig", "pos", F.lit(1).alias("variant")).unionByName(chosen.select("contig", "pos", F.lit(0).alias("variant")))


#: Chances that a training candidate stays: near a variant, far from all, and where no variants are known.
NEAR_CHANCE, FAR_CHANCE, PLAIN_CHANCE = 0.5, 7e6 / (3e9 - 14e6), 14e6 / 3e9


def training_gate(sites: DataFrame, variants: DataFrame | None = None, near_chance: float = NEAR_CHANCE, far_chance: float = FAR_CHANCE, plain_chance: float = PLAIN_CHANCE, seed: int = 0) -> DataFrame:
    """A random part of the candidate sites, with near: whether a site is near a variant (see near_variants); variants themselves go."""
    draw = uniform("contig", "pos", seed=seed)
    if variants is None:
        return sites.where(draw <= plain_chance).withColumn("near", F.lit(False))
    near = near_variants(variants).withColumn("near", F.lit(True)).hint("merge")  # of exploded rows, whose size Spark takes for the variants'
    rest = sites.join(variants.select("contig", "pos").distinct(), ["contig", "pos"], "left_anti")
    marked = rest.join(near, ["contig", "pos"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    return marked.where(draw <= F.when(F.col("near"), near_chance).otherwise(far_chance))


def near_tallies(gated: DataFrame) -> DataFrame:
    """contig, near, n of the candidates that the gate let through."""
    return gated.groupBy("contig", "near").agg(F.count("*").alias("n"))


def label_vector() -> Column:
    """The 90 numbers of a label (gt21, zyg, len1, len2): four one-hot parts."""
    one = lambda n, at: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col(at)).cast("int"))
    return F.concat(one(21, "gt21"), one(3, "zyg"), one(2 * FLANK + 1, "len1"), one(2 * FLANK + 1, "len2"))


def training_rows(rows: DataFrame, labels: DataFrame, allow_duplicates: bool = False, bed: DataFrame | None = None) -> DataFrame:
    """contig, pos, copy, x, y: tensors (ord, contig, pos, seq, x as counted) with channel 0 taken from the others and their labels by bare key.

    Only sites whose centre is A, C, G, T or U; with a BED, those whose 1-based
    position lies in an interval (not shifted).
    """
    kept = rows.where(F.upper(F.substring("seq", FLANK + 1, 1)).isin(*"ACGTU"))
    kept = number_duplicates(kept if bed is None else points_in(kept, bed, at="pos"), allow_duplicates)
    sites = kept.select("contig", "pos", F.upper(F.substring("seq", FLANK + 1, 1)).alias("base")).distinct()
    labelled = label_sites(sites, labels).select("contig", "pos", label_vector().alias("y")).dropDuplicates(["contig", "pos"])
    return kept.join(labelled, ["contig", "pos"]).select("contig", "pos", "copy", subtract_reference(F.col("x")).alias("x"), "y")


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in an order that the seed and the keys decide, the same on every run."""
    return rows.orderBy(uniform(*keys, seed=seed), *keys)


def split_train(rows: DataFrame, share: float = 0.9) -> DataFrame:
    """Adds split, train for the first ``share`` of the bin's rows by text order of contig:pos, and block of 500 rows."""
    key = F.concat_ws(":", "contig", F.col("pos").cast("string"))
    sizes = rows.groupBy("bin").agg(F.count("*").alias("size"))
    out = ordered.rank(rows.withColumn("__key", key), ["bin"], ["__key"]).join(sizes, "bin")
    return out.select(*rows.columns, F.when(F.col("nth") <= F.floor(F.col("size") * share), "train").otherwise("validation").alias("split"), F.floor((F.col("nth") - 1) / 500).cast("long").alias("block"))
