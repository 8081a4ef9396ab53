"""Scans in order over groups of any size: ranks, run numbers and running maxima without one task for a group.

Rows are dealt into ranges of their order columns, whose bounds come from a
bounded sample (they decide how even the ranges are, never a result). Each
range has a summary row; the summaries of a group are scanned in order, and a
second pass inside the ranges adds what came before. A range is a part of a
group, so a task holds no more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample for each range, about; the driver holds twice as many for all ranges at most.
SAMPLED = 50
PART = "__range"


def with_ranges(rows: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Adds PART, the range of each row's keys, in the order of the keys; equal keys share one."""
    spark = rows.sparkSession
    n = n or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = rows.count()
    keep = max(1, total // (SAMPLED * n))
    sample = rows.select(*keys).where(F.pmod(F.xxhash64(*keys), F.lit(keep)) == 0).distinct().limit(2 * SAMPLED * n)
    seen = sorted((tuple(r) for r in sample.collect()), key=lambda r: tuple((x is not None, x) for x in r))
    bounds = [seen[len(seen) * k // n] for k in range(1, n)] if seen else []
    bounds = sorted(set(bounds), key=lambda r: tuple((x is not None, x) for x in r))
    if not bounds:
        return rows.withColumn(PART, F.lit(0))
    types = {f.name: f.dataType for f in rows.schema}
    lits = F.array(*(F.struct(*(F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, b, strict=True))) for b in bounds))
    return rows.withColumn(PART, F.size(F.filter(lits, lambda b: b <= F.struct(*keys))))


def _range_window(group: list[str], order: list[str]):
    return Window.partitionBy(*group, PART).orderBy(*order)


def _scanned(summaries: DataFrame, group: list[str]):
    return Window.partitionBy(*group).orderBy(PART)


def rank(rows: DataFrame, group: list[str], order: list[str], name: str = "nth", n: int | None = None) -> DataFrame:
    """Adds the row's number from 1 in its group by ``order``."""
    ranged = with_ranges(rows, [*group, *order], n)
    sizes = ranged.groupBy(*group, PART).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(_scanned(sizes, group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*group, PART, before.alias("__before"))
    own = ranged.withColumn("__own", F.row_number().over(_range_window(group, order)))
    return own.join(offsets, [*group, PART]).select(*rows.columns, (F.col("__before") + F.col("__own")).alias(name))


def runs(rows: DataFrame, group: list[str], order: list[str], value: str, name: str = "run", n: int | None = None) -> DataFrame:
    """Adds the number of the row's run, neighbours of equal ``value`` in their group's order."""
    ranged = with_ranges(rows, [*group, *order], n)
    w = _range_window(group, order)
    # in a range all rows but the first know whether they begin a run
    flagged = ranged.withColumn("__last", F.lag(value).over(w)).withColumn("__nth", F.row_number().over(w))
    flagged = flagged.withColumn("__new", F.when(F.col("__nth") > 1, (~F.col(value).eqNullSafe(F.col("__last"))).cast("int")).otherwise(0))
    key = F.struct(*order)
    parts = flagged.groupBy(*group, PART).agg(F.sum("__new").alias("__inner"), F.min(F.struct(key.alias("k"), value)).alias("__a"), F.max(F.struct(key.alias("k"), value)).alias("__z"))
    over = _scanned(parts, group)
    parts = parts.withColumn("__nth", F.row_number().over(over)).withColumn("__left", F.lag("__z").over(over)[value])
    parts = parts.withColumn("__first", ((F.col("__nth") == 1) | ~F.col("__a")[value].eqNullSafe(F.col("__left"))).cast("int"))
    before = F.coalesce(F.sum(F.col("__inner") + F.col("__first")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(*group, PART, (before + F.col("__first")).alias("__before"))
    own = F.sum("__new").over(w)
    return flagged.withColumn("__own", own).join(offsets, [*group, PART]).select(*rows.columns, (F.col("__before") + F.col("__own")).cast("long").alias(name))


def islands(rows: DataFrame, group: list[str], order: list[str], at: str, reach: Column, name: str = "island", n: int | None = None) -> DataFrame:
    """Adds the number of the row's island: a new one begins where ``at`` lies behind all that the rows before reach (null: nothing)."""
    ranged = with_ranges(rows, [*group, *order], n).withColumn("__reach", reach)
    w = _range_window(group, order)
    tops = ranged.groupBy(*group, PART).agg(F.max("__reach").alias("__top"))
    over = _scanned(tops, group).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*group, PART, F.max("__top").over(over).alias("__earlier"))
    own = F.max("__reach").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranged.withColumn("__own", own).join(tops, [*group, PART])
    flagged = flagged.withColumn("__before", F.greatest("__own", "__earlier"))  # skips nulls
    flagged = flagged.withColumn("__new", F.when(F.col("__before").isNull() | (F.col(at) > F.col("__before")), 1).otherwise(0))
    counts = flagged.groupBy(*group, PART).agg(F.sum("__new").alias("__n"))
    counts = counts.select(*group, PART, F.coalesce(F.sum("__n").over(_scanned(counts, group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    numbered = flagged.withColumn("__count", F.sum("__new").over(w)).join(counts, [*group, PART])
    return numbered.select(*rows.columns, (F.col("__offset") + F.col("__count")).alias(name))
