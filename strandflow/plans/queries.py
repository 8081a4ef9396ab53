"""Registered queries of the variant operators over derived relations, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bases as B
from ..operators import calls, intervals, metrics, network, packed, reads, tensors, truth
from ..sources import bam, files
from ..sources.shared import fresh_path
from ..streaming import pileup
from . import calling
from .views import oracle, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_sql(mapq: int = 5, soft: bool = True, source: str = "{reads}") -> str:
    clip = "AND 1.0 - coalesce(list_sum(CAST(regexp_extract_all(cigar, '(\\d+)S', 1) AS INT[])), 0) / (list_sum(CAST(regexp_extract_all(cigar, '(\\d+)[A-Z=]', 1) AS INT[])) + 1) >= 0.55" if soft else ""
    return f"kept AS (SELECT *, row_number() OVER () AS rid FROM {source} WHERE (flag & 2316) = 0 AND mapq >= {mapq} AND cigar <> '*' {clip})"


EVENTS_SQL = r"""
  ops AS (SELECT rid, unnest(CAST(regexp_extract_all(cigar, '(\d+)[A-Z=]', 1) AS INT[])) AS n, unnest(regexp_extract_all(cigar, '\d+([A-Z=])', 1)) AS op, unnest(range(1, len(regexp_extract_all(cigar, '\d+[A-Z=]')) + 1)) AS oi FROM kept),
  offs AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'D') THEN n ELSE 0 END) OVER w, 0) AS aref, coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN n ELSE 0 END) OVER w, 0) AS aq
    FROM ops WINDOW w AS (PARTITION BY rid ORDER BY oi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ev AS (SELECT contig, pos0, ord, CASE WHEN op IN ('I', 'D') THEN op ELSE 'M' END AS kind, j AS k, pos0 + aref + CASE WHEN op = 'I' THEN 0 ELSE j END AS r,
      CASE WHEN op <> 'D' THEN upper(substr(seq, CAST(aq + j + 1 AS BIGINT), 1)) END AS base, (flag & 16) > 0 AS reverse, op <> 'I' AND aref + j = 0 AS is_first, aref > 0 AS begun
    FROM offs JOIN kept USING (rid), LATERAL (SELECT unnest(range(0, n)) AS j) WHERE op IN ('M', '=', 'X', 'I', 'D'))"""
ACGT_SQL = "translate({0}, 'URYSWKMBDHV', 'TACCAGACAAA')"
PILE_SQL = f"""
  pile AS (SELECT contig, CASE WHEN kind = 'M' THEN r ELSE r - 1 END AS p, CASE WHEN kind = 'M' THEN {ACGT_SQL.format('base')} ELSE kind END AS s FROM ev WHERE kind = 'M' OR k = 0),
  counts AS (SELECT contig, CAST(p AS BIGINT) AS pos0, {', '.join(f"count(*) FILTER (s = '{s}') AS {s}" for s in reads.SYMBOLS)} FROM pile GROUP BY ALL)"""
CAND_SQL = """
  ranked AS (SELECT c.*, x.base AS rb, A + C + G + T + N AS depth, list_sort([{m: -A, o: 0, s: 'A'}, {m: -C, o: 1, s: 'C'}, {m: -G, o: 2, s: 'G'}, {m: -T, o: 3, s: 'T'}, {m: -I, o: 4, s: 'I'}, {m: -D, o: 5, s: 'D'}, {m: -N, o: 6, s: 'N'}]) AS top
    FROM counts c JOIN {reference} x ON x.contig = c.contig AND x.pos0 = c.pos0),
  cand AS (SELECT contig, pos0 + 1 AS pos, rb AS ref, CAST(depth AS BIGINT) AS depth, array_to_string(list_transform(top, lambda rk: rk.s || ' ' || CAST(-rk.m AS VARCHAR)), ' ') AS counts
    FROM ranked WHERE depth >= 4 AND (top[1].s <> rb OR -top[2].m / greatest(depth, 1) >= 0.2))""".replace("{m:", "{{m:").replace("'}", "'}}").replace("{{", "{").replace("}}", "}")


def kept_reads(spark: SparkSession, d: str, mapq: int = 5) -> DataFrame:
    return reads.filter_reads(relation(spark, d, "reads"), mapq)


def counts_of(spark: SparkSession, d: str) -> DataFrame:
    return packed.pileup_counts(relation(spark, d, "reads"), 5)


def sites_of(spark: SparkSession, d: str) -> DataFrame:
    return reads.candidates(counts_of(spark, d), relation(spark, d, "reference"), 0.2, 4)


@query(f"WITH {kept_sql()} SELECT contig, pos0, mapq, flag, cigar, seq, ord FROM kept")
def read_filters(spark, d):
    return kept_reads(spark, d).drop("lens", "ops")


#: Contigs of files that queries write and read back; no position lies beyond.
FILE_CONTIGS = [("chr1", 1 << 28), ("chr2", 1 << 28), ("chr3", 1 << 28)]


def _bam(spark, d) -> str:
    path = fresh_path(spark, "reads") + ".bam"
    bam.write_bam(relation(spark, d, "reads"), FILE_CONTIGS, path)
    return path


@query(f"WITH {kept_sql()} SELECT contig, pos0, mapq, flag, cigar, seq FROM kept")
def bam_reads(spark, d):
    """The reads written as one indexed BAM file and read back, filters in the scan."""
    return reads.filter_reads(bam.read_bam(spark, _bam(spark, d), min_mapq=5, without_flags=reads.DROPPED_FLAGS), 5).drop("lens", "ops", "ord")


@query(r"""WITH r AS (SELECT *, coalesce(list_sum(CAST(regexp_extract_all(cigar, '(\d+)[M=XDN]', 1) AS INT[])), 0) AS span FROM {reads})
  SELECT contig, pos0, mapq, flag, cigar, seq FROM r WHERE contig = 'chr2' AND pos0 <= 2999 AND pos0 + greatest(span, 1) > 2000""")
def bam_region(spark, d):
    """Reads over chr2:2001-3000 by the file's index."""
    return bam.read_bam(spark, _bam(spark, d), "chr2", 2001, 3000).drop("ord")


@query("SELECT contig, pos, ref, alt, CAST(qual AS BIGINT) AS qual FROM {calls} WHERE contig = 'chr3' AND pos BETWEEN 1000 AND 9000")
def vcf_region(spark, d):
    """Calls written as one sorted VCF file with a tabix index; those of chr3:1000-9000 read back by it."""
    path = fresh_path(spark, "calls") + ".vcf.gz"
    done = relation(spark, d, "calls").select("contig", "pos", "ref", "alt", "qual", F.lit(".").alias("filter"), F.lit("0/1").alias("gt"), F.col("qual").cast("int").alias("gq"), F.lit(10).alias("dp"), F.lit(0.5).alias("af"))
    files.write_vcf_file(done, FILE_CONTIGS, path)
    return _longs(files.read_vcf(spark, path, "chr3", 1000, 9000).select("contig", "pos", "ref", "alt", "qual"), "qual")


@query(f"WITH {kept_sql()}, {EVENTS_SQL} SELECT contig, CAST(r AS BIGINT) AS r, kind, CAST(k AS INT) AS k, base, reverse, count(*) AS n FROM ev GROUP BY ALL")
def cigar_expand(spark, d):
    return packed.event_counts(relation(spark, d, "reads"), 5)


@query(f"WITH {kept_sql()}, {EVENTS_SQL}, {PILE_SQL} SELECT * FROM counts")
def pileup_counts(spark, d):
    return counts_of(spark, d)


@query(f"WITH {kept_sql()}, {EVENTS_SQL}, {PILE_SQL}, {CAND_SQL} SELECT * FROM cand")
def candidates(spark, d):
    return sites_of(spark, d)


def _column(rows) -> list[tuple]:
    """A position's depth, symbols of the reverse strand and symbols in read order."""
    first = rows[0]
    return [(first["contig"], first["pos0"], len({(r["start"], r["ord"]) for r in rows}), sum(r["reverse"] for r in rows), "".join(r["symbol"] for r in rows))]


@query(f"""WITH {kept_sql()}, {EVENTS_SQL},
  shown AS (SELECT contig, CASE kind WHEN 'M' THEN r WHEN 'D' THEN r - k - 1 ELSE r - 1 END AS p, kind, CASE kind WHEN 'M' THEN base WHEN 'I' THEN '+' || base ELSE '-' END AS symbol, k, reverse, pos0 AS start, ord FROM ev),
  nth AS (SELECT *, dense_rank() OVER (PARTITION BY contig, p ORDER BY start, ord) AS nth FROM shown)
  SELECT contig, CAST(p AS BIGINT) AS pos0, count(DISTINCT (start, ord)) AS reads, count(*) FILTER (reverse) AS reversed, string_agg(symbol, '' ORDER BY start, ord, kind, k, symbol) AS text FROM nth WHERE nth <= 250 GROUP BY contig, p""")
def pileup_columns(spark, d):
    """Every position's symbols by a pileup function that SQL calls."""
    spark.udtf.register("pileup_column", reads.pileup_function(_column, "contig string, pos0 long, reads long, reversed long, text string"))
    rows = reads.pileup_rows(reads.expand(kept_reads(spark, d)))
    return spark.sql(f"SELECT * FROM pileup_column(TABLE({{rows}}) PARTITION BY (contig, pos0) ORDER BY ({', '.join(reads.READ_ORDER)}))", rows=rows)


CLEAN_BED = "(SELECT contig, start, CASE WHEN start = end_ THEN end_ + 1 ELSE end_ END AS e FROM {bed})"


@query(f"WITH {kept_sql()}, {EVENTS_SQL}, {PILE_SQL}, {CAND_SQL} SELECT * FROM cand c WHERE c.pos BETWEEN 101 AND 12000 AND EXISTS (SELECT 1 FROM {CLEAN_BED} b WHERE b.contig = c.contig AND c.pos - 1 >= b.start AND c.pos - 1 < b.e)")
def candidates_bed(spark, d):
    # reads that touch neither the region nor an interval are left out before they are expanded
    kept = reads.touching(kept_reads(spark, d), 101, 12000)
    near = intervals.intervals_near(reads.spans(kept), relation(spark, d, "bed"))
    counts = reads.pileup_counts(reads.expand(near))
    sites = reads.in_region(reads.candidates(counts, relation(spark, d, "reference"), 0.2, 4), 101, 12000).withColumn("pos0", F.col("pos") - 1)
    return intervals.points_in(sites, relation(spark, d, "bed")).drop("pos0")


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY contig, pos0 ORDER BY ord) AS nth FROM {reads}) SELECT contig, pos0, ord, cigar FROM t WHERE nth <= CASE WHEN pos0 = 0 THEN 1 ELSE 2 END")
def depth_cap(spark, d):
    return reads.cap_depth(relation(spark, d, "reads"), 2).select("contig", "pos0", "ord", "cigar")


INDEX = [("chr1", 20_000), ("chr2", 19_000), ("X", 1_001), ("chrM", 16_569), ("chr3", 500)]


@query(f"""WITH idx AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {n})" for c, n in INDEX)}) v(contig, size)),
  ch AS (SELECT contig, CAST(k * 1000 AS BIGINT) AS start, CAST(least((k + 1) * 1000, size) AS BIGINT) AS e2 FROM idx, LATERAL (SELECT unnest(range(0, CAST(ceil(size / 1000.0) AS BIGINT))) AS k) WHERE contig <> 'chrM')
  SELECT contig, start, e2 AS "end" FROM ch c WHERE EXISTS (SELECT 1 FROM {CLEAN_BED} b WHERE b.contig = c.contig AND c.start < b.e AND b.start < c.e2)""")
def chunk_plan(spark, d):
    index = spark.createDataFrame(INDEX, "contig string, length long")
    return intervals.intervals_overlapping(intervals.plan_chunks(index, 1000), relation(spark, d, "bed"))


@query("""WITH v AS (SELECT DISTINCT contig, pos FROM {vcf}), s AS (SELECT contig, pos + o AS pos, min(abs(o)) AS away FROM v, (SELECT unnest(range(-16, 17)) AS o) x WHERE pos + o > 0 GROUP BY ALL)
  SELECT contig, pos FROM s WHERE away >= 15""")
def near_variant_sites(spark, d):
    return intervals.near_variants(relation(spark, d, "vcf"))


TRUTH_SQL = """
  gts AS (SELECT contig, pos, ref, alt, ord, least(a, b) AS gt1, greatest(a, b) AS gt2, contains(alt, '*') AS star, string_split(alt, ',') AS alts
    FROM (SELECT *, CAST(split_part(replace(replace(gt, '/', '|'), '.', '0'), '|', 1) AS INT) AS a, CAST(split_part(replace(replace(gt, '/', '|'), '.', '0'), '|', 2) AS INT) AS b FROM {vcf})),
  arr AS (SELECT *, CASE WHEN NOT star THEN [alt] WHEN alts[2] = '*' THEN list_concat(['*', substr(alt, 1, 1)], alts[3:]) ELSE alts END AS ones FROM gts),
  one AS (SELECT * EXCLUDE (ones), unnest(ones) AS o, unnest(range(0, len(ones))) AS part FROM arr),
  parts AS (SELECT ord, part, one.contig, CASE WHEN star AND o = '*' THEN pos - 1 ELSE pos END AS pos, CASE WHEN star AND o = '*' THEN x.base || substr(ref, 1, 1) ELSE ref END AS ref,
      CASE WHEN star AND o = '*' THEN x.base ELSE o END AS alt, CASE WHEN star THEN 0 ELSE gt1 END AS gt1, CASE WHEN star THEN 1 ELSE gt2 END AS gt2
    FROM one LEFT JOIN {reference} x ON star AND o = '*' AND x.contig = one.contig AND x.pos0 = one.pos - 2
    WHERE x.base IS NOT NULL OR NOT (star AND o = '*')),
  lagged AS (SELECT *, CASE WHEN pos <> lag(pos) OVER w THEN 1 WHEN lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM parts WINDOW w AS (PARTITION BY contig ORDER BY ord, part)),
  runs AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY ord, part) AS run FROM lagged),
  nth AS (SELECT *, row_number() OVER (PARTITION BY contig, run ORDER BY ord, part) AS i, count(*) OVER (PARTITION BY contig, run) AS many FROM runs),
  fold AS (
    SELECT contig, run, i, many, pos, ref, alt, gt1, gt2 FROM nth WHERE i = 1
    UNION ALL
    SELECT a.contig, a.run, b.i, a.many, a.pos,
      CASE WHEN contains(a.ref, ',') OR contains(a.alt, ',') OR a.ref = b.ref THEN a.ref WHEN length(a.alt) > length(b.alt) THEN a.ref ELSE b.ref END,
      CASE WHEN contains(a.ref, ',') OR contains(a.alt, ',') OR (a.ref = b.ref AND a.alt = b.alt) THEN a.alt WHEN a.ref = b.ref THEN a.alt || ',' || b.alt
        WHEN length(a.alt) > length(b.alt) THEN b.alt || CASE WHEN length(b.ref) - length(a.ref) < 0 THEN right(a.ref, length(a.ref) - length(b.ref)) ELSE substr(a.ref, length(b.ref) - length(a.ref) + 1) END || ',' || a.alt
        ELSE a.alt || CASE WHEN length(a.ref) - length(b.ref) < 0 THEN right(b.ref, length(b.ref) - length(a.ref)) ELSE substr(b.ref, length(a.ref) - length(b.ref) + 1) END || ',' || b.alt END,
      CASE WHEN contains(a.ref, ',') OR contains(a.alt, ',') OR (a.ref = b.ref AND a.alt = b.alt) THEN a.gt1 ELSE 1 END,
      CASE WHEN contains(a.ref, ',') OR contains(a.alt, ',') OR (a.ref = b.ref AND a.alt = b.alt) THEN a.gt2 ELSE 2 END
    FROM fold a JOIN nth b ON b.contig = a.contig AND b.run = a.run AND b.i = a.i + 1),
  truth AS (SELECT contig, pos, ref, alt, gt1, gt2 FROM fold WHERE i = many)"""


def truth_of(spark, d):
    return truth.truth_variants(relation(spark, d, "vcf").select("ord", "contig", "pos", "ref", "alt", "gt"), relation(spark, d, "reference"))


@query(f"WITH {TRUTH_SQL} SELECT * FROM truth")
def truth_variants(spark, d):
    return truth_of(spark, d)


MERGE_SQL = TRUTH_SQL[: TRUTH_SQL.index("arr AS")] + "parts AS (SELECT ord, 0 AS part, contig, pos, ref, alt, gt1, gt2 FROM gts)," + TRUTH_SQL[TRUTH_SQL.index("lagged AS") - 3 :]


@query(f"WITH {MERGE_SQL} SELECT * FROM truth")
def truth_merge(spark, d):
    """Merges of neighbours alone, stars as they are."""
    return truth.merge_adjacent(truth.parse_genotypes(relation(spark, d, "vcf")).withColumn("part", F.lit(0)))


LABEL_SQL = f"""
  lab AS (SELECT *, string_split(alt, ',') AS als FROM truth),
  two AS (SELECT *, CASE WHEN len(als) = 1 THEN CASE WHEN gt1 = 0 OR gt2 = 0 THEN ref ELSE als[1] END ELSE als[1] END AS x, CASE WHEN len(als) = 1 THEN als[1] ELSE als[2] END AS y FROM lab),
  pl AS (SELECT *, CASE WHEN length(ref) > length(x) THEN 'Del' WHEN length(ref) < length(x) THEN 'Ins' ELSE substr(x, 1, 1) END AS px, CASE WHEN length(ref) > length(y) THEN 'Del' WHEN length(ref) < length(y) THEN 'Ins' ELSE substr(y, 1, 1) END AS py FROM two),
  labels_ AS (SELECT contig, pos, list_position([{', '.join(repr(x) for x in B.GT21_LABELS)}], CASE WHEN length(px) = 1 AND length(py) = 1 THEN least(px, py) || greatest(px, py) WHEN length(px) = 1 THEN px || py WHEN length(py) = 1 THEN py || px WHEN px = py THEN px || py ELSE 'InsDel' END) - 1 AS gt21,
      CASE WHEN gt1 = 0 AND gt2 = 0 THEN 0 WHEN gt1 = gt2 THEN 1 ELSE 2 END AS zyg,
      least(greatest(least(length(x) - length(ref), 16), -16), greatest(least(length(y) - length(ref), 16), -16)) + 16 AS len1, greatest(greatest(least(length(x) - length(ref), 16), -16), greatest(least(length(y) - length(ref), 16), -16)) + 16 AS len2 FROM pl)"""
_AS_LONG = ["gt21", "zyg", "len1", "len2"]


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query(f"WITH {TRUTH_SQL}, {LABEL_SQL} SELECT contig, pos, CAST(gt21 AS BIGINT) AS gt21, CAST(zyg AS BIGINT) AS zyg, CAST(len1 AS BIGINT) AS len1, CAST(len2 AS BIGINT) AS len2 FROM labels_")
def variant_labels(spark, d):
    return _longs(truth.variant_labels(truth_of(spark, d)), *_AS_LONG)


@query("""SELECT contig, pos0 + 1 AS pos, base, CAST(CASE base WHEN 'A' THEN 0 WHEN 'C' THEN 4 WHEN 'G' THEN 7 ELSE 9 END AS BIGINT) AS gt21, CAST(0 AS BIGINT) AS zyg, CAST(16 AS BIGINT) AS len1, CAST(16 AS BIGINT) AS len2 FROM {reference}""")
def reference_labels(spark, d):
    none = spark.createDataFrame([], "contig string, pos long, gt21 int, zyg int, len1 int, len2 int")
    sites = relation(spark, d, "reference").select("contig", (F.col("pos0") + 1).alias("pos"), "base")
    return _longs(truth.label_sites(sites, none), *_AS_LONG)


@query(f"""WITH {TRUTH_SQL}, {LABEL_SQL} SELECT s.contig, s.pos0 + 1 AS pos, base, CAST(coalesce(gt21, CASE base WHEN 'A' THEN 0 WHEN 'C' THEN 4 WHEN 'G' THEN 7 ELSE 9 END) AS BIGINT) AS gt21, CAST(coalesce(zyg, 0) AS BIGINT) AS zyg, CAST(coalesce(len1, 16) AS BIGINT) AS len1, CAST(coalesce(len2, 16) AS BIGINT) AS len2
  FROM {{reference}} s LEFT JOIN labels_ l ON l.contig = s.contig AND l.pos = s.pos0 + 1""".replace("{{reference}}", "{reference}"))
def label_join(spark, d):
    sites = relation(spark, d, "reference").select("contig", (F.col("pos0") + 1).alias("pos"), "base")
    return _longs(truth.label_sites(sites, truth.variant_labels(truth_of(spark, d))), *_AS_LONG)


@query("WITH r AS (SELECT contig, pos0 AS pos, ord, row_number() OVER (PARTITION BY contig, pos0 ORDER BY ord) - 1 AS copy FROM {reads}) SELECT contig, pos, ord, copy FROM r WHERE copy < 4")
def dup_keys(spark, d):
    rows = relation(spark, d, "reads").select("contig", F.col("pos0").alias("pos"), "ord")
    return _longs(truth.number_duplicates(rows, True, 4), "copy")


U_SQL = "CAST(CAST('0x' || substr(md5(contig || ':' || pos || ':0'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


@query(f"""WITH v AS (SELECT DISTINCT contig, pos FROM {{vcf}}), c AS (SELECT contig, pos0 + 1 AS pos FROM {{reference}}), rest AS (SELECT * FROM c ANTI JOIN v USING (contig, pos))
  SELECT contig, pos, 1 AS variant FROM v UNION ALL SELECT contig, pos, 0 FROM rest WHERE {U_SQL} <= least((SELECT count(*) FROM v) * 2.0 / (SELECT count(*) FROM rest), 1.0)""")
def pair_non_variants(spark, d):
    v = relation(spark, d, "vcf").select("contig", "pos").distinct()
    return truth.pair_non_variants(v, relation(spark, d, "reference").select("contig", (F.col("pos0") + 1).alias("pos")))


@query("""WITH b AS (SELECT contig AS bin, contig, pos FROM (SELECT DISTINCT contig, pos FROM {vcf})), n AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY contig || ':' || pos) AS nth, count(*) OVER (PARTITION BY bin) AS size FROM b)
  SELECT bin, contig, pos, CASE WHEN nth <= floor(size * 0.9) THEN 'train' ELSE 'validation' END AS split, CAST(floor((nth - 1) / 500.0) AS BIGINT) AS block FROM n""")
def train_validation_split(spark, d):
    return truth.split_train(relation(spark, d, "vcf").select(F.col("contig").alias("bin"), "contig", "pos").distinct())


@query(f"""WITH c AS (SELECT contig, pos0 + 1 AS pos FROM {{reference}}), b AS (SELECT contig, start, CASE WHEN start = end_ THEN end_ + 1 ELSE end_ END AS e FROM {{bed}}), v AS (SELECT DISTINCT contig, pos FROM {{vcf}}),
  rest AS (SELECT * FROM c WHERE EXISTS (SELECT 1 FROM b WHERE b.contig = c.contig AND c.pos >= b.start AND c.pos < b.e) AND NOT EXISTS (SELECT 1 FROM v WHERE v.contig = c.contig AND v.pos = c.pos))
  SELECT contig, pos, 1 AS variant FROM v UNION ALL SELECT contig, pos, 0 FROM rest WHERE {U_SQL} <= least((SELECT count(*) FROM v) * 0.5 / (SELECT count(*) FROM rest), 1.0)""")
def pair_non_variants_bed(spark, d):
    v = relation(spark, d, "vcf").select("contig", "pos").distinct()
    return truth.pair_non_variants(v, relation(spark, d, "reference").select("contig", (F.col("pos0") + 1).alias("pos")), 0.5, bed=relation(spark, d, "bed"))


GATE_SQL = f"""v AS (SELECT DISTINCT contig, pos FROM {{vcf}}), near_ AS (SELECT contig, pos + o AS pos, min(abs(o)) AS away FROM v, (SELECT unnest(range(-16, 17)) AS o) x GROUP BY ALL),
  gate AS (SELECT c.contig, c.pos, n.pos IS NOT NULL AS near FROM cand c LEFT JOIN (SELECT * FROM near_ WHERE away >= 15) n ON n.contig = c.contig AND n.pos = c.pos
    WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.contig = c.contig AND v.pos = c.pos) AND {U_SQL.replace("contig || ':' || pos", "c.contig || ':' || c.pos")} <= CASE WHEN n.pos IS NOT NULL THEN 0.5 ELSE 0.25 END)"""


def _gated(spark, d):
    return truth.training_gate(sites_of(spark, d).select("contig", "pos"), relation(spark, d, "vcf"), far_chance=0.25)


@query(f"WITH {kept_sql()}, {EVENTS_SQL}, {PILE_SQL}, {CAND_SQL}, {GATE_SQL} SELECT * FROM gate")
def training_gate(spark, d):
    return _gated(spark, d)


@query(f"WITH {kept_sql()}, {EVENTS_SQL}, {PILE_SQL}, {CAND_SQL}, {GATE_SQL} SELECT contig, near, count(*) AS n FROM gate GROUP BY ALL")
def near_tallies(spark, d):
    return truth.near_tallies(_gated(spark, d))


BIN_SQL = "SELECT contig, pos, ord, CAST(floor((row_number() OVER (PARTITION BY contig ORDER BY pos, ord) - 1) / 500.0) AS BIGINT) AS block FROM {calls}"


def _bins(spark, d) -> dict[str, DataFrame]:
    w = Window.partitionBy("contig").orderBy("pos", "ord")
    rows = relation(spark, d, "calls").select("contig", "pos", "ord", F.floor((F.row_number().over(w) - 1) / 500).alias("block"))
    return {c: rows.where(F.col("contig") == c) for c in ("chr1", "chr2", "chr3")}


@query(f"""WITH b AS ({BIN_SQL}), sizes AS (SELECT contig, max(block) + 1 AS blocks FROM b GROUP BY contig)
  SELECT contig, pos, ord, block + CAST(coalesce((SELECT sum(blocks) FROM sizes s WHERE s.contig < b.contig), 0) AS BIGINT) AS block FROM b""")
def union_bins(spark, d):
    return files.combine_bins(list(_bins(spark, d).values()))


@query(f"WITH b AS ({BIN_SQL}) SELECT contig AS bin, contig, pos, ord, block FROM b WHERE block % 2 = 0")
def read_bins(spark, d):
    """Every bin written by split and read back, their train parts only."""
    root, paths = fresh_path(spark, "bins"), []
    for name in ("chr1", "chr2", "chr3"):
        rows = _bins(spark, d)[name].withColumn("split", F.when(F.col("block") % 2 == 0, "train").otherwise("validation"))
        paths.append(f"{root}/{name}")
        files.write_bins(rows, paths[-1])
    return files.read_bins(spark, *paths, split="train").drop("split")


ROW_SQL = "CASE WHEN instr('ACGTURYSWKMBDHVN', {0}) > 0 THEN instr('ACGT', translate({0}, 'URYSWKMBDHVN', 'TACCAGACAAAA')) - 1 END + CASE WHEN reverse THEN 4 ELSE 0 END"
CENTRES = "centres AS (SELECT DISTINCT contig, pos FROM {vcf})"
HITS_SQL = f"""
  refd AS (SELECT ev.*, {ROW_SQL.format('x.base')} AS rr, {ROW_SQL.format('ev.base')} AS qr FROM ev JOIN {{reference}} x ON x.contig = ev.contig AND x.pos0 = ev.r),
  hits AS (SELECT c.contig, c.pos, e.*EXCLUDE (contig), CAST(e.r - c.pos + 17 AS BIGINT) AS i FROM centres c JOIN refd e ON e.contig = c.contig AND e.r BETWEEN c.pos - 17 AND c.pos + 16 {{edge}}),
  cell AS (
    SELECT contig, pos, i AS idx, unnest([rr, qr, rr, qr]) AS "row", unnest([0, 1, 2, 3]) AS ch FROM hits WHERE kind = 'M' AND i BETWEEN 0 AND 32 AND rr IS NOT NULL AND qr IS NOT NULL
    UNION ALL SELECT contig, pos, i, rr, 2 FROM hits WHERE kind = 'D' AND i BETWEEN 1 AND 32 AND rr IS NOT NULL AND NOT is_first
    UNION ALL SELECT contig, pos, least(i + k, 32), qr, 1 FROM hits WHERE kind = 'I' AND i BETWEEN 1 AND 32 AND qr IS NOT NULL AND begun)
  SELECT contig, pos, CAST(idx AS BIGINT) AS idx, CAST("row" AS BIGINT) AS "row", CAST(ch AS BIGINT) AS ch, count(*) AS n FROM cell GROUP BY ALL"""


def _events(spark, d):
    return reads.expand(reads.filter_reads(relation(spark, d, "reads"), 5, soft_clip=False))


def _position_counts(spark, d):
    return tensors.position_counts_of(relation(spark, d, "reads"), relation(spark, d, "reference"), 5)


def _centres(spark, d):
    return relation(spark, d, "vcf").select("contig", "pos").distinct()


@query(f"WITH {kept_sql(soft=False)}, {EVENTS_SQL}, {CENTRES}, " + HITS_SQL.replace("{edge}", ""))
def window_tensor(spark, d):
    return _longs(tensors.window_cells(_centres(spark, d), _position_counts(spark, d)), "idx", "row", "ch")


@query(f"""WITH {kept_sql(soft=False)}, {EVENTS_SQL}, {CENTRES},
  aligned AS (SELECT ev.contig, ev.r, count(*) AS n FROM ev JOIN {{reference}} x ON x.contig = ev.contig AND x.pos0 = ev.r WHERE kind = 'M' AND {ROW_SQL.format('x.base')} IS NOT NULL AND {ROW_SQL.format('ev.base')} IS NOT NULL GROUP BY ALL)
  SELECT c.contig, c.pos, CAST(i AS BIGINT) AS idx, CAST(coalesce(n, 0) AS BIGINT) AS depth FROM centres c CROSS JOIN (SELECT unnest(range(0, 33)) AS i) w LEFT JOIN aligned a ON a.contig = c.contig AND a.r = c.pos + i - 17""")
def window_depth(spark, d):
    """Aligned bases at each index of the window tensors."""
    return _longs(tensors.window_depth(_centres(spark, d), _events(spark, d), relation(spark, d, "reference")), "idx", "depth")


@query(f"WITH {kept_sql(soft=False)}, {EVENTS_SQL}, {CENTRES}, " + HITS_SQL.replace("{edge}", "AND EXISTS (SELECT 1 FROM ev t WHERE t.contig = e.contig AND t.pos0 = e.pos0 AND t.ord = e.ord AND t.kind <> 'I' AND t.r = c.pos - 17)"))
def tensor_left_edge_off(spark, d):
    return _longs(tensors.window_cells_left_edge(_centres(spark, d), _events(spark, d), relation(spark, d, "reference")), "idx", "row", "ch")


def _dense(spark, d, subtract=False):
    return tensors.dense(tensors.window_cells(_centres(spark, d), _position_counts(spark, d)), subtract)


DENSE_SQL = f"WITH {kept_sql(soft=False)}, {EVENTS_SQL}, {CENTRES}, " + HITS_SQL.replace("{edge}", "").replace("SELECT contig, pos, CAST(idx AS BIGINT) AS idx", "long AS (SELECT contig, pos, CAST(idx AS BIGINT) AS idx").replace("SELECT contig, pos, i AS idx", "SELECT contig, pos, i AS idx").replace("begun)\n  long", "begun),\n  long") + ")"


@query(DENSE_SQL + """, base0 AS (SELECT contig, pos, idx, "row", n FROM long WHERE ch = 0)
  SELECT l.contig, l.pos, CAST(sum(CASE WHEN ch = 0 THEN l.n ELSE l.n - coalesce(b.n, 0) END) AS BIGINT) AS total, CAST(sum(l.n * (ch + 1)) AS BIGINT) AS weighted
  FROM long l LEFT JOIN base0 b USING (contig, pos, idx, "row") WHERE NOT (ch > 0 AND false) GROUP BY ALL""")
def tensor_channels(spark, d):
    x = _dense(spark, d).withColumn("y", B.subtract_reference(F.col("x")))
    # cells without counts of their own still lose channel 0; the sum takes those with counts
    total = F.aggregate(F.filter(F.zip_with("x", "y", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s["a"] != 0), F.lit(0).cast("long"), lambda s, v: s + v["b"])
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (i % 4 + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return x.select("contig", "pos", total.alias("total"), weighted.alias("weighted"))


@query(DENSE_SQL + """ SELECT contig, pos, CAST(coalesce(sum(n) FILTER (idx BETWEEN 8 AND 24), 0) AS BIGINT) AS total, CAST(coalesce(sum(n * (("row" % 4) * 4 + ch)) FILTER (idx BETWEEN 8 AND 24), 0) AS BIGINT) AS weighted FROM long GROUP BY ALL""")
def tensor_crop(spark, d):
    y = B.crop(F.col("x"), B.WIDTH, 8, merge_strands=True)
    sums = lambda f: F.aggregate(F.transform(y, f), F.lit(0).cast("long"), lambda s, v: s + v)
    return _dense(spark, d).select("contig", "pos", sums(lambda v: v).alias("total"), sums(lambda v, i: v * (i % 16)).alias("weighted"))


def _subtracted(spark, d):
    return _dense(spark, d, subtract=True)


# channel 0 is in every other channel of a match, so sums of the subtracted tensor are differences of raw ones
@query(DENSE_SQL + """ SELECT contig, pos, CAST(coalesce(sum(n) FILTER (idx = 16 AND ch = 2), 0) AS BIGINT) AS depth FROM long GROUP BY ALL""")
def read_depth(spark, d):
    return _subtracted(spark, d).select("contig", "pos", calls.read_depth(F.col("x")).cast("long").alias("depth"))


AF_SQL = """ , sums AS (SELECT contig, pos, sum(n) FILTER (idx = 16 AND ch = 2) AS depth, coalesce(sum(n) FILTER (idx = 17 AND ch = 2), 0) - coalesce(sum(n) FILTER (idx = 17 AND ch = 0), 0) AS gone,
      coalesce(sum(n) FILTER (idx = 17 AND ch = 1), 0) - coalesce(sum(n) FILTER (idx = 17 AND ch = 3), 0) AS gain, [coalesce(sum(n) FILTER (idx = 16 AND ch = 3 AND "row" % 4 = 0), 0), coalesce(sum(n) FILTER (idx = 16 AND ch = 3 AND "row" % 4 = 1), 0),
      coalesce(sum(n) FILTER (idx = 16 AND ch = 3 AND "row" % 4 = 2), 0), coalesce(sum(n) FILTER (idx = 16 AND ch = 3 AND "row" % 4 = 3), 0)] AS snp, [coalesce(sum(n) FILTER (idx = 16 AND ch = 0 AND "row" % 4 = 0), 0),
      coalesce(sum(n) FILTER (idx = 16 AND ch = 0 AND "row" % 4 = 1), 0), coalesce(sum(n) FILTER (idx = 16 AND ch = 0 AND "row" % 4 = 2), 0), coalesce(sum(n) FILTER (idx = 16 AND ch = 0 AND "row" % 4 = 3), 0)] AS same FROM long GROUP BY ALL)"""
_AF_CASES = [("reference", "A", "A", "same[1]"), ("hom_snp", "A", "G", "snp[3]"), ("het_snp", "C", "A,G", "snp[1] + snp[3]"), ("hom_ins", "A", "AC", "gain"), ("het_base_ins", "A", "AC", "gain"), ("het_base_ins", "A", "T,AC", "gain + snp[4]"), ("het_ins_ins", "A", "AC,ACC", "gain"),
             ("hom_del", "AC", "A", "gone"), ("het_base_del", "AC", "A", "gone"), ("het_base_del", "AC", "A,GC", "gone + snp[3]"), ("het_del_del", "ACT", "A,AT", "gone"), ("ins_del", "AC", "A,ATTC", "gain + gone")]


@query(DENSE_SQL + AF_SQL + " UNION ALL ".join(f" SELECT contig, pos, {k} AS call, least(({e}) / depth, 1.0) AS af FROM sums WHERE depth > 0" for k, (_, _, _, e) in enumerate(_AF_CASES)))
def allele_frequency(spark, d):
    cases = F.array(*(F.struct(F.lit(k).alias("call"), F.lit(cls).alias("cls"), F.lit(ref).alias("ref"), F.lit(alt).alias("alt")) for k, (cls, ref, alt, _) in enumerate(_AF_CASES)))
    rows = _subtracted(spark, d).select("contig", "pos", "x", F.inline(cases))
    return rows.select("contig", "pos", "call", calls.allele_frequency(F.col("x"), F.col("cls"), F.col("ref"), F.col("alt")).alias("af")).where("af IS NOT NULL")


@query(f"""WITH {kept_sql(soft=False)}, {EVENTS_SQL}, st AS (SELECT contig, pos0, ord, r - k AS spot, count(*) AS size FROM ev WHERE kind = 'D' GROUP BY ALL),
  met AS (SELECT contig, CAST(spot - 1 AS BIGINT) AS pos0, size, count(*) AS n, min((pos0, ord)) AS seen FROM st GROUP BY contig, spot, size),
  best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY contig, pos0 ORDER BY n DESC, seen, size) = 1)
  SELECT b.contig, b.pos0, coalesce(string_agg(x.base, '' ORDER BY x.pos0), '') AS bases, n FROM best b LEFT JOIN {{reference}} x ON x.contig = b.contig AND x.pos0 > b.pos0 AND x.pos0 <= b.pos0 + size GROUP BY b.contig, b.pos0, n""".replace("{{reference}}", "{reference}"))
def deleted_bases_mode(spark, d):
    return reads.indel_mode(_events(spark, d), "D", reference=relation(spark, d, "reference"))


GAIN_SQL = """, gains AS (SELECT c.contig, c.pos, t.i, [sum(CASE WHEN l."row" % 4 = 0 THEN CASE ch WHEN 1 THEN n WHEN 3 THEN -n ELSE 0 END ELSE 0 END), sum(CASE WHEN l."row" % 4 = 1 THEN CASE ch WHEN 1 THEN n WHEN 3 THEN -n ELSE 0 END ELSE 0 END),
      sum(CASE WHEN l."row" % 4 = 2 THEN CASE ch WHEN 1 THEN n WHEN 3 THEN -n ELSE 0 END ELSE 0 END), sum(CASE WHEN l."row" % 4 = 3 THEN CASE ch WHEN 1 THEN n WHEN 3 THEN -n ELSE 0 END ELSE 0 END)] AS gs, coalesce(sum(CASE WHEN ch = 0 THEN n END), 0) AS same
    FROM (SELECT DISTINCT contig, pos FROM long) c CROSS JOIN (SELECT unnest(range(17, 33)) AS i) t LEFT JOIN long l ON l.contig = c.contig AND l.pos = c.pos AND l.idx = t.i GROUP BY ALL),
  tins AS (SELECT contig, pos, string_agg(CASE WHEN list_max(gs) < 0 THEN 'A' ELSE substr('ACGT', CAST(list_position(gs, list_max(gs)) AS INT), 1) END, '' ORDER BY i) AS tb, bool_or(i = 32 AND list_sum(gs) >= 0.125 * same) AS whole FROM gains GROUP BY ALL)"""


@query(DENSE_SQL + GAIN_SQL + " SELECT contig, pos, tb[1:5] AS five, tb[1:15] AS fifteen FROM tins")
def tensor_insertion_bases(spark, d):
    bases = lambda n: calls.inserted_from_tensor(F.col("x"), F.lit(n))
    return _subtracted(spark, d).select("contig", "pos", bases(5).alias("five"), bases(15).alias("fifteen"))


# probabilities: 90 values of 16 bits by part, from md5


def probabilities(spark, d):
    key = F.col("p_partkey").cast("string")
    values = F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), i.cast("string"))), 1, 4), 16, 10).cast("double") / 65536)
    rows = table(spark, d, "part").select(F.lit("chr1").alias("contig"), F.col("p_partkey").alias("pos"), F.substring(F.lit("ACGT"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1)).alias("ref"), values.alias("p"))
    return rows.select("*", F.slice("p", 1, 21).alias("g"), F.slice("p", 22, 3).alias("z"), F.slice("p", 25, 33).alias("u"), F.slice("p", 58, 33).alias("v"))


PROBS_SQL = """probs AS (SELECT *, p[1:21] AS g, p[22:24] AS z, p[25:57] AS u, p[58:90] AS v FROM (
  SELECT 'chr1' AS contig, p_partkey AS pos, substr('ACGT', CAST(p_size % 4 + 1 AS INT), 1) AS ref, list_transform(range(1, 91), lambda i: CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 4) AS INT) / 65536) AS p FROM part))"""


def _class_sql() -> str:
    g = {x: f"g[{i + 1}]" for i, x in enumerate(B.GT21_LABELS)}
    still = "u[17] * v[17]"
    pairs = [a + b for i, a in enumerate("ACGT") for b in "ACGT"[i + 1 :]]
    over = lambda e: f"list_max(list_transform(range(1, 17), lambda i: {e}))"
    both = lambda e: over(f"list_max(list_transform(range(1, 17), lambda j: {e}))")
    base = lambda s, kind: over("greatest(" + ", ".join(f"greatest(u[17] * v[17 {s} i], u[17 {s} i] * v[17]) * {g[b + kind]} * z[3]" for b in "ACGT") + ")")
    out = {
        "reference": f"{still} * z[1] * CASE ref WHEN 'A' THEN {g['AA']} WHEN 'C' THEN {g['CC']} WHEN 'G' THEN {g['GG']} ELSE {g['TT']} END",
        "hom_snp": "greatest(" + ", ".join(f"{still} * z[2] * {g[b + b]}" for b in "ACGT") + ")",
        "het_snp": "greatest(" + ", ".join(f"{still} * z[3] * {g[p]}" for p in pairs) + ")",
        "hom_ins": over(f"u[17 + i] * v[17 + i] * (z[2] * {g['InsIns']})"),
        "het_base_ins": base("+", "Ins"),
        "het_ins_ins": both(f"u[17 + i] * v[17 + j] * (z[3] * {g['InsIns']})"),
        "hom_del": over(f"u[17 - i] * v[17 - i] * (z[2] * {g['DelDel']})"),
        "het_base_del": base("-", "Del"),
        "het_del_del": both(f"CASE WHEN i <> j THEN u[17 - i] * v[17 - j] * (z[3] * {g['DelDel']}) END"),
        "ins_del": both(f"greatest(u[17 + i] * v[17 - j] * (z[3] * {g['InsDel']}), u[17 - j] * v[17 + i] * (z[3] * {g['InsDel']}))"),
    }
    cols = ", ".join(f"{e} AS {c}" for c, e in out.items())
    top = f"greatest({', '.join(calls.CLASSES)})"
    return f"WITH {PROBS_SQL}, s AS (SELECT contig, pos, {cols} FROM probs) SELECT *, CASE {' '.join(f'WHEN {c} = {top} THEN {chr(39)}{c}{chr(39)}' for c in calls.CLASSES)} END AS winner FROM s"


@query(_class_sql())
def hypothesis_scores(spark, d):
    return calls.best_scores(probabilities(spark, d))


def _hypothesis_sql() -> str:
    """All hypotheses of a site with score, alleles and whether these can be shown; the best one that can wins."""
    g = {x: f"g[{i + 1}]" for i, x in enumerate(B.GT21_LABELS)}
    base_case = lambda kind: "CASE b " + " ".join(f"WHEN '{b}' THEN {g[b + kind]}" for b in "ACGT") + " END"
    pairs = [a + b for i, a in enumerate("ACGT") for b in "ACGT"[i + 1 :]]
    same = f"CASE base WHEN 'A' THEN {g['AA']} WHEN 'C' THEN {g['CC']} WHEN 'G' THEN {g['GG']} ELSE {g['TT']} END"
    steps = "(SELECT unnest(range(1, 17)) AS i) si"
    other = "(SELECT unnest(range(1, 17)) AS j) sj"
    ins = lambda n: f"CASE WHEN {n} < 16 THEN tb[1:{n}] ELSE coalesce(long_ins, CASE WHEN whole THEN tb ELSE tb[1:15] END) END"
    gone = lambda n: f"CASE WHEN {n} >= 16 AND long_del IS NOT NULL THEN after[1:long_del] ELSE substr(seq, 18, CAST({n} AS INT)) END"
    top = lambda labels: "[" + ", ".join(g[x] for x in labels) + "]"
    label = lambda labels: f"[{', '.join(repr(x) for x in labels)}][list_position({top(labels)}, list_max({top(labels)}))]"
    return f"""
  site AS (SELECT q.contig, q.pos, q.seq, q.after, substr(q.seq, 17, 1) AS base, t.tb, t.whole, m.depth, m.gain, m.gone, m.snp, m.same, p.g, p.z, p.u, p.v,
      (SELECT bases FROM ins_ x WHERE x.contig = q.contig AND x.pos = q.pos AND length(bases) BETWEEN 16 AND 50 ORDER BY n DESC, seen LIMIT 1) AS long_ins,
      (SELECT size FROM dels_ x WHERE x.contig = q.contig AND x.pos = q.pos AND size BETWEEN 16 AND 50 ORDER BY n DESC, seen LIMIT 1) AS long_del
    FROM seqs q JOIN tins t USING (contig, pos) JOIN sums m USING (contig, pos) JOIN probs p ON p.pos = (q.pos - 25) / 10 WHERE m.depth > 0 AND substr(q.seq, 17, 1) IN ('A', 'C', 'G', 'T')),
  hyp AS (
    SELECT 0 AS cls, 0 AS o, 0 AS i, 0 AS j, '' AS b UNION ALL SELECT 1, 0, 0, 0, '' UNION ALL SELECT 2, 0, 0, 0, ''
    UNION ALL SELECT 3, i, i, 0, '' FROM {steps} UNION ALL SELECT 4, i * 4 + k, i, 0, substr('ACGT', k + 1, 1) FROM {steps}, (SELECT unnest(range(0, 4)) AS k) sk UNION ALL SELECT 5, i * 16 + j, i, j, '' FROM {steps}, {other}
    UNION ALL SELECT 6, i, i, 0, '' FROM {steps} UNION ALL SELECT 7, i * 4 + k, i, 0, substr('ACGT', k + 1, 1) FROM {steps}, (SELECT unnest(range(0, 4)) AS k) sk UNION ALL SELECT 8, i * 16 + j, i, j, '' FROM {steps}, {other} WHERE i <> j
    UNION ALL SELECT 9, (i * 16 + j) * 2, i, j, 'a' FROM {steps}, {other} UNION ALL SELECT 9, (i * 16 + j) * 2 + 1, i, j, 'b' FROM {steps}, {other}),
  scored AS (SELECT s.*, cls, o, b, CASE WHEN cls IN (5, 8) THEN least(i, j) WHEN cls = 9 AND b = 'b' THEN j ELSE i END AS lo, CASE WHEN cls IN (5, 8) THEN greatest(i, j) WHEN cls = 9 AND b = 'b' THEN i WHEN cls = 9 THEN j ELSE i END AS hi,
      CASE cls WHEN 0 THEN u[17] * v[17] * z[1] * {same}
        WHEN 1 THEN list_max(list_transform({top([b + b for b in 'ACGT'])}, lambda y: u[17] * v[17] * z[2] * y)) WHEN 2 THEN list_max(list_transform({top(pairs)}, lambda y: u[17] * v[17] * z[3] * y))
        WHEN 3 THEN u[17 + i] * v[17 + i] * (z[2] * {g['InsIns']}) WHEN 4 THEN greatest(u[17] * v[17 + i], u[17 + i] * v[17]) * {base_case('Ins')} * z[3] WHEN 5 THEN u[17 + i] * v[17 + j] * (z[3] * {g['InsIns']})
        WHEN 6 THEN u[17 - i] * v[17 - i] * (z[2] * {g['DelDel']}) WHEN 7 THEN greatest(u[17] * v[17 - i], u[17 - i] * v[17]) * {base_case('Del')} * z[3] WHEN 8 THEN u[17 - i] * v[17 - j] * (z[3] * {g['DelDel']})
        ELSE CASE b WHEN 'a' THEN u[17 + i] * v[17 - j] ELSE u[17 - i] * v[17 + j] END * (z[3] * {g['InsDel']}) END AS score
    FROM site s, hyp),
  ranked_ AS (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY score DESC, cls, o) AS place FROM scored QUALIFY place <= 300),
  bases_ AS (SELECT *, CASE cls WHEN 1 THEN {label([b + b for b in 'ACGT'])} WHEN 2 THEN {label(pairs)} END AS lab, CASE WHEN cls IN (3, 4, 9) THEN {ins('lo')} WHEN cls = 5 THEN {ins('hi')} END AS ib, CASE WHEN cls IN (6, 7) THEN {gone('lo')} WHEN cls IN (8, 9) THEN {gone('hi')} END AS db FROM ranked_),
  second_ AS (SELECT h.contig, h.pos, h.place, arg_min(x.bases, (-x.n, x.seen)) AS bases FROM bases_ h JOIN ins_ x ON x.contig = h.contig AND x.pos = h.pos AND length(x.bases) BETWEEN h.lo AND CASE WHEN h.lo >= 16 THEN 50 ELSE h.lo END AND x.bases <> h.ib WHERE h.cls = 5 GROUP BY ALL),
  shown AS (SELECT h.*, coalesce(x.bases, h.ib[1:h.lo]) AS ib2 FROM bases_ h LEFT JOIN second_ x ON x.contig = h.contig AND x.pos = h.pos AND x.place = h.place),
  alle AS (SELECT *,
      CASE WHEN cls <= 5 THEN base ELSE base || db END AS ref,
      CASE cls WHEN 0 THEN base
        WHEN 1 THEN substr(lab, 1, 1) WHEN 2 THEN CASE WHEN substr(lab, 1, 1) <> base AND substr(lab, 2, 1) <> base THEN substr(lab, 1, 1) || ',' || substr(lab, 2, 1) WHEN substr(lab, 1, 1) <> base THEN substr(lab, 1, 1) ELSE substr(lab, 2, 1) END
        WHEN 3 THEN base || ib WHEN 4 THEN CASE WHEN b = base THEN base || ib ELSE b || ',' || base || ib END WHEN 5 THEN base || ib2 || ',' || base || ib
        WHEN 6 THEN base WHEN 7 THEN CASE WHEN b = base THEN base ELSE base || ',' || b || db END WHEN 8 THEN base || ',' || base || substr(db, CAST(lo + 1 AS INT)) ELSE base || ',' || base || ib || db END AS alt,
      CASE WHEN cls <= 2 THEN true WHEN cls IN (3, 4) THEN ib <> '' WHEN cls = 5 THEN ib <> '' AND ib2 <> ib WHEN cls IN (6, 7) THEN db <> '' WHEN cls = 8 THEN db <> '' AND substr(db, CAST(lo + 1 AS INT)) NOT IN ('', db) ELSE ib <> '' AND db <> '' END AS ok FROM shown),
  won AS (SELECT * FROM alle WHERE ok QUALIFY row_number() OVER (PARTITION BY contig, pos ORDER BY place) = 1),
  gtd AS (SELECT *, CASE WHEN contains(alt, ',') THEN '1/2' WHEN cls = 0 THEN '0/0' WHEN cls IN (1, 3, 6) THEN '1/1' ELSE '0/1' END AS gt, string_split(alt, ',') AS als FROM won),
  two_ AS (SELECT *, CASE WHEN len(als) = 1 AND gt[1] = '0' THEN ref ELSE als[1] END AS xa, CASE WHEN len(als) = 1 THEN als[1] ELSE als[2] END AS ya FROM gtd),
  lab_ AS (SELECT *, CASE WHEN length(ref) > length(xa) THEN 'Del' WHEN length(ref) < length(xa) THEN 'Ins' ELSE substr(xa, 1, 1) END AS px, CASE WHEN length(ref) > length(ya) THEN 'Del' WHEN length(ref) < length(ya) THEN 'Ins' ELSE substr(ya, 1, 1) END AS py FROM two_),
  decoded AS (SELECT contig, pos, [{', '.join(repr(c) for c in calls.CLASSES)}][cls + 1] AS cls, ref, alt,
      g[list_position([{', '.join(repr(x) for x in B.GT21_LABELS)}], CASE WHEN length(px) = 1 AND length(py) = 1 THEN least(px, py) || greatest(px, py) WHEN length(px) = 1 THEN px || py WHEN length(py) = 1 THEN py || px WHEN px = py THEN px || py ELSE 'InsDel' END)]
        * z[CASE gt WHEN '0/0' THEN 1 WHEN '1/1' THEN 2 ELSE 3 END] AS p, gt, CAST(depth AS BIGINT) AS depth,
      least(CASE WHEN cls = 0 THEN same[instr('ACGT', ref)] WHEN cls IN (1, 2) THEN list_sum(list_transform(als, lambda y: snp[instr('ACGT', y)])) WHEN cls = 4 AND len(als) = 2 THEN gain + snp[instr('ACGT', als[1])] WHEN cls IN (3, 4, 5) THEN gain
        WHEN cls = 7 AND len(als) = 2 THEN gone + snp[instr('ACGT', substr(als[2], 1, 1))] WHEN cls IN (6, 7, 8) THEN gone ELSE gain + gone END / depth, 1.0) AS af FROM lab_)"""


#: Every seventh site has an N at its centre.
SEQS_SQL = """, seqs_ AS (SELECT c.contig, c.pos, string_agg(x.base, '' ORDER BY x.pos0) FILTER (x.pos0 <= c.pos + 15) AS seq, coalesce(string_agg(x.base, '' ORDER BY x.pos0) FILTER (x.pos0 >= c.pos), '') AS after
    FROM centres c JOIN {reference} x ON x.contig = c.contig AND x.pos0 BETWEEN c.pos - 17 AND c.pos + 49 GROUP BY ALL HAVING min(x.pos0) = c.pos - 17),
  seqs AS (SELECT contig, pos, CASE WHEN (pos - 25) / 10 % 7 = 0 THEN substr(seq, 1, 16) || 'N' || substr(seq, 18) ELSE seq END AS seq, after FROM seqs_)"""
INDELS_SQL = """, ins_ AS (SELECT contig, spot AS pos, bases, count(*) AS n, min((pos0, ord)) AS seen FROM (SELECT contig, pos0, ord, r AS spot, string_agg(base, '' ORDER BY k) AS bases FROM ev WHERE kind = 'I' GROUP BY ALL) GROUP BY contig, spot, bases),
  dels_ AS (SELECT contig, spot AS pos, size, count(*) AS n, min((pos0, ord)) AS seen FROM (SELECT contig, pos0, ord, r - k AS spot, count(*) AS size FROM ev WHERE kind = 'D' GROUP BY ALL) GROUP BY contig, spot, size)"""
DECODED_SQL = DENSE_SQL + AF_SQL + GAIN_SQL + SEQS_SQL + INDELS_SQL + f", {PROBS_SQL}," + _hypothesis_sql()


@query(DENSE_SQL + SEQS_SQL + " SELECT contig, pos, seq, after FROM seqs_")
def site_sequences(spark, d):
    return calling.site_sequences(_centres(spark, d), relation(spark, d, "reference"))


def _scored_tensors(spark, d):
    """Tensors of the VCF's sites with sequences and the probabilities of a part; every seventh centre is an N."""
    rows = calling.tensor_rows(_centres(spark, d), _events(spark, d), relation(spark, d, "reference"), counts=_position_counts(spark, d))
    seventh = ((F.col("pos") - 25) / 10).cast("long") % 7 == 0
    rows = rows.withColumn("seq", F.when(seventh, F.concat(F.substring("seq", 1, 16), F.lit("N"), F.substring("seq", 18, 16))).otherwise(F.col("seq")))
    p = probabilities(spark, d).select((F.col("pos") * 10 + 25).alias("pos"), "g", "z", "u", "v")
    # Spark takes an array for one number, so p seems small enough to broadcast
    return rows.join(p.hint("merge"), "pos")


@query(DECODED_SQL + " SELECT contig, pos, cls, ref, alt, round(p, 9) AS p, depth, round(af, 9) AS af FROM decoded")
def decode_calls(spark, d):
    found = calling.call_tensors(_scored_tensors(spark, d), _events(spark, d))
    return found.withColumn("p", F.round("p", 9)).withColumn("af", F.round("af", 9))


@query(DECODED_SQL + """, q AS (SELECT *, greatest(-10.0 * log10((1.0 - p + 1e-300) / (p + 1e-300)) + 16, 0.0) AS s FROM decoded WHERE cls <> 'reference' AND ref <> alt)
  SELECT contig, pos, ref, alt, CAST(round_even(s * s, 0) AS INT) AS qual, CASE WHEN round_even(s * s, 0) >= 100 THEN 'PASS' ELSE 'LowQual' END AS filter, gt, CAST(round_even(s * s, 0) AS INT) AS gq, depth AS dp, round(af, 4) AS af FROM q""")
def call_variants(spark, d):
    return calls.finish_calls(calling.call_tensors(_scored_tensors(spark, d), _events(spark, d)), 100)


@query(f"""WITH {PROBS_SQL}, q AS (SELECT pos, p[1] AS p, greatest(-10.0 * log10((1.0 - p[1] + 1e-300) / (p[1] + 1e-300)) + 16, 0.0) AS s FROM probs)
  SELECT pos, CAST(round_even(s * s, 0) AS BIGINT) AS qual, CASE WHEN round_even(s * s, 0) >= 300 THEN 'PASS' ELSE 'LowQual' END AS filter FROM q""")
def quality_score(spark, d):
    rows = probabilities(spark, d).select("pos", B.quality(F.col("p")[0]).cast("long").alias("qual"))
    return rows.withColumn("filter", B.vcf_filter(F.col("qual"), 300))


FINISH = "CASE CAST(ord % 4 AS INT) WHEN 0 THEN 'het_snp' WHEN 1 THEN 'hom_snp' WHEN 2 THEN 'hom_ins' ELSE 'reference' END"


def _decoded(spark, d):
    cls = F.element_at(F.array(*map(F.lit, ("het_snp", "hom_snp", "hom_ins", "reference"))), (F.col("ord") % 4 + 1).cast("int"))
    return relation(spark, d, "calls").withColumn("cls", cls).withColumn("p", F.col("qual") / F.lit(64.0)).withColumn("depth", F.col("ord") % 9).withColumn("af", (F.col("ord") % 8) / F.lit(16.0))


def _finish_sql(where: str, gt: str) -> str:
    return f"""WITH c AS (SELECT *, {FINISH} AS cls, qual / 64.0 AS p, ord % 9 AS depth, (ord % 8) / 16.0 AS af FROM {{calls}}), q AS (SELECT *, greatest(-10.0 * log10((1.0 - p + 1e-300) / (p + 1e-300)) + 16, 0.0) AS s FROM c WHERE depth > 0 AND {where})
      SELECT contig, pos, ref, alt, CAST(round_even(s * s, 0) AS INT) AS qual, CASE WHEN round_even(s * s, 0) >= 200 THEN 'PASS' ELSE 'LowQual' END AS filter, {gt} AS gt, CAST(round_even(s * s, 0) AS INT) AS gq, depth AS dp, CAST(af AS DOUBLE) AS af FROM q"""


@query(_finish_sql("cls <> 'reference' AND ref <> alt", "CASE WHEN contains(alt, ',') THEN '1/2' WHEN cls IN ('hom_snp', 'hom_ins') THEN '1/1' ELSE '0/1' END"))
def vcf_filter(spark, d):
    return calls.finish_calls(_decoded(spark, d), 200)


@query("WITH a AS (" + _finish_sql("cls <> 'reference' AND ref <> alt AND cls IN ('hom_snp', 'hom_ins')", "'1'").replace("{calls}", "{calls}") + ") SELECT 'precise' AS mode, * FROM a UNION ALL SELECT 'sensitive', * FROM (" + _finish_sql("cls <> 'reference' AND ref <> alt AND NOT contains(alt, ',')", "'1'") + ")")
def haploid_modes(spark, d):
    modes = [calls.finish_calls(_decoded(spark, d), 200, haploid=m).select(F.lit(m).alias("mode"), "*") for m in ("precise", "sensitive")]
    return modes[0].unionByName(modes[1])


@query(f"""WITH {PROBS_SQL}, runs AS (SELECT CAST(floor(pos / 3) AS BIGINT) AS pos, pos % 3 AS ord, ref AS seq, unnest(p) AS p, unnest(range(0, 90)) AS i FROM probs), m AS (SELECT pos, i, round(avg(p), 6) AS p, count(*) AS runs, arg_min(seq, ord) AS seq FROM runs GROUP BY ALL)
  SELECT pos, max(runs) AS runs, min(seq) AS seq, round(sum(p * (i + 1)), 1) AS weighted FROM m GROUP BY pos HAVING max(runs) >= 2""")
def ensemble_average(spark, d):
    runs = probabilities(spark, d).select("contig", F.floor(F.col("pos") / 3).alias("pos"), (F.col("pos") % 3).alias("ord"), F.col("ref").alias("seq"), "p")
    means = calls.average_runs(runs, 2)
    weighted = F.aggregate(F.transform("p", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return means.select("pos", "runs", "seq", F.round(weighted, 1).alias("weighted"))


@query("""WITH f AS (SELECT *, length(ref) - list_min(list_transform(string_split(alt, ','), lambda a: length(a))) AS dl, list_contains(list_transform(string_split(alt, ','), lambda a: length(a)), length(ref)) AS snp,
    row_number() OVER (PARTITION BY contig ORDER BY pos, ord) AS i FROM {calls}),
  fold AS (
    SELECT contig, i, ord, pos, dl, qual, CAST(NULL AS BIGINT) AS gone, ord AS kept FROM f WHERE i = 1
    UNION ALL
    SELECT b.contig, b.i, CASE WHEN clash AND a.qual > b.qual THEN a.ord ELSE b.ord END, CASE WHEN clash AND a.qual > b.qual THEN a.pos ELSE b.pos END, CASE WHEN clash AND a.qual > b.qual THEN a.dl ELSE b.dl END, CASE WHEN clash AND a.qual > b.qual THEN a.qual ELSE b.qual END,
      CASE WHEN NOT clash THEN NULL WHEN a.qual > b.qual THEN b.ord ELSE a.ord END, b.ord
    FROM fold a JOIN (SELECT * FROM f) b ON b.contig = a.contig AND b.i = a.i + 1, LATERAL (SELECT a.dl > 0 AND (b.snp OR b.dl > 0) AND b.pos <= a.pos + a.dl AS clash))
  SELECT contig, pos, ord, ref, alt, qual FROM {calls} c WHERE NOT EXISTS (SELECT 1 FROM fold g WHERE g.contig = c.contig AND g.gone = c.ord)""")
def overlap_removal(spark, d):
    return calls.remove_overlaps(relation(spark, d, "calls")).select("contig", "pos", "ord", "ref", "alt", "qual")


TASKS = "tasks AS (SELECT 'gt' AS task, CAST(pos % 21 AS BIGINT) AS truth, CAST(qual % 21 AS BIGINT) AS pred FROM {calls} UNION ALL SELECT 'zyg', pos % 3, qual % 3 FROM {calls})"


def _tasks(spark, d):
    rows = relation(spark, d, "calls")
    one = lambda name, n: rows.select(F.lit(name).alias("task"), (F.col("pos") % n).alias("truth"), (F.col("qual") % n).alias("pred"))
    return one("gt", 21).unionByName(one("zyg", 3))


@query(f"WITH {TASKS} SELECT task, truth, pred, count(*) AS n FROM tasks GROUP BY ALL UNION ALL SELECT 'length_1', least(pos % 33, ord % 33), least(qual % 33, pos % 5), count(*) FROM {{calls}} GROUP BY ALL UNION ALL SELECT 'length_2', greatest(pos % 33, ord % 33), greatest(qual % 33, pos % 5), count(*) FROM {{calls}} GROUP BY ALL")
def confusion_matrix(spark, d):
    sizes = relation(spark, d, "calls").select((F.col("pos") % 33).alias("t1"), (F.col("ord") % 33).alias("t2"), (F.col("qual") % 33).alias("p1"), (F.col("pos") % 5).alias("p2"))
    return metrics.confusion(_tasks(spark, d).unionByName(metrics.sorted_lengths(sizes)))


@query(f"""WITH {TASKS}, m AS (SELECT task, truth, pred, count(*) AS n FROM tasks GROUP BY ALL), k AS (SELECT DISTINCT task, truth AS cls FROM m UNION SELECT DISTINCT task, pred FROM m),
  s AS (SELECT task, cls, coalesce((SELECT sum(n) FROM m WHERE m.task = k.task AND truth = cls AND pred = cls), 0) AS hit, coalesce((SELECT sum(n) FROM m WHERE m.task = k.task AND pred = cls), 0) AS ip, coalesce((SELECT sum(n) FROM m WHERE m.task = k.task AND truth = cls), 0) AS it FROM k),
  pr AS (SELECT task, cls, hit / (ip + 1e-15) AS "precision", hit / (it + 1e-15) AS recall FROM s)
  SELECT *, 2 * "precision" * recall / ("precision" + recall + 1e-15) AS f1 FROM pr""")
def f1_per_class(spark, d):
    return metrics.f1_by_class(metrics.confusion(_tasks(spark, d)))


@query("""WITH e AS (SELECT label % 64 AS truth, list_transform(embedding[1:64], lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings), r AS (SELECT truth, s, s[truth + 1] AS own FROM e),
  k AS (SELECT 1 + len(list_filter(range(1, 65), lambda i: s[i] > own OR (s[i] = own AND i < truth + 1))) AS place FROM r)
  SELECT count(*) AS n, avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0.0 END) AS top1, avg(CASE WHEN place <= 2 THEN 1.0 ELSE 0.0 END) AS topk FROM k""")
def topk_accuracy(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("label") % 64).alias("truth"), F.slice("embedding", 1, 64).cast("array<double>").alias("scores"))
    return metrics.top_k(rows, 2)


@query(f"WITH {TASKS}, e AS (SELECT truth % 5 AS step, task, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM tasks GROUP BY ALL) SELECT step, avg(accuracy) AS accuracy FROM e GROUP BY step")
def task_accuracy(spark, d):
    return metrics.mean_task_accuracy(_tasks(spark, d).withColumn("step", F.col("truth") % 5))


# training histories: the events of a user are a run


def _history(spark, d):
    rows = table(spark, d, "events")
    return rows.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("event_id").alias("epoch"), (F.lit(1e-5) * (F.col("event_id") + 1)).alias("lr"), F.col("value").alias("accuracy"), F.col("value").alias("loss"))


@query("""WITH h AS (SELECT user_id AS run, event_id AS step, 1e-5 * (event_id + 1) AS lr, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS diff FROM events),
  up AS (SELECT run, lr FROM h WHERE diff IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run ORDER BY diff DESC, step) = 1), down AS (SELECT run, lr FROM h WHERE diff IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run ORDER BY diff, step) = 1)
  SELECT r.run, least(up.lr, down.lr) AS low_lr, greatest(up.lr, down.lr) AS high_lr FROM (SELECT DISTINCT run FROM h) r LEFT JOIN up USING (run) LEFT JOIN down USING (run)""")
def lr_diff(spark, d):
    return metrics.learning_rate_bounds(metrics.accuracy_steps(_history(spark, d)))


FLAGS_SQL = """runs AS (SELECT user_id AS run, event_id AS epoch, value AS loss, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM events),
  flags AS (SELECT run, epoch, loss, len(h) <= 5 OR list_min(h[-5:]) = list_min(h) AS approaches,
      len(h) > 6 AND ((h[-6] > h[-5] AND h[-5] < h[-4] AND h[-4] > h[-3] AND h[-3] < h[-2] AND h[-2] > h[-1]) OR (h[-6] < h[-5] AND h[-5] > h[-4] AND h[-4] < h[-3] AND h[-3] > h[-2] AND h[-2] < h[-1])) AS oscillates,
      len(h) > 6 AND list_min(h[-5:]) > list_min(h) AS rises FROM runs)"""


@query(f"WITH {FLAGS_SQL} SELECT * FROM flags")
def loss_history_flags(spark, d):
    return metrics.loss_flags(_history(spark, d).select("run", "epoch", "loss"))


@query(f"""WITH RECURSIVE {FLAGS_SQL}, nth AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM flags),
  fold AS (
    SELECT run, i, epoch, 1 AS since, 3 AS left_, CAST(1e-3 AS DOUBLE) AS rate, false AS switched FROM nth WHERE i = 1
    UNION ALL
    SELECT n.run, n.i, n.epoch, CASE WHEN f.switched THEN 1 ELSE f.since + 1 END, f.left_ - CASE WHEN called THEN 1 ELSE 0 END, CASE WHEN f.switched THEN f.rate * 0.1 ELSE f.rate END, called
    FROM fold f JOIN nth n ON n.run = f.run AND n.i = f.i + 1,
      LATERAL (SELECT (CASE WHEN f.switched THEN 1 ELSE f.since + 1 END >= 6 AND NOT approaches AND oscillates) OR (CASE WHEN f.switched THEN 1 ELSE f.since + 1 END >= 8 AND rises) AS called)
    WHERE f.left_ > 0)
  SELECT run, epoch, rate, switched, left_ = 0 AS stopped FROM fold""")
def adaptive_lr(spark, d):
    return metrics.adaptive_rates(metrics.loss_flags(_history(spark, d).select("run", "epoch", "loss")))


@query("SELECT user_id AS run, arg_min(event_id, (value, event_id)) AS epoch, min(value) AS loss FROM events GROUP BY user_id")
def best_epoch(spark, d):
    return metrics.best_epoch(_history(spark, d).select("run", "epoch", "loss"))


@query("""SELECT user_id AS run, CAST(floor(event_id / 1000.0) AS BIGINT) AS epoch, CASE WHEN event_id % 10 < 9 THEN 'train' ELSE 'validation' END AS phase, round(sum(value) / sum(event_id % 7 + 1), 6) AS loss, CAST(sum(event_id % 7 + 1) AS BIGINT) AS examples FROM events GROUP BY ALL""")
def epoch_loss(spark, d):
    rows = table(spark, d, "events")
    return metrics.epoch_losses(rows.select(F.col("user_id").alias("run"), F.floor(F.col("event_id") / 1000).alias("epoch"), F.when(F.col("event_id") % 10 < 9, "train").otherwise("validation").alias("phase"), F.col("value").alias("loss"), (F.col("event_id") % 7 + 1).alias("examples"))).withColumn("loss", F.round("loss", 6))


@query(f"WITH {PROBS_SQL} SELECT pos % 50 AS batch, round(sum(p[1]) * 1.0 + sum(p[2]) * 0.5 + sum(p[3]) * 2.0 + sum(p[4]) * 1.0 + 3.0 * 7.0 * 0.005, 6) AS total FROM probs GROUP BY ALL")
def total_loss(spark, d):
    rows = probabilities(spark, d).select((F.col("pos") % 50).alias("batch"), *(F.col("p")[i].alias(k) for i, k in enumerate("gzuv")))
    return metrics.total_loss(rows, (1.0, 0.5, 2.0, 1.0, 3.0), 7.0, 0.005).withColumn("total", F.round("total", 6))


@query(f"""WITH {PROBS_SQL}, t AS (SELECT pos, list_transform(z, lambda x: exp(x * 8) / (exp(z[1] * 8) + exp(z[2] * 8) + exp(z[3] * 8))) AS q, [CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN pos % 3 = 1 THEN 1 ELSE 0 END, CASE WHEN pos % 3 = 2 THEN 1 ELSE 0 END] AS y FROM probs)
  SELECT pos, round(list_sum([CASE WHEN y[i] > 0 THEN -pow(y[i] - q[i], 2) * ln(greatest(least(q[i], 1.0), 1e-8)) ELSE -pow(q[i], 2) * ln(greatest(least(1.0 - q[i], 1.0), 1e-8)) END for i in [1, 2, 3]]), 9) AS loss FROM t""")
def focal_loss(spark, d):
    y = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.col("pos") % 3 == i).cast("int"))
    logits = F.transform("z", lambda x: x * 8)
    return probabilities(spark, d).select("pos", F.round(B.focal_loss(logits, y), 9).alias("loss"))


@query(f"WITH {PROBS_SQL} SELECT pos, round(-ln(z[pos % 3 + 1] + 1e-10) * [0.5, 2.0, 1.25][pos % 3 + 1], 9) AS loss FROM probs")
def cross_entropy(spark, d):
    y = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.col("pos") % 3 == i).cast("int"))
    return probabilities(spark, d).select("pos", F.round(B.cross_entropy(F.col("z"), y, F.array(F.lit(0.5), F.lit(2.0), F.lit(1.25))), 9).alias("loss"))


@query("""WITH RECURSIVE n AS (SELECT event_id AS step, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events),
  fold AS (SELECT CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS g, CAST(0 AS BIGINT) AS c
    UNION ALL SELECT i + 1, CASE WHEN g + 1 > 40 THEN 0 ELSE g + 1 END, CASE WHEN g + 1 > 40 THEN c + 1 ELSE c END FROM fold WHERE i + 1 < 41 * 60),
  s AS (SELECT step, CASE WHEN g <= 20 THEN g / 20.0 ELSE 2 - g / 20.0 END AS x, c + CAST(floor(i_all / 2460) AS BIGINT) * 60 AS c FROM (SELECT step, i AS i_all FROM n) e JOIN fold ON fold.i = i_all % 2460)
  SELECT step, round(0.001 + 0.009 * x + 1e-12, 9) AS tri, round(0.001 + (0.01 * pow(0.5, c) - 0.001) * x + 1e-12, 9) AS tri2, round(0.001 + (0.01 * pow(0.95, c) - 0.001) * x + 1e-12, 9) AS exp FROM s""")
def cyclical_lr(spark, d):
    # event ids count up from 0 without gaps, as updates do
    rows = table(spark, d, "events").select(F.col("event_id").alias("step"))
    # the rates end in a 5 at some digit, so a small amount decides how they round
    return rows.select("step", *(F.round(B.triangular_lr(F.col("step"), 20, 0.001, 0.01, m) + 1e-12, 9).alias(m) for m in ("tri", "tri2", "exp")))


EVALUATE_SQL = """, e AS (SELECT pos % 21 AS t1, pos % 3 AS t2, pos % 33 AS a, pos * 7 % 33 AS b, list_position(g, list_max(g)) - 1 AS p1, list_position(z, list_max(z)) - 1 AS p2, list_position(u, list_max(u)) - 1 AS pu, list_position(v, list_max(v)) - 1 AS pv, g FROM probs),
  m AS (SELECT task, truth, pred, count(*) AS n FROM (SELECT 'gt21' AS task, t1 AS truth, p1 AS pred FROM e UNION ALL SELECT 'zyg', t2, p2 FROM e UNION ALL SELECT 'length_1', least(a, b), least(pu, pv) FROM e UNION ALL SELECT 'length_2', greatest(a, b), greatest(pu, pv) FROM e) GROUP BY ALL),
  k AS (SELECT DISTINCT task, truth AS cls FROM m UNION SELECT DISTINCT task, pred FROM m),
  f AS (SELECT task, cls, coalesce((SELECT sum(n) FROM m WHERE m.task = k.task AND truth = cls AND pred = cls), 0) AS hit, coalesce((SELECT sum(n) FROM m WHERE m.task = k.task AND pred = cls), 0) AS ip, coalesce((SELECT sum(n) FROM m WHERE m.task = k.task AND truth = cls), 0) AS it FROM k),
  pr AS (SELECT *, hit / (ip + 1e-15) AS pp, hit / (it + 1e-15) AS rr FROM f),
  place AS (SELECT len(list_filter(range(1, 22), lambda i: g[i] > g[t1 + 1] OR (g[i] = g[t1 + 1] AND i > t1 + 1))) AS place FROM e),
  out AS (SELECT task, 'n' AS metric, truth, pred, CAST(n AS DOUBLE) AS value FROM m UNION ALL SELECT task, 'precision', cls, NULL, pp FROM pr UNION ALL SELECT task, 'recall', cls, NULL, rr FROM pr UNION ALL SELECT task, 'f1', cls, NULL, 2 * pp * rr / (pp + rr + 1e-15) FROM pr
    UNION ALL SELECT 'gt21', 'all', NULL, NULL, count(*) FROM place UNION ALL SELECT 'gt21', 'top1', NULL, NULL, count(*) FILTER (place = 0) FROM place UNION ALL SELECT 'gt21', 'top2', NULL, NULL, count(*) FILTER (place <= 1) FROM place)"""


@query(f"WITH {PROBS_SQL}{EVALUATE_SQL} SELECT task, metric, CAST(truth AS BIGINT) AS truth, CAST(pred AS BIGINT) AS pred, round(value, 9) AS value FROM out")
def evaluate(spark, d):
    rows = probabilities(spark, d).select((F.col("pos") % 21).alias("gt21"), (F.col("pos") % 3).alias("zyg"), (F.col("pos") % 33).alias("len1"), (F.col("pos") * 7 % 33).alias("len2"), "g", "z", "u", "v")
    return _longs(metrics.evaluate(rows), "truth", "pred").withColumn("value", F.round("value", 9))


@query(DENSE_SQL + f", {TRUTH_SQL}, {LABEL_SQL}" + SEQS_SQL + """, sums AS (SELECT contig, pos, CAST(sum(n) - 4 * coalesce(sum(n) FILTER (ch = 0), 0) + coalesce(sum(n) FILTER (ch = 0), 0) AS BIGINT) AS total FROM long GROUP BY ALL),
  first_ AS (SELECT contig, pos, min(gt21) AS gt21, min(zyg) AS zyg, min(len1) AS len1, min(len2) AS len2 FROM labels_ GROUP BY ALL HAVING count(*) = 1)
  SELECT s.contig, s.pos, total, coalesce(gt21, CASE substr(q.seq, 17, 1) WHEN 'A' THEN 0 WHEN 'C' THEN 4 WHEN 'G' THEN 7 ELSE 9 END) AS y1, coalesce(zyg, 0) + 21 AS y2, coalesce(len1, 16) + 24 AS y3, coalesce(len2, 16) + 57 AS y4
  FROM sums s JOIN seqs_ q USING (contig, pos) LEFT JOIN first_ USING (contig, pos) WHERE length(q.seq) > 16 AND (s.contig, s.pos) NOT IN (SELECT contig, pos FROM labels_ GROUP BY ALL HAVING count(*) > 1)""")
def training_rows(spark, d):
    rows = calling.tensor_rows(_centres(spark, d), _events(spark, d), relation(spark, d, "reference"), counts=_position_counts(spark, d)).withColumn("ord", F.lit(0))
    labels = truth.variant_labels(truth_of(spark, d))
    once = labels.groupBy("contig", "pos").agg(F.count("*").alias("n"))
    rows = rows.join(once.where("n > 1"), ["contig", "pos"], "left_anti")  # a site of several truth rows has no one label
    made = truth.training_rows(rows, labels)
    ones = F.filter(F.transform("y", lambda v, i: F.when(v == 1, i)), lambda x: x.isNotNull())
    total = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v)
    return made.select("contig", "pos", total.alias("total"), *(ones[k].cast("long").alias(f"y{k + 1}") for k in range(4)))


@query(DENSE_SQL + """ SELECT ['reference', 'insert', 'delete', 'snp'][ch + 1] AS channel, ['A+', 'C+', 'G+', 'T+', 'A-', 'C-', 'G-', 'T-']["row" + 1] AS "row", idx, CAST(sum(n) AS BIGINT) AS value FROM long GROUP BY ALL""")
def plot_rows(spark, d):
    """The heat maps of all tensors together."""
    rows = files.plot_rows(_dense(spark, d), "contig", "pos")
    return _longs(rows.where("value <> 0").groupBy("channel", "row", "idx").agg(F.sum("value").alias("value")), "idx")


@query(None)
def network_scores(spark, d):
    x = _subtracted(spark, d).withColumn("x", F.col("x").cast("array<float>"))
    weights = network.random_weights(hidden=8, slices=4, dense=16, head=8)
    return network.score(x.select("contig", "pos", "x"), weights).select("contig", "pos", *(B.argmax(F.col(k)).alias(k) for k in network.HEADS))


#: Batches that the streaming queries cut the reads into, in genome order.
PIECES = 5


def _stream_contigs(spark, d) -> list[tuple[str, int]]:
    """The contigs with a bound of the positions that their reads and reference reach."""
    return [(c, (spark.read.parquet(f"{d}/part.parquet").agg(F.max("p_partkey")).first()[0] + 10) * 10) for c in ("chr1", "chr2", "chr3")]


def _kept(rows: DataFrame) -> DataFrame:
    """The rows as a table, since each batch reads them again."""
    path = fresh_path(rows.sparkSession, "rows")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _sorted_reads(spark, d):
    """The reads in genome order, as a stream brings them."""
    return relation(spark, d, "reads").orderBy("contig", "pos0")


def _streamed(spark, d, build, contigs) -> tuple[DataFrame, str]:
    """The result of a stream of the reads, in batches that cross contigs, and its progress folder."""
    folder, out, progress = (fresh_path(spark, name) for name in ("reads", "stream", "progress"))
    rows = _kept(_sorted_reads(spark, d))
    stream = lambda s: build(s.readStream.schema(rows.schema).parquet(folder))
    pieces = pileup.pieces_of(rows, contigs, F.col("pos0"), PIECES)
    return pileup.run_pieces([[(p, folder)] for p in pieces], stream, out, progress), progress


@query(f"WITH {kept_sql()}, {EVENTS_SQL}, {PILE_SQL} SELECT * FROM counts")
def streaming_pileup_counts(spark, d):
    """The stateful pileup over the reads in several batches, and what was open at the end; equal to pileup_counts."""
    contigs = _stream_contigs(spark, d)
    done, progress = _streamed(spark, d, lambda reads: pileup.streaming_pileup(reads, contigs, 5), contigs)
    return done.unionByName(pileup.open_pileup(spark, progress)).where("NOT late").drop("late")


@query(f"WITH {kept_sql(soft=False)}, {EVENTS_SQL}, {CENTRES}, " + HITS_SQL.replace("{edge}", ""))
def streaming_tensor_cells(spark, d):
    """Tensors from a stream of the reads in several batches; equal to window_tensor."""
    contigs = _stream_contigs(spark, d)
    sites, known = _kept(_centres(spark, d)), _kept(relation(spark, d, "reference"))
    done, progress = _streamed(spark, d, lambda reads: pileup.streaming_window_cells(reads, sites, known, contigs, 64, 5), contigs)
    return _longs(done.unionByName(pileup.open_window_cells(spark, progress)), "idx", "row", "ch")


@query(f"WITH {kept_sql(soft=False)}, {EVENTS_SQL}, {CENTRES}, " + HITS_SQL.replace("{edge}", ""))
def lookahead_tensor_cells(spark, d):
    """Tensors from a stream of reads and a stream of sites, which arrive together piece by piece; equal to window_tensor."""
    contigs = _stream_contigs(spark, d)
    rows, centres, known = _kept(_sorted_reads(spark, d)), _kept(_centres(spark, d)), _kept(relation(spark, d, "reference"))
    folders = [fresh_path(spark, name) for name in ("reads", "sites")]
    parts = zip(pileup.pieces_of(centres, contigs, F.col("pos"), PIECES), pileup.pieces_of(rows, contigs, F.col("pos0"), PIECES), strict=True)
    pieces = [[(site_part, folders[1]), (read_part, folders[0])] for site_part, read_part in parts]
    whole = sum(n + pileup.GAP for _, n in contigs) // PIECES + 1  # the part of a piece

    def build(s):
        return pileup.lookahead_cells(s.readStream.schema(rows.schema).parquet(folders[0]), s.readStream.schema(centres.schema).parquet(folders[1]), known, contigs, 64, 5, whole)

    # a stream reads folders that exist
    for folder, like in zip(folders, (rows, centres), strict=True):
        like.limit(0).write.mode("append").parquet(folder)
    cells = pileup.run_pieces(pieces, build, *(fresh_path(spark, name) for name in ("stream", "progress")))
    return _longs(cells.groupBy(*tensors.CELL).agg(F.sum("n").alias("n")), "idx", "row", "ch")
