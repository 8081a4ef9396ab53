"""Small-variant relations derived from star-schema tables, in SQL that Spark and DuckDB both run.

Three contigs share a repeating pattern of bases, read at another offset each;
reads are stretches of it with a few substitutions and CIGARs of every kind.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

PERIOD, READ = 997, 32
_rng = random.Random(20240501)
PATTERN = "".join(_rng.choice("ACGT") for _ in range(PERIOD))
DOUBLE = PATTERN + PATTERN[:64]

#: Base of a contig number and 0-based position, as SQL.
BASE = "substr('{d}', CAST(({p} + 331 * {c}) % {n} AS INT) + 1, {k})"


def base_sql(contig: str, pos: str, size: int = 1) -> str:
    return BASE.format(d=DOUBLE, p=pos, c=contig, n=PERIOD, k=size)


READS = f"""
  SELECT contig, pos0, mapq, flag, cigar,
         CASE WHEN h4 % 6 = 0 THEN concat(substr(whole, 1, sub_at), substr('ACGTNRACGT', h4 % 10 + 1, 1), substr(whole, sub_at + 2, {READ})) ELSE whole END AS seq,
         row_number() OVER (PARTITION BY contig, pos0 ORDER BY l_orderkey, l_linenumber, l_quantity, l_suppkey, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord
  FROM (
    SELECT *, {base_sql('cn', 'pos0', READ)} AS whole, CAST((l_orderkey * 7 + l_partkey * 3 + l_linenumber) % {READ} AS INT) AS sub_at,
           CAST((l_orderkey * 5 + l_suppkey) % 60 AS INT) AS h4
    FROM (
      SELECT *, concat('chr', CAST(l_suppkey % 3 + 1 AS VARCHAR(3))) AS contig, CAST(l_suppkey % 3 AS INT) AS cn,
             l_partkey * 10 + l_linenumber AS pos0, CAST(l_quantity AS INT) AS mapq,
             CASE WHEN l_linenumber % 2 = 0 THEN 16 ELSE 0 END + CASE CAST(l_quantity AS INT) WHEN 11 THEN 4 WHEN 12 THEN 256 WHEN 13 THEN 2048 WHEN 14 THEN 8 WHEN 15 THEN 64 ELSE 0 END AS flag,
             CASE CAST(l_orderkey % 20 AS INT) WHEN 0 THEN '5S27M' WHEN 1 THEN '10M2I20M' WHEN 2 THEN '12M3D20M' WHEN 3 THEN '8=4X20=' WHEN 4 THEN '3I29M'
               WHEN 5 THEN '20S12M' WHEN 6 THEN '*' WHEN 7 THEN '10M5N22M' WHEN 8 THEN '4H32M' WHEN 9 THEN '16M1P16M' WHEN 10 THEN '2D32M' WHEN 11 THEN '30M2I' ELSE '32M' END AS cigar
      FROM lineitem
    ) a
  ) b
"""

REFERENCE = f"""
  SELECT concat('chr', CAST(c + 1 AS VARCHAR(3))) AS contig, pos0, {base_sql('c', 'pos0')} AS base
  FROM (SELECT p_partkey * 10 + k AS pos0, c FROM part CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) v(k)) ks CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) w(c)) cs) x
"""

BED = """
  SELECT concat('chr', CAST(s_suppkey % 3 + 1 AS VARCHAR(3))) AS contig, s_suppkey * 137 % 18000 AS start, s_suppkey * 137 % 18000 + s_suppkey * 53 % 90 AS end_
  FROM supplier
"""

VCF = f"""
  SELECT contig, pos, ref,
         CASE CAST(kind AS INT) WHEN 0 THEN CASE ref WHEN 'A' THEN 'G' ELSE 'A' END WHEN 1 THEN concat(ref, 'TT') WHEN 2 THEN substr(ref, 1, 1) WHEN 3 THEN concat(substr(ref, 1, 1), ',', ref, 'AC')
           WHEN 4 THEN 'C,T' WHEN 5 THEN '*,G' WHEN 6 THEN 'TT,*' ELSE concat(ref, 'G') END AS alt,
         CASE CAST(p_size % 5 AS INT) WHEN 0 THEN '0/1' WHEN 1 THEN '1|0' WHEN 2 THEN '1/1' WHEN 3 THEN './1' ELSE '2/1' END AS gt,
         p_partkey AS ord, p_partkey, kind
  FROM (
    SELECT *, CASE WHEN kind IN (2, 3) THEN {base_sql('cn', 'pos - 1', 3)} ELSE {base_sql('cn', 'pos - 1')} END AS ref
    FROM (SELECT *, concat('chr', CAST(cn + 1 AS VARCHAR(3))) AS contig, (p_partkey - p_partkey % 2) * 10 + 25 AS pos, p_size % 8 AS kind FROM (SELECT *, CAST(floor(p_partkey / 700) AS BIGINT) % 3 AS cn FROM part) z) a
  ) b
"""

CALLS = """
  SELECT concat('chr', CAST(o_custkey % 3 + 1 AS VARCHAR(3))) AS contig, o_orderkey * 3 + o_custkey % 4 AS pos, o_orderkey AS ord,
         CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'ACGTAC' WHEN 1 THEN 'ACG' ELSE 'A' END AS ref,
         CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'A' WHEN 1 THEN 'A,AC' WHEN 2 THEN 'ATT' WHEN 3 THEN 'G' ELSE 'T' END AS alt,
         CAST(floor(o_totalprice) AS BIGINT) % 40 AS qual
  FROM orders
"""

#: Relations by name; {name} in a query becomes the relation's SQL.
RELATIONS = {"reads": READS, "reference": REFERENCE, "bed": BED, "vcf": VCF, "calls": CALLS}
TABLES = ["lineitem", "part", "supplier", "orders", "embeddings", "labels", "documents", "events", "customer"]


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation over a folder's tables."""
    text = RELATIONS[name].replace("VARCHAR(3)", "STRING")
    for t in TABLES:
        text = text.replace(f"FROM {t}\n", f"FROM parquet.`{sf_dir}/{t}.parquet`\n").replace(f"FROM {t} ", f"FROM parquet.`{sf_dir}/{t}.parquet` ").replace(f"FROM {t})", f"FROM parquet.`{sf_dir}/{t}.parquet`)")
    df = spark.sql(text)
    return df.withColumnRenamed("end_", "end") if name == "bed" else df


def oracle(text: str) -> str:
    """A query's SQL with relations as common table expressions."""
    used = [n for n in RELATIONS if f"{{{n}}}" in text]
    for n in used:
        text = text.replace(f"{{{n}}}", f"{n}_")
    text = text.strip()
    own = text[:5].upper() == "WITH "
    if not used:
        return text
    parts = ", ".join(f"{n}_ AS ({RELATIONS[n]})" for n in used)
    return f"WITH RECURSIVE {parts}{',' if own else ''} {text[5:] if own else text}"
