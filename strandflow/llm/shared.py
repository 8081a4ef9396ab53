"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Addresses of the tables that materialize() wrote and nothing has removed yet, oldest first.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a temporary folder takes its place if all runs
    in one process, as in local tests; on a cluster that is an error, since
    each machine would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_strandflow_dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandflow-")
        spark._strandflow_dir = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new address in the shared folder, which release() removes later."""
    path = f"{shared_dir(spark)}/strandflow/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


#: Rows that packed() leaves to a task at least.
ROWS_A_TASK = 50_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than up to ``rows`` rows and the cores ask for: a small table is no large number of tasks and files.

    Rows stay as they are, and so do the partitions of a large table.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


def mark() -> int:
    """What release() takes to remove only tables written from here on."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Removes the tables written since mark(), but those of materialize() in ``keep``.

    Results are lazy: write a result down before the tables that it reads go.
    """
    kept = [df.written_at for df in keep]
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for path in _written[since:]:
        if path not in kept:
            where = path_of(path)
            where.getFileSystem(conf).delete(where, True)
    _written[since:] = kept


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores behind it until no column is called so (whatever the case)."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def base_columns(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns only; extra columns of any name do not get in the way."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def stream_groups(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """One table for each run of equal keys in sorted batches."""
    kept: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in keys:
            col = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= col[1:] != col[:-1]
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        cuts = np.flatnonzero(change)
        edges = [0, *cuts.tolist(), n]
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if kept and (i or first != last):
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(lo, hi - lo))
        last = tuple(batch.column(k)[n - 1].as_py() for k in keys)
    if kept:
        yield pa.Table.from_batches(kept)


#: Keys of 8 bytes that may be broadcast (16 MB); the rows found are the same either way.
MOST_KEYS = 2_000_000


def without(df: DataFrame, keys: DataFrame, key: str, negate: bool = False) -> DataFrame:
    """Rows whose long ``key`` is not (or is) among ``keys``, a written table of distinct keys.

    Up to MOST_KEYS keys are broadcast, so df's rows stay where they are; more
    are joined by a shuffle.
    """
    few = keys.count() <= MOST_KEYS
    return df.join(F.broadcast(keys) if few else keys, key, "left_semi" if negate else "left_anti")


def bounded_sample(rows: DataFrame, group: str, per_group: int, max_bytes: int) -> DataFrame:
    """Up to ``per_group`` distinct texts of each group, ``max_bytes`` of them at most: those of least hash of doc_id and text.

    rows: doc_id, text and the group's column. The hash decides alone, so the
    sample is the same in every run. A threshold that every group's share
    passes leaves a bounded number of rows before any are sorted; equal rows
    are one.
    """
    h = F.xxhash64("doc_id", "text")
    full = rows.select(F.col(f"`{group}`").alias("g"), "doc_id", "text").where("text IS NOT NULL AND g IS NOT NULL")
    # for each group the hash below which about twice per_group rows lie, from all rows
    sizes = full.groupBy("g").agg(F.approx_count_distinct(h).alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_group + 100) / F.col("n"))
    limit = F.when(share < 1, F.floor((share * 2 - 1) * float(1 << 62) * 2)).otherwise((1 << 63) - 1).cast("long")
    near = full.withColumn("h", h).join(F.broadcast(sizes.select("g", limit.alias("most"))), "g").where("h <= most")
    once = near.groupBy("g", "h").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    w = Window.partitionBy("g").orderBy("h")
    ranked = once.withColumn("nth", F.row_number().over(w)).withColumn("upto", F.sum(F.octet_length("row.text")).over(w))
    return ranked.where((F.col("nth") <= per_group) & ((F.col("upto") <= max_bytes) | (F.col("nth") == 1))).select("g", "h", "row.doc_id", "row.text")
