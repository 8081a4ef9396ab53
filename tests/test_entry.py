import math

import __spark_entry__
import duckdb
import pytest
from strandflow.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = ["lineitem", "part", "supplier", "orders", "events", "embeddings"]


def plain(v):
    """A value as text, floats to nine digits."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order] for _ in range(1)) + sorted([plain(r[i]) for i in order] for r in rows)


#: Queries whose rare cases show only in larger tables.
LARGER = ["truth_variants", "truth_merge", "variant_labels", "reference_labels", "label_join", "pair_non_variants", "overlap_removal", "train_validation_split"]


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name,folder", [(n, SF) for n in sorted(queries.ORACLES)] + [(n, "/root/testdata/sf0.01") for n in LARGER])
def test_query_equals_its_sql(spark, name, folder):
    got = queries.QUERIES[name](spark, folder)
    want = duck(folder).sql(__spark_entry__.oracle_sql()[name])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"network_scores"}
