"""Scans by ranges against plain loops, on inputs of one group and of many."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from strandflow.operators import ordered


@pytest.fixture(scope="module", params=["one group", "many groups"])
def rows(spark, request):
    rng = random.Random(2)
    n, pos, out = 3000, Counter(), []
    for i in range(n):
        g = "a" if request.param == "one group" else rng.choice(["a", "a", "a", "b", "c"])
        pos[g] += rng.choice([0, 0, 1, 3, 40])
        out.append((g, i, pos[g], rng.choice([None, None, None, 2, 15, 500 if i % 100 == 0 else 1])))
    return out, spark.createDataFrame(out, "g string, ord long, pos long, size long").repartition(5, "ord").cache()


def groups(rows):
    for g in sorted({r[0] for r in rows}):
        yield g, sorted((r for r in rows if r[0] == g), key=lambda r: r[1])


@pytest.mark.parametrize("n", [1, 2, 7, 50])
def test_scans(rows, n):
    plain, df = rows
    ranks, run_of, island_of = {}, {}, {}
    for _, own in groups(plain):
        run = island = 0
        last = reach = None
        for nth, (_, i, pos, size) in enumerate(own, 1):
            run += last is None or pos != last
            island += reach is None or pos > reach
            ranks[i], run_of[i], island_of[i], last = nth, run, island, pos
            if size is not None:
                reach = max(reach or 0, pos + size)
    got = ordered.rank(df, ["g"], ["ord"], n=n)
    assert got.columns == [*df.columns, "nth"] and {r.ord: r.nth for r in got.collect()} == ranks
    assert {r.ord: r.run for r in ordered.runs(df, ["g"], ["ord"], "pos", n=n).collect()} == run_of
    assert {r.ord: r.island for r in ordered.islands(df, ["g"], ["pos", "ord"], "pos", F.col("pos") + F.col("size"), n=n).collect()} == island_of


def test_a_group_is_spread_over_ranges(rows):
    _, df = rows
    sizes = [r["count"] for r in ordered.with_ranges(df, ["g", "ord"], 10).groupBy(ordered.PART).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 3 * sum(sizes) / 10


def test_nothing(spark):
    none = spark.createDataFrame([], "g string, ord long, pos long, size long")
    assert ordered.rank(none, ["g"], ["ord"]).count() == ordered.runs(none, ["g"], ["ord"], "pos").count() == ordered.islands(none, ["g"], ["pos"], "pos", F.col("size")).count() == 0
