"""Plans of the queries that place windows: what an explode makes many of is never broadcast."""

import pytest
from strandflow.plans import queries

SF = "/root/testdata/sf0.001"


def broadcasts_of(plan, what):
    """Lines with ``what`` below a broadcast exchange of a plan's text."""
    found, depth = [], None
    for line in plan.split("\n"):
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        if depth is None and "BroadcastExchange" in line:
            depth = at
        elif depth is not None and what in line:
            found.append(line)
    return found


WINDOWS = ["allele_frequency", "call_variants", "decode_calls", "network_scores", "plot_rows", "read_depth", "site_sequences", "tensor_channels", "tensor_crop", "tensor_insertion_bases", "training_rows", "window_tensor", "window_depth"]


@pytest.mark.parametrize("name", WINDOWS)
def test_exploded_rows_are_not_broadcast(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and not broadcasts_of(plan, "Generate explode")


@pytest.mark.parametrize("name", ["call_variants", "decode_calls"])
def test_probabilities_are_not_broadcast(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "md5(" in plan and not broadcasts_of(plan, "md5(")


def test_left_edge_joins_the_reference_last(spark):
    """All events meet the edges and the reads that take part, only hits the reference; before, every event did."""
    plan = queries.QUERIES["tensor_left_edge_off"](spark, SF)._jdf.queryExecution().analyzed().toString()
    joins = [line for line in plan.split("\n") if "Join Inner" in line]
    assert len(joins) == 3 and "r#" in joins[0] and "ord#" in joins[1] and "edge#" in joins[2]
