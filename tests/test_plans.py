"""What a plan may not hold, on the smallest data set: rows made by an explode are many times what Spark takes them for, so that a join right on them may be broadcast at any size."""

from pathlib import Path

import pytest

from colloquy.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def nodes(plan):
    yield plan
    below = plan.children()
    for i in range(below.size()):
        yield from nodes(below.apply(i))


def exploded(plan):
    """Whether rows of an explode come out of a plan without being summed up on the way."""
    name = plan.nodeName()
    below = plan.children()
    return name == "Generate" or (name != "Aggregate" and any(exploded(below.apply(i)) for i in range(below.size())))


@pytest.mark.parametrize("name", ["infer_stitched", "tokens_in_windows"])
def test_no_exploded_rows_are_joined(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan()
    joins = [x for x in nodes(plan) if x.nodeName() == "Join"]
    assert joins and not any(exploded(x.children().apply(i)) for x in joins for i in range(2))
