"""Changed symbols carry no paths through their joins."""

import contextlib
import io

from tracegraph.operators import review
from tracegraph.sources.starview import StarGraph


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_changed_symbols_are_told_apart_by_number(spark):
    g = StarGraph(spark, "/root/testdata/sf0.001")
    plan = plan_of(review.changed_symbols(g, g.patches))
    assert "keys=[pr_id" in plan
    for line in plan.splitlines():
        if "HashAggregate(keys=[pr_id" in line:
            assert "path" not in line and "name" not in line
