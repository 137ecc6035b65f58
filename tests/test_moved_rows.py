"""What lookup queries move between tasks: relationship arrays stay where they are met."""

from __future__ import annotations

import pytest

from prefixlake.plans import all_queries


def top_join(df):
    """The types of the columns that each side brings to the last join."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    sides = [node.children().apply(i) for i in range(2)]
    return [[s.output().apply(i).dataType().typeName() for i in range(s.output().size())] for s in sides]


def test_agreement_is_counted_after_the_last_move(spark, sf_dir):
    plan = all_queries.queries()["agreement_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")


@pytest.mark.parametrize("name", ["lookup_confidence", "lookup_conflicts", "lookup_rivals"])
def test_queries_meet_answers_without_arrays(name, spark, sf_dir):
    assert "array" not in sum(top_join(all_queries.queries()[name](spark, sf_dir)), [])


def test_winners_meet_relationships_last(spark, sf_dir):
    sides = top_join(all_queries.queries()["lookup_winner"](spark, sf_dir))
    assert [len(s) for s in sides if "array" in s] == [3]


def test_labels_need_no_institutions(spark, sf_dir):
    assert "s_suppkey" not in all_queries.queries()["lookup_match_label"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
