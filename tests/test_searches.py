"""Searches on n-gram vectors decide their pairs in blocks: no join of queries and functions is left in the plan."""

import pytest

import __spark_entry__ as entry
from codekin.operators import graph_queries

IN_BLOCKS = ["a03_report2", "j04_other_names", "t01_topk"]


@pytest.mark.parametrize("name", IN_BLOCKS)
def test_pairs_are_decided_in_blocks(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join [__bucket" not in plan


@pytest.mark.parametrize("name", ["g21_groups", "g19_clusters"])
def test_candidates_of_the_subject_are_decided_in_blocks(spark, sf_dir, monkeypatch, name):
    plans, kept = [], graph_queries.written

    def seen(df, table):
        if table == "costs":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, table)

    monkeypatch.setattr(graph_queries, "written", seen)
    entry.queries()[name](spark, sf_dir)
    assert plans and all("MapInArrow" in p and "Join [__bucket" not in p for p in plans)
