"""Plans: no products, filters and columns at the scan, bounded broadcasts only."""

import re

import pytest

import __spark_entry__ as entry

#: A subject graph on one row meets every other file's graph.
ONE_ROW = {"g15_umeyama"}


def plan(spark, df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in ("d01_cosim", "j03_star", "j04_report1", "f04_import_subset", "g05_reach", "g17_align_score", "j13_range", "p1_found", "p1_profile", "u05_ignore", "t01_topk") if n not in ONE_ROW])
def test_no_product(spark, sf_dir, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, entry.queries()[name](spark, sf_dir)))


def test_columns_are_pruned(spark, sf_dir):
    text = plan(spark, entry.queries()["a11_extent"](spark, sf_dir))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["func_id:bigint,file_id:bigint,startea:bigint,endea:bigint"]


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(spark, entry.queries()["g03_weights"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(fn_parent), IsNotNull(fn_child)]" in text


def test_no_row_at_a_time_python(spark, sf_dir):
    for name in ("d01_cosim", "w01_ngrams", "g05_reach", "p1_profile", "d15_escaped"):
        assert "Python" not in plan(spark, entry.queries()[name](spark, sf_dir))
