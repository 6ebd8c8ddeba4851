"""Assignments and neighbours follow the given pairs: results of the whole matrix, work and shuffles of the pairs alone."""

import random
import time

import numpy as np
import pytest

import __spark_entry__ as entry
from codekin.operators import graph, graph_queries, matching
from codekin.plans.scratch import written


def test_sparse_assignment_costs_as_much_as_the_whole_matrix():
    rng = random.Random(7)
    for n, m, share, top in [(1, 1, 1, 9), (6, 4, 0.6, 3), (4, 9, 0.5, 9), (12, 12, 0.3, 2), (30, 25, 0.2, 9), (25, 40, 0.9, 5)] * 8:
        given = {(i, j): rng.randint(0, top) for i in range(n) for j in range(m) if rng.random() < share} or {(0, 0): 1}
        dense = np.full((n, max(n, m)), 10)
        for k, c in given.items():
            dense[k] = c
        rows, cols, cost = np.array([(*k, c) for k, c in sorted(given.items())]).T
        to = matching.sparse_assignment(rows, cols, cost, 10)
        taken = [(i, j) for i, j in enumerate(to.tolist()) if j >= 0]
        assert len({j for _, j in taken}) == len(taken)
        best = dense[range(n), matching.assignment(dense)].sum()
        assert sum(given[k] for k in taken) + 10 * (n - len(taken)) == best


def test_assignment_of_large_files_takes_no_matrix():
    n = 6_000  # a matrix of 36 million cells; 18,000 are given
    i = np.repeat(np.arange(n), 3)
    j, cost = (i + np.tile([0, 1, 7], n)) % n, np.tile([500, 0, 900], n)
    began = time.time()
    to = matching.sparse_assignment(i, j, cost, 10_000)
    assert (to == (np.arange(n) + 1) % n).all() and time.time() - began < 20


@pytest.mark.parametrize("opened", [2, 1_000_000])
def test_neighbours_of_pairs(monkeypatch, opened):
    monkeypatch.setattr(matching, "OPENED", opened)
    rng = np.random.default_rng(4)
    for n in (8, 20):
        f1, f2 = np.divmod(rng.permutation(n * n)[: n * n // 3], n)
        for callees in (1, n - 1):
            e1, e2 = (np.unique(np.stack([rng.integers(0, n, 3 * n), rng.integers(0, callees + 1, 3 * n)], 1), axis=0) for _ in "12")
            got = sorted((x, y) for a, b in matching.pair_neighbours(f1, f2 + 100, e1, e2 + 100) for x, y in zip(a.tolist(), b.tolist()))
            have = [{tuple(e) for e in e_.tolist()} for e_ in (e1, e2)]
            p = list(zip(f1.tolist(), f2.tolist()))
            want = sorted((x, y) for x in range(len(p)) for y in range(len(p)) if (p[x][0], p[y][0]) in have[0] and (p[x][1], p[y][1]) in have[1])
            assert got == want
            assert callees == 1 or got


def test_neighbour_costs_and_assignment_by_file(spark):
    costs = written(spark.createDataFrame([(1, 2, 10, 20, 0.1), (1, 2, 11, 21, 0.3), (1, 2, 11, 22, 0.2), (1, 3, 10, 30, 0.25)], "file1 long, file2 long, func1_id long, func2_id long, cost double"), "costs")
    edges = spark.createDataFrame([(1, 10, 11), (2, 20, 21), (2, 20, 22), (3, 30, 31)], "file_id long, fn_parent long, fn_child long")
    got = {(r["func1_id"], r["func2_id"]): (r["child"], r["parent"]) for r in matching.neighbour_costs(costs, edges).collect()}
    assert got == {(10, 20): (pytest.approx(0.25), None), (11, 21): (None, 0.1), (11, 22): (None, 0.1), (10, 30): (None, None)}
    assert sorted(tuple(r) for r in matching.assigned(costs).collect()) == [(1, 2, 10, 20, 0.1), (1, 2, 11, 22, 0.2), (1, 3, 10, 30, 0.25)]


def test_neighbours_shuffle_each_pair_once(spark, sf_dir):
    plan = entry.queries()["g19_neighbours"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["g09_assign", "g18_pair_sets"])
def test_assignment_holds_no_group_in_pandas(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan


def test_pairs_are_marked_and_clustered_by_file(spark):
    schema = "file1 long, file2 long, func1_id long, func2_id long, cost double, cluster1 long, cluster2 long"
    rows = [(1, 2, 10, 20, 0.1, 0, 5), (1, 2, 11, 21, 0.3, 0, 5), (1, 2, 11, 22, 0.2, 0, 6), (1, 3, 10, 30, 0.25, 0, 5), (1, 3, 11, 30, 0.3, None, 5)]
    costs = written(spark.createDataFrame(rows, schema), "costs")
    assert {tuple(r) for r in matching.kinds(costs).collect()} == {(10, 20, "IS"), (11, 21, "MAY"), (11, 22, "IS"), (10, 30, "IS"), (11, 30, "MAY")}
    mean = {(r["func1_id"], r["func2_id"]): (r["vertex"], r["cluster"]) for r in matching.cluster_costs(costs).collect()}
    assert mean == {(10, 20): (0.1, pytest.approx(0.2)), (11, 21): (0.3, pytest.approx(0.2)), (11, 22): (0.2, 0.2), (10, 30): (0.25, 0.25), (11, 30): (0.3, None)}


@pytest.mark.parametrize("name", ["g18_pair_sets", "g19_clusters"])
def test_candidates_are_shuffled_once(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


@pytest.mark.parametrize("held", [3, 1_000_000])
def test_stars_keep_components(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "EDGES_HELD", held)
    rng = random.Random(9)
    e = [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    edges = spark.createDataFrame(e, "fn_parent long, fn_child long").repartition(3)
    got = graph.stars(edges)
    ends = spark.createDataFrame([(x,) for x in {x for p in e for x in p}], "func_id long")
    assert {r[0] for r in got.select("fn_child").collect()} == {x for p in e for x in p}
    assert {tuple(r) for r in graph.components(ends, got).collect()} == {tuple(r) for r in graph.components(ends, edges).collect()}
    assert graph.stars(spark.createDataFrame([(1, 2 + i % 5) for i in range(500)], edges.schema).coalesce(1)).count() == 6


def test_groups_of_candidates_start_from_stars(spark, sf_dir, monkeypatch):
    names, kept = [], graph_queries.written
    monkeypatch.setattr(graph_queries, "written", lambda df, name: names.append(name) or kept(df, name))
    entry.queries()["g21_groups"](spark, sf_dir)
    assert names == ["costs", "stars"]
