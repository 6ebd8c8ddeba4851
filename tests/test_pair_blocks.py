"""Pairs are decided where they are formed: plans without a shuffle of pairs, blocks of any size, equal results."""

import random

import pytest

import __spark_entry__ as entry
from codekin.operators import distance, pair_blocks


@pytest.mark.parametrize("name", ["f01_gates", "j03_results"])
def test_no_pair_is_shuffled(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(func1_id" not in plan and "hashpartitioning(func2_id" not in plan


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(5)
    own = {i: {g: rng.randint(1, 4) for g in ["common", *rng.sample("abcdefgh", rng.randint(0, 6))]} for i in range(60)}
    fn = spark.createDataFrame([(i, i % 4 or None, len(v) if i % 7 else 0) for i, v in own.items()] + [(99, 9, 3)], "func_id long, file_id long, num_ngrams long")
    return fn, spark.createDataFrame([(i, g, f) for i, v in own.items() for g, f in v.items()], "func_id long, ngram string, freq long")


def test_blocks_of_any_size_give_the_same(spark, vectors, monkeypatch):
    fn, freq = vectors
    queries = fn.where("func_id % 3 = 0")

    def found():
        some = [distance.distances(m, queries, fn, freq) for m in ("cosim", "euclid")] + [distance.near_pairs(queries, fn, freq, 0.4, carry=("num_ngrams",))]
        some += [distance.nearest_pairs(queries, fn, freq), distance.lowest_by_file(queries, fn, freq)]
        return [sorted(tuple(r) for r in df.collect()) for df in some]

    once = found()
    for name, value in (("FUNCTIONS_A_BLOCK", (3, 3)), ("QUERIES_A_CUT", 4), ("CELLS", 20), ("ROWS_A_BATCH", 2), ("COMMON_SHARE", 2.0)):
        monkeypatch.setattr(pair_blocks, name, value)
    assert found() == once and all(once)


def test_lowest_pairs_only_are_written(spark, vectors, monkeypatch):
    fn, freq = vectors
    queries, rows = fn.where("func_id % 3 = 0"), {}
    monkeypatch.setattr(distance, "written", lambda df, name, kept=distance.written: rows.setdefault(name, kept(df, name)))
    got = distance.nearest_pairs(queries, fn, freq).collect()
    monkeypatch.undo()
    near = distance.near_pairs(queries, fn, freq, 1.0).collect()
    low = {r["func1_id"]: min(x["value"] for x in near if x["func1_id"] == r["func1_id"]) for r in near}
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in near if r["value"] == low[r["func1_id"]])
    assert rows["nearest"].count() < len(near) / 2


@pytest.mark.parametrize("name", ["a10_argmin", "g09_assign", "g18_pair_sets", "t01_topk", "d01_cosim"])
def test_shuffles_carry_packed_rows(spark, sf_dir, monkeypatch, name):
    met, meet = [], pair_blocks.meet
    monkeypatch.setattr(pair_blocks, "meet", lambda rows, *more: met.append(rows) or meet(rows, *more))
    entry.queries()[name](spark, sf_dir)
    assert met and all({"__rows", "__side"} <= set(rows.columns) and "terms" not in rows.columns for rows in met)


def test_packed_rows_are_small(spark, monkeypatch):
    monkeypatch.setattr(pair_blocks, "FUNCTIONS_A_BLOCK", (100, 100))
    rng, met, meet = random.Random(3), [], pair_blocks.meet
    names = [f"op{i} op{j} op{k}" for i in range(5) for j in range(5) for k in range(5)]
    fn = spark.range(2_000).selectExpr("id AS func_id", "id % 9 AS file_id", "30L AS num_ngrams").coalesce(1)
    freq = spark.createDataFrame([(i, rng.sample(names, 30), [1] * 30) for i in range(2_000)], "func_id long, terms array<string>, freqs array<long>")
    monkeypatch.setattr(pair_blocks, "meet", lambda rows, *more: met.append(rows) or meet(rows, *more))
    distance.near_pairs(fn.where("func_id % 4 = 0"), fn, freq, 0.4)
    n, size = met[0].selectExpr("count(1)", "sum(length(__rows))").first()
    copies = 2_000 + 500 * 20  # each function once, each query once for each of 20 blocks
    assert n < copies / 10 and size < copies * 30 * 10 / 4
