"""Problem 3: similar sets by the count-vector R-tree."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codekin.llm import near_sets


def brute(sets, threshold, least):
    ids = [i for i, s in sets.items() if len(s) >= least]
    return {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def pairs(spark, sets, threshold, least=1, split=near_sets.SPLIT, **how):
    rows = [(i, sorted(s), 0, "clash") for i, s in sets.items()]
    df = spark.createDataFrame(rows, "id long, tokens array<bigint>, rep long, key string")
    distinct, members = near_sets.classes(df, "id", "tokens", least)
    got = [tuple(r) for r in near_sets.record_pairs(near_sets.similar_pairs(distinct, threshold, **how), members, split).collect()]
    assert len(got) == len(set(got))
    return set(got)


def related(seed, n=120):
    rng = random.Random(seed)
    common = [rng.getrandbits(63) for _ in range(20)]
    bases = [{rng.getrandbits(63) for _ in range(rng.choice([3, 12, 40, 300]))} | set(rng.sample(common, 8)) for _ in range(n // 6)]
    out = {}
    for i in range(n):
        s = set(rng.choice(bases))
        for x in rng.sample(sorted(s), rng.randint(0, len(s) // 8)):
            s.discard(x)
        s |= {rng.getrandbits(63) for _ in range(rng.randint(0, max(1, len(s) // 10)))}
        out[i] = s
    return out


@pytest.mark.parametrize("seed, threshold", [(1, 0.8), (2, 0.9), (3, 0.6), (4, 1.0)])
def test_pairs_equal_brute_force(spark, seed, threshold):
    sets = related(seed)
    want = brute(sets, threshold, 10)
    assert pairs(spark, sets, threshold, 10) == want


def test_hot_tokens_many_leaves_and_copies(spark):
    hot = set(range(1, 31))  # every set shares nearly all of its tokens with every other
    rng = random.Random(5)
    sets = {i: hot - set(rng.sample(sorted(hot), 3)) | {1000 + i % 90} for i in range(180)}
    assert pairs(spark, sets, 0.8) == brute(sets, 0.8, 1)


@pytest.mark.parametrize("leaf, fan, hot, routes", [(2, 2, 3, 4), (1, 2, 1, 2), (2, 4, 8, 1)])
def test_any_shape_of_the_tree_gives_the_same_pairs(spark, monkeypatch, leaf, fan, hot, routes):
    monkeypatch.setattr(near_sets, "LEAF", leaf)
    monkeypatch.setattr(near_sets, "FAN", fan)
    sets = related(6, 90)
    assert pairs(spark, sets, 0.8, 10, hot=hot, routes=routes) == brute(sets, 0.8, 10)


def test_large_classes_are_paired_by_several_tasks(spark):
    sets = {i: set(range(20)) for i in range(9)} | {i: set(range(19)) for i in range(9, 20)} | {20: set(range(5, 20)), 21: set(range(1, 20))}
    assert pairs(spark, sets, 0.8, split=2) == brute(sets, 0.8, 1)


def test_candidates_do_not_grow_with_the_collection(spark):
    # every set starts with the same tokens, which the sketch cannot tell from others
    def candidates(n):
        rng = random.Random(7)
        sets = {i: {1, 2} | {rng.getrandbits(40) for _ in range(18)} for i in range(n)}
        sets |= {n + i: sets[i] ^ {min(sets[i] - {1, 2})} for i in range(n // 10)}
        df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "rep long, tokens array<bigint>")
        schema = "rep long, n int, keys array<long>, prefix int, cls int, m1 long, m2 long, over long, " + ", ".join(f"{v} long" for v in near_sets._V)
        # tokens in the order of their values, so that the common ones come first
        order = np.array(sorted({x for s in sets.values() for x in s}, reverse=True), np.int64).view(np.uint64)
        points = df.mapInArrow(near_sets._points(0.8, order, 4), schema).cache()
        return near_sets.candidates(points, 0.8, 4, 64).count() / n

    few, many = candidates(200), candidates(1600)
    assert 0.1 <= many <= 1.5 * few + 0.1


def test_bound_holds():
    rng = np.random.default_rng(1)
    for size in (5, 60, 900):
        a = rng.integers(0, 2**62, size).astype(np.uint64)
        b = np.concatenate([a[: size // 2], rng.integers(0, 2**62, size // 2).astype(np.uint64)])
        tokens, sets = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        words, over = near_sets.count_points(sets, tokens, 2)
        bound = sum(int(x & y).bit_count() for x, y in zip(words[0].tolist(), words[1].tolist())) + min(over)
        assert bound >= len(set(a.tolist()) & set(b.tolist()))


def test_empty_table_and_small_sets(spark):
    assert pairs(spark, {}, 0.8) == set()
    assert pairs(spark, {1: {1}, 2: {1}, 3: {2}, 4: set()}, 0.8) == {(1, 2)}
    assert pairs(spark, {1: {1}, 2: {1}}, 0.8, 2) == set()


def test_function_sets(spark):
    f = spark.createDataFrame(
        [(1, [" a", "a\t", "", None, "b"]), (1, None), (2, None), (3, []), (None, ["a"])], "func_id long, calls array<string>"
    ).withColumn("own", F.lit("clash"))
    b = spark.createDataFrame(
        [(1, ["s", "s", None]), (1, ["t", "a"]), (2, None), (9, ["s"]), (None, ["s"])], "func_id long, stmts array<string>"
    ).withColumn("h", F.lit(1))
    assert {r["func_id"]: len(r["tokens"]) for r in near_sets.function_sets(f, b).collect()} == {1: 5, 2: 0, 3: 0}
