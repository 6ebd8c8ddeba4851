"""Problem 4: shared spans."""

import random
from collections import defaultdict

import numpy as np

from codekin.llm.spans import rolling_hashes, shared_share, shared_spans

SCHEMA = "bb_id long, stmts array<string>, h long, pos int, tokens string"


def brute(records, width):
    holders = defaultdict(set)
    for i, t in records.items():
        for p in range(len(t) - width + 1):
            holders[tuple(t[p : p + width])].add(i)
    out = set()
    for i, t in records.items():
        shared = set()
        for p in range(len(t) - width + 1):
            if len(holders[tuple(t[p : p + width])]) > 1:
                shared |= set(range(p, p + width))
        start = None
        for p in range(len(t) + 1):
            if p in shared and start is None:
                start = p
            if p not in shared and start is not None:
                out.add((i, start, p - 1))
                start = None
    return out


def spans(spark, rows, width, **how):
    df = spark.createDataFrame([(i, t, 0, 0, "clash") for i, t in rows], SCHEMA)
    got = [(r["id"], r["pos_from"], r["pos_to"]) for r in shared_spans(df, "bb_id", "stmts", width, **how).collect()]
    assert len(got) == len(set(got))
    return set(got), df


def test_spans_equal_brute_force(spark):
    for seed, width in ((1, 3), (2, 4), (3, 10)):
        rng = random.Random(seed)
        pool = [[rng.choice("abcdefgh") for _ in range(30)] for _ in range(4)]
        records = {}
        for i in range(60):
            t = []
            for _ in range(rng.randint(0, 4)):
                p = rng.choice(pool)
                a = rng.randint(0, 20)
                t += p[a : a + rng.randint(1, 14)] + [f"own{rng.random()}"] * rng.randint(0, 1)
            records[i] = t
        assert spans(spark, list(records.items()), width)[0] == brute(records, width)


def test_clashing_hashes_and_hot_windows_change_nothing(spark):
    rng = random.Random(9)
    run = [rng.choice("abcdefgh") for _ in range(12)]
    records = {i: [f"own{i}"] + (run[:8] if i % 3 else run[2:]) + [rng.choice("xyz") for _ in range(i % 7)] for i in range(80)}
    want = brute(records, 4)
    for bits, hot in ((64, 100_000), (1, 100_000), (2, 3), (64, 20)):
        assert spans(spark, list(records.items()), 4, bits=bits, hot=hot)[0] == want


def test_nulls_repeats_and_redelivery(spark):
    run = [f"s{i}" for i in range(10)]
    rows = [(1, run), (1, run), (1, None), (2, run[:9]), (3, None), (4, []), (None, run), (5, run * 2), (6, [None] * 12), (7, [None] * 10)]
    got, df = spans(spark, rows, 10)
    assert got == {(1, 0, 9), (5, 0, 19), (6, 0, 11), (7, 0, 9)}
    share = {r["id"]: (r["n_tokens"], r["n_shared"], r["share"]) for r in shared_share(df, "bb_id", "stmts", 10).collect()}
    assert share == {1: (10, 10, 1.0), 2: (9, 0, 0.0), 5: (20, 20, 1.0), 6: (12, 12, 1.0), 7: (10, 10, 1.0)}


def test_only_within_one_record_is_not_shared(spark):
    assert spans(spark, [(1, list("abcabcabc")), (2, list("xyz"))], 3)[0] == set()


def test_empty_and_long(spark):
    assert spans(spark, [], 3)[0] == set()
    long = [f"t{i}" for i in range(50_000)]
    assert spans(spark, [(1, long), (2, ["x", *long[100:40_000]])], 10)[0] == {(1, 100, 39_999), (2, 1, 39_900)}


def test_rolling_hashes_are_polynomials():
    t = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 10, 16, 50, 51):
        h = rolling_hashes(t, width)
        assert len(h) == max(0, 51 - width)
        again = rolling_hashes(np.concatenate([t[5:], t[:5]]), width)
        assert len(h) < 6 or (h[5:] == again[: len(h) - 5]).all()
        assert len(set(h.tolist())) == len(h)
