"""Problem 1: per-key results under skew."""

from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codekin.operators.skew import balanced_counts, balanced_profile, heavy_keys, split_join

SCHEMA = "name string, file_id long, seen_at timestamp, n_rows long, is_heavy string, salt long"


def brute(rows):
    out = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            out[r[0]].append(r)
    return {
        k: (len(v), len({x[1] for x in v} - {None}), min((x[2] for x in v if x[2]), default=None), max((x[2] for x in v if x[2]), default=None))
        for k, v in out.items()
    }


def profile(df, **options):
    rows = balanced_profile(df, F.col("name"), "file_id", "seen_at", **options).collect()
    assert len({r["key_value"] for r in rows}) == len(rows)
    return {r["key_value"]: (r["n_rows"], r["n_files"], r["first_seen"], r["last_seen"]) for r in rows}


def test_skewed_nulls_ties_and_repeated_rows(spark):
    t = datetime(2020, 1, 1)
    rows = [("hot", i % 7 if i % 5 else None, t + timedelta(seconds=i % 11) if i % 3 else None, 1, "x", 2) for i in range(3000)]
    rows += [(f"k{i % 400}", i % 3, t, None, None, None) for i in range(1000)] + [(None, 1, t, 1, "", 1)] * 50 + [("only nulls", None, None, 0, "", 0)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    assert profile(df) == brute(rows)
    assert profile(df, heavy=[]) == brute(rows)
    assert profile(df, heavy=["hot", "k1", "absent"]) == brute(rows)


def test_counts_and_joins_do_not_depend_on_the_list(spark):
    rows = [("hot",)] * 300 + [(f"k{i % 40}",) for i in range(200)] + [(None,)] * 20
    df = spark.createDataFrame(rows, "name string").withColumn("id", F.monotonically_increasing_id())
    want = {"hot": 300} | {f"k{i}": 5 for i in range(40)}
    few = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("none", 4), (None, 5)], "name string, q int")
    joined = sorted(tuple(r) for r in few.join(df, "name").collect())
    for heavy in ([], ["hot"], ["hot", "k1", "absent"]):
        got = balanced_counts(df, F.col("name"), heavy).collect()
        assert len(got) == len(want) and {r["key_value"]: r["n_rows"] for r in got} == want
        assert sorted(tuple(r) for r in split_join(few, df, "name", heavy, "id", 4, 3).select("name", "q", "id").collect()) == joined
    assert balanced_counts(df.limit(0), F.col("name"), ["hot"]).count() == 0


def test_heavy_keys_are_found(spark):
    df = spark.createDataFrame([("hot",)] * 500 + [(f"k{i}",) for i in range(500)], "name string")
    heavy, n = heavy_keys(df, F.col("name"), 0.1)
    assert n == 1000 and heavy == ["hot"]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert profile(df) == {} and heavy_keys(df, F.col("name"), 0.1) == ([], 0)


def test_very_long_key(spark):
    rows = [("x" * 200_000, 1, None, 1, "", 1)] * 3
    assert profile(spark.createDataFrame(rows, SCHEMA)) == {"x" * 200_000: (3, 1, None, None)}
