"""Problem 2: suffix-sorted counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codekin.llm.frequency import marked, term_statistics

SCHEMA = "id long, terms array<string>, gram string, occurrences long"


def brute(records, longest):
    occurrences, holders = Counter(), Counter()
    for terms in records:
        grams = [tuple(terms[i : i + n]) for n in range(1, longest + 1) for i in range(len(terms or []) - n + 1)] if terms else []
        occurrences.update(grams)
        holders.update(set(grams))
    return {g: (occurrences[g], holders[g]) for g in occurrences}


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_counts(spark, longest):
    rng = random.Random(longest)
    records = [[rng.choice("aaaaabcdé\"") for _ in range(rng.randint(0, 12))] for _ in range(300)] + [None, [], ["a"] * 500, ["x y", "x", "y"]]
    df = spark.createDataFrame([(i % 50, r, "clash", 1) for i, r in enumerate(records)], SCHEMA)
    rows = term_statistics(df, "terms", longest).collect()
    assert len({tuple(r["gram"]) for r in rows}) == len(rows)
    assert {tuple(r["gram"]): (r["occurrences"], r["records"]) for r in rows} == brute(records, longest)


def test_empty_and_long_terms(spark):
    assert term_statistics(spark.createDataFrame([], SCHEMA), "terms", 2).count() == 0
    df = spark.createDataFrame([(1, ["z" * 100_000] * 2, "", 1)], SCHEMA)
    assert [(r["occurrences"], r["records"]) for r in term_statistics(df, "terms").collect()] == [(2, 1)]
    with pytest.raises(ValueError):
        term_statistics(df, "terms", 0)


def test_marks(spark):
    df = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4), ("d", 5)], "t string, records long")
    got = lambda total: {r["t"]: r["mark"] for r in marked(df, total, 2, 0.04).select("t", "mark").collect()}
    assert got(100) == {"a": "rare", "b": None, "c": "common", "d": "common"}
    assert got(25) == {"a": "rare", "b": "common", "c": "common", "d": "common"}
    assert marked(df.where(F.lit(False)), 0, 2, 0.04).count() == 0
