"""Per-key results where a few keys hold most rows.

Heavy keys are found with a frequent-items sketch in one pass. Their rows meet the (bounded) list
of heavy keys in a broadcast join and are aggregated in two steps over salted sub-keys; all other
rows take an ordinary shuffle on the key; the two parts are united. The sketch only decides the
route, so every count is exact whatever the sketch says.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def heavy_keys(df: DataFrame, key: Column, share: float, most: int = 1000) -> tuple[list[str], int]:
    """Keys that hold about ``share`` of the rows or more (at most ``most``, so at most ``1/share``
    matter) and the number of all rows. One pass; the driver gets at most ``most`` values."""
    most = max(1, min(most, int(2 / share)))
    sketch = F.expr(f"approx_top_k(__k, {most}, {max(8 * most, 1000)})")
    row = df.select(key.alias("__k")).agg(sketch.alias("top"), F.count(F.lit(1)).alias("n"))
    got = row.first()
    floor = share / 2 * got["n"]
    return [x["item"] for x in got["top"] or [] if x["item"] is not None and x["count"] >= floor], got["n"]


def balanced_profile(
    df: DataFrame,
    key: Column,
    distinct_of: str,
    time_of: str,
    share: float = 0.002,
    salts: int = 64,
    heavy: Sequence[str] | None = None,
) -> DataFrame:
    """Rows, distinct ``distinct_of`` and first and last ``time_of`` of every value of ``key``.

    Columns: key_value, n_rows, n_files, first_seen, last_seen, is_heavy. Rows whose key is null
    are no values and give no result row; null ``distinct_of`` and times are left out of their
    aggregates (0 files, null times if there is no other). Repeated rows count as often as they
    stand. An empty input gives an empty result. Only the three columns named are read, so extra
    columns cannot clash. The salt is a hash of ``distinct_of`` and so splits the distinct values of
    a heavy key into disjoint sets whose counts add up; where one of those values is hot itself, the
    partial aggregation before the shuffle has already reduced it to one row a task.
    """
    rows = df.select(key.alias("__k"), F.col(distinct_of).alias("__d"), F.col(time_of).alias("__t"))
    if heavy is None:
        heavy, _ = heavy_keys(rows, F.col("__k"), share)
    spark = df.sparkSession
    schema = T.StructType([T.StructField("__h", T.StringType())])
    known = F.broadcast(spark.createDataFrame([(k,) for k in heavy], schema))
    rows = rows.where(F.col("__k").isNotNull())
    measures = [F.count(F.lit(1)).alias("n"), F.min("__t").alias("lo"), F.max("__t").alias("hi")]

    hot = rows.join(known, rows["__k"] == known["__h"], "left_semi")
    hot = hot.groupBy("__k", "__d").agg(*measures)  # combined before the shuffle, spread over (key, value)
    hot = hot.groupBy("__k", F.pmod(F.xxhash64("__d"), F.lit(salts)).alias("salt")).agg(
        F.sum("n").alias("n"), F.count("__d").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    cold = rows.join(known, rows["__k"] == known["__h"], "left_anti")
    cold = cold.groupBy("__k", "__d").agg(*measures)

    def final(part: DataFrame, files: Column, is_heavy: bool) -> DataFrame:
        return part.groupBy("__k").agg(
            F.sum("n").alias("n_rows"),
            files.cast("long").alias("n_files"),
            F.min("lo").alias("first_seen"),
            F.max("hi").alias("last_seen"),
            F.lit(is_heavy).alias("is_heavy"),
        )

    both = final(hot, F.sum("d"), True).unionByName(final(cold, F.count("__d"), False))
    return both.withColumnRenamed("__k", "key_value")


def balanced_counts(df: DataFrame, key: Column, heavy: Sequence[str]) -> DataFrame:
    """(key_value, n_rows) of every value of ``key`` that is not null: rows of the listed heavy keys by a
    broadcast join, combined to one row a key and task before they are shuffled, the rest by an ordinary
    shuffle, united. The list only routes."""
    rows = df.select(key.alias("key_value")).where("key_value IS NOT NULL")
    schema = T.StructType([T.StructField("key_value", T.StringType())])
    known = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in heavy], schema))
    count = F.count(F.lit(1)).alias("n_rows")
    parts = [rows.join(known, "key_value", how).groupBy("key_value").agg(count) for how in ("left_semi", "left_anti")]
    return parts[0].unionByName(parts[1])


def split_join(left: DataFrame, right: DataFrame, key: str, heavy: Sequence[str], by: str, salts: int, tasks: int) -> DataFrame:
    """The inner join of both on ``key``, for keys that a large share of ``right`` holds.

    Rows of ``right`` with a key of ``heavy`` are spread over ``salts`` tasks by a hash of their column
    ``by``; the rows of ``left`` with such a key meet all of them. Which keys are listed decides only
    where rows meet, never which. The list is part of the plan, so it must be bounded. ``right`` is cut
    for ``tasks`` tasks, as many matches may come of few bytes."""
    if not heavy:
        return left.join(right.repartition(tasks, key), key)
    hot = F.col(key).isin(list(heavy))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    left = left.withColumn("__salt", F.explode(F.when(hot, every).otherwise(F.array(F.lit(0)))))
    right = right.withColumn("__salt", F.when(hot, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0))
    return left.join(right.repartition(tasks, key, "__salt"), [key, "__salt"]).drop("__salt")
