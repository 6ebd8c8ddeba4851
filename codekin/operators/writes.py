"""Writes as plans: keep-first, upsert, insert-ignore, surrogate ids, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codekin.plans.scratch import written


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row with the smallest ``order``; combined before the shuffle, so a
    hot key costs one row a task. Keys may be null and then form a group."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order))
    return df.groupBy(*keys).agg(first.alias("__r")).select(*[F.col(c) if c in keys else F.col(f"__r.{c}") for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], written_at: str) -> DataFrame:
    """Last write wins by ``written_at``; among equal times the greatest row."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    last = F.max(F.struct(F.col(written_at).alias("__at"), *rest))
    return rows.groupBy(*keys).agg(last.alias("__r")).select(*[F.col(c) if c in keys else F.col(f"__r.{c}") for c in rows.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new``, once per key, whose key is not in ``old``."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def dense_ids(df: DataFrame, col: str, first: int = 1) -> DataFrame:
    """(col, id): consecutive ids of the distinct values of ``col`` in their order.

    A range-partitioned sort, then one offset per partition; no partition sees all values, as it
    would under one global window. Null gets no id."""
    ordered = df.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(col).sortWithinPartitions(col)
    place = F.monotonically_increasing_id()
    ordered = written(
        ordered.select(col, F.shiftright(place, 33).alias("__p"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__i")), "ids"
    )
    counts = sorted((r["__p"], r["n"]) for r in ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], first
    for p, n in counts:
        offsets.append((p, total))
        total += n
    schema = T.StructType([T.StructField("__p", T.LongType()), T.StructField("__o", T.LongType())])
    starts = df.sparkSession.createDataFrame(offsets, schema)
    return ordered.join(F.broadcast(starts), "__p").select(col, (F.col("__o") + F.col("__i")).alias("id"))


def updated(df: DataFrame, when: Column, **values: Column) -> DataFrame:
    """U8: the rows with ``values`` set where ``when`` holds."""
    return df.select(*[F.when(when, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])
