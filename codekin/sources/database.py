"""A folder of Parquet tables as a database: dump, load, truncate, and rewriting damaged tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dump(spark: SparkSession, source: str, target: str, names: Sequence[str]) -> None:
    """Copy tables of one folder into another, replacing them there."""
    for name in names:
        spark.read.parquet(f"{source}/{name}.parquet").write.mode("overwrite").parquet(f"{target}/{name}.parquet")


def load(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables by name, each also a temporary view."""
    out = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def truncate(spark: SparkSession, folder: str, name: str) -> None:
    """Empty a table; its schema stays."""
    path = f"{folder}/{name}.parquet"
    empty = spark.createDataFrame([], spark.read.parquet(path).schema)
    empty.write.mode("overwrite").parquet(path)


def repair(spark: SparkSession, source: str, target: str, name: str) -> tuple[int, list[str]]:
    """Copy what can be read of a table with damaged files; returns the number of rows kept and the paths of
    the files that cannot be read. Files that give rows are whole; only the others are opened once more."""
    folder = f"{source}/{name}.parquet"
    rows = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(folder)
    rows.write.mode("overwrite").parquet(f"{target}/{name}.parquet")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))
    whole = rows.select("_metadata.file_path").distinct().select(F.regexp_replace("file_path", "^file:/+", "file:/").alias("path"))
    damaged = []
    for r in listed.join(whole, "path", "left_anti").toLocalIterator():
        try:
            spark.read.parquet(r["path"]).count()
        except Exception:  # noqa: BLE001 - whatever the reader says of it
            damaged.append(r["path"])
    return spark.read.parquet(f"{target}/{name}.parquet").count(), sorted(damaged)
