"""Reading the tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space in the sense of the test data: blank, tab, line end.
BLANKS = " \t\r\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of ``sf_dir``; projections and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cleaned(col: Column | str) -> Column:
    """A name without the white space around it; blank becomes null."""
    trimmed = F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))
    return F.when(trimmed != "", trimmed)
