"""A worker that takes arriving rows batch by batch and appends its results once.

The reference's request loop becomes a structured stream over an arriving-files source; the engine's
tasks take the place of its queue and consumers. There is no state between batches: each batch's
results go to a folder of their own by batch number, so a batch that is run again overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekin.sources.formats import _GDL_EDGE, _GDL_NODE


def work_off(spark: SparkSession, source: str, work: Callable[[DataFrame], DataFrame], out: str, files_per_batch: int = 64) -> DataFrame:
    """Apply ``work`` to all rows that have arrived in the Parquet folder or file ``source`` since the
    last call with this ``out``, and return all results so far (every arriving file counts once)."""
    schema = spark.read.parquet(source).schema
    pattern = f"{source[:-1]}[{source[-1]}]"  # as a pattern, a single file may stand for its folder
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/results/batch={number}")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/results").drop("batch")


def graph_sizes(spark: SparkSession, source: str, out: str) -> DataFrame:
    """(gdl_id, n_nodes, n_edges) of arriving graph files."""

    def sizes(batch: DataFrame) -> DataFrame:
        body = F.coalesce("body", F.lit(""))
        count = lambda p: F.size(F.regexp_extract_all(body, F.lit(p), F.lit(1)))
        return batch.select("gdl_id", count(_GDL_NODE).alias("n_nodes"), count(_GDL_EDGE).alias("n_edges"))

    return work_off(spark, source, sizes, out)
