"""Result rows, what is still to be done, and the log of runs.

A run scores files; each score is a row (file_id, expt_id, elapsed_ms, finished_at, score). An error is
a negative score, which ``status`` names. Planning a run is an anti or semi join against the rows of
earlier ones, made before anything is scored.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codekin.functions.scalars import elapsed_ms
from codekin.operators.writes import upsert

R = TypeVar("R")
#: Scores of errors: fixed values.
ERRORS = {-1: "TIMEOUT_DATABASE", -2: "TIMEOUT_FEATURES", -3: "TIMEOUT_DISTANCE", -4: "DATABASE_MISSING"}
MODES = ("replace", "resume", "repair")


def status(score: Column) -> Column:
    """OK for scores from 0 on, the error's name for its score, ERROR for other negative ones; null
    stays null."""
    named = F.when(score >= 0, "OK")
    for code, name in ERRORS.items():
        named = named.when(score == code, name)
    return named.when(score < 0, "ERROR")


def result_rows(scores: DataFrame, expt_id: Column | int, started_at: Column, finished_at: Column | None = None) -> DataFrame:
    """(file_id, expt_id, elapsed_ms, finished_at, score, status) of (file_id, score); a row without a
    score is a missing database. ``finished_at`` is now unless given."""
    score = F.coalesce(F.col("score"), F.lit(-4.0))
    end = F.current_timestamp() if finished_at is None else finished_at
    expt = expt_id if isinstance(expt_id, Column) else F.lit(expt_id).cast("long")
    return scores.select(
        "file_id", expt.alias("expt_id"), elapsed_ms(started_at, end).alias("elapsed_ms"), end.alias("finished_at"), score.alias("score"), status(score).alias("status")
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The result rows after a run: of each file and experiment the one finished last."""
    return upsert(old, new, ["file_id", "expt_id"], "finished_at")


def to_do(files: DataFrame, results: DataFrame, mode: str) -> DataFrame:
    """The rows of ``files`` (with file_id) that a run in this mode works on.

    replace: all. resume: those without any result row. repair: those without a good row (a score from 0
    on and a time), and those with a bad one. A file with very many rows costs one row a task, as the
    rows are made one per file before they are joined."""
    if mode not in MODES:
        raise ValueError(mode)
    if mode == "replace":
        return files
    good = F.coalesce((F.col("score") >= 0) & F.col("finished_at").isNotNull(), F.lit(False))
    known = results.groupBy("file_id").agg(F.min(good).alias("__all"), F.max(good).alias("__any"))
    if mode == "repair":
        known = known.where("__all AND __any")
    return files.join(known.select("file_id"), "file_id", "left_anti")


def runs(log: DataFrame) -> DataFrame:
    """(expt_id, started_at, stopped_at, elapsed_ms) of a log of stamps (expt_id, event, at): the first start
    and the last stop; null while it has not stopped."""
    at = lambda event: F.when(F.col("event") == event, F.col("at"))
    rows = log.groupBy("expt_id").agg(F.min(at("start")).alias("started_at"), F.max(at("stop")).alias("stopped_at"))
    return rows.select("*", elapsed_ms(F.col("started_at"), F.col("stopped_at")).alias("elapsed_ms"))


def within(spark: SparkSession, seconds: float, work: Callable[[], R]) -> R:
    """``work()``, whose Spark jobs are cancelled after ``seconds``; then ``TimeoutError`` is raised."""
    group = f"limit-{threading.get_ident()}-{id(work)}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, f"limited to {seconds} s", interruptOnCancel=True)
    timer.start()
    try:
        return work()
    except Exception as e:  # noqa: BLE001
        if late.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
