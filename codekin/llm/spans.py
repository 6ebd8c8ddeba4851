"""Long exact spans shared between records.

Rabin-Karp hashes of every window of ``width`` consecutive tokens are counted in Spark; windows
that stand in more than one record merge into maximal intervals. A window is repeated when the
smallest and the largest record id that hold it differ, so no group of records is ever collected:
the count is one min/max aggregation, combined before its shuffle.

A window is known by two rolling hashes of 64 bits with different bases over different token hashes,
so two windows with one of them in common are still told apart; both go through the count and the
join. Windows that a great many records hold (found by their counts, so at most ``MOST_HOT`` of them)
go to the records by broadcast, the others by an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codekin.plans.scratch import written

#: Odd multiplier of the rolling hash (2**64 divided by the golden ratio), arithmetic modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Multiplier of the second one.
SECOND = np.uint64(0xD1342543DE82EF95)
MOST_HOT = 1000  # windows that are broadcast
HOT = 100_000  # a window that stands so often at least may be one of them


def rolling_hashes(tokens: np.ndarray, width: int, base: np.uint64 = BASE) -> np.ndarray:
    """The Rabin-Karp hash of each window of ``width`` token hashes: sum of t[i+j] * base**(width-1-j).

    Built by doubling, so it costs log2(width) vector operations. The result is mixed at the end."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, length, part = base, 1, tokens.astype(np.uint64)  # hashes of windows of 2**i
        result, done = None, 0
        bits = width
        while bits:
            if bits & 1:
                piece = part[done : done + n]
                result = piece.copy() if result is None else result * power + piece
                done += length
            bits >>= 1
            if bits:
                part = part[:-length] * power + part[length:]
                power, length = power * power, length * 2
        result ^= result >> np.uint64(29)
        result *= np.uint64(0xBF58476D1CE4E5B9)
        result ^= result >> np.uint64(32)
    return result


def _windows(width: int, bits: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(1)
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.cumsum(lengths) - lengths
            counts = np.maximum(lengths - width + 1, 0)
            total = int(counts.sum())
            if not total:
                continue
            record = np.repeat(np.arange(len(lengths)), counts)
            pos = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            at = starts[record] + pos
            first = rolling_hashes(tokens, width)[at] >> np.uint64(64 - bits)
            with np.errstate(over="ignore"):
                other = (tokens ^ (tokens >> np.uint64(31))) * SECOND
            second = rolling_hashes(other ^ (other >> np.uint64(29)), width, SECOND)[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(record)), pa.array(pos, pa.int32()), pa.array(first.view(np.int64)), pa.array(second.view(np.int64))],
                ["id", "pos", "h", "g"],
            )

    return batches


def record_tokens(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(id, tokens): one row per record with the hash of each token, in order.

    Redelivered rows are one record: the row whose token list is not null counts (of several the
    greatest list of hashes). Null ids are left out. A null token is a token like any other."""
    hashed = F.transform(tokens_col, lambda x: F.xxhash64(F.coalesce(x, F.lit("\0null"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), hashed.alias("tokens")).where(
        F.col("id").isNotNull() & (F.size("tokens") > 0)
    )
    return rows.groupBy("id").agg(F.max("tokens").alias("tokens"))


def shared_spans(df: DataFrame, id_col: str, tokens_col: str, width: int = 10, bits: int = 64, hot: int = HOT) -> DataFrame:
    """Maximal runs of tokens that lie in windows repeated in another record.

    Returns (id, pos_from, pos_to, n_tokens): positions from 0, both ends included, and the length
    of the record. Records shorter than ``width``, empty or null ones, and records without repeated
    windows give no row; equal windows within one record alone are not shared. Extra columns of
    ``df`` are not read. ``bits`` of the first hash are used, 64 but in tests. Tokens themselves are known
    by 64-bit hashes, so two windows count as equal only if each of their tokens clashes, or both of
    their own hashes do (a chance of about N**2 / 2**129 among N windows).
    """
    return _spans(written(record_tokens(df, id_col, tokens_col), "tokens"), width, bits, hot)


def _spans(records: DataFrame, width: int, bits: int = 64, hot: int = HOT) -> DataFrame:
    """``shared_spans`` of a written table of (id, tokens)."""
    records = records.where(F.size("tokens") >= width)
    windows = records.select("id", "tokens").mapInArrow(_windows(width, bits), "id long, pos int, h long, g long")
    counts = windows.groupBy("h", "g").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"))
    repeated = written(counts.where("lo <> hi").select("h", "g", "n"), "repeated")
    often = repeated.where(F.col("n") >= hot).orderBy(F.desc("n"), "h", "g").limit(MOST_HOT).select("h", "g").collect()
    hits = windows
    if often:
        # where they stand is found without sending all of their copies to one task
        known = F.broadcast(records.sparkSession.createDataFrame([(r["h"], r["g"], True) for r in often], "h long, g long, often boolean"))
        marked = windows.join(known, ["h", "g"], "left")
        hits = marked.where("often IS NULL").drop("often")
    hits = hits.join(repeated, ["h", "g"], "left_semi").select("id", "pos")
    if often:
        hits = hits.unionByName(marked.where("often").select("id", "pos"))
    by_record = Window.partitionBy("id").orderBy("pos")
    before = F.lag("pos").over(by_record)
    runs = hits.withColumn("new", (before.isNull() | (F.col("pos") > before + width)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(by_record.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("id", "run").agg(
        F.min("pos").alias("pos_from"), (F.max("pos") + F.lit(width - 1)).cast("int").alias("pos_to")
    )
    sizes = records.select("id", F.size("tokens").alias("n_tokens"))
    return spans.join(sizes, "id").select("id", "pos_from", "pos_to", "n_tokens")


def shared_share(df: DataFrame, id_col: str, tokens_col: str, width: int = 10) -> DataFrame:
    """Of each record with tokens: (id, n_tokens, n_shared, share), share rounded to 6 places.

    Every record with at least one token has a row, also where nothing is shared."""
    records = written(record_tokens(df, id_col, tokens_col), "tokens")
    spans = _spans(records, width).groupBy("id").agg(F.sum(F.col("pos_to") - F.col("pos_from") + 1).alias("s"))
    records = records.select("id", F.size("tokens").alias("n_tokens"))
    shared = F.coalesce("s", F.lit(0)).cast("long")
    return records.join(spans, "id", "left").select(
        "id", "n_tokens", shared.alias("n_shared"), F.round(shared / F.col("n_tokens"), 6).alias("share")
    )
