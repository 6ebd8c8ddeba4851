"""How often every distinct term, or run of terms, occurs, and in how many records.

Suffix-sorted counting: each record emits, for each position, the suffix that starts there,
truncated to ``longest`` terms. Equal suffixes are combined before the shuffle; they are routed by
their first term (and, when runs are counted, a salt from the second, so that a first term that
starts a third of all suffixes is split), sorted in reverse lexicographic order within each
partition, and one pass with a stack of the current prefix adds up the counts of all prefixes.

Record sets are carried as counts: a suffix notes for each prefix length whether that prefix occurs
here for the first time within its record. The sum of those marks is the size of the record set,
so no set of ids is ever held, however common the term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_A_SALT = 100_000  # records for each part of the suffixes with one first term


def _suffixes(longest: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(0)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            total = int(lengths.sum())
            if not total:
                continue
            coded = lists.flatten().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            record = np.repeat(np.arange(len(lengths)), lengths)
            left = np.repeat(np.cumsum(lengths), lengths) - np.arange(total)  # terms from a position to its record's end
            marks, prefix = [], np.zeros(total, np.int64)
            for n in range(1, longest + 1):
                at = np.flatnonzero(left >= n)
                # prefixes of n terms by number: the number of the first n - 1 terms, and the last one
                _, number = np.unique(prefix[at] * len(coded.dictionary) + codes[at + n - 1], return_inverse=True)
                prefix = np.zeros(total, np.int64)
                prefix[at] = number
                _, first = np.unique(record[at] * (total + 1) + number, return_index=True)
                mark = np.zeros(total, np.int64)
                mark[at[first]] = 1
                marks.append(pa.array(mark))
            size = np.minimum(left, longest)
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(np.arange(total), size)
            terms = coded.dictionary.take(pa.array(codes[place]))
            suffixes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), terms)
            yield pa.RecordBatch.from_arrays([suffixes, *marks], ["suffix", *[f"r{n}" for n in range(longest)]])

    return batches


def _stack(longest: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix: list[str] = []
        counts: list[list[int]] = []  # occurrences and records of each open prefix
        grams: list[list[str]] = []
        sums: list[list[int]] = []

        def close(depth: int) -> None:
            while len(prefix) > depth:
                occurrences, records = counts.pop()
                grams.append(prefix[:])
                sums.append([occurrences, records])
                prefix.pop()
                if counts:
                    counts[-1][0] += occurrences

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.list_(pa.string())), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64())],
                ["gram", "occurrences", "records"],
            )
            grams.clear()
            sums.clear()
            return out

        for batch in it:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for suffix, occurrences, *records in zip(*columns):
                common = 0
                while common < len(prefix) and common < len(suffix) and prefix[common] == suffix[common]:
                    common += 1
                close(common)
                for term in suffix[common:]:
                    prefix.append(term)
                    counts.append([0, 0])
                counts[len(suffix) - 1][0] += occurrences
                for n in range(len(suffix)):
                    counts[n][1] += records[n]
            if len(grams) > 20_000:
                yield flush()
        close(0)
        if grams:
            yield flush()

    return batches


def term_statistics(records: DataFrame, terms_col: str, longest: int = 1, n_records: int | None = None) -> DataFrame:
    """(gram, occurrences, records) of every run of 1 to ``longest`` terms.

    ``records`` has one row per record; ``terms_col`` is its list of terms, in order, without nulls.
    Null and empty lists give nothing. A term repeated within a record counts each time as an
    occurrence and once as a record. ``n_records``, if known, sets how many tasks share the suffixes of
    one first term."""
    if longest < 1:
        raise ValueError("longest must be at least 1")
    marks = [f"r{n}" for n in range(longest)]
    suffixes = records.where(F.size(terms_col) > 0).select(terms_col).mapInArrow(
        _suffixes(longest), "suffix array<string>, " + ", ".join(f"{m} long" for m in marks)
    )
    combined = suffixes.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in marks])
    route: list[Column] = [F.element_at("suffix", 1)]
    if longest > 1:
        route.append(F.pmod(F.xxhash64(F.try_element_at("suffix", F.lit(2))), F.lit(max(16, min(4096, (n_records or 0) // ROWS_A_SALT)))))
    ordered = combined.repartition(*route).sortWithinPartitions(F.col("suffix").desc())
    grams = ordered.mapInArrow(_stack(longest), "gram array<string>, occurrences long, records long")
    if longest == 1:
        return grams
    single = grams.where(F.size("gram") == 1).groupBy("gram").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")
    )
    return grams.where(F.size("gram") > 1).unionByName(single)


def marked(statistics: DataFrame, total: int, rare_at_most: int, common_share: float) -> DataFrame:
    """``statistics`` with ``mark``: 'rare' up to ``rare_at_most`` records, else 'common' from
    ``common_share`` of ``total`` records on, else null. Where both hold, only 'rare' is given."""
    common = F.col("records") >= F.lit(common_share * total - 1e-9)
    return statistics.withColumn(
        "mark", F.when(F.col("records") <= rare_at_most, "rare").when(common, "common")
    )
