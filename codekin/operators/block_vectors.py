"""Functions' n-gram vectors straight from basic blocks, with shuffles of packed rows.

A statement is needed only for its operation, so blocks are shuffled by id as packed, compressed chunks of operations
with a hash of their statements, then by function together with the functions' own columns; n-grams are counted and
joined to the functions in the task that holds both. Where redelivered rows of a block have different statements, the
greatest list counts, which needs the statements: functions with such a block are left open and counted again alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codekin.operators.features import frequencies, operation
from codekin.operators.pair_blocks import packed, unpacked
from codekin.sources.tables import table

BLOCKS, FUNCTIONS = 0, 1  # kinds of chunks
ROWS_HELD = 500_000  # that a task packs at once
ROWS_A_BATCH = 10_000
_CHUNK = "__part int, __kind int, __rows binary"
_LEAST = np.iinfo(np.int64).min


@dataclass
class BlockRows:
    """The blocks of a dataset folder as ``vectors_with`` takes them, and the exact vectors of some functions."""

    blocks: DataFrame
    again: Callable[[DataFrame], DataFrame]


def block_rows(spark: SparkSession, sf_dir: str) -> BlockRows:
    rows = table(spark, sf_dir, "ir_bb").where("bb_id IS NOT NULL")
    terms = F.coalesce(F.transform("stmts", lambda s: F.coalesce(operation(s), F.lit(""))), F.array().cast("array<string>"))
    hashed = F.when(F.col("stmts").isNotNull(), F.xxhash64("stmts", F.size("stmts")))
    blocks = rows.select("bb_id", "func_id", F.col("bb_no").cast("long").alias("bb_no"), hashed.alias("stated"), terms.alias("terms"))
    return BlockRows(blocks, lambda ids: frequencies(spark, sf_dir, of=ids))


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % parts


def _chunks(t: pa.Table, key: str, parts: int, kind: int) -> Iterator[pa.RecordBatch]:
    """``t`` cut by the part of its key, each cut packed."""
    part = _part_of(t[key].to_numpy(), parts)
    order = np.argsort(part, kind="stable")
    t, ends = t.combine_chunks().take(pa.array(order)), np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if ends[p] < ends[p + 1]:
            value = packed(t.slice(ends[p], ends[p + 1] - ends[p]))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([kind], pa.int32()), pa.array([value], pa.binary())], ["__part", "__kind", "__rows"])


def _dealt(rows: DataFrame, key: str, parts: int, kind: int) -> DataFrame:
    """The rows as packed chunks where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS_HELD:
                yield from _chunks(pa.Table.from_batches(held), key, parts, kind)
                held, n = [], 0
        if n:
            yield from _chunks(pa.Table.from_batches(held), key, parts, kind)

    return rows.mapInArrow(run, _CHUNK)


def _gathered(chunks: DataFrame, parts: int, run: Callable[[dict[int, pa.Table]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """What ``run`` makes of all rows of each part, by kind; a part is one task's."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[pa.Table]] = {}
        for batch in batches:
            for kind, value in zip(batch.column("__kind").to_pylist(), batch.column("__rows")):
                found.setdefault(kind, []).append(unpacked(value.as_buffer()))
        if found:
            yield from run({kind: pa.concat_tables(tables).combine_chunks() for kind, tables in found.items()})

    return chunks.repartitionById(parts, F.col("__part")).mapInArrow(task, schema)


def _known(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers; the least one stands for null."""
    return column.fill_null(_LEAST).to_numpy()


def _nullable(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=x == _LEAST)


def merged(t: pa.Table) -> pa.Table:
    """One row a block: the greatest function and number, the statements' operations; ``open`` where statements differ.
    Blocks without a function are left out."""
    bb, stated = t["bb_id"].to_numpy(), _known(t["stated"])
    missing = t["stated"].is_null().to_numpy()
    order = np.lexsort((stated, missing, bb))  # rows with statements come first
    bb, stated, missing = bb[order], stated[order], missing[order]
    first = np.flatnonzero(np.concatenate([[True], bb[1:] != bb[:-1]]))
    differs = np.zeros(len(bb), bool)
    differs[1:] = (bb[1:] == bb[:-1]) & ~missing[1:] & (stated[1:] != stated[:-1])
    func, no = (np.maximum.reduceat(_known(t[c])[order], first) for c in ("func_id", "bb_no"))
    kept = func != _LEAST
    out = {"bb_id": bb[first][kept], "func_id": func[kept], "bb_no": _nullable(no[kept]), "open": np.logical_or.reduceat(differs, first)[kept]}
    return pa.table(out | {"terms": t["terms"].take(pa.array(order[first][kept]))})


def counted(t: pa.Table, n: int) -> tuple[np.ndarray, pa.ListArray, pa.ListArray, np.ndarray]:
    """(functions in ascending order, n-grams, frequencies, open) of merged blocks, in the order of (bb_no, bb_id), nulls last."""
    no = _known(t["bb_no"])
    order = np.lexsort((t["bb_id"].to_numpy(), no, no == _LEAST, t["func_id"].to_numpy()))
    t = t.take(pa.array(order)).combine_chunks()
    ids, place = np.unique(t["func_id"].to_numpy(), return_inverse=True)
    left_open = np.bincount(place, t["open"].to_numpy(), minlength=len(ids)) > 0
    lists = t["terms"].combine_chunks()
    words = lists.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    who = np.repeat(place, np.asarray(lists.value_lengths(), np.int64))
    m, v = max(0, len(code) - n + 1), max(1, len(words.dictionary))
    within = who[:m] == who[n - 1 :] if m else np.zeros(0, bool)
    key, starts = np.zeros(int(within.sum()), np.int64), np.flatnonzero(within)
    for k in range(n):  # distinct runs of k + 1 operations, numbered
        key = np.unique(key * v + code[starts + k], return_inverse=True)[1].astype(np.int64)
    _, sample = np.unique(key, return_index=True)
    names = np.array(words.dictionary.to_pylist(), object)
    grams = [" ".join(names[code[starts[i] : starts[i] + n]]) for i in sample]
    both, freq = np.unique(who[starts] * max(1, len(grams)) + key, return_counts=True)
    who, key = both // max(1, len(grams)), both % max(1, len(grams))
    ends = pa.array(np.searchsorted(who, np.arange(len(ids) + 1)).astype(np.int32))
    terms = pa.DictionaryArray.from_arrays(pa.array(key.astype(np.int32)), pa.array(grams, pa.string())).dictionary_decode()
    return ids, pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(freq.astype(np.int64))), left_open


def vectors_with(rows: DataFrame, source: BlockRows, how: str, n: int = 3) -> DataFrame:
    """``rows`` (one a func_id) with ``terms``, ``freqs`` and ``open``, which says that the vector is to be counted again.

    Functions without a vector have an empty one if ``how`` is left, else they are left out unless open."""
    parts = max(1, min(10_000, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("terms array<string>, freqs array<long>, open boolean")])
    columns = rows.columns

    def by_block(found: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        if len(t := merged(found[BLOCKS])):
            yield from _chunks(t, "func_id", parts, BLOCKS)

    def by_function(found: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        if FUNCTIONS not in found:
            return
        t = found[FUNCTIONS]
        none = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.string())), pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.int64()))
        ids, terms, freqs, left_open = counted(found[BLOCKS], n) if BLOCKS in found else (np.zeros(0, np.int64), none[0].slice(0, 0), none[1].slice(0, 0), np.zeros(0, bool))
        terms, freqs, left_open = pa.concat_arrays([terms, none[0]]), pa.concat_arrays([freqs, none[1]]), np.append(left_open, False)
        func = t["func_id"].to_numpy()
        at = np.searchsorted(ids, func)
        at[at < len(ids)] = np.where(ids[at[at < len(ids)]] == func[at < len(ids)], at[at < len(ids)], len(ids))
        kept = np.ones(len(func), bool) if how == "left" else (np.asarray(terms.value_lengths())[at] > 0) | left_open[at]
        t, at = t.filter(pa.array(kept)), at[kept]
        for lo in range(0, len(at), ROWS_A_BATCH):
            some, cut = at[lo : lo + ROWS_A_BATCH], t.slice(lo, ROWS_A_BATCH).combine_chunks()
            arrays = [pa.concat_arrays(cut[c].chunks) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, terms.take(pa.array(some)), freqs.take(pa.array(some)), pa.array(left_open[some])], schema.names)

    blocks = _gathered(_dealt(source.blocks, "bb_id", parts, BLOCKS), parts, by_block, _CHUNK)
    return _gathered(blocks.union(_dealt(rows, "func_id", parts, FUNCTIONS)), parts, by_function, schema)
