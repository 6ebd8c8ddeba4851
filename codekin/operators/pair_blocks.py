"""Vectors of queries and of all functions that meet in blocks, so that no pair is ever shuffled.

Rows are packed first: those that a task reads become compressed chunks. A shuffle carries each side's chunks
only: those of functions once for each cut of the queries, those of queries once for each block of functions they
may match. A block's dot products come from its postings, the commonest terms as one matrix product; what is
kept of its pairs is decided there, and only that leaves the task, in batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS_A_TASK = 100_000_000
FUNCTIONS_A_BLOCK = (8_000, 20_000)  # least and most
ROWS_A_CHUNK = 4_000  # packed together, at most
QUERIES_A_CUT = 20_000
BUCKETS = 2  # to a power of the ratio; queries meet those of counts that may be within it
CELLS = 250_000  # of the matrix of dot products that is held at a time
ROWS_A_BATCH = 100_000
COMMON = 96  # terms of a block held as a dense matrix, at most
COMMON_SHARE = 0.03  # of a block's functions that hold such a term
DECIMALS = 6


@dataclass
class Side:
    """The rows of one side of a block: ids, files, counts and vectors as postings' raw material."""

    rows: pa.Table
    id: np.ndarray
    file: np.ndarray
    n: np.ndarray
    codes: np.ndarray
    freqs: np.ndarray
    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.row = np.repeat(np.arange(len(self.id)), self.lengths)
        self.squares = np.bincount(self.row, self.freqs**2, minlength=len(self.id))
        self.norm = np.sqrt(self.squares)


def _flat(table: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    lists = pa.concat_arrays(table[name].chunks) if table[name].num_chunks else pa.array([], table.schema.field(name).type)
    return lists.flatten(), np.asarray(lists.value_lengths(), np.int64)


def sides(queries: pa.Table, functions: pa.Table) -> tuple[Side, Side]:
    """Both sides, terms as places in one dictionary."""
    (t1, n1), (t2, n2) = _flat(queries, "terms"), _flat(functions, "terms")
    codes = pa.concat_arrays([t1, t2]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = lambda t, c, n: Side(t, *(t[k].to_numpy() for k in ("id", "file", "n")), c, np.asarray(_flat(t, "freqs")[0], np.float64), n)
    return of(queries, codes[: len(t1)], n1), of(functions, codes[len(t1) :], n2)


def dot_products(q: Side, a: Side) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, dots): the products of the queries from a place to another with all functions of the block."""
    m, n = len(q.id), len(a.id)
    v = int(max(q.codes.max(initial=-1), a.codes.max(initial=-1))) + 1
    order = np.argsort(a.codes, kind="stable")
    code, row, weight = a.codes[order], a.row[order], a.freqs[order]
    size = np.bincount(code, minlength=v)
    first = np.cumsum(size) - size
    common = np.argsort(-size, kind="stable")[:COMMON]
    common = common[size[common] > COMMON_SHARE * n]
    place = np.full(v, -1, np.int64)
    place[common] = np.arange(len(common))
    # by Cauchy and Schwarz no product or part of one is larger; whole numbers below 2^24 are exact in single precision
    kind = np.float32 if q.squares.max(initial=0) * a.squares.max(initial=0) < 2.0**48 else np.float64
    dense = np.zeros((len(common), n), kind)
    held = place[code] >= 0
    dense[place[code[held]], row[held]] = weight[held]
    ends = np.concatenate([[0], np.cumsum(q.lengths)])
    step = max(1, CELLS // max(n, 1))
    for lo in range(0, m, step):
        hi = min(m, lo + step)
        part = slice(ends[lo], ends[hi])
        term, f, who = q.codes[part], q.freqs[part], q.row[part] - lo
        at = place[term]
        c = at >= 0
        w = np.zeros((hi - lo, len(common)), kind)
        w[who[c], at[c]] = f[c]
        dots = w @ dense
        term, f, who = term[~c], f[~c], who[~c]
        k = size[term]
        post = np.arange(k.sum()) + np.repeat(first[term] - (np.cumsum(k) - k), k)
        if len(post):
            cell = np.repeat(who * n, k) + row[post]
            dots += np.bincount(cell, np.repeat(f, k) * weight[post], minlength=dots.size).reshape(dots.shape)
        yield lo, hi, dots


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 places, halves up."""
    return np.floor(x * 10.0**DECIMALS + 0.5) / 10.0**DECIMALS


def cosine(dot: np.ndarray, norm1: np.ndarray, norm2: np.ndarray) -> np.ndarray:
    """Cosine distance, rounded; 1 where a vector is empty."""
    both = norm1 * norm2
    return rounded(1 - np.divide(dot, both, out=np.zeros(np.shape(dot)), where=both > 0))


Kept = tuple[np.ndarray, np.ndarray, "np.ndarray | None"]
#: What is kept of the products ``dots`` of queries from ``lo`` to ``hi``: places of queries, of functions, values.
Rule = Callable[[Side, Side, int, int, np.ndarray], Kept]


def _places(cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.flatnonzero(cells)
    i = np.repeat(np.arange(len(cells)), np.count_nonzero(cells, axis=1))
    return i, flat - i * n


def allowed(q: Side, a: Side, lo: int, hi: int, ratio: int, other_file: bool) -> np.ndarray:
    n1 = q.n[lo:hi, None]
    near = (a.n <= ratio * n1) & (ratio * a.n >= n1)
    if other_file:
        near &= q.file[lo:hi, None] != a.file
    return near


def every_pair(value: str, ratio: int, other_file: bool) -> Rule:
    """All pairs within the ratio with their cosine or Euclidean distance."""

    def rule(q: Side, a: Side, lo: int, hi: int, dots: np.ndarray) -> Kept:
        i, j = _places(allowed(q, a, lo, hi, ratio, other_file), len(a.id))
        dot, i = dots[i, j].astype(np.float64), i + lo
        if value == "cosim":
            return i, j, cosine(dot, q.norm[i], a.norm[j])
        return i, j, rounded(np.sqrt(q.squares[i] + a.squares[j] - 2 * dot))

    return rule


def nearer(below: float, ratio: int, other_file: bool) -> Rule:
    """Pairs within the ratio whose cosine distance is less than ``below``."""

    def rule(q: Side, a: Side, lo: int, hi: int, dots: np.ndarray) -> Kept:
        least = max(0.0, 1 - below - 10.0**-DECIMALS) * (1 - 1e-5)  # for the rounding of single precision
        i, j = _places(dots > (least * q.norm[lo:hi, None]).astype(dots.dtype) * a.norm.astype(dots.dtype), len(a.id))
        dot, i = dots[i, j].astype(np.float64), i + lo
        n1, n2 = q.n[i], a.n[j]
        kept = (n2 <= ratio * n1) & (n1 <= ratio * n2)
        if other_file:
            kept &= q.file[i] != a.file[j]
        i, j, dot = i[kept], j[kept], dot[kept]
        d = cosine(dot, q.norm[i], a.norm[j])
        kept = d < below
        return i[kept], j[kept], d[kept]

    return rule


def nearest(ratio: int, other_file: bool) -> Rule:
    """Of each query the pairs at its lowest cosine distance in the block, if that is below 1."""

    def rule(q: Side, a: Side, lo: int, hi: int, dots: np.ndarray) -> Kept:
        both = q.norm[lo:hi, None] * a.norm
        c = np.divide(dots, both, out=np.zeros(dots.shape), where=both > 0)
        c[~allowed(q, a, lo, hi, ratio, other_file)] = 0
        top = c.max(axis=1, initial=0)
        i, j = _places((c > 0) & (c >= (top - 2 * 10.0**-DECIMALS)[:, None]), len(a.id))
        d = rounded(1 - c[i, j])
        low = np.full(hi - lo, 1.0)
        np.minimum.at(low, i, d)
        kept = (d < 1) & (d == low[i])
        return i[kept] + lo, j[kept], d[kept]

    return rule


def contained(ratio: int, other_file: bool) -> Rule:
    """Pairs within the ratio whose query's terms all are terms of the function; frequencies must be 1."""

    def rule(q: Side, a: Side, lo: int, hi: int, dots: np.ndarray) -> Kept:
        i, j = _places(allowed(q, a, lo, hi, ratio, other_file) & (dots == q.lengths[lo:hi, None]), len(a.id))
        return i + lo, j, None

    return rule


def _batches(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), ROWS_A_BATCH):
        yield pa.RecordBatch.from_arrays([c.slice(at, ROWS_A_BATCH) for c in columns], names)


def pairs_of(rule: Rule, carry: Sequence[str], names: list[str]) -> Callable[[Side, Side], Iterator[pa.RecordBatch]]:
    """What a block gives: ids, value if the rule has one, columns carried from both sides."""

    def block(q: Side, a: Side) -> Iterator[pa.RecordBatch]:
        carried = [[t.rows[c].combine_chunks() for c in carry] for t in (q, a)]
        for lo, hi, dots in dot_products(q, a):
            i, j, value = rule(q, a, lo, hi, dots)
            for at in range(0, len(i), ROWS_A_BATCH):
                part = slice(at, at + ROWS_A_BATCH)
                x, y = i[part], j[part]
                out = [pa.array(q.id[x]), pa.array(a.id[y]), *([] if value is None else [pa.array(value[part])])]
                for c1, c2 in zip(*carried):
                    out += [c1.take(pa.array(x)), c2.take(pa.array(y))]
                yield pa.RecordBatch.from_arrays(out, names)

    return block


def lowest_by_file(ratio: int) -> Callable[[Side, Side], Iterator[pa.RecordBatch]]:
    """(file_id, total, n) of a block that holds whole files: over the queries with a partner in the file, the sum of
    the lowest cosine distances in millionths, and their number."""

    def block(q: Side, a: Side) -> Iterator[pa.RecordBatch]:
        files, at = np.unique(a.file, return_index=True)  # sorted by file
        total, n = np.zeros(len(files), np.int64), np.zeros(len(files), np.int64)
        for lo, hi, dots in dot_products(q, a):
            both = q.norm[lo:hi, None] * a.norm
            c = np.divide(dots, both, out=np.zeros(dots.shape), where=both > 0)
            c[~allowed(q, a, lo, hi, ratio, True)] = -1
            top = np.maximum.reduceat(c, at, axis=1)
            low = np.floor((1 - top) * 10.0**DECIMALS + 0.5).astype(np.int64)
            total += np.where(top >= 0, low, 0).sum(axis=0)
            n += (top >= 0).sum(axis=0)
        kept = n > 0
        yield from _batches([pa.array(files[kept]), pa.array(total[kept]), pa.array(n[kept])], ["file_id", "total", "n"])

    return block


_KEY = ["__bucket", "__part", "__cut"]
_CHUNK = "__bucket int, __no int, __side int, __rows binary"


def packed(rows: pa.Table) -> bytes:
    """Rows as one compressed value; if they have ``terms``, each term is held once."""
    if "terms" in rows.column_names:
        terms = rows["terms"].combine_chunks()
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(terms.value_lengths())]).astype(np.int32), terms.flatten().dictionary_encode())
        rows = rows.set_column(rows.schema.get_field_index("terms"), "terms", lists)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pa.Table:
    rows = pa.ipc.open_stream(value).read_all().combine_chunks()
    if "terms" not in rows.column_names:
        return rows
    lists = rows["terms"].combine_chunks()
    terms = pa.ListArray.from_arrays(lists.offsets, lists.values.dictionary_decode())
    return rows.set_column(rows.schema.get_field_index("terms"), "terms", terms)


def chunks(rows: DataFrame) -> DataFrame:
    """Both sides packed where they are read: ``__side`` 0 holds the queries, 1 all functions, each chunk rows of one
    ``__bucket``. ``__no`` is the chunk's number in its task and bucket plus that of the task, so that chunks can be dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: dict[tuple[int, int], list[pa.Table]] = {}
        count: dict[tuple[int, int], int] = {}

        def given(key: tuple[int, int]) -> pa.RecordBatch:
            value, no = packed(pa.concat_tables(held.pop(key))), count.get(key, 0)
            count[key] = no + 1
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([task + no], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([value], pa.binary())], names)

        names = ["__bucket", "__no", "__side", "__rows"]
        for batch in batches:
            t = pa.Table.from_batches([batch])
            bucket, asked = t["__bucket"].to_numpy(), t["is_query"].to_numpy()
            t = t.drop_columns(["__bucket", "is_query"])
            for b in np.unique(bucket).tolist():
                for side, chosen in ((0, (bucket == b) & asked), (1, bucket == b)):
                    place = np.flatnonzero(chosen)
                    for at in range(0, len(place), ROWS_A_CHUNK):
                        part = t.take(pa.array(place[at : at + ROWS_A_CHUNK]))
                        if (b, side) in held and sum(map(len, held[b, side])) + len(part) > ROWS_A_CHUNK:
                            yield given((b, side))
                        held.setdefault((b, side), []).append(part)
        for key in sorted(held):
            yield given(key)

    return rows.mapInArrow(run, _CHUNK)


def meet(rows: DataFrame, spread: int, block: Callable[[Side, Side], Iterator[pa.RecordBatch]], schema: T.StructType, order: str | None = None) -> DataFrame:
    """The rows that ``block`` gives for the queries and the functions of each key; ``rows`` are chunks with ``_KEY``.
    Functions come by ``order`` if it is given."""
    rows = rows.select(*_KEY, "__side", "__rows").repartition(max(1, min(10_000, 2 * spread)), *_KEY).sortWithinPartitions(*_KEY, "__side")

    def given(parts: dict[int, list[pa.Table]]) -> Iterator[pa.RecordBatch]:
        if len(parts) == 2:
            q, a = (pa.concat_tables(parts[k]) for k in (0, 1))
            yield from block(*sides(q, a.sort_by(order) if order else a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, {}
        for batch in batches:
            for *key, side, value in zip(*(batch.column(k).to_pylist() for k in (*_KEY, "__side")), batch.column("__rows")):
                if key != now:
                    yield from given(parts)
                    now, parts = key, {}
                parts.setdefault(side, []).append(unpacked(value.as_buffer()))
        yield from given(parts)

    return rows.mapInArrow(run, schema)


def bucket_of(n: Column, ratio: int, steps: int = 1) -> Column:
    """Powers of ``ratio``, each in ``steps`` (4 at most); partners lie in the same or one of ``steps`` neighbouring ones on
    either side, 0 is alone."""
    power = F.log(float(ratio), F.greatest(n, F.lit(1)).cast("double"))
    return F.when(n == 0, -5).otherwise(F.floor(power * F.lit(float(steps)) + F.lit(1e-12))).cast("int")


def _rows_a_block(n_queries: int) -> int:
    if _cuts(n_queries) > 1:  # a cut bounds the pairs then; queries are shuffled once for each block
        return FUNCTIONS_A_BLOCK[1]
    return max(FUNCTIONS_A_BLOCK[0], min(FUNCTIONS_A_BLOCK[1], PAIRS_A_TASK // max(1, n_queries)))


def _cuts(n_queries: int) -> int:
    return max(1, -(-n_queries // QUERIES_A_CUT))


def _cut(held: DataFrame, cuts: int) -> DataFrame:
    return held.withColumn("__cut", F.explode(F.when(F.col("__side") == 1, F.sequence(F.lit(0), F.lit(cuts - 1))).otherwise(F.array(F.col("__no") % cuts))))


def pairs(rows: DataFrame, rule: Rule, ratio: int, carry: Sequence[str] = (), valued: bool = True) -> DataFrame:
    """(func1_id, func2_id, value, carried columns with 1 and 2 behind their names) of what ``rule`` keeps.

    ``rows`` is a written table: func_id, file_id, num_ngrams, terms, freqs and ``is_query``. It is counted by
    buckets (a row for each, so at most 90), then read once for either side."""
    rows = rows.where("num_ngrams >= 0").withColumn("__bucket", bucket_of(F.col("num_ngrams"), ratio, BUCKETS))
    found = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("is_query").cast("long")).alias("q")).collect()
    n_queries = sum(r["q"] for r in found)
    size, cuts = _rows_a_block(n_queries), _cuts(n_queries)
    parts = {r["__bucket"]: -(-r["c"] // size) for r in found}
    cut = F.create_map(*[F.lit(x) for item in [(-99, 1), *parts.items()] for x in item])
    columns = [F.col("func_id").alias("id"), F.col("file_id").alias("file"), F.col("num_ngrams").alias("n"), "terms", "freqs", *carry]
    held = chunks(rows.select(*columns, "__bucket", "is_query"))
    to = [F.when((F.col("__side") == 0) | F.lit(d == 0), F.col("__bucket") + d) for d in range(-BUCKETS, BUCKETS + 1)]
    held = held.withColumn("__bucket", F.explode(F.array_compact(F.array(*to)))).withColumn("__parts", F.try_element_at(cut, F.col("__bucket"))).where("__parts > 0")
    # the chunks of queries go to every part, those of functions to every cut
    held = held.withColumn("__part", F.explode(F.when(F.col("__side") == 0, F.sequence(F.lit(0), F.col("__parts") - 1)).otherwise(F.array(F.col("__no") % F.col("__parts")))))
    held = _cut(held, cuts)
    fields = [T.StructField("func1_id", T.LongType()), T.StructField("func2_id", T.LongType()), *([T.StructField("value", T.DoubleType())] if valued else [])]
    fields += [T.StructField(f"{c}{k}", rows.schema[c].dataType) for c in carry for k in (1, 2)]
    return meet(held, cuts * sum(parts.values()), pairs_of(rule, tuple(carry), [f.name for f in fields]), T.StructType(fields))


def lowest(rows: DataFrame, ratio: int) -> DataFrame:
    """(file_id, total, n): ``lowest_by_file`` of all files. Blocks hold whole files; a large one is cut by queries."""
    rows = rows.where("num_ngrams >= 0 AND file_id IS NOT NULL")
    found = rows.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0)).alias("q")).first()
    parts, cuts = max(1, -(-found["c"] // FUNCTIONS_A_BLOCK[1])), _cuts(found["q"])
    columns = [F.col("func_id").alias("id"), F.col("file_id").alias("file"), F.col("num_ngrams").alias("n"), "terms", "freqs"]
    held = chunks(rows.select(*columns, F.pmod(F.xxhash64("file_id"), F.lit(parts)).cast("int").alias("__bucket"), "is_query"))
    held = held.withColumn("__part", F.explode(F.when(F.col("__side") == 0, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array("__bucket")))).withColumn("__bucket", F.lit(0))
    held = _cut(held, cuts)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("file_id", "total", "n")])
    return meet(held, parts * cuts, lowest_by_file(ratio), schema, "file").groupBy("file_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
