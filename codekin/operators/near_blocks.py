"""All functions against each other: pairs with near n-gram vectors that pass the gates, formed in blocks and never shuffled.

Functions are dealt into bands of neighbouring counts, as packed chunks; every two bands that may hold partners are one
task's, and each two functions are looked at once for both orders. A matrix product bounds their cosine first: the
terms of most weight stand for themselves, the others are dealt to groups of which the norms are held, so that by
Cauchy and Schwarz no cosine is larger than its bound. Pairs whose bound suffices are multiplied out in whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codekin.operators.gates import passing
from codekin.operators.pair_blocks import DECIMALS, cosine, packed, unpacked

FUNCTIONS_A_BAND = (4_000, 25_000)  # least and most
STEPS = 8  # counts are told apart by this part of a power of the ratio
HEAVY_NAME = 5_000  # functions of a name that are no longer one task's
COMMON, GROUPS = 96, 160  # terms that stand for themselves, groups of the others
QUERIES_A_STEP, FUNCTIONS_A_STEP = 512, 4_096  # rows and columns of a matrix product
HELD = 20_000_000  # cells of dense vectors
PAIRS_A_STEP = 4_000  # multiplied out at a time
ROWS_A_CHUNK = 100_000
ROWS_A_BATCH = 100_000
ACROSS, WITHIN = (0, 1), 2  # sides of a block of two bands, and the side of a block of one
_CHUNK = "__block int, __side int, __rows binary"


@dataclass
class Search:
    """What is sought: cosine distance ``below``, counts within ``ratio``, names ``any``, ``same`` or ``other``; columns carried
    from the first and the second function; ``shared`` gives the number of ``names`` (imports) that both have."""

    below: float
    ratio: int
    names: str = "any"
    carry1: Sequence[str] = ()
    carry2: Sequence[str] = ()
    shared: bool = False

    def columns(self) -> list[str]:
        more = [*self.carry1, *self.carry2, "c", "i", *(["func_name"] if self.names != "any" else []), *(["names"] if self.shared else [])]
        return list(dict.fromkeys(more))

    def schema(self, rows: T.StructType) -> T.StructType:
        kinds = [("func1_id", T.LongType()), ("func2_id", T.LongType()), ("value", T.DoubleType())]
        kinds += [(f"{c}{k}", rows[c].dataType) for k, carry in ((1, self.carry1), (2, self.carry2)) for c in carry]
        return T.StructType([T.StructField(*x) for x in [*kinds, *([("shared", T.LongType())] if self.shared else [])]])


@dataclass
class Lists:
    """Lists of weighted terms, a row each."""

    codes: np.ndarray
    weights: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.width = int(self.codes.max(initial=-1)) + 1
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.squares = np.bincount(self.row, self.weights**2, minlength=len(self.lengths))
        if self.squares.max(initial=0) < 2.0**24:  # by Cauchy and Schwarz no product is larger: exact in single precision
            self.weights = self.weights.astype(np.float32)
        most = self.weights.max(initial=0)
        self.kind = np.uint8 if most < 2**8 else np.float32 if most < 2.0**24 else np.float64

    def products(self, lo: int, hi: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Dot products of the rows ``x``, which are from ``lo`` to ``hi``, and ``y``."""
        out = np.zeros(len(x))
        if not len(x) or not self.width:
            return out
        held = np.zeros((hi - lo) * self.width, self.kind)
        part = slice(self.starts[lo], self.starts[hi])
        held[(self.row[part] - lo) * self.width + self.codes[part]] = self.weights[part]
        for at in range(0, len(x), PAIRS_A_STEP):
            i, j = (x[at : at + PAIRS_A_STEP] - lo) * self.width, y[at : at + PAIRS_A_STEP]
            k = self.lengths[j]
            first = np.cumsum(k) - k
            place = np.repeat(self.starts[j] - first, k)
            place += np.arange(len(place))
            cell = np.repeat(i, k)
            cell += self.codes[place]
            if len(place):
                some = k > 0
                out[at : at + PAIRS_A_STEP][some] = np.add.reduceat(held[cell] * self.weights[place], first[some])
        return out


def _lists(column: pa.ChunkedArray, weights: pa.ChunkedArray | None = None) -> Lists:
    lists = pa.concat_arrays(column.chunks)
    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    held = np.ones(len(codes)) if weights is None else pa.concat_arrays(weights.chunks).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return Lists(codes, held, np.asarray(lists.value_lengths().fill_null(0), np.int64))


class Block:
    """Rows of a block, those of the second band from ``second`` on; each band in the order of counts."""

    def __init__(self, rows: pa.Table, second: int, search: Search) -> None:
        self.rows, self.second, self.search = rows, second, search
        self.id, self.file, self.n = (rows[c].to_numpy() for c in ("func_id", "file_id", "num_ngrams"))
        self.c, self.i = (rows[c].cast(pa.float64()).fill_null(np.nan).to_numpy() for c in ("c", "i"))
        self.vectors = _lists(rows["terms"], rows["freqs"])
        self.norm = np.sqrt(self.vectors.squares)
        if search.names != "any":
            self.name = pa.concat_arrays(rows["func_name"].chunks).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        if search.shared:
            self.imports = _lists(rows["names"])
        widest = max(self.vectors.width, self.imports.width if search.shared else 0)
        self.step = max(1, min(QUERIES_A_STEP, HELD // max(1, widest)))

    def bounds(self) -> np.ndarray:
        """Rows whose dot products are no less than the cosines."""
        v = self.vectors
        weight = (v.weights / self.norm[v.row]) ** 2
        order = np.argsort(-np.bincount(v.codes, weight, minlength=v.width), kind="stable")
        place, size = np.empty(v.width, np.int64), COMMON + GROUPS
        place[order] = np.where(np.arange(v.width) < COMMON, np.arange(v.width), COMMON + np.arange(v.width) % GROUPS)
        out = np.empty((len(self.id), size), np.float32)
        for lo in range(0, len(out), FUNCTIONS_A_STEP):
            hi = min(len(out), lo + FUNCTIONS_A_STEP)
            part = slice(v.starts[lo], v.starts[hi])
            out[lo:hi] = np.sqrt(np.bincount((v.row[part] - lo) * size + place[v.codes[part]], weight[part], minlength=(hi - lo) * size)).reshape(-1, size)
        return out

    def reached(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, x, y): of the rows from a place to another the pairs whose bound suffices."""
        m, n, ratio, most = self.bounds(), self.n, self.search.ratio, len(self.id)
        least = np.float32(1 - self.search.below - 10.0**-DECIMALS - 1e-4)  # for rounding and single precision
        for lo in range(0, self.second or most, self.step):
            hi = min(self.second or most, lo + self.step)
            first = lo if not self.second else self.second + int(np.searchsorted(n[self.second :], n[lo] / ratio))
            last = self.second + int(np.searchsorted(n[self.second :], ratio * n[hi - 1], "right"))
            xs, ys = [], []
            for at in range(first, last, FUNCTIONS_A_STEP):
                to = min(last, at + FUNCTIONS_A_STEP)
                x, y = np.divmod(np.flatnonzero(m[lo:hi] @ m[at:to].T > least), to - at)
                x, y = x + lo, y + at
                if not self.second and at < hi:
                    x, y = x[y > x], y[y > x]
                xs.append(x)
                ys.append(y)
            if xs:
                yield lo, hi, np.concatenate(xs), np.concatenate(ys)

    def named(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The same of the pairs of one name; rows are in the order of names."""
        last = np.searchsorted(self.name, self.name, "right")
        for lo in range(0, len(self.id), self.step):
            hi = min(len(self.id), lo + self.step)
            rows = np.arange(lo, hi)
            k = last[rows] - rows - 1
            yield lo, hi, np.repeat(rows, k), np.arange(k.sum()) + np.repeat(rows + 1 - (np.cumsum(k) - k), k)

    def found(self, reached: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
        """(x, y, value, shared) of the pairs in both orders that pass."""
        s, c, i, n = self.search, self.c, self.i, self.n
        for lo, hi, x, y in reached:
            kept = (self.file[x] != self.file[y]) & (n[x] <= s.ratio * n[y]) & (n[y] <= s.ratio * n[x])
            if s.names != "any":
                kept &= (self.name[x] >= 0) & (self.name[y] >= 0) & ((self.name[x] == self.name[y]) == (s.names == "same"))
            x, y = x[kept], y[kept]
            one, two = passing(c[x], c[y], i[x], i[y]), passing(c[y], c[x], i[y], i[x])
            kept = one | two
            x, y, one, two = x[kept], y[kept], one[kept], two[kept]
            dot = self.vectors.products(lo, hi, x, y)
            value = np.copysign(cosine(dot, self.norm[x], self.norm[y]), 1 - dot / (self.norm[x] * self.norm[y]))  # SQL rounds to -0.0 too
            kept = value < s.below
            x, y, one, two, value = x[kept], y[kept], one[kept], two[kept], value[kept]
            shared = self.imports.products(lo, hi, x, y).astype(np.int64) if s.shared else np.zeros(len(x), np.int64)
            yield tuple(np.concatenate([a[one], b[two]]) for a, b in ((x, y), (y, x), (value, value), (shared, shared)))

    def batches(self, found: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
        s = self.search
        carried = {c: pa.concat_arrays(self.rows[c].chunks) for c in {*s.carry1, *s.carry2}}
        for x, y, value, shared in found:
            for at in range(0, len(x), ROWS_A_BATCH):
                part = slice(at, at + ROWS_A_BATCH)
                i, j = pa.array(x[part]), pa.array(y[part])
                out = [pa.array(self.id[x[part]]), pa.array(self.id[y[part]]), pa.array(value[part])]
                out += [carried[c].take(k) for k, carry in ((i, s.carry1), (j, s.carry2)) for c in carry]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(shared[part])] if s.shared else [])], names)


def _meet(rows: DataFrame, band: Column, to: list[list[tuple[int, int]]], blocks: int, block: Callable[[dict[int, pa.Table]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """What ``block`` gives for the rows of each block by side. ``to`` has the blocks and sides of each band."""
    tasks = max(1, min(10_000, blocks))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def given() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            at = t["__band"].to_numpy()
            t, order = t.drop_columns(["__band"]), np.argsort(at, kind="stable")
            for b, lo, k in zip(*np.unique(at[order], return_index=True, return_counts=True)):
                if to[b]:
                    value = packed(t.take(pa.array(order[lo : lo + k])))
                    for no, side in to[b]:
                        yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([side], pa.int32()), pa.array([value], pa.binary())], ["__block", "__side", "__rows"])
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ROWS_A_CHUNK:
                yield from given()
        if held:
            yield from given()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, {}
        for batch in batches:
            for no, side, value in zip(batch.column("__block").to_pylist(), batch.column("__side").to_pylist(), batch.column("__rows")):
                if no != now:
                    yield from block({k: pa.concat_tables(p).combine_chunks() for k, p in parts.items()})
                    now, parts = no, {}
                parts.setdefault(side, []).append(unpacked(value.as_buffer()))
        yield from block({k: pa.concat_tables(p).combine_chunks() for k, p in parts.items()})

    held = rows.withColumn("__band", band).mapInArrow(chunks, _CHUNK)
    return held.repartitionById(tasks, F.col("__block") % tasks).sortWithinPartitions("__block").mapInArrow(run, schema)


def _read(rows: DataFrame, search: Search) -> DataFrame:
    return rows.where("num_ngrams >= 0 AND file_id IS NOT NULL").select(*dict.fromkeys(("func_id", "file_id", "num_ngrams", "terms", "freqs", *search.columns())))


def near(rows: DataFrame, search: Search) -> DataFrame:
    """(func1_id, func2_id, value, carried columns with 1 and 2 behind their names, shared): the ordered pairs of functions of two
    files that ``search`` seeks and whose c (complexity) and i (imports) pass the gates.

    ``rows`` is a written table: func_id, file_id, num_ngrams, terms, freqs (not empty) and what the search carries. It is
    counted by counts of n-grams first (a row for each eighth of a power of the ratio, so at most 320)."""
    rows, schema = _read(rows, search), search.schema(rows.schema)
    n = F.col("num_ngrams")
    step = F.when(n == 0, -1).otherwise(F.floor(F.log(float(search.ratio), F.greatest(n, F.lit(1)).cast("double")) * STEPS)).cast("int")
    found = sorted(rows.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c"), F.min(n).alias("lo"), F.max(n).alias("hi")).collect(), key=lambda r: r["s"])
    size = max(FUNCTIONS_A_BAND[0], min(FUNCTIONS_A_BAND[1], sum(r["c"] for r in found) // 8))
    bands: list[list[int]] = []  # least and greatest count, functions
    place = {}
    for r in found:
        parts = -(-r["c"] // size)
        if bands and parts == 1 and bands[-1][2] + r["c"] <= size:
            bands[-1][1:] = r["hi"], bands[-1][2] + r["c"]
        else:
            bands += [[r["lo"], r["hi"], r["c"] // parts] for _ in range(parts)]
        place[r["s"]] = len(bands) - parts, parts
    to: list[list[tuple[int, int]]] = [[] for _ in bands]
    blocks = 0
    for x, one in enumerate(bands):
        for y, two in enumerate(bands[x:], x):
            if two[0] <= search.ratio * one[1]:
                for band, side in ((x, WITHIN),) if x == y else ((x, ACROSS[0]), (y, ACROSS[1])):
                    to[band].append((blocks, side))
                blocks += 1
    at = [F.try_element_at(F.create_map(*[F.lit(v) for s, p in [(-9, (0, 1)), *place.items()] for v in (s, p[k])]), step) for k in (0, 1)]
    names = [f.name for f in schema]

    def block(parts: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        if set(parts) in (set(ACROSS), {WITHIN}):
            tables = [parts[k].sort_by("num_ngrams") for k in sorted(parts)]
            b = Block(pa.concat_tables(tables).combine_chunks(), len(tables[0]) if len(tables) == 2 else 0, search)
            yield from b.batches(b.found(b.reached()), names)

    return _meet(rows, at[0] + F.pmod(F.xxhash64("func_id"), at[1]).cast("int"), to, blocks, block, schema)


def near_of_a_name(rows: DataFrame, search: Search) -> DataFrame:
    """``near`` of functions of one name, from equal names. ``rows`` have ``n_named`` besides, the functions of their name; those
    of more than ``HEAVY_NAME`` meet as in ``near``."""
    schema, names = search.schema(rows.schema), [f.name for f in search.schema(rows.schema)]
    many = rows.where(F.col("n_named") > HEAVY_NAME)
    few = _read(rows.where(F.col("n_named") <= HEAVY_NAME), search)
    parts = max(8, min(10_000, -(-few.count() // FUNCTIONS_A_BAND[1])))

    def block(found: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        if found:
            t = found[WITHIN].sort_by("func_name")
            b = Block(t.combine_chunks(), 0, search)
            yield from b.batches(b.found(b.named()), names)

    out = _meet(few, F.pmod(F.xxhash64("func_name"), F.lit(parts)).cast("int"), [[(k, WITHIN)] for k in range(parts)], parts, block, schema)
    return out if many.isEmpty() else out.unionByName(near(many, search))
