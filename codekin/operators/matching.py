"""Matching of call graphs: assignment, spectral matching, alignment score."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekin.plans.scratch import written

SCALE = 10_000  # costs are whole numbers on this scale
INFINITE = 10_000_000
MOST_VERTICES = 2_500  # of a graph held as dense matrices
MOST_CELLS = 30_000_000  # of a matrix of two graphs' vertices
ROWS_A_TASK = 100_000  # pairs of functions, about
OPENED = 1_000_000  # pairs of neighbours looked at in one step


def assignment(cost: np.ndarray, maximise: bool = False) -> np.ndarray:
    """The column of each row in a least-cost assignment of a matrix with no more rows than
    columns. Shortest augmenting paths over potentials; each step is one vector operation."""
    a = -np.asarray(cost, float) if maximise else np.asarray(cost, float)
    n, m = a.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, np.int64)  # 1-based; 0 is free
    for i in range(1, n + 1):
        row_of[0] = i
        j = 0
        least = np.full(m + 1, np.inf)
        way = np.zeros(m + 1, np.int64)
        done = np.zeros(m + 1, bool)
        while row_of[j]:
            done[j] = True
            r = row_of[j]
            reduced = a[r - 1] - u[r] - v[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j
            open_ = np.where(done[1:], np.inf, least[1:])
            j = int(open_.argmin()) + 1
            delta = open_[j - 1]
            u[row_of[done]] += delta
            v[done] -= delta
            least[1:][~done[1:]] -= delta
        while j:
            before = way[j]
            row_of[j] = row_of[before]
            j = before
    out = np.full(n, -1, np.int64)
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def _parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(x, float)
    return (x + x.T) / 2, (x - x.T) / 2


def spectrum(x: np.ndarray, n: int) -> np.ndarray:
    """Absolute eigenvectors of S + iN as rows of x's vertices and n columns by descending eigenvalue,
    as if x were padded with n - len(x) vertices without edges: their zeros stand before the negatives."""
    s, k = _parts(x)
    values, vectors = np.linalg.eigh(s + 1j * k)
    order = np.argsort(-values, kind="stable")
    kept = int((values > -1e-9).sum())
    out = np.zeros((len(x), n))
    out[:, :kept] = np.abs(vectors[:, order[:kept]])
    out[:, n - (len(x) - kept) :] = np.abs(vectors[:, order[kept:]])
    return out


def umeyama(a: np.ndarray, b: np.ndarray, spectrum_a: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The vertex of ``a`` for each vertex of ``b`` (-1 for none), and the score: the squared
    difference of the matched matrices' symmetric and skew parts; 0 for isomorphic graphs matched right.

    Eigenvectors of the Hermitian matrices, both by descending eigenvalue; assignment of most weight
    on |U_B| |U_A|^T. The smaller graph counts as padded with lone vertices, which cost no work: they
    take part in the order of eigenvalues and in the score, not in the assignment."""
    n = max(len(a), len(b))
    match = np.full(len(b), -1, np.int64)
    if len(a) and len(b):
        ua = spectrum_a if spectrum_a is not None and spectrum_a.shape[1] == n else spectrum(a, n)
        weight = spectrum(b, n) @ ua.T
        if len(b) <= len(a):
            match = assignment(weight, maximise=True)
        else:
            match[assignment(weight.T, maximise=True)] = np.arange(len(a))
    score, got = 0.0, np.flatnonzero(match >= 0)
    for x, y in zip(_parts(a), _parts(b)):
        score += (x**2).sum() + (y**2).sum() - 2 * (x[np.ix_(match[got], match[got])] * y[np.ix_(got, got)]).sum()
    return match, max(0.0, float(score))


def sparse_assignment(rows: np.ndarray, cols: np.ndarray, cost: np.ndarray, missing: int) -> np.ndarray:
    """The column of each row (-1 for none) in a least-cost assignment where only the given entries may be
    taken and a row without a column costs ``missing``. ``rows`` are places in ascending order, costs whole numbers.

    Shortest augmenting paths over the given entries alone, so time and memory follow these and not the
    matrix. A column once taken stays taken; a row gives way to none where that is cheapest."""
    n, m = int(rows[-1]) + 1 if len(rows) else 0, int(cols.max(initial=-1)) + 1
    start = np.searchsorted(rows, np.arange(n + 1)).tolist()
    col, weight = cols.tolist(), cost.tolist()
    potential, row_of, to, entry = [0] * m, [-1] * m, [-1] * n, [-1] * n
    for i in range(n):
        least: dict[int, int] = {}
        way: dict[int, tuple[int, int]] = {}
        done: list[int] = []
        heap: list[tuple[int, int]] = []
        r, far, height = i, 0, 0
        none, loser = missing, i  # the cheapest way to leave a row without a column
        end = -1
        while True:
            for k in range(start[r], start[r + 1]):
                j = col[k]
                d = far + weight[k] - potential[j] - height
                if d < none and d < least.get(j, missing):
                    least[j], way[j] = d, (r, k)
                    heappush(heap, (d, row_of[j] >= 0, j))
            while heap and heap[0][0] > least[heap[0][2]]:
                heappop(heap)
            if not heap or heap[0][0] >= none:
                far = none
                break
            far, _, j = heappop(heap)
            if row_of[j] < 0:
                end = j
                break
            done.append(j)
            r = row_of[j]
            height = weight[entry[r]] - potential[j]
            if far + missing - height < none:
                none, loser = far + missing - height, r
        for j in done:
            potential[j] += least[j] - far
        if end < 0:
            if loser == i:
                continue
            end, to[loser], entry[loser] = to[loser], -1, -1
        while True:
            r, k = way[end]
            before = to[r]
            row_of[end], to[r], entry[r] = r, end, k
            if r == i:
                break
            end = before
    return np.array(to, np.int64)


def _places(*keys: np.ndarray) -> np.ndarray:
    """The place of each tuple of keys among the distinct ones in ascending order."""
    out = np.zeros(len(keys[0]), np.int64)
    for key in keys:
        names, place = np.unique(key, return_inverse=True)
        out = np.unique(out * max(1, len(names)) + place, return_inverse=True)[1]
    return out


def _file_pairs(rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str, n: int) -> DataFrame:
    """What ``run`` makes of the rows of each task, which holds whole file2; ``n`` rows in all."""
    rows = rows.repartition(max(1, min(10_000, -(-n // ROWS_A_TASK))), "file2")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if batches := list(batches):
            yield from run(pa.Table.from_batches(batches)).to_batches(max_chunksize=100_000)

    return rows.mapInArrow(task, schema)


_COSTS = ("file1", "file2", "func1_id", "func2_id", "cost")


def _chosen(t: pa.Table, missing: float) -> np.ndarray:
    """Places of the pairs that a least-cost assignment of each pair of files takes."""
    file1, file2, func1, func2, cost = (t[c].to_numpy() for c in _COSTS)
    whole = np.rint(cost * SCALE).astype(np.int64)
    order = np.lexsort((func2, func1, file2, file1))
    order = order[whole[order] < int(missing * SCALE)]
    file1, file2, func1, func2, whole = (x[order] for x in (file1, file2, func1, func2, whole))
    r, c = _places(file1, file2, func1), _places(file1, file2, func2)
    return order[sparse_assignment(r, c, whole, int(missing * SCALE))[r] == c]


def _cost_rows(costs: DataFrame, *more: str) -> DataFrame:
    return costs.select(*[F.col(c).cast("double" if c == "cost" else "long") for c in (*_COSTS, *more)])


def assigned(costs: DataFrame, missing: float = 1.0) -> DataFrame:
    """(file1, file2, func1_id, func2_id, cost) of a least-cost assignment in each pair of files.

    ``costs`` is a written table of these columns, once a pair, cost from 0 to 1; pairs not given cost ``missing``
    and are left out of the result. Costs are taken as whole numbers of 1/10000. A file2's pairs go to one task."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(_chosen(t, missing)))
        return t.set_column(4, "cost", pa.array(np.rint(t["cost"].to_numpy() * SCALE).astype(np.int64) / SCALE))

    return _file_pairs(_cost_rows(costs), run, "file1 long, file2 long, func1_id long, func2_id long, cost double", costs.count())


def kinds(costs: DataFrame, missing: float = 1.0) -> DataFrame:
    """The pair set (func1_id, func2_id, kind) of ``costs``: IS for pairs that ``assigned`` takes, MAY for the others.
    They are marked where they are assigned, so pairs are shuffled once."""

    def run(t: pa.Table) -> pa.Table:
        taken = np.zeros(t.num_rows, bool)
        taken[_chosen(t, missing)] = True
        kind = pa.DictionaryArray.from_arrays(taken.astype(np.int8), ["MAY", "IS"]).dictionary_decode()
        return pa.table({"func1_id": t["func1_id"], "func2_id": t["func2_id"], "kind": kind})

    return _file_pairs(_cost_rows(costs), run, "func1_id long, func2_id long, kind string", costs.count())


def inserted(pairs: DataFrame, more: DataFrame) -> DataFrame:
    """A pair set (func1_id, func2_id, kind) with further pairs, once each; a pair already there keeps its
    kind, so a sure one never becomes a possible one."""
    keys = ["func1_id", "func2_id"]
    return pairs.unionByName(more.dropDuplicates(keys).join(pairs.select(*keys), keys, "left_anti"))


def deleted(pairs: DataFrame, less: DataFrame) -> DataFrame:
    """A pair set without the given pairs."""
    return pairs.join(less.select("func1_id", "func2_id"), ["func1_id", "func2_id"], "left_anti")


def having(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs asked for, with the kind they have in a pair set, null where it lacks them."""
    return asked.select("func1_id", "func2_id").join(pairs.select("func1_id", "func2_id", "kind"), ["func1_id", "func2_id"], "left")


def cluster_costs(costs: DataFrame) -> DataFrame:
    """(func1_id, func2_id, vertex, cluster): a pair's own cost, and the mean cost of all pairs between the
    clusters of its two functions (null where one is in none).

    ``costs`` is a written table as for ``assigned`` with cluster1 and cluster2, numbers that tell a file's clusters
    apart. A file2's pairs go to one task, so pairs are shuffled once."""

    def run(t: pa.Table) -> pa.Table:
        inside = pc.and_(pc.is_valid(t["cluster1"]), pc.is_valid(t["cluster2"])).to_numpy()
        some = t.filter(pa.array(inside))
        keys = ("file1", "cluster1", "file2", "cluster2")
        place, cost = _places(*(some[c].to_numpy() for c in keys)), some["cost"].to_numpy()
        mean = np.zeros(t.num_rows)
        mean[inside] = (np.bincount(place, cost) / np.maximum(np.bincount(place), 1))[place]
        return pa.table({"func1_id": t["func1_id"], "func2_id": t["func2_id"], "vertex": t["cost"], "cluster": pa.array(mean, mask=~inside)})

    rows = _cost_rows(costs, "cluster1", "cluster2")
    return _file_pairs(rows, run, "func1_id long, func2_id long, vertex double, cluster double", costs.count())


def _expanded(first: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``of``, place in the list) for the list of each place of ``of``."""
    k = size[of]
    who = np.repeat(np.arange(len(of)), k)
    return who, np.arange(len(who)) + np.repeat(first[of] - (np.cumsum(k) - k), k)


def pair_neighbours(f1: np.ndarray, f2: np.ndarray, e1: np.ndarray, e2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(parent, child): places of given pairs (once each) of which one calls the other on both sides, in parts of bounded
    size. ``e1`` and ``e2``: calls (caller, callee) of either side, once each."""
    (u1, i1), (u2, i2) = np.unique(f1, return_inverse=True), np.unique(f2, return_inverse=True)
    e1, e2 = (e[np.isin(e, u).all(axis=1)] for e, u in ((e1, u1), (e2, u2)))
    e1, e2 = np.searchsorted(u1, e1), np.searchsorted(u2, e2)
    key = i1 * len(u2) + i2
    order = np.argsort(key, kind="stable")
    keys = key[order]
    # from the callers or from the callees, whichever opens fewer pairs
    opened = [(np.bincount(e1[:, k], minlength=len(u1))[i1] * np.bincount(e2[:, k], minlength=len(u2))[i2]).sum() for k in (0, 1)]
    at = int(opened[1] < opened[0])
    lists = []
    for e, u in ((e1, u1), (e2, u2)):
        e = e[np.argsort(e[:, at], kind="stable")]
        size = np.bincount(e[:, at], minlength=len(u))
        lists.append((np.cumsum(size) - size, size, e[:, 1 - at]))
    (first1, size1, other1), (first2, size2, other2) = lists
    some = np.flatnonzero((size1[i1] > 0) & (size2[i2] > 0))
    for a in _cuts(size1[i1[some]]):
        who, place = _expanded(first1, size1, i1[some[a]])
        pair, one = some[a][who], other1[place]
        for b in _cuts(size2[i2[pair]]):
            who, place = _expanded(first2, size2, i2[pair[b]])
            wanted = one[b][who] * len(u2) + other2[place]
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[found] == wanted
            x, y = pair[b][who[hit]], order[found[hit]]
            yield (y, x) if at else (x, y)


def _cuts(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of about ``OPENED`` in sum."""
    part = np.cumsum(sizes) // OPENED
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    return (slice(lo, hi) for lo, hi in zip(starts, starts[1:]) if lo < hi)


def neighbour_costs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` with child and parent: of each pair the mean cost over pairs of its children and over
    pairs of its parents; null where there is none.

    ``pairs`` is a written table of file1, file2, func1_id, func2_id, cost and columns to carry, once a pair;
    ``edges`` has file_id, fn_parent, fn_child within one file. A file2's pairs and calls meet in one task, so pairs
    of neighbours are never shuffled; calls of file1, the subject's, go to all tasks."""
    subject = edges.join(pairs.select(F.col("file1").alias("file_id")).distinct(), "file_id", "left_semi").select("fn_parent", "fn_child").toPandas()
    e1 = subject.to_numpy(np.int64).reshape(-1, 2)
    carried = [F.col(c) for c in pairs.columns]
    rows = pairs.select(*carried, F.lit(None).cast("long").alias("__p"), F.lit(None).cast("long").alias("__c"))
    none = {c: F.lit(None).cast(pairs.schema[c].dataType) for c in pairs.columns if c != "file2"}
    calls = edges.select(*[none[c].alias(c) if c in none else F.col("file_id").alias("file2") for c in pairs.columns], F.col("fn_parent").alias("__p"), F.col("fn_child").alias("__c"))

    def run(t: pa.Table) -> pa.Table:
        is_call = pc.is_valid(t["__p"])
        calls, t = t.filter(is_call), t.filter(pc.invert(is_call)).drop_columns(["__p", "__c"])
        cost, n = t["cost"].to_numpy(), t.num_rows
        total, count = np.zeros((2, n)), np.zeros((2, n), np.int64)
        if n:
            e2 = np.stack([calls[c].to_numpy() for c in ("__p", "__c")], axis=1)
            for x, y in pair_neighbours(t["func1_id"].to_numpy(), t["func2_id"].to_numpy(), e1, e2):
                for k, (to, of) in enumerate(((x, y), (y, x))):
                    total[k] += np.bincount(to, cost[of], minlength=n)
                    count[k] += np.bincount(to, minlength=n)
        for k, name in enumerate(("child", "parent")):
            mean = total[k] / np.maximum(count[k], 1)
            t = t.append_column(name, pa.array(mean, mask=count[k] == 0))
        return t

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return _file_pairs(rows.unionByName(calls), run, f"{fields}, child double, parent double", pairs.count())


#: Of each version of the alignment score the rounds and the weights of a pair's own cost, its
#: children's and its parents'.
VERSIONS = {1: (0, (1.0, 0.0, 0.0)), 2: (1, (0.5, 0.5, 0.0)), 3: (2, (0.5, 0.25, 0.25))}


def align_scores(
    candidates: DataFrame, edges: DataFrame, sizes: DataFrame, version: int = 3, small: int = 0,
) -> DataFrame:
    """(file1, file2, score): size-weighted cost of the best assignment; 0 identical, 1 unrelated.

    ``version`` 1 takes own costs, 2 also those of children, 3 of children and parents. Functions of less
    than ``small`` bytes are told apart by their calls alone, as their bodies say little: their pairs'
    own cost gives way to the mean of the calls around, where there are any.

    ``candidates``: file1, file2, func1_id, func2_id, cost. Each round mixes a pair's own cost with the
    mean costs of its paired children and parents (its own where it has none). ``sizes``: func_id,
    file_id, func_size of all functions; those of file1 without a partner cost 1."""
    rounds, weights = VERSIONS[version]
    tiny = sizes.where(F.col("func_size") < small).select(F.col("func_id").alias("func1_id"), F.lit(True).alias("tiny"))
    own = now = written(candidates.join(tiny, "func1_id", "left").withColumn("own", F.col("cost")), "candidates")
    edges = written(edges, "edges")
    keys = ["func1_id", "func2_id"]
    for _ in range(rounds):
        around = neighbour_costs(now, edges)
        mixed = weights[0] * F.col("own") + weights[1] * F.coalesce("child", "own") + weights[2] * F.coalesce("parent", "own")
        calls = F.coalesce((F.col("child") + F.col("parent")) / 2, "child", "parent", "own")
        now = written(around.select("file1", "file2", *keys, "own", "tiny", F.when(F.col("tiny"), calls).otherwise(mixed).alias("cost")), "costs")
    matched = assigned(now).join(sizes.select(F.col("func_id").alias("func1_id"), F.col("func_size").alias("size")), "func1_id")
    matched = matched.groupBy("file1", "file2").agg(F.sum((1 - F.col("cost")) * F.col("size")).alias("gain"))
    total = sizes.groupBy(F.col("file_id").alias("file1")).agg(F.sum("func_size").alias("total"))
    pairs = own.select("file1", "file2").distinct()
    return pairs.join(matched, ["file1", "file2"], "left").join(total, "file1").select(
        "file1", "file2", F.round(1 - F.coalesce("gain", F.lit(0.0)) / F.col("total"), 6).alias("score")
    )


def edit_bound(a: np.ndarray, b: np.ndarray) -> int:
    """G16 of two adjacency matrices."""
    return edges_edit_bound(np.argwhere(a > 0), len(a), np.argwhere(b > 0), len(b))


def edges_edit_bound(a: np.ndarray, n1: int, b: np.ndarray, n2: int) -> int:
    """An upper bound of the edit distance of two graphs, all costs 1: vertices are assigned by the
    difference of their degrees, as in the bipartite approximation, and the edits of that map counted.

    ``a`` and ``b`` are distinct edges as pairs of places, ``n1`` and ``n2`` numbers of vertices; only a
    matrix of n1 x n2 is held."""
    if n1 > n2:
        a, n1, b, n2 = b, n2, a, n1
    if not n1:
        return n2 + len(b)
    cost = np.zeros((n1, n2))
    for end in (0, 1):
        difference = np.subtract.outer(np.bincount(a[:, end], minlength=n1).astype(float), np.bincount(b[:, end], minlength=n2))
        cost += np.abs(difference, out=difference)
    to = assignment(cost)
    kept = np.isin(to[a[:, 0]] * n2 + to[a[:, 1]], b[:, 0] * n2 + b[:, 1]).sum()
    return int(n2 - n1 + len(a) + len(b) - 2 * kept)


def spectral_matches(edges: DataFrame, subject: DataFrame, most: int = MOST_VERTICES, most_cells: int = MOST_CELLS) -> DataFrame:
    """G15 and the bound of G16 for one subject graph and every other file: (file1, file2, score, n_edits, n1, n2).

    ``edges``: file_id, fn_parent, fn_child; ``subject``: file1 and its edges e1 as one list, on one row.
    The score takes dense matrices (n x n numbers): it is null where either graph has more than ``most``
    vertices. The bound takes n1 x n2 numbers: it is null above ``most_cells``. Every file has a row."""
    one = subject.select("file1", F.explode("e1").alias("e")).select("file1", "e.fn_parent", "e.fn_child").toPandas()
    subjects = {int(k): x[["fn_parent", "fn_child"]].to_numpy(np.int64) for k, x in one.groupby("file1")}
    graphs = edges.groupBy(F.col("file_id").alias("file2")).agg(F.collect_list(F.struct("fn_parent", "fn_child")).alias("e2"))

    def places(ends: np.ndarray) -> tuple[np.ndarray, int]:
        names = np.unique(ends)
        return np.searchsorted(names, ends), len(names)

    def adjacency(ends: np.ndarray, n: int) -> np.ndarray:
        x = np.zeros((n, n))
        np.add.at(x, (ends[:, 0], ends[:, 1]), 1)
        return x

    def batches(it):
        known: dict[int, tuple] = {}
        for file1, ends in subjects.items():
            e1, n1 = places(ends)
            a = adjacency(e1, n1) if n1 <= most else None
            known[file1] = np.unique(e1, axis=0), n1, a, None if a is None else spectrum(a, n1)
        for pdf in it:
            out = []
            for file2, pairs in zip(pdf.file2, pdf.e2):
                e2, n2 = places(np.array([(p["fn_parent"], p["fn_child"]) for p in pairs], np.int64).reshape(-1, 2))
                for file1, (u1, n1, a, ua) in known.items():
                    if file1 != file2:
                        score = None if a is None or n2 > most else round(umeyama(a, adjacency(e2, n2), ua)[1], 6)
                        edits = None if n1 * n2 > most_cells else edges_edit_bound(u1, n1, np.unique(e2, axis=0), n2)
                        out.append((file1, file2, score, edits, n1, n2))
            rows = pd.DataFrame(out, columns=["file1", "file2", "score", "n_edits", "n1", "n2"])
            yield rows.astype({"file1": "int64", "file2": "int64", "score": "Float64", "n_edits": "Int32", "n1": "int32", "n2": "int32"})

    return graphs.mapInPandas(batches, "file1 long, file2 long, score double, n_edits int, n1 int, n2 int")
