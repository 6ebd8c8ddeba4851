"""Call graph and control flow operators on vertex and edge tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codekin.plans.scratch import written


def graph_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(fn_parent, fn_child, file_id) of the distinct edges with both ends in one file.

    ``vertices`` has func_id, file_id, once each."""
    p = vertices.select(F.col("func_id").alias("fn_parent"), "file_id")
    c = vertices.select(F.col("func_id").alias("fn_child"), F.col("file_id").alias("child_file"))
    rows = edges.select("fn_parent", "fn_child").distinct().join(p, "fn_parent").join(c, "fn_child")
    return rows.where("file_id = child_file").select("fn_parent", "fn_child", "file_id")


def degrees(edges: DataFrame) -> DataFrame:
    """(func_id, n_out, n_in) of every vertex with an edge, without self calls."""
    e = edges.where("fn_parent <> fn_child")
    ends = e.select(F.explode(F.array(F.struct(F.col("fn_parent").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("fn_child").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy(F.col("x.v").alias("func_id")).agg(F.sum("x.o").alias("n_out"), F.sum("x.i").alias("n_in"))


def ranks(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(func_id, rank): 2 calls others and is not called, 1 is called, 0 neither."""
    rows = vertices.select("func_id").join(degrees(edges), "func_id", "left")
    rank = F.when(F.col("n_in") > 0, 1).when(F.col("n_out") > 0, 2).otherwise(0)
    return rows.select("func_id", rank.alias("rank"))


EDGES_HELD = 1_000_000  # that a task of ``stars`` takes at once


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, vertex) of the ends of given edges, the label being the smallest vertex of the component."""
    vertices, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(vertices))
    while True:
        u, v = label[x], label[y]
        apart = u != v
        if not apart.any():
            return vertices[label], vertices
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]


def stars(edges: DataFrame) -> DataFrame:
    """(fn_parent, fn_child): fewer edges with the same weak components and ends: of the edges that a task reads, each
    component's smallest vertex with all its vertices, itself included. Nothing is shuffled; ends are not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("fn_parent", "fn_child")))
            if sum(len(x) for x, _ in held) >= EDGES_HELD:
                known, held = _labels(*map(np.concatenate, zip(known, *held))), []
        a, b = _labels(*map(np.concatenate, zip(known, *held)))
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (a, b)], ["fn_parent", "fn_child"])

    return edges.select(*[F.col(c).cast("long") for c in ("fn_parent", "fn_child")]).mapInArrow(run, "fn_parent long, fn_child long")


def components(vertices: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(func_id, component): weak components by their smallest vertex.

    Alternating large-star and small-star steps; each is one aggregation and one join, and the edges
    shrink towards stars. The number of steps is logarithmic in the size; a vertex with very many
    edges is never collected. Every step is written, so no lineage grows. Raises if ``rounds`` steps
    do not end it: unfinished labels are never returned."""
    e = edges.where("fn_parent <> fn_child").select(F.least("fn_parent", "fn_child").alias("a"), F.greatest("fn_parent", "fn_child").alias("b"))
    e = written(e.distinct(), "star")
    before = None
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))  # large-star: neighbours above a vertex go to the smallest around it
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = e.groupBy("b").agg(F.min("a").alias("m"))  # small-star: neighbours below a vertex, and itself
        e = e.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("x"))
        e = written(e.select("x.a", "x.b").where("a <> b").distinct(), "star")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not converged in {rounds} rounds")
    root = e.groupBy(F.col("b").alias("func_id")).agg(F.min("a").alias("component"))
    return vertices.select("func_id").join(root, "func_id", "left").select("func_id", F.coalesce("component", "func_id").alias("component"))


def reachable(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(src, dst, hops): the fewest calls that lead from src to dst, for every dst that src
    reaches, itself included where it lies on a cycle.

    Goes on until no new pair is found; ``depth`` bounds the calls where only near ones are wanted.
    Every round is written, and only the pairs new in it go on. The result is as large as the
    closure; a caller of very many functions is one more row each, never a list."""
    steps = written(edges.select(F.col("fn_parent").alias("src"), F.col("fn_child").alias("dst")).distinct(), "steps")
    onward = steps.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    known = [steps.withColumn("hops", F.lit(1))]
    front = steps
    while depth is None or len(known) < depth:
        so_far = reduce(DataFrame.unionByName, known).select("src", "dst")
        front = front.join(onward, "dst").select("src", F.col("next").alias("dst")).distinct().join(so_far, ["src", "dst"], "left_anti")
        front = written(front, "front")
        if front.isEmpty():
            break
        known.append(front.withColumn("hops", F.lit(len(known) + 1)))
    return reduce(DataFrame.unionByName, known)


def call_levels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(func_id, level): the longest chain of calls from a root, cycles counting as one vertex.

    One binary's call graph is one group: its size is a binary's, not the collection's."""
    rows = vertices.select("file_id", F.col("func_id").alias("a"), F.lit(None).cast("long").alias("b")).union(edges.where("fn_parent <> fn_child").select("file_id", "fn_parent", "fn_child"))

    def per_file(pdf: pd.DataFrame) -> pd.DataFrame:
        level = longest_levels(pdf.a.unique().tolist(), pdf.dropna(subset=["b"])[["a", "b"]].astype("int64").values.tolist())
        return pd.DataFrame({"func_id": list(level), "level": list(level.values())})

    return rows.groupBy("file_id").applyInPandas(per_file, "func_id long, level int")


def strong_components(vertices: list[int], children: dict[int, list[int]]) -> list[list[int]]:
    """The strongly connected components, every one after those it leads to; without recursion."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    held: set[int] = set()
    stack: list[int] = []
    out: list[list[int]] = []
    for start in vertices:
        if start in number:
            continue
        work = [(start, iter(children.get(start, ())))]
        number[start] = low[start] = len(number)
        stack.append(start)
        held.add(start)
        while work:
            v, rest = work[-1]
            step = next(rest, None)
            if step is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        held.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    out.append(part)
            elif step not in number:
                number[step] = low[step] = len(number)
                stack.append(step)
                held.add(step)
                work.append((step, iter(children.get(step, ()))))
            elif step in held:
                low[v] = min(low[v], number[step])
    return out


def longest_levels(vertices: list[int], edges: list[list[int]]) -> dict[int, int]:
    """Longest chain from a root to each vertex on the graph of strong components."""
    children: dict[int, list[int]] = {}
    for a, b in edges:
        children.setdefault(a, []).append(b)
    parts = strong_components(vertices, children)
    of = {v: i for i, part in enumerate(parts) for v in part}
    level = [0] * len(parts)
    for i in range(len(parts) - 1, -1, -1):  # parents come after their children
        for v in parts[i]:
            for w in children.get(v, ()):
                if of[w] != i:
                    level[of[w]] = max(level[of[w]], level[i] + 1)
    return {v: level[of[v]] for v in vertices}


def recursive_functions(edges: DataFrame) -> DataFrame:
    """(func_id) of the functions that can call themselves, directly or through others; one
    binary's call graph is one group. ``edges`` has file_id, fn_parent, fn_child."""

    def per_file(pdf: pd.DataFrame) -> pd.DataFrame:
        children: dict[int, list[int]] = {}
        for a, b in zip(pdf.fn_parent.tolist(), pdf.fn_child.tolist()):
            children.setdefault(a, []).append(b)
        parts = strong_components(list(children), children)
        found = [v for part in parts for v in part if len(part) > 1 or v in children.get(v, ())]
        return pd.DataFrame({"func_id": pd.Series(found, dtype="int64")})

    return edges.groupBy("file_id").applyInPandas(per_file, "func_id long")


def propagated(vertices: DataFrame, edges: DataFrame, weight: str, tolerance: float = 1e-11, at_once: int = 3) -> DataFrame:
    """(func_id, w): a leaf keeps its weight; any other vertex gets half of 0.3 of its children's
    mean plus 0.7 of its own. A self call makes no child, so its caller's own weight is not counted
    twice; null weights are left out of means.

    Goes on until no weight changes by more than ``tolerance`` (and 1e-13 of itself). A round shrinks a
    change to 0.15 of it, so the rounds are logarithmic in the weights, on cycles too, and the result
    is the one fixed point. ``at_once`` rounds are planned together and written."""
    own = written(vertices.select("func_id", F.col(weight).cast("double").alias("own")), "own")
    edges = written(edges.where("fn_parent <> fn_child").select("fn_parent", "fn_child").distinct(), "edges")
    now = own.select("func_id", F.col("own").alias("w"))
    while True:
        for _ in range(at_once):
            mean = edges.join(now.select(F.col("func_id").alias("fn_child"), "w"), "fn_child").groupBy(F.col("fn_parent").alias("func_id")).agg(F.avg("w").alias("m"))
            rows = own.join(mean, "func_id", "left").join(now.withColumnRenamed("w", "before"), "func_id")
            w = F.when(F.col("m").isNull(), F.col("own")).otherwise((0.3 * F.col("m") + 0.7 * F.col("own")) / 2)
            rows = rows.select("func_id", w.alias("w"), "before")
            now = rows.drop("before")
        rows = written(rows, "weights")
        now = rows.drop("before")
        if rows.where(F.abs(F.col("w") - F.col("before")) > tolerance + 1e-13 * F.abs("w")).isEmpty():
            return now


def spill(edges: DataFrame, sources: DataFrame, hops: int = 2, decay: float = 0.5) -> DataFrame:
    """(fn_parent, fn_child, weight, n_spills): each source (func_id, weight) adds its weight to
    the edges around it in both directions, less by ``decay`` per hop; an edge takes the nearest hop."""
    e = edges.select("fn_parent", "fn_child").distinct()
    ends = e.select(F.col("fn_parent").alias("v"), "fn_parent", "fn_child").union(e.select("fn_child", "fn_parent", "fn_child"))
    front = sources.select(F.col("func_id").alias("src"), F.col("func_id").alias("v"))
    hit = None
    for hop in range(1, hops + 1):
        new = front.join(ends, "v").select("src", "fn_parent", "fn_child").distinct()
        if hit is not None:
            new = new.join(hit, ["src", "fn_parent", "fn_child"], "left_anti")
        new = new.withColumn("hop", F.lit(hop))
        front = new.select("src", F.explode(F.array("fn_parent", "fn_child")).alias("v")).distinct()
        hit = new if hit is None else hit.unionByName(new)
    weighted = hit.join(sources.select(F.col("func_id").alias("src"), "weight"), "src")
    got = weighted.groupBy("fn_parent", "fn_child").agg(F.sum(F.col("weight") * F.pow(F.lit(decay), F.col("hop") - 1)).alias("weight"), F.count(F.lit(1)).alias("n_spills"))
    return e.join(got, ["fn_parent", "fn_child"], "left").select("fn_parent", "fn_child", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("n_spills", F.lit(0).cast("long")).alias("n_spills"))


def normalised(spilled: DataFrame) -> DataFrame:
    """An edge's weight by its number of spills; 0 for untouched edges."""
    return spilled.select("fn_parent", "fn_child", F.when(F.col("n_spills") == 0, 0.0).otherwise(F.col("weight") / F.greatest("n_spills", F.lit(1))).alias("weight"))


def patched(edges: DataFrame, thunks: DataFrame) -> DataFrame:
    """Calls of a thunk (func_id, target) become calls of its target."""
    t = thunks.select(F.col("func_id").alias("fn_child"), "target")
    return edges.join(t, "fn_child", "left").select("fn_parent", F.coalesce("target", "fn_child").alias("fn_child")).distinct()


def range_join(points: DataFrame, ranges: DataFrame, on: list[str], address: str, start: str, end: str, width: int = 4096) -> DataFrame:
    """Points joined to the half-open ranges that hold them, within equal ``on`` columns.

    Ranges are cut at multiples of ``width``, so it is an equi-join on (on, address / width)."""
    spans = ranges.where(F.col(end) > F.col(start)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    rows = points.withColumn("__b", F.floor(F.col(address) / width)).join(spans, [*on, "__b"])
    return rows.where((F.col(address) >= F.col(start)) & (F.col(address) < F.col(end))).drop("__b")


def control_flow(blocks: DataFrame) -> DataFrame:
    """(func_id, bb_id, next1, next2): next1 is the following block of the function unless the
    block ends with a jump, next2 the block with the label that its last jump names.

    Null and foreign targets give null. ``blocks`` has bb_id, func_id, bb_no, stmts."""
    last = F.try_element_at("stmts", F.lit(-1))
    own = Window.partitionBy("func_id").orderBy("bb_no", "bb_id")
    rows = blocks.where("func_id IS NOT NULL").select(
        "func_id", "bb_id", F.lead("bb_id").over(own).alias("following"), F.coalesce(last.startswith("jmp("), F.lit(False)).alias("jumps"),
        F.regexp_extract(last, r"^c?jmp\(.*?name\((pc_0x[0-9a-f]+)\)", 1).alias("target"),
    )
    labels = blocks.select("func_id", F.col("bb_id").alias("next2"), F.explode("stmts").alias("s")).where("s LIKE 'label pc%'")
    labels = labels.select("func_id", F.regexp_extract("s", r"^label (pc_0x[0-9a-f]+):", 1).alias("target"), "next2").groupBy("func_id", "target").agg(F.min("next2").alias("next2"))
    return rows.join(labels.where("target <> ''"), ["func_id", "target"], "left").select(
        "func_id", "bb_id", F.when(~F.col("jumps"), F.col("following")).alias("next1"), "next2"
    )


def dominators(entry: int, successors: dict[int, list[int]]) -> dict[int, int]:
    """The immediate dominator of each block that ``entry`` reaches, but itself; by iteration over
    a reverse postorder."""
    order: list[int] = []
    seen = {entry}
    work = [(entry, iter(successors.get(entry, ())))]
    while work:
        block, rest = work[-1]
        step = next(rest, None)
        if step is None:
            order.append(block)
            work.pop()
        elif step not in seen:
            seen.add(step)
            work.append((step, iter(successors.get(step, ()))))
    place = {b: i for i, b in enumerate(order)}
    before: dict[int, list[int]] = {}
    for b in order:
        for c in successors.get(b, ()):
            before.setdefault(c, []).append(b)
    idom = {entry: entry}
    changed = True
    while changed:
        changed = False
        for b in reversed(order[:-1]):
            known = [p for p in before[b] if p in idom]
            new = known[0]
            for p in known[1:]:
                while p != new:
                    if place[p] < place[new]:
                        p = idom[p]
                    else:
                        new = idom[new]
            if idom.get(b) != new:
                idom[b], changed = new, True
    del idom[entry]
    return idom


def loop_heads(entry: int, successors: dict[int, list[int]]) -> set[int]:
    """Heads of natural loops: targets of an edge from a block that they dominate."""
    idom = dominators(entry, successors)
    out = set()
    for b in [entry, *idom]:
        for head in successors.get(b, ()):
            x: int | None = b
            while x is not None and x != head:
                x = idom.get(x)
            if x == head:
                out.add(head)
    return out


def qt_clusters(starts: list[int], diameter: int) -> list[int]:
    """Cluster number of each address: again and again the most addresses within ``diameter`` form
    the next cluster; of equal ones the one that starts lowest."""
    left = sorted(range(len(starts)), key=lambda i: (starts[i], i))
    out = [0] * len(starts)
    number = 0
    while left:
        number += 1
        best, low, j = (0, 0), 0, 0
        for i in range(len(left)):
            j = max(j, i)
            while j < len(left) and starts[left[j]] - starts[left[i]] <= diameter:
                j += 1
            if j - i > best[0]:
                best, low = (j - i, i), i
        for i in left[low : low + best[0]]:
            out[i] = number
        left = left[:low] + left[low + best[0] :]
    return out


def clustered(functions: DataFrame, diameter: int) -> DataFrame:
    """(func_id, cluster) by start address, file by file."""

    def per_file(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["startea", "func_id"])
        return pd.DataFrame({"func_id": pdf.func_id, "cluster": qt_clusters(pdf.startea.tolist(), diameter)})

    rows = functions.where("startea IS NOT NULL").select("file_id", "func_id", "startea")
    return rows.groupBy("file_id").applyInPandas(per_file, "func_id long, cluster int")


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two sparse matrices (src, dst, value) in coordinate form."""
    right = b.select(F.col("src").alias("mid"), F.col("dst"), F.col("value").alias("y"))
    rows = a.select("src", F.col("dst").alias("mid"), F.col("value").alias("x")).join(right, "mid")
    return rows.groupBy("src", "dst").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def transposed(a: DataFrame) -> DataFrame:
    """The transpose of a sparse matrix."""
    return a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value")


def split_parts(a: DataFrame) -> DataFrame:
    """(src, dst, symmetric, skew): the two parts of a square matrix, whose sum it is; rows where both
    vanish are left out."""
    both = a.select("src", "dst", F.col("value").alias("x"), F.lit(0).alias("y")).union(transposed(a).select("src", "dst", F.lit(0), "value"))
    rows = both.groupBy("src", "dst").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    rows = rows.select("src", "dst", ((F.col("x") + F.col("y")) / 2).alias("symmetric"), ((F.col("x") - F.col("y")) / 2).alias("skew"))
    return rows.where("symmetric <> 0 OR skew <> 0")


def two_step_counts(edges: DataFrame) -> DataFrame:
    """The square of the adjacency matrix: (src, dst, value)."""
    a = edges.select(F.col("fn_parent").alias("src"), F.col("fn_child").alias("dst"), F.lit(1).cast("long").alias("value"))
    return matrix_product(a, a)


def preorder(vertices: DataFrame, children: DataFrame) -> DataFrame:
    """(func_id, path): a key of each function that a root leads to; in its order the functions are listed
    parent before children, children in their places.

    ``children``: fn_parent, fn_child, place; roots are the vertices without another caller. A function
    hangs below the caller over which it is nearest to a root, of several the first in the listing.
    Functions that only cycles lead to have no row. One round a level, each written."""
    calls = written(children.where("fn_parent <> fn_child").select("fn_parent", "fn_child", F.lpad(F.col("place").cast("string"), 6, "0").alias("step")), "calls")
    front = vertices.select("func_id").join(calls.select(F.col("fn_child").alias("func_id")), "func_id", "left_anti")
    known = [written(front.select("func_id", F.lpad(F.col("func_id").cast("string"), 12, "0").alias("path")), "front")]
    while True:
        so_far = reduce(DataFrame.unionByName, known).select("func_id")
        step = known[-1].select(F.col("func_id").alias("fn_parent"), "path").join(calls, "fn_parent")
        step = step.groupBy(F.col("fn_child").alias("func_id")).agg(F.min(F.concat_ws("/", "path", "step")).alias("path"))
        step = written(step.join(so_far, "func_id", "left_anti"), "front")
        if step.isEmpty():
            return reduce(DataFrame.unionByName, known)
        known.append(step)
